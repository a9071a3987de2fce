"""Exact top-k search by a three-phase uniform threshold (operator 12).

A score is the inner product of two integer vectors. Vectors are cut into LISTS segments, and for a query each segment is a list of all
candidates by their partial scores; a task is the node that holds all lists of its rows. Queries come in blocks, and blocks of candidates meet
blocks of queries through a broadcast of at most HELD bytes, as many waves as the queries need.

Phase 1: for each list a task gathers the K entries with the highest partial scores and sums up their candidates in all lists. The K-th best
sum of all tasks is a cutoff that is safe: K candidates reach it. Phase 2: it is broadcast with the queries. A candidate that reaches
it has a partial score of at least cutoff / LISTS in some list, so only such entries are collected; a candidate whose
collected scores, with cutoff / LISTS for the lists in which it was not collected, fall short of the cutoff is out. Phase 3: what remains gets
its missing partial scores and so its exact score; those that reach the cutoff, K a query and task at most, meet in the ranking. So the rows
that move are K a query and task, however many candidates there are, and no large table is shuffled.

Defined cases: vectors that are null or hold null or non-finite components take no part; integers are held within 2**30 / length; vectors of
different lengths are not compared, and empty vectors score 0; equal scores go to the smaller vec_id, a null vec_id last and never a query;
a candidate with the query's vec_id is left out; candidates that repeat are ranked as often as they are there; queries that repeat count
once, and queries with one vec_id and different vectors are ranked each for itself; extra columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, drop_written, from_id, to_id, trimmed, written
from .integers import doubles, integer_rows, usable

K, EVERY, FACTOR, LISTS = 5, 50, 256.0, 4
#: Rows of a block of queries and of candidates; bytes of queries that a wave broadcasts; queries compared at once.
QUERIES, CANDIDATES, HELD, AT_ONCE = 4096, 2048, 32 << 20, 256
#: No score is as low, and no cutoff below it can hold anything back.
LOWEST = -(2**62)

BLOCK = "length int, ids binary, ints binary"


def packed(block: int):
    """(id, vec) to blocks of up to so many vectors of one length."""

    def rows(length: int, ids: list, ints: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([length], pa.int32()), pa.array([np.concatenate(ids).tobytes()]), pa.array([np.concatenate(ints).astype(np.int32).tobytes()])], names=["length", "ids", "ints"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, int]] = {}
        for batch in batches:
            every = batch.column(0).to_numpy()
            for at, x in integer_rows(batch.column(1), FACTOR):
                for k in range(0, len(at), block):
                    ids, ints, n = held.pop(x.shape[1], ([], [], 0))
                    ids, ints, n = [*ids, every[at[k : k + block]]], [*ints, x[k : k + block]], n + len(at[k : k + block])
                    if n >= block:
                        yield rows(x.shape[1], ids, ints)
                    else:
                        held[x.shape[1]] = ids, ints, n
        for length, (ids, ints, _) in held.items():
            yield rows(length, ids, ints)

    return run


def segments(length: int) -> list[slice]:
    """Up to LISTS equal runs of components; one that is empty has no list."""
    edges = [length * k // LISTS for k in range(LISTS + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if b > a] or [slice(0, 0)]


def partial_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(lists, queries, rows): exact, in double precision if all sums fit into it and in 64-bit integers if not."""
    length = rows.shape[1]
    peak = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, length)
    kind = np.float64 if peak < 2**53 else np.int64
    queries, rows = queries.astype(kind), rows.astype(kind)
    return np.stack([queries[:, s] @ rows[:, s].T for s in segments(length)])


def highest(scores: np.ndarray, k: int) -> np.ndarray:
    """Marks at least the k highest of each row, and all that are equal to the k-th."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    return scores >= np.partition(scores, -k, axis=1)[:, -k][:, None]


class Best:
    """The k best of every query so far: scores (descending) and ids, by score and then the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.ids = k, np.full((n, k), LOWEST, np.int64), np.full((n, k), NO_ID, np.int64)

    def add(self, at: slice, scores: np.ndarray, ids: np.ndarray, mark: np.ndarray) -> None:
        """The marked scores (queries, rows) of these ids."""
        q, j = np.nonzero(mark)
        some = scores[q, j].astype(np.int64)
        reach = some >= self.scores[at][q, -1]
        q, some, j = q[reach], some[reach], j[reach]
        if not len(q):
            return
        asked = np.unique(q)
        rows = np.arange(at.start, at.stop)[asked]
        q = np.concatenate([q, np.repeat(asked, self.k)])
        some = np.concatenate([some, self.scores[rows].ravel()])
        own = np.concatenate([ids[j], self.ids[rows].ravel()])
        order = np.lexsort((own, -some, q))
        q, some, own = q[order], some[order], own[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.scores[rows], self.ids[rows] = some[kept].reshape(-1, self.k), own[kept].reshape(-1, self.k)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(y, cutoffs or None, query ids, queries, ids, vectors) for each pair of blocks."""
    for batch in batches:
        for row in range(batch.num_rows):
            r = {c: batch.column(c)[row] for c in batch.schema.names}
            length = r["length"].as_py()
            ids, of = (np.frombuffer(r[c].as_buffer(), np.int64) for c in ("ids", "q_ids"))
            ints, asked = (np.frombuffer(r[c].as_buffer() or b"", np.int32).reshape(n, length) for c, n in (("ints", len(ids)), ("q_ints", len(of))))
            cuts = np.frombuffer(r["cuts"].as_buffer(), np.int64) if "cuts" in r else None
            yield r["y"].as_py(), cuts, of, asked, ids, ints


def gather(k: int):
    """Phase 1. Pairs of blocks to (y, q, score): the k best sums of candidates that stand high in some list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for y, _, of, asked, ids, ints in _blocks(batches):
            own = best.setdefault(y, Best(len(of), k))
            for at in (slice(a, min(a + AT_ONCE, len(of))) for a in range(0, len(of), AT_ONCE)):
                lists = partial_scores(asked[at], ints)
                others = of[at][:, None] != ids[None, :]
                # the query's own row may take a place in a list, so each list is one entry longer
                listed = np.logical_or.reduce([highest(scores, k + 1) for scores in lists])
                own.add(at, lists.sum(axis=0), ids, listed & others)
        yield from _ranked(best)

    return run


def resolve(k: int):
    """Phases 2 and 3. Pairs of blocks to (y, q, id, score): the k best of the candidates that reach the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for y, cuts, of, asked, ids, ints in _blocks(batches):
            own = best.setdefault(y, Best(len(of), k))
            for at in (slice(a, min(a + AT_ONCE, len(of))) for a in range(0, len(of), AT_ONCE)):
                lists = partial_scores(asked[at], ints)
                cut = cuts[at][:, None]
                # the least integer that reaches an equal share of the cutoff
                share = -(-cut // len(lists))
                collected = lists >= share
                known = np.where(collected, lists, share).sum(axis=0)
                remains = collected.any(axis=0) & (known >= cut) & (of[at][:, None] != ids[None, :])
                exact = np.where(remains, lists.sum(axis=0), LOWEST)
                own.add(at, exact, ids, remains & (exact >= cut))
        yield from _ranked(best)

    return run


def _ranked(best: dict[int, Best]) -> Iterator[pa.RecordBatch]:
    for y, own in best.items():
        q, place = np.nonzero(own.scores > LOWEST)
        yield pa.record_batch([pa.array(np.full(len(q), y)), pa.array(q), pa.array(own.ids[q, place]), pa.array(own.scores[q, place])], names=["y", "q", "id", "score"])


FOUND = "y long, q long, id long, score long"


def waves(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, last) numbers of blocks (number, bytes), in order, that HELD bytes hold."""
    out: list[list[int]] = []
    size = 0
    for y, n in sorted(blocks):
        if not out or size + n > HELD:
            out.append([y, y])
            size = 0
        out[-1][1] = y
        size += n
    return [(a, b) for a, b in out]


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("y", "q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_scores(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by `every`."""
    rows = vectors.select(to_id(id_col).alias("id"), doubles(vectors, vector_col).alias("vec")).where(usable(F.col("vec")))
    asked = rows.where((F.col("id") % every == 0) & (F.col("id") != NO_ID)).distinct()
    asked = asked.coalesce(max(1, -(-rows.where(F.col("id") % every == 0).count() // (16 * QUERIES))))
    # written, as a block must hold the same queries in every phase
    blocks = written(asked.mapInArrow(trimmed(packed(QUERIES)), BLOCK).select(F.monotonically_increasing_id().alias("y"), "length", F.col("ids").alias("q_ids"), F.col("ints").alias("q_ints")), "queries")
    candidates = rows.mapInArrow(trimmed(packed(CANDIDATES)), BLOCK)
    out = None
    for first, last in waves([tuple(r) for r in blocks.select("y", F.length("q_ids") + F.length("q_ints")).collect()]):
        some = blocks.where(F.col("y").between(first, last))
        listed = candidates.join(F.broadcast(some), "length").mapInArrow(trimmed(gather(k)), FOUND)
        cuts = ranked(listed, k).where(F.col("rank") == k).select("y", "q", "score")
        cuts = written(cuts.groupBy("y").agg(F.collect_list(F.struct("q", "score")).alias("found")), "cutoffs")
        ready = some.join(cuts, "y", "left").mapInArrow(cutoffs, "y long, length int, q_ids binary, q_ints binary, cuts binary")
        found = ranked(candidates.join(F.broadcast(ready), "length").mapInArrow(trimmed(resolve(k)), FOUND), k)
        found = found.join(F.broadcast(some.select("y", "q_ids").mapInArrow(numbered, "y long, q long, query_id long")), ["y", "q"])
        found = written(found.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"), "found")
        drop_written(cuts)
        out = found if out is None else out.union(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    return out.select("query_id", "rank", from_id("id").alias("vec_id"), "score")


def cutoffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries with their cutoffs by the query's place in the block; a query with fewer than k candidates has none."""
    for batch in batches:
        cuts = []
        for ids, found in zip(batch.column("q_ids"), batch.column("found").to_pylist()):
            cut = np.full(len(ids.as_buffer()) // 8, LOWEST)
            for r in found or ():
                cut[r["q"]] = r["score"]
            cuts.append(cut.tobytes())
        yield pa.record_batch([*(batch.column(c) for c in ("y", "length", "q_ids", "q_ints")), pa.array(cuts, pa.binary())], names=["y", "length", "q_ids", "q_ints", "cuts"])


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries to a row a query: its block, its place and its id."""
    for batch in batches:
        for y, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(ids.as_buffer(), np.int64)
            yield pa.record_batch([pa.array(np.full(len(own), y)), pa.array(np.arange(len(own))), pa.array(own)], names=["y", "q", "query_id"])
