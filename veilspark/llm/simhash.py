"""SimHash near-dedup with pigeonring filtering (operator 9).

A fingerprint's 64 bits are split into SEGMENTS segments on a ring. If two fingerprints differ in at most
LIMIT bits, there is a segment from which every chain of l consecutive segments differs in at most
floor(l * LIMIT / SEGMENTS) bits (the pigeonring principle): the first segment is equal, the first two
differ in at most one bit, the first three in two, and so on.

Candidates are found by the first two conditions: a key holds the start, its segment and the next segment with
one of its bits cleared. Fingerprints that share a key are compared: the cumulative differences of three and of
four segments prune pairs before the full Hamming check. Every key run keeps only the edges of a spanning forest, as the
result asks for components; a run of over RUN fingerprints is dealt out as pairs of blocks, so no
task holds it and no pair of it is skipped. Keys that a thousandth of all fingerprints share are counted first, and their rows
dealt to blocks without passing one task.

Defined cases: a null or wordless text has fingerprint 0 and links like any other; rows with equal texts share a
fingerprint and a component; ties need no rule, as a component's name is its smallest id; a very long text is hashed a PIECE at
a time, with about three times its bytes held; a null doc_id sorts last and is null again in the result (also as a component
made of null ids alone); rows with the same doc_id, or equal in all columns, are rows of their own in the result; extra columns are
ignored, or passed through under their own names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, components, from_id, hot_join, small, to_id, trimmed, unpacked, whole_row, written

SHINGLE, SEED, LIMIT = 4, 42, 4
WIDTHS = (13, 13, 13, 13, 12)
SEGMENTS = len(WIDTHS)
STARTS = tuple(sum(WIDTHS[:k]) for k in range(SEGMENTS))
#: Differences that a chain of 1, 2, ... segments may have.
BUDGET = tuple((k + 1) * LIMIT // SEGMENTS for k in range(SEGMENTS))
#: Rows of a key that one task compares; longer runs are dealt out by pairs of blocks.
RUN = 2048
PAIRS = 1 << 20
_HASHES = 1 << 15
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


#: Bytes of a text that are hashed at once; the cut is moved to white space.
PIECE = 1 << 20


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, some at a time; split() and lower() treat exactly U+0009-U+000D, space and A-Z."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            m = _SPACE.search(text, end)
            end = m.start() if m else len(text)
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, some at a time; the last words of a piece go before the next one's."""
    digest = xxhash.xxh64_intdigest
    last: list[bytes] = []
    found = 0
    for own in _pieces(text):
        words = last + own
        n = len(words)
        last = words[max(0, n - SHINGLE + 1) :]
        if n < SHINGLE:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[:-1]])
        found += n - SHINGLE + 1
        yield np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), (ends[SHINGLE - 1 :] - 1).tolist())), np.uint64, n - SHINGLE + 1)
    if not found and last:
        yield np.array([digest(b" ".join(last), SEED)], np.uint64)


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint; 0 without words."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text):
        n += len(h)
        for k in range(0, len(h), _HASHES):
            bits = np.unpackbits(h[k : k + _HASHES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big") if n else 0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text) to (..., fp)."""
    for batch in batches:
        *others, texts = batch.columns
        fps = np.array([fingerprint(x.as_py() or b"") for x in texts.cast(pa.binary())], np.uint64).view(np.int64)
        yield pa.record_batch([*others, pa.array(fps, pa.int64())], names=[*batch.schema.names[:-1], "fp"])


def rotated(fp: np.ndarray, start: np.ndarray) -> np.ndarray:
    """fp (uint64) turned so that the segment with number `start` is lowest."""
    by = np.array(STARTS, np.uint64)[start]
    return (fp >> by) | (fp << ((np.uint64(64) - by) % np.uint64(64)))


def _ring_masks() -> np.ndarray:
    """masks[start, l]: the lowest bits that l + 1 segments from `start` take."""
    widths = np.array([[WIDTHS[(s + k) % SEGMENTS] for k in range(SEGMENTS)] for s in range(SEGMENTS)]).cumsum(axis=1)
    return np.array([[(1 << int(w)) - 1 for w in row] for row in widths], np.uint64)


MASKS = _ring_masks()


def chain_keys(fp: np.ndarray) -> np.ndarray:
    """(n, 64) keys of the chains of two segments: start, segment, cleared bit, next segment without that bit."""
    out = []
    for s in range(SEGMENTS):
        turned = rotated(fp, np.full(len(fp), s))
        first = turned & MASKS[s, 0]
        second = (turned & MASKS[s, 1]) >> np.uint64(WIDTHS[s])
        for j in range(WIDTHS[(s + 1) % SEGMENTS]):
            head = np.uint64((s << 4 | j) << 26)
            out.append(head | first << np.uint64(13) | second & ~np.uint64(1 << j))
    return np.stack(out, axis=1).view(np.int64)


def _first_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) to (start, segment, n): how many fingerprints have each first segment, summed up within the task."""
    counts = [np.zeros(1 << w, np.int64) for w in WIDTHS]
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for s in range(SEGMENTS):
            counts[s] += np.bincount((rotated(fps, np.full(len(fps), s)) & MASKS[s, 0]).astype(np.int64), minlength=1 << WIDTHS[s])
    for s, own in enumerate(counts):
        at = np.flatnonzero(own)
        yield pa.record_batch([pa.array(np.full(len(at), s, np.int32)), pa.array(at), pa.array(own[at])], names=["start", "segment", "n"])


def _keyed(hot: dict[int, int], wanted: bool, within: frozenset | None = None):
    """(fp) to (key, fp, block): rows of the hot keys with a block of theirs by a hash of the fingerprint (wanted), or all others. within:
    only keys that begin with one of these (start, segment)."""
    names = np.array(sorted(hot), np.int64)
    blocks = np.array([hot[k] for k in names.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fps), 4096):
                part = fps[k : k + 4096]
                keys = chain_keys(part.view(np.uint64))
                own = np.repeat(part, keys.shape[1])
                keys = keys.ravel()
                if within is not None:
                    some = np.isin(keys >> 30 << 13 | keys >> 13 & 0x1FFF, np.array([s << 13 | x for s, x in within]))
                    keys, own = keys[some], own[some]
                block = np.zeros(len(keys), np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
                    is_hot = names[at] == keys
                    some = is_hot == wanted
                    keys, own, at = keys[some], own[some], at[some]
                    mixed = own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    block = ((mixed >> np.uint64(33)).astype(np.int64) % blocks[at]) if wanted else np.zeros(len(keys), np.int64)
                yield pa.record_batch([pa.array(keys), pa.array(own), pa.array(block)], names=["key", "fp", "block"])

    return run


def hot_keys(fps: DataFrame, n: int) -> dict[int, int]:
    """Keys with at least RUN and a HOT_SHARE of the n fingerprints, and in how many blocks to deal them: at most 1 / HOT_SHARE keys for each of a
    fingerprint's 64. Only first segments with that many fingerprints can have such keys, so most are never counted."""
    least = max(RUN + 1, int(n * HOT_SHARE) + 1)
    first = fps.mapInArrow(trimmed(_first_segments), "start int, segment long, n long").groupBy("start", "segment").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    within = frozenset((r.start, r.segment) for r in first.collect())  # under SEGMENTS / HOT_SHARE rows
    if not within:
        return {}
    counted = fps.mapInArrow(trimmed(_keyed({}, False, within)), "key long, fp long, block long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return {r.key: -(-r.n // RUN) for r in counted.collect()}


def linked(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints (uint64) that share a key are within LIMIT: longer chains first, then all bits."""
    start = (keys >> 30).astype(np.int64)
    diff = rotated(a ^ b, start)
    left = np.arange(len(a))
    for k in range(2, SEGMENTS):
        left = left[np.bitwise_count(diff[left] & MASKS[start[left], k]) <= BUDGET[k]]
    return left


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node of the given edges to its component's smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            break
        for side in (a, b):
            np.minimum.at(label, label[side], least)
            np.minimum.at(label, side, least)
        while (label != (up := label[label])).any():
            label = up
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


class _Edges:
    """Gathers linked pairs and keeps no more than a spanning forest of them."""

    def __init__(self) -> None:
        self.u, self.v, self.n = [], [], 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.u.append(u)
        self.v.append(v)
        self.n += len(u)
        if self.n > PAIRS:
            self.shrink()

    def shrink(self) -> None:
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.u, self.v))
        u, v = forest(u, v) if len(u) else (u, v)
        self.u, self.v, self.n = [u], [v], len(u)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.shrink()
        out = self.u[0], self.v[0]
        self.u, self.v, self.n = [], [], 0
        return out


def compare_runs(keys: np.ndarray, fps: np.ndarray, edges: _Edges) -> None:
    """Compares all rows that share a key; keys are sorted, and no key has over RUN rows."""
    if len(keys) < 2:
        return
    ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1
    after = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(len(keys)) - 1
    raw = fps.view(np.uint64)
    left = np.flatnonzero(after >= 1)
    step = 1
    while len(left):
        for k in range(0, len(left), PAIRS):
            x = left[k : k + PAIRS]
            hit = x[linked(keys[x], raw[x], raw[x + step])]
            edges.add(fps[hit], fps[hit + step])
        step += 1
        left = left[after[left] >= step]


def _rows(kind: int, a, b, c) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["kind", "a", "b", "c"])


def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to edges (kind 0: a, b) and rows of long runs (kind 1: key a, fingerprint b, block c)."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    long_key, given = None, 0
    edges = _Edges()

    def held(key: int, part: np.ndarray) -> pa.RecordBatch:
        nonlocal long_key, given
        if key != long_key:
            long_key, given = key, 0
        blocks = (given + np.arange(len(part))) // RUN
        given += len(part)
        return _rows(1, np.full(len(part), key, np.int64), part, blocks)

    def whole(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs."""
        ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1
        sizes = np.diff(np.concatenate([[0], ends]))
        is_long = (sizes > RUN) | ((keys[ends - 1] == long_key) if long_key is not None else False)
        for e, n in zip(ends[is_long], sizes[is_long]):
            yield held(int(keys[e - 1]), fps[e - n : e])
        short = ~np.repeat(is_long, sizes)
        compare_runs(keys[short], fps[short], edges)

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield from whole(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
        if len(keys) > 2 * RUN or long_key == keys[-1]:
            yield held(int(keys[-1]), fps)
            keys, fps = keys[:0], fps[:0]
        if edges.n:
            u, v = edges.take()
            yield _rows(0, u, v, np.zeros(len(u), np.int64))
    if len(keys):
        yield from whole(keys, fps)
    u, v = edges.take()
    yield _rows(0, u, v, np.zeros(len(u), np.int64))


def match_blocks(key: tuple, rows: pa.Table) -> pa.Table:
    """All rows of one block against all of another, or of one block against itself."""
    start, x, y = (k.as_py() for k in key)
    fps, block = rows["fp"].to_numpy(), rows["block"].to_numpy()
    a, b = fps[block == x], fps[block == y]
    edges = _Edges()
    for k in range(0, len(a), 128):
        i, j = np.meshgrid(np.arange(k, min(k + 128, len(a))), np.arange(len(b)), indexing="ij")
        i, j = i.ravel(), j.ravel()
        if x == y:
            i, j = i[i < j], j[i < j]
        hit = linked(np.full(len(i), start, np.int64), a[i].view(np.uint64), b[j].view(np.uint64))
        edges.add(a[i[hit]], b[j[hit]])
    u, v = edges.take()
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def links(fps: DataFrame) -> DataFrame:
    """(u, v) edges between distinct fingerprints (column fp) whose components are those of all links.

    Rows of hot keys go to blocks at once; other runs pass one task each, which hands those of over RUN rows on in blocks."""
    fps = fps.select("fp")
    hot = hot_keys(fps, fps.count())
    kinds = "key long, fp long, block long"
    keyed = fps.mapInArrow(trimmed(_keyed(hot, False)), kinds).drop("block")
    found = written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(match), "kind int, a long, b long, c long"), "matches")
    edges = found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    held = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), F.col("c").alias("block"))
    blocks = held.groupBy("key").agg(F.max("block").alias("last"), F.count("*").alias("n"))
    each = hot_join(held, blocks, "key", held.count(), "n")
    if hot:
        ends = fps.sparkSession.createDataFrame([(k, b - 1) for k, b in hot.items()], "key long, last long")
        each = each.union(fps.mapInArrow(trimmed(_keyed(hot, True)), kinds).join(F.broadcast(ends), "key").select("key", "fp", "block", "last"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    each = each.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "fp", "block")
    far = each.groupBy("key", "x", "y").applyInArrow(match_blocks, "u long, v long")
    return edges.union(far).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs."""
    texts = docs.select(to_id(id_col).alias("id"), F.col(text_col).alias("text"))
    printed = written(texts.mapInArrow(trimmed(_fingerprints), "id long, fp long"), "fingerprints")
    nodes = written(printed.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("n")), "nodes")
    pairs = links(nodes)
    at = nodes.select("fp", "node")
    edges = pairs.join(at.toDF("u", "nu"), "u").join(at.toDF("v", "nv"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    roots = components(edges)
    classes = nodes.join(roots, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("root"))
    out = hot_join(printed, classes, "fp", printed.count(), "n")
    return out.select(from_id("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), from_id("root").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class of linked fingerprints: that with the smallest id, null last; a hash of all columns decides between rows of
    one id, and of rows that are equal in all columns one stays."""
    told = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    name = F.concat_ws(":", to_id(id_col), F.hex(F.xxhash64(*told)), F.hex(F.xxhash64(F.lit(1), *told)))
    rows = docs.select(name.alias("name"), to_id(id_col).alias("id"), F.col(text_col).alias("text"))
    printed = rows.mapInArrow(trimmed(_fingerprints), "name string, id long, fp long")
    names = written(printed.groupBy("name", "id", "fp").agg(F.count("*").alias("n")), "names")
    nodes = written(names.groupBy("fp").agg(F.min(F.struct("id", "name")).alias("first")), "nodes")
    roots = components(links(nodes))
    chosen = nodes.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first"))
    chosen = chosen.select(F.col("first.name").alias("kept"))
    stays = F.col("kept").isNotNull()
    decided = written(names.join(chosen, F.col("name") == F.col("kept"), "left").select("name", "n", (stays & (F.col("n") == 1)).alias("stays"), (stays & (F.col("n") > 1)).alias("many")), "decided")
    total = decided.agg(F.sum("n")).first()[0] or 0
    # equal rows have one name: a place in the table tells them apart where a hot name is dealt out
    rows = docs.select(whole_row(docs).alias("row"), name.alias("name"), F.monotonically_increasing_id().alias("place"))
    out = hot_join(rows, decided.select("name", "n", "stays"), "name", total, "n").where("stays").select("row")
    many = decided.where("many").select("name")
    if many.head(1):
        alike = rows.select("row", "name").join(small(many), "name", "left_semi")
        out = out.union(alike.dropDuplicates(["name"]).select("row"))
    return unpacked(out)
