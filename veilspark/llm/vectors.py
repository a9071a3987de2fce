"""Embedding near-dedup by robust-pruned flat graphs (operator 10).

Vectors that are equal are one node with a count. Centroids are fitted on a bounded sample for each large label, and every node goes to
the shards of its HOMES nearest centroids, so neighbours across a border share a shard. Shards of over REFINE nodes are
split again, level by level, by pivots of their own that lie APART. In each block of a shard a flat graph is built: candidates (nearest and
random nodes) are pruned robustly, so that an edge is left out when a kept neighbour is closer to its end by ALPHA, and reverse
edges are added. A node's adjacency lists from all its shards are united: each shard sends the others what concerns their
nodes. Every node then searches its shards: a greedy beam walk from the medoids, and from all nodes in range a
range-expanding walk until it finds no more. Pairs in range are verified in double precision. A pair is counted in the smallest shard that
its nodes share. Tasks return counts and a spanning forest of their links, never the pairs.

Large groups of near copies would make walks quadratic, so they are folded first: the sample shows where they are, and all nodes within half
of the limit's angle of a group's centre form a class, in which all link with all (the triangle inequality). A node outside links with all of a
class, or with none, if its angle to the centre and the class's radius say so; only nodes between the two are compared with
the members one by one. Shards that pivots can't split and that hold no such group are compared in full, in blocks.

Recall is audited after every search: all nodes that hold a row whose id is divisible by EVERY against brute force over all nodes, over all their links and as
the mean over nodes with links, and the lower of both counts. Below LEAST_RECALL the search is repeated with more homes, at every level of
shards, and a wider beam. If no search of TRIES passes, all blocks of a label are compared in full, which loses nothing. What was
measured is logged and stands in the column `recall`, which is null where no audited node has a link.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without a label, link
with nothing; vectors of different lengths don't link; equal rows link with each other; a cosine of exactly the limit links; rows with the
same vec_id and other vectors are vectors of their own; very long vectors are held a shard at a time, REFINE of them at most; a null vec_id is null
in the result and sorts last; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop_written, from_id, hot_join, pack_numbers, small, to_id, trimmed, unpack_numbers, written
from .simhash import forest

log = logging.getLogger(__name__)

LIMIT, LABELS, SAMPLE, SHARD, BLOCK = 0.93, 1000, 20_000, 1000, 2000
HOMES, NEAREST, RANDOM, DEGREE, ALPHA, BEAM = 2, 32, 32, 20, 1.2, 24
EVERY, LEAST_RECALL, TRIES, SEED = 100, 0.95, 3, 11
#: Slices of an EVERY-th of all nodes that are audited while no link was found to measure by.
AUDITS = 2
#: Queries that an audit hands to every task; more are dealt out in blocks.
ASKED = 4096
#: Shards with more nodes are split again by up to about PIVOTS of their nodes, dealt CHUNK at a time.
REFINE, PIVOTS, CHUNK, APART, LEVELS = 8 * BLOCK, 1000, 10_000, 0.6, 4
#: A class has at least so many nodes of the sample, and so many nodes in all.
FOLD_SAMPLE, FOLD_LEAST, FOLD_PIVOTS = 16, 64, 512
#: What angles may be off by.
ROUNDING = 1e-6
_QUERIES = 256

Key = tuple[int, int]


def unit(vectors: np.ndarray) -> np.ndarray:
    # in double precision, and scaled first, so that squares neither overflow nor vanish
    vectors = np.asarray(vectors, np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_kind(batch: pa.RecordBatch, among) -> Iterator[tuple[Key, np.ndarray]]:
    """((label, dim), rows) of a batch (columns 1 and 2), for the kinds among these."""
    rows: dict[Key, list[int]] = {}
    for k, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
        if among is None or key in among:
            rows.setdefault(key, []).append(k)
    for key, own in rows.items():
        yield key, np.array(own)


# ---- nodes


def prepare(double: bool):
    """(id, label, vec) to (id, label, dim, key, vec): the key names equal usable vectors of a label, and is null for all others."""
    kind, item = (np.float64, pa.float64()) if double else (np.float32, pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, vecs = [], [], []
            for label, row in zip(batch.column(1).to_pylist(), batch.column(2)):
                key = vec = None
                if label is not None and row.is_valid and len(row):
                    x = row.values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # nulls become NaN, and -0 becomes 0
                    if np.isfinite(x).all() and x.any():
                        vec, key = x, hashlib.blake2b(int(label).to_bytes(8, "little", signed=True) + x.tobytes(), digest_size=16).digest()
                keys.append(key)
                vecs.append(vec)
                dims.append(0 if vec is None else len(vec))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.list_(item))], names=["id", "label", "dim", "key", "vec"])

    return run


def nodes_of(rows: DataFrame) -> DataFrame:
    """key, id, node, label, dim, mult, asked, vec for each key of prepared rows; node is the key's smallest id, or a number below all ids where
    another key has that; asked: whether any of its rows has an id divisible by EVERY. Vectors that occur once stay where they are."""
    rows = rows.where("key IS NOT NULL").withColumn("asked", F.col("id") % EVERY == 0)
    keyed = written(rows.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.bool_or("asked").alias("any_asked")), "keys")
    total = keyed.count()
    shared = keyed.groupBy("id").agg(F.count("*").alias("c"), F.min("key").alias("least")).where("c > 1")
    named = hot_join(keyed, shared, "id", total, "c").where("n > 1 OR least IS NOT NULL")
    node = F.when(F.col("key") != F.col("least"), -F.shiftrightunsigned(F.xxhash64("key"), 1) - 1).otherwise(F.col("id"))
    special = written(named.select("key", F.col("id").alias("of"), node.alias("node"), "n", F.col("n").alias("mult"), "any_asked"), "special")
    columns = ["key", "id", "node", "label", "dim", "mult", "asked", "vec"]
    if not special.head(1):
        return rows.withColumn("node", F.col("id")).withColumn("mult", F.lit(1).cast("long")).select(columns)
    marked = hot_join(rows, special, "key", rows.count(), "n")
    plain = marked.where("node IS NULL").withColumn("node", F.col("id")).withColumn("mult", F.lit(1).cast("long"))
    one = marked.where("node IS NOT NULL").drop("asked").groupBy("key").agg(*[F.first(c).alias(c) for c in ("of", "node", "label", "dim", "mult", "any_asked", "vec")])
    return written(plain.select(columns).unionByName(one.withColumnRenamed("of", "id").withColumnRenamed("any_asked", "asked").select(columns)), "nodes")


# ---- shards


def fit_centroids(units: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centers = units[rng.choice(len(units), min(k, len(units)), replace=False)]
    for _ in range(rounds):
        near = (units @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, units)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centers)
    return centers


class Layout(NamedTuple):
    """What the sample tells of each (label, dim): centroids of its shards, and centres of its large groups of near copies."""

    centers: dict[Key, np.ndarray]
    groups: dict[Key, np.ndarray]


def dense_groups(units: np.ndarray, limit: float) -> np.ndarray:
    """Centres of groups with at least FOLD_SAMPLE of these units within half of the limit's angle."""
    half = np.cos(np.arccos(limit) / 2 - ROUNDING)
    pivots = units[np.unique(np.linspace(0, len(units) - 1, FOLD_PIVOTS).astype(int))]
    near = units @ pivots.T >= limit
    left, found = np.ones(len(units), bool), []
    while True:
        counts = (near & left[:, None]).sum(axis=0)
        best = int(counts.argmax())
        if counts[best] < FOLD_SAMPLE:
            return np.array(found).reshape(len(found), units.shape[1])
        own = near[:, best] & left
        near[:, best] = False
        for _ in range(2):
            center = units[own].sum(axis=0)
            size = np.sqrt((center * center).sum())
            if not size:
                break
            center = center / size
            own = left & (units @ center >= half)
            if not own.any():
                break
        if own.sum() >= FOLD_SAMPLE:
            found.append(center)
            left &= ~own


def layout(nodes: DataFrame, limit: float) -> Layout:
    """Fitted on a sample of SAMPLE nodes of the LABELS largest (label, length) groups with over SHARD nodes."""
    large = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).orderBy(F.desc("n"), "label", "dim").limit(LABELS)
    counts = {(r.label, r.dim): r.n for r in large.collect()}  # LABELS rows at most
    if not counts:
        return Layout({}, {})
    names = nodes.sparkSession.createDataFrame([(*k, n) for k, n in counts.items()], "label long, dim int, n long")
    found: dict[Key, list] = {}
    for r in nodes.join(F.broadcast(names.drop("n")), ["label", "dim"]).select("label", "dim", "node", "vec").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect():
        found.setdefault((r.label, r.dim), []).append(r.vec)
    rng = np.random.default_rng(SEED)
    centers, groups = {}, {}
    for key, rows in sorted(found.items()):
        units = unit(np.array(rows))
        if len(dense := dense_groups(units, limit)):
            groups[key] = dense
        k = min(-(-counts[key] // SHARD), len(rows) // 4)
        if k > 1:
            centers[key] = fit_centroids(units, k, rng)
    return Layout(centers, groups)


# ---- classes of near copies


class Classes(NamedTuple):
    """Of the groups of one (label, dim): centres, whether they are classes, their largest angle to a member, rows in all, and smallest node."""

    centers: np.ndarray
    kept: np.ndarray
    radius: np.ndarray
    mult: np.ndarray
    rep: np.ndarray


def angles(units: np.ndarray, centers: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Angles to all centres, and the nearest centre if it is within half of the limit's angle, else -1."""
    got = np.arccos(np.clip(units @ centers.T, -1, 1))
    best = got.argmin(axis=1)
    return got, np.where(got[np.arange(len(units)), best] <= np.arccos(limit) / 2 - ROUNDING, best, -1)


def member_rows(groups: dict[Key, np.ndarray], limit: float):
    """Nodes to (node, label, dim, mult, class, radius) of those that a group has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (label, dim), rows in by_kind(batch, groups):
                got, cls = angles(unit(_matrix(batch.column(4).take(pa.array(rows)))), groups[label, dim], limit)
                some = np.flatnonzero(cls >= 0)
                about = [batch.column(c).take(pa.array(rows[some])) for c in range(4)]
                yield pa.record_batch([*about, pa.array(cls[some]), pa.array(got[some, cls[some]])], names=["node", "label", "dim", "mult", "cls", "radius"])

    return run


def relations(classes: dict[Key, Classes], limit: float):
    """Nodes of kinds with classes to (node, label, dim, mult, cls, links, touches, borders): their own class or -1, rows that they surely link with
    in classes, the other classes all of which they link with, and those whose members must be looked at."""
    theta = np.arccos(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, rows in by_kind(batch, classes):
                c = classes[key]
                got, cls = angles(unit(_matrix(batch.column(4).take(pa.array(rows)))), c.centers, limit)
                cls = np.where((cls >= 0) & c.kept[cls], cls, -1)
                other = c.kept[None, :] & (np.arange(len(c.kept))[None, :] != cls[:, None])
                sure = other & (got + c.radius <= theta - ROUNDING)
                border = other & ~sure & (got - c.radius <= theta + ROUNDING)
                about = [batch.column(k).take(pa.array(rows)) for k in range(4)]
                own = np.where(cls >= 0, c.mult[cls] - about[3].to_numpy(), 0)
                listed = lambda hit: pa.ListArray.from_arrays(pa.array(np.append(0, hit.sum(axis=1).cumsum()), pa.int32()), pa.array(np.nonzero(hit)[1], pa.int64()))
                yield pa.record_batch([*about, pa.array(cls), pa.array(sure @ c.mult + own), listed(sure), listed(border)], names=["node", "label", "dim", "mult", "cls", "links", "touches", "borders"])

    return run


class Folded(NamedTuple):
    """What classes settle: (node, n_links) and (u, v) between nodes and classes, which go by their smallest node; and (node, rep) of their members."""

    classes: dict[Key, Classes]
    counts: DataFrame
    edges: DataFrame
    members: DataFrame


def crossed(left: DataFrame, right: DataFrame, keys: list[str], block: int = REFINE):
    """left and right (keys, node, ...; the same columns) met block by block within their keys: role 1 and 2."""
    blocks = lambda df, name: written(df.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias(name)), "blocks")
    sizes = written(blocks(left, "xs").join(blocks(right, "ys"), keys), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    a = left.join(small(sizes), keys).withColumn("role", F.lit(1)).withColumn("x", own("xs")).withColumn("y", every("ys"))
    b = right.join(small(sizes), keys).withColumn("role", F.lit(2)).withColumn("y", own("ys")).withColumn("x", every("xs"))
    return a.drop("xs", "ys").unionByName(b.drop("xs", "ys")).groupBy(*keys, "x", "y")


def across(limit: float):
    """Nodes beside a class (role 1; own: their class or -1, name: what they go by) against its members (role 2; name: what the class goes by)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        role, ids, mult, own, name = (rows[c].to_numpy() for c in ("role", "node", "mult", "own", "name"))
        units = unit(_matrix(rows["vec"]))
        asking, held = np.flatnonzero(role == 1), np.flatnonzero(role == 2)
        counts, linked = np.zeros(len(ids), np.int64), []
        for k in range(0, len(asking), _QUERIES):
            q = asking[k : k + _QUERIES]
            hit = units[q] @ units[held].T >= limit
            counts[q] += hit @ mult[held]
            # members of other classes are asked about in their own turn
            counts[held] += np.where(own[q] < 0, mult[q], 0) @ hit
            linked.append(q[hit.any(axis=1)])
        u = np.unique(name[np.concatenate([np.zeros(0, np.int64), *linked])])
        kind = np.repeat(np.array([0, 1], np.int32), [len(ids), len(u)])
        to = np.full(len(u), name[held[0]] if len(held) else 0)
        return pa.table({"kind": kind, "a": np.concatenate([ids, u]), "b": np.concatenate([counts, to])})

    return run


def fold(nodes: DataFrame, groups: dict[Key, np.ndarray], limit: float) -> Folded | None:
    """The classes of nodes (node, label, dim, mult, vec); None if there are none."""
    if not groups:
        return None
    spark = nodes.sparkSession
    found = nodes.mapInArrow(trimmed(member_rows(groups, limit)), "node long, label long, dim int, mult long, cls long, radius double")
    found = found.groupBy("label", "dim", "cls").agg(F.max("radius").alias("radius"), F.sum("mult").alias("mult"), F.min("node").alias("rep"), F.count("*").alias("n")).where(F.col("n") >= FOLD_LEAST)
    classes: dict[Key, Classes] = {}
    for r in found.collect():  # at most SAMPLE / FOLD_SAMPLE rows
        key = r.label, r.dim
        k = len(groups[key])
        c = classes.setdefault(key, Classes(groups[key], np.zeros(k, bool), np.zeros(k), np.zeros(k, np.int64), np.zeros(k, np.int64)))
        c.kept[r.cls], c.radius[r.cls], c.mult[r.cls], c.rep[r.cls] = True, r.radius, r.mult, r.rep
    if not classes:
        return None
    table = written(nodes.mapInArrow(trimmed(relations(classes, limit)), "node long, label long, dim int, mult long, cls long, links long, touches array<long>, borders array<long>"), "relations")
    reps = [(*key, j, int(c.rep[j])) for key, c in classes.items() for j in np.flatnonzero(c.kept).tolist()]
    names = F.broadcast(spark.createDataFrame(reps, "label long, dim int, cls long, rep long"))
    kind = ["label", "dim", "cls"]
    named = table.join(names, kind, "left").withColumn("name", F.coalesce("rep", "node"))
    # what single nodes add to a class that they link with all of
    touched = named.select("label", "dim", F.col("cls").alias("own"), "mult", "name", F.explode("touches").alias("cls"))
    more = touched.where("own < 0").groupBy(*kind).agg(F.sum("mult").alias("more"))  # a row a class at most
    counts = table.join(F.broadcast(more), kind, "left").select("node", (F.col("links") + F.coalesce("more", F.lit(0))).alias("n_links"))
    edges = touched.join(names, kind).select(F.col("name").alias("u"), F.col("rep").alias("v")).distinct()
    border = named.select("label", "dim", F.col("cls").alias("own"), "node", "mult", "name", F.explode("borders").alias("cls"))
    if border.head(1):
        vecs = nodes.select("node", "vec")
        members = named.where("cls >= 0").select("label", "dim", "cls", "node", "mult", F.lit(-1).cast("long").alias("own"), "name")
        columns = [*kind, "node", "mult", "own", "name", "vec"]
        met = crossed(border.join(vecs, "node").select(columns), members.join(vecs, "node").select(columns), kind)
        seen = written(met.applyInArrow(across(limit), "kind int, a long, b long"), "borders")
        counts = counts.union(seen.where("kind = 0").select("a", "b"))
        edges = edges.union(seen.where("kind = 1").select("a", "b"))
    return Folded(classes, counts, edges, named.where("cls >= 0").select("node", "rep"))


# ---- shards


def assign(own: Layout, folded: dict[Key, Classes], homes: int, limit: float, with_vec: bool):
    """Nodes that no class has to their shards: a row for each of the `homes` nearest centroids, all of which stand in `homes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, rows in by_kind(batch, None):
                near = np.zeros((len(rows), 1), np.int64)
                if key in own.centers or key in folded:
                    units = unit(_matrix(batch.column(4).take(pa.array(rows))))
                    if key in own.centers:
                        near = np.sort(np.argsort(-(units @ own.centers[key].T), axis=1, kind="stable")[:, :homes], axis=1)
                    if key in folded:
                        cls = angles(units, folded[key].centers, limit)[1]
                        free = ~((cls >= 0) & folded[key].kept[cls])
                        rows, near = rows[free], near[free]
                n, h = near.shape
                at = pa.array(np.repeat(rows, h))
                label, dim, cluster = batch.column(1).take(at), batch.column(2).take(at), pa.array(near.ravel())
                if not with_vec:
                    yield pa.record_batch([label, dim, cluster], names=["label", "dim", "cluster"])
                    continue
                lists = pa.FixedSizeListArray.from_arrays(pa.array(np.repeat(near, h, axis=0).ravel()), h).cast(pa.list_(pa.int64()))
                yield pa.record_batch([label, dim, cluster, batch.column(0).take(at), batch.column(3).take(at), batch.column(4).take(at), lists], names=["label", "dim", "cluster", "node", "mult", "vec", "homes"])

    return run


def thin(key: tuple, rows: pa.Table) -> pa.Table:
    """A shard's candidate pivots without those that are near one kept before."""
    rows = rows.sort_by("node")
    units = unit(_matrix(rows["vec"]))
    kept: list[int] = []
    for k in range(len(units)):
        if not kept or (units[kept] @ units[k]).max() < APART:
            kept.append(k)
    rows = rows.take(pa.array(kept))
    same = [pa.array([k.as_py()] * len(kept), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int64()))]
    return pa.table([*same, rows["node"], rows["vec"]], names=["label", "dim", "cluster", "pivot", "pivot_vec"])


def finer(cluster: int, pivots: np.ndarray) -> np.ndarray:
    """Numbers for the parts of a shard that belong to its pivots."""
    x = pivots.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(cluster & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def deal_out(homes: int):
    """A chunk of a large shard to the parts of its `homes` nearest pivots; unchanged and final if there are no two."""

    def run(key: tuple, rows: pa.Table, pivots: pa.Table) -> pa.Table:
        rows = rows.select(["label", "dim", "cluster", "node", "mult", "vec"])
        if pivots.num_rows < 2 or not rows.num_rows:
            return rows.append_column("final", pa.array([True] * rows.num_rows))
        pivots = pivots.sort_by("pivot")
        near = np.argsort(-(unit(_matrix(rows["vec"])) @ unit(_matrix(pivots["pivot_vec"])).T), axis=1, kind="stable")[:, :homes]
        parts = finer(key[2].as_py(), pivots["pivot"].to_numpy())[near]
        rows = rows.take(pa.array(np.repeat(np.arange(rows.num_rows), near.shape[1])))
        rows = rows.set_column(2, "cluster", pa.array(parts.ravel()))
        return rows.append_column("final", pa.array([False] * rows.num_rows))

    return run


def refined(members: DataFrame, homes: int) -> DataFrame:
    """members (label, dim, cluster, node, mult, vec, homes) with large shards split; homes lists each node's shards anew."""
    keys = ["label", "dim", "cluster"]
    vec = members.schema["vec"].dataType.simpleString()
    schema = f"label long, dim int, cluster long, node long, mult long, vec {vec}, final boolean"
    now = written(members.drop("homes").withColumn("final", F.lit(False)), "placed")
    for level in range(LEVELS):
        sizes = written(now.where("NOT final").groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > REFINE), "large")
        if not sizes.head(1):
            break
        marked = now.join(small(sizes), keys, "left")
        large = marked.where("n IS NOT NULL")
        every = F.greatest(F.lit(1), F.floor(F.col("n") / F.least(F.lit(PIVOTS), F.ceil(F.col("n") / SHARD))))
        chosen = large.where(F.pmod(F.xxhash64("node", F.lit(level)), every) == 0).select(*keys, "node", "vec")
        pivots = written(chosen.groupBy(*keys).applyInArrow(thin, f"label long, dim int, cluster long, pivot long, pivot_vec {vec}"), "pivots")
        chunks = F.ceil(F.col("n") / CHUNK)
        left = large.select(*keys, "node", "mult", "vec", F.pmod(F.xxhash64("node", F.lit(-1)), chunks).alias("chunk"))
        right = pivots.join(small(sizes), keys).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).drop("n")
        split = left.groupBy(*keys, "chunk").cogroup(right.groupBy(*keys, "chunk")).applyInArrow(deal_out(homes), schema)
        kept = marked.where("n IS NULL").select(*keys, "node", "mult", "vec", "final")
        was, now = now, written(kept.unionByName(split), "finer")
        drop_written(was)
    return now.drop("final").join(now.groupBy("node").agg(F.array_sort(F.collect_set("cluster")).alias("homes")), "node").select(*keys, "node", "mult", "vec", "homes")


# ---- graphs


def robust_prune(cand: np.ndarray, dist: np.ndarray, between, degree: int) -> np.ndarray:
    """(n, c) candidates sorted by squared distance (-1: none) to (n, degree) neighbours. between(picked, cand) gives squared distances
    of each row's picked node to its candidates."""
    n = len(cand)
    alive = cand >= 0
    out = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        picked = cand[rows, first]
        out[some, k] = picked[some]
        alive &= ~((ALPHA * ALPHA * between(picked, cand) <= dist) & some[:, None])
        alive[rows, first] = False
    return out


def build_graph(units: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(n, 2 * DEGREE) local neighbours, -1 for none: a robust-pruned flat graph with reverse edges."""
    n = len(units)
    if n == 1:
        return np.full((1, 1), -1, np.int64)
    # 1 - cosine, half the squared distance: single precision will do, as links are verified later
    units = units.astype(np.float32)
    apart = 1 - units @ units.T
    np.fill_diagonal(apart, np.inf)
    near = min(NEAREST, n - 1)
    cand = np.argpartition(apart, near - 1, axis=1)[:, :near]
    cand = np.concatenate([cand, rng.integers(0, n, (n, min(RANDOM, n)))], axis=1)
    flat = apart.ravel()

    def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return flat.take(a[:, None] * n + b)

    def pruned(cand: np.ndarray, degree: int) -> np.ndarray:
        me = np.arange(n)
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == me[:, None]] = -1
        dist = np.where(cand >= 0, far(me, np.maximum(cand, 0)), np.inf)
        order = np.argsort(dist, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, axis=1), np.take_along_axis(dist, order, axis=1)
        return robust_prune(cand, dist, lambda p, c: far(p, np.maximum(c, 0)), degree)

    out = pruned(cand, DEGREE)
    src = np.repeat(np.arange(n), out.shape[1])[out.ravel() >= 0]
    dst = out.ravel()[out.ravel() >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    back = np.full((n, 4 * DEGREE), -1, np.int64)
    keep = place < back.shape[1]
    back[dst[keep], place[keep]] = src[keep]
    return pruned(np.concatenate([out, back], axis=1), 2 * DEGREE)


def blocks_of(ids: np.ndarray) -> list[np.ndarray]:
    """A shard's nodes (places) in blocks of about BLOCK by a hash."""
    n = -(-len(ids) // BLOCK)
    mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    block = (mixed >> np.uint64(33)).astype(np.int64) % max(n, 1)
    return [x for k in range(n) if len(x := np.flatnonzero(block == k))]


def homes_of(rows: pa.Table) -> np.ndarray:
    """(n, most homes) shards of each node, -1 for none."""
    lists = rows["homes"].combine_chunks()
    count = np.diff(lists.offsets.to_numpy())
    out = np.full((len(count), int(count.max(initial=1))), -1, np.int64)
    out[np.arange(out.shape[1])[None, :] < count[:, None]] = lists.flatten().to_numpy()
    return out


def build(key: tuple, rows: pa.Table) -> pa.Table:
    """A shard's graph, cut up for every shard that shares some of its nodes: (label, dim, cluster, ids, counts, near), where near are places in ids."""
    rows = rows.sort_by("node")
    ids, units, homes = rows["node"].to_numpy(), unit(_matrix(rows["vec"])), homes_of(rows)
    rng = np.random.default_rng([SEED, *(abs(int(k.as_py() or 0)) for k in key)])
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for block in blocks_of(ids):
        got = build_graph(units[block], rng)
        a, b = np.nonzero(got >= 0)
        src.append(block[a])
        dst.append(block[got[a, b]])
    src, dst = np.concatenate(src), np.concatenate(dst)
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    out = []
    for to in np.unique(homes[homes >= 0]).tolist():
        there = (homes == to).any(axis=1)
        if there.sum() < 2:
            continue
        place = np.cumsum(there) - 1
        both = there[src] & there[dst]
        counts = np.bincount(place[src[both]], minlength=int(there.sum()))
        out.append((to, ids[there].tobytes(), pack_numbers(counts), pack_numbers(place[dst[both]])))
    label, dim = (k.as_py() for k in key[:2])
    columns = list(zip(*out)) or [[], [], [], []]
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    same = [pa.array([label] * len(out), pa.int64()), pa.array([dim] * len(out), pa.int32())]
    return pa.table([*same, *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names=["label", "dim", "cluster", "ids", "counts", "near"])


def united(ids: np.ndarray, messages: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) places of all neighbours that any shard found for these nodes (sorted)."""
    pairs = [np.zeros(0, np.int64)]
    for named, counts, near in zip(messages["ids"], messages["counts"], messages["near"]):
        at = np.searchsorted(ids, np.frombuffer(named.as_py(), np.int64))
        src = np.repeat(at, unpack_numbers(counts.as_py()).astype(np.int64))
        pairs.append(src * len(ids) + at[unpack_numbers(near.as_py()).astype(np.int64)])
    flat = np.unique(np.concatenate(pairs))
    return flat // max(len(ids), 1), flat % max(len(ids), 1)


def neighbours(block: np.ndarray, src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """(len(block), width) places in the block of each node's neighbours, -1 for none."""
    place = np.full(n, -1, np.int64)
    place[block] = np.arange(len(block))
    a, b = place[src], place[dst]
    a, b = a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((len(block), int(nth.max(initial=0)) + 1), -1, np.int64)
    out[a, nth] = b
    return out


# ---- search


def is_elsewhere(homes: np.ndarray, a: np.ndarray, b: np.ndarray, cluster: int) -> np.ndarray:
    """Whether pairs of nodes share a smaller shard, which they belong to."""
    x, y = homes[a][:, :, None], homes[b][:, None, :]
    return ((x == y) & (x >= 0) & (x < cluster)).any(axis=(1, 2))


def link_rows(ids: np.ndarray, counts: np.ndarray, us: list[np.ndarray], vs: list[np.ndarray]) -> pa.Table:
    """(kind 0, node, links) and (kind 1, u, v) of a spanning forest."""
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    u, v = forest(u, v) if len(u) else (u, v)
    kind = np.repeat(np.array([0, 1], np.int32), [len(ids), len(u)])
    return pa.table({"kind": kind, "a": np.concatenate([ids, u]), "b": np.concatenate([counts, v])})


def search(beam: int, limit: float):
    """A shard's nodes through the graphs of its blocks."""

    def run(key: tuple, rows: pa.Table, messages: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        cluster, ids, mult = key[2].as_py(), rows["node"].to_numpy(), rows["mult"].to_numpy()
        n = len(ids)
        units, homes = unit(_matrix(rows["vec"])) if n else np.zeros((0, 1)), homes_of(rows)
        src, dst = united(ids, messages)
        counts, us, vs = np.zeros(n, np.int64), [], []
        for block in blocks_of(ids):
            points = units[block].astype(np.float32)
            adj = neighbours(block, src, dst, n)
            start = np.unique(np.append(np.linspace(0, len(block) - 1, 8).astype(np.int64), int((points @ points.mean(axis=0)).argmax())))
            for k in range(0, n, _QUERIES):
                q = np.arange(k, min(k + _QUERIES, n))
                a, b = ranged(units[q].astype(np.float32), points, adj, start, beam, limit)
                a, b = q[a], block[b]
                a, b = a[a != b], b[a != b]
                sure = np.concatenate([np.einsum("ij,ij->i", units[a[t : t + 65536]], units[b[t : t + 65536]]) >= limit for t in range(0, len(a), 65536)] or [np.zeros(0, bool)])
                a, b = a[sure], b[sure]
                if len(a):
                    mine = ~is_elsewhere(homes, a, b, cluster)
                    np.add.at(counts, a[mine], mult[b[mine]])
                    u, v = forest(ids[a], ids[b])
                    us.append(u)
                    vs.append(v)
        return link_rows(ids, counts, us, vs)

    return run


def ranged(queries: np.ndarray, points: np.ndarray, adj: np.ndarray, start: np.ndarray, beam: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) of similarity near limit or more, by a beam walk and a range-expanding walk of all queries at once."""
    nq, n = len(queries), len(points)
    rows = np.arange(nq)[:, None]
    seen = np.zeros((nq, n), bool)
    near_limit = limit - 1e-5
    width = min(beam, n)
    at = np.repeat(start[None, :], nq, axis=0)
    seen[:, start] = True
    sims = queries @ points[start].T
    found_q, found_p = [], []

    def note(q: np.ndarray, p: np.ndarray, s: np.ndarray) -> None:
        hit = s >= near_limit
        found_q.append(q[hit])
        found_p.append(p[hit])

    note(np.broadcast_to(rows, at.shape), at, sims)
    done = np.zeros(at.shape, bool)
    while True:
        if at.shape[1] > width:
            top = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            at, sims, done = (np.take_along_axis(x, top, axis=1) for x in (at, sims, done))
        best = np.where(done, -np.inf, sims).argmax(axis=1)
        open_rows = np.flatnonzero(~done[np.arange(nq), best] & np.isfinite(sims[np.arange(nq), best]))
        if not len(open_rows):
            break
        done[open_rows, best[open_rows]] = True
        step = adj[at[open_rows, best[open_rows]]]
        fresh = (step >= 0) & ~seen[open_rows[:, None], step]
        who, col = np.nonzero(fresh)
        pts = step[who, col]
        seen[open_rows[who], pts] = True
        s = np.einsum("ij,ij->i", queries[open_rows[who]], points[pts])
        note(open_rows[who], pts, s)
        more = np.full((nq, step.shape[1]), -np.inf, np.float32)
        more[open_rows[who], col] = s
        more_at = np.zeros((nq, step.shape[1]), np.int64)
        more_at[open_rows[who], col] = pts
        at, sims = np.concatenate([at, more_at], axis=1), np.concatenate([sims, more], axis=1)
        done = np.concatenate([done, np.zeros(more.shape, bool)], axis=1)
    q, p = np.concatenate([x.ravel() for x in found_q]), np.concatenate([x.ravel() for x in found_p])
    out_q, out_p = [q], [p]
    while len(q):
        next_q, next_p = [], []
        for k in range(0, len(q), 8192):
            step = adj[p[k : k + 8192]]
            who = np.broadcast_to(q[k : k + 8192, None], step.shape)
            fresh = (step >= 0) & ~seen[who, step]
            pairs = np.unique(who[fresh] * n + step[fresh])
            a, b = pairs // n, pairs % n
            seen[a, b] = True
            hit = np.einsum("ij,ij->i", queries[a], points[b]) >= near_limit
            next_q.append(a[hit])
            next_p.append(b[hit])
        q, p = np.concatenate(next_q), np.concatenate(next_p)
        out_q.append(q)
        out_p.append(p)
    return np.concatenate(out_q), np.concatenate(out_p)


# ---- audit


def brute_counts(sample: list, limit: float):
    """(node, ...) batches to (node of the sample, links) by comparing everything of the same label with the sample."""
    kinds: dict[Key, list] = {}
    for r in sample:
        kinds.setdefault((r.label, r.dim), []).append(r)
    units = {k: (np.array([r.node for r in v]), unit(np.array([r.vec for r in v]))) for k, v in kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, mult = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for key, own in by_kind(batch, units):
                ids, asked = units[key]
                hit = unit(_matrix(batch.column(4).take(pa.array(own)))) @ asked.T >= limit
                hit &= nodes[own][:, None] != ids[None, :]
                yield pa.record_batch([pa.array(ids), pa.array((hit * mult[own][:, None]).sum(axis=0))], names=["node", "truth"])

    return run


def block_counts(limit: float):
    """A block of queries (role 1) against a block of nodes (role 2): (node, links) of the queries."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        role, ids, mult = (rows[c].to_numpy() for c in ("role", "node", "mult"))
        units = unit(_matrix(rows["vec"]))
        asking, held = np.flatnonzero(role == 1), np.flatnonzero(role == 2)
        truth = np.zeros(len(asking), np.int64)
        for k in range(0, len(asking), _QUERIES):
            q = asking[k : k + _QUERIES]
            truth[k : k + _QUERIES] = ((units[q] @ units[held].T >= limit) & (ids[q][:, None] != ids[held][None, :])) @ mult[held]
        return pa.table({"node": ids[asking], "truth": truth})

    return run


def audit(nodes: DataFrame, links: DataFrame, limit: float = LIMIT, every: int = EVERY) -> float | None:
    """The share of brute-force links that links (node, n_links) has, for all nodes that are asked: over all their links or as the mean over
    those with links, whichever is lower, so that neither a few large groups nor many small ones hide a loss. Where those have no link,
    slices of all nodes by a hash of their number follow, AUDITS at most; None if none of them has one."""
    by_hash = F.pmod(F.xxhash64("node"), F.lit(every))
    for turn in range(1 + AUDITS):
        asked = nodes.where("asked" if not turn else by_hash == turn).select("node", "label", "dim", "mult", "vec")
        found = _recall(nodes, asked, links, limit)
        if found is not None:
            return found
    return None


def _recall(nodes: DataFrame, asked: DataFrame, links: DataFrame, limit: float) -> float | None:
    if (n := asked.count()) <= ASKED:
        if not n:
            return None
        truth = nodes.select("node", "label", "dim", "mult", "vec").mapInArrow(trimmed(brute_counts(asked.collect(), limit)), "node long, truth long")
    else:
        truth = crossed(asked, nodes.select(asked.columns), ["label", "dim"]).applyInArrow(block_counts(limit), "node long, truth long")
    truth = truth.groupBy("node").agg(F.sum("truth").alias("truth"))
    have = F.least("truth", F.coalesce("n_links", F.lit(0)))
    got = truth.where("truth > 0").join(links, "node", "left").agg(F.sum("truth"), F.sum(have), F.avg(have / F.col("truth"))).first()
    recall = min(got[1] / got[0], got[2]) if got[0] else None
    log.info("recall %s over %d vectors", recall, n)
    return recall


# ---- comparison in full


def compare(limit: float):
    """Two blocks (role 1 and 2), or one with itself (role 3), all nodes with all, each pair in the smallest shard that both are in: rows as of
    search(), links of both sides."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        role, ids, mult = (rows[c].to_numpy() for c in ("role", "node", "mult"))
        cluster, units, homes = key[2].as_py(), unit(_matrix(rows["vec"])), homes_of(rows)
        asking, held = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        counts, us, vs = np.zeros(len(ids), np.int64), [], []
        for k in range(0, len(asking), _QUERIES):
            q = asking[k : k + _QUERIES]
            hit = units[q] @ units[held].T >= limit
            hit &= q[:, None] != held[None, :]
            a, b = np.nonzero(hit)
            if len(a):
                u, v = forest(ids[q[a]], ids[held[b]])
                us.append(u)
                vs.append(v)
            if homes.shape[1] > 1 and len(a):
                for t in range(0, len(a), 65536):
                    x, y = a[t : t + 65536], b[t : t + 65536]
                    gone = is_elsewhere(homes, q[x], held[y], cluster)
                    hit[x[gone], y[gone]] = False
            counts[q] += hit @ mult[held]
            if key[3] != key[4]:
                counts[held] += mult[q] @ hit
        return link_rows(ids, counts, us, vs)

    return run


def compare_blocks(members: DataFrame, limit: float) -> DataFrame:
    """Rows as of search() by comparing every pair of blocks of a shard: no link is lost, at quadratic cost. members: as of assign()."""
    keys = ["label", "dim", "cluster"]
    sizes = written(members.groupBy(*keys).agg(F.ceil(F.count("*") / REFINE).alias("blocks")), "blocks")
    placed = members.join(small(sizes), keys).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    ready = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    role = F.when(F.col("block") == F.col("other"), 3).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("role")
    pairs = ready.select(*keys, F.least("block", "other").alias("q"), F.greatest("block", "other").alias("g"), role, "node", "mult", "vec", "homes")
    return pairs.groupBy(*keys, "q", "g").applyInArrow(compare(limit), "kind int, a long, b long")


def compare_all(nodes: DataFrame, limit: float) -> DataFrame:
    """Written rows as of search() with each label as one shard, compared in full."""
    none = F.array().cast("array<long>").alias("homes")
    return written(compare_blocks(nodes.select("label", "dim", F.lit(0).cast("long").alias("cluster"), "node", "mult", "vec", none), limit), "links")


# ---- operator


def search_links(nodes: DataFrame, own: Layout, folded: dict[Key, Classes], homes: int, beam: int, limit: float) -> DataFrame:
    """Written rows (kind, a, b) of the search over nodes (node, label, dim, mult, vec) that no class has."""
    keys, vec = ["label", "dim", "cluster"], nodes.schema["vec"].dataType.simpleString()
    nodes = nodes.select("node", "label", "dim", "mult", "vec")
    names = nodes.mapInArrow(trimmed(assign(own, folded, homes, limit, False)), "label long, dim int, cluster long")
    members = nodes.mapInArrow(trimmed(assign(own, folded, homes, limit, True)), f"label long, dim int, cluster long, node long, mult long, vec {vec}, homes array<long>")
    found = None
    if names.groupBy(*keys).count().where(F.col("count") > REFINE).head(1):
        members = written(refined(members, homes), "members")
        large = written(members.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > REFINE).select(*keys), "large")
        if large.head(1):
            found = compare_blocks(members.join(small(large), keys, "left_semi"), limit)
            members = members.join(small(large), keys, "left_anti")
    # one exchange, from which graphs are built and then searched
    dealt = members.repartition(*keys)
    messages = dealt.groupBy(*keys).applyInArrow(build, "label long, dim int, cluster long, ids binary, counts binary, near binary")
    got = dealt.groupBy(*keys).cogroup(messages.groupBy(*keys)).applyInArrow(search(beam, limit), "kind int, a long, b long")
    return written(got if found is None else got.union(found), "links")


def label_number(vectors: DataFrame, col: str) -> Column:
    """Labels of any type as numbers: whole numbers as they are, others by a 64-bit hash of how they print."""
    kind = vectors.schema[col].dataType.simpleString()
    return F.col(col).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.when(F.col(col).isNotNull(), F.xxhash64(F.col(col).cast("string"))) if kind != "void" else F.lit(None).cast("long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: float = LIMIT) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall for every row of vectors."""
    item = vectors.schema[vector_col].dataType.elementType.simpleString()
    vec = F.col(vector_col) if item in ("float", "double") else F.col(vector_col).cast("array<double>")
    item = "float" if item == "float" else "double"
    rows = vectors.select(to_id(id_col).alias("id"), label_number(vectors, label_col).alias("label"), vec.alias("vec"))
    rows = written(rows.mapInArrow(trimmed(prepare(item == "double")), f"id long, label long, dim int, key binary, vec array<{item}>"), "vectors")
    nodes = nodes_of(rows)
    own = layout(nodes, limit)
    settled = fold(nodes.select("node", "label", "dim", "mult", "vec"), own.groups, limit)
    homes, beam = HOMES, BEAM
    for turn in range(TRIES + 1):
        folded = settled if turn < TRIES else None
        found = search_links(nodes, own, folded.classes if folded else {}, homes, beam, limit) if turn < TRIES else compare_all(nodes, limit)
        counts = found.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("n_links"))
        counts = (counts.union(folded.counts) if folded else counts).groupBy("node").agg(F.sum("n_links").alias("n_links"))
        recall = audit(nodes, counts, limit)
        if recall is None or recall >= LEAST_RECALL:
            break
        homes, beam = homes + 1, 2 * beam
    edges = found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(edges.union(folded.edges) if folded else edges)
    known = nodes.select("key", "id", "node", "mult").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if folded:
        # a class has one root, that of its smallest node
        reps = folded.members.select("rep").distinct().join(roots, F.col("rep") == roots["node"], "left").select("rep", F.coalesce(roots["root"], "rep").alias("class_root"))
        of = folded.members.join(F.broadcast(reps), "rep").select(F.col("node").alias("member"), "class_root")  # reps: a row a class
        known = known.join(of, known["node"] == of["member"], "left").withColumn("root", F.coalesce("class_root", "root"))
    if nodes.where("node <> id").head(1):
        # nodes without an id of their own: a component goes by the smallest id that it has
        least = known.groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("n"))
        known = hot_join(known.select("key", "id", "node", "mult", "n_links", "root"), least, "root", nodes.count(), "n").withColumn("root", F.col("least"))
    known = known.select("key", F.col("mult").alias("n"), (F.coalesce("n_links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "root")
    out = hot_join(rows.select("id", "key"), known, "key", rows.count(), "n")
    root = F.coalesce("root", "id")
    return out.select(from_id("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), from_id(root).alias("component_id"), (F.col("id") == root).alias("kept"), F.lit(recall).cast("double").alias("recall"))
