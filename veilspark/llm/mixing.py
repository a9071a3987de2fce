"""Mixing sources to target weights by pivotal dependent rounding (operator 2), in DataFrame functions only.

Every document of a source gets target / source_size copies: the whole copies are certain, and the
fraction is a probability. Pivotal rounding pairs two fractional documents and moves mass (probability times size)
between them at random until one is taken or left; the pair's mass, so the number of words, stays the same,
and every document keeps its probability. Blocks of BLOCK documents are folded to one residual
each, the residuals are dealt into blocks again, and so on: a reduction tree whose last residual is
the only document rounded by chance alone.

Documents are rounded in kinds, larger ones first (BIG); what a kind's last residual is off by is taken from, or
given to, the probability of all smaller documents of the source, which leaves every probability as it was on
average. So a source's words come near its target: within the size of one document of a kind whose smaller ones
have too few words left to make it up.

Random numbers are hashes of the pair's ids, so reruns agree. Rows are dealt by a hash of their id within
their source, so no source, however large, meets in one task; equal rows are numbered, and the number is hashed too.

Defined cases: null, empty and wordless texts have size 0 and are taken 0 words; a null source is a source of its own, last
in order; a null doc_id is an id like any other; rows that share a doc_id, or are equal in all columns, are decided one by one;
documents of the same size are taken in the order of their ids; a very long text is one count of words, without a copy of it; a source
without words has target 0; extra columns are ignored, or passed through under their own names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import from_id, hot_join, small, to_id, unpacked, whole_row, written
from .sharding import RANKED, ranked

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK, BUCKET, SEED = 64, 4096, 20
#: Equal rows that are unrolled from one count at once.
CHUNK = 1 << 16
#: Up to so many sources, what is known of each is broadcast.
FEW_SOURCES = 20_000
#: Kinds of documents by their share of their source's fractional words, larger ones rounded first.
BIG = (0.05, 0.015, 0.005, 0.0015, 0.0005)
WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds s (number), weight and target to a row a source (source, source_size): the level at which weighted shares, none above cap times
    its source, make up `share` of all sizes. Sources in order of cap per weight are capped one after another; the first
    that isn't capped fixes the level for all that follow."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("s", F.row_number().over(order) - 1).withColumn("weight", F.element_at(cyc, (F.pmod("s", F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everyone = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all", F.sum("source_size").over(everyone) * F.lit(float(share))).withColumn("weights", F.sum("weight").over(everyone))
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("free", F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level")))
    s = s.withColumn("level", F.max("free").over(everyone))
    # where no source is free (share is no less than cap), all are capped
    return s.withColumn("target", F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most")).drop("most", "all", "weights", "level", "free")


def uniform(*cols: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def _fold(items: Column, level: int) -> Column:
    """Pivotal rounding over an array of (id, w, nth, m) structs: struct(done: array of (id, w, up), id, w, nth, m), the last four the residual."""
    names = ("id", "w", "nth")
    same = lambda x: [x[c].alias(c) for c in names]
    first = F.element_at(items, 1)
    start = F.struct(F.array().cast("array<struct<id:bigint,w:bigint,up:int>>").alias("done"), *same(first), first["m"].alias("m"))

    def merge(acc: Column, x: Column) -> Column:
        total = acc["m"] + x["m"]
        to_acc, to_x = F.least(acc["w"] - acc["m"], x["m"]), F.least(x["w"] - x["m"], acc["m"])
        acc_gains = uniform(*[y[c] for y in (acc, x) for c in names], F.lit(level)) * (to_acc + to_x) < to_x

        def after(gains: Column, loses: Column) -> Column:
            full = gains["w"] <= total
            gone = F.when(full, F.struct(gains["id"].alias("id"), gains["w"].alias("w"), F.lit(1).alias("up"))).otherwise(F.struct(loses["id"].alias("id"), loses["w"].alias("w"), F.lit(0).alias("up")))
            rest = F.when(full, F.struct(*same(loses))).otherwise(F.struct(*same(gains)))
            return F.struct(F.concat(acc["done"], F.array(gone)).alias("done"), *same(rest), F.when(full, total - gains["w"]).otherwise(total).alias("m"))

        return F.when(acc_gains, after(acc, x)).otherwise(after(x, acc))

    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, merge)


def _with_sources(rows: DataFrame, per_source: DataFrame, n_sources: int, on: Column | str = "s") -> DataFrame:
    """rows joined to a row a source: by broadcast if there are few sources, else by a shuffle, which is dealt anew
    so that a large source is not in one task in what follows."""
    if n_sources <= FEW_SOURCES:
        return rows.join(F.broadcast(per_source), on)
    return rows.join(per_source, on).repartition("s", "id")


def _round(rows: DataFrame, level: int, name: str, n_sources: int) -> DataFrame:
    """One level of the tree over (s, id, w, nth, m): written rows (s, done, id, w, nth, m), one a block."""
    per = rows.groupBy("s").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))
    dealt = _with_sources(rows, per, n_sources).withColumn("b", F.pmod(F.xxhash64(F.lit(level), "id", "w", "nth"), "buckets"))
    at = F.row_number().over(Window.partitionBy("s", "b").orderBy(F.desc("w"), "id", "nth", "m"))
    dealt = dealt.withColumn("k", F.floor((at - 1) / BLOCK)).withColumn("at", at)
    fields = ("id", "w", "nth", "m")
    items = F.transform(F.array_sort(F.collect_list(F.struct("at", *fields))), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    blocks = dealt.groupBy("s", "b", "k").agg(items.alias("items"))
    return written(blocks.select("s", _fold(F.col("items"), level).alias("f")).select("s", "f.*"), name)


def round_by_pairs(rows: DataFrame, n_sources: int, name: str = "mixing") -> DataFrame:
    """(s, id, w, up) for rows (s, id, w, nth, m): up is 0 or 1, and the sum of w over up = 1 is that of m in every s but for the last residual."""
    done, now, level = None, rows, 0
    while True:
        blocks = _round(now, level, name, n_sources)
        part = blocks.select("s", F.explode("done").alias("d")).select("s", "d.*")
        done = part if done is None else done.union(part)
        most = blocks.groupBy("s").count().agg(F.max("count")).first()[0]
        now = blocks.select("s", "id", "w", "nth", "m")
        level += 1
        if (most or 0) <= 1:
            last = now.withColumn("up", (uniform("s", "id", "w", "nth", F.lit("last")) * F.col("w") < F.col("m")).cast("int"))
            return done.union(last.select("s", "id", "w", "up"))


def numbered(sizes: DataFrame) -> DataFrame:
    """Rows (id, source, size) with `nth`, which tells equal rows apart: they are counted, and the counts unrolled CHUNK at a time. So equal
    rows, such as those without an id, get hashes of their own and are dealt out like any others, on every run alike."""
    counted = sizes.groupBy("id", "source", "size").agg(F.count("*").alias("n"))
    chunk = F.lit(CHUNK).cast("long")
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))))
    own = F.explode(F.sequence(F.col("part") * chunk, F.least(F.col("n"), (F.col("part") + 1) * chunk) - 1))
    return parts.select("id", "source", "size", own.alias("nth"))


def mix_sizes(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """id, source, size, source_size, target, copies for rows (id, source, size)."""
    base = written(numbered(sizes.select("id", "source", "size")), "sizes")
    sources = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    sources = sources.withColumn("x", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    sources = written(sources.withColumn("whole", F.floor("x")).withColumn("p", F.col("x") - F.floor("x")), "sources")
    n = sources.count()
    known = _with_sources(base, sources.withColumnRenamed("source", "_of"), n, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    share_of = F.col("size") / (F.col("p") * F.col("source_size"))
    kind = sum((F.when(share_of > b, 1).otherwise(0) for b in BIG[1:]), F.when(share_of > BIG[0], 1).otherwise(0))
    known = known.withColumn("kind", F.when((F.col("p") > 0) & (F.col("size") > 0), len(BIG) - kind).otherwise(-1))
    words = written(known.where("kind >= 0").groupBy("s", "kind").agg(F.sum("size").alias("words")), "words")
    state, every = sources.select("s", "p"), None
    for k in range(len(BIG) + 1):
        open_rows = known.where(F.col("kind") == k).select("s", "id", F.col("size").alias("w"), "nth")
        open_rows = _with_sources(open_rows, state, n)
        part = round_by_pairs(open_rows.select("s", "id", "w", "nth", (F.col("p") * F.col("w")).alias("m")), n)
        if k < len(BIG):  # what this kind takes over its share, the smaller documents take less
            part = written(part, "part")
            took = part.groupBy("s").agg(F.sum(F.col("w") * F.col("up")).alias("took"), F.sum("w").alias("own"))
            rest = words.where(F.col("kind") > k).groupBy("s").agg(F.sum("words").alias("rest"))
            off = (F.coalesce("took", F.lit(0)) - F.col("p") * F.coalesce("own", F.lit(0))) / F.col("rest")
            state = state.join(took, "s", "left").join(rest, "s", "left")
            state = written(state.select("s", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") - off)), "p").alias("p")), "state")
        every = part if every is None else every.union(part)
    closed = known.where("kind = -1").select("s", "id", F.col("size").alias("w"), F.lit(0).alias("up"))
    about = sources.select("s", "source", "source_size", "target", "whole")
    return _with_sources(every.union(closed), about, n).select("id", "source", F.col("w").alias("size"), "source_size", "target", (F.col("whole") + F.col("up")).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    rows = docs.select(to_id(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    return mix_sizes(rows).select(from_id("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it. Rows of one id, source and size are alike to the mix, so their decisions are
    dealt to them by a hash of their columns; every decision goes to one row."""
    told = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    rows = docs.select(whole_row(docs).alias("row"), to_id(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), F.xxhash64(*[F.col(f"`{c}`") for c in told]).alias("hash"))
    decided = written(mix_sizes(rows.select("id", "source", "size")).groupBy("id", "source", "size").agg(F.count("*").alias("n"), F.min("copies").cast("int").alias("least"), F.sum("copies").alias("all")), "decided")
    # the ids whose rows all get the same need no more than the id; those of others are told apart
    even = F.max(F.col("all") / F.col("n")) == F.min("least")
    ids = written(decided.groupBy("id").agg(F.min("least").alias("copies"), F.sum("n").alias("n"), even.alias("even")), "ids")
    total = ids.agg(F.sum("n")).first()[0] or 0
    out = hot_join(rows.select("row", "id", "hash"), ids.where("even AND copies > 0").drop("even"), "id", total, "n").where("copies > 0").select("row", "copies")
    apart = written(ids.where("NOT even").select("id"), "apart")
    if apart.head(1):
        names = F.concat_ws(":", "id", "size", F.coalesce(F.hex(F.col("source").cast("string")), F.lit("-"))).alias("key")
        kinds = decided.join(small(apart), "id").select(names, "n", "least", (F.col("all") - F.col("n") * F.col("least")).alias("more"))
        kinds = written(kinds.withColumn("of", F.col("n")), "kinds")
        open_rows = rows.join(small(apart), "id", "left_semi").select("row", names, "hash")
        open_rows = hot_join(open_rows, kinds, "key", total, "n")
        open_rows = ranked(open_rows, ["key"], F.pmod("hash", F.floor(F.col("of") / RANKED) + 1), ["hash"], "nth")
        out = out.union(open_rows.select("row", (F.col("least") + (F.col("nth") < F.col("more")).cast("int")).alias("copies")))
    return unpacked(out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))))
