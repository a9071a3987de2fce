"""What the operators share: written tables in the shared folder, hot-key joins, components.

Ids may be null: inside an operator a null id is NO_ID, which sorts after all others, and it turns
back into null in what the operator returns. Rows with the same id count as one document.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = 2**63 - 1
#: A key is hot when it holds at least this share of the rows; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: White space by the contracts: space and U+0009 to U+000D.
SPACE = b" \t\n\x0b\x0c\r"


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(task: Task) -> Task:
    """task, giving the memory that it has freed back to the system when it ends: Spark keeps idle Python workers, and what
    they hold counts against the executor."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return run


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes: how many there are, then low bytes first, as most numbers are small."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return len(numbers).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpack_numbers(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = pa.Codec("zstd").decompress(packed[8:], 4 * n, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


def to_id(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(NO_ID)).cast("long")


def from_id(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != NO_ID, c)


#: Up to so many rows, a table is broadcast.
FEW_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has FEW_ROWS rows at most; without one it joins by a shuffle."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


#: Folders made for local sessions that name none, by application.
_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where a local session names none, one of our own; on a cluster
    that would be another folder on every machine, so none is made there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = f"file://{tempfile.mkdtemp(prefix='veilspark-')}"
        found = _OWN_DIRS[app]
    return found.rstrip("/")


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one, so that no name of theirs can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def unpacked(df: DataFrame, row: str = "row") -> DataFrame:
    return df.select(f"{row}.*")


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended; nothing depends on the folder any more
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/veilspark/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Removes tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_written_at", None):
            remove(df.sparkSession, path)


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: int, count: str) -> DataFrame:
    """left LEFT JOIN right on key; right has one row a key and, in `count`, how many rows of left have it.

    Keys with at least HOT_SHARE of `rows` go by a broadcast of at most 1 / HOT_SHARE rows; their left rows
    then pass through the join of all others under a key of their own, so no task holds a hot key.
    """
    least = max(2, int(rows * HOT_SHARE) + 1)
    cols = [c for c in right.columns if c not in (key, count)]
    hot = right.where(F.col(count) >= least).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in cols])
    cold = right.where(F.col(count) < least).select(F.col(key).alias("_ck"), *cols)
    kind = left.schema[key].dataType
    spread = F.xxhash64(*[F.col(c) for c in left.columns if left.schema[c].dataType.simpleString() in ("bigint", "int", "string", "binary")])
    spread = spread.cast(kind) if kind.simpleString() == "bigint" else spread.cast("string").cast(kind)
    out = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    # a key of its own for each row that is settled: matching by a salt beside the key would let the join deal by the key alone
    out = out.withColumn("_lk", F.when(F.col("_hk").isNotNull(), spread).otherwise(F.col(key)))
    out = out.join(cold, (F.col("_lk") == F.col("_ck")) & F.col("_hk").isNull(), "left")
    return out.select(*left.columns, *[F.when(F.col("_hk").isNotNull(), F.col(f"_h_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the smallest node reachable.

    Alternating large-star and small-star rounds; each is written to the shared folder, and the rounds end
    when the edges no longer change. No edge list leaves the executors.
    """
    big, small = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = written(edges.where("u <> v").select(big, small).distinct(), name)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = mark(now)
    for _ in range(most_rounds):
        if not was[0]:
            break
        both = now.union(now.select("v", "u"))
        # a node may have a third of all edges, so both joins treat hot nodes apart
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = hot_join(both.where("v > u"), least, "u", 2 * was[0], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        star = hot_join(large, down, "u", was[0], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(star.union(down.select("u", F.col("m").alias("v"))).distinct(), name)
        mark_after = mark(after)
        drop_written(now)
        now = after
        if mark_after == was:
            break
        was = mark_after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
