"""A running roll-up of files as they arrive, and OCR tokens that arrive beside them: the two places where the stream keeps state.

Both states are bounded by a watermark on when files were modified. The roll-up counts a file once however often it is sent: what
has been seen is kept for `late`, and a window is handed on once nothing can join it any more. Files older than the watermark are left out;
Spark counts them as rows dropped by the watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import risk
from ..schema import SPAN
from ..sources import files as source_files
from ..sources import ocr

# ---- roll-up


def file_key() -> list[Column]:
    """What makes a file the same: its name, wherever it lies, and its content."""
    return [F.element_at(F.split("path", "/"), -1).alias("_name"), F.col("digest").alias("_digest")]


def once_each(reports: DataFrame, late: str = "1 hour") -> DataFrame:
    """Reports (path, digest, seen_at, ...) without files that are there already. A stream keeps the first that comes and remembers it for `late`
    beyond its time; a table keeps the one seen first, then the smallest path."""
    keyed = reports.select("*", *file_key())
    if reports.isStreaming:
        out = keyed.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["_name", "_digest"])
    else:
        first = F.row_number().over(Window.partitionBy("_name", "_digest").orderBy(F.col("seen_at").asc_nulls_last(), "path"))
        out = keyed.withColumn("_rn", first).where("_rn = 1").drop("_rn")
    return out.drop("_name", "_digest")


def rollup(reports: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, verdict, n_files, hidden_spans, worst (exit code), first_file, last_file: a row a window and verdict. The same
    plan serves a stream, in append mode, and a table."""
    files = once_each(reports.where("seen_at IS NOT NULL"), late)
    found = files.groupBy(F.window("seen_at", window).alias("w"), risk.batch_verdict(F.col("exit_code")).alias("verdict")).agg(
        F.count("*").alias("n_files"),
        F.sum(risk.hidden_count()).alias("hidden_spans"),
        F.max("exit_code").alias("worst"),
        F.min("path").alias("first_file"),
        F.max("path").alias("last_file"),
    )
    return found.select(F.col("w.start").alias("window_start"), "verdict", "n_files", "hidden_spans", "worst", "first_file", "last_file")


# ---- tokens

TOKEN = "struct<token_seq:bigint,page_index:int,text:string,conf:int,left:int,top:int,width:int,height:int,dpi:int>"
TOKENS = f"path string, arrived_at timestamp, tokens array<{TOKEN}>"


def token_array_spans(tokens: Column) -> Column:
    """Spans of an array of a file's OCR tokens: those that can be trusted and show something, by number."""
    kept = F.filter(tokens, lambda t: (t["conf"] >= ocr.LEAST_CONFIDENCE) & (F.trim(t["text"]) != ""))

    def span(t: Column) -> Column:
        scale = F.lit(72.0) / t["dpi"]
        x0, y0 = t["left"] * scale, t["top"] * scale
        box = F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + t["width"] * scale).alias("x1"), (y0 + t["height"] * scale).alias("y1"))
        nothing = F.lit(None)
        return F.struct(t["token_seq"].alias("span_seq"), F.trim(t["text"]).alias("text"), (t["page_index"] + 1).alias("page_number"), box.alias("bbox"), nothing.cast("double").alias("font_size"), nothing.cast("struct<r:int,g:int,b:int>").alias("font_color"), nothing.cast("struct<r:int,g:int,b:int>").alias("background_color"))

    return F.array_sort(F.transform(kept, span)).cast(f"array<{SPAN}>")


def with_tokens(arrays: DataFrame, tokens: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows as of span_arrays() in which files that need OCR have the spans of their tokens (TOKENS, a row a file), which may come up to `late`
    before or after the file. Files without tokens by then stay errors; those that need none are handed on at once. Of a file's
    tokens that come several times, each makes a row."""
    waiting = F.col("error").eqNullSafe(F.lit(source_files.NEEDS_OCR)) & (F.col("choice") == "ocr")
    given = tokens.select(F.col("path").alias("_path"), "arrived_at", F.col("tokens").alias("_tokens"))
    files = arrays
    if arrays.isStreaming:
        files, given = files.withWatermark("seen_at", late), given.withWatermark("arrived_at", late)
    # one condition that looks at the time, as a filter that doesn't would go below the watermark, which only files that wait would move then
    files = files.where(F.when(F.col("seen_at").isNotNull(), waiting).otherwise(False))
    near = (F.col("path") == F.col("_path")) & F.expr(f"arrived_at >= seen_at - INTERVAL {late}") & F.expr(f"arrived_at <= seen_at + INTERVAL {late}")
    met = files.join(given, near, "left_outer")
    has = F.col("_path").isNotNull()
    spans = F.when(has, token_array_spans(F.col("_tokens"))).otherwise(F.col("spans"))
    met = met.select("path", spans.alias("spans"), F.when(~has, F.col("error")).alias("error"), "choice", "seen_at", "digest")
    return arrays.where(~waiting | F.col("choice").isNull() | F.col("seen_at").isNull()).unionByName(met)


def write_rollup(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Starts writing a roll-up as Parquet; once=True stops after what is there now."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
