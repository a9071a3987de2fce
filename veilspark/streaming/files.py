"""Files that arrive over time: a stateless stream of analysed spans and of per-file reports.

Each file is read, analysed and rolled up within its own row by array functions, so the stream needs no state, no
watermark and no shuffle, and a report comes out with the batch that brings the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import injection, visibility
from ..operators import risk
from ..schema import SPAN
from ..sources import ingest
from ..sources import files as source_files
from ..sources.extraction import SPAN_ARROW, Info, attempt, span_array

FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def read_stream(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).load(path)


def span_arrays(files: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """path, spans (array), error, choice, seen_at, digest; one row a file. A file whose text only OCR can read is an error. seen_at is when the
    file was modified, null where that isn't known; the digest is that of its content."""
    mode = c.highlight_mode
    kept = {"seen_at": "timestamp", "digest": "string"}
    seen = F.col("modificationTime") if "modificationTime" in files.columns else F.lit(None).cast("timestamp")
    names = ["path", "spans", "error", *Info._fields, *kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a file at a time: a batch may hold many large ones
            for k in range(batch.num_rows):
                content, error = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                spans, info = [], Info(0)
                if error is None:
                    spans, info, error = attempt(lambda x: source_files.read_any(x, mode), content or b"")
                found = [pa.ListArray.from_arrays(pa.array([0, len(spans)], pa.int32()), span_array(spans), pa.list_(SPAN_ARROW)), pa.array([error], pa.string()), *[pa.array([x], kind) for x, kind in zip(info, (pa.int64(), pa.float64(), pa.float64()))]]
                yield pa.record_batch([batch.column(0).slice(k, 1), *found, *[batch.column(name).slice(k, 1) for name in kept]], names=names)

    routed = files.select("path", "content", ingest.route_error(F.col("path")).alias("error"), seen.alias("seen_at"), F.sha2("content", 256).alias("digest"))
    schema = f"path string, spans array<{SPAN}>, error string, native_chars long, page_area double, image_area double, " + ", ".join(f"{n} {k}" for n, k in kept.items())
    out = routed.mapInArrow(run, schema).withColumn("choice", source_files.choice_of(c))
    unread = F.when(F.col("choice") != "native", F.lit(source_files.NEEDS_OCR))
    return out.select("path", F.when(unread.isNull(), F.col("spans")).otherwise(F.array().cast(f"array<{SPAN}>")).alias("spans"), F.coalesce("error", unread).alias("error"), "choice", *kept)


def reports(arrays: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """path, error, counts, prompt_injection_patterns, risk_level, risk_score, exit_code of each file, and seen_at and digest if arrays have them."""
    status = lambda s: visibility.status_of(s["font_color"], s["background_color"], s["font_size"], s["bbox"], c)
    marked = arrays.withColumn("marked", F.transform("spans", lambda s: F.struct(status(s).alias("status"), s["text"].alias("text"))))
    count: Column = lambda kind: F.size(F.filter("marked", lambda m: m["status"] == kind)).cast("long")
    hidden = F.filter("marked", lambda m: visibility.is_hidden(m["status"]))
    found = F.flatten(F.transform(hidden, lambda m: injection.matches(m["text"])))
    about = [k for k in ("seen_at", "digest") if k in arrays.columns]
    out = marked.select(
        "path", "error", *about, F.size("spans").cast("long").alias("total_spans"), count("visible").alias("visible_count"), count("suspicious").alias("suspicious_count"),
        count("invisible").alias("invisible_count"), count("unknown").alias("unknown_count"), F.array_sort(F.array_distinct(found)).alias("prompt_injection_patterns"),
    )
    out = out.withColumn("prompt_injection_detected", F.size("prompt_injection_patterns") > 0)
    out = out.withColumn("risk_level", risk.risk_level(F.col("invisible_count"), F.col("suspicious_count"), F.col("prompt_injection_detected"), c))
    read = F.col("error").isNull()
    out = out.withColumn("risk_level", F.when(read, F.col("risk_level")))  # a file that wasn't read has no level
    code = F.when(F.col("error").isNotNull(), risk.ERROR_EXIT).otherwise(risk.scan_exit_code())
    return out.withColumn("risk_score", F.when(read, risk.gate_score())).withColumn("exit_code", code)


def write_reports(stream: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Starts writing reports as Parquet, exactly once a file; once=True stops after what is there now."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
