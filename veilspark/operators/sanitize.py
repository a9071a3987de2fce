"""Sanitized text of each document: strip, flag or preserve, put together from parts in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import visibility
from ..schema import STRATEGIES
from . import ordered
from .risk import adaptive_strategy

SAMPLE = 10


def check_strategy(strategy: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r}: one of {', '.join(STRATEGIES)} is needed")
    return strategy


def _by_strategy(analyzed_spans: DataFrame, strategy: Column, c: Config) -> DataFrame:
    """The columns of sanitize() for a strategy that may differ from document to document.

    Kept texts stand in reading order (page, top, left, then as extracted), flagged ones as they were extracted."""
    status, text = F.col("visibility_status"), F.col("text")
    flag, strip = strategy == "flag", strategy == "strip"
    gone = ((status == "invisible") & (strategy != "preserve")) | visibility.switched((status == "suspicious") & strip, c.remove_suspicious)
    flagged = flag & (status == "suspicious")
    shown = F.when(flagged, F.concat(c.flag_prefix if isinstance(c.flag_prefix, Column) else F.lit(c.flag_prefix), text)).otherwise(text)
    reading = lambda column: F.when(~flag, column)
    page, within = reading(F.col("page_number")), F.when(flag, ordered.part().cast("double")).otherwise(ordered.band())
    sample = F.collect_list(F.when(gone, F.struct("span_seq", "text")))
    parts = analyzed_spans.groupBy("doc_id", strategy.alias("_strategy"), page.alias("_page"), within.alias("_within")).agg(
        F.count("*").alias("_all"),
        F.count_if(gone).alias("_gone"),
        F.count_if(flagged).alias("_flagged"),
        F.slice(F.array_sort(sample), 1, SAMPLE).alias("_sample"),
        ordered.joined([reading(F.col("bbox.y0")), reading(F.col("bbox.x0")), F.col("span_seq")], shown, ~gone).alias("_text"),
    )
    first = F.slice(F.array_sort(F.flatten(F.collect_list("_sample"))), 1, SAMPLE)
    return parts.groupBy("doc_id", "_strategy").agg(
        F.sum("_all").alias("original_span_count"),
        F.sum(F.col("_all") - F.col("_gone")).alias("sanitized_span_count"),
        F.sum("_gone").alias("removed_count"),
        F.sum("_flagged").alias("flagged_count"),
        F.transform(first, lambda x: x["text"]).alias("removed_text_sample"),
        F.coalesce(ordered.joined([F.col("_page"), F.col("_within")], F.col("_text")), F.lit("")).alias("safe_text"),
    ).withColumnRenamed("_strategy", "strategy_used")


COLUMNS = ["doc_id", "original_span_count", "sanitized_span_count", "removed_count", "flagged_count", "strategy_used", "removed_text_sample", "safe_text"]


def sanitize(analyzed_spans: DataFrame, strategy: str, c: Config = DEFAULT) -> DataFrame:
    """doc_id, original, sanitized, removed and flagged counts, strategy_used, removed_text_sample, safe_text."""
    return _by_strategy(analyzed_spans, F.lit(check_strategy(strategy)), c).select(COLUMNS)


def sanitize_by_level(analyzed_spans: DataFrame, report: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """As sanitize(), with the strategy that each document's level asks for, in one pass over the spans."""
    choice = report.select("doc_id", adaptive_strategy(c).alias("_chosen"))
    return _by_strategy(analyzed_spans.join(choice, "doc_id"), F.col("_chosen"), c).select(COLUMNS)


def reconstructed(spans: DataFrame) -> DataFrame:
    """doc_id, text: all texts in reading order."""
    parts = spans.groupBy("doc_id", "page_number", ordered.band().alias("_within")).agg(ordered.joined([F.col("bbox.y0"), F.col("bbox.x0"), F.col("span_seq")], F.col("text")).alias("_text"))
    return parts.groupBy("doc_id").agg(F.coalesce(ordered.joined([F.col("page_number"), F.col("_within")], F.col("_text")), F.lit("")).alias("text"))
