"""Per-span operators: analysis, filters and predicates over a spans frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import color, injection, text, visibility


def analyzed(spans: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """spans with contrast_ratio and visibility_status.

    The contrast comes through a generator of one row: as a plain column it would be copied into each filter, status and reason
    that uses it, which is too much code to compile."""
    fg, bg = F.col("font_color"), F.col("background_color")
    out = spans.select("*", F.explode(F.array(color.contrast_ratio(fg, bg))).alias("contrast_ratio"))
    status = visibility.visibility_status(F.col("contrast_ratio"), F.col("font_size"), F.col("bbox"), visibility.metadata_known(fg, bg), c)
    return out.withColumn("visibility_status", status)


def hidden(analyzed_spans: DataFrame) -> DataFrame:
    return analyzed_spans.where(visibility.is_hidden(F.col("visibility_status")))


def invisible(analyzed_spans: DataFrame) -> DataFrame:
    return analyzed_spans.where(F.col("visibility_status") == "invisible")


def near_white(spans: DataFrame, least: int = 700) -> DataFrame:
    c = F.col("font_color")
    return spans.where(c["r"] + c["g"] + c["b"] > least)


def small_font(spans: DataFrame, limit: float = 5.0) -> DataFrame:
    return spans.where((F.col("font_size") != 0) & (F.col("font_size") < limit))


def with_matches(hidden_spans: DataFrame) -> DataFrame:
    """Hidden spans with the injection phrases they hold (column matches), spans without any left out."""
    return hidden_spans.withColumn("matches", injection.matches(F.col("text"))).where(F.size("matches") > 0)


def with_reasons(hidden_spans: DataFrame, places: int | None = None) -> DataFrame:
    return hidden_spans.withColumn("reasons", text.reasons(F.col("contrast_ratio"), F.col("font_size"), places))
