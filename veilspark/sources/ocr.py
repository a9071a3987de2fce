"""OCR token tables, scanned-page tests and pixel colours, all as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..schema import BBOX, COLOR

LEAST_CONFIDENCE, SCANNED_SHARE, NATIVE_CHARS, UNREADABLE_SHARE = 30, 0.7, 50, 0.5


def trusted() -> Column:
    """Whether a token is confident and shows something."""
    return (F.col("conf") >= LEAST_CONFIDENCE) & (F.trim("text") != "")


def tokens_to_spans(tokens: DataFrame) -> DataFrame:
    """Spans of an OCR token table: confident, non-blank tokens, pixels scaled to points; the size is unknown."""
    scale = F.lit(72.0) / F.col("dpi")
    kept = tokens.where(trusted())
    x0, y0 = F.col("left") * scale, F.col("top") * scale
    return kept.select("doc_id", "token_seq", F.trim("text").alias("text"), (F.col("page_index") + 1).alias("page_number"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("width") * scale).alias("x1"), (y0 + F.col("height") * scale).alias("y1"), F.lit(None).cast("double").alias("font_size"))


def token_spans(tokens: DataFrame) -> DataFrame:
    """tokens_to_spans() in the engine's schema: numbered by token_seq, with the tokens' font_color and background_color if they have them."""
    color = [F.col(c).cast(COLOR).alias(c) if c in tokens.columns else F.lit(None).cast(COLOR).alias(c) for c in ("font_color", "background_color")]
    own = tokens.select("doc_id", "token_seq", *color)
    spans = tokens_to_spans(tokens)
    if "font_color" in tokens.columns or "background_color" in tokens.columns:
        spans = spans.join(own, ["doc_id", "token_seq"])
    else:
        spans = spans.select("*", *color)
    box = F.struct("x0", "y0", "x1", "y1").cast(BBOX)
    return spans.select("doc_id", F.col("token_seq").cast("long").alias("span_seq"), "text", F.col("page_number").cast("int").alias("page_number"), box.alias("bbox"), "font_size", "font_color", "background_color")


def scanned(pages: DataFrame, rects: DataFrame) -> DataFrame:
    """doc_id, page_area, image_area, is_scanned. Both sides are summed by document before they meet; a rectangle
    that can't be read (null) counts half its page."""
    area = (F.col("width") * F.col("height")).alias("area")
    by_page = pages.select("doc_id", "page", area)
    unread = rects.where("width IS NULL").groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    half = by_page.join(unread, ["doc_id", "page"]).groupBy("doc_id").agg(F.sum(F.col("area") * UNREADABLE_SHARE * F.col("n")).alias("unread_area"))
    read = rects.where("width IS NOT NULL").groupBy("doc_id").agg(F.sum(F.col("width") * F.col("height")).alias("read_area"))
    total = by_page.groupBy("doc_id").agg(F.sum("area").alias("page_area"))
    out = total.join(read, "doc_id", "left").join(half, "doc_id", "left")
    images = F.coalesce("read_area", F.lit(0.0)) + F.coalesce("unread_area", F.lit(0.0))
    out = out.select("doc_id", "page_area", images.alias("image_area"))
    return out.withColumn("is_scanned", F.when(F.col("page_area") > 0, F.col("image_area") / F.col("page_area") > SCANNED_SHARE).otherwise(F.lit(False)))


def extraction_choice(native_chars: Column, is_scanned: Column, c: Config = DEFAULT) -> Column:
    """'ocr' where the native text is short, the file is scanned and OCR is on; else 'native'."""
    return F.when((native_chars < NATIVE_CHARS) & is_scanned & F.lit(c.ocr_enabled), "ocr").otherwise("native")


def pixel_colors(pixels: DataFrame) -> DataFrame:
    """doc_id, box_id, font_color, background_color: the mean of all pixels, and of those no brighter than the 10th percentile.

    One aggregation gathers each box's pixels by brightness: at most 766 sums, however many pixels a box has."""
    total = F.col("r") + F.col("g") + F.col("b")
    sums = lambda names: [F.sum(c).alias(c) for c in names]
    by_light = pixels.groupBy("doc_id", "box_id", total.alias("light")).agg(F.count("*").alias("n"), *sums("rgb"))
    box = Window.partitionBy("doc_id", "box_id")
    upto = box.orderBy("light").rowsBetween(Window.unboundedPreceding, 0)
    # the percentile lies between the pixels of ranks floor(at) and floor(at) + 1, counted from 0
    at = F.lit(0.1) * (F.sum("n").over(box) - 1)
    ranked = by_light.withColumn("_at", at).withColumn("_upto", F.sum("n").over(upto))
    lower = F.min(F.when(F.col("_upto") > F.floor("_at"), F.col("light"))).over(box)
    upper = F.min(F.when(F.col("_upto") > F.floor("_at") + 1, F.col("light"))).over(box)
    limit = lower + (F.col("_at") - F.floor("_at")) * (F.coalesce(upper, lower) - lower)
    ranked = ranked.withColumn("_dark", F.col("light") <= F.round(limit, 9))
    mean = lambda c, when: (F.sum(F.when(when, F.col(c))) / F.sum(F.when(when, F.col("n")))).cast("int").alias(c)
    color = lambda when: F.struct(*[mean(c, when) for c in "rgb"])
    return ranked.groupBy("doc_id", "box_id").agg(color(F.col("_dark")).alias("font_color"), color(F.lit(True)).alias("background_color"))
