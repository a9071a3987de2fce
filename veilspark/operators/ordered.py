"""Order across many spans: texts put together in order, and runs of equal neighbours, in bounded pieces.

A document or a page may hold any share of all spans, so neither is ever one list. Spans are grouped in parts first: PART neighbours of the
extraction order, or a band of a page's reading order. A part becomes one row (its text, or its runs and its edges); what is put
together for a document or a page after that are parts, not spans. Both steps are plain aggregations and windows, and only
the first moves spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A part holds 2**PART_BITS spans of the extraction order at most, or the spans of a page that begin within BAND points.
PART_BITS, BAND = 12, 99.0


def part() -> Column:
    """The part of a span in the extraction order."""
    return F.shiftright("span_seq", PART_BITS)


def band() -> Column:
    """The part of a span within its page, in reading order: from top to bottom, spans without a box first."""
    return F.rint(F.col("bbox.y0") / F.lit(BAND))


def joined(order: list[Column], text: Column, keep: Column | None = None) -> Column:
    """Aggregate: the kept texts in order with a space between them, null without any."""
    keep = text.isNotNull() if keep is None else keep & text.isNotNull()
    items = F.collect_list(F.when(keep, F.struct(*[o.alias(f"_{k}") for k, o in enumerate(order)], text.alias("_text"))))
    return F.when(F.count_if(keep) > 0, F.array_join(F.transform(F.array_sort(items), lambda x: x["_text"]), " "))


def before(column: str, by: str = "doc_id", order: str = "_part") -> Column:
    """The sum of a column over the parts of a document that come before this one."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


# ---- text with page markers


def marked(page: Column, was: Column, text: Column) -> Column:
    """text, after a marker where the page is another one."""
    return F.concat_ws(" ", F.when(page != was, F.concat(F.lit("\n--- Page "), page.cast("string"), F.lit(" ---\n"))), text)


def part_text(parts: DataFrame, items: str = "_items") -> DataFrame:
    """Parts whose spans are an array (span_seq, page_number, text), with that array replaced by a struct `_body`: first and last page, and the
    text with markers where the page changes within."""
    sorted_items = parts.withColumn(items, F.array_sort(items))
    own = F.col(items)
    texts = F.transform(own, lambda x, k: F.when(k == 0, F.coalesce(x["text"], F.lit(""))).otherwise(marked(x["page_number"], F.get(own, k - 1)["page_number"], x["text"])))
    body = F.struct("_part", F.get(own, F.lit(0))["page_number"].alias("first"), F.element_at(own, -1)["page_number"].alias("last"), F.array_join(texts, " ").alias("text"))
    return sorted_items.withColumn("_body", body).drop(items)


def document_text(bodies: Column) -> Column:
    """The text of a sorted array of `_body`, with markers where the page changes from part to part, and from page 1 at first."""
    was = lambda k: F.when(k == 0, F.lit(1)).otherwise(F.get(bodies, k - 1)["last"])
    return F.array_join(F.transform(bodies, lambda x, k: marked(x["first"], was(k), x["text"])), " ")


# ---- runs


def runs(df: DataFrame, keys: list[str], kind: str, of_piece: list[Column], of_run: list[Column]) -> DataFrame:
    """Runs of neighbours (by span_seq, within keys) of the same kind: keys, group_seq (from 1), kind and of_run.

    A segmented scan: runs are found within parts (of_piece aggregates the spans of one), then a row a part, with the kinds at its
    edges, tells how many runs came before and whether its first one goes on from the part before; of_run
    aggregates the pieces of a run, whose order is `_part`.
    """
    within = Window.partitionBy(*keys, "_part").orderBy("span_seq")
    numbered = df.withColumn("_part", part())
    numbered = numbered.withColumn("_begins", F.coalesce((F.col(kind) != F.lag(kind).over(within)).cast("int"), F.lit(1)))
    numbered = numbered.withColumn("_run", F.sum("_begins").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = numbered.groupBy(*keys, "_part", "_run", kind).agg(*of_piece)
    edges = pieces.groupBy(*keys, "_part").agg(F.max("_run").alias("_n"), F.min_by(kind, "_run").alias("_first"), F.max_by(kind, "_run").alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_part")
    goes_on = F.coalesce((F.col("_first") == F.lag("_last").over(along)).cast("int"), F.lit(0))
    edges = edges.withColumn("_new", F.col("_n") - goes_on)
    shift = F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    edges = edges.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_at"), shift.alias("_shift"))
    same = F.col("_part") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = pieces.join(edges, same).withColumn("group_seq", F.col("_run") + F.col("_shift"))
    return placed.groupBy(*keys, "group_seq", kind).agg(*of_run)


def joined_runs(pieces: Column) -> Column:
    """An array of pieces (page, part, run, severity, text, reasons), sorted, to its runs (page, text, severity, reasons): neighbours on a page
    with the same severity are one, with their texts joined and their reasons sorted."""
    was = lambda k: F.get(pieces, k - 2)
    begins = lambda k: (k == 1) | (~was(k)["page"].eqNullSafe(F.get(pieces, k - 1)["page"])) | (was(k)["severity"] != F.get(pieces, k - 1)["severity"])
    starts = F.filter(F.when(F.size(pieces) > 0, F.sequence(F.lit(1), F.size(pieces))).otherwise(F.array().cast("array<int>")), begins)
    whole = lambda run: F.struct(
        F.get(run, F.lit(0))["page"].alias("page"),
        F.array_join(F.transform(run, lambda p: p["text"]), " ").alias("text"),
        F.get(run, F.lit(0))["severity"].alias("severity"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(run, lambda p: p["reasons"])))).alias("reasons"),
    )
    ends = lambda k: F.coalesce(F.get(starts, k + 1), F.size(pieces) + 1)
    return F.transform(starts, lambda s, k: whole(F.slice(pieces, s, ends(k) - s)))
