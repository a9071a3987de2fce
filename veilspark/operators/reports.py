"""Reports over analysed spans: issues, pages, full text, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text, visibility
from ..sources import ingest
from . import ordered, risk, spans as span_ops


def hidden_by_page(analyzed_spans: DataFrame, places: int = 1) -> DataFrame:
    """doc_id, page_number, n_hidden, severity, and the first hidden span's preview and reasons."""
    h = span_ops.with_reasons(span_ops.hidden(analyzed_spans), places)
    per = h.groupBy("doc_id", "page_number").agg(
        F.count("*").alias("n_hidden"),
        F.bool_or(F.col("visibility_status") == "invisible").alias("_inv"),
        F.min(F.struct("span_seq", "text", "reasons")).alias("_first"),
    )
    severity = F.when(F.col("_inv"), "INVISIBLE").otherwise("LOW CONTRAST")
    return per.select("doc_id", "page_number", "n_hidden", severity.alias("severity"), text.preview(F.col("_first.text"), 50).alias("example"), F.array_join("_first.reasons", ", ").alias("why"))


def _first_rows(rows: DataFrame, order: str, most: int, left_over: str) -> DataFrame:
    """The first rows of each document (rn), with how many more there are. The limit works on both sides of the shuffle, so the
    count is an aggregation of its own."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(order))).where(F.col("rn") <= most)
    counts = rows.groupBy("doc_id").agg(F.greatest(F.count("*") - most, F.lit(0)).alias(left_over))
    return ranked.join(counts, "doc_id")


def top_pages(by_page: DataFrame, most: int = 10) -> DataFrame:
    """The first pages of each document, with how many more there are."""
    return _first_rows(by_page, "page_number", most, "more_pages")


def top_problem_spans(analyzed_spans: DataFrame, most: int = 10, chars: int = 50) -> DataFrame:
    """The first hidden spans of each document as shown, with how many more there are; texts are cut before the shuffle."""
    h = span_ops.hidden(analyzed_spans).select("doc_id", "span_seq", F.upper("visibility_status").alias("status"), F.substring("text", 1, chars).alias("shown"), "page_number", "contrast_ratio", "font_size")
    size = F.when(F.col("font_size") != 0, text.fixed(F.col("font_size"), 1))
    first = _first_rows(h, "span_seq", most, "more_spans")
    return first.select("doc_id", F.col("rn").cast("int").alias("rn"), "status", "shown", "page_number", text.fixed(F.col("contrast_ratio"), 2).alias("contrast"), size.alias("size"), "more_spans")


def issue_groups(analyzed_spans: DataFrame, most: int | None = None) -> DataFrame:
    """Runs of hidden spans of a page with the same severity: doc_id, page_number, group_seq, severity, text, reasons (sorted). With
    `most`, texts may end after one character more than that; they are then cut before they are shuffled."""
    cut = lambda column: column if most is None else F.substring(column, 1, most + 1)
    h = span_ops.with_reasons(span_ops.hidden(analyzed_spans))
    h = h.select("doc_id", "page_number", "span_seq", text.severity(F.col("visibility_status")).alias("severity"), cut(F.col("text")).alias("text"), "reasons")
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons")
    of_piece = [cut(ordered.joined([F.col("span_seq")], F.col("text"))).alias("text"), reasons]
    of_run = [F.coalesce(ordered.joined([F.col("_part")], F.col("text")), F.lit("")).alias("text"), reasons]
    return ordered.runs(h, ["doc_id", "page_number"], "severity", of_piece, of_run)


def issues(analyzed_spans: DataFrame) -> DataFrame:
    """Issue rows as shown: texts cut to 100 code points, reasons joined."""
    g = issue_groups(analyzed_spans, most=100)
    return g.select("doc_id", F.col("page_number").alias("page"), "group_seq", text.preview(F.col("text"), 100).alias("text"), "severity", F.array_join("reasons", ", ").alias("reasons"))


def full_text(spans: DataFrame) -> DataFrame:
    """doc_id, full_text: all texts with a marker where the page changes (from page 1 at first)."""
    parts = spans.groupBy("doc_id", ordered.part().alias("_part")).agg(F.collect_list(F.struct("span_seq", "page_number", "text")).alias("_items"))
    bodies = ordered.part_text(parts).groupBy("doc_id").agg(F.array_sort(F.collect_list("_body")).alias("_bodies"))
    return bodies.select("doc_id", ordered.document_text(F.col("_bodies")).alias("full_text"))


def viewer_sections(full: DataFrame) -> DataFrame:
    """The sections between page markers as a viewer numbers them; a blank first one is left out."""
    cut = full.select("doc_id", F.posexplode(F.split("full_text", "--- Page [0-9]+ ---")).alias("section", "body"))
    body = F.regexp_replace("body", r"^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$", "")
    return cut.select("doc_id", "section", body.alias("body")).where((F.col("section") > 0) | (F.col("body") != ""))


def web_report(spans: DataFrame, documents: DataFrame | None = None, c: Config = DEFAULT, errors: DataFrame | None = None) -> DataFrame:
    """A row a document as the web view shows it, with issues as an array. documents with a path add the file type; errors (doc_id,
    error) add a row with status ERROR for each file that can't be read.

    Spans are read and dealt by part once; windows, runs and parts then follow in place, and only a row a part goes on to the document."""
    analyzed = span_ops.with_reasons(span_ops.analyzed(spans, c)).withColumn("_hidden", visibility.is_hidden(F.col("visibility_status")))
    severity = F.when(F.col("_hidden"), text.severity(F.col("visibility_status")))
    dealt = analyzed.withColumn("_part", ordered.part()).withColumn("_severity", severity).repartition("doc_id", "_part")
    on_page = Window.partitionBy("doc_id", "page_number", "_part").orderBy("span_seq")
    was = F.last("_severity", ignorenulls=True).over(on_page.rowsBetween(Window.unboundedPreceding, -1))
    dealt = dealt.withColumn("_begins", (F.col("_hidden") & (was.isNull() | (was != F.col("_severity")))).cast("int"))
    dealt = dealt.withColumn("_run", F.when(F.col("_hidden"), F.sum("_begins").over(on_page.rowsBetween(Window.unboundedPreceding, 0))))
    hidden = F.col("_hidden")
    runs = dealt.groupBy("doc_id", "page_number", "_part", "_run", "_severity").agg(
        *risk.span_measures(c),
        F.collect_list(F.struct("span_seq", "page_number", "text")).alias("_items"),
        F.substring(F.coalesce(ordered.joined([F.col("span_seq")], F.substring("text", 1, 101), hidden), F.lit("")), 1, 101).alias("_text"),
        F.array_distinct(F.flatten(F.collect_set(F.when(hidden, F.col("reasons"))))).alias("_reasons"),
    )
    piece = F.struct(F.col("page_number").alias("page"), F.col("_part").alias("part"), F.col("_run").alias("run"), F.col("_severity").alias("severity"), F.col("_text").alias("text"), F.col("_reasons").alias("reasons"))
    parts = runs.groupBy("doc_id", "_part").agg(*risk.merged_measures(), F.flatten(F.collect_list("_items")).alias("_items"), F.collect_list(F.when(F.col("_run").isNotNull(), piece)).alias("_pieces"))
    per = risk.few_samples(ordered.part_text(parts)).groupBy("doc_id").agg(
        *risk.document_measures(),
        F.array_sort(F.flatten(F.collect_list("_pieces"))).alias("_pieces"),
        F.array_sort(F.collect_list("_body")).alias("_bodies"),
    )
    per = per.withColumn("issues", ordered.joined_runs(F.col("_pieces"))).withColumn("full_text", ordered.document_text(F.col("_bodies")))
    report = risk.judged(per, documents, c)
    bare = F.transform("issues", lambda x: F.struct(x["page"].alias("page"), text.preview(x["text"], 100).alias("text"), x["severity"].alias("severity"), F.array_join(x["reasons"], ", ").alias("reasons")))
    kind = "array<struct<page:int,text:string,severity:string,reasons:string>>"
    out = report.select(
        "doc_id", risk.gate_status().alias("status"), F.upper("risk_level").alias("risk_level"), risk.web_score().alias("risk_score"), "total_spans",
        F.col("visible_count").alias("visible_spans"), F.col("suspicious_count").alias("suspicious_spans"), F.col("invisible_count").alias("invisible_spans"), risk.hidden_count().alias("hidden_spans"),
        F.coalesce(bare, F.array()).cast(kind).alias("issues"), F.coalesce("full_text", F.lit("")).alias("full_text"), F.col("prompt_injection_detected").alias("prompt_injection"), "prompt_injection_patterns",
    )
    if errors is not None:
        nothing = F.lit(0)
        failed = errors.select("doc_id", F.lit("ERROR").alias("status"), "error", nothing.alias("risk_score"), nothing.cast("long").alias("total_spans"), F.array().cast(kind).alias("issues"))
        out = out.join(failed.select("doc_id"), "doc_id", "left_anti").unionByName(failed, allowMissingColumns=True)
    if documents is not None and "path" in documents.columns:
        out = out.join(documents.select("doc_id", ingest.file_type(F.col("path")).alias("file_type")), "doc_id", "left")
    return out


def gate_report(spans: DataFrame, documents: DataFrame | None = None, c: Config = DEFAULT) -> DataFrame:
    """A row a document as the gate prints it: status, exit code, score, the first ten pages and three phrases. Parts of pages are summed up
    first; pages and documents then follow from one exchange of their rows."""
    analyzed = span_ops.with_reasons(span_ops.analyzed(spans, c), 1)
    hidden = visibility.is_hidden(F.col("visibility_status"))
    first = F.min(F.when(hidden, F.struct("span_seq", F.substring("text", 1, 51).alias("text"), "reasons")))
    parts = analyzed.groupBy("doc_id", "page_number", ordered.part().alias("_part")).agg(*risk.span_measures(c), first.alias("_first"))
    pages = parts.repartition("doc_id").groupBy("doc_id", "page_number").agg(*risk.merged_measures(), F.min("_first").alias("_first"))
    n_hidden = risk.hidden_count()
    severity = F.when(F.col("invisible_count") > 0, "INVISIBLE").otherwise("LOW CONTRAST")
    page = F.struct("page_number", n_hidden.alias("n_hidden"), severity.alias("severity"), text.preview(F.col("_first.text"), 50).alias("example"), F.array_join("_first.reasons", ", ").alias("why"))
    # only the first pages with hidden text are gathered
    pages = pages.withColumn("_shown", (n_hidden > 0).cast("int")).withColumn("_earlier", ordered.before("_shown", order="page_number"))
    pages = pages.withColumn("_page", F.when((n_hidden > 0) & (F.col("_earlier") < 10), page))
    per = pages.groupBy("doc_id").agg(*risk.document_measures(), F.array_sort(F.collect_list("_page")).alias("pages"), F.greatest(F.sum("_shown") - 10, F.lit(0)).alias("more_pages"))
    out = risk.judged(per, documents, c)
    empty = F.array().cast(per.schema["pages"].dataType)
    return out.select("doc_id", risk.gate_status().alias("status"), risk.gate_exit_code().alias("exit_code"), risk.gate_score().alias("risk_score"), risk.hidden_count().alias("hidden_count"), "total_spans", F.coalesce("pages", empty).alias("pages"), F.coalesce("more_pages", F.lit(0)).alias("more_pages"), F.size("prompt_injection_patterns").alias("n_patterns"), F.slice("prompt_injection_patterns", 1, 3).alias("patterns"))


def detail_report(spans: DataFrame, documents: DataFrame | None = None, c: Config = DEFAULT, most: int = 10) -> DataFrame:
    """A row a document as the detailed view prints it: counts, characters, known sizes and colours, the first hidden spans,
    phrases, samples, level, colour and recommendations."""
    analyzed = span_ops.analyzed(spans, c)
    hidden = visibility.is_hidden(F.col("visibility_status"))
    size = F.when(F.col("font_size") != 0, text.fixed(F.col("font_size"), 1))
    shown = F.struct("span_seq", F.upper("visibility_status").alias("status"), F.substring("text", 1, 50).alias("text"), F.col("page_number").alias("page"), text.fixed(F.col("contrast_ratio"), 2).alias("contrast"), size.alias("size"), text.color_text(F.col("font_color")).alias("color"), text.color_text(F.col("background_color")).alias("background"))
    first = lambda items: F.slice(F.array_sort(items), 1, most)
    extra = [F.sum(F.length("text")).alias("total_chars"), F.count("font_size").alias("with_size"), F.count("font_color").alias("with_color")]
    parts = analyzed.groupBy("doc_id", ordered.part().alias("_part")).agg(*risk.span_measures(c), *extra, first(F.collect_list(F.when(hidden, shown))).alias("_shown"))
    sums = ["total_chars", "with_size", "with_color"]
    parts = risk.few_samples(parts).withColumn("_hidden", risk.hidden_count())
    parts = parts.withColumn("_shown", F.when(ordered.before("_hidden") < most, F.col("_shown")))
    per = parts.groupBy("doc_id").agg(*risk.document_measures(), *[F.sum(k).alias(k) for k in sums], first(F.flatten(F.collect_list("_shown"))).alias("problem_spans"))
    out = risk.judged(per, documents, c).fillna(0, subset=sums)
    patterns = "prompt_injection_patterns"
    return out.select(
        "doc_id", *risk.COUNTS, *sums, F.coalesce("problem_spans", F.array().cast(per.schema["problem_spans"].dataType)).alias("problem_spans"),
        F.greatest(risk.hidden_count() - most, F.lit(0)).alias("more_spans"), "risk_level", risk.risk_color().alias("risk_color"), F.size(patterns).alias("n_patterns"), F.slice(patterns, 1, 5).alias("patterns"),
        F.greatest(F.size(patterns) - 5, F.lit(0)).alias("more_patterns"), risk.previews("invisible_text_sample", risk.SAMPLE, 60).alias("samples"), "recommendations",
    )
