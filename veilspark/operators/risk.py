"""Per-document roll-up: counts, injection, level, scores, recommendations. Parts of documents are summed up first, then documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import injection, visibility
from ..functions.text import preview
from . import ordered, patterns

SAMPLE = 5


def count_of(status: str) -> Column:
    return F.count_if(F.col("visibility_status") == status)


def status_counts(analyzed_spans: DataFrame) -> DataFrame:
    return analyzed_spans.groupBy("doc_id").agg(
        F.count("*").alias("total_spans"),
        count_of("visible").alias("visible_count"),
        count_of("suspicious").alias("suspicious_count"),
        count_of("invisible").alias("invisible_count"),
        count_of("unknown").alias("unknown_count"),
    )


def risk_level(inv: Column, susp: Column, inj: Column, c: Config = DEFAULT) -> Column:
    return (
        F.when(inj & (inv > 0), "critical")
        .when(inv >= 3 * c.invisible_threshold, "high")
        .when(inj, "high")
        .when(inv >= c.invisible_threshold, "medium")
        .when(susp >= 2 * c.suspicious_threshold, "medium")
        .when(susp >= c.suspicious_threshold, "low")
        .otherwise("safe")
    )


def recommendations(level: Column, inv: Column, susp: Column, inj: Column) -> Column:
    """The advice for a level, in order. The sentences are fixed values."""
    some = lambda condition, *lines: [F.when(condition, line if isinstance(line, Column) else F.lit(line)) for line in lines]
    counted = lambda before, n, after: F.concat(F.lit(before), n.cast("string"), F.lit(after))
    critical, high, medium, low, safe = (level == x for x in ("critical", "high", "medium", "low", "safe"))
    lines = [
        *some(critical, "DO NOT process this document with LLMs", "Prompt injection attack detected in invisible text", "Manual security review required", "Consider reporting as malicious document"),
        *some(high & inj, "Block LLM processing - prompt injection detected", "Review detected patterns before proceeding"),
        *some(high & ~inj, "Block LLM processing - excessive invisible text", counted("Found ", inv, " invisible text spans")),
        *some(high, "Manual review strongly recommended"),
        *some(medium & (inv > 0), "Warn user about invisible text before LLM processing", counted("Strip ", inv, " invisible spans from output")),
        *some(medium & (susp > 0), counted("Review ", susp, " suspicious spans for legitimacy")),
        *some(medium, "Consider manual verification"),
        *some(low, "Safe to process with caution", counted("Monitor ", susp, " suspicious spans"), "Likely legitimate low-contrast text"),
        *some(safe, "Safe to process with LLMs", "No suspicious content detected"),
    ]
    return F.filter(F.array(*lines), lambda x: x.isNotNull())


#: The counts that reports carry, and the statuses that they count.
COUNTS = {"total_spans": None, "visible_count": "visible", "suspicious_count": "suspicious", "invisible_count": "invisible", "unknown_count": "unknown"}


def _distinct(lists: str | Column) -> Column:
    """Aggregate: the distinct items of all lists. Equal lists meet first, most of which are empty."""
    return F.array_distinct(F.flatten(F.collect_set(lists)))


def span_measures(c: Config = DEFAULT) -> list[Column]:
    """Aggregates over analysed spans of a part: counts, the phrases found in hidden ones, and the first invisible texts (at most SAMPLE)."""
    hidden = visibility.is_hidden(F.col("visibility_status"))
    searched = visibility.switched(hidden, c.check_hidden_instructions)
    found = F.lit(None).cast("array<string>") if c.check_hidden_instructions is False else F.when(searched, injection.matches(F.col("text")))
    first = F.collect_list(F.when(F.col("visibility_status") == "invisible", F.struct("span_seq", "text")))
    return [
        *[(count_of(status) if status else F.count("*")).alias(k) for k, status in COUNTS.items()],
        _distinct(found).alias("_found"),
        F.slice(F.array_sort(first), 1, SAMPLE).alias("_sample"),
    ]


def merged_measures() -> list[Column]:
    """Aggregates over parts that hold span_measures(), which give the same columns."""
    return [
        *[F.sum(k).alias(k) for k in COUNTS],
        _distinct("_found").alias("_found"),
        F.slice(F.array_sort(F.flatten(F.collect_list("_sample"))), 1, SAMPLE).alias("_sample"),
    ]


def few_samples(parts: DataFrame) -> DataFrame:
    """Parts of documents (_part, in extraction order) dealt by document, with samples only where fewer than SAMPLE texts came before: what a
    document gathers never exceeds two samples."""
    dealt = parts.repartition("doc_id")
    return dealt.withColumn("_sample", F.when(ordered.before("invisible_count") < SAMPLE, F.col("_sample")))


def document_measures() -> list[Column]:
    """Aggregates over parts of documents that hold span_measures()."""
    return [
        *[F.sum(k).alias(k) for k in COUNTS],
        F.array_sort(_distinct("_found")).alias("prompt_injection_patterns"),
        F.transform(F.slice(F.array_sort(F.flatten(F.collect_list("_sample"))), 1, SAMPLE), lambda x: x["text"]).alias("invisible_text_sample"),
    ]


def judged(per: DataFrame, documents: DataFrame | None, c: Config = DEFAULT) -> DataFrame:
    """A row a document with document_measures() completed: documents without spans, level and recommendations."""
    if documents is not None:
        per = documents.select("doc_id", *(k for k in ("settings",) if k in documents.columns)).join(per, "doc_id", "left")
    per = per.fillna(0, subset=list(COUNTS))
    for k in ("prompt_injection_patterns", "invisible_text_sample"):
        per = per.withColumn(k, F.coalesce(k, F.array().cast("array<string>")))
    per = per.withColumn("prompt_injection_detected", F.size("prompt_injection_patterns") > 0)
    inv, susp, inj = F.col("invisible_count"), F.col("suspicious_count"), F.col("prompt_injection_detected")
    per = per.withColumn("risk_level", risk_level(inv, susp, inj, c))
    return per.withColumn("recommendations", recommendations(F.col("risk_level"), inv, susp, inj))


def risk_report(analyzed_spans: DataFrame, documents: DataFrame | None = None, c: Config = DEFAULT, pattern_table: DataFrame | None = None) -> DataFrame:
    """A report a document; documents (doc_id) adds those without any span. Parts are summed up first, so what is kept of a
    long document is a few phrases and texts a part. pattern_table (pattern_id, pattern) stands in for the engine's own patterns."""
    if pattern_table is not None:
        hidden = analyzed_spans.where(visibility.is_hidden(F.col("visibility_status")))
        phrases = patterns.by_document(patterns.matched(hidden, pattern_table)).withColumnRenamed("prompt_injection_patterns", "_phrases")
        parts = analyzed_spans.groupBy("doc_id", ordered.part().alias("_part")).agg(*span_measures(replace(c, check_hidden_instructions=False)))
        per = few_samples(parts).groupBy("doc_id").agg(*document_measures()).join(phrases, "doc_id", "left")
        return judged(per.withColumn("prompt_injection_patterns", F.col("_phrases")).drop("_phrases"), documents, c)
    parts = analyzed_spans.groupBy("doc_id", ordered.part().alias("_part")).agg(*span_measures(c))
    return judged(few_samples(parts).groupBy("doc_id").agg(*document_measures()), documents, c)


# ---- scores and verdicts over a risk report


def hidden_count() -> Column:
    return F.col("invisible_count") + F.col("suspicious_count")


def gate_score() -> Column:
    inv, susp, total = F.col("invisible_count"), F.col("suspicious_count"), F.col("total_spans")
    share = F.when(total > 0, F.floor((inv + susp) / total * F.lit(20.0))).otherwise(0)
    raw = F.when(inv > 0, 50 + F.least(5 * inv, F.lit(30))).otherwise(0) + F.when(susp > 0, 20 + F.least(2 * susp, F.lit(20))).otherwise(0) + F.when(F.col("prompt_injection_detected"), 40).otherwise(0) + share
    return F.least(raw, F.lit(100)).cast("int")


def web_score() -> Column:
    raw = F.least(20 * F.col("invisible_count"), F.lit(60)) + F.least(5 * F.col("suspicious_count"), F.lit(20)) + F.when(F.col("prompt_injection_detected"), 20).otherwise(0)
    return F.least(raw, F.lit(100)).cast("int")


def chosen(value: Column, table: dict[str, object], other: object) -> Column:
    out = F.when(F.lit(False), F.lit(other))
    for key, result in table.items():
        out = out.when(value == key, F.lit(result))
    return out.otherwise(F.lit(other))


# Colours and exit codes by level.
RISK_COLORS = {"safe": "green", "low": "blue", "medium": "yellow", "high": "red", "critical": "red bold"}
EXIT_CODES = {"safe": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
ERROR_EXIT = 5


def risk_color() -> Column:
    return chosen(F.col("risk_level"), RISK_COLORS, "white")


def scan_exit_code() -> Column:
    return chosen(F.col("risk_level"), EXIT_CODES, 0).cast("int")


def clean() -> Column:
    return (hidden_count() == 0) & ~F.col("prompt_injection_detected")


def gate_status() -> Column:
    return F.when(clean(), "SAFE").otherwise("SUSPICIOUS")


def gate_exit_code() -> Column:
    return F.when(clean(), 1).when(hidden_count() > 0, 2).otherwise(3)


def ui_badge() -> Column:
    return F.when(clean(), "SAFE").when(web_score() >= 70, "CRITICAL").otherwise("SUSPICIOUS")


def batch_verdict(exit_code: Column) -> Column:
    return F.when(exit_code == 0, "safe").when(exit_code.isin(1, 2), "review").when(exit_code.isin(3, 4), "block").otherwise("error")


def adaptive_strategy(c: Config = DEFAULT) -> Column:
    level = F.col("risk_level")
    return F.when(level.isin("high", "critical"), "strip").when(level == "medium", "flag").otherwise(c.default_strategy)


def previews(texts: str, most: int, chars: int) -> Column:
    return F.transform(F.slice(texts, 1, most), lambda x: preview(x, chars))


def batch_summary(report: DataFrame) -> DataFrame:
    """How many documents a batch holds by verdict, and the first and last of their ids; batch_lists() names them all."""
    verdict = batch_verdict(scan_exit_code())
    return report.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def batch_lists(report: DataFrame) -> DataFrame:
    """doc_id, verdict, is_safe: the safe documents and those that need review, as rows, since a list has no bound."""
    verdict = batch_verdict(scan_exit_code())
    return report.select("doc_id", verdict.alias("verdict"), (verdict == "safe").alias("is_safe"))
