"""Settings that differ from document to document: a table of thresholds and switches by tenant, joined to documents and their spans.

The table has a row a tenant and any of the columns of Config; what is null or missing, and a tenant without a row, has the defaults. The
settings become a struct column, and SETTINGS is a Config whose entries are its fields, so that every operator that takes a Config takes
limits from the row in the order that it always has. The table is broadcast while it has FEW tenants at most, and joined by a shuffle beyond.
"""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from . import risk, sanitize, spans as span_ops

FEW = 50_000
#: Settings that concern extraction, which has no tenant yet.
EXTRACTION = ("ocr_enabled", "ocr_dpi", "highlight_mode")
KINDS = {"float": "double", "int": "int", "bool": "boolean", "str": "string"}
NAMES = {f.name: KINDS[str(f.type)] for f in fields(Config) if f.name not in EXTRACTION}


def settings_column() -> Config:
    """A Config of the fields of the column `settings`."""
    return replace(DEFAULT, **{name: F.col("settings")[name] for name in NAMES})


def _filled(table: DataFrame | None, c: Config) -> Column:
    known = set(table.columns) if table is not None else set()
    value = lambda name, kind: F.coalesce(F.col(f"_t.{name}").cast(kind), F.lit(getattr(c, name)).cast(kind)) if name in known else F.lit(getattr(c, name)).cast(kind)
    return F.struct(*[value(name, kind).alias(name) for name, kind in NAMES.items()])


def with_settings(documents: DataFrame, table: DataFrame, tenant: str = "tenant", c: Config = DEFAULT) -> DataFrame:
    """documents (doc_id, tenant) with the column `settings`. A tenant has one row in the table: others with its name are an error."""
    twice = table.groupBy(tenant).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"tenant {twice[0][0]!r} has several rows of settings")
    unknown = set(table.columns) - {tenant} - set(NAMES)
    if unknown:
        raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
    held = table.alias("_t")
    held = F.broadcast(held) if table.limit(FEW + 1).count() <= FEW else held
    joined = documents.alias("_d").join(held, F.col(f"_d.{tenant}") == F.col(f"_t.{tenant}"), "left")
    return joined.select("_d.*", _filled(table, c).alias("settings"))


def analyzed(spans: DataFrame, settled: DataFrame) -> DataFrame:
    """Analysed spans of documents with settings, by their own limits; spans of other documents are left out."""
    return span_ops.analyzed(spans.join(settled.select("doc_id", "settings"), "doc_id"), settings_column())


def risk_report(analyzed_spans: DataFrame, settled: DataFrame) -> DataFrame:
    """A report a document, with the levels of its tenant."""
    return risk.risk_report(analyzed_spans, settled, settings_column())


def sanitize_by_level(analyzed_spans: DataFrame, report: DataFrame) -> DataFrame:
    """Safe texts with the strategy, prefix and switches of each document's tenant."""
    return sanitize.sanitize_by_level(analyzed_spans, report, settings_column())
