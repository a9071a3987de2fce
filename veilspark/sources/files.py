"""Files of any supported kind to one spans frame, with a row of its own for every file that can't be read.

A PDF file with little native text whose pages are mostly pictures needs OCR. Its spans come from a table of OCR tokens if one is given
and has the file; else the file is an error, never a document without hidden text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from . import docx, ingest, ocr, pdf
from .extraction import Columns, Info, extract

NEEDS_OCR = "the pages are pictures: no text can be read without OCR"


def read_any(content: bytes, highlight_mode: str = "white") -> tuple[list[tuple], Info]:
    """Spans of a PDF or DOCX file, told apart by its first bytes."""
    return pdf.read_file(content) if is_pdf(content[:1024]) else docx.read_file(content, highlight_mode)


def read_columns(content: bytes, highlight_mode: str = "white") -> tuple[list[tuple] | Columns, Info]:
    """read_any(), with the words of a PDF file by columns."""
    return pdf.read_columns(content) if is_pdf(content[:1024]) else docx.read_file(content, highlight_mode)


def is_pdf(head: bytes) -> bool:
    """Whether a file that opens with these bytes is a PDF file. An archive must show a version too, as its packed bytes may happen to be %PDF."""
    return re.search(rb"%PDF-[0-9]" if head.startswith(b"PK\x03\x04") else rb"%PDF", head) is not None


def choice_of(c: Config = DEFAULT) -> Column:
    """'native', 'ocr' or, without OCR, 'unread' for a file that shows pictures and no text at all."""
    scanned = (F.col("page_area") > 0) & (F.col("image_area") > F.lit(ocr.SCANNED_SHARE) * F.col("page_area"))
    choice = ocr.extraction_choice(F.col("native_chars"), scanned, c)
    return F.when((choice == "native") & (F.col("native_chars") == 0) & (F.col("image_area") > 0), "unread").otherwise(choice)


def extracted(files: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Rows as of extract() for files (doc_id, content, error), with the choice of their text; files that were rejected keep their error."""
    mode = c.highlight_mode
    got = extract(files.where("error IS NULL"), lambda content: read_columns(content, mode)).withColumn("choice", choice_of(c))
    rejected = files.where("error IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "error")
    return got.unionByName(rejected, allowMissingColumns=True)


def spans_and_errors(got: DataFrame, tokens: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans, errors) of extracted(): errors has doc_id and error. tokens: OCR tokens (schema.OCR_TOKENS, and colours if known)."""
    about = ["error", "native_chars", "page_area", "image_area", "choice"]
    native = got.where("span_seq IS NOT NULL AND choice = 'native'").drop(*about)
    failed = got.where("error IS NOT NULL").select("doc_id", "error")
    unread = got.where("error IS NULL AND choice <> 'native'").select("doc_id", "choice").distinct()
    if tokens is None:
        return native, failed.union(unread.select("doc_id", F.lit(NEEDS_OCR)))
    asked = unread.where("choice = 'ocr'")
    words = ocr.token_spans(tokens.join(asked.select("doc_id"), "doc_id", "left_semi"))
    without = unread.join(tokens.select("doc_id").distinct(), "doc_id", "left_anti").union(unread.where("choice = 'unread'")).distinct()
    return native.unionByName(words), failed.union(without.select("doc_id", F.lit(NEEDS_OCR)))


def spans_of_files(files: DataFrame, c: Config = DEFAULT, tokens: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans, errors) of files (doc_id, path, content, error): errors has doc_id, path and error."""
    spans, errors = spans_and_errors(extracted(files, c), tokens)
    return spans, errors.join(files.select("doc_id", "path"), "doc_id").select("doc_id", "path", "error")


def outcomes(files: DataFrame, c: Config = DEFAULT, tokens: DataFrame | None = None) -> DataFrame:
    """doc_id, n_spans, error: how many rows spans_of_files() has of each file, or why there are none.

    Files are read once, and spans and tokens are counted where they are, so that what moves is a row a file and task."""
    by_file = extracted(files, c).groupBy("doc_id", "error", "choice").agg(F.count("span_seq").alias("n_native"))
    given = F.lit(None).cast("long")
    if tokens is not None:
        counted = tokens.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count_if(ocr.trusted()).alias("n_tokens"))
        by_file, given = by_file.join(counted, "doc_id", "left"), F.when(F.col("choice") == "ocr", F.col("n_tokens"))
    native = F.when(F.col("error").isNotNull() | (F.col("choice") == "native"), F.col("n_native"))
    found = F.coalesce(native, given)
    return by_file.select("doc_id", F.coalesce(found, F.lit(0)).alias("n_spans"), F.when(found.isNull(), NEEDS_OCR).otherwise(F.col("error")).alias("error"))


def load(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files under paths with a doc_id made from the path."""
    return ingest.load_files(spark, paths).withColumn("doc_id", F.xxhash64("path"))
