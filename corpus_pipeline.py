"""From raw documents to a deduplicated, mixed and tokenized corpus, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the
shared folder and reads it again as the next stage's docs. All stages but the last return the columns of docs.

Defined cases: a null text passes like an empty one, and of all texts without words near-dedup leaves one; rows with one doc_id are decided on
one by one, and of rows that are equal in all columns near-dedup leaves one; ties go to the smallest doc_id, null last; the mix takes a row up to
twice, and then it is there twice; very long texts pass whole, in one task each; further columns of documents are kept up to the last stage,
whatever their names; without labels all documents are accepted; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import byte_bpe, line_dedup, mixing, quality, simhash
from veilspark.llm.common import drop_written, written

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled ones, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.good_docs(docs, quality.fit(docs, labels))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has."""
    return line_dedup.without_repeats(docs)


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digest of the decoded text."""
    return byte_bpe.tokens(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", unique_lines),
    ("simhash near-dedup", unique_texts),
    ("source mixing", source_mix),
    ("byte-level bpe", token_ids),
]

#: A trained network and random rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = written(stage(spark, docs, sf_dir), f"stage-{k}-{name.replace(' ', '-')}")
        drop_written(docs)
        docs = out
    return docs
