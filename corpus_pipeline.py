"""Corpus pipeline: filter by quality, drop near copies, mix sources and tokenize.

``STAGES`` are applied in order; each reads what its predecessor kept, written as Parquet and read again. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import bpe, mixing, near_copies, quality_classifier, quality_rules
from stockloom.llm.registry import table
from stockloom.operators.scans import materialize

#: The stages hold trained models and iterations, which SQL does not express.
ORACLE_SQL: str | None = None


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    labels = table(spark, sf_dir, "labels").filter(~quality_classifier.held_out())
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, labels))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and have enough content lines."""
    field = quality_rules.train(docs, table(spark, sf_dir, "labels").filter(~quality_classifier.held_out()))
    return quality_rules.filter_documents(docs, field)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return near_copies.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have evened-out shares."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe_encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; the result of each but the last is stored for the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        docs = result if at == len(STAGES) - 1 else materialize(result)
    return docs
