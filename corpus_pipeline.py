"""The corpus pipeline: language ID, quality rules, one document of each group of near copies, benchmark
decontamination, packing. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents.

Defined cases. Null, empty and letterless texts are rejected by language ID, texts under ten words by the quality
rules. Rows that repeat a doc_id or differ in it but hold near copies: one row of the group stays. A null doc_id goes
through like any other and is packed under null; null lang and source are a group of their own. Other columns are
passed through to packing, which ignores them. Without labelled rows language ID rejects every document. An empty
table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import decontaminate, language_id, ngram_join, packing, quality_rules
from quantloom.llm.common import staged, table


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep(docs, language_id.fit(docs))


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", _language),
    ("quality_rules", _quality),
    ("ngram_jaccard_join", _near_copies),
    ("benchmark_decontamination", _benchmark),
    ("packing", _packed),
]
#: Language ID and packing have no SQL form; tests/llm/test_models.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
