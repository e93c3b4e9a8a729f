"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns the columns of
documents, but for the last, which returns the packed pieces. Stages are joined by Parquet tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontaminate, packing, pii, quality_rules, simhash
from foliospark.scratch import stage
from foliospark.shipping import shipped
from foliospark.sources import table


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no quality rule rejects."""
    return quality_rules.keep(docs)


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


@shipped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@shipped
def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced in their texts."""
    return pii.redact(docs)


@shipped
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 2048 ids."""
    return packing.pack(packing.documents_as_examples(docs))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", private_data),
    ("packing", pack),
]

#: Fingerprints, embeddings and token ids are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
