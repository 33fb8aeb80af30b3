"""A training-data pipeline over `documents`: five stages, each one of gridmill.llm's operators.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. ORACLE_SQL is None: a trained network and fingerprints are beyond SQL; the tests hold the
stages against plain versions instead.

Every stage takes null and empty texts as texts without words, keeps rows repeated in full together
(near-dedup leaves one of them), gives an empty table for an empty one, takes texts whole, however long,
and leaves columns as they are, whatever their names; doc_id must be a whole number or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmill.llm import decontaminate, near_copies, packing, pii, quality_cnn
from gridmill.llm.common import fresh_path
from gridmill.llm.queries import op1_columns, table, vocabulary

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; at a score of 0.5 a document stays. Without labels of both kinds all stay or go together."""
    return quality_cnn.keep(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies with a similarity of 0.8 or more (five-word shingles) stays: the one with the least id, null ids last."""
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, by 0.6 of its own alignment score or more, go; null texts stay."""
    return decontaminate.drop(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind, overlapping spans by the first one's; null texts stay null. n_chars follows."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in windows, with the columns of op1's query and the ids; a null text is its end id alone."""
    return op1_columns(packing.pack(docs, vocabulary("byte_bpe_50k.json")), "ids")


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
