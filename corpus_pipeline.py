"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of
``documents``. ``run`` writes each result as Parquet in the shared folder and reads it back for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ringloom.llm import mixing, packing, pii, quality, simhash
from ringloom.llm._common import saved


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; tags stand for personal data, and n_chars follows."""
    return pii.redacted(docs)


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its token ids and its place in a sequence."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", one_of_each),
    ("PII", without_personal_data),
    ("mixing to target weights", mixed_to_targets),
    ("best-fit packing", packed_sequences),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage{i + 1}")
    return docs
