"""The training-data pipeline: quality, duplicates, near duplicates, mixture, tokens.

Each stage works on all that the stage before kept, written as Parquet and read
again. run() writes between stages to the folder that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import exact, jaccard, mixing, pieces, rules
from barloom.llm.common import documents, remove_folder, shared_folder
from barloom.llm.queries import PIECE_MODEL, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs, rules.trusted(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes more than once has a row for each time."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, vocabulary(PIECE_MODEL))


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("encoded", encoded)]

#: The mixture's hashes and the library's token ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
