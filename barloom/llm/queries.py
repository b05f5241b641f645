"""The queries op1_ ... op10_ with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import exact, jaccard, licences, mixing, perplexity, pieces, private, rules, suffixes, token_counts
from barloom.llm.common import documents

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir), vocabulary(PIECE_MODEL))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary(WORD_MODEL))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.quality(documents(spark, sf_dir), rules.trusted(labels))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return perplexity.classify(documents(spark, sf_dir), rules.trusted(labels))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.sanitise(documents(spark, sf_dir))


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths: source and language stand for the directories."""
    return licences.scan(documents(spark, sf_dir), path=F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("body")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": sentencepiece,
        "op2_jaccard_join": jaccard_pairs,
        "op3_exact_dedup": exact_dedup,
        "op4_token_counts": tokens,
        "op5_quality_rules": quality_rules,
        "op6_quality_classifier": quality_classifier,
        "op7_personal_data": personal_data,
        "op8_licence_scan": licence_scan,
        "op9_suffix_dedup": repeated_strings,
        "op10_mix_sources": mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact.SQL}
