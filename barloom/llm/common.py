"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters of the contracts: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without_white(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")  # the ends of the text give empty words


def _shared_base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, but only if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or tempfile.mkdtemp(prefix="barloom-")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the folder in spark.checkpoint.dir and read from there.

    The session's setting rules; a folder of our own is set only where there is none.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows up to which a counted table of keys may be broadcast.
BROADCAST_KEYS = 1_000_000


def small(df: DataFrame, most_rows: int = BROADCAST_KEYS) -> DataFrame:
    """df, marked for broadcast only if counted to have at most so many rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def body_of(text_col: str) -> Column:
    """A hash that tells apart the texts of rows with one id."""
    return F.xxhash64(text_of(text_col), F.octet_length(text_of(text_col)))


def one_of_each(docs: DataFrame, judged: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose (id, body) stays by judged (doc_id, body, stays), each key once, with the columns of docs.

    Columns of docs of any name are safe: they travel inside one struct. Of rows
    that repeat a key, the one with the smallest hash of all its columns stays.
    """
    held = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), body_of(text_col).alias("body"))
    gone = judged.where("NOT stays").select(F.col("doc_id").alias("gone_id"), F.col("body").alias("gone_body")).distinct()
    often = judged.where("stays").groupBy(F.col("doc_id").alias("often_id"), F.col("body").alias("often_body")).count().where("count > 1").drop("count")
    left = held.join(small(gone), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("body") == F.col("gone_body")), "left_anti")
    if often.isEmpty():
        return left.select("row.*")
    often, on = small(often), F.col("id").eqNullSafe(F.col("often_id")) & (F.col("body") == F.col("often_body"))
    ones = left.join(often, on, "left_semi").groupBy("id", "body").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return left.join(often, on, "left_anti").select("row.*").unionAll(ones.select("row.*"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one in spark.checkpoint.dir, which driver and executors share."""
    return f"{_shared_base(spark)}/barloom-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
