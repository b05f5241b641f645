"""Exact de-duplication by deterministic block naming (native).

The white-space-free UTF-8 text is cut into blocks of a fixed number of bytes.
Sorting brings equal blocks together and gives each run one integer name: the
smallest slot number in it. Adjacent names are paired and the pairs named alike,
until each document has one name. Names are given by comparison, never by
hashing, so two documents share (number of blocks, name) exactly if their
normalised texts are equal.

Scale. The text is shuffled twice at most: by (block, salt), so that a block
that holds a third of all rows is spread over `salts` tasks, and then one
representative of each (block, salt) by block. All later levels move integers
only; their names are aggregated before the shuffle and joined back, which AQE
splits where a name is hot. The number of levels is log2 of the blocks in the
longest text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import body_of, cut, one_of_each, text_of, without_white

BLOCK_BYTES = 4096
SALTS = 16


def _named_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, salts: int) -> DataFrame:
    raw = F.col("raw")
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(raw) / block_bytes).cast("int") - 1)
    heads = (
        docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("doc_id"), F.char_length(text_of(text_col)).cast("long").alias("n_points"), body_of(text_col).alias("body"), F.encode(without_white(text_of(text_col)), "utf-8").alias("raw"))
        .select("row_key", "doc_id", "n_points", "body", F.sha2(raw, 256).alias("sha"), (last + 1).alias("n_blocks"), F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block_bytes + 1, block_bytes)).alias("blocks"))
    )
    first = F.col("pos") == 0
    blocks = heads.select("row_key", "n_blocks", "doc_id", "n_points", "body", "sha", F.posexplode("blocks").alias("pos", "block")).select(
        "row_key", "n_blocks", "pos", "block", F.monotonically_increasing_id().alias("slot"), F.pmod(F.xxhash64("row_key"), F.lit(salts)).alias("salt"), *[F.when(first, F.col(c)).alias(c) for c in ("doc_id", "n_points", "body", "sha")]
    )
    # equal blocks of a salt lie together after the sort; the run is named by its smallest slot
    salted = blocks.withColumn("run", F.min("slot").over(Window.partitionBy("block", "salt")))
    # the hash is always at least this; it names every column, so that both uses of the shuffle read the same columns and share it
    whole = F.xxhash64(*[c for c in salted.columns if c != "block"]) >= F.lit(-(2**63))
    runs = salted.where((F.col("run") == F.col("slot")) & whole).select("block", "run").withColumn("name", F.min("run").over(Window.partitionBy("block"))).select("run", "name")
    return salted.drop("block", "salt").join(runs, "run").drop("run")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, n_points, body, sha, n_blocks, name. Equal texts have equal (n_blocks, name)."""
    blocks = cut(_named_blocks(docs, id_col, text_col, block_bytes, salts))
    heads = blocks.where("pos = 0").select("row_key", "doc_id", "n_points", "body", "sha")
    left, finished = blocks.select("row_key", "n_blocks", F.col("n_blocks").alias("width"), "pos", "slot", "name"), []
    while True:
        finished.append(left.where("width = 1").select("row_key", "n_blocks", "name"))
        left = left.where("width > 1")
        if left.isEmpty():
            break
        pairs = left.groupBy("row_key", "n_blocks", "width", F.expr("pos div 2").alias("pair")).agg(F.min("slot").alias("slot"), F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        names = pairs.groupBy("a", "b").agg(F.min("slot").alias("name"))
        left = cut(pairs.join(names, ["a", "b"]).select("row_key", "n_blocks", F.expr("cast((width + 1) div 2 as int)").alias("width"), F.col("pair").alias("pos"), "slot", "name"))
    return heads.join(reduce(DataFrame.unionAll, finished), "row_key").drop("row_key")


def _judged(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, salts: int) -> DataFrame:
    """The identities with group_size and best, the row of the group that stays."""
    rows = identities(docs, id_col, text_col, block_bytes, salts)
    place = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").alias("keep_id"), F.col("body").alias("keep_body"))
    groups = rows.groupBy("n_blocks", "name").agg(F.count("*").alias("group_size"), F.min(place).alias("best"))
    return rows.join(groups, ["n_blocks", "name"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_points: one row per input row.

    Texts are equal when identical after deleting white space. Of equal texts the
    one with the most code points stays, then the smallest doc_id (null counts as
    smallest). A null text is the empty text, and all empty texts are equal. Rows
    that repeat a doc_id with an equal text of the same length are one document:
    they share keep_id and kept, and each counts in group_size. No rows in, no rows out.
    """
    return _judged(docs, id_col, text_col, block_bytes, salts).select(
        "doc_id", F.col("best.keep_id").alias("keep_id"), "group_size", (F.col("doc_id").eqNullSafe(F.col("best.keep_id")) & (-F.col("n_points") == F.col("best.n"))).alias("kept"), F.col("sha").alias("text_sha256"), "n_points"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, salts: int = SALTS) -> DataFrame:
    """One row of docs for each group of equal texts, with all its columns.

    The row that stays is that of exact_duplicates; of rows that repeat its doc_id
    and text, one. Null ids, null and empty texts and columns of any name are
    handled as there. No rows in, no rows out.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("best.keep_id")) & (F.col("body") == F.col("best.keep_body"))
    judged = cut(_judged(docs, id_col, text_col, block_bytes, salts).select("doc_id", "body", stays.alias("stays")))
    return one_of_each(docs, judged, id_col, text_col)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) = doc_id AS kept,
       sha256(norm) AS text_sha256,
       CAST(length(t) AS BIGINT) AS n_points
FROM d
"""
