"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of documents by a seeded hash. A source's target
is met by whole passes over all its blocks plus a prefix of the permuted blocks;
one block at the boundary is filled document by document. Blocks are exact quotas:
the tree splits the vector of block counts per source between the two halves of
the shards by a multivariate hypergeometric draw, and so on down to single shards.
Each shard then draws its own disjoint run of the permuted blocks and orders its
documents by a seeded hash.

Scale. Documents are reduced to (source, block, size) before any shuffle; text is
read only to count words. Prefix sums run over blocks (documents / BLOCK_DOCS rows)
and over the documents of at most one boundary block per source, never over all
documents of a source, so a source with a third of all rows is no hot task. The
tree sees one row per source.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import cut, small, text_of, words_of

BLOCK_DOCS = 4096
SHARDS = 16
SEED = 20240501
#: Rows up to which the tables of sources and of blocks are broadcast.
MOST_SOURCES, MOST_BLOCKS = 100_000, 500_000
#: A shard is dealt in 2 ** RUN_BITS runs of order keys.
RUN_BITS = 8


def _source_key(source: str) -> Column:
    """Sorts as the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))


def _mix_hash(seed: int, *cols) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def targets(per_source: DataFrame, most: float = 3.0) -> DataFrame:
    """Adds target to rows (src, source_size): weights 1, 2, 3, ... by order of src, no target above `most` times the size.

    With caps c = most * size the answer is min(c, level * weight), where level
    spends the total. The capped sources are those of the smallest c / weight, so
    prefix sums in that order give the level at once.
    """
    ranked = per_source.withColumn("weight", ((F.row_number().over(Window.orderBy("src")) - 1) % 3 + 1).cast("double")).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    # the level is that of the first source in this order that stays under its cap
    tried = ranked.withColumn("level", level)
    held = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "src", "level"))).over(Window.partitionBy())
    return tried.withColumn("held", held["level"]).select("src", "source_size", F.least(F.col("cap"), F.coalesce(F.col("held") * F.col("weight"), F.col("cap"))).alias("target"))


def split_quotas(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """counts: blocks of each source. Returns (shards, sources): exact block quotas, rows and columns both add up."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    take = int(counts.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(counts, take) if len(counts) else counts
    return np.concatenate([split_quotas(drawn, left, rng), split_quotas(counts - drawn, shards - left, rng)])


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.col(id_col).alias("doc_id"), _source_key(source_col).alias("src"), F.size(words_of(text_of(text_col))).cast("long").alias("size"), F.xxhash64(id_col, text_col).alias("body"))


def _drawn(rows: DataFrame, shards: int, block_docs: int, seed: int, most: float) -> Callable[[DataFrame], DataFrame]:
    """The draw from narrow rows (doc_id, src, size, body), as a function that adds its columns to any such rows."""
    sources = targets(rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).select("src", "source_size"), most)
    counted = rows.groupBy("src").agg(F.count("*").alias("n_docs"))
    plan = (
        sources.join(counted, "src")
        .withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("n_blocks", F.ceil(F.col("n_docs") / block_docs))
    )
    plan = small(cut(plan), MOST_SOURCES)

    def placing(some: DataFrame) -> DataFrame:
        return some.join(plan, "src").withColumn("block", F.pmod(_mix_hash(seed, "doc_id", "body"), F.col("n_blocks")))

    placed = placing(rows)
    permuted = Window.partitionBy("src").orderBy(_mix_hash(seed + 1, "src", "block"), "block")
    blocks = (
        placed.groupBy("src", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
        .withColumn("rank", F.row_number().over(permuted) - 1)
        .withColumn("before", F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("blocks_all", F.count("*").over(Window.partitionBy("src")))
        .withColumn("part", F.when(F.col("before") + F.col("words") <= F.col("rest"), "all").when(F.col("before") < F.col("rest"), "edge").otherwise("none"))
    )
    units = blocks.groupBy("src").agg((F.first("passes") * F.first("blocks_all") + F.sum(F.when(F.col("part") != "none", 1).otherwise(0))).cast("long").alias("units"))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("src")
        ends = split_quotas(pdf["units"].to_numpy(np.int64), shards, np.random.default_rng(seed)).cumsum(axis=0)
        return pd.DataFrame({"src": pdf["src"], "ends": [x.tolist() for x in ends.T]})

    quotas = units.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(tree, "src string, ends array<long>")
    number = lambda unit: F.size(F.filter("ends", lambda e: e <= unit))
    drawn = blocks.join(quotas, "src").select(
        "src", "block", "passes", "part", (F.col("rest") - F.col("before")).alias("room"),
        F.transform(F.sequence(F.lit(0), F.col("passes")), lambda e: number(e * F.col("blocks_all") + F.col("rank"))).alias("unit_shards"),
    )
    # the documents of boundary blocks, in permuted order: each is taken if it still fits
    place = F.struct(_mix_hash(seed + 2, "doc_id", "body").alias("h"), "doc_id", "body", "size")
    edge = (
        placed.select("src", "block", "doc_id", "body", "size").join(drawn.where("part = 'edge'").select("src", "block", "room"), ["src", "block"])
        .groupBy("src", "block").agg(F.first("room").alias("room"), F.sort_array(F.collect_list(place)).alias("each"))
        .select("src", "block", F.aggregate("each", F.struct(F.col("room").alias("room"), F.expr("cast(array() as array<bigint>)").alias("took")),
                                             lambda a, x: F.when(x["size"].cast("double") <= a["room"], F.struct((a["room"] - x["size"]).alias("room"), F.concat(a["took"], F.array(x["h"])).alias("took"))).otherwise(a))["took"].alias("took"))
    )
    # a row for each block_docs documents; no document's own row is in it but those of boundary blocks
    table = small(cut(drawn.join(edge, ["src", "block"], "left").drop("room", "passes")), MOST_BLOCKS)
    extra = F.when(F.col("part") == "all", 1).when(F.col("part") == "edge", F.array_contains("took", _mix_hash(seed + 2, "doc_id", "body")).cast("int")).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("passes") + F.coalesce(extra, F.lit(0))).otherwise(0).cast("int")
    own = F.slice("unit_shards", 1, F.col("copies"))

    def apply(some: DataFrame) -> DataFrame:
        told = placing(some).join(table, ["src", "block"]).withColumn("copies", copies).withColumn("shards", own)
        return told.withColumn("order_keys", F.transform("shards", lambda s, i: _mix_hash(seed + 3, "doc_id", "body", s, i)))

    return apply


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, block_docs: int = BLOCK_DOCS, seed: int = SEED, most: float = 3.0) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies, shards, order_keys.

    size counts the words of the text (null: 0). copies is how often the mix takes
    the document, at most `most`; taken = size * copies. shards and order_keys have
    one entry per copy: the output shard and the place of the copy inside it.
    Documents without words are in no shard. Rows that repeat a doc_id are mixed
    row by row; equal rows lie in one block and may be taken differently only by
    their order there. No rows in, no rows out. The same rows and seed give
    the same mix. The words taken of a source stay under its target by less than its
    longest document.
    """
    # texts are read once: the narrow rows are used several times
    rows = cut(_narrow(docs, id_col, text_col, source_col))
    told = _drawn(rows, shards, block_docs, seed, most)(rows)
    return told.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards", "order_keys", "body")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, block_docs: int = BLOCK_DOCS, seed: int = SEED, most: float = 3.0) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with its columns, by shard and in each shard by order key.

    A shard is dealt in runs of order keys, so that it need not fit one task; within
    a partition rows lie by (shard, key). Columns may have any names. Texts are
    shuffled once. Rows without words are not taken. No rows in, no rows out.
    """
    apply = _drawn(cut(_narrow(docs, id_col, text_col, source_col)), shards, block_docs, seed, most)
    told = apply(_narrow(docs, id_col, text_col, source_col, F.struct("*").alias("row"))).where("copies > 0")
    each = told.select("row", F.explode(F.arrays_zip("shards", "order_keys")).alias("at")).select("row", F.col("at.shards").alias("shard"), F.col("at.order_keys").alias("key"))
    runs = F.shiftright("key", 64 - RUN_BITS)
    return each.repartition(F.col("shard"), runs).sortWithinPartitions("shard", "key").select("row.*")
