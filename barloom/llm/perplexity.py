r"""Quality classifier: an interpolated modified Kneser-Ney model of characters.

An order-5 model is trained on all trusted text (rows labelled good and not toxic).
Every document gets its perplexity, and each language its own limit from quantiles of
the log perplexities of its documents: median + SPREAD * (upper - median), with
upper the UPPER quantile. The limit thus follows the spread of ordinary documents
and does not cut a fixed share of them.

A character is one unit of 12 bits, its code point; those of WIDE and above are two
units, so that every character keeps its identity and five units fit a long. NUL
stands before the start of a text. The perplexity is that of a character.

Scale. Documents are packed into blocks, shuffled once, and read in two passes. A
block sends its distinct n-grams by shard (hash of the first three characters), as
sorted differences; counts are summed in the shards. All model tables are joins and
aggregations over distinct n-grams, which grow far slower than the text: highest
order by count, lower orders by the number of distinct left neighbours. The
log-probabilities go back to the blocks in the order of the n-grams sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, text_of
from barloom.llm.pieces import slices
from barloom.llm.suffixes import _expand, _squeeze

ORDER, BITS = 5, 12
#: The first code point of two units: WIDE + the upper bits, then the lower twelve.
WIDE = 4096 - (0x110000 >> BITS)
BLOCK_CHARS = 4_000_000
UPPER, SPREAD = 0.8, 6.0
#: A text of n characters is held to the limit plus SHORT / sqrt(n): its mean varies more.
SHORT = 6.0
BROADCAST_IDS = 1_000_000


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at each unit, and the number of units of each text."""
    chars_of = np.array([len(t) + ORDER - 1 for t in texts], np.int64)
    lead = "\0" * (ORDER - 1)
    chars = np.frombuffer("".join(lead + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = chars >= WIDE
    at = np.cumsum(1 + wide) - 1
    units = np.empty(len(chars) + int(wide.sum()), np.int64)
    units[at] = np.where(wide, chars & np.uint32((1 << BITS) - 1), chars)
    units[at[wide] - 1] = WIDE + (chars[wide] >> np.uint32(BITS))
    chars, ends = units, np.concatenate([at, np.array([-1])])[np.cumsum(chars_of) - 1] + 1
    sizes = np.diff(ends, prepend=0) - ORDER + 1
    full = np.zeros(len(chars), np.int64)
    for k in range(ORDER):
        full[k:] |= chars[: len(chars) - k] << (BITS * k)
    own = np.ones(len(chars), bool)
    for k in range(ORDER - 1):
        own[(ends - sizes - ORDER + 1 + k)[sizes >= 0]] = False
    return full[own], sizes


def _shards(grams: np.ndarray, shards: int) -> np.ndarray:
    return (((grams >> (BITS * 2)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams in order, and how often each is there. Values alone sort much faster than their places."""
    ordered = np.sort(grams)
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))  # n-grams are not negative
    return ordered[starts], np.diff(starts, append=len(ordered))


def _where(distinct: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The place of each n-gram in `distinct`: a table by hash, and a search for those whose slot another one took."""
    bits = max(8, 3 + int(len(distinct)).bit_length())
    slot = lambda g: ((g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
    table = np.zeros(1 << bits, np.int64)
    table[slot(distinct)] = np.arange(len(distinct))
    at = table[slot(grams)]
    other = np.flatnonzero(distinct[at] != grams) if len(grams) else []
    at[other] = np.searchsorted(distinct, grams[other])
    return at


class _Grams:
    """Distinct n-grams of a block, in the order of (shard, n-gram)."""

    def __init__(self, texts: list[str], shards: int):
        self.all, self.sizes = codes(texts)
        self._sorted, _ = _distinct(self.all)
        home = _shards(self._sorted, shards)
        order = np.argsort(home, kind="stable")
        self._place = np.empty(len(order), np.int64)
        self._place[order] = np.arange(len(order))
        self.grams = self._sorted[order]
        self.edges = np.searchsorted(home[order], np.arange(shards + 1))

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each distinct n-gram is among the chosen ones."""
        some, n = _distinct(self.all[chosen])
        out = np.zeros(len(self.grams), np.uint32)
        out[self._place[np.searchsorted(self._sorted, some)]] = n
        return out

    def spread(self, values: np.ndarray) -> np.ndarray:
        """A value of each distinct n-gram, for every n-gram of the block."""
        return values[self._place][_where(self._sorted, self.all)]


def _texts(payload: bytes) -> list[str]:
    data, sizes = _expand(payload)
    ends = np.cumsum(sizes.view(np.int64)).tolist()
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends[:-1]], ends)]


def _unsorted(diffs: np.ndarray) -> np.ndarray:
    return np.cumsum(diffs.view(np.int64))


def _prob(seen: DataFrame, order: int, lower: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Discounted part of each seen n-gram and back-off weight of each context of one order.

    seen: g, c. Returns (g, part) and (ctx, gamma). Discounts are those of modified
    Kneser-Ney for counts of 1, 2 and 3 or more.
    """
    tally = seen.agg(*[F.coalesce(F.sum((F.col("c") == k).cast("double")), F.lit(0.0)).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))
    bound = lambda d, most: F.coalesce(F.greatest(F.lit(0.1), F.least(d, F.lit(most))), F.lit(most / 2))
    some = tally.select(F.array(bound(1 - 2 * y * F.col("n2") / F.nullif(F.col("n1"), F.lit(0.0)), 0.95), bound(2 - 3 * y * F.col("n3") / F.nullif(F.col("n2"), F.lit(0.0)), 1.95), bound(3 - 4 * y * F.col("n4") / F.nullif(F.col("n3"), F.lit(0.0)), 2.95)).alias("d")).first()
    d1, d2, d3 = some["d"] if some and some["d"] else (0.5, 1.0, 1.5)  # three numbers
    off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
    keyed = seen.withColumn("ctx", F.shiftright("g", BITS)).withColumn("off", off)
    totals = keyed.groupBy("ctx").agg(F.sum("c").cast("double").alias("total"), F.sum("off").alias("off"))
    return keyed.join(totals.select("ctx", "total"), "ctx").select("g", ((F.col("c") - F.col("off")) / F.col("total")).alias("part")), totals.select("ctx", (F.col("off") / F.col("total")).alias("gamma"))


def log_probabilities(grams: DataFrame) -> DataFrame:
    """g, logp of every row (g, c): n-grams of highest order and their counts in trusted text, 0 for others."""
    seen = {ORDER: grams.where("c > 0").select("g", "c")}
    asked = {ORDER: grams.select("g")}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("g").bitwiseAND(F.lit((1 << (BITS * k)) - 1)).alias("g")
        seen[k] = cut(seen[k + 1].select(suffix).groupBy("g").agg(F.count("*").alias("c")))
        asked[k] = asked[k + 1].select(suffix).distinct()
    floor = F.lit(1.0 / (1 << BITS))
    below = None
    for k in range(1, ORDER + 1):
        part, gamma = _prob(seen[k], k, below)
        joined = asked[k].join(part, "g", "left").withColumn("ctx", F.shiftright("g", BITS)).join(gamma, "ctx", "left")
        if below is None:
            lower = joined.withColumn("p0", floor)
        else:
            lower = joined.withColumn("low", F.col("g").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))).join(below.select(F.col("g").alias("low"), F.col("p").alias("p0")), "low")
        below = cut(lower.select("g", (F.coalesce("part", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p0")).alias("p")))
    return below.select("g", F.log("p").cast("float").alias("logp"))


def perplexities(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, n_chars, perplexity: one row per input row. trusted_ids: one column, _trusted."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    few = trusted_ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = trusted_ids.distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text")).join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_trusted"), "left").withColumn("good", F.col("_trusted").isNotNull()).drop("_trusted")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in slices(batch, "text", BLOCK_CHARS):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([_squeeze(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64))], pa.binary()), *[pa.array([part.column(c).to_pylist()], pa.list_(part.schema.field(c).type)) for c in ("doc_id", "lang", "good")]],
                    names=["block", "payload", "ids", "langs", "goods"],
                )
                block += 1

    blocks = rows.mapInArrow(pack, f"block long, payload binary, ids array<{kind}>, langs array<string>, goods array<boolean>").repartition(shards, "block")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grams = _Grams(_texts(batch.column("payload")[k].as_py()), shards)
                good = np.repeat(np.array(batch.column("goods")[k].as_py(), bool), grams.sizes)
                counts = grams.counts(good)
                e = grams.edges
                out = [(s, _squeeze(np.diff(grams.grams[e[s] : e[s + 1]], prepend=0), counts[e[s] : e[s + 1]])) for s in range(shards) if e[s] < e[s + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("block")[k].as_py()] * len(out), pa.int64()), pa.array([s for s, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["block", "shard", "payload"])

    def total(table: pa.Table) -> pa.Table:
        parts = [_expand(x) for x in table.column("payload").to_pylist()]
        grams, back = np.unique(np.concatenate([_unsorted(x[0]) for x in parts]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([x[1].view(np.uint32) for x in parts])).astype(np.int64)
        return pa.table({"shard": pa.array(np.full(len(grams), table.column("shard")[0].as_py(), np.int32)), "g": grams, "c": counts})

    sent = blocks.mapInArrow(send, "block long, shard int, payload binary")
    grams = cut(sent.groupBy("shard").applyInArrow(total, "shard int, g long, c long"))
    told = log_probabilities(grams.select("g", "c"))
    by_shard = told.join(grams.select("g", "shard"), "g")

    def back(asked: pa.Table, known: pa.Table) -> pa.Table:
        g, p = known.column("g").to_numpy(), known.column("logp").to_numpy()
        order = np.argsort(g)
        g, p = g[order], p[order]
        out = [_squeeze(p[np.searchsorted(g, _unsorted(_expand(x)[0]))]) for x in asked.column("payload").to_pylist()]
        return pa.table([asked.column("block"), asked.column("shard"), pa.array(out, pa.binary())], names=["block", "shard", "logs"])

    answers = sent.groupBy("shard").cogroup(by_shard.groupBy("shard")).applyInArrow(back, "block long, shard int, logs binary")

    def score(own: pa.Table, logs: pa.Table) -> pa.Table:
        ids_, langs, sizes, out = [], [], [], []
        if own.num_rows:
            texts = _texts(own.column("payload")[0].as_py())
            grams = _Grams(texts, shards)
            p = np.zeros(len(grams.grams), np.float64)
            for s, x in zip(logs.column("shard").to_pylist(), logs.column("logs").to_pylist()):
                p[grams.edges[s] : grams.edges[s + 1]] = _expand(x)[0].view(np.float32)
            sums = np.bincount(np.repeat(np.arange(len(grams.sizes)), grams.sizes), grams.spread(p), minlength=len(grams.sizes))
            ids_, langs, sizes = own.column("ids")[0].as_py(), own.column("langs")[0].as_py(), [len(t) for t in texts]
            out = [round(math.exp(min(700.0, -s / n)), 6) if n else None for s, n in zip(sums.tolist(), sizes)]
        return pa.table([pa.array(ids_, own.schema.field("ids").type.value_type), pa.array(langs, pa.string()), pa.array(sizes, pa.int64()), pa.array(out, pa.float64())], names=["doc_id", "lang", "n_chars", "perplexity"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, lang string, n_chars long, perplexity double")


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", upper: float = UPPER, spread: float = SPREAD, short: float = SHORT) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, limit, kept: one row per input row.

    A null or empty text has no perplexity and is not kept. A null language is a
    language of its own. Without trusted rows every character is equally likely and
    all texts are kept. Repeated rows are judged alike. No rows in, no rows out.
    """
    rows = cut(perplexities(docs, trusted_ids, id_col, text_col, lang_col)).withColumn("log", F.round(F.log("perplexity"), 6))
    # a sketch of fixed size for each language
    limits = rows.groupBy("lang").agg(F.percentile_approx("log", [0.5, upper], 10_000).alias("q")).select(F.col("lang").alias("_lang"), (F.col("q")[0] + spread * (F.col("q")[1] - F.col("q")[0])).alias("limit"))
    judged = rows.join(limits, rows["lang"].eqNullSafe(limits["_lang"]), "left")
    return judged.select("doc_id", "lang", "n_chars", "perplexity", F.exp("limit").alias("limit"), F.coalesce(F.col("log") <= F.col("limit") + short / F.nullif(F.sqrt("n_chars"), F.lit(0.0)), F.lit(False)).alias("kept"))
