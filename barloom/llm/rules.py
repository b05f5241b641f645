r"""Quality rules: counts, base limits and a hashed n-gram log-likelihood ratio (native).

Words and adjacent word pairs are hashed into a fixed number of buckets. Two
multinomials are counted over them: one over the whole raw corpus, add-one smoothed,
and one over the trusted target (the rows labelled good and not toxic), smoothed by
PRIOR n-grams of the raw distribution, so that a small target moves little. A document
scores the mean of log(target / raw) over its n-grams, so the score does not grow
with length, and every document is held against one fixed threshold.

Scale. The n-grams are aggregated before the shuffle into at most `buckets` rows a
task. The model is one array of `buckets` doubles, read through a scalar subquery:
its size is fixed by the parameter. The trusted ids are broadcast only if counted
to be at most BROADCAST_IDS, else joined by a shuffle. Scoring and the base counts
are a map over the scan without shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of, words_of

BUCKETS = 10_000
#: n-grams of the raw distribution that are added to the target.
PRIOR = 300_000.0
#: Mean log-likelihood ratio per n-gram below which a document is rejected.
THRESHOLD = -0.05
BROADCAST_IDS = 1_000_000
SYMBOLS = r"[#*$%&|<>]"


def _with_pairs(df: DataFrame, hashes: str, tail: str, pairs: str) -> DataFrame:
    """Adds pairs, one hash of each two adjacent entries; tail is used twice, so that it is not built inside the lambda."""
    df = df.withColumn(tail, F.slice(hashes, 2, F.size(hashes)))
    return df.withColumn(pairs, F.slice(F.zip_with(hashes, tail, lambda a, b: F.xxhash64(a, b)), 1, F.size(tail)))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _lowered(words: Column) -> Column:
    """Hashes of the words in lower case."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def model(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row, column weights: array of `buckets` log ratios. trusted_ids: one column, _trusted."""
    few = trusted_ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = trusted_ids.distinct()
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids) if few else ids, F.col("_id") == F.col("_trusted"), "left")
    grams = marked.select(F.col("_trusted").isNotNull().cast("long").alias("good"), _lowered(words_of(text_of("_text"))).alias("hashes"))
    grams = _with_pairs(grams, "hashes", "tail", "pairs").select("good", F.explode(F.concat("hashes", "pairs")).alias("gram")).select("good", _bucket(F.col("gram"), buckets).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").na.fill(0)
    listed = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("c"), F.sum("raw").cast("double").alias("raw"), F.sum("good").cast("double").alias("good"))
    share = lambda x: (x["raw"] + 1) / (F.col("raw") + buckets)
    ratio = lambda x: F.log((x["good"] + prior * share(x)) / (F.col("good") + prior) / share(x))
    return listed.select(F.transform("c", ratio).alias("weights"))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_ (the whole row), lowered (hashes of the words in lower case) and the base counts of every row."""
    text = text_of(text_col)
    lines = F.filter(F.split("text_", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    start = docs.select(F.col(id_col).alias("doc_id"), F.struct("*").alias("row_"), text.alias("text_")).select(
        "doc_id", "row_", "text_", words_of(F.col("text_")).alias("words"), F.regexp_count("text_", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"),
    )
    hashed = start.select(
        "doc_id", "row_", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), _lowered(F.col("words")).alias("lowered"),
    )
    # the hash of two words with that of the third
    paired = _with_pairs(hashed, "hashes", "tail", "pairs").withColumn("third", F.slice("hashes", 3, F.size("hashes")))
    keyed = paired.withColumn("keys", F.slice(F.zip_with("pairs", "third", lambda a, b: F.xxhash64(a, b)), 1, F.size("third"))).drop("hashes", "tail", "pairs", "third")
    # only texts with a repeated window are sorted; equal windows then lie side by side
    repeats = F.when(F.size(F.array_distinct("keys")) < F.size("keys"), F.sort_array(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i")))))
    ordered = keyed.withColumn("ordered", repeats).drop("keys")
    at = F.filter("ordered", lambda x, j: ((j > 0) & (F.get("ordered", F.greatest(j - 1, F.lit(0)))["k"] == x["k"])) | F.coalesce(F.get("ordered", j + 1)["k"] == x["k"], F.lit(False)))
    placed = ordered.withColumn("starts", F.sort_array(F.transform(at, lambda x: x["i"]))).drop("ordered")
    # each repeated window covers three words, less what the next one covers
    covered = F.aggregate(F.transform("starts", lambda s, j: F.least(F.lit(3), F.coalesce(F.get("starts", j + 1) - s, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def _judged(docs: DataFrame, trusted_ids: DataFrame, id_col: str, text_col: str, buckets: int, threshold: float) -> DataFrame:
    # one array of a fixed length, as a constant of the plan
    weights = F.split(F.lit(",".join(map(repr, model(docs, trusted_ids, id_col, text_col, buckets).first()["weights"]))), ",").cast("array<double>")
    hashed = _with_pairs(counts(docs, id_col, text_col), "lowered", "lowered_tail", "lowered_pairs")
    total = lambda grams: F.aggregate(grams, F.lit(0.0), lambda a, h: a + F.get(weights, _bucket(h, buckets)))
    mean = F.when(F.size("lowered") > 0, (total("lowered") + total("lowered_pairs")) / (F.size("lowered") + F.size("lowered_pairs")))
    # used twice below, so computed once before
    scored = hashed.withColumn("score", mean).withColumn("number_", F.monotonically_increasing_id())
    score = F.col("score")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & F.coalesce(score >= threshold, F.lit(False))
    told = F.struct("row_", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score", kept.alias("kept"))
    # every result hangs on the row number: no filter on one is pushed below the arrays, where it would build them anew for each element
    return scored.select(F.when(F.col("number_") >= 0, told).alias("told_")).select("told_.*")


def quality(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept: one row per input row.

    A null text has no words: every count is 0, base_failed is true, score is null
    and it is not kept. Repeated rows are judged alike. trusted_ids may be empty:
    the target is then the raw corpus and every score is 0. No rows in, no rows out.
    Window keys are 64-bit hashes compared inside one text only.
    """
    return _judged(docs, trusted_ids, id_col, text_col, buckets, threshold).drop("row_")


def keep_good(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    return _judged(docs, trusted_ids, id_col, text_col, buckets, threshold).where("kept").select("row_.*")


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of the rows labelled good and not toxic."""
    return labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_trusted"))
