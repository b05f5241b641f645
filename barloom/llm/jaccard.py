r"""N-gram Jaccard join by MinHash banding.

1. A map over the scan turns each text into the set of its five-word shingles
   (64-bit hashes of runs of `[^\x20\x09-\x0D]+`) and that into BANDS x ROWS minima.
   A pair of similarity 0.8 shares a band with probability
   1 - (1 - 0.8^6)^30 = 0.9999, the target recall.
2. Documents with one shingle set are one class, so copies are never paired.
   Classes that share a band hash are linked to the smallest class of the bucket,
   not to each other; connected components of these links hold all candidates.
3. The full shingle sets of each component are compared, all against all, by exact
   intersection counts. A component of more than TILE classes is dealt in tiles:
   one task for each pair of tiles. Tasks return counts and a spanning forest, one
   row a class, never the pairs.

Scale. Texts are read twice and not shuffled unless more than BROADCAST_ROWS classes
are candidates. Band rows are aggregated before the shuffle; a hot bucket costs one
row a class. Components are found by joins with checkpoints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import body_of, cut, one_of_each, small, text_of
from barloom.llm.graphs import components
from barloom.llm.pieces import slices

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 30, 6
TILE = 512
BROADCAST_ROWS = 500_000
MOST_WORDS = 200_000
SEED = 7


class _Hashes(dict):
    """64-bit hashes of words, kept for reuse up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MOST_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], hashes: dict, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text of fewer words has one shingle of all of them, or none if it has no word."""
    cut_ = [t.encode("utf-8", "replace").split() for t in texts]
    sizes = np.array([len(x) for x in cut_], np.int64)
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(cut_)), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    total = np.zeros(len(flat), np.uint64)
    if len(flat) >= words:
        n = len(flat) - words + 1
        for k in range(words):
            total[:n] = (total[:n] + flat[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            total[:n] ^= total[:n] >> np.uint64(29)
    total = _mixed(total)
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist()):
        if size >= words:
            out.append(np.unique(total[end - size : end - words + 1]))
        elif size:
            h = np.uint64(size)
            for x in flat[end - size : end]:
                h = _mixed(np.array([h * np.uint64(31) + x], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_hashes(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    add, mul = rng.integers(0, 2**64, bands * rows, np.uint64), rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.uint64(2**64 - 1))
    for k in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[k : k + 2048, None] ^ add) * mul).min(axis=0))
    out = np.zeros(bands, np.uint64)
    for x in least.reshape(bands, rows).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + x)
    return out.view(np.int64)


def _signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    sets = shingle_sets(texts, hashes, words)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("body"), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() if len(x) else "" for x in sets], pa.string()), pa.array([band_hashes(x, bands, rows) if len(x) else None for x in sets], pa.list_(pa.int64()))],
                        names=["doc_id", "body", "set_key", "bands"],
                    )

    return docs.select(F.col(id_col).alias("doc_id"), body_of(text_col).alias("body"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, body long, set_key string, bands array<long>")


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similar: float) -> np.ndarray:
    """Pairs (row of left, row of right) of sets with a Jaccard similarity of at least `similar`; both index sets."""
    used = np.unique(np.concatenate([left, right]))
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([sets[k] for k in used]) if len(used) else np.zeros(0, np.uint64)
    owner = np.repeat(used, sizes[used])
    _, feature, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[feature] > 1
    names, feature = np.unique(feature[shared], return_inverse=True)
    owner = owner[shared]
    row_of = np.full(len(sets), -1)
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(feature, kind="stable")
    feature, owner = feature[order], owner[order]
    step = 4096
    for k in range(0, len(names), step):
        lo, hi = np.searchsorted(feature, (k, k + step))
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        for side, rows in ((x, left), (y, right)):
            row_of[:] = -1
            row_of[rows] = np.arange(len(rows))
            at = row_of[owner[lo:hi]]
            side[at[at >= 0], feature[lo:hi][at >= 0] - k] = 1
        common += x @ y.T
    either = sizes[left][:, None] + sizes[right][None, :] - common
    return np.argwhere((common >= similar * either - 1e-3) & (common.astype(np.float64) >= similar * either.astype(np.float64)))


def _verify(similar: float):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("c").to_numpy()
        tiles = table.column("tile").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        left, right = np.nonzero(tiles == i)[0], np.nonzero(tiles == j)[0]
        pairs = linked(sets, left, right, similar) if len(left) and len(right) else np.zeros((0, 2), np.int64)
        pairs = np.stack([left[pairs[:, 0]], right[pairs[:, 1]]], axis=1)
        if i == j:
            pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        links = np.bincount(pairs.ravel(), minlength=len(ids))
        root = np.arange(len(ids))
        while True:  # each class takes the least root of its neighbours until none changes
            new = root.copy()
            np.minimum.at(new, pairs[:, 0], root[pairs[:, 1]])
            np.minimum.at(new, pairs[:, 1], root[pairs[:, 0]])
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = np.nonzero(links)[0]
        return pa.table({"c": ids[some], "n": links[some].astype(np.int64), "root": ids[root[some]]})

    return run


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """c, set_key, comp, tiles, shingles of rows c, set_key, comp, tiles, text whose text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                for part, texts_ in slices(batch, "text"):
                    sets = shingle_sets(texts_, hashes, words)
                    keys = [hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() for x in sets]
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in ("c", "comp", "tiles")] + [pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([a == b for a, b in zip(keys, part.column("set_key").to_pylist())])], names=["c", "comp", "tiles", "shingles", "same"])

    return texts.mapInArrow(run, "c long, comp long, tiles int, shingles binary, same boolean").where("same").drop("same")


def _judged(docs: DataFrame, id_col: str, text_col: str, words: int, similar: float, bands: int, rows: int, tile: int) -> DataFrame:
    """doc_id, body, class_id, class_size, n_links and first, the row (n, doc_id, body) that names the group."""
    signs = cut(_signatures(docs, id_col, text_col, words, bands, rows))
    # a class is named by its row of the smallest id, null last
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "body"))
    classes = cut(signs.groupBy("set_key").agg(least.alias("first"), F.count("*").alias("class_size"), F.first("bands").alias("bands")).withColumn("c", F.monotonically_increasing_id()))
    members = classes.where("bands IS NOT NULL").select("c", F.posexplode("bands").alias("band", "hash"))
    leads = members.groupBy("band", "hash").agg(F.min("c").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = components(members.join(leads, ["band", "hash"]).where("c <> lead").select(F.col("c").alias("a"), F.col("lead").alias("b")))
    sizes = near.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    wanted = cut(near.join(sizes, "root").select(F.col("node").alias("c"), F.col("root").alias("comp"), "tiles").join(classes.select("c", "set_key", "first.doc_id", F.col("first.body").alias("class_body")), "c").withColumnRenamed("doc_id", "class_id"))
    held = docs.select(F.col(id_col).alias("id"), body_of(text_col).alias("body"), text_of(text_col).alias("text"))
    texts = held.join(small(wanted, BROADCAST_ROWS), F.col("id").eqNullSafe(F.col("class_id")) & (F.col("body") == F.col("class_body"))).select("c", "set_key", "comp", "tiles", "text")
    # a row that names a class may be repeated
    sets = _sets(texts, words).dropDuplicates(["c"])
    own = F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int")
    dealt = sets.withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("c", "comp", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "shingles")
    found = cut(dealt.groupBy("comp", "i", "j").applyInArrow(_verify(similar), "c long, n long, root long"))
    counts = found.groupBy("c").agg(F.sum("n").alias("n_links"))
    groups = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    first = groups.join(classes.select(F.col("c").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("group_first"))
    grouped = groups.join(first, "root").select(F.col("node").alias("c"), "group_first")
    told = classes.drop("bands").join(counts, "c", "left").join(grouped, "c", "left").select("set_key", F.col("first.doc_id").alias("class_id"), "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_first", "first").alias("first"))
    return signs.select("doc_id", "body", "set_key").join(told, "set_key").drop("set_key")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """doc_id, class_id, class_size, n_links, group_id: one row per input row.

    Documents with one shingle set are a class, named by its smallest doc_id (null
    only if all are null). n_links counts the other classes whose similarity is at
    least `similar`; the links chain classes to groups, named by the smallest doc_id
    in them. Texts of fewer than `words` words have one shingle of all their words.
    Null, empty and blank texts have no shingle: they are one class and group
    without links. Rows that repeat a doc_id count one by one in class_size, also
    where their texts differ. No rows in, no rows out.
    """
    return _judged(docs, id_col, text_col, words, similar, bands, rows, tile).select("doc_id", "class_id", "class_size", "n_links", F.col("first.doc_id").alias("group_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """One row of docs for each group of jaccard_join, with all its columns.

    The row with the smallest doc_id (null last) stays; of rows that repeat its
    doc_id and text, one. A row of another text under the same doc_id is judged by
    its own group. Columns may have any names. No rows in, no rows out.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("body") == F.col("first.body"))
    judged = cut(_judged(docs, id_col, text_col, words, similar, bands, rows, tile).select("doc_id", "body", stays.alias("stays")))
    return one_of_each(docs, judged, id_col, text_col)
