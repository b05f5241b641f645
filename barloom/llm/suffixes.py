r"""Removal of long repeated byte strings by a range-partitioned sparse suffix array.

A byte is removed if a string of LENGTH bytes that covers it also starts in a
document with a smaller doc_id. The suffix array is sparse: suffixes start at
anchors, the positions with the least hash of GRAM bytes in some window of LENGTH
bytes. An anchor's place in a window depends on the window's bytes alone, so two
equal windows hold the same anchor, and comparing the suffixes and the bytes left of
equal anchors finds every equal window.

1. Documents are packed into compressed blocks, shuffled once by block; all passes
   read that shuffle.
2. Blocks send hashes of their distinct anchors by hash bucket and get back one bit
   each: whether another document may hold the anchor too (a collision only keeps an
   anchor for the exact comparison below). Unrepeated text ends here.
3. The suffixes of the remaining anchors, with the bytes before them, are
   range-partitioned by splitters sampled from leading bytes. Splitters are shorter than an
   anchor, so suffixes that share an anchor never straddle a boundary and
   comparison across boundaries is settled by the partitioning itself. A bucket is
   sorted by multikey quicksort on eight-byte words, ties refined word by word;
   common prefixes of neighbours, and of the reversed left sides, give for each of the
   window places around an anchor the smallest document holding that window.
4. One bit for each place goes back to the block, which marks the bytes.

Scale. Equal suffixes of a block are one entry with its smallest document, so a
passage that a third of all documents share costs one entry a block and anchor. No
bytes are compared but those of repeated anchors. Buckets are as many as the
session's shuffle partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of
from barloom.llm.pieces import slices

LENGTH, GRAM = 50, 20
PLACES = LENGTH - GRAM + 1
BLOCK_CHARS = 3_000_000
CHUNK = 1_000_000
SPLIT_BYTES = 16
SAMPLE_DOCS, SAMPLE_ANCHORS = 2000, 100
_B = 0x9E3779B97F4A7C15
_LAST_ID = np.iinfo(np.int64).max


def _grams(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM = 16 + 4 bytes from each position, by doubling."""
    h, width, four = buf.astype(np.uint64) + np.uint64(1), 1, None
    for _ in range(4):
        h = h[:-width] * np.uint64(pow(_B, width, 2**64)) + h[width:]
        width *= 2
        if width == 4:
            four = h
    h = h[: len(h) - 4] * np.uint64(pow(_B, 4, 2**64)) + four[16 : 16 + len(h) - 4]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """Of each run of `width` values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = of(x[:-have], x[have:])
        have *= 2
    return of(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of documents that lie end to end in buf."""
    found, hashes = [], []
    starts = np.concatenate([[0], ends[:-1]])
    for at in range(0, max(1, len(buf) - LENGTH + 1), CHUNK):
        part = buf[at : at + CHUNK + LENGTH - 1]
        n = len(part) - LENGTH + 1
        if n <= 0:
            continue
        grams = _grams(part)
        order = (grams >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = _sliding(order, PLACES, np.minimum)[:n]
        # windows that run over the end of a document hold no anchor
        over = np.zeros(n + 1, np.int32)
        lo = np.clip(np.maximum(ends - LENGTH + 1, starts) - at, 0, n)
        hi = np.clip(ends - at, 0, n)
        np.add.at(over, lo, 1)
        np.add.at(over, hi, -1)
        least = np.where(np.cumsum(over[:-1]) > 0, np.uint32(0), least)
        padded = np.concatenate([np.zeros(PLACES - 1, np.uint32), least, np.zeros(PLACES - 1, np.uint32)])
        most = _sliding(padded, PLACES, np.maximum)
        pos = np.nonzero(most[: len(order)] == order[: len(most)])[0]
        found.append(pos + at)
        hashes.append(grams[pos])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos, first = np.unique(np.concatenate(found), return_index=True)
    return pos, np.concatenate(hashes)[first]


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian words: sorted by the first word, then ties alone by the next, and so on."""
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.zeros(len(order), np.int64)
    for k in range(1, words.shape[1] + 1):
        keys = words[order, k - 1]
        tied = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]) | (tied[1:] != tied[:-1])]))
        sizes = np.bincount(tied)
        open_ = np.nonzero(sizes[tied] > 1)[0]
        if k == words.shape[1] or not len(open_):
            break
        sub = order[open_]
        order[open_] = sub[np.lexsort((words[sub, k], tied[open_]))]
    return order


def _words(rows: np.ndarray) -> np.ndarray:
    width = -(-rows.shape[1] // 8) * 8
    full = np.zeros((len(rows), width), np.uint8)
    full[:, : rows.shape[1]] = rows
    return full.view(">u8").astype(np.uint64)


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, and for each but the first in it how many bytes it shares with the one before."""
    order = multikey_order(_words(rows))
    differ = rows[order[1:]] != rows[order[:-1]]
    return order, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def places(right: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A bit for each place: whether the window that begins so many bytes before the anchor starts in a smaller document."""
    n = len(doc)
    masks = np.zeros(n, np.uint32)
    if n < 2:
        return masks
    r_order, r_same = _classes(right)
    l_order, l_same = _classes(left)
    r_class, l_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(PLACES):
        r_class[r_order] = np.concatenate([[0], np.cumsum(r_same < LENGTH - k)])
        l_class[l_order] = np.concatenate([[0], np.cumsum(l_same < k)])
        some = np.nonzero((n_right >= LENGTH - k) & (n_left >= k))[0]
        if not len(some):
            continue
        key = r_class[some] * n + l_class[some]
        order = np.argsort(key, kind="stable")
        key, ids = key[order], doc[some[order]]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        least = np.minimum.reduceat(ids, np.nonzero(new)[0])[np.cumsum(new) - 1]
        masks[some[order[least < ids]]] |= np.uint32(1 << k)
    return masks


def _squeeze(*arrays: np.ndarray) -> bytes:
    import zstandard

    raw = b"".join(len(x).to_bytes(8, "little") + x for x in (np.ascontiguousarray(a).tobytes() for a in arrays))
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _expand(blob: bytes) -> list[np.ndarray]:
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(np.frombuffer(data, np.uint8, n, at + 8))
        at += 8 + n
    return out


class _Block:
    """What every pass over a block computes again: bytes, documents, anchors, distinct anchors by bucket."""

    def __init__(self, payload: bytes, buckets: int):
        self.buf, sizes, ids, null = _expand(payload)
        self.sizes, self.ids, self.null = sizes.view(np.int64), ids.view(np.int64), null.astype(bool)
        self.ends = np.cumsum(self.sizes)
        self.buckets = buckets
        self.pos, hashes = anchors(self.buf, self.ends) if len(self.buf) >= LENGTH else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.owner = np.searchsorted(self.ends, self.pos, side="right")
        home = (hashes >> np.uint64(40)).astype(np.int64) % buckets
        # distinct anchors in the order of (bucket, hash)
        order = np.lexsort((hashes, home))
        h, b, d = hashes[order], home[order], self.ids[self.owner[order]]
        new = np.concatenate([[True], (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
        self.kind = np.zeros(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        at = np.nonzero(new)[0]
        self.hashes, self.home = h[at], b[at]
        self.many = np.maximum.reduceat(d, at) != np.minimum.reduceat(d, at) if len(at) else np.zeros(0, bool)

    def sent(self) -> list[tuple[int, bytes]]:
        """By bucket: 39 bits of each distinct anchor's hash and one that tells whether two documents here hold it."""
        low = ((self.hashes & np.uint64((1 << 39) - 1)) << np.uint64(1)) | self.many.astype(np.uint64)
        edges = np.searchsorted(self.home, np.arange(self.buckets + 1))
        five = low.view(np.uint8).reshape(-1, 8)[:, :5]
        return [(b, five[edges[b] : edges[b + 1]].tobytes()) for b in range(self.buckets) if edges[b] < edges[b + 1]]

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """The anchors (indices of pos) that may stand in two documents."""
        keep = np.zeros(len(self.hashes), bool)
        edges = np.searchsorted(self.home, np.arange(self.buckets + 1))
        for b, bits in answers.items():
            keep[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=edges[b + 1] - edges[b]).astype(bool)
        return np.nonzero(keep[self.kind])[0]

    def suffixes(self, some: np.ndarray, splitters: np.ndarray) -> None:
        """Sets the distinct suffixes of these anchors, in the order of (range, hash): rows, lengths, smallest document, and the entry of each anchor."""
        pos, owner = self.pos[some], self.owner[some]
        n_left = np.minimum(PLACES - 1, pos - (self.ends - self.sizes)[owner])
        n_right = np.minimum(LENGTH, self.ends[owner] - pos)
        padded = np.concatenate([np.zeros(PLACES - 1, np.uint8), self.buf, np.zeros(LENGTH, np.uint8)])
        rows = padded[pos[:, None] + np.arange(PLACES - 1 + LENGTH)]
        rows[:, : PLACES - 1] *= np.arange(PLACES - 1)[None, :] >= (PLACES - 1 - n_left)[:, None]
        rows[:, PLACES - 1 :] *= np.arange(LENGTH)[None, :] < n_right[:, None]
        full = np.concatenate([rows, n_left[:, None].astype(np.uint8), n_right[:, None].astype(np.uint8)], axis=1)
        lead = np.ascontiguousarray(rows[:, PLACES - 1 : PLACES - 1 + SPLIT_BYTES]).view(f"S{SPLIT_BYTES}").ravel()
        where = np.searchsorted(splitters, lead, side="right")
        words = _words(full)
        order = np.lexsort((*words.T[::-1], where)) if len(some) else np.zeros(0, np.int64)
        sorted_ = full[order]
        new = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)]) if len(order) else np.zeros(0, bool)
        self.entry = np.zeros(len(some), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        at = np.nonzero(new)[0]
        self.rows, self.range = sorted_[at], where[order][at]
        self.least = np.minimum.reduceat(self.ids[owner[order]], at) if len(at) else np.zeros(0, np.int64)

    def removed(self, some: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Which bytes are removed, given the bits of each distinct suffix."""
        doc = self.ids[self.owner[some]]
        n_left, n_right = self.rows[self.entry, -2].astype(np.int64), self.rows[self.entry, -1].astype(np.int64)
        mask, copy = masks[self.entry], doc > self.least[self.entry]
        marks = np.zeros(len(self.buf) + 1, np.int32)
        for k in range(PLACES):
            hit = (n_right >= LENGTH - k) & (n_left >= k) & (copy | ((mask >> np.uint32(k)) & np.uint32(1)).astype(bool))
            start = np.unique(self.pos[some[hit]] - k)
            marks[start] += 1
            marks[start + LENGTH] -= 1
        return np.cumsum(marks[:-1]) > 0


def _pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in slices(batch, "text", BLOCK_CHARS):
                raw = [t.encode("utf-8", "replace") for t in texts]
                ids = part.column("doc_id")
                blob = _squeeze(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64), np.array([_LAST_ID if x is None else x for x in ids.to_pylist()], np.int64), np.array([x is None for x in ids.to_pylist()], np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([blob], pa.binary())], names=["block", "payload"])
                block += 1

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "block long, payload binary")


def _answers(table: pa.Table) -> pa.Table:
    """For one bucket: a bit for each hash that a block sent."""
    blobs = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in table.column("payload").to_pylist()]
    sizes = [len(x) for x in blobs]
    full = np.zeros((sum(sizes), 8), np.uint8)
    full[:, :5] = np.concatenate(blobs)
    low = full.view("<u8").ravel()
    _, back, times = np.unique(low >> np.uint64(1), return_inverse=True, return_counts=True)
    again = (np.bincount(back, low & np.uint64(1)) > 0) | (times > 1)
    bits = [np.packbits(x).tobytes() for x in np.split(again[back], np.cumsum(sizes)[:-1])]
    n = len(bits)
    return pa.table([table.column("block"), pa.array(["hash"] * n), table.column("bucket"), pa.array(bits, pa.binary())], names=["block", "what", "bucket", "bits"])


def _ranges(table: pa.Table) -> pa.Table:
    """For one range of suffixes: the bits of each that a block sent."""
    parts = [_expand(x) for x in table.column("payload").to_pylist()]
    rows = np.concatenate([x[0].reshape(-1, PLACES + LENGTH + 1) for x in parts])
    doc = np.concatenate([x[1].view(np.int64) for x in parts])
    masks = places(rows[:, PLACES - 1 : -2], rows[:, PLACES - 2 :: -1], rows[:, -1], rows[:, -2], doc)
    blobs = [_squeeze(x) for x in np.split(masks, np.cumsum([len(x[1]) // 8 for x in parts])[:-1])]
    n = len(blobs)
    return pa.table([table.column("block"), pa.array(["range"] * n), table.column("bucket"), pa.array(blobs, pa.binary())], names=["block", "what", "bucket", "bits"])


def _bits(table: pa.Table, what: str) -> dict[int, bytes]:
    return {b: x for w, b, x in zip(table.column("what").to_pylist(), table.column("bucket").to_pylist(), table.column("bits").to_pylist()) if w == what}


def splitters_of(docs: DataFrame, text_col: str, buckets: int, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Leading bytes that cut the suffixes of a bounded sample into ranges of one size. They set the balance only, not the result."""
    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for t in batch.column("text").to_pylist():
                    buf = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
                    if len(buf) >= LENGTH:
                        pos, _ = anchors(buf, np.array([len(buf)]))
                        some = pos[np.linspace(0, len(pos) - 1, min(len(pos), SAMPLE_ANCHORS)).astype(int)]
                        yield pa.RecordBatch.from_arrays([pa.array([buf[p : p + SPLIT_BYTES].tobytes() for p in some.tolist()], pa.binary())], names=["lead"])

    share = min(1.0, sample_docs / max(1, docs.count()))
    leads = [bytes(r[0]) for r in docs.select(text_of(text_col).alias("text")).sample(share, 1).mapInArrow(leading, "lead binary").collect()]
    leads = np.sort(np.array(leads, f"S{SPLIT_BYTES}"))
    return np.unique(leads[np.linspace(0, len(leads), buckets + 1)[1:-1].astype(int)]) if len(leads) >= buckets > 1 else leads[:0]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per input row.

    doc_id must be an integer; a null one counts as larger than all others. A null
    or empty text has 0 bytes. Rows that repeat a doc_id are one document in the
    comparison, so they remove nothing from each other, and one row each in the
    result. Texts of fewer than LENGTH bytes lose nothing. No rows in, no rows out.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = splitters_of(docs, text_col, buckets)
    blocks = _pack(docs, id_col, text_col).repartition(buckets, "block")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                    sent = _Block(payload.as_py(), buckets).sent()
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(sent), pa.int64()), pa.array([b for b, _ in sent], pa.int32()), pa.array([x for _, x in sent], pa.binary())], names=["block", "bucket", "payload"])

    def second(own: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        block = 0
        if own.num_rows:
            block = own.column("block")[0].as_py()
            with np.errstate(over="ignore"):
                b = _Block(own.column("payload")[0].as_py(), buckets)
            b.suffixes(b.repeated(_bits(told, "hash")), splitters)
            edges = np.searchsorted(b.range, np.arange(len(splitters) + 2))
            rows = [(k, _squeeze(b.rows[edges[k] : edges[k + 1]], b.least[edges[k] : edges[k + 1]])) for k in range(len(splitters) + 1) if edges[k] < edges[k + 1]]
        return pa.table([pa.array([block] * len(rows), pa.int64()), pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "bucket", "payload"])

    def third(own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        with np.errstate(over="ignore"):
            b = _Block(own.column("payload")[0].as_py(), buckets)
        some = b.repeated(_bits(told, "hash"))
        b.suffixes(some, splitters)
        masks = np.zeros(len(b.least), np.uint32)
        edges = np.searchsorted(b.range, np.arange(len(splitters) + 2))
        for k, blob in _bits(told, "range").items():
            masks[edges[k] : edges[k + 1]] = _expand(blob)[0].view(np.uint32)
        gone = b.removed(some, masks)
        out: list[tuple] = []
        for end, size in zip(b.ends.tolist(), b.sizes.tolist()):
            own_gone = gone[end - size : end]
            n = int(own_gone.sum())
            spans = int(own_gone[0]) + int((own_gone[1:] & ~own_gone[:-1]).sum()) if n else 0
            data = b.buf[end - size : end]
            out.append((size, n, spans, hashlib.sha256((data[~own_gone] if n else data).tobytes()).hexdigest()))
        ids = pa.array([None if null else x for x, null in zip(b.ids.tolist(), b.null.tolist())], pa.int64())
        return pa.table([ids, *[pa.array([x[k] for x in out], pa.int64()) for k in range(3)], pa.array([x[3] for x in out], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    answer = "block long, what string, bucket int, bits binary"
    sent = "block long, bucket int, payload binary"
    hashes = blocks.mapInArrow(first, sent).groupBy("bucket").applyInArrow(_answers, answer)
    suffixes = blocks.groupBy("block").cogroup(hashes.groupBy("block")).applyInArrow(second, sent)
    ranges = suffixes.groupBy("bucket").applyInArrow(_ranges, answer)
    told = hashes.unionAll(ranges)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(third, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
