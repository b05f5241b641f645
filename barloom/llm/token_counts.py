"""Token counts without token ids: pieces are counted once per distinct pre-token.

1. A map over the scan cuts texts into pre-tokens as the tokenizer does and writes,
   for each block of documents and each bucket of pre-tokens (by hash), one packed
   row of postings: the distinct pre-tokens and, for each, documents and frequencies.
2. The rows are shuffled by bucket. A task joins the postings with the piece counts
   of its pre-tokens, each distinct one counted once, and sums by document.
3. The partial sums go back by block and are added up.

Scale. All postings of a pre-token in a block are one entry, so a very common one has
one entry a block, not one a document. Buckets are as many as the session's shuffle
partitions; a task holds the counts of its own bucket's distinct pre-tokens only.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of
from barloom.llm.pieces import slices

BLOCK_CHARS = 6_000_000
LIMIT = 2048
#: Texts of characters below this are cut here; others by the library.
LATIN = 0x250
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


class PreTokens:
    """Cuts texts as the tokenizer does, and counts pieces of single pre-tokens."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.special = re.compile("(" + "|".join(re.escape(x.content) for x in self.library.get_added_tokens_decoder().values()) + ")")
        kinds = {chr(c): unicodedata.category(chr(c))[0] for c in range(LATIN)}
        of = lambda k: "".join(re.escape(c) for c, x in kinds.items() if x == k)
        white = "\\x09-\\x0d\\x20\\x85\\xa0"
        self.cut_latin = re.compile(f"{CONTRACTIONS}|[{of('L')}]+|[{of('N')}]|[^{white}{of('L')}{of('N')}]+").findall
        self.foreign = re.compile(f"[^\\x00-{chr(LATIN - 1)}]").search
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        #: bytes as the letters of byte-level models: printable ones stand for themselves
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.table = {i: self.letters[i] for i in range(256)}
        self.model = self.library.model
        self.counts: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        """The pre-tokens; white space is in none, so one space marks special strings and two mark pre-tokens that the library has mapped to byte letters."""
        if "<|" in text:
            out: list[str] = []
            for part in self.special.split(text):
                out += [" " + part] if self.special.fullmatch(part) else self._plain(part) if part else []
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not self.foreign(text) and not self.foreign(low := text.lower()):  # some Latin capitals have their small letter elsewhere
            return self.cut_latin(low)
        text = self.library.normalizer.normalize_str(text)
        if not self.foreign(text):
            return self.cut_latin(text)
        return ["  " + x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, word: str) -> int:
        """Pieces of one pre-token."""
        if word[:2] == "  ":
            return len(self.model.tokenize(word[2:]))
        if word[0] == " ":
            return 1
        return len(self.model.tokenize(word.encode("utf-8", "replace").decode("latin-1").translate(self.table)))


#: The cutter of this worker process, by its vocabulary.
_KEPT: dict[str, PreTokens] = {}


def _pre_tokens(tokenizer: str) -> PreTokens:
    """That of another vocabulary is dropped."""
    if tokenizer not in _KEPT:
        _KEPT.clear()
        _KEPT[tokenizer] = PreTokens(tokenizer)
    return _KEPT[tokenizer]


def _pack(*parts: bytes) -> bytes:
    return zlib.compress(b"".join(len(x).to_bytes(4, "little") + x for x in parts), 1)


def _unpack(blob: bytes) -> list[bytes]:
    data, at, out = memoryview(zlib.decompress(blob)), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row.

    n_tokens is the library's count without begin, end or added special tokens;
    special strings inside a text count as one token each. A null or empty text has
    0 bytes and 0 tokens. Rows that repeat a doc_id are counted one by one. No rows,
    no rows.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())  # of the vocabulary's size, whatever the input
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()

    def shared() -> PreTokens:
        return _pre_tokens(held.value)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pre = TaskContext.get().partitionId() << 32, shared()
        for batch in batches:
            for part, texts in slices(batch, "text", BLOCK_CHARS):
                cut = [pre.cut(t) for t in texts]
                names: dict[str, int] = {}
                sizes = [len(x) for x in cut]
                words = np.fromiter((names.setdefault(w, len(names)) for w in chain.from_iterable(cut)), np.int64, sum(sizes))
                del cut
                code, freq = np.unique(words * len(texts) + np.repeat(np.arange(len(texts)), sizes), return_counts=True)
                word, doc = np.divmod(code, max(1, len(texts)))
                listed = list(names)
                home = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % buckets for w in listed), np.int64, len(listed))
                order = np.argsort(home[word], kind="stable")
                word, doc, freq = word[order], doc[order], freq[order]
                edges = np.searchsorted(home[word], np.arange(buckets + 1))
                rows: list[tuple[int, bytes]] = []
                for b in range(buckets):
                    lo, hi = edges[b], edges[b + 1]
                    if lo < hi:
                        own, per = np.unique(word[lo:hi], return_counts=True)
                        rows.append((b, _pack("\n".join(listed[k] for k in own.tolist()).encode("utf-8", "replace"), per.astype("<u4").tobytes(), doc[lo:hi].astype("<u4").tobytes(), freq[lo:hi].astype("<u4").tobytes())))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in rows] + [block % buckets], pa.int32()), pa.array([block] * (n + 1), pa.int64()), pa.array([x for _, x in rows] + [None], pa.binary()),
                     pa.array([None] * n + [part.column("doc_id").to_pylist()], pa.list_(part.schema.field("doc_id").type)), pa.array([None] * n + [[len(t.encode("utf-8", "replace")) for t in texts]], pa.list_(pa.int64()))],
                    names=["bucket", "block", "payload", "ids", "n_bytes"],
                )
                block += 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        pre = shared()
        for batch in batches:
            blobs = []
            for blob in batch.column("payload").to_pylist():
                if blob is None:
                    blobs.append(None)
                    continue
                words, per, doc, freq = _unpack(blob)
                pieces = []
                for w in str(words, "utf-8").split("\n"):
                    n = counts.get(w)
                    if n is None:
                        n = counts[w] = pre.count(w)
                    pieces.append(n)
                doc, freq = np.frombuffer(doc, "<u4"), np.frombuffer(freq, "<u4")
                total = np.bincount(doc, np.repeat(np.array(pieces, np.float64), np.frombuffer(per, "<u4")) * freq)
                some = np.nonzero(total)[0]
                blobs.append(_pack(some.astype("<u4").tobytes(), total[some].astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(blobs, pa.binary()), batch.column("ids"), batch.column("n_bytes")], names=["block", "payload", "ids", "n_bytes"])

    def added(table: pa.Table) -> pa.Table:
        blobs, ids, sizes = table.column("payload").to_pylist(), table.column("ids").to_pylist(), table.column("n_bytes").to_pylist()
        k = next(i for i, x in enumerate(sizes) if x is not None)
        total = np.zeros(len(sizes[k]), np.int64)
        for blob in blobs:
            if blob is not None:
                at, n = _unpack(blob)
                total[np.frombuffer(at, "<u4")] += np.frombuffer(n, "<u8").astype(np.int64)
        return pa.table([pa.array(ids[k], table.schema.field("ids").type.value_type), pa.array(sizes[k], pa.int64()), pa.array(total), pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    packed = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(postings, f"bucket int, block long, payload binary, ids array<{kind}>, n_bytes array<long>")
    partial = packed.repartition(buckets, "bucket").mapInArrow(sums, f"block long, payload binary, ids array<{kind}>, n_bytes array<long>")
    return partial.groupBy("block").applyInArrow(added, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
