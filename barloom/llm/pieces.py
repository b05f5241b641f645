"""SentencePiece encoding and decoding by a batched numpy Viterbi.

The text is cut at spaces into words; words of equal length (long ones filled up to a common
width) advance together as the rows of one matrix. For every substring length a rolling hash of all positions
probes a table of the pieces, and for each end position a vectorised
maximum over the candidate pieces stores the backpointer.

The public model is a byte-pair model, whose right result is that of its merges,
not the best sum of scores. Merging is local: a sequence of pieces is the encoding
of its text exactly if each two adjacent pieces, taken alone, are the encoding of
theirs. So the Viterbi scores a candidate by its length if it may follow the last
piece of the prefix, else minus infinity; each prefix then has one best path, the
library's. Whether a pair may stand together is asked of the library once for each
distinct pair and kept in a table. A model of another kind is refused.

Scale. A map over the scan, without shuffle. Distinct words are encoded once a task
and kept up to MOST_WORDS in each of two tables; texts are taken in slices of SLICE_CHARS, so memory is
bounded but for the longest single text. A lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
MOST_WORDS = 400_000
#: Pairs of pieces whose standing together is kept, and the width above which a word is encoded by itself.
MOST_PAIRS = 1_000_000
LONG_WORD = 256
SLICE_CHARS = 1_000_000
MOST_CELLS = 150_000


class Viterbi:
    """Encoder and decoder of one byte-pair SentencePiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp, n = self.library, self.library.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and pieces[i]]
        if sp.encode("a b", out_type=str)[0][:1] != SPACE or any(SPACE in pieces[i].lstrip(SPACE) or (pieces[i][:2] == SPACE * 2 and pieces[i].strip(SPACE)) for i in usable):
            raise ValueError("only models with a space before each word, whose pieces lie within words, are encoded")
        self.unknown, self.start = n, n + 1
        self.pieces, self.ids = pieces, {pieces[i]: i for i in usable}
        self.longest = max(len(pieces[i]) for i in usable)
        hashes = np.array([self._hash(pieces[i]) for i in usable], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array(usable, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one key")
        self.seen, self.places = np.zeros(1 << 20, bool), np.zeros(1 << 20, np.int32)
        self.seen[self._slot(self.keys)] = True
        self.places[self._slot(self.keys)] = np.arange(len(self.keys))
        self.bytes = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.byte_ids = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        alone = "".join(chr(c) for c in range(128) if not any(chr(c) in p for p in self.ids if len(p) > 1))
        alone = re.escape(alone)
        # no two of the three match at one place; the most frequent is tried first
        self.split = re.compile(f"{SPACE}?[^{SPACE}{alone}]+|{SPACE}?[{alone}]|{SPACE}+(?={SPACE}|$)" if alone else f"{SPACE}?[^{SPACE}]+|{SPACE}+(?={SPACE}|$)").findall
        self.pairs: dict[int, bool] = {}
        self.known_pairs = np.full(1 << 21, -1, np.int64)  # twice the code of a pair, and one if it is good
        self.head, self.feed = sp.encode("\n"), sp.encode("\n\n")[-1:]
        self.feeds_part = sp.encode("\na\na") == [*self.head, *sp.encode("\na")[len(self.head) :], *self.feed, *sp.encode("\na")[len(self.head) :]]
        prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.alive = np.zeros(1 << 20, bool)
        self.alive[self._slot(np.array([self._hash(p) for p in prefixes], np.uint64))] = True
        self.words, self.old = _Words(), _Words()
        self.piece_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.piece_sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c)) & (2**64 - 1)
        return np.uint64(h)

    def _alone(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of strings as they are, without its space before: a line feed joins with nothing, so one call holds many."""
        head, feed = self.head, self.feed
        if not self.feeds_part or "\n" in "".join(texts):
            return [x[len(head) :] for x in self.library.encode(["\n" + t.replace(SPACE, " ") for t in texts], num_threads=1)]
        out: list[list[int]] = []
        for k in range(0, len(texts), 1000):
            ids = self.library.encode("\n" + "\n".join(texts[k : k + 1000]).replace(SPACE, " "))[len(head) :]
            ends = [i for i, x in enumerate(ids) if x == feed[0]]
            out += [ids[i:j] for i, j in zip([0, *[x + 1 for x in ends]], [*ends, len(ids)])]
        return out

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may stand after piece a; a may be the start of a word. Known pairs are read from a direct-mapped table."""
        codes = a * np.int64(self.start + 1) + b
        slots = self._pair_slot(codes)
        known = self.known_pairs[slots]
        lost = known >> 1 != codes
        if lost.any():
            missed = np.unique(codes[lost])
            if len(self.pairs) > MOST_PAIRS:
                self.pairs.clear()
            new = [c for c in missed.tolist() if c not in self.pairs]
            if new:
                split = [divmod(c, self.start + 1) for c in new]
                got = self._alone([("" if x == self.start else self.pieces[x]) + self.pieces[y] for x, y in split])
                self.pairs.update((c, g == ([y] if x == self.start else [x, y])) for c, g, (x, y) in zip(new, got, split))
            good = np.array([self.pairs[c] for c in missed.tolist()])
            self.known_pairs[self._pair_slot(missed)] = missed << 1 | good
            out = known & 1 != 0
            out[lost] = good[np.searchsorted(missed, codes[lost])]
            return out
        return known & 1 != 0

    @staticmethod
    def _pair_slot(codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(43)).astype(np.int64)

    def _piece_places(self, probe: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are those of pieces, and the places of these in the sorted keys."""
        place = self.places[slot]
        hit = self.keys[place] == probe
        rest = np.flatnonzero(~hit)  # a slot of two pieces shows one of them
        place[rest] = np.minimum(np.searchsorted(self.keys, probe[rest]), len(self.keys) - 1)
        hit[rest] = self.keys[place[rest]] == probe[rest]
        return np.flatnonzero(hit), place[hit]

    def _equal_width(self, words: list[str], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of one width in a row, and how many each has; shorter words are filled up with a character of no piece."""
        n = len(words)
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.full((width, n), 1 << 40, np.uint64)  # position by position, so that what is found is in the order of its begin
        chars.T[np.arange(width) < sizes[:, None]] = text
        # substrings that begin as no piece does are not made longer
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        flat, at = chars.ravel(), np.arange(n * width)
        h = np.zeros(n * width, np.uint64)
        for size in range(1, min(self.longest, width) + 1):
            h = h * BASE + flat[at + (size - 1) * n]
            slot = self._slot(h).astype(np.int64)
            whole = np.flatnonzero(self.seen[slot])
            hit, place = self._piece_places(h[whole], slot[whole])
            where = at[whole[hit]]
            found.append((where, self.key_ids[place], np.searchsorted(where, np.arange(width + 1) * n)))
            more = np.flatnonzero(self.alive[slot[: np.searchsorted(at, (width - size) * n)]])
            h, at = h[more], at[more]
            if not len(at):
                break
        last = np.full((width + 1, n), self.start, np.int64)
        # after a character of no piece, a piece stands as at the start of a word
        ahead = np.full((width + 1, n), self.start, np.int64)
        back = np.ones((width + 1, n), np.int64)
        for end in range(1, width + 1):
            best, piece = np.zeros(n, np.int64), np.full(n, self.unknown, np.int64)
            for size in range(min(len(found), end), 0, -1):
                where, ids, edges = found[size - 1]
                lo, hi = edges[end - size], edges[end - size + 1]
                if lo == hi:
                    continue
                rows, ids = where[lo:hi] - (end - size) * n, ids[lo:hi]
                free = best[rows] == 0
                rows, ids = rows[free], ids[free]
                if len(rows):
                    ok = self._may_follow(ahead[end - size][rows], ids)
                    best[rows[ok]], piece[rows[ok]] = size, ids[ok]
            last[end], back[end] = piece, np.maximum(best, 1)
            ahead[end] = np.where(piece == self.unknown, self.start, piece)
        # all words walk back together; a walk ends at position 0
        at, all_rows = sizes.copy(), np.arange(n)
        steps = []
        while at.any():
            steps.append(np.where(at > 0, last[at, all_rows], -1))
            at = np.where(at > 0, at - back[at, all_rows], 0)
        walked = np.stack(steps[::-1], axis=1) if steps else np.zeros((n, 0), np.int64)
        kept = walked >= 0
        flat, counts = walked[kept], kept.sum(axis=1)
        odd = np.flatnonzero((walked == self.unknown).any(axis=1)).tolist()
        if odd:
            ends, parts, begin = np.cumsum(counts), [], 0
            for k in odd:
                own = self._bytes_for(words[k], flat[ends[k] - counts[k] : ends[k]].tolist())
                parts += [flat[begin : ends[k] - counts[k]], np.array(own, np.int64)]
                begin, counts[k] = ends[k], len(own)
            flat = np.concatenate([*parts, flat[begin:]])
        return flat, counts

    def _bytes_for(self, word: str, ids: list[int]) -> tuple[int, ...]:
        """The ids with those of the UTF-8 bytes in place of each character of no piece."""
        got, at = [], 0
        for i in ids:
            if i == self.unknown:
                got += [self.byte_ids[x] for x in word[at].encode("utf-8", "replace")]
                at += 1
            else:
                got.append(i)
                at += len(self.pieces[i])
        return tuple(got)

    def _long(self, word: str) -> tuple[int, ...]:
        """One word too long for a batch, by the same rule position by position."""
        last, back = [self.start], [0]
        for end in range(1, len(word) + 1):
            piece, took = self.unknown, 1
            for size in range(min(self.longest, end), 0, -1):
                i = self.ids.get(word[end - size : end])
                if i is not None:
                    before = self.start if last[end - size] == self.unknown else last[end - size]
                    code = before * (self.start + 1) + i
                    good = self.pairs.get(code)
                    if good if good is not None else self._may_follow(np.array([before]), np.array([i]))[0]:
                        piece, took = i, size
                        break
            last.append(piece)
            back.append(took)
        got, at = [], len(word)
        while at:
            got.append(last[at])
            at -= back[at]
        return self._bytes_for(word, got[::-1])

    def _learn(self, words: set[str]) -> None:
        words = sorted(words, key=len)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        widths = np.where(sizes <= 8, sizes, np.where(sizes <= 32, -(-sizes // 4) * 4, -(-sizes // 32) * 32))
        begin = 0
        while begin < len(words):
            width = int(widths[begin])
            if width > LONG_WORD:
                self.words.add_lists(words[begin:], [self._long(w) for w in words[begin:]])
                break
            end = min(begin + max(1, MOST_CELLS // width), int(np.searchsorted(widths, width, "right")))
            part = words[begin:end]
            self.words.add(part, *self._equal_width(part, sizes[begin:end], width))
            begin = end

    def _rows(self, words: list[str]) -> np.ndarray:
        """The place of every word in the current table, which gets those it lacks; when it is full, words in use move on to a new one, the others go with the old one."""
        rows = np.fromiter(map(self.words.index.get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(rows < 0)
        if not len(lost):
            return rows
        lacking = [words[k] for k in lost.tolist()]
        new = set(lacking)
        if len(self.words.index) + len(new) > MOST_WORDS:
            self.old, self.words = self.words, _Words()
            lost, lacking, new = np.arange(len(words)), words, set(words)
        again = [w for w in new if w in self.old.index]
        self.words.add(again, *self.old.ids(again))
        new.difference_update(again)
        runs = [w for w in new if w[-1] == SPACE]  # a word ends in its space only if it is a run of them
        self.words.add_lists(runs, self._alone(runs))
        self._learn(new.difference(runs))
        rows[lost] = np.fromiter(map(self.words.index.__getitem__, lacking), np.int64, len(lacking))
        return rows

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each end."""
        cut = [self.split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = list(chain.from_iterable(cut))
        ends = np.cumsum(np.array([len(x) for x in cut], np.int64))
        del cut
        rows = self._rows(words)
        starts, sizes, flat = self.words.spans()
        begin, size = starts[rows], sizes[rows]
        lone = self.ids.get(SPACE)
        if lone is not None and len(rows):
            # the last space of a run belongs to its word unless it stays alone there: then it belongs to the run
            joins = np.nonzero(flat[begin] == lone)[0]
            joins = joins[(joins > 0) & ~np.isin(joins, ends)]
            joined = [j for j in joins.tolist() if not words[j - 1].strip(SPACE) and words[j].strip(SPACE)]
            if joined:
                longer = [words[j - 1] + SPACE for j in joined]
                kept, at = self.words, np.array(joined)
                places = self._rows(longer)
                if self.words is not kept:  # the tables turned: read all rows again
                    places, rows = np.split(self._rows([*longer, *words]), [len(longer)])
                rows[at - 1] = places
                starts, sizes, flat = self.words.spans()
                begin, size = starts[rows], sizes[rows]
                begin[at] += 1
                size[at] -= 1
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        return _gathered(flat, begin, size), sums[ends]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, ends = self.encode_flat(texts)
        ends = ends.tolist()
        return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of runs of ids."""
        size = self.piece_sizes[ids]
        raw = _gathered(self.piece_bytes, self.piece_starts[ids], size).tobytes()
        to = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])[ends].tolist()
        out = [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *to[:-1]], to)]
        return [x[1:] if x[:1] == " " else x for x in out]

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.array(ids, np.int64), np.array([len(ids)]))[0]


class _Words:
    """Words and their ids, packed in one growing array."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.starts, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """ids: of all the words in a row."""
        n, total = len(self.index), len(ids)
        while n + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = ids
        self.starts[n + 1 : n + len(words) + 1] = self.used + np.cumsum(sizes)
        self.used += total
        self.index.update(zip(words, range(n, n + len(words))))

    def add_lists(self, words: list[str], ids: list) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        self.add(words, np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the words in a row, and how many each has."""
        rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = self.starts[rows + 1] - self.starts[rows]
        return _gathered(self.flat, self.starts[rows], sizes), sizes

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.index)
        return self.starts[:n], np.diff(self.starts[: n + 1]), self.flat


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans flat[begin : begin + size], one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + size, size)]


#: The coder of this worker process, by the digest of its model: it keeps its words from task to task.
_CODERS: dict[str, Viterbi] = {}


def shared(model: bytes) -> Viterbi:
    """The coder of this worker process; that of another model is dropped."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Viterbi(model)
    return _CODERS[key]


def slices(batch: pa.RecordBatch, column: str, most_chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of at most so many characters of text (at least one row), with their texts."""
    begin, held, texts = 0, 0, []
    values = batch.column(column)
    for k in range(batch.num_rows):
        t = values[k].as_py() or ""
        if texts and held + len(t) > most_chars:
            yield batch.slice(begin, k - begin), texts
            begin, held, texts = k, 0, []
        texts.append(t)
        held += len(t)
    if texts:
        yield batch.slice(begin), texts


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256, round_trip: one row per input row.

    ids are those of the model's library, without begin or end. decoded_sha256 is of
    the text decoded from them; round_trip tells whether it equals the text (a text
    that holds the model's own space sign does not come back). A null or empty text
    has no ids and comes back empty. Equal rows get equal results. No rows, no rows.
    """
    with open(model_file, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # of the model's size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for part, texts in slices(batch, "text"):
                coder = coder or shared(held.value)
                ids, ends = coder.encode_flat(texts)
                back = coder.decode_flat(ids, ends)
                offsets = np.concatenate([np.zeros(1, np.int64), ends])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in back]), pa.array([a == b for a, b in zip(back, texts)], pa.bool_())],
                    names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode_documents(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts of lists of ids; null ids give the empty text."""
    with open(model_file, "rb") as f:
        held = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or shared(held.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([coder.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
