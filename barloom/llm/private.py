r"""Personal data: fixed patterns, and terms that reveal the entities they stand beside.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each found
value is a protected entity e. Terms t within WINDOW words of an entity are its
context. Over the whole corpus, with document frequencies df and N documents,

    PMI(e, t) = log(P(e | t) / P(e)),   IC(e) = -log P(e),   P(e) = df(e) / N,
    P(e | t) = (df(e, t) + PRIOR P(e)) / (df(t) + PRIOR).

PMI / IC is the share of e's information that t reveals: near 1 if t never stands
without e. A term at or above REMOVE is removed, one at or above GENERALISE is
generalised to its class, at all its places in every document that holds the entity beside it. Every
observed pair is scored: PRIOR imagined documents with t, which hold e as often as
any, make a rare pair count for less and never for nothing. Copies of one context
are one observation: df(e, t) and df(t) are scaled by contexts a document.

Scale. One map over the scan finds spans and contexts; texts without a digit or
`@` cost one search. Pairs are rows of (entity, term) near entities only, counted
with aggregation before the shuffle. Corpus frequencies are counted for candidate
terms only; these are broadcast if counted to be at most BROADCAST_TERMS.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, text_of, words_of
from barloom.llm.pieces import slices

WINDOW = 8
#: Imagined documents with each term, by which P(e | t) is drawn towards P(e).
PRIOR = 1.0
GENERALISE, REMOVE = 0.75, 0.9
BROADCAST_TERMS = 500_000
KINDS = ("email", "ip", "card", "phone", "general", "removed")

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = string.punctuation


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of the e-mail pattern, in linear time: a match is decided by its @ alone."""
    end = 0
    at = text.find("@")
    while at >= 0:
        head = text[end:at]
        start = at - (len(head) - len(head.rstrip(_LOCAL)))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed in KINDS, then start."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _contexts(text: str, spans: list[tuple[str, int, int]], window: int) -> list[dict]:
    """For each entity, the terms within so many words on either side: entity, term, start, end, context."""
    if not spans:
        return []
    out = []
    inside = sorted((a, b) for _, a, b in spans)
    for kind, a, b in spans:
        value = text[a:b].lower() if kind == "email" else "".join(c for c in text[a:b] if c.isdigit() or c == ".")
        near = [(m.start(), m.end()) for m in _words_before(text, a, window)] + [(m.start(), m.end()) for m in _words_after(text, b, window)]
        terms = []
        for s, e in near:
            w = text[s:e]
            s2 = s + len(w) - len(w.lstrip(_EDGE))
            e2 = e - (len(w) - len(w.rstrip(_EDGE)))
            if e2 - s2 >= 3 and any(c.isalpha() for c in text[s2:e2]) and not any(x < e2 and s2 < y for x, y in inside):
                terms.append((text[s2:e2].lower(), s2, e2))
        context = hashlib.md5(" ".join(t for t, _, _ in terms).encode("utf-8", "replace")).hexdigest()
        out += [{"entity": f"{kind}:{value}", "term": t, "s": s, "e": e, "context": context} for t, s, e in terms]
    return out


def _occurrences(text: str, near: list[dict]) -> list[dict]:
    """All places of the terms of `near` in a text: term, s, e, outside the found values' own words as in the contexts."""
    wanted = {x["term"] for x in near}
    if not wanted:
        return []
    out = []
    for m in _WORD.finditer(text):
        w = m[0]
        s, e = m.start() + len(w) - len(w.lstrip(_EDGE)), m.end() - (len(w) - len(w.rstrip(_EDGE)))
        if s < e and text[s:e].lower() in wanted:
            out.append({"term": text[s:e].lower(), "s": s, "e": e})
    return out


def _words_after(text: str, at: int, window: int) -> list[re.Match]:
    out = []
    for m in _WORD.finditer(text, at):
        if m.start() > at or not text[at : at + 1].strip():
            out.append(m)
        if len(out) >= window:
            break
    return out


def _words_before(text: str, at: int, window: int) -> list[re.Match]:
    """The last words that end before `at`: the stretch looked at doubles until it holds enough."""
    reach = 16 * window
    while True:
        begin = max(0, at - reach)
        found = [m for m in _WORD.finditer(text, begin, at) if m.end() < at]
        if begin and found and found[0].start() == begin:
            found = found[1:]
        if len(found) >= window or not begin:
            return found[-window:]
        reach *= 2


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, base (spans joined), n_email, n_ip, n_card, n_phone, base_sha256, near, places (of the terms of near in the whole text): one row per input row."""
    kind = docs.schema[id_col].dataType.simpleString()
    near_type = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("context", pa.string())]))

    place_type = pa.list_(pa.struct([("term", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                spans = [base_spans(t) for t in texts]
                near = [_contexts(t, x, window) for t, x in zip(texts, spans)]
                base = [_joined(x) for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(base, pa.string()), *[pa.array([sum(k == name for k, _, _ in x) for x in spans], pa.int64()) for name in KINDS[:4]],
                     pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array(near, near_type), pa.array([_occurrences(t, x) for t, x in zip(texts, near)], place_type)],
                    names=["doc_id", "base", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "near", "places"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, base string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, near array<struct<entity:string,term:string,s:bigint,e:bigint,context:string>>, places array<struct<term:string,s:bigint,e:bigint>>")


def disclosing(found: DataFrame, docs: DataFrame, text_col: str = "text", prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """entity, term, action for the pairs whose share of revealed information is at least `generalise`. found has row_key."""
    pairs = found.select("row_key", F.explode("near").alias("n")).select("row_key", "n.entity", "n.term", "n.context").distinct()
    seen = cut(pairs.groupBy("entity", "term").agg(F.countDistinct("row_key").alias("both"), F.countDistinct("context").alias("contexts")))
    terms = seen.select("term").distinct()
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    # words at the edges of which punctuation stands are counted without it, as in the contexts
    each = docs.select(F.explode(F.array_distinct(F.transform(words_of(F.lower(text_of(text_col))), lambda w: F.btrim(w, F.lit(_EDGE))))).alias("term"))
    # counted before the join, so that a common term is one row a task and not one a document
    counted = each.groupBy("term").agg(F.count("*").alias("df_t"))
    corpus = counted.join(F.broadcast(terms) if few else terms, "term")
    held = found.select("row_key", F.explode(F.array_distinct(F.transform("near", lambda n: n["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("df_e"))
    n = found.agg(F.count("*").cast("double").alias("n")).scalar()
    chance, once = F.col("df_e") / n, F.least(F.lit(1.0), F.col("contexts") / F.col("both"))
    told = (F.col("both") * once + prior * chance) / (F.greatest("df_t", "both") * once + prior)
    share = F.log(told / chance) / F.nullif(-F.log(chance), F.lit(0.0))
    return seen.join(corpus, "term").join(held, "entity").withColumn("share", share).where(F.col("share") >= generalise).select("entity", "term", F.when(F.col("share") >= remove, "removed").otherwise("general").alias("action"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, prior: float = PRIOR) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per input row.

    spans joins kind:start:end of the base spans and of the terms that reveal an
    entity (kinds general and removed), by kind as in KINDS, then start; positions
    are code points, end exclusive. A null or empty text has no spans (empty string).
    Equal rows get equal spans. No rows in, no rows out.
    """
    found = cut(find(docs, id_col, text_col, window).withColumn("row_key", F.monotonically_increasing_id()))
    told = disclosing(found, docs, text_col, prior)
    near = found.select("row_key", F.explode("near").alias("n")).select("row_key", "n.entity", "n.term").distinct()
    # the strongest action wins where a term stands beside several entities; it holds at every place of the term in the document
    action = near.join(told, ["entity", "term"]).groupBy("row_key", "term").agg(F.max("action").alias("action"))
    places = found.select("row_key", F.explode("places").alias("p")).select("row_key", "p.term", "p.s", "p.e")
    more = places.join(action, ["row_key", "term"]).groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("action", "s", "e"))).alias("more"))
    texts = F.transform(F.coalesce("more", F.expr("cast(array() as array<struct<action:string,s:bigint,e:bigint>>)")), lambda x: F.concat_ws(":", x["action"], x["s"].cast("string"), x["e"].cast("string")))
    base = F.when(F.col("base") == "", F.expr("cast(array() as array<string>)")).otherwise(F.array("base"))
    return found.join(more, "row_key", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.concat_ws(",", F.concat(base, texts)).alias("spans"))


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its class in brackets; overlapping spans become one."""
    marks = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x))
    out, at = [], 0
    for a, b, kind in marks:
        if a >= at:
            out += [text[at:a], "" if kind == "removed" else f"[{kind}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])
