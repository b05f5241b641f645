"""The training-data operators against brute force, on a small table with every edge case."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from barloom.llm import exact, jaccard, licences, mixing, perplexity, pieces, private, rules, suffixes, token_counts
from barloom.llm.queries import PIECE_MODEL, WORD_MODEL, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, words string, block string, payload string"
WHITE = re.compile(r"[\x20\x09-\x0D]")


def rows():
    rng = random.Random(3)
    vocabulary_ = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary_) for _ in range(n))
    texts = [prose(rng.randint(5, 150)) for _ in range(60)]
    passage = prose(60)
    texts += [texts[0], texts[0] + " ", texts[1].replace(" ", "\n"), prose(30) + " " + passage + " " + prose(30), passage + prose(20), prose(5) + passage]
    texts += [texts[2] + " x", texts[2] + " y z", None, "", " \n", "one two", "a" * 3000, "ab " * 900, prose(20000), "mail a.b@c.de or +49 (30) 123-4567 or 1.2.3.4 or 4111 1111 1111 1111 or 999.1.1.1"]
    texts += ["Licensed under the Apache License, Version 2.0.\n" + prose(40), "日本語 <|endoftext|> it's \U00013000\x00 ▁ x"]
    out = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s1", None]), 1, "k", "w", "b", "p") for k, t in enumerate(texts)]
    return out + [out[5], out[5], (None, texts[3], "en", "s1", 1, "k", "w", "b", "p")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(spark, which):
    return spark.createDataFrame([(x,) for x in which], "_trusted long")


def test_empty_tables(spark, empty):
    none = ids(spark, [])
    for df in (pieces.encode_documents(empty, vocabulary(PIECE_MODEL)), jaccard.jaccard_join(empty), exact.exact_duplicates(empty), token_counts.count_tokens(empty, vocabulary(WORD_MODEL)), rules.quality(empty, none), perplexity.classify(empty, none), private.sanitise(empty), licences.scan(empty), suffixes.remove_repeats(empty), mixing.mix(empty)):
        assert df.collect() == []


def test_pieces(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_MODEL))
    coded = pieces.encode_documents(docs, vocabulary(PIECE_MODEL))
    got = collections.Counter((r.doc_id, tuple(r.ids), r.round_trip) for r in coded.collect())
    want = collections.Counter((r[0], tuple(library.encode(r[1] or "")), "▁" not in (r[1] or "")) for r in rows())
    assert got == want
    back = collections.Counter((r.doc_id, r.text) for r in pieces.decode_documents(coded, vocabulary(PIECE_MODEL)).collect())
    assert back == collections.Counter((r[0], (r[1] or "").replace("▁", " ")) for r in rows())


def test_token_counts(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(WORD_MODEL))
    got = collections.Counter(tuple(r) for r in token_counts.count_tokens(docs, vocabulary(WORD_MODEL)).collect())
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert got == collections.Counter((r[0], len((r[1] or "").encode()), n(r[1] or ""), n(r[1] or "") > 2048) for r in rows())


def test_exact(docs):
    got = exact.exact_duplicates(docs, block_bytes=64).collect()
    groups = collections.defaultdict(list)
    for r in rows():
        groups[WHITE.sub("", r[1] or "")].append((-len(r[1] or ""), r[0]))
    least = {k: min(v, key=lambda x: (x[0], x[1] is not None, x[1] or 0)) for k, v in groups.items()}
    want = collections.Counter()
    for r in rows():
        k = WHITE.sub("", r[1] or "")
        want[(r[0], least[k][1], len(groups[k]), (-len(r[1] or ""), r[0]) == least[k], hashlib.sha256(k.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_jaccard(docs):
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs, tile=2).collect()}
    sets = {}
    for r in rows():
        w = (r[1] or "").encode().split()
        sets[r[0]] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    classes = collections.defaultdict(list)
    for k, s in sets.items():
        classes[s].append(k)
    for s, members in classes.items():
        links = sum(1 for t in classes if t and s and t != s and len(s & t) >= 0.8 * len(s | t))
        for k in members:
            assert (got[k].n_links, got[k].class_id) == (links, min(x for x in members if x is not None)), k


def test_quality_counts(spark, docs):
    got = {r.doc_id: r for r in rules.quality(docs, ids(spark, range(0, 60, 2))).collect()}
    for r in rows():
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = list(zip(words, words[1:], words[2:]))
        times = collections.Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    kept = rules.keep_good(docs, ids(spark, range(0, 60, 2)))
    assert kept.columns == docs.columns and kept.count() == rules.quality(docs, ids(spark, range(0, 60, 2))).where("kept").count()


def test_perplexity(spark):
    texts = ["abcabcabd", "abcab", "xyz abc", "", "ab"]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.perplexity for r in perplexity.perplexities(df, ids(spark, [0, 1])).collect()}
    for k, t in enumerate(texts):
        if t:
            assert got[k] == pytest.approx(_kneser_ney(["abcabcabd", "abcab"], t), rel=1e-4)
        else:
            assert got[k] is None


def _kneser_ney(trained, text, order=5):
    grams = lambda t: [("\0" * (order - 1) + t)[k : k + order] for k in range(len(t))]
    counts = {order: collections.Counter(g for t in trained for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, c in counts.items():
        n = [sum(x == j for x in c.values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        raw = [None if y is None or not n[j] else j - (j + 1) * y * n[j + 1] / n[j] for j in (1, 2, 3)]
        discounts[k] = [m / 2 if d is None else max(0.1, min(d, m)) for d, m in zip(raw, (0.95, 1.95, 2.95))]

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / 4096
        same = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        if not same:
            return below
        total, off = sum(same.values()), lambda n: discounts[k][min(n, 3) - 1]
        return (same[g] - off(same[g]) if g in same else 0) / total + sum(map(off, same.values())) / total * below

    return np.exp(-np.mean([np.log(p(g)) for g in grams(text)]))


def test_personal_data(docs):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(5)
    strange = ["".join(rng.choice("a1.@+- 4(") for _ in range(40)) for _ in range(3000)]
    for text in strange + [r[1] or "" for r in rows()]:
        want = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and private._luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15):
                    want.append((kind, m.start(), m.end()))
        assert private.base_spans(text) == want, text
    row = next(r for r in private.sanitise(docs).collect() if r.n_email)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)


def test_disclosing_terms(spark):
    texts = [f"call wood{k} zebra x@y.example under{k} now" for k in range(6)] + [f"plain words number {k} call now" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in private.sanitise(df).collect()}
    at = texts[0].index("zebra")
    assert f"removed:{at}:{at + 5}" in spans[0] and "general" not in spans[0] and spans[10] == ""
    assert private.redact(texts[0], spans[0]) == texts[0].replace("zebra", "").replace("x@y.example", "[email]")


def test_disclosing_rare_terms(spark):
    """Entities of one document, and of copies of it: no pair is too rare to be scored."""
    texts = ["call plain zebra x@y.example now"] + ["call plain walrus u@v.example now"] * 2 + [f"plain words number {k} call now" for k in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in private.sanitise(df).collect()}
    share = 1 - np.log((1 + 1) / (1 + 1 / 2003)) / np.log(2003)
    assert private.REMOVE <= share and spans[0] == "email:17:28,removed:11:16"
    copied = 1 - np.log((1 + 1) / (1 + 2 / 2003)) / np.log(2003 / 2)
    assert private.REMOVE > copied >= private.GENERALISE and spans[1] == spans[2] == "email:18:29,general:11:17" and spans[3] == ""


def test_licences(spark):
    data = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x", "nothing here"), (3, "a/b/y", "word " * 30 + "\nLicensed under CC BY-NC 4.0."), (4, "c/z", None), (5, None, "All rights reserved.")]
    df = spark.createDataFrame(data, "doc_id long, path string, text string")
    got = {r.doc_id: (r.own_licence, r.licence, r.inherited_from) for r in licences.scan(df, path=df["path"]).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "MIT", "a"), 3: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 4: (None, None, None), 5: ("LicenseRef-Proprietary", "LicenseRef-Proprietary", None)}


def test_licence_lines(spark):
    """Every line is compared: scores against all lines by brute force."""
    terms = lambda t: [w for w in (x.strip(".-") for x in re.split(r"[^\w.\-]+", t.lower())) if w]
    rng = random.Random(8)
    texts = ["under CC BY-NC 4.0", "CC BY-NC 4.0", "public domain, CC0 1.0", "GNU Lesser General Public Licence, version 3", "Dedicated to the public domain under CC0 1.0"]
    for _ in range(60):
        words = rng.choice(licences.TEMPLATES[:13])[1].split()
        texts.append(" ".join(rng.sample(words, rng.randint(1, len(words))) + ["other"] * rng.randint(0, 2)))
    texts += ["the of and to in by any other text"] * 40 + ["text " * 500 + "\n" + x for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.own_score for r in licences.scan(df).collect()}
    known = [collections.Counter(terms(x[1])) for x in [*licences.TEMPLATES, *licences.full_texts()]]
    held = collections.Counter(t for x in texts for t in set(terms(x)))
    idf = lambda t: np.log((len(texts) + 1) / (held[t] + 1)) + 1 if any(t in k for k in known) else np.log(len(texts) + 1) + 1
    vectors = lambda c: {t: k * idf(t) for t, k in c.items()}
    norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
    sides = [(v, norm(v)) for v in map(vectors, known)]
    for k, text in enumerate(texts):
        scores = [0.0]
        for line in {text, *text.split("\n")}:
            v = vectors(collections.Counter(terms(line)))
            scores += [sum(x * w.get(t, 0) for t, x in v.items()) / (n * norm(v)) for w, n in sides]
        assert got[k] == (pytest.approx(max(scores), abs=2e-6) if max(scores) >= licences.SIMILAR else None), text
    assert got[0]


def test_licence_files(spark):
    """Standard licence files of any length speak for their directories."""
    texts = dict(licences.full_texts())
    data = [(f"{k}/LICENSE", "Copyright (c) 2020 Some Body and others\n\n" + texts[k].replace("\n", " ").replace(". ", ".\n")) for k in texts] + [(f"{k}/src/x", "nothing here") for k in texts]
    df = spark.createDataFrame(data, "path string, text string").selectExpr("path AS doc_id", "path", "text")
    got = {r.doc_id: (r.licence, r.inherited_from) for r in licences.scan(df, path=df["path"]).collect()}
    for k in texts:
        assert got[f"{k}/LICENSE"] == (k, None) and got[f"{k}/src/x"] == (k, k)


def test_suffixes(docs):
    got = collections.Counter(tuple(r) for r in suffixes.remove_repeats(docs).collect())
    order = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    first, want = {}, collections.Counter()
    key = lambda r: 2**63 if r[0] is None else r[0]
    for r in order:
        b = (r[1] or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], key(r))
    for r in order:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(r):
                gone[p : p + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(r[0], len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    assert got == want


def test_multikey_order():
    words = np.random.default_rng(1).integers(0, 3, (500, 4)).astype(np.uint64)
    got = words[suffixes.multikey_order(words)]
    assert (got == words[np.lexsort(words.T[::-1])]).all()


def test_mixing(spark):
    rng = random.Random(1)
    data = [(k, "w " * rng.randint(1, 40), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(2000)] + [(9999, None, "a")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    a, b = (mixing.mix(df, block_docs=64, shards=5).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2))
    assert a.astype(str).equals(b.astype(str)) and len(a) == len(data)
    a["source"] = [x[2] or "~" for x in sorted(data)]
    sums = a.groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sums["size"] == sums.told).all() and (abs(sums.taken - sums.target) <= 40).all() and a.copies.max() <= 3
    weights, left, total = dict(zip(sorted(sums.index), (1, 2, 3, 1))), dict.fromkeys(sums.index, 0.0), float(sums.told.sum())
    capped: set = set()
    while True:
        rest = total - sum(3 * sums.told[s] for s in capped)
        free = sum(w for s, w in weights.items() if s not in capped)
        left = {s: 3 * sums.told[s] if s in capped else rest * weights[s] / free for s in weights}
        over = {s for s in weights if s not in capped and left[s] > 3 * sums.told[s]}
        if not over:
            break
        capped |= over
    assert all(abs(left[s] - sums.target[s]) < 1e-6 for s in weights)
    quotas = mixing.split_quotas(np.array([7, 0, 30]), 4, np.random.default_rng(1))
    assert quotas.sum(axis=0).tolist() == [7, 0, 30] and quotas.sum(axis=1).max() - quotas.sum(axis=1).min() <= 1
