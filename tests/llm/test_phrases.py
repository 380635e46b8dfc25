"""Lexical search, substring dedup and collocations against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trajectra.llm import collocations, lexical, substring_dedup

ODD = [None, "", " \n ", "x", "a b c d e", "\x00\x01\x02", "é ß \U0001f600 " * 30, "w" * 50_000, "same text here again " * 40, "same text here again " * 40, "Zwei, drei; DREI vier! " * 30]


def table(spark, rows):
    """(doc_id, text, lang) with extra columns of names that the operators use themselves."""
    rows = [(d, t, lang, 1, 2, "r", 3.0, b"s") for d, t, lang in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, k int, x long, item string, score double, spans binary")


def odd_rows():
    return [(i if i != 4 else None, t, [None, "en", "und"][i % 3]) for i, t in enumerate(ODD)] + [(8, ODD[8], "en"), (8, ODD[8], "en"), (9, "other text of one id " * 30, None)]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# lexical search


def plain_search(docs, items, k=10):
    """docs: (doc_id, text), items: (item_id, text)."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    split = [(d, Counter(terms(t))) for d, t in docs]
    split = [(d, c, sum(c.values())) for d, c in split if c]
    n_docs, n_terms = len(split), sum(n for _, _, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in wanted.items():
        found = []
        for d, c, n in split:
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if score > 0:
                found.append((-score, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


def test_search_equals_plain_search(spark):
    rng = random.Random(3)
    words = ["The", "of", "é", "x1"] + [f"w{i}" for i in range(60)]
    docs = [(rng.randrange(400), " ".join(rng.choices(words, weights=[30, 20, 5, 5] + [1] * 60, k=rng.choice([0, 1, 5, 40, 400]))), "en") for _ in range(600)]
    docs += odd_rows()
    items = [(i, " ".join(rng.sample(words, 8)) + "!") for i in range(30)] + [(30, None), (31, " ,"), (5, "second row of item w1"), (None, "the same text"), (33, "absentword")]
    queries = spark.createDataFrame([(i, t, 1, 5) for i, t in items], "item_id long, text string, q int, rank int")
    expected = plain_search([(d, t) for d, t, _ in docs], items)
    found = lexical.search(table(spark, docs).repartition(3), queries)
    assert Counter(map(tuple, found.collect())) == expected and sum(expected.values()) > 250
    assert Counter(map(tuple, lexical.search(table(spark, docs), queries, terms_a_block=40).collect())) == expected
    empty = table(spark, docs).where("false")
    assert lexical.search(empty, queries).count() == 0 and lexical.search(table(spark, docs), queries.where("false")).count() == 0


def test_pivots_skip_documents_and_small_shards_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n, v = 20_000, 500
    lists = [np.unique(rng.zipf(1.3, 30)[rng.zipf(1.3, 30) < v] % v) for _ in range(n)]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    terms, tfs = np.concatenate(lists), np.ones(ends[-1], np.int64)
    df = np.bincount(terms, minlength=v)
    weights = np.append(np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))), 0).astype(np.int64)
    lengths = np.diff(ends)
    items = [np.sort(rng.choice(v, 12, replace=False)) for _ in range(20)]
    item_ids, item_ends = np.concatenate(items), np.arange(0, 252, 12)

    def run(cuts):
        best, scored = lexical.Heaps(20, 10), 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            shard = lexical.Shard(np.arange(a, b) * 7 % n, lengths[a:b], ends[a : b + 1] - ends[a], terms[ends[a] : ends[b]], tfs[ends[a] : ends[b]], weights, n, int(ends[-1]))
            scored += lexical.search_shard(shard, item_ids, item_ends, best)
        return best, scored

    (one, scored), (many, _) = run([0, n]), run([0, 100, 5_000, 5_001, 12_000, n])
    assert (one.scores == many.scores).all() and (one.ids == many.ids).all()
    shard = lexical.Shard(np.arange(n) * 7 % n, lengths, ends, terms, tfs, weights, n, int(ends[-1]))
    for i, item in enumerate(items):
        full = np.zeros(n, np.int64)
        for t in item:
            full[shard.docs[shard.starts[t] : shard.ends[t]]] += shard.impacts[shard.starts[t] : shard.ends[t]]
        order = np.lexsort((shard.ids, -full))[:10]
        assert (one.scores[i] == full[order]).all() and (one.ids[i] == shard.ids[order]).all()
    met = sum(len(np.unique(np.concatenate([shard.docs[shard.starts[t] : shard.ends[t]] for t in item]))) for item in items)
    assert scored < 0.5 * met


# substring dedup


def plain_dedup(docs, window):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    size = lambda d: math.inf if d is None else d
    first: dict = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            first[s] = min(first.get(s, math.inf), size(d))
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < size(d) for j in range(i, i + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return Counter(out)


def made_repeats(rng, n, window):
    passages = [[rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(6)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(passages)[rng.choice([0, 0, 1, 3]) :] if rng.random() < 0.6 else [f"u{rng.randrange(99)}" for _ in range(rng.randrange(9))]
        docs.append((rng.choice([i, i, i // 2]), rng.choice([" ", "\n", "\t "]).join(words), "en"))
    return docs + [(-5, "ha " * (3 * window), "en"), (900, "ha " * (2 * window + 1), "en"), (901, "ha " * (window - 1), "en")]


@pytest.mark.parametrize("window", [2, 8, 50])
def test_removed_words_equal_plain_dedup(spark, window, monkeypatch):
    docs = made_repeats(random.Random(window), 150, window) + odd_rows()
    expected = plain_dedup([(d, t) for d, t, _ in docs], window)
    df = table(spark, docs).repartition(5)
    digest = lambda out: Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect())
    found = substring_dedup.dedup_passages(df, window)
    assert digest(found) == expected and sum(e[2] for e in expected.elements()) > 300
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in found.collect())
    # Slices of a few words and groups sorted in parts, and tables too large to broadcast, give the same.
    for name, value in (("SLICE_WORDS", 2 * window + 7), ("SLICE_BYTES", 3_000), ("SORTED_AT_ONCE", 5), ("BROADCAST_BYTES", -1), ("HASHED_BYTES", 64)):
        monkeypatch.setattr(substring_dedup, name, value)
    assert digest(substring_dedup.dedup_passages(df, window)) == expected


def test_substring_dedup_of_empty_tables_and_odd_windows(spark):
    empty = table(spark, odd_rows()).where("false")
    assert substring_dedup.dedup_passages(empty).count() == 0
    assert substring_dedup.dedup_passages(table(spark, [(1, None, None)])).collect() == [(1, 0, 0, [], "")]
    with pytest.raises(ValueError):
        substring_dedup.dedup_passages(empty, 7)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé \n\x0b\x1c", max_size=40), min_size=1, max_size=6))
def test_word_hashes_tell_words_apart(texts):
    words = substring_dedup.Words([t.encode() for t in texts], 2)
    split = [t.encode().split() for t in texts]
    assert np.diff(words.bounds).tolist() == [len(w) for w in split]
    for hashes in words.hashes:
        seen = dict(zip(hashes.tolist(), (x for w in split for x in w), strict=True))
        assert len(seen) == len({x for w in split for x in w}) and [seen[h] for h in hashes.tolist()] == [x for w in split for x in w]


# collocations


def plain_collocations(docs, least, top, max_n=3, percent=50):
    totals, counts = Counter(), {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, max_n + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in counts.items():
        good = {p: f for p, f in c.items() if f >= least}
        rows = []
        for p, a in good.items():
            if len(p) == 1:
                continue
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * f >= percent * a for q, f in good.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, totals[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize("max_n", [2, 3, 4])
def test_collocations_equal_plain_counts(spark, max_n, monkeypatch):
    rng = random.Random(max_n)
    docs = []
    for i in range(250):
        words = [rng.choice(["New York", "new york city", "in the", "été x", "a", "b", "c", "\x1c", f"r{rng.randrange(300)}"]) + rng.choice([" ", "\t", " ", ", ", "\r\n"]) for _ in range(rng.randrange(40))]
        docs.append((i, "".join(words), rng.choice(["en", "en", "fr", None, "und"])))
    docs += odd_rows()
    expected = plain_collocations([(lang, t) for _, t, lang in docs], 5, 40, max_n)
    df = table(spark, docs).repartition(3)
    assert Counter(map(tuple, collocations.collocations(df, max_n, 5, 50, 40, bits=1 << 16).collect())) == expected and len(expected) > 60
    # A map with few bits lets others pass, which changes nothing; nor do counts that are given on early.
    monkeypatch.setattr(collocations, "PHRASES_HELD", 20)
    assert Counter(map(tuple, collocations.collocations(df, max_n, 5, 50, 40, bits=64).collect())) == expected


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_007, 4_000_000_000_000, 5_000_000_000
    grams = spark.createDataFrame([("en", "p", 1, left), ("en", "q", 1, right), ("en", "p q", 2, a)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    row = collocations.scored(grams, totals, 50, None).first()
    assert row.score == 1_000_000 * a * a // (left * right) and (row.l, row.r, row.n) == (left, right, 10**14)


def test_collocations_of_empty_tables(spark):
    assert collocations.collocations(table(spark, odd_rows()).where("false")).count() == 0
    assert collocations.collocations(table(spark, [(1, None, None), (2, "x y", "en")])).count() == 0
