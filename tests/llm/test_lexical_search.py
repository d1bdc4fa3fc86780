"""Ranked lexical search: brute force over random texts in many small blocks, odd rows, pruning, and the SQL twin."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import compare, connect

from tidemark.llm import lexical_search as ls
from tidemark.llm import queries

DOCS = "doc_id long, text string, item_id string, score int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    rows = []
    for i, ts in asked.items():
        df = {t: sum(t in c for _, c in counts) for t in ts}
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in ts}
        scored = []
        for d, c in counts:
            m = 50 + 50 * c.total() * n // total
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        rows += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(scored[:top])]
    return sorted(rows, key=str)


def got(spark, docs, items, **kw):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id long")
    return sorted((tuple(r) for r in ls.search(df, asked, **kw).collect()), key=str)


def some_texts(rng, n):
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Ünï", "B-c", "3d", "日本"]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 30, 30, 200]))) for _ in range(n)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_POSTINGS", 300)
    monkeypatch.setattr(ls, "BLOCK_DOCS", 30)
    monkeypatch.setattr(ls, "ITEM_BLOCK", 7)
    rng = random.Random(2)
    texts = some_texts(rng, 500)
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[3]) for i in range(120)] + [(5, "w1 w1 w2"), (5, "w1 w1 w2"), (None, "w1 w2 w9"), (7000, None), (7001, " .- ")]
    items = [(i, t) for i, t in enumerate(some_texts(rng, 20))] + [(3, "w1 W2 w2"), (None, "w1"), (90, None), (91, "nowhere"), (92, "")]
    want = plain(docs, items)
    assert got(spark, docs, items) == want
    assert got(spark, docs, items, top=3) == plain(docs, items, 3)


def test_empty(spark):
    assert got(spark, [], [(1, "a")]) == []
    assert got(spark, [(1, "a")], []) == []
    assert got(spark, [(1, None)], [(1, "a")]) == []


def test_a_long_text_is_cut_between_terms():
    text = ("Ab-c " * 700_000 + "x" * 3_000_000 + " é").encode()
    assert ls.terms(text) == {b"ab": 700_000, b"c": 700_000, b"x" * 3_000_000: 1, "é".encode(): 1}


def test_strata_below_the_floor_are_left_out():
    """Strata whose bound is below the floor are never scored: their documents could hold anything."""
    rng = np.random.default_rng(0)
    m = np.sort(rng.integers(50, 400, 3000))
    doc_of = np.repeat(np.arange(3000), 4)
    term, tf = rng.integers(0, 40, len(doc_of)), rng.integers(1, 6, len(doc_of))
    keep = np.unique(doc_of * 40 + term, return_index=True)[1]
    doc_of, term, tf = doc_of[keep], term[keep], tf[keep]
    _, _, body = ls._body(np.arange(3000), m, doc_of, term.astype(np.int32), tf)
    weight, item = rng.integers(1, 5000, 40), np.arange(0, 40, 3)
    score = np.zeros(3000, np.int64)
    wanted = np.isin(term, item)
    np.add.at(score, doc_of[wanted], (weight[term] * ls.impact(tf, m[doc_of]))[wanted])
    order = np.lexsort((np.arange(3000), -score))[:50]
    for floor in (1, int(score[order[20]])):
        [(_, docs, scores)] = ls._score(body, [item], [0], np.array([floor]), weight, 50)
        found = sorted(zip((-scores).tolist(), docs.tolist()))
        assert found == [(-int(score[d]), int(d)) for d in order if score[d] >= floor]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql_twin(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    df = queries.QUERIES["op12_ranked_search"](spark, sf_dir)
    assert compare(df.columns, [tuple(r) for r in df.collect()], connect(sf_dir), queries.SQL["op12_ranked_search"]) == ""
