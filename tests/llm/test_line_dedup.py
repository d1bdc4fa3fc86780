"""Line removal by patience alignment: goldens and invariants."""

import random

import numpy as np

from tidemark.llm import line_dedup
from tidemark.llm.line_dedup import _cut, align, dedup_lines


def cut(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string").repartition(3)
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(df, **kw).collect()), key=str)


LONG = [f"line {i} of a passage with some more words {i}" for i in range(9)]


def test_blocks_of_the_later_document_go(spark):
    a = "\n".join(["own head of a", *LONG, "own tail of a"])
    b = "\n".join(["another head", *LONG[:4], "between the two halves", *LONG[4:], "short"])
    c = "\n".join([*reversed(LONG), "short"])
    rows = [(1, a, "x"), (2, b, "x"), (3, c, "x"), (4, "short", None), (5, None, None), (6, "", None), (7, a, None), (None, a, None), (2, b, "x"), (9, "short\nend", "")]
    got = {}
    for i, text, n, gone in cut(spark, rows):
        got.setdefault(i, []).append((text, n, gone))
    assert got[1] == [(a, 11, 0)] and got[None] == [(a, 11, 0)] and got[5] == [(None, 1, 0)] and got[6] == [("", 1, 0)]
    assert got[2] == [("another head\nbetween the two halves\nshort", 12, 9)] * 2
    assert got[7] == [("", 11, 11)]
    assert got[3][0][2] == 1 and got[4] == [("short", 1, 0)] and got[9] == [("short\nend", 2, 0)]


def test_hot_line_costs_one_pair_per_document(spark):
    hot = "the same licence line in very many documents here"
    rows = [(i, f"text number {i} alone\n{hot}\nand its end {i}", "") for i in range(300)]
    got = cut(spark, rows)
    assert [g[3] for g in sorted(got)] == [0] + [1] * 299
    assert all(hot not in g[1] for g in got if g[0])


def test_pairs_of_a_hot_owner_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_SHARE", 16)
    pairs = spark.createDataFrame([(i, i, 1 if i % 2 else i - 1, 7) for i in range(2, 400)], "id long, key long, early_id long, early_key long")
    early = spark.createDataFrame([(i, 7, [i]) for i in range(1, 400)], "early_id long, early_key long, early array<long>")
    rows = line_dedup._with_owner(pairs, early).collect()
    assert sorted((r.id, r.early_id, r.early[0]) for r in rows) == [(i, e, e) for i in range(2, 400) for e in [1 if i % 2 else i - 1]]
    held = [sum(r.early_id == 1 and r.copy == c for r in rows) for c in range(13)]
    assert sum(held) == 200 and 0 < max(held) < 40
    hot = "the same licence line in very many documents here"
    got = cut(spark, [(i, f"text number {i} alone\n{hot}\nand its end {i}", "") for i in range(100)])
    assert [g[3] for g in sorted(got)] == [0] + [1] * 99


def test_alignment_is_common_and_increasing():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(15))]
        b = [rng.randrange(12) for _ in range(rng.randrange(15))]
        blocks = sorted(align(a, b))
        x = y = 0
        for e, l, n in blocks:
            assert e >= x and l >= y and n > 0 and a[e : e + n] == b[l : l + n]
            x, y = e + n, l + n
        assert align(a, a) == ([(0, 0, len(a))] if a else [])


def test_empty_table(spark):
    assert cut(spark, []) == []


def test_repeated_and_swapped_passages_go(spark):
    p, q = ([f"{name} number {i} of a shared passage that has twelve words each {name}{i}" for i in range(6)] for name in ("first", "second"))
    twice = "\n".join(["head", *p, "between", *p, "tail"])
    rows = [(1, twice, ""), (2, "\n".join(["a", *p, "b"]), ""), (3, "\n".join(["c", *p, "d"]), ""), (11, "\n".join(["e", *q, "f"]), ""), (12, "\n".join(["g", *q, "h", *q, "i"]), "")]
    got = {g[0]: (g[1], g[3]) for g in cut(spark, rows)}
    assert got == {1: (twice, 0), 2: ("a\nb", 6), 3: ("c\nd", 6), 11: (rows[3][1], 0), 12: ("g\nh\ni", 12)}
    swapped = [(1, "\n".join([*p, "x", *q]), ""), (2, "\n".join([*q, "y", *p]), "")]
    assert {g[0]: (g[1], g[3]) for g in cut(spark, swapped)} == {1: (swapped[0][1], 0), 2: ("y", 12)}


def test_no_common_block_is_left():
    rng, names = random.Random(2), np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 8)
    for _ in range(2000):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        words = [0, 1, 3, 3, 4, 5, 8, 9]
        gone = set(_cut(names[a], names[b], np.array([words[x] for x in b]), 8).tolist())
        blocks = [(l, l + n) for l in range(len(b)) for n in range(1, len(b) - l + 1) if sum(words[x] for x in b[l : l + n]) >= 8 and any(a[e : e + n] == b[l : l + n] for e in range(len(a)))]
        assert gone <= {i for l, r in blocks for i in range(l, r)}
        for l, r in blocks:
            if r - l > 1 or a.count(b[l]) + b.count(b[l]) > 2:
                assert gone >= set(range(l, r))


def test_block_of_lines_with_different_first_owners_goes(spark):
    lines = [f"only five words here {i}" for i in range(12)]
    block = "\n".join(lines)
    rows = [(i, f"{line}\nend {i}", "") for i, line in enumerate(lines)] + [(i, f"{block}\nlast {i}", "") for i in (12, 13)] + [(14, block, ""), (15, block, "")]
    got = {g[0]: (g[1], g[3]) for g in cut(spark, rows)}
    assert got == {i: (text, 0) for i, text, _ in rows[:13]} | {13: ("last 13", 12), 14: ("", 12), 15: ("", 12)}


def test_every_block_that_an_earlier_document_holds_goes(spark):
    rng, words = random.Random(3), [0, 1, 3, 4, 5, 5, 8, 9]
    vocabulary = [" ".join(f"w{i}x{k}" for k in range(n)) or " " * i for i, n in enumerate([*words, *words])]
    texts = [[rng.randrange(16) for _ in range(rng.randrange(1, 12))] for _ in range(150)]
    got = {g[0]: g for g in cut(spark, [(i, "\n".join(vocabulary[x] for x in t), "") for i, t in enumerate(texts)])}
    for i, t in enumerate(texts):
        must, may = set(), set()
        for l in range(len(t)):
            for r in range(l + 1, len(t) + 1):
                if sum(words[x % 8] for x in t[l:r]) >= 8 and any(u[e : e + r - l] == t[l:r] for u in texts[:i] for e in range(len(u))):
                    may |= set(range(l, r))
                    must |= set(range(l, r)) if r - l > 1 else set()
        assert len(must) <= got[i][3] <= len(may)
        if must == may:
            assert got[i][1] == "\n".join(vocabulary[x] for k, x in enumerate(t) if k not in may)


def test_clashing_columns(spark):
    own = ["_key", "_id", "_gone", "id", "key", "c0", "c1", "hashes", "a.b", "n_lines"]
    line = "these are eight words of a shared line"
    rows = spark.createDataFrame([(i, f"{line}\nown {i}", *own) for i in (1, 2)], ["doc_id", "text", *own])
    got = {r.doc_id: r for r in dedup_lines(rows).collect()}
    assert [got[i].text for i in (1, 2)] == [f"{line}\nown 1", "own 2"] and got[2].n_lines == 2
    assert all(r[c] == c for r in got.values() for c in own[:-1])
