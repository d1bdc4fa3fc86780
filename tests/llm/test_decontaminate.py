"""Winnowed decontamination against brute force and its SQL twin."""

import random
import re

import pytest
from compare import compare, connect

from tidemark.llm import queries
from tidemark.llm.decontaminate import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at : at + n])):
                    hit |= set(range(at, at + n))
                    items |= own
        out.append((i, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, docs, bench):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate(d, b).collect()), key=str)


@pytest.mark.parametrize("short", [False, True])
def test_equals_brute_force(spark, short):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("aa bb Cc dd éé x1 日本".split()) for _ in range(n))
    bench = [(i, text(rng.randrange(13, 40))) for i in range(20)] + [(None, text(20)), (30, "..."), (31, None), (3, text(15))]
    bench += [(40, "only three words"), (41, "aa aa"), (42, "zz"), (43, text(12))] if short else []
    docs = [(i, text(rng.randrange(60))) for i in range(40)]
    docs += [(100 + i, f"{text(9)}, {bench[i][1]}; {text(rng.randrange(400))}") for i in range(20)]
    docs += [(200, bench[2][1].upper().replace(" ", " - ")), (201, None), (202, ""), (203, "Only  three\nwords"), (None, bench[5][1]), (100, bench[0][1]), (100, bench[0][1])]
    docs += [(300, " ".join(bench[4][1].split()[:13])), (301, " ".join(bench[4][1].split()[:12])), (302, "aa " * 5000), (303, "zz")]
    assert run(spark, docs, bench) == brute(docs, bench)


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], [(1, "a " * 20)]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [], False)]
    d = spark.createDataFrame([(1, "a b c", 9, "k", "0")], "doc_id long, text string, n_hit int, text_key string, item string")
    b = spark.createDataFrame([("q", "b", 1)], "item_id string, text string, n_words int")
    row = decontaminate(d, b).first()
    assert (row.n_hit, row.n_words, list(row["items"]), row.text_key, row.item) == (1, 3, ["q"], "k", "0")
    own = ["_key", "_at", "_hit", "_items", "c0", "c1", "a.b", "words", "spans"]
    d = spark.createDataFrame([(1, "a b c", *own)], ["doc_id", "text", *own])
    row = decontaminate(d, b).first()
    assert (row.n_hit, [row[c] for c in own]) == (1, own)


@pytest.mark.parametrize("sf", ["0.001"])
def test_sql_twin(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    df = queries.QUERIES["op9_benchmark_decontamination"](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert compare(df.columns, rows, connect(sf_dir), queries.SQL["op9_benchmark_decontamination"]) == ""
    assert any(r[df.columns.index("contaminated")] for r in rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
