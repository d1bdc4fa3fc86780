"""Embedding near-duplicates: brute force over planted groups, odd vectors, pruning, and the SQL twin."""

import math

import numpy as np
import pytest
from compare import compare as same_rows, connect

from tidemark.llm import embedding_dedup as ed
from tidemark.llm import queries

KIND = "vec_id long, embedding array<float>, label int, class int, part string"


def plain(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) of each row, sorted."""
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        x = np.array(v, float)
        return None if not x.any() else x / np.abs(x).max() / np.sqrt(((x / np.abs(x).max()) ** 2).sum())

    units = [unit(v) for _, v, _ in rows]
    n = len(rows)
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            a, b = units[i], units[j]
            if i != j and a is not None and b is not None and len(a) == len(b) and rows[i][2] is not None and rows[i][2] == rows[j][2]:
                link[i][j] = float((a * b).sum()) >= threshold
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in range(n) if link[i][j])]) for i in range(n)]
        if new == label:
            break
        label = new
    out = []
    for i, (vec, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec, sum(link[i]), least, vec is not None and vec == least))
    return sorted(out, key=str)


def got(spark, rows, threshold=0.98):
    df = spark.createDataFrame([(i, v, lab, 1, "clash") for i, v, lab in rows], KIND).repartition(5)
    return sorted((tuple(r) for r in ed.near_duplicate_vectors(df, threshold).collect()), key=str)


def planted(rng, dim=24):
    rows, at = [], 0
    for label in (0, 1, 2):
        centre = rng.normal(size=dim)
        for _ in range(60):
            rows.append((at, (centre + rng.normal(size=dim)).astype(np.float32).tolist(), label))
            at += 1
        for size in (2, 3, 40):
            base = rng.normal(size=dim)
            for _ in range(size):
                rows.append((at, (base * rng.choice([1, 2, 0.3]) + rng.normal(size=dim) * 0.09).astype(np.float32).tolist(), label))
                at += 1
    rows += [(at + k, rows[5][1], 0) for k in range(30)] + [(at + 40 + k, rows[5][1], 1) for k in range(3)]
    chain = [(math.cos(0.15 * k), math.sin(0.15 * k)) for k in range(30)]  # each is near the next one only
    return rows + [(at + 100 + 30 - k, [x, y] + [0.0] * (dim - 2), 7) for k, (x, y) in enumerate(chain)]


def test_against_brute_force(spark, monkeypatch):
    rows = planted(np.random.default_rng(3))
    nan, inf = float("nan"), float("inf")
    odd = [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 24, 0), (9003, [nan] + [1.0] * 23, 0), (9004, [None] + [1.0] * 23, 0), (9005, [inf] * 24, 0), (9006, rows[5][1], None)]
    odd += [(9007, [1.0, 2.0], 0), (9008, [2.0, 4.0], 0), (9009, [3.0], 4), (9010, [1e-30], 4), (9011, [-1.0], 4), (None, [1.0, 2.0], 0), (None, [5.0, 1.0], 9), (None, [5.0, 1.0], 9), (9012, [1e38, 3e38], 0), (5, rows[5][1], 0), (5, rows[5][1], 0)]
    want = plain(rows + odd)
    assert max(w[1] for w in want) > 30
    assert got(spark, rows + odd) == want
    monkeypatch.setattr(ed, "PART_ROWS", 7)
    monkeypatch.setattr(ed, "TILE", 3)
    assert got(spark, rows + odd) == want
    assert got(spark, rows + odd, 0.5) == plain(rows + odd, 0.5)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, None)]) == [(1, 0, 1, True)]


def test_leading_dimensions_end_most_pairs():
    """Exact survivors, with a part of all products; and no more forest edges than nodes for a dense group."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(512, 64)) * (0.9 ** np.arange(64))
    x[100:140] = x[100] + rng.normal(size=(40, 64)) * 0.001
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, made = ed.survivors(x, x, ed.suffixes(x), ed.suffixes(x), 0.98)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.98 - ed.SLACK))))
    assert made < 0.6 * 512 * 512 * 8
    one = (np.arange(512), np.ones(512, np.int64), x, x)
    links, _, (a, _), _ = ed.compare(one, one, True, 0.98)
    assert len(a) <= 39 + (links[:100] > 0).sum() + (links[140:] > 0).sum() and links[100] >= 39


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql_twin(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    df = queries.QUERIES["op13_embedding_near_dedup"](spark, sf_dir)
    assert same_rows(df.columns, [tuple(r) for r in df.collect()], connect(sf_dir), queries.SQL["op13_embedding_near_dedup"]) == ""
