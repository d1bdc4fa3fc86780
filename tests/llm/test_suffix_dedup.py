"""Removal of repeated byte strings against a brute-force table of all 50-byte strings."""

import hashlib
import random

import pytest

from tidemark.llm.merged_bwt import merge, transform
from tidemark.llm.suffix_dedup import remove_repeats


def brute(rows, w=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - w + 1):
                s = b[p : p + w]
                least[s] = min(least.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - w + 1):
                if least[b[p : p + w]] < i:
                    gone[p : p + w] = b"\1" * w
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            at = gone.find(0, a) if gone.find(0, a) >= 0 else len(gone)
            spans.append((a, at))
        out.append((i, len(b), tuple(spans), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, hot=4096):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(df, hot=hot).collect()
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["der", "the", "é", "ça", "tion", "on", "x", "日本", "a"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, common = text(40), text(25)
    rows = [(i, text(rng.randrange(60))) for i in range(40)]
    rows += [(100 + i, text(8) + passage + text(9) + common) for i in range(15)]
    rows += [(200, text(300)), (201, "a" * 500), (202, "a" * 49), (203, "a" * 50), (204, "ab" * 200), (205, None), (206, ""), (7, "z" * 70)]
    rows += [(300, rows[50][1]), (300, rows[50][1]), (301, rows[50][1]), (None, passage * 2), (None, None), (302, passage * 30)]
    return rows


@pytest.mark.parametrize("hot", [4096, 3])
def test_equals_brute_force(spark, hot):
    rows = corpus()
    assert run(spark, rows, hot) == brute(rows)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).collect() == []
    df = spark.createDataFrame([(1, "a", 2, 3)], "id long, body string, block long, kept long")
    assert [(r.id, r.n_bytes, r.spans, bytes(r.kept)) for r in remove_repeats(df, "id", "body").collect()] == [(1, 1, [], b"a")]


def test_merge_equals_one_sort_of_all_suffixes():
    rng = random.Random(3)
    shards = [sorted(bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30))) + b"abcabcaab" * 8 for _ in range(n)) for n in (5, 1, 9)]
    interval, onward, whole = merge([transform(s) for s in shards], 50)
    prefix, number = [], []
    for row, s in zip(whole, [s for shard in shards for s in shard]):
        for at in range(len(s) - 49):
            prefix.append(s[at : at + 50])
            number.append(interval[row])
            row = onward[row]
    often = {p for p in prefix if prefix.count(p) > 1}
    assert {p for p, n in zip(prefix, number) if n >= 0} >= often
    shared = sorted((n, p) for p, n in zip(prefix, number) if p in often)
    assert [p for _, p in shared] == sorted(p for p in prefix if p in often)
    assert len({n for n, _ in shared}) == len(often)
