"""SimHash groups against brute force."""

import random
import re

import numpy as np
import xxhash

from tidemark.llm.common import components
from tidemark.llm.simhash import compare, fingerprint, links, near_duplicates


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    return sorted(((i, p, least[g]) for (i, _), p, g in zip(rows, prints, group)), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("ab cd ef gh ij KL Mé ñ".split()) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:30]):
        words = t.split()
        words[rng.randrange(len(words))] = "zz"
        rows.append((1000 + i, " \t".join(words)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, base[3]), (5, base[7]), (5, base[7]), (None, None), (3000, "x " * 70_000), (3001, "\x85\x1c　 a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.print & (2**64 - 1), r.component) for r in near_duplicates(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_compare_equals_all_pairs():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    prints = np.unique(np.concatenate([centres, *(centres ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 63, (90, 2)))]))
    rng.shuffle(prints)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    want = {(min(int(prints[i]), int(prints[j])), max(int(prints[i]), int(prints[j]))) for i, j in zip(*np.nonzero(near)) if i < j}
    got = [(min(x, y), max(x, y)) for a, b in compare(prints, prints, 4, True) for x, y in zip(prints[a].tolist(), prints[b].tolist())]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_dense_group_costs_few_links(spark):
    centre = 0x0F1E2D3C4B5A6978
    dense = sorted({centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)} | {centre ^ (1 << i) for i in range(64)})
    far = [~p & (2**64 - 1) for p in dense[:40]]
    prints = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in dense + far], "print long")
    rows = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in links(prints).collect()]
    assert len(dense) == 2081 and len(rows) < 5000 and all(1 <= (a ^ b).bit_count() <= 4 for a, b in rows)
    group = {p: {p} for p in dense + far}
    for a, b in rows:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for p in group[b]:
                group[p] = group[a]
    assert all(group[p] == set(dense) for p in dense) and not any(group[p] & set(dense) for p in far)


def test_fingerprint_of_empty_and_empty_table(spark):
    assert fingerprint(None) == fingerprint("\n") == 0
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    rng = random.Random(4)
    ids = list(range(300))
    rng.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(149)] + [(ids[200], ids[i]) for i in range(201, 299)] + [(7, 7)]
    nodes = spark.createDataFrame([(i,) for i in range(300)], "id long")
    got = {r.id: r.component for r in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    chain, star = ids[:150], [ids[200], *ids[201:299]]
    want = {i: i for i in range(300)} | {i: min(chain) for i in chain} | {i: min(star) for i in star}
    assert got == want
