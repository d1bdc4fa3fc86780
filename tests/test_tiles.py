"""Pairs of blocks by tiles: every pair once, and a matrix once per tile instead of once per pair."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import blocks as bl
from tidemark.operators import neighbors as nb


def points(spark, n, dim, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x, spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "article_id long, embedding array<double>")


def test_every_pair_meets_once_with_its_matrices(spark, monkeypatch):
    x, df = points(spark, 400, 40)
    packed = bl.build_blocks(df, block_rows=16)
    monkeypatch.setattr(bl, "TILE_BYTES", 3 * 8 * 40 * 16)  # three blocks a side
    pairs = bl.candidates(packed).filter("block_a <> block_b")

    def seen(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                assert (bl.unpack(row, "a", 40)[2] == x[bl.unpack(row, "a", 40)[0]]).all()
                assert (bl.unpack(row, "b", 40)[2] == x[bl.unpack(row, "b", 40)[0]]).all()
            yield b[["block_a", "block_b"]]

    got = bl.meet(pairs, packed, seen, "block_a long, block_b long")
    asked = [tuple(r) for r in pairs.select("block_a", "block_b").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(asked) and len(asked) > 500


def shuffled_mb(spark, df):
    """Bytes that the exchanges of a plan have written, from the metrics of its executed plan."""
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect() and df._jdf.queryExecution().executedPlan()
    text, total = [rows], 0
    while text:
        node = text.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            text.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            text.append(node.plan())
        else:
            if name == "Exchange":
                total += node.metrics().apply("dataSize").value()
            text += [node.children().apply(i) for i in range(node.children().size())]
    return total / 1e6


def test_matrices_do_not_travel_per_pair(spark):
    """About 60 blocks without structure, nearly all pairs of them: the matrices travel a few times each, not 60."""
    _, df = points(spark, 2000, 64)
    packed = bl.build_blocks(df, block_rows=32)
    mb = 2000 * 64 * 8 / 1e6
    blocks = packed.df.count()
    assert blocks > 40
    met = bl.meet(bl.candidates(packed), packed, lambda f: (b[["block_a"]] for b in f), "block_a long")
    assert shuffled_mb(spark, met) < 30 * mb < 0.5 * blocks * mb * 2


def test_neighbours_over_many_tiles(spark, monkeypatch):
    x, df = points(spark, 500, 40)
    x[100:140] = np.round(x[100:140])  # equal distances
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "article_id long, embedding array<double>")
    monkeypatch.setattr(bl, "TILE_BYTES", 2 * 8 * 40 * 16)
    got = nb.knn_graph(df, 7, "euclidean", 16).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("l"))
    d = bl.rounded(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(500), d.shape), d), axis=1)[:, :7]
    assert {r["src"]: [n["dst"] for n in r["l"]] for r in got.collect()} == dict(enumerate(want.tolist()))
