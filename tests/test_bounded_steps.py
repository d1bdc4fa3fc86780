"""Steps whose share per task must not grow with the table: dense numbering, term counts and passes over term weights."""

import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.ordering import dense_index
from tidemark.operators import embeddings as em
from tidemark.operators import features as ft


def test_consecutive_ids_are_numbered_by_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(60_000).select((F.col("id") * 2 + 5).alias("v"))
        got = dense_index(rows, "v", "i").withColumn("task", F.spark_partition_id())
        assert got.filter("v <> 2 * i + 5").isEmpty() and got.count() == 60_000
        assert got.groupBy("task").count().agg(F.max("count")).first()[0] < 30_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_terms_are_counted_without_an_aggregate_of_postings(spark):
    texts = [(1, "aa bb aa bb aa"), (2, "cc"), (3, None), (4, ""), (1, "aa dd"), (None, "aa"), (5, "x")]
    docs = spark.createDataFrame(texts, "article_id long, tfidf_text string")
    got = ft.term_freq(docs)
    want = Counter()
    for key, text in texts:
        words = [w for w in (text or "").split() if len(w) > 1]
        want.update((key, t) for t in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])
    assert {(r["article_id"], r["term"]): r["tf"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "keys=[article_id" in plan and "term" not in plan.split("Aggregate(keys=[", 1)[1].split("]")[0]


def test_class_counts_clean_the_texts_once(spark, tmp_path):
    """The counts read cleaned texts that were written once, for words and for borders, and not the documents twice."""
    from tidemark.plans import queries as q

    docs = spark.range(8).selectExpr("id + 1 AS doc_id", "'market trade\\nbank market' AS text", "'en' AS lang", "'s' AS source", "26L AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = q.class_term_counts(spark, str(tmp_path))
    assert not [f for f in got.inputFiles() if "documents.parquet" in f]
    assert got.agg(F.sum("tf")).first()[0] > 8 * 4


def test_a_pass_over_term_weights_holds_few_numbers():
    """512 documents of 400 terms against 110 directions: a product per posting would hold 90 MB at a time."""
    rng = np.random.default_rng(5)
    idx = [np.sort(rng.choice(2000, 400, replace=False)) for _ in range(512)]
    frame = pd.DataFrame({"idx": idx, "val": list(rng.normal(size=(512, 400)))})
    right = rng.normal(size=(2000, 110))
    tracemalloc.start()
    got = em._gram_share(iter([frame.iloc[:300], frame.iloc[300:]]), right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x = np.zeros((512, 2000))
    for row, (at, val) in enumerate(zip(idx, frame["val"])):
        x[row, at] = val
    assert np.allclose(got, x.T @ (x @ right), rtol=1e-10, atol=1e-8)
    assert peak < 40e6
