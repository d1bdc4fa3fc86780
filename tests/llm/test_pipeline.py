"""Pipeline stages against what they promise, on the smallest tables and on a fixture of odd rows."""

import os

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


def test_run_on_small_tables(spark):
    docs = table(spark, SF, "documents")
    kept, counts = docs, [docs.count()]
    for name, stage in cp.STAGES:
        out = stage(spark, kept, SF)
        if name != "bpe_encode_decode":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = cp.checkpointed(out)
        counts.append(path.count())
        kept = path
    assert counts == sorted(counts, reverse=True) and counts[2] == counts[1] and counts[5] == counts[4] > 0
    final = sorted(map(str, kept.select("doc_id", "n_tokens", "decoded_sha256").collect()))
    assert final == sorted(map(str, cp.run(spark, SF).select("doc_id", "n_tokens", "decoded_sha256").collect()))
    assert kept.filter(F.size("ids") != F.col("n_tokens")).isEmpty()


def test_stages_with_odd_rows(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "lone words here that nobody else has", "en", "s", 36), (None, "lone words here that nobody else has", "en", "s", 36), (3, "x " * 60_000, "en", "s", 120_000), (4, "some words in a row", "en", "s", 19), (4, "some words in a row", "en", "s", 19), (5, "some words in a row", "fr", "s", 19)]
    df = cp.checkpointed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    near = cp.drop_near_copies(spark, df, SF)
    assert near.columns == df.columns
    got = sorted((str(r.doc_id), r.text or "") for r in near.collect())
    assert [i for i, _ in got] == ["1", "3", "4", "None", "None"]
    for _, stage in cp.STAGES:
        stage(spark, df, SF).collect()
        assert stage(spark, df.limit(0), SF).collect() == []


def test_different_texts_under_one_id_are_judged_by_their_own_component(spark):
    a, b, c = (" ".join(f"{name}{i}" for i in range(40)) for name in ("one", "two", "three"))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (4, c), (2, c)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.drop_near_copies(spark, cp.checkpointed(df), SF).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, a), (1, b), (2, c)]


def test_oracle_is_none_and_stages_are_named():
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 5 and os.path.exists(cp.__file__)
