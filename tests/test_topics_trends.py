import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import topics as tp
from tidemark.operators import trends as tr


def test_names(spark):
    rows = [(0, []), (1, ["ai", "agent", "automation", "gpu"]), (2, ["trade deal", "budget"])]
    df = spark.createDataFrame(rows, "topic_id int, keywords array<string>")
    given = spark.createDataFrame([(2, "Trade")], "topic_id int, topic string")
    assert {r[0]: r[1] for r in tp.name_topics(df).collect()} == {
        0: "Miscellaneous", 1: "AI · Agent · Automation", 2: "Trade Deal · Budget",
    }
    assert {r[0]: r[1] for r in tp.name_topics(df, given).collect()}[2] == "Trade"
    same = spark.createDataFrame([(0, "X"), (1, "X"), (2, "Y"), (3, "X")], "topic_id int, topic string")
    assert {r[0]: r[1] for r in tp.unique_topic_names(same).collect()} == {0: "X", 1: "X (2)", 2: "Y", 3: "X (3)"}


@pytest.mark.parametrize("width", [2, 500])
def test_keyword_filter(spark, width):
    terms = ["ai agent", "ai", "agent", "chip", "chips", "ship", "zebra"]
    rows = [(0, t, 10.0 - i) for i, t in enumerate(terms)] + [(1, "solo", 1.0)]
    scores = spark.createDataFrame(rows, "cluster int, term string, raw double")
    got = {r[0]: r[1] for r in tp.cluster_keywords(scores, 3, width).collect()}
    assert got == {0: ["ai agent", "chip", "ship"], 1: ["solo"]}


def test_border_bigrams(spark):
    rows = [(1, 0, "aa bb"), (2, 0, ""), (3, 1, "xx"), (70000, 0, "cc"), (70001, -1, "dd"), (70002, 0, "ee")]
    df = spark.createDataFrame(rows, "article_id long, cluster int, tfidf_text string")
    got = {(r["cluster"], r["term"]): r["tf"] for r in tp.class_term_counts(df).collect()}
    assert got == {(0, t): 1 for t in ("aa", "bb", "cc", "ee", "aa bb", "bb cc", "cc ee")} | {(1, "xx"): 1}


@pytest.mark.parametrize(
    "texts, want",
    [
        (["aa bb", "aa cc bb", "x1", "x2"], 1.0),
        (["aa bb", "aa", "bb", "x2"], 0.0),
        (["aa", "aa", "bb", "bb"], -1.0),
        (["aa", "aa", "cc", "cc"], 0.0),
    ],
)
def test_npmi(spark, texts, want):
    docs = spark.createDataFrame(list(enumerate(texts)), "article_id long, tfidf_text string")
    kw = spark.createDataFrame([(0, ["aa", "bb"])], "topic_id int, keywords array<string>")
    assert tp.npmi_coherence(kw, docs).first()["coherence"] == pytest.approx(want, abs=1e-9)


def test_trend_golden(spark):
    counts = {0: [1, 1, 2, 4], 1: [3, 2, 1, 0]}
    rows, n = [], 0
    for topic, per_day in counts.items():
        for day, c in enumerate(per_day):
            for i in range(c):
                rows.append((n, topic, dt.datetime(2026, 1, 1 + day, 5), f"s{topic}-{i % 2}"))
                n += 1
    rows.append((n, -1, dt.datetime(2026, 2, 1), "noise"))
    df = spark.createDataFrame(rows, "article_id long, cluster int, published timestamp_ntz, source string")
    got = {r["topic_id"]: r for r in tr.emerging_topics(df).collect()}
    a, b = got[0], got[1]
    assert (a["recent"], a["previous"], a["growth_rate"], a["topic"]) == (6, 2, 2.0, "Topic 0")
    assert a["velocity"] == pytest.approx(0.5) and b["velocity"] == pytest.approx(-2 / 3)
    assert a["trend"] == tr.RISING and b["trend"] == tr.DECLINING
    assert a["emerging_score"] == pytest.approx(0.35 + 0.25 + 0.2 * a["source_diversity"] + 0.2, abs=5e-4)
    assert tr.emerging_topics(df.filter(F.col("published") < dt.datetime(2026, 1, 2))).count() == 0
    assert tr.daily_counts(df).count() == 8


def test_labels(spark):
    cases = [(0.60, -1.0), (0.59, -0.5), (0.10, 0.16), (0.10, -0.16), (0.10, 0.15), (0.39, -0.15)]
    df = spark.createDataFrame(cases, "s double, g double").coalesce(1)
    got = [r[0] for r in df.select(tr.label_for(F.col("s"), F.col("g"))).collect()]
    assert got == [tr.RISING, tr.GROWING, tr.GROWING, tr.DECLINING, tr.STABLE, tr.STABLE]
