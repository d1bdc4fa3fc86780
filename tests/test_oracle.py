"""Registered queries against their SQL twins on the smallest tables; all of them with TIDEMARK_ALL=1."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUICK = (
    "emerging_topics normalize_articles assign_article_id save_new_articles strip_html heavy_clean tfidf "
    "class_term_counts daily_counts overview article_filter filter_options map_labels similar_pairs story_groups "
    "knn_graph silhouette assign_new stream_daily_counts stream_trends"
).split()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", list(SQL) if os.environ.get("TIDEMARK_ALL") else QUICK)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert compare(df.columns, [tuple(r) for r in df.collect()], con, SQL[name]) == ""
