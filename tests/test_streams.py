"""The stream queries over tables that are one file and over tables that are folders of parts."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import queries as q
from tidemark.plans import views as v


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The same rows twice: each table a folder of four parts, and each table one file."""
    top = tmp_path_factory.mktemp("tables")
    i = F.col("id")
    text = F.concat(F.lit("title "), i.cast("string"), F.lit("\nbody"))
    docs = spark.range(40).select(i.alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.length(text).cast("long").alias("n_chars"))
    vecs = spark.range(40).select(i.alias("vec_id"), F.array((i % 2).cast("float"), F.lit(1.0).cast("float")).alias("embedding"), (i % 2).cast("int").alias("label"))
    for name, df in (("documents", docs), ("embeddings", vecs)):
        df.repartition(4).write.parquet(f"{top}/parts/{name}.parquet")
        df.coalesce(1).write.parquet(f"{top}/{name}")
        (top / "file").mkdir(exist_ok=True)
        next((top / name).glob("*.parquet")).rename(top / "file" / f"{name}.parquet")
    return top


@pytest.mark.parametrize("layout", ["parts", "file"])
def test_streams_take_every_file_of_a_table(spark, tables, layout):
    d = f"{tables}/{layout}"
    titled = v.articles(spark, d).filter(F.col("article_id") % 17 != 0).count()  # the query blanks every 17th title
    assert q.stream_ingest(spark, d).count() == titled == 37
    assert q.stream_dedup(spark, d).count() == 40
    assert q.stream_assign(spark, d).select("article_id").distinct().count() == 40
