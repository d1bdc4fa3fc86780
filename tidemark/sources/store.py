"""Stored articles: a Parquet table that takes each URL once, in folders by save and day."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ordering import dense_index, first_rows
from tidemark.session import checkpointed
from tidemark.sources.articles import COLUMNS

STORE_SCHEMA = (
    "id long, title string, description string, source string, url string, published timestamp_ntz, "
    "author string, category string, fetched_at timestamp"
)


def load_store(spark: SparkSession, path: str) -> DataFrame:
    """The whole table; an empty frame with the same schema if nothing was stored yet."""
    return load_days(spark, path).drop("day")


def load_days(spark: SparkSession, path: str) -> DataFrame:
    """The table with the day of ``published`` (null without date), which is a folder: a filter on it opens only its days."""
    return _with_batches(spark, path).drop("batch")


def _with_batches(spark: SparkSession, path: str) -> DataFrame:
    """The table with the name of the save that brought each row, and its day."""
    return _read(spark, path, STORE_SCHEMA + ", batch string, day date")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def load_articles(spark: SparkSession, path: str) -> DataFrame:
    return load_store(spark, path).select(*COLUMNS)


def count_articles(spark: SparkSession, path: str) -> int:
    return load_store(spark, path).count()


def new_articles(batch: DataFrame, stored_urls: DataFrame, order_col: str) -> DataFrame:
    """Rows of ``batch`` that an insert-or-ignore on the unique URL would add.

    The first row of a URL wins; rows without URL never conflict; rows without title are ignored.
    The URL is settled by a partial aggregate before the anti join, so a hot URL arrives there once.
    """
    named = batch.filter(F.col("title").isNotNull()).withColumn("url", F.nullif(F.col("url"), F.lit("")))
    no_url = named.filter(F.col("url").isNull())
    by_url = first_rows(named.filter(F.col("url").isNotNull()), ["url"], order_col)
    return by_url.join(stored_urls.select("url"), "url", "left_anti").select(*batch.columns).unionByName(no_url)


def save_articles(batch: DataFrame, path: str, order_col: str | None = None, name: str | None = None) -> int:
    """Append the new rows of ``batch`` with running ids and a fetch stamp; returns their number.

    Each save has a folder of its own, and in it one for each day of ``published``; late articles are small folders of their days.
    Saving again under the same ``name`` replaces what that save had brought, so a batch that is repeated after a
    failure adds nothing twice, rows without URL included. The last id of each save is noted beside the table before
    the save is written: a save that fails in between leaves a gap in the ids and never an id twice.
    """
    spark = batch.sparkSession
    ordered = batch.withColumn("_ord", F.col(order_col) if order_col else F.monotonically_increasing_id())
    name = name or uuid.uuid4().hex
    stored = _with_batches(spark, path).filter(F.col("batch") != name)
    last = _read(spark, f"{path}-ids", "last long, batch string").filter(F.col("batch") != name).agg(F.max("last").alias("m")).first()["m"]
    fresh = new_articles(ordered.select("_ord", *COLUMNS), stored, "_ord")
    numbered = checkpointed(dense_index(fresh, "_ord", "id").withColumn("id", F.col("id") + (last or 0) + 1))
    n = numbered.count()
    noted = spark.range(1).select(F.lit((last or 0) + n).cast("long").alias("last"))
    noted.write.mode("overwrite").parquet(f"{path}-ids/batch={name}")
    rows = numbered.select("id", *COLUMNS, F.current_timestamp().alias("fetched_at"), F.to_date("published").alias("day"))
    by_day = rows.hint("rebalance", F.col("day")).write.option("partitionOverwriteMode", "static")
    by_day.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={name}")
    return n


def export_articles(articles: DataFrame) -> DataFrame:
    """Download form: everything but the two working texts."""
    return articles.drop("embedding_text", "tfidf_text")


def write_export(articles: DataFrame, path: str) -> None:
    export_articles(articles).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)
