"""Keep the article store, the topic counts and the trends up to date from landed files.

State and progress live below the shared folder; every job can be restarted on the same paths.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.clusters import assign_new_articles
from tidemark.operators.trends import NOISE, filled_days, topic_day_source, trends_from_cells
from tidemark.sources.articles import (
    canonical_columns,
    default_values,
    drop_blank_titles,
    fill_published,
    parse_published,
)
from tidemark.sources.feed_files import FeedFiles
from tidemark.sources.feeds import fetch_counts, landed_articles, landed_items
from tidemark.sources.store import save_articles

Sink = Callable[[DataFrame, int], None]


def landed(spark: SparkSession, path: str, schema, name_filter: str = "*", fmt: str = "parquet") -> DataFrame:
    """Stream of the files that land in ``path``, which may be a glob: of folders that it matches all files are taken."""
    return spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", name_filter).load(path)


def normalize_stream(raw: DataFrame) -> DataFrame:
    """Row-wise part of the article rules: column names, dates, defaults; dates that do not parse stay null."""
    out = canonical_columns(raw)
    if dict(out.dtypes)["published"] != "timestamp_ntz":
        out = out.withColumn("published", parse_published(F.col("published").cast("string")))
    return default_values(out)


def run_once(df: DataFrame, sink: Sink, state: str, mode: str = "append") -> None:
    """Process everything that has landed, then stop."""
    query = df.writeStream.foreachBatch(sink).option("checkpointLocation", state).outputMode(mode)
    query.trigger(availableNow=True).start().awaitTermination()


def append_to(path: str) -> Sink:
    """Sink that writes each batch to its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def ingest(raw: DataFrame, path: str, state: str) -> None:
    """Normalised articles of all landed files, appended to ``path``.

    A date that is missing becomes the newest date of its batch; rows without title are left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            append_to(path)(drop_blank_titles(fill_published(batch)), batch_id)
        finally:
            batch.unpersist()

    run_once(normalize_stream(raw), write, state)


def feed_items(spark: SparkSession, root: str, limit: int = 100) -> DataFrame:
    """Stream of the items of the feed files that land below ``root``, a folder per feed (see ``FeedFiles``)."""
    spark.dataSource.register(FeedFiles)
    return landed_items(spark.readStream.format("landed_feeds").option("limit", limit).load(root))


def keep_feeds(articles: str, fetches: str) -> Sink:
    """Sink for :func:`feed_items`: articles below ``articles``, item counts of every file below ``fetches``.

    For ``run_once`` or ``start_continuous``. Each batch has its own folders, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            append_to(articles)(landed_articles(batch), batch_id)
            append_to(fetches)(fetch_counts(batch), batch_id)
        finally:
            batch.unpersist()

    return write


def query_id(spark: SparkSession, state: str) -> str:
    """The id that a streaming query keeps over restarts, from the metadata of its state folder."""
    return json.loads(spark.read.text(f"{state}/metadata").first()[0])["id"]


def store_new(raw: DataFrame, store: str, state: str, order_col: str | None = None) -> None:
    """Append articles with an unseen URL to the store: exact and without state that grows in memory.

    A batch is saved under the query's own id and the number of the batch, so a repeated batch replaces itself.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        name = f"{query_id(batch.sparkSession, state)}-{batch_id}"
        save_articles(drop_blank_titles(batch), store, order_col, name)

    run_once(normalize_stream(raw), save, state)


def recent_urls_only(raw: DataFrame, delay: str = "3 days") -> DataFrame:
    """Cheaper rule with bounded state: a URL is dropped if it was seen within ``delay`` of event time."""
    timed = raw.withColumn("seen_at", F.col("published").cast("timestamp")).withWatermark("seen_at", delay)
    return timed.dropDuplicatesWithinWatermark(["url"]).drop("seen_at")


def daily_topic_counts(articles: DataFrame, delay: str = "3 days") -> DataFrame:
    """(day, topic_id, n) per tumbling day; a day is final once the watermark has passed it.

    Articles later than ``delay`` are dropped, unlike in the batch operator and in ``running_topic_counts``.
    """
    timed = articles.filter(F.col("cluster") != NOISE).withColumn("at", F.col("published").cast("timestamp"))
    counts = timed.withWatermark("at", delay).groupBy(F.window("at", "1 day"), F.col("cluster").alias("topic_id"))
    return counts.agg(F.count(F.lit(1)).alias("n")).select(
        F.to_date("window.start").alias("day"), "topic_id", "n"
    )


def running_topic_counts(articles: DataFrame) -> DataFrame:
    """(topic_id, day, n) as a stream of corrections: the new total of each topic and day that a batch has touched.

    There is no watermark, so an article counts however late it comes, as in the batch operator. The state
    is one number per topic and day. Write it in ``update`` mode; the largest total of a cell is the current one.
    """
    kept = articles.filter(F.col("cluster") != NOISE)
    return kept.groupBy(F.col("cluster").alias("topic_id"), F.to_date("published").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def count_topics(articles: DataFrame, totals: str, state: str) -> None:
    """Write the corrections of all landed files below ``totals``, a folder per batch."""
    run_once(running_topic_counts(articles), append_to(totals), state, "update")


def current_counts(spark: SparkSession, totals: str) -> DataFrame:
    """(day, topic_id, n) from the corrections, with zeros for days without articles: ``daily_counts`` of all that landed.

    A total never falls, so the order of batches does not matter, nor does a batch that was written twice.
    """
    rows = spark.read.schema("topic_id int, day date, n long").parquet(totals)
    return filled_days(rows.groupBy("topic_id", "day").agg(F.max("n").alias("n")))


def _level(cells: str, level: int, end: int) -> str:
    return f"{cells}/batch={end}" if not level else f"{cells}-levels/level={level}/end={end}"


def keep_cells(counts: DataFrame, cells: str, batch_id: int) -> DataFrame:
    """Write the counts of one batch and give back the sums of all batches up to it, from few folders.

    Batches are merged like the carries of a binary counter: after batch b, each pair of neighbouring runs of 2^k batches
    that ends with b becomes one run of 2^(k+1). The runs to read are the binary digits of b + 1, a function of the
    number of the batch alone: there is no list of files that a crash could leave behind, and a repeated batch writes
    the same folders again. So a refresh reads at most log2(b + 1) + 1 folders, and a merge as much as it writes.
    """
    spark, keys = counts.sparkSession, [c for c in counts.columns if c != "n"]
    counts.write.mode("overwrite").parquet(_level(cells, 0, batch_id))

    def summed(folders: list[str]) -> DataFrame:
        rows = spark.read.schema(counts.schema).parquet(*folders)
        return rows.groupBy(*keys).agg(F.sum("n").alias("n"))

    level = 0
    while (batch_id + 1) % (2 << level) == 0:
        both = [_level(cells, level, batch_id - (1 << level)), _level(cells, level, batch_id)]
        summed(both).write.mode("overwrite").parquet(_level(cells, level + 1, batch_id))
        level += 1
    return summed(standing(cells, batch_id))


def standing(cells: str, batch_id: int) -> list[str]:
    """The folders that together hold all batches up to ``batch_id``."""
    folders, left = [], batch_id + 1
    while left:
        level = (left & -left).bit_length() - 1
        folders.append(_level(cells, level, left - 1))
        left -= 1 << level
    return folders


def assign_stream(vectors: DataFrame, centroids: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Clusters for a stream of new article vectors, from a static centroid table."""
    return assign_new_articles(vectors, centroids, threshold)


def refresh_trends(articles: DataFrame, cells: str, trends: str, state: str, window_days: int = 3) -> None:
    """Add each batch's counts per topic, day and source to ``cells`` and make the trend table from all counts.

    Articles are read once, in their own batch; a refresh reads counts only, merged so that it opens a logarithmic number
    of folders. The table of a batch goes to its own folder below ``trends``; the newest one is the current table.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        everything = keep_cells(topic_day_source(batch), cells, batch_id)
        table = trends_from_cells(everything, window_days=window_days)
        table.write.mode("overwrite").parquet(f"{trends}/batch={batch_id}")

    run_once(articles, refresh, state)


def start_continuous(df: DataFrame, sink: Sink, state: str, every: str = "1 minute") -> StreamingQuery:
    """The same jobs as a running query."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(processingTime=every).start()


