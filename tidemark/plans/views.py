"""The given tables in the shape of the news operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _after_epoch(days: Column, seconds: Column | None = None) -> Column:
    zero = F.lit(0)
    secs = zero if seconds is None else seconds.cast("int")
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(days.cast("int"), zero, zero, secs)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_articles(table(spark, sf_dir, "documents"))


def event_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_vectors(table(spark, sf_dir, "embeddings"))


def shape_articles(documents: DataFrame) -> DataFrame:
    """``documents`` as articles: first line is the title, the rest the description; 8 topics and noise."""
    i = F.col("doc_id")
    g = F.floor(i / 3).cast("int")
    wave, other = i % 14, (i * 5 + 3) % 13
    day = F.when(g % 4 == 0, F.greatest(wave, other)).when(g % 4 == 1, F.least(wave, other)).otherwise(wave)
    title = F.substring_index("text", "\n", 1)
    rest = F.when(F.contains("text", F.lit("\n")), F.substr("text", F.length(title) + 2)).otherwise("")
    return documents.select(
        i.alias("article_id"),
        title.alias("title"),
        rest.alias("description"),
        "source",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), (i % 700).cast("string")).alias("url"),
        _after_epoch(day, (i * 37) % 86400).alias("published"),
        F.lit("").alias("author"),
        F.col("lang").alias("category"),
        F.when(i % 11 == 0, -1).otherwise(g % 8).cast("int").alias("cluster"),
    )


# Topic ids of the event types.
EVENT_TOPICS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def shape_events(events: DataFrame) -> DataFrame:
    """``events`` as dated topic mentions: the type is the topic, the user the source."""
    topic = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in EVENT_TOPICS.items()], F.lit(-1))
    return events.select(
        F.col("event_id").alias("article_id"),
        F.col("ts").cast("timestamp_ntz").alias("published"),
        F.col("user_id").cast("string").alias("source"),
        topic.cast("int").alias("cluster"),
    )


def shape_vectors(embeddings: DataFrame) -> DataFrame:
    """``embeddings`` as article vectors with cluster, source and date."""
    i = F.col("vec_id")
    return embeddings.select(
        i.alias("article_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").alias("cluster"),
        F.concat(F.lit("s"), (i % 7).cast("string")).alias("source"),
        _after_epoch(i % 14).alias("published"),
    )


def feed_items(spark: SparkSession, sf_dir: str, atom: bool = False) -> DataFrame:
    """``pages`` as landed feed items: one RSS or Atom item per page, five feeds, in page order."""
    i = F.col("page_id")
    # Ampersands that start no reference are escaped, so that each title is one whole XML text.
    title = F.regexp_replace(
        F.trim(F.regexp_extract("html", "<title>([^<]*)", 1)), "&(?!(amp|lt|gt|quot|apos|#[0-9]+);)", "&amp;"
    )
    url = F.regexp_replace("url", "&", "&amp;")
    at = _after_epoch(i % 14, (i * 37) % 86400)
    parts = _atom_parts(i, title, url, at) if atom else _rss_parts(i, title, url, at)
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("feed"), (i % 5).cast("string")).alias("feed"), i.alias("pos"), F.concat(*parts).alias("xml")
    )


def feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as whole feed files (feed, part, xml): a file holds the pages of a range of 100 ids; two of five feeds are Atom."""

    def files(atom: bool, opened: str, closed: str) -> DataFrame:
        items = feed_items(spark, sf_dir, atom).filter(F.col("feed").isin("feed3", "feed4") == atom)
        held = F.array_sort(F.collect_list(F.struct("pos", "xml")))["xml"]  # 20 items at most
        part = F.format_string("%012d", F.floor(F.col("pos") / 100))
        text = F.concat(F.lit(opened), F.array_join(held, "\n"), F.lit(closed))
        return items.groupBy("feed", part.alias("part")).agg(text.alias("xml"))

    rss = files(False, '<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>all</title>', "</channel></rss>")
    return rss.unionByName(files(True, '<feed xmlns="http://www.w3.org/2005/Atom"><title>all</title>', "</feed>"))


def _rss_parts(i: Column, title: Column, url: Column, at: Column) -> list[Column]:
    return [
        F.lit("<item><title>"),
        title,
        F.lit("</title>"),
        F.when(i % 2 == 0, F.concat(F.lit("<description>about "), title, F.lit("</description>"))).otherwise(""),
        F.lit("<link>"),
        url,
        F.lit("</link><pubDate>Mon, "),
        F.date_format(at, "dd MMM yyyy HH:mm:ss"),
        F.lit(" +0200</pubDate>"),
        F.when(i % 7 == 0, "<dc:creator>Ann</dc:creator>").otherwise(""),
        F.when(i % 3 == 0, "<category>world</category><category>europe</category>").otherwise(""),
        F.lit("</item>"),
    ]


def _atom_parts(i: Column, title: Column, url: Column, at: Column) -> list[Column]:
    return [
        F.lit("<entry><title type=\"html\">"),
        title,
        F.lit("</title>"),
        F.when(i % 2 == 0, F.concat(F.lit("<summary>about "), title, F.lit("</summary>"))).otherwise(""),
        F.lit('<link rel="self" href="https://feed.example/x"/><link href="'),
        url,
        F.lit('"/><updated>'),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("+02:00</updated>"),
        F.when(i % 7 == 0, "<author><name>Joe</name><uri>https://joe.example</uri></author>").otherwise(""),
        F.when(i % 3 == 0, '<category term="world" label="World"/><category term="europe"/>').otherwise(""),
        F.lit("</entry>"),
    ]
