"""Landed RSS and Atom files to article rows; the fetch itself is not part of this package."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.session import checkpointed
from tidemark.sources.articles import parse_published

# The default feeds.
DEFAULT_FEEDS = {
    "BBC World": "http://feeds.bbci.co.uk/news/world/rss.xml",
    "BBC Technology": "http://feeds.bbci.co.uk/news/technology/rss.xml",
    "BBC Business": "http://feeds.bbci.co.uk/news/business/rss.xml",
    "The Guardian World": "https://www.theguardian.com/world/rss",
    "The Guardian Tech": "https://www.theguardian.com/technology/rss",
    "TechCrunch": "https://techcrunch.com/feed/",
    "NDTV": "https://feeds.feedburner.com/ndtvnews-top-stories",
    "Times of India": "https://timesofindia.indiatimes.com/rssfeedstopstories.cms",
    "Al Jazeera": "https://www.aljazeera.com/xml/rss/all.xml",
}

# One schema for both forms: RSS holds plain text where Atom uses attributes and child elements.
_S = T.StringType()


def _fields(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


ITEM_SCHEMA = T.StructType(
    [
        *_fields("title", "summary", "description", "content", "pubDate", "published", "updated", "dc:creator", "dc:date"),
        T.StructField("link", T.ArrayType(_fields("_VALUE", "_href", "_rel"))),
        T.StructField("author", T.ArrayType(_fields("_VALUE", "name"))),
        T.StructField("category", T.ArrayType(_fields("_VALUE", "_term"))),
        T.StructField("_corrupt_record", _S),
    ]
)


def feed_list(chosen: dict[str, str] | None = None, custom: str = "") -> dict[str, str]:
    """Feeds to collect: the chosen ones or the defaults, plus one ``Name|URL`` entry."""
    feeds = dict(chosen or {})
    if "|" in custom:
        name, url = custom.split("|", 1)
        feeds[name.strip()] = url.strip()
    return feeds or dict(DEFAULT_FEEDS)


def _text(*fields: str | Column) -> Column:
    """First non-empty field, or empty text."""
    columns = [F.col(f"`{f}`") if isinstance(f, str) else f for f in fields]
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def _link() -> Column:
    """The text of an RSS link, else the address of the first Atom link to the article itself."""
    own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    first = F.get(own, F.lit(0))
    return _text(first["_VALUE"], first["_href"])


def item_rows(items: DataFrame, keep: tuple[str, ...] = ("feed", "pos")) -> DataFrame:
    """Parsed items (``feed``, ``pos`` and the item fields) to article columns, with the columns to ``keep`` in front."""
    return items.select(
        *keep,
        _text("title").alias("title"),
        _text("summary", "description", "content").alias("description"),
        F.col("feed").alias("source"),
        _link().alias("url"),
        parse_published(_text("pubDate", "published", "dc:date", "updated")).alias("published"),
        _text(F.get("author", F.lit(0))["name"], F.get("author", F.lit(0))["_VALUE"], "dc:creator").alias("author"),
        _text(F.get("category", F.lit(0))["_term"], F.get("category", F.lit(0))["_VALUE"]).alias("category"),
    )


def limit_per_feed(rows: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` items of each feed: the collector's own rule, by position in the feed."""
    w = Window.partitionBy("feed").orderBy("pos")
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def read_feed(spark: SparkSession, name: str, path: str, row_tag: str = "item") -> DataFrame:
    """One landed feed file (``row_tag`` is ``item`` for RSS, ``entry`` for Atom).

    The parsed items are written out once: the articles and the status both read them.
    """
    raw = (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("mode", "PERMISSIVE")
        .schema(ITEM_SCHEMA)
        .load(path)
        .withColumn("feed", F.lit(name))
        .withColumn("pos", F.monotonically_increasing_id())
    )
    return checkpointed(raw)


def parse_items(df: DataFrame, xml_col: str) -> DataFrame:
    """Item XML held in a column to parsed item fields (bad XML fills ``_corrupt_record``)."""
    parsed = df.withColumn("_x", F.from_xml(xml_col, ITEM_SCHEMA, {"mode": "PERMISSIVE"}))
    return parsed.select(*[c for c in df.columns if c != xml_col], "_x.*")


def landed_items(raw: DataFrame) -> DataFrame:
    """Rows of the ``landed_feeds`` source with parsed fields; the error of a file stands in its last row."""
    parsed = parse_items(raw.withColumn("_xml", F.col("xml")), "_xml")
    return parsed.withColumn("_corrupt_record", F.coalesce("_corrupt_record", "error")).drop("error")


def landed_articles(items: DataFrame) -> DataFrame:
    """Articles of :func:`landed_items`, by feed, file and position."""
    good = items.filter(F.col("xml").isNotNull() & F.col("_corrupt_record").isNull())
    return item_rows(good, ("feed", "file", "pos"))


def fetch_counts(items: DataFrame) -> DataFrame:
    """(feed, file, n, n_bad) of :func:`landed_items`: one row per file, those without items too."""
    bad = F.col("_corrupt_record").isNotNull()
    counts = (F.count_if(F.col("xml").isNotNull() & ~bad).alias("n"), F.count_if(bad).alias("n_bad"))
    return items.groupBy("feed", "file").agg(*counts)


def collect_feeds(parsed: list[DataFrame] | DataFrame, limit: int = 100) -> DataFrame:
    """Articles of all feeds; corrupt items are left out and show in ``feed_status``."""
    items = parsed if isinstance(parsed, DataFrame) else reduce(DataFrame.unionByName, parsed)
    good = items.filter(F.col("_corrupt_record").isNull())
    return limit_per_feed(item_rows(good), limit)


def _status(feeds: DataFrame, counts: DataFrame) -> DataFrame:
    # The messages.
    message = (
        F.when(F.coalesce("n", F.lit(0)) > 0, F.concat(F.col("n").cast("string"), F.lit(" articles")))
        .when(F.coalesce("n_bad", F.lit(0)) > 0, "error: malformed feed item")
        .otherwise("no entries (feed empty or unreachable)")
    )
    return feeds.select("feed").join(counts, "feed", "left").select("feed", message.alias("status"))


def feed_status(feeds: DataFrame, parsed: DataFrame, limit: int = 100) -> DataFrame:
    """One message per feed of ``feeds(feed)``: item count, no entries, or an error."""
    bad = F.col("_corrupt_record").isNotNull()
    counts = parsed.groupBy("feed").agg(
        F.least(F.count_if(~bad), F.lit(limit)).alias("n"), F.count_if(bad).alias("n_bad")
    )
    return _status(feeds, counts)


def newest_status(feeds: DataFrame, fetches: DataFrame) -> DataFrame:
    """One message per feed from its newest file, by the rows of :func:`fetch_counts` (a repeated row changes nothing)."""
    newest = fetches.groupBy("feed").agg(F.max(F.struct("file", "n", "n_bad")).alias("f"))
    return _status(feeds, newest.select("feed", "f.n", "f.n_bad"))
