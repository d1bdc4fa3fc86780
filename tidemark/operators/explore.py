"""Exploration queries over analysed articles, topics and trends."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.ordering import all_of
from tidemark.functions.text import article_search
from tidemark.operators.trends import RISING

NOISE = -1


def topic_summary(articles: DataFrame, names: DataFrame, keywords: DataFrame, coherence: DataFrame) -> DataFrame:
    """One row per topic: size, share of all articles, outlets, keywords, coherence, first and last seen."""
    total = articles.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).scalar()
    # Counting per (cluster, source) first keeps a hot cluster out of the distinct count.
    per_source = (
        articles.filter(F.col("cluster") != NOISE)
        .groupBy("cluster", "source")
        .agg(F.count(F.lit(1)).alias("n"), F.min("published").alias("a"), F.max("published").alias("b"))
    )
    sizes = per_source.groupBy(F.col("cluster").alias("topic_id")).agg(
        F.sum("n").alias("articles"),
        F.count("source").alias("sources"),
        F.min("a").alias("first_seen"),
        F.max("b").alias("last_seen"),
    )
    words = keywords.select("topic_id", F.array_join(F.slice("keywords", 1, 8), ", ").alias("keywords"))
    return (
        sizes.join(names, "topic_id", "left")
        .join(words, "topic_id", "left")
        .join(coherence, "topic_id", "left")
        .select(
            "topic_id",
            "topic",
            "articles",
            (100 * F.col("articles") / total).alias("share_pct"),
            "sources",
            "keywords",
            F.coalesce("coherence", F.lit(0.0)).alias("coherence"),
            "first_seen",
            "last_seen",
        )
    )


def by_size(topics: DataFrame) -> DataFrame:
    return topics.orderBy(F.desc("articles"), "topic_id")


def topic_with_trend(topics: DataFrame, trends: DataFrame) -> DataFrame:
    return topics.join(trends.select("topic_id", "trend", "emerging_score", "growth_rate"), "topic_id", "left")


def overview(articles: DataFrame, trends: DataFrame) -> DataFrame:
    """One row: articles, topics, sources, rising topics, noise."""
    rising = trends.agg(F.count_if(F.col("trend") == RISING).alias("r")).scalar()
    cells = articles.groupBy("cluster", "source").agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_articles"),
        F.count_distinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("n_topics"),
        F.count_distinct("source").alias("n_sources"),
        F.coalesce(F.sum(F.when(F.col("cluster") == NOISE, F.col("n"))), F.lit(0)).alias("n_noise"),
    ).select(
        "*",
        rising.alias("n_rising"),
        (100 * F.col("n_noise") / F.greatest("n_articles", F.lit(1))).alias("noise_pct"),
    )


def top_emerging(trends: DataFrame, n: int = 4) -> DataFrame:
    """The first ``n`` topics by score, with a progress value in 0..1."""
    progress = F.least(F.greatest(F.col("emerging_score"), F.lit(0.0)), F.lit(1.0))
    return trends.orderBy(F.desc("emerging_score"), "topic_id").limit(n).withColumn("progress", progress)


def default_trend_topics(trends: DataFrame, counts: DataFrame, n: int = 4) -> DataFrame:
    """Ids of the top ``n`` topics by score; without trends the first ``n`` topic ids."""
    top = trends.orderBy(F.desc("emerging_score"), "topic_id").limit(n).select("topic_id")
    first = counts.select("topic_id").distinct().orderBy("topic_id").limit(n)
    none = trends.limit(1).agg((F.count(F.lit(1)) == 0).alias("e")).scalar()
    return top.unionByName(first.filter(none))


def trend_lines(counts: DataFrame, topic_ids: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Daily counts of the chosen topics (a handful of ids, one screen)."""
    lines = counts.join(topic_ids.select("topic_id"), "topic_id", "left_semi")
    if names is None:
        return lines
    return lines.join(names, "topic_id", "left").withColumn(
        "topic", F.coalesce("topic", F.col("topic_id").cast("string"))
    )


def topic_distribution(topics: DataFrame) -> DataFrame:
    return topics.select("topic", "articles", "share_pct").orderBy("articles", "topic")


def topic_latest(articles: DataFrame, topic_id: int, n: int = 50) -> DataFrame:
    """The ``n`` newest articles of one topic."""
    hits = articles.filter(F.col("cluster") == topic_id)
    return hits.orderBy(F.desc("published"), "article_id").limit(n).select("published", "source", "title")


def topic_keywords(keywords: DataFrame, topic_id: int) -> DataFrame:
    return keywords.filter(F.col("topic_id") == topic_id)


def source_mix(articles: DataFrame, topic_id: int, n: int = 15) -> DataFrame:
    """The ``n`` most frequent sources of one topic."""
    hits = articles.filter(F.col("cluster") == topic_id)
    counts = hits.groupBy("source").agg(F.count(F.lit(1)).alias("articles"))
    return counts.orderBy(F.desc("articles"), "source").limit(n)


def date_range(start: dt.date, end: dt.date) -> Column:
    """Inclusive calendar-day range as a half-open timestamp range, which Parquet can push down."""
    after = end + dt.timedelta(days=1)
    low = F.lit(start.isoformat()).cast("timestamp_ntz")
    high = F.lit(after.isoformat()).cast("timestamp_ntz")
    return (F.col("published") >= low) & (F.col("published") < high)


def article_filter(
    articles: DataFrame,
    search: str = "",
    topics: list[str] | None = None,
    sources: list[str] | None = None,
    days: tuple[dt.date, dt.date] | None = None,
    day_col: str | None = None,
) -> DataFrame:
    """Search text, topic names, sources and date range, all optional.

    ``day_col`` names the day of ``published`` if the table is partitioned by it, so that other days are not opened.
    """
    tests = []
    if search:
        tests.append(article_search(F.col("title"), F.col("description"), search))
    if topics:
        tests.append(F.col("topic_name").isin(topics))
    if sources:
        tests.append(F.col("source").isin(sources))
    if days:
        tests.append(date_range(*days))
        if day_col:
            tests.append(F.col(day_col).between(*days))
    return articles.filter(all_of(tests))


def article_list(articles: DataFrame) -> DataFrame:
    cols = ["published", "source", "topic_name", "title", "url"]
    return articles.orderBy(F.desc("published"), "article_id").select(*cols)


def preview_articles(articles: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` articles with the totals shown above them."""
    totals = articles.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("s")).alias("t")
    ).scalar()
    head = articles.orderBy("article_id").limit(n).select("title", "source", "published")
    return head.withColumns({"n_articles": totals["n"], "n_sources": totals["s"]})


def filter_options(articles: DataFrame) -> DataFrame:
    """(kind, value): first and last day, all sources and all topics, to fill the filter boxes."""
    text = "yyyy-MM-dd"
    span = articles.agg(F.min("published").alias("a"), F.max("published").alias("b"))
    days = span.select(
        F.explode(
            F.array(
                F.struct(F.lit("first_day").alias("kind"), F.date_format("a", text).alias("value")),
                F.struct(F.lit("last_day").alias("kind"), F.date_format("b", text).alias("value")),
            )
        ).alias("o")
    ).select("o.*")
    values = articles.select(
        F.explode(
            F.array(
                F.struct(F.lit("source").alias("kind"), F.col("source").alias("value")),
                F.struct(F.lit("topic").alias("kind"), F.col("topic_name").alias("value")),
            )
        ).alias("o")
    ).select("o.*")
    options = values.filter(F.col("value").isNotNull()).distinct()
    return days.unionByName(options).orderBy("kind", "value")


def article_labels(articles: DataFrame) -> DataFrame:
    """(article_id, label): titles cut to 100 characters, as the box that picks an article lists them."""
    return articles.select("article_id", F.left("title", F.lit(100)).alias("label"))


def article_detail(articles: DataFrame, article_id: int) -> DataFrame:
    return articles.filter(F.col("article_id") == article_id).select(
        "title",
        "source",
        F.date_format("published", "dd MMM yyyy HH:mm").alias("published_text"),
        F.coalesce(F.nullif(F.col("topic_name"), F.lit("")), F.lit("Noise")).alias("topic_name"),
        "description",
        "url",
    )


def map_points(articles: DataFrame, hide_noise: bool = False) -> DataFrame:
    """Scatter data: position, topic, title, source, date text."""
    shown = articles.filter(F.col("cluster") != NOISE) if hide_noise else articles
    return shown.select(
        "article_id",
        "x",
        "y",
        F.coalesce("topic_name", F.lit("Noise / Unclustered")).alias("topic_name"),
        "title",
        "source",
        F.date_format("published", "dd MMM yyyy").alias("published_text"),
    )


def exact_median(df: DataFrame, group: str, col: str) -> DataFrame:
    """(group, col): exact median per group without gathering a group in one task.

    A quantile sketch of fixed size gives a bracket that surely holds the middle rows (its rank error is
    1e-5 of the group, the bracket is 2e-4 wide on each side). Rows below the bracket are only counted;
    the few inside it, merged by value, are ranked.
    """
    valued = df.select(group, F.col(col).cast("double").alias("_v"))
    ends = F.percentile_approx("_v", F.array(F.lit(0.4998), F.lit(0.5002)), F.lit(100000))
    bracket = valued.groupBy(group).agg(F.count("_v").alias("_n"), ends.alias("_q"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    keyed = valued.join(bracket.filter(F.col("_n") > 0), group).filter(F.col("_v") <= high)
    merged = keyed.groupBy(group, "_n", F.when(F.col("_v") >= low, F.col("_v")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    # Null (all rows below the bracket) sorts first, so its count shifts the ranks inside the bracket.
    upto = Window.partitionBy(group).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("_to", F.sum("_c").over(upto))
    covers = [(F.col("_to") >= r) & (F.col("_to") - F.col("_c") < r) for r in _middle_ranks(F.col("_n"))]
    picks = ranked.groupBy(group).agg(*[F.max(F.when(c, F.col("_v"))).alias(f"_m{i}") for i, c in enumerate(covers)])
    return picks.select(group, ((F.col("_m0") + F.col("_m1")) / 2).alias(col))


def _middle_ranks(n: Column) -> tuple[Column, Column]:
    return F.floor((n + 1) / 2), F.floor(n / 2) + 1


def map_labels(articles: DataFrame) -> DataFrame:
    """Median position per topic name, noise out."""
    shown = articles.filter(F.col("cluster") != NOISE).filter(F.col("topic_name").isNotNull())
    return exact_median(shown, "topic_name", "x").join(exact_median(shown, "topic_name", "y"), "topic_name")


def trend_table(trends: DataFrame) -> DataFrame:
    return trends.orderBy(F.desc("emerging_score"), "topic_id").select(
        "trend",
        "topic",
        "articles",
        F.col("previous").alias("prev_window"),
        F.col("recent").alias("recent_window"),
        (F.col("growth_rate") * 100).alias("growth_pct"),
        "source_diversity",
        "velocity",
        "emerging_score",
    )


def coherence_table(topics: DataFrame) -> DataFrame:
    return by_size(topics).select("topic", "articles", "coherence")


def topic_table(topics: DataFrame) -> DataFrame:
    """Topic list view; ``share_scale`` is the upper end of its share bar."""
    scale = topics.agg(F.greatest(F.max("share_pct"), F.lit(1.0)).alias("m")).scalar()
    trend = F.coalesce("trend", F.lit("")) if "trend" in topics.columns else F.lit("")
    return by_size(topics).select(
        "topic_id",
        "topic",
        "articles",
        F.col("share_pct").alias("share"),
        "sources",
        trend.alias("trend"),
        "keywords",
        scale.alias("share_scale"),
    )
