"""Daily topic counts, window comparison, emerging score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


NOISE = -1

# Weights of the score and the labels.
WEIGHTS = {"growth": 0.35, "recent_activity": 0.25, "source_diversity": 0.20, "velocity": 0.20}
RISING, GROWING, DECLINING, STABLE = "🔥 Rising", "↑ Growing", "↓ Declining", "→ Stable"

TREND_COLUMNS = [
    "topic_id",
    "topic",
    "articles",
    "recent",
    "previous",
    "growth_rate",
    "recent_activity",
    "source_diversity",
    "velocity",
    "emerging_score",
    "trend",
]


def topic_day_source(articles: DataFrame) -> DataFrame:
    """(topic_id, day, source, n) without noise: the one pass over the articles.

    Everything below works on this pre-aggregated table, so a topic that holds a third of all articles
    is reduced map-side to one row per day and source before any shuffle.
    """
    return (
        articles.filter(F.col("cluster") != NOISE)
        .groupBy(F.col("cluster").alias("topic_id"), F.to_date("published").alias("day"), "source")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _sparse_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("topic_id", "day").agg(F.sum("n").alias("n"))


def daily_counts(articles: DataFrame) -> DataFrame:
    """(day, topic_id, n) for every day between the first and last one, zeros filled."""
    return filled_days(_sparse_counts(topic_day_source(articles)))


def filled_days(counts: DataFrame) -> DataFrame:
    """``counts(topic_id, day, n)`` with a row for every topic and day between the first and last day."""
    span = counts.agg(F.struct(F.min("day").alias("a"), F.max("day").alias("b")).alias("s")).scalar()
    calendar = (
        counts.select("topic_id")
        .distinct()
        .select("topic_id", F.explode(F.sequence(span["a"], span["b"])).alias("day"))
    )
    return calendar.join(counts, ["topic_id", "day"], "left").select(
        "day", "topic_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def daily_counts_wide(articles: DataFrame, topic_ids: list[int]) -> DataFrame:
    """One column per given topic; the id list is an argument, so no job runs to find it."""
    long = daily_counts(articles)
    return long.groupBy("day").pivot("topic_id", topic_ids).agg(F.first("n")).na.fill(0)


def label_for(score: Column, growth: Column) -> Column:
    return (
        F.when(score >= 0.60, RISING)
        .when((score >= 0.40) | (growth > 0.15), GROWING)
        .when(growth < -0.15, DECLINING)
        .otherwise(STABLE)
    )


def _clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def window_compare(articles: DataFrame, window_days: int = 3) -> DataFrame:
    """Per topic: counts of the last window and the one before, totals, slope, source counts.

    The window is at most half of the history; a history of one day gives no rows.
    """
    return compare_cells(topic_day_source(articles), window_days)


def compare_cells(cells: DataFrame, window_days: int = 3) -> DataFrame:
    """``window_compare`` from (topic_id, day, source, n) rows; a cell may come in several parts."""
    span = cells.agg(F.struct(F.min("day").alias("a"), F.max("day").alias("b")).alias("s")).scalar()
    tagged = cells.withColumns({"_a": span["a"], "_b": span["b"]})
    days = F.datediff("_b", "_a") + 1
    tagged = tagged.withColumn("days", days).filter(F.col("days") >= 2)
    width = F.greatest(F.lit(1), F.least(F.lit(window_days), F.floor(F.col("days") / 2).cast("int")))
    tagged = tagged.withColumn("w", width).withColumn("age", F.datediff("_b", "day"))
    is_recent = F.col("age") < F.col("w")
    is_previous = (F.col("age") >= F.col("w")) & (F.col("age") < 2 * F.col("w"))
    # Least-squares slope over the dense calendar x = 0..D-1: days without articles add nothing to
    # sum(x*n), so the sparse counts are enough.
    x = F.datediff("day", "_a")
    per_source = tagged.groupBy("topic_id", "source", "days").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(is_recent, F.col("n")).otherwise(0)).alias("r"),
        F.sum(F.when(is_previous, F.col("n")).otherwise(0)).alias("p"),
        F.sum(x * F.col("n")).alias("xn"),
    )
    d = F.col("days").cast("double")
    topics = per_source.groupBy("topic_id", "days").agg(
        F.sum("n").alias("articles"),
        F.sum("r").alias("recent"),
        F.sum("p").alias("previous"),
        F.sum("xn").alias("xn"),
        F.count("source").alias("sources"),
        F.count_if((F.col("r") > 0) & F.col("source").isNotNull()).alias("recent_sources"),
    )
    sxx = d * (d * d - 1) / 12
    sxy = F.col("xn") - F.col("articles") * (d - 1) / 2
    return topics.withColumns({"slope": sxy / sxx, "mean": F.col("articles") / d}).drop("xn")


def score_topics(topics: DataFrame) -> DataFrame:
    """Adds growth, activity, diversity, velocity, score and label to ``window_compare`` rows."""
    totals = topics.agg(
        F.struct(F.sum("recent").alias("all"), F.max("recent").alias("top")).alias("s")
    ).scalar()
    total_recent = F.greatest(totals["all"], F.lit(1))
    growth = (F.col("recent") - F.col("previous")) / F.greatest(F.col("previous"), F.lit(1))
    diversity = F.col("recent_sources") / F.greatest(F.col("sources"), F.lit(1))
    velocity = F.col("slope") / F.greatest(F.col("mean"), F.lit(1e-9))
    parts = topics.withColumns(
        {
            "growth_rate": growth,
            "recent_activity": F.col("recent") / total_recent,
            "source_diversity": F.when(F.col("recent") > 0, diversity).otherwise(F.lit(0.0)),
            "velocity": velocity,
        }
    )
    top_activity = F.greatest(totals["top"] / total_recent, F.lit(1e-9))
    score = (
        WEIGHTS["growth"] * _clip(F.col("growth_rate"), 0.0, 2.0) / 2
        + WEIGHTS["recent_activity"] * F.col("recent_activity") / top_activity
        + WEIGHTS["source_diversity"] * F.col("source_diversity")
        + WEIGHTS["velocity"] * _clip(F.col("velocity"), 0.0, 0.5) / 0.5
    )
    return parts.withColumn("emerging_score", F.bround(score, 3)).withColumn(
        "trend", label_for(F.col("emerging_score"), F.col("growth_rate"))
    )


def emerging_topics(articles: DataFrame, names: DataFrame | None = None, window_days: int = 3) -> DataFrame:
    """The trend table, one row per topic; ``names(topic_id, topic)`` is optional."""
    return trends_from_cells(topic_day_source(articles), names, window_days)


def trends_from_cells(cells: DataFrame, names: DataFrame | None = None, window_days: int = 3) -> DataFrame:
    """The trend table from (topic_id, day, source, n) rows, which may come in several parts."""
    scored = score_topics(compare_cells(cells, window_days))
    default = F.concat(F.lit("Topic "), F.col("topic_id").cast("string"))
    if names is None:
        scored = scored.withColumn("topic", default)
    else:
        scored = scored.join(names, "topic_id", "left").withColumn("topic", F.coalesce("topic", default))
    return scored.select(*TREND_COLUMNS)


def ranked(trends: DataFrame) -> DataFrame:
    return trends.orderBy(F.desc("emerging_score"), "topic_id")
