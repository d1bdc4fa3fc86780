"""Registered queries: every one reads whole tables of ``sf_dir``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.ordering import dense_index
from tidemark.functions.vectors import normalized
from tidemark.operators import clusters as cl
from tidemark.operators import density as de
from tidemark.operators import embeddings as em
from tidemark.operators import explore as ex
from tidemark.operators import features as ft
from tidemark.operators import neighbors as nb
from tidemark.operators import reduce as rd
from tidemark.operators import stories as so
from tidemark.operators import topics as tp
from tidemark.operators import trends as tr
from tidemark.plans import views as v
from tidemark.plans.analysis import Config, run_analysis
from tidemark.session import checkpointed, fresh_path, spread
from tidemark.sources import articles as art
from tidemark.sources import feeds as fd
from tidemark.sources import store as st
from tidemark.streaming import news as sn

DAYS = (dt.date(2024, 1, 4), dt.date(2024, 1, 9))
STAMP = "yyyy-MM-dd HH:mm:ss"


def r6(*cols: str) -> dict[str, Column]:
    return {c: F.round(c, 6) for c in cols}


def stamp(*cols: str) -> dict[str, Column]:
    return {c: F.date_format(c, STAMP) for c in cols}


def day_text(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# --- shared inputs -------------------------------------------------------------------------------


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return tx.preprocess_articles(spread(v.articles(spark, d)))


def cleaned_table(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned texts written out once, for queries that read them several times."""
    return checkpointed(cleaned(spark, d))


def named(spark: SparkSession, d: str) -> DataFrame:
    """Articles with a plain topic name, for the queries that only need some name."""
    name = F.when(F.col("cluster") != -1, F.concat(F.lit("Topic "), F.col("cluster").cast("string")))
    return v.articles(spark, d).withColumn("topic_name", name)


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Named articles with a position; a few multiples of the id stand in for the layout."""
    i = F.col("article_id")
    return named(spark, d).withColumns({"x": (i * 7 % 101) / 8, "y": (i * 13 % 97) / 8})


def trends(spark: SparkSession, d: str) -> DataFrame:
    return tr.emerging_topics(v.articles(spark, d))


def keyword_scores(spark: SparkSession, d: str) -> DataFrame:
    return tp.class_tfidf(cleaned_table(spark, d))


def keywords(spark: SparkSession, d: str) -> DataFrame:
    return tp.cluster_keywords(keyword_scores(spark, d))


def topics(spark: SparkSession, d: str) -> DataFrame:
    docs = cleaned_table(spark, d)
    kw = tp.cluster_keywords(tp.class_tfidf(docs))
    names = tp.unique_topic_names(tp.name_topics(kw))
    return ex.topic_summary(docs, names, kw, tp.npmi_coherence(kw, docs))


def simple_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topic table with plain names, for the views on top of it."""
    arts = named(spark, d)
    ids = arts.filter(F.col("cluster") != -1).select(F.col("cluster").alias("topic_id")).distinct()
    names = ids.select("topic_id", F.concat(F.lit("Topic "), F.col("topic_id").cast("string")).alias("topic"))
    kw = ids.select("topic_id", F.array(F.lit("k"), F.col("topic_id").cast("string")).alias("keywords"))
    coherence = ids.select("topic_id", (F.col("topic_id") / 10).alias("coherence"))
    return ex.topic_summary(arts, names, kw, coherence)


def rounded_topics(df: DataFrame) -> DataFrame:
    return df.withColumns({**r6("share_pct", "coherence"), **stamp("first_seen", "last_seen")})


# --- ingestion -----------------------------------------------------------------------------------


def date_texts(spark: SparkSession, d: str) -> DataFrame:
    """``events`` times written in the date forms that feeds and files use."""
    i, ts = F.col("article_id"), F.date_trunc("second", F.col("published"))
    forms = [
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.concat(F.lit("Mon, "), F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")),
        F.date_format(ts, "yyyy-MM-dd"),
        F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+05:30")),
        F.date_format(ts, "MM/dd/yyyy"),
        F.lit("soon"),
    ]
    text = F.coalesce(*[F.when(i % len(forms) == n, f) for n, f in enumerate(forms)])
    return v.event_articles(spark, d).select("article_id", text.alias("text"))


def parse_published(spark, d):
    parsed = date_texts(spark, d).select("article_id", art.parse_published("text").alias("published"))
    return parsed.withColumns(stamp("published"))


def fill_published(spark, d):
    parsed = date_texts(spark, d).select("article_id", art.parse_published("text").alias("published"))
    return art.fill_published(parsed).withColumns(stamp("published"))


def raw_articles(spark, d):
    """Articles as they come in: some titles blank, some sources missing, some dates unreadable."""
    return shape_raw(v.articles(spark, d))


def shape_raw(articles):
    i = F.col("article_id")
    return articles.select(
        i.alias("row"),
        F.when(i % 17 == 0, "  ").otherwise(F.col("title")).alias(" Headline"),
        F.col("description").alias("Content"),
        F.when(i % 13 == 0, "").when(i % 13 == 1, None).otherwise(F.col("source")).alias("publisher"),
        F.col("url").alias("link"),
        F.when(i % 19 == 0, "soon").otherwise(F.date_format("published", STAMP)).alias("date"),
    )


def normalize_articles(spark, d):
    return art.normalize_articles(raw_articles(spark, d), "row").withColumns(stamp("published"))


def dedup_title_source(spark, d):
    kept = art.dedup_title_source(v.articles(spark, d), "article_id")
    return kept.select("article_id", "title", "source")


def assign_article_id(spark, d):
    kept = art.dedup_title_source(v.articles(spark, d), "article_id").select(F.col("article_id").alias("row"))
    return dense_index(kept, "row", "article_id")


def parsed_items(spark, d):
    return fd.parse_items(v.feed_items(spark, d), "xml")


def parse_feed(spark, d):
    return fd.item_rows(parsed_items(spark, d)).withColumns(stamp("published"))


def parse_feed_atom(spark, d):
    parsed = fd.parse_items(v.feed_items(spark, d, atom=True), "xml")
    return fd.item_rows(parsed).withColumns(stamp("published"))


def feed_limit(spark, d):
    return fd.limit_per_feed(fd.item_rows(parsed_items(spark, d)), 20).select("feed", "pos", "url")


def feed_status(spark, d):
    feeds = spark.createDataFrame([(f"feed{n}",) for n in range(7)], "feed string")
    return fd.feed_status(feeds, parsed_items(spark, d))


def store_split(spark, d):
    """Articles of the first days stand for the stored table, all articles for the batch."""
    arts = v.articles(spark, d)
    batch = arts.withColumn("url", F.when(F.col("article_id") % 23 == 0, "").otherwise(F.col("url")))
    stored = arts.filter(F.col("published") < F.lit("2024-01-03").cast("timestamp_ntz")).select("url")
    return batch, stored


def save_new_articles(spark, d):
    batch, stored = store_split(spark, d)
    return st.new_articles(batch, stored, "article_id").select("article_id", "title", "url")


def inserted_count(spark, d):
    batch, stored = store_split(spark, d)
    return st.new_articles(batch, stored, "article_id").agg(F.count(F.lit(1)).alias("inserted"))


def stored_count(spark, d):
    batch, stored = store_split(spark, d)
    fresh = st.new_articles(batch, stored, "article_id").select("url")
    return fresh.unionByName(stored).agg(F.count(F.lit(1)).alias("articles"))


def export_articles(spark, d):
    hits = ex.article_filter(cleaned(spark, d), sources=["src1", "src2", "src3"], days=DAYS)
    return st.export_articles(hits).withColumns(stamp("published"))


def preview_articles(spark, d):
    return ex.preview_articles(v.articles(spark, d)).withColumns(stamp("published"))


# --- text ----------------------------------------------------------------------------------------


def strip_html(spark, d):
    return spread(v.table(spark, d, "pages")).select("page_id", tx.strip_html("html").alias("text"))


def light_clean(spark, d):
    return spread(v.table(spark, d, "pages")).select("page_id", tx.light_clean("html").alias("text"))


def heavy_clean(spark, d):
    return spread(v.table(spark, d, "pages")).select("page_id", tx.heavy_clean("html").alias("text"))


def words(spark, d):
    """Distinct lower-case words of all documents."""
    toks = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9-]+"), F.lit(0))
    return v.table(spark, d, "documents").select(F.explode(toks).alias("word")).distinct()


def simple_lemma(spark, d):
    return words(spark, d).select("word", tx.simple_lemma(F.col("word")).alias("lemma"))


def stopword_filter(spark, d):
    return words(spark, d).filter(tx.is_content_word(F.col("word")))


def preprocess_articles(spark, d):
    return cleaned(spark, d).select("article_id", "embedding_text", "tfidf_text")


def article_search(spark, d):
    hit = tx.article_search(F.col("title"), F.col("description"), "tion(er|al)? (the|of)")
    return v.articles(spark, d).filter(hit).select("article_id", "title")


# --- term features -------------------------------------------------------------------------------


def tokens(spark, d):
    return ft.tokens(cleaned(spark, d))


def ngrams(spark, d):
    """Word and word-pair occurrences, counted over the corpus."""
    return ft.ngrams(cleaned(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def term_freq(spark, d):
    return ft.term_freq(cleaned(spark, d))


def doc_freq(spark, d):
    return ft.doc_freq(ft.term_freq(cleaned(spark, d)), 2)


def vocab_topk(spark, d):
    return ft.vocabulary(ft.term_freq(cleaned(spark, d)), 20000, 2)


def tfidf(spark, d):
    return ft.tfidf(cleaned_table(spark, d)).withColumns(r6("weight"))


def normalize_vectors(spark, d):
    unit = normalized(F.transform("embedding", lambda x: x * 3))
    flat = v.vectors(spark, d).select("article_id", F.posexplode(unit).alias("pos", "value"))
    return flat.withColumns(r6("value"))


# --- topics --------------------------------------------------------------------------------------


def class_term_counts(spark, d):
    return tp.class_term_counts(cleaned_table(spark, d))  # reads the texts twice, for words and for borders


def class_tfidf(spark, d):
    return keyword_scores(spark, d).select("cluster", "term", "tf", "weight").withColumns(r6("weight"))


def class_term_rank(spark, d):
    return tp.class_term_rank(keyword_scores(spark, d), 100).select("cluster", "rank", "term")


def cluster_keywords(spark, d):
    return tp.keyword_rows(keywords(spark, d))


def npmi_coherence(spark, d):
    docs = cleaned_table(spark, d)
    kw = tp.cluster_keywords(tp.class_tfidf(docs))
    return tp.npmi_coherence(kw, docs).withColumns(r6("coherence"))


def average_coherence(spark, d):
    docs = cleaned_table(spark, d)
    kw = tp.cluster_keywords(tp.class_tfidf(docs))
    return tp.average_coherence(tp.npmi_coherence(kw, docs)).withColumns(r6("avg_coherence"))


def topic_names(spark, d):
    return tp.name_topics(keywords(spark, d))


def unique_topic_names(spark, d):
    """Sources as topics, named by their last digit, so that names repeat."""
    ids = v.articles(spark, d).select("source").distinct()
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    name = F.concat(F.lit("Source "), F.right("source", F.lit(1)))
    return tp.unique_topic_names(ids.select(number.alias("topic_id"), name.alias("topic")))


def label_articles(spark, d):
    names = tp.unique_topic_names(tp.name_topics(keywords(spark, d)))
    return tp.label_articles(v.articles(spark, d), names).select("article_id", "cluster", "topic_name")


def sample_titles(spark, d):
    titles = tp.sample_titles(v.articles(spark, d))
    return titles.withColumn("titles", F.array_join("titles", " | "))


# --- trends --------------------------------------------------------------------------------------


def daily_counts(spark, d):
    return day_text(tr.daily_counts(v.articles(spark, d)))


def daily_counts_wide(spark, d):
    return day_text(tr.daily_counts_wide(v.event_articles(spark, d), sorted(v.EVENT_TOPICS.values())))


def window_compare(spark, d):
    return tr.window_compare(v.event_articles(spark, d)).select("topic_id", "articles", "recent", "previous")


def source_diversity(spark, d):
    scored = tr.score_topics(tr.window_compare(v.event_articles(spark, d)))
    return scored.select("topic_id", "sources", "recent_sources", F.round("source_diversity", 6).alias("diversity"))


def velocity(spark, d):
    scored = tr.score_topics(tr.window_compare(v.event_articles(spark, d)))
    return scored.select("topic_id", "slope", "velocity").withColumns(r6("slope", "velocity"))


TREND_ROUND = ("growth_rate", "recent_activity", "source_diversity", "velocity", "emerging_score")


def emerging_score(spark, d):
    scored = tr.emerging_topics(v.event_articles(spark, d))
    return scored.select("topic_id", "growth_rate", "emerging_score").withColumns(r6("growth_rate", "emerging_score"))


def trend_label(spark, d):
    return trends(spark, d).select("topic_id", "trend")


def emerging_topics(spark, d):
    return tr.ranked(trends(spark, d)).withColumns(r6(*TREND_ROUND))


def emerging_topics_events(spark, d):
    return tr.ranked(tr.emerging_topics(v.event_articles(spark, d))).withColumns(r6(*TREND_ROUND))


# --- exploration ---------------------------------------------------------------------------------


def topic_summary(spark, d):
    return rounded_topics(topics(spark, d))


def topic_with_trend(spark, d):
    joined = ex.topic_with_trend(simple_topics(spark, d), trends(spark, d))
    return rounded_topics(joined).withColumns(r6("emerging_score", "growth_rate"))


def topic_table(spark, d):
    joined = ex.topic_with_trend(simple_topics(spark, d), trends(spark, d))
    return ex.topic_table(joined).withColumns(r6("share", "share_scale"))


def coherence_table(spark, d):
    return ex.coherence_table(simple_topics(spark, d)).withColumns(r6("coherence"))


def topic_distribution(spark, d):
    return ex.topic_distribution(simple_topics(spark, d)).withColumns(r6("share_pct"))


def overview(spark, d):
    return ex.overview(v.articles(spark, d), trends(spark, d)).withColumns(r6("noise_pct"))


def top_emerging(spark, d):
    top = ex.top_emerging(trends(spark, d))
    return top.select("topic_id", "trend", "topic", "recent", "emerging_score", "progress").withColumns(
        r6("emerging_score", "progress")
    )


def trend_lines(spark, d):
    counts = tr.daily_counts(v.articles(spark, d))
    return day_text(ex.trend_lines(counts, ex.default_trend_topics(trends(spark, d), counts, 3)))


def trend_table(spark, d):
    return ex.trend_table(trends(spark, d)).withColumns(
        r6("growth_pct", "source_diversity", "velocity", "emerging_score")
    )


def topic_latest(spark, d):
    return ex.topic_latest(v.articles(spark, d), 3).withColumns(stamp("published"))


def source_mix(spark, d):
    return ex.source_mix(v.articles(spark, d), 3)


def article_filter(spark, d):
    hits = ex.article_filter(
        named(spark, d),
        search="tion",
        topics=["Topic 1", "Topic 2", "Topic 5"],
        sources=[f"src{n}" for n in range(10)],
        days=DAYS,
    )
    return hits.select("article_id", "topic_name", "source", "published").withColumns(stamp("published"))


def stored_filter(spark, d):
    """The store, saved in two parts that share their URLs' first days, filtered by folders of days."""
    store = _paths(spark, "store")[0]
    articles = v.articles(spark, d)
    late = F.col("article_id") % 3 == 0
    for part in (articles.filter(late), articles):
        st.save_articles(part, store, "article_id")
    hits = ex.article_filter(st.load_days(spark, store), search="tion", sources=[f"src{n}" for n in range(10)], days=DAYS, day_col="day")
    return hits.select("title", "source", "url", "published").withColumns(stamp("published"))


def article_list(spark, d):
    return ex.article_list(named(spark, d)).withColumns(stamp("published"))


def filter_options(spark, d):
    return ex.filter_options(named(spark, d))


def article_labels(spark, d):
    """Labels of long titles: the given ones, each followed by its description."""
    long = F.concat_ws(" ", "title", "description")
    return ex.article_labels(named(spark, d).withColumn("title", long))


def article_detail(spark, d):
    return ex.article_detail(named(spark, d), 11)


def map_points(spark, d):
    return ex.map_points(placed(spark, d), hide_noise=True)


def map_labels(spark, d):
    return ex.map_labels(placed(spark, d))


# --- vectors, clusters, stories ------------------------------------------------------------------

STORY_COSINE = 0.35  # the given vectors have no pair at the default of 0.80


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_model():
    """Stand-in for a sentence model that SQL can compute too: how often each small letter occurs."""
    import numpy as np

    def embed(texts):
        return np.array([[(t or "").count(c) for c in LETTERS] for t in texts], dtype="float32").reshape(-1, len(LETTERS))

    return embed


def flat(df: DataFrame, key: str = "article_id", digits: int = 6) -> DataFrame:
    return df.select(key, F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", digits))


def lsa_embed(spark, d):
    return flat(em.lsa_embed(cleaned_table(spark, d), 20))


def batch_embed(spark, d):
    return flat(em.batch_embed(cleaned(spark, d), letter_model))


def semantic_keywords(spark, d):
    return em.semantic_keywords(cleaned(spark, d), letter_model)


def pca_reduce(spark, d):
    return flat(rd.pca_reduce(v.vectors(spark, d), 5))


def neighbor_layout(spark, d):
    return flat(rd.reduce_dims(v.vectors(spark, d), 2, method="graph")[0])


def spectral_layout(spark, d):
    return flat(rd.spectral_layout(v.vectors(spark, d), 2))


def knn_graph(spark, d):
    return nb.knn_graph(v.vectors(spark, d), 15).withColumns(r6("dist"))


def core_distance(spark, d):
    near = nb.knn_graph(v.vectors(spark, d), 9, "euclidean")
    return de.core_distance(near, 10).withColumns(r6("core"))


def mutual_reachability(spark, d):
    near = checkpointed(nb.knn_graph(v.vectors(spark, d), 9, "euclidean"))
    return de.mutual_reachability(near, de.core_distance(near, 10)).withColumns(r6("weight"))


def mst_edges(spark, d):
    tree = de.mst_edges(v.vectors(spark, d), 10)
    return tree.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


def density_cluster(spark, d):
    small = rd.pca_reduce(v.vectors(spark, d), 5)
    return de.density_cluster(checkpointed(small), 10, 5)


def kmeans_cluster(spark, d):
    return cl.kmeans_cluster(v.vectors(spark, d), 8)


def cluster_centroids(spark, d):
    return flat(cl.cluster_centroids(v.vectors(spark, d)), "cluster")


def assign_new(spark, d):
    """All vectors against the centroids of the given labels."""
    vec = v.vectors(spark, d)
    return cl.assign_new_articles(vec, cl.cluster_centroids(vec), 0.3).select("article_id", "cluster")


def cluster_counts(spark, d):
    return cl.cluster_counts(v.articles(spark, d)).withColumns(r6("noise_pct"))


def silhouette(spark, d):
    return cl.silhouette(v.vectors(spark, d)).withColumns(r6("silhouette"))


def davies_bouldin(spark, d):
    return cl.davies_bouldin(v.vectors(spark, d)).withColumns(r6("davies_bouldin"))


def similar_pairs(spark, d):
    return nb.similar_pairs(v.vectors(spark, d), STORY_COSINE).withColumns(r6("cosine"))


def told_stories(spark, d):
    arts = v.vectors(spark, d).drop("embedding").withColumn("title", F.concat(F.lit("title "), F.col("article_id").cast("string")))
    return so.find_story_groups(arts, v.vectors(spark, d), STORY_COSINE)


def story_components(spark, d):
    return so.story_table(v.vectors(spark, d), STORY_COSINE).select("article_id", "component", "size")


def story_groups(spark, d):
    return told_stories(spark, d).select("article_id", "story_id")


def story_summary(spark, d):
    return so.top_stories(so.story_summary(told_stories(spark, d))).select("story_id", "n", "outlets", "label")


def story_count(spark, d):
    return so.story_count(told_stories(spark, d))


def story_members(spark, d):
    return so.story_members(told_stories(spark, d), 1).withColumns(stamp("published"))


# --- streaming -----------------------------------------------------------------------------------


def _stream(spark, d, name):
    """A given table as a stream of its landed files. The glob fits one name, be it that of a file or of a folder of parts."""
    return sn.landed(spark, f"{d}/{name}.{{parquet}}", v.table(spark, d, name).schema)


def _paths(spark, *names):
    base = fresh_path(spark, "stream")
    return [f"{base}/{n}" for n in names]


def _event_stream(spark, d):
    return v.shape_events(_stream(spark, d, "events"))


def stream_ingest(spark, d):
    out, state = _paths(spark, "out", "state")
    sn.ingest(shape_raw(v.shape_articles(_stream(spark, d, "documents"))), out, state)
    return spark.read.parquet(out).drop("batch").withColumns(stamp("published"))


def _collected(spark, d):
    """Feed files that land in three steps, taken by a stream after each: its articles and its item counts per file."""
    root, articles, fetches, state = _paths(spark, "landed", "articles", "fetches", "state")
    files = checkpointed(v.feed_files(spark, d))
    last = files.agg(F.coalesce(F.max(F.col("part").cast("long")), F.lit(0)).alias("p")).scalar()
    for step in range(3):
        now = files.filter(F.floor(F.col("part").cast("long") * 3 / (last + 1)) == step)
        now.write.partitionBy("feed", "part").mode("append").text(root)
        sn.run_once(sn.feed_items(spark, root, 15), sn.keep_feeds(articles, fetches), state)
    return spark.read.parquet(articles), spark.read.parquet(fetches)


def stream_feeds(spark, d):
    articles = _collected(spark, d)[0]
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part")
    return articles.select(part, *[c for c in articles.columns if c not in ("file", "batch")]).withColumns(stamp("published"))


def stream_feed_status(spark, d):
    feeds = spark.createDataFrame([(f"feed{n}",) for n in range(7)], "feed string")
    return fd.newest_status(feeds, _collected(spark, d)[1])


def stream_dedup(spark, d):
    store, state = _paths(spark, "store", "state")
    sn.store_new(v.shape_articles(_stream(spark, d, "documents")), store, state, "article_id")
    return st.load_store(spark, store).select("title", "url")


def stream_daily_counts(spark, d):
    """Days that the watermark has passed; the last days of the stream stay open."""
    out, state = _paths(spark, "out", "state")
    sn.run_once(sn.daily_topic_counts(_event_stream(spark, d)), sn.append_to(out), state)
    return day_text(spark.read.parquet(out).drop("batch"))


def stream_late_counts(spark, d):
    """Daily counts of a stream that takes articles however late."""
    totals, state = _paths(spark, "totals", "state")
    sn.count_topics(_event_stream(spark, d), totals, state)
    return day_text(sn.current_counts(spark, totals))


def stream_assign(spark, d):
    out, state = _paths(spark, "out", "state")
    centroids = cl.cluster_centroids(v.vectors(spark, d))
    new = v.shape_vectors(_stream(spark, d, "embeddings"))
    sn.run_once(sn.assign_stream(new, centroids, 0.3).select("article_id", "cluster"), sn.append_to(out), state)
    return spark.read.parquet(out).drop("batch")


def stream_trends(spark, d):
    cells, trend, state = _paths(spark, "cells", "trends", "state")
    sn.refresh_trends(_event_stream(spark, d), cells, trend, state)
    newest = spark.read.parquet(trend)
    last = newest.agg(F.max("batch").alias("b")).scalar()
    return newest.filter(F.col("batch") == last).drop("batch").withColumns(r6(*TREND_ROUND))


def full_analysis(spark, d):
    """The end-to-end run with k-means over LSA vectors: its topic table."""
    cfg = Config(embedding_backend="tfidf", algorithm="kmeans", embedding_dims=20, silhouette="squared")
    return rounded_topics(run_analysis(spread(v.articles(spark, d)).drop("cluster"), cfg).topics)


def full_analysis_defaults(spark, d):
    """The end-to-end run at its defaults (100 dimensions, density clustering): one row per article."""
    cfg = Config(embedding_backend="tfidf")
    out = run_analysis(spread(v.articles(spark, d)).drop("cluster"), cfg).articles
    return out.select("article_id", "cluster", "topic_name", "story_id")


QUERIES = {
    f.__name__: f
    for f in (
        emerging_topics, emerging_topics_events, parse_published, fill_published, normalize_articles,
        dedup_title_source, assign_article_id, parse_feed, parse_feed_atom, feed_limit, feed_status, save_new_articles,
        inserted_count, stored_count, export_articles, preview_articles, strip_html, light_clean, heavy_clean,
        simple_lemma, stopword_filter, preprocess_articles, article_search, tokens, ngrams, term_freq, doc_freq,
        vocab_topk, tfidf, normalize_vectors, class_term_counts, class_tfidf, class_term_rank, cluster_keywords,
        npmi_coherence, average_coherence, topic_names, unique_topic_names, label_articles, sample_titles,
        daily_counts, daily_counts_wide, window_compare, source_diversity, velocity, emerging_score, trend_label,
        topic_summary, topic_with_trend, topic_table, coherence_table, topic_distribution, overview, top_emerging,
        trend_lines, trend_table, topic_latest, source_mix, article_filter, stored_filter, article_list, filter_options,
        article_labels, article_detail, map_points, map_labels, similar_pairs, story_components, story_groups, story_summary,
        story_count, story_members, cluster_centroids, assign_new, cluster_counts, silhouette, davies_bouldin,
        knn_graph, core_distance, mutual_reachability, stream_ingest, stream_feeds, stream_feed_status, stream_dedup, stream_daily_counts,
        stream_late_counts, stream_assign, stream_trends, batch_embed, semantic_keywords, lsa_embed, pca_reduce, kmeans_cluster,
        full_analysis, full_analysis_defaults, neighbor_layout, spectral_layout, mst_edges, density_cluster,
    )
}
