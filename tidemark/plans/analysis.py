"""End-to-end run: articles to topics, trends, stories and quality measures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import preprocess_articles
from tidemark.operators import clusters as cl
from tidemark.operators import topics as tp
from tidemark.operators.embeddings import MakeModel, generate_embeddings, lsa_embed
from tidemark.operators.explore import by_size, topic_summary, topic_with_trend
from tidemark.operators.reduce import reduce_dims
from tidemark.operators.stories import find_story_groups
from tidemark.operators.trends import daily_counts, emerging_topics, ranked
from tidemark.session import checkpointed


@dataclass
class Config:
    embedding_backend: str = "auto"  # auto | sbert | tfidf
    algorithm: str = "hdbscan"  # hdbscan | kmeans
    min_cluster_size: int = 40
    min_samples: int | None = None
    k: int = 8  # only for kmeans
    cluster_dims: int = 5
    method: str = "pca"  # pca | spectral | graph
    trend_window_days: int = 3
    dup_threshold: float = 0.80
    seed: int = 42
    silhouette: str = "sampled"  # sampled (exact up to 4,096 points) | exact | squared (another measure)
    embedding_dims: int = 100
    make_model: MakeModel | None = None


@dataclass
class Result:
    articles: DataFrame
    topics: DataFrame
    trends: DataFrame
    counts: DataFrame
    metrics: DataFrame
    keywords: DataFrame
    topic_names: DataFrame
    embeddings: DataFrame
    notes: list[str] = field(default_factory=list)


def run_analysis(articles: DataFrame, cfg: Config | None = None, name_overrides: DataFrame | None = None) -> Result:
    """Analyse a canonical article table.

    Cleaned texts, vectors, labels and keywords are written out once each, because several later steps
    read them; the returned tables are lazy on top of those.
    """
    cfg = cfg or Config()
    cl.require_articles(articles)
    notes: list[str] = []
    docs = checkpointed(preprocess_articles(articles))

    if cfg.embedding_backend == "tfidf":
        raw, used, note = lsa_embed(docs, cfg.embedding_dims, cfg.seed), "tfidf-svd", ""
    else:
        raw, used, note = generate_embeddings(
            docs, cfg.embedding_backend, cfg.make_model, dim=cfg.embedding_dims, seed=cfg.seed
        )
    if note:
        notes.append(note)
    vectors = checkpointed(raw)

    reduced, method = reduce_dims(vectors, cfg.cluster_dims, cfg.seed, method=cfg.method)
    reduced = checkpointed(reduced)
    if method != cfg.method:
        notes.append(f"{cfg.method} needs more than 20 articles; used {method}.")
    if method == "pca":
        flat = reduced  # the first two components are the two-dimensional projection
    else:
        flat, _ = reduce_dims(vectors, 2, cfg.seed, method=cfg.method)
    labels = checkpointed(
        cl.cluster(reduced, cfg.algorithm, cfg.min_cluster_size, cfg.min_samples, cfg.k, cfg.seed)
    )
    places = flat.select("article_id", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    placed = checkpointed(docs.join(labels, "article_id").join(places, "article_id"))

    keywords = tp.cluster_keywords(tp.class_tfidf(placed))
    names = checkpointed(tp.unique_topic_names(tp.name_topics(keywords, name_overrides)))
    coherence = checkpointed(tp.npmi_coherence(keywords, docs))
    named = tp.label_articles(placed, names)

    labelled = reduced.join(labels, "article_id")
    average = tp.average_coherence(coherence).scalar()
    metrics = cl.evaluate(checkpointed(labelled), cfg.silhouette).select(
        "*",
        average.alias("avg_coherence"),
        F.lit(used).alias("embedding_backend"),
        F.lit(method).alias("reduction"),
        F.lit(cfg.algorithm).alias("algorithm"),
    )
    trends = checkpointed(emerging_topics(placed, names, cfg.trend_window_days))
    stories = find_story_groups(named, vectors, cfg.dup_threshold)
    topics = by_size(topic_with_trend(topic_summary(placed, names, keywords, coherence), trends))
    return Result(
        stories, topics, ranked(trends), daily_counts(placed), metrics, keywords, names, vectors, notes
    )
