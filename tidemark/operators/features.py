"""Term features: n-grams, counts, vocabulary, TF-IDF weights as postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import let


def token_list(text) -> Column:
    """Runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def has_token(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[\p{L}\p{N}_]{2}"))


def ngram_list(tokens: Column) -> Column:
    """All words and all pairs of neighbouring words."""

    def grams(t: Column) -> Column:
        pairs = F.greatest(F.size(t) - 1, F.lit(0))
        left, right = F.slice(t, F.lit(1), pairs), F.slice(t, F.lit(2), pairs)
        return F.concat(t, F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b)))

    return let(tokens, grams)


def tokens(docs: DataFrame, text: str = "tfidf_text", key: str = "article_id") -> DataFrame:
    return docs.select(key, F.posexplode(token_list(F.col(text))).alias("pos", "token"))


def ngrams(docs: DataFrame, text: str = "tfidf_text", key: str = "article_id") -> DataFrame:
    return docs.select(key, F.explode(ngram_list(token_list(F.col(text)))).alias("term"))


def run_counts(terms: Column) -> Column:
    """(term, tf) of each distinct element: the elements are sorted, and a run ends where the next one differs."""

    def ends(t: Column) -> Column:
        last = F.size(t) - 1
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (t[i] != t[i + 1]))

    def runs(t: Column) -> Column:
        def counted(e: Column) -> Column:
            before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(e[i - 1])
            return F.transform(e, lambda at, i: F.struct(t[at].alias("term"), (at - before(i)).cast("long").alias("tf")))

        return F.when(F.size(t) > 0, let(ends(t), counted))

    return let(F.sort_array(terms), runs)


def term_freq(docs: DataFrame, text: str = "tfidf_text", key: str = "article_id") -> DataFrame:
    """(key, term, tf).

    The texts of a document are brought together before they are cut into terms, and its terms are counted inside one row: a
    text is several times smaller than its postings, which are neither shuffled nor held in a hash table that spills.
    """
    by_doc = docs.groupBy(key).agg(F.collect_list(text).alias("_texts"))
    grams = F.flatten(F.transform("_texts", lambda t: ngram_list(token_list(t))))
    return by_doc.select(key, F.inline(run_counts(grams)))


def doc_freq(postings: DataFrame, min_df: int | Column = 1) -> DataFrame:
    """(term, df, total) with ``df >= min_df``."""
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    return counts.filter(F.col("df") >= min_df)


def vocabulary(postings: DataFrame, max_features: int = 20000, min_df: int | Column = 1) -> DataFrame:
    """The ``max_features`` terms of highest total count (ties by term): a top-k, no full sort."""
    return doc_freq(postings, min_df).orderBy(F.desc("total"), "term").limit(max_features)


def effective_min_df(n_docs: Column, min_df: int = 2) -> Column:
    return F.when(n_docs > 50, F.lit(min_df)).otherwise(F.lit(1))


def tfidf(
    docs: DataFrame,
    text: str = "tfidf_text",
    key: str = "article_id",
    max_features: int = 20000,
    min_df: int = 2,
) -> DataFrame:
    """(key, term, weight): sublinear tf, smooth idf, unit length per document."""
    return tfidf_indexed(docs, text, key, max_features, min_df).drop("idx")


def tfidf_indexed(
    docs: DataFrame,
    text: str = "tfidf_text",
    key: str = "article_id",
    max_features: int = 20000,
    min_df: int = 2,
) -> DataFrame:
    """(key, term, idx, weight); ``idx`` numbers the vocabulary in term order from 0.

    The vocabulary is at most ``max_features`` rows (20,000 short strings), so it is broadcast; the
    postings stay on their partitioning by document to the end.
    """
    postings = term_freq(docs, text, key)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    vocab = vocabulary(postings, max_features, effective_min_df(n_docs, min_df))
    idf = vocab.select(
        "term",
        (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"),
        (F.ln((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"),
    )
    small = F.broadcast(idf) if max_features <= 200_000 else idf
    raw = postings.join(small, "term").select(key, "term", "idx", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    # One document per window, on the partitioning that the postings already have.
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "idx", (F.col("w") / length).alias("weight"))
