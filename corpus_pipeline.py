"""Corpus pipeline: five stages, each reads what its predecessor kept as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_decode, read_vocabulary
from tidemark.llm.common import table
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.simhash import fingerprints, near_duplicates
from tidemark.llm.toxicity import score, train
from tidemark.llm.vocabulary import vocabulary_path
from tidemark.session import checkpointed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones, rejects (score 0.5 or more) go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select(*COLUMNS), model).filter("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks of lines go from the later document; n_chars follows the text. Every document stays."""
    out = dedup_lines(docs.select(*COLUMNS))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that with the least id, once if its row is repeated.

    Rows that share an id but hold different texts are judged each by the component of its own text. Rows without id
    stay only if no document with an id is in their component. Documents without words share the fingerprint zero
    and so are copies of each other. Shingles and radius are those of op5.
    """
    # the first row of each id and fingerprint, by all columns, stands for it; partial minima go first
    rest = [c for c in COLUMNS if c != "doc_id"]
    loose = docs.filter("doc_id is null").select(*COLUMNS)
    groups = near_duplicates(docs.select("doc_id", "text"))
    first = groups.filter("doc_id = component").groupBy("root").agg(F.min(F.struct("doc_id", "print")).alias("r"))
    kept = checkpointed(first.select("r.doc_id", "r.print"))
    known = docs.select(*COLUMNS).join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    known = fingerprints(known, keep=tuple(rest)).withColumnRenamed("id", "doc_id").join(kept, ["doc_id", "print"], "left_semi")
    one = known.groupBy("doc_id", "print").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "r.*")
    if loose.isEmpty():
        return one.select(*COLUMNS)
    alone = checkpointed(groups.filter("component is null").select("print").distinct())
    prints = loose.withColumn("_row", F.monotonically_increasing_id())
    marked = fingerprints(prints, "_row").join(alone, "print", "left_semi").select(F.col("id").alias("_row"))
    return one.select(*COLUMNS).unionByName(prints.join(marked, "_row", "left_semi").select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark windows cover at least one word in twenty go."""
    benchmark = table(spark, sf_dir, "benchmark")
    return decontaminate(docs.select(*COLUMNS), benchmark).filter("not contaminated").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to."""
    out = encode_decode(docs, read_vocabulary(spark, vocabulary_path()), keep=("lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encode_decode", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again as the documents of the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
