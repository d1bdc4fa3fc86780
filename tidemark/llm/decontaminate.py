"""Benchmark decontamination by winnowing: shared fingerprints find the candidates, whole windows decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast_if_small, by_place, lower_ascii, named_again
from tidemark.session import checkpointed

WINDOW = 13
GRAM = 5
SHARE = 20  # a document is contaminated if hit words times SHARE reach its words
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in lower case: runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BREAK), lambda w: w != "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _prints(text: Column, size: int, winnowed: bool) -> Column:
    """Distinct hashes of a text's runs of ``size`` words: the winnowed ones, or all."""
    return _let(words_of(text), lambda w: _let(_hashes(w, size), _winnowed if winnowed else F.array_distinct))


def _hashes(words: Column, size: int) -> Column:
    """Hash of each run of ``size`` words."""
    runs = F.sequence(F.lit(0), F.size(words) - size)
    return F.when(F.size(words) >= size, F.transform(runs, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))


def _winnowed(hashes: Column) -> Column:
    """Distinct least hashes of all stretches that make up a window: any shared window shares one of them."""
    width = WINDOW - GRAM + 1
    stretches = F.sequence(F.lit(0), F.size(hashes) - width)
    least = F.transform(stretches, lambda i: F.least(*(F.get(hashes, i + k) for k in range(width))))
    return F.when(F.size(hashes) >= width, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _runs(words: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.struct(i.cast("int").alias("at"), F.concat_ws(" ", F.slice(words, i + 1, size)).alias("run")))


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(text_key, at, n, item): each occurrence of a benchmark window in a distinct text, by first word and length.

    Windows of ``WINDOW`` words: documents and items are winnowed alike (least hash of ``GRAM`` words in each stretch
    of a window), so a shared window always gives a shared fingerprint. Texts that share one are extended: the
    windows around each shared gram are compared word by word, by equality of the joined words. An item with fewer
    words is one window; every document run of its length is compared, by hash and then by words. Copies of a
    text share a key and are worked on once after the join of fingerprints.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(item_text_col)).alias("words"))
    items = checkpointed(items.withColumn("n_words", F.size("words")).filter("n_words > 0").distinct())
    sizes = [r.n for r in items.select(F.least("n_words", F.lit(WINDOW)).alias("n")).distinct().collect()]  # 13 at most
    keyed = docs.select(F.col(text_col).alias("text")).withColumn("text_key", F.sha2("text", 256))
    out = None
    for n in sorted(sizes):
        gram = GRAM if n == WINDOW else n
        own = items.filter(F.col("n_words") >= WINDOW if n == WINDOW else F.col("n_words") == n)
        text = F.col("text")
        prints = own.select(F.explode(_prints(F.concat_ws(" ", "words"), gram, n == WINDOW)).alias("print")).distinct()
        prints = broadcast_if_small(checkpointed(prints))
        found = keyed.select("text_key", F.explode(_prints(text, gram, n == WINDOW)).alias("print")).join(prints, "print").distinct()
        runs = own.select("item", F.explode(_runs(F.col("words"), n)).alias("r")).select("item", F.col("r.run").alias("run")).distinct()
        runs = broadcast_if_small(checkpointed(runs), 64 << 20)
        shared = checkpointed(found.groupBy("text_key").agg(F.collect_set("print").alias("prints")))
        texts = _texts(keyed, shared)
        # windows that hold a shared gram, each once
        near = lambda w: _let(
            _let(_hashes(w, gram), lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains("prints", F.get(h, i)))),
            lambda g: F.array_distinct(F.flatten(F.transform(g, lambda i: F.sequence(F.greatest(i - (n - gram), F.lit(0)), i)))),
        )
        around = _let(words_of(text), lambda w: F.transform(F.filter(near(w), lambda i: i + n <= F.size(w)), lambda i: F.struct(i.alias("at"), F.concat_ws(" ", F.slice(w, i + 1, n)).alias("run"))))
        tried = texts.select("text_key", F.explode(around).alias("t"))
        hit = tried.select("text_key", F.col("t.at").alias("at"), F.lit(n).alias("n"), F.col("t.run").alias("run")).join(runs, "run").select("text_key", "at", "n", "item")
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        return docs.sparkSession.createDataFrame([], "text_key string, at int, n int, item string")
    return out


def _texts(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """One row per distinct text that shares a fingerprint, with its fingerprints."""
    held = keyed.join(broadcast_if_small(shared), "text_key")
    return held.groupBy("text_key").agg(F.first("text").alias("text"), F.first("prints").alias("prints"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (long), items array<string> (sorted) and contaminated boolean.

    A word is hit if it lies in an occurrence of a benchmark window, ``WINDOW`` consecutive words of an item (an item
    of fewer, but not none, is one window). Contaminated: some word is hit and hit words are at least 1 of ``SHARE``.
    Null and wordless texts have no words and are clean. Repeated rows and copies get the same result; an item
    without id counts as item ''. Columns of ``docs`` with these names are replaced.
    """
    found = hits(docs, benchmark, text_col, item_col, item_text_col)
    spans = F.array_sort(F.collect_set(F.struct("at", "n")))
    # words covered by the union of the spans: walk them in order, adding what lies beyond the end so far
    walk = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["n"]).alias("end"), (s["sum"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(s["end"], x["at"]))).alias("sum")),
        lambda s: s["sum"],
    )
    per_text = found.groupBy("text_key").agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("_items"))
    per_text = broadcast_if_small(checkpointed(per_text.select(F.col("text_key").alias("_key"), walk.cast("long").alias("_hit"), "_items")))
    made = ("n_words", "n_hit", "n_items", "items", "contaminated")
    rows, names = by_place(docs, made)
    text = F.col(names[text_col])
    out = rows.withColumn("_at", F.sha2(text, 256)).join(per_text, F.col("_at") == F.col("_key"), "left")
    n_words = F.size(words_of(text)).cast("long")
    out = out.select(*names.values(), n_words.alias("n_words"), F.coalesce("_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"))
    return out.select(*named_again(names), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
