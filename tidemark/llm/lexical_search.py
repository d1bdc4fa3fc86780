"""Ranked lexical search over an index stratified by the length normaliser."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import broadcast_if_small, dump, load, n_tasks, release_memory
from tidemark.session import checkpointed

TOP = 50
NO_ID = (1 << 63) - 1  # stands for a null id, which comes last
ITEM_BLOCK = 4096  # items searched at a time, and
TERM_BLOCK = 1 << 16  # the most terms that they may hold together, if more than one item
BLOCK_POSTINGS = 1 << 19
BLOCK_DOCS = 1 << 16
SEEDS = 16  # blocks of the highest bounds that give an item its floor
_SLICE = 1 << 20
_TERMS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def terms(text: bytes | None) -> Counter:
    """Occurrences of each term, A-Z in lower case; the text is cut between terms, about 1 MB at a time."""
    counts: Counter = Counter()
    text, at = text or b"", 0
    while at < len(text):
        gap = _GAP.search(text, at + _SLICE) if at + _SLICE < len(text) else None
        to = gap.start() if gap else len(text)
        counts.update(_TERMS.findall(text[at:to].translate(_LOWER)))
        at = to
    return counts


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


# --- index ------------------------------------------------------------------------------------------

COUNTED = "doc_id long, n long, terms array<int>, tf array<long>"
INDEX = "block long, docs int, low long, high long, terms array<int>, peaks array<long>, body binary"


def _counted(docs: DataFrame, words: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tf) of each text that has a term; terms are numbers of ``words``, others count in n only."""
    known = docs.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms(text.as_py())
                if found:
                    pairs = sorted((numbers[t], c) for t, c in found.items() if t in numbers)
                    rows.append((doc, found.total(), [t for t, _ in pairs], [c for _, c in pairs]))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n", "terms", "tf"])
            release_memory()

    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(work, COUNTED)


def _body(docs: np.ndarray, m: np.ndarray, doc_of: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Terms, their highest impacts, and the packed block: documents by stratum, postings by term, stratum and tf.

    Equal (stratum, tf) have one impact, computed once.
    """
    norms, stratum = np.unique(m, return_inverse=True)
    pairs, code = np.unique(np.stack([stratum[doc_of], tf], axis=1), axis=0, return_inverse=True)
    value = impact(pairs[:, 1], norms[pairs[:, 0]])
    order = np.lexsort((doc_of, -tf, stratum[doc_of], term))
    doc_of, term, code = doc_of[order], term[order], code.reshape(-1)[order]
    names, first = np.unique(term, return_index=True)
    # highest impact of each term in each stratum: the bound of a stratum is a sum of these
    cell, at = np.unique(term.astype(np.int64) * len(norms) + pairs[code, 0], return_index=True)
    best = np.maximum.reduceat(value[code], at) if len(at) else value[:0]
    peaks = np.maximum.reduceat(value[code], first) if len(first) else value[:0]
    packed = dump(docs, stratum.astype(np.int32), names, np.append(first, len(term)), doc_of.astype(np.int32), code.astype(np.int32), value, cell // max(len(norms), 1), cell % max(len(norms), 1), best, len(norms))
    return names, peaks, packed


def _blocks(placed: DataFrame) -> DataFrame:
    """Written index blocks of ``placed`` (doc_id, m, terms, tf): neighbouring strata, a bounded number of postings each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            docs, m = (np.asarray(t.column(c)) for c in ("doc_id", "m"))
            lists = t.column("terms").combine_chunks()
            lengths = np.diff(np.asarray(lists.offsets))
            doc_of = np.repeat(np.arange(len(docs)), lengths)
            term, tf = (np.asarray(t.column(c).combine_chunks().flatten()) for c in ("terms", "tf"))
            names, peaks, body = _body(docs, m, doc_of, term, tf)
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()), "docs": pa.array([len(docs)], pa.int32()), "low": pa.array([int(m.min())], pa.int64()), "high": pa.array([int(m.max())], pa.int64()),
                    "terms": pa.array([names], pa.list_(pa.int32())), "peaks": pa.array([peaks], pa.list_(pa.int64())), "body": pa.array([body], pa.binary()),
                }
            )

        for batch in batches:
            ends = np.cumsum(np.diff(np.asarray(batch.column("terms").offsets)).astype(np.int64)) + np.arange(1, batch.num_rows + 1) * (BLOCK_POSTINGS // BLOCK_DOCS)
            at = 0
            while at < batch.num_rows:
                used = int(ends[at - 1]) if at else 0
                to = max(int(np.searchsorted(ends, used + BLOCK_POSTINGS - size, "right")), at + (not held))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(ends[to - 1]) - used
                at = to
                if at < batch.num_rows:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()
        release_memory()

    order = ["m", F.xxhash64("doc_id"), "doc_id"]
    return checkpointed(placed.repartitionByRange(n_tasks(placed), *order).sortWithinPartitions(*order).mapInArrow(work, INDEX))


def build_index(docs: DataFrame, words: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int], int]:
    """(index blocks, documents that hold each term, documents with a term at all) of ``docs`` for the terms ``words``.

    Every text counts whole, for the lengths, the counts and the postings. Documents of one normaliser m are a stratum;
    the table is dealt by ranges of (m, document), so that a block holds whole neighbouring strata or, where one stratum
    is large, a part of it. Frequencies of the given terms are the only table that reaches the driver.
    """
    counted = checkpointed(_counted(docs, words, id_col, text_col))
    total = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = {r["t"]: r["d"] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("d")).collect()}
    m = F.expr(f"50 + (50 * n * {total['n']}L) div {max(total['l'], 1)}L")
    return _blocks(counted.filter(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tf")), df, total["n"]


# --- search ------------------------------------------------------------------------------------------


def weights(words: dict[bytes, int], df: dict[int, int], n: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(words))], np.int64)


def _score(body: bytes, items: list[np.ndarray], chosen: list[int], floors: np.ndarray, weight: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, doc_ids, scores): the ``top`` documents of a block for each chosen item whose score is its floor or more.

    Strata are visited from the highest bound down, some at a time; a stratum whose bound is below the floor, or
    below the ``top``-th score so far, is left out with all that follow.
    """
    docs, stratum, names, first, doc_of, code, value, cell_term, cell_stratum, best, n_strata = load(body)
    sizes = np.bincount(stratum, minlength=n_strata)
    place = {t: i for i, t in enumerate(names.tolist())}
    from_cell = np.searchsorted(cell_term, np.append(names, np.iinfo(np.int64).max))
    strata_of = stratum[doc_of]
    for item in chosen:
        held = [(place[t], int(weight[t])) for t in items[item].tolist() if t in place]
        bound = np.zeros(n_strata, np.int64)
        for i, w in held:
            s = slice(from_cell[i], from_cell[i + 1])
            bound[cell_stratum[s]] += w * best[s]
        floor = max(int(floors[item]), 1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= floor]
        seen, scores, wanted = np.zeros(0, np.int64), np.zeros(0, np.int64), 4 * top
        while len(order):
            take = int(np.searchsorted(np.cumsum(sizes[order]), wanted)) + 1
            now, order, wanted = order[:take], order[take:], 8 * wanted
            visited = np.zeros(n_strata, bool)
            visited[now] = True
            total = np.zeros(len(docs), np.int64)
            for i, w in held:
                s = slice(first[i], first[i + 1])
                inside = visited[strata_of[s]]
                total[doc_of[s][inside]] += w * value[code[s][inside]]
            hit = np.flatnonzero(total >= floor)
            seen, scores = np.concatenate([seen, docs[hit]]), np.concatenate([scores, total[hit]])
            if len(seen) > top:
                kept = np.lexsort((seen, -scores))[:top]
                seen, scores = seen[kept], scores[kept]
                floor = max(floor, int(scores[-1]))
                order = order[bound[order] >= floor]
        if len(seen):
            yield item, seen, scores


def _ranked(hits: DataFrame, top: int) -> DataFrame:
    """The ``top`` hits of each item; Spark limits each partition before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search_block(docs: DataFrame, found: list[tuple[int, list[bytes]]], id_col: str, text_col: str, top: int) -> DataFrame:
    """(item, rank, doc_id, score) for one block of items, given as (number, terms)."""
    spark = docs.sparkSession
    words = {t: i for i, t in enumerate(sorted({t for _, ts in found for t in ts}))}
    index, df, n = build_index(docs, words, id_col, text_col)
    numbers = np.array([i for i, _ in found], np.int64)
    items = [np.array(sorted(words[t] for t in ts), np.int64) for _, ts in found]
    sent = spark.sparkContext.broadcast((items, weights(words, df, n)))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value
        flat, start = np.concatenate([*items, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, items)])
        for batch in batches:
            for block, ts, ps in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                peak = np.zeros(len(weight), np.int64)
                ts = np.asarray(ts.values)
                peak[ts] = np.asarray(ps.values) * weight[ts]
                sums = np.concatenate([[0], np.cumsum(peak[flat])])
                most = sums[start[1:]] - sums[start[:-1]]
                some = np.flatnonzero(most)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), block)), pa.array(most[some])], names=["item", "block", "bound"])

    def pass_over(which: DataFrame, floors: np.ndarray) -> DataFrame:
        """Scores of the pairs ``which`` (block, item); a block is read once for all its items."""
        lows = spark.sparkContext.broadcast(floors)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, weight = sent.value
            for batch in batches:
                for body, chosen in zip(batch.column("body"), batch.column("items").to_pylist()):
                    for item, ids, scores in _score(body.as_py(), items, chosen, lows.value, weight, top):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int32)), pa.array(ids), pa.array(scores)], names=["item", "doc_id", "score"])
            release_memory()

        chosen = checkpointed(which.groupBy("block").agg(F.collect_list("item").alias("items")))
        return checkpointed(index.select("block", "body").join(broadcast_if_small(chosen), "block").select("body", "items").mapInArrow(score, "item int, doc_id long, score long"))

    most = checkpointed(index.select("block", "terms", "peaks").mapInArrow(bounds, "item int, block long, bound long"))
    # the blocks of the highest bounds give each item a floor; other blocks are scored only if they can reach it
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "block")
    first = checkpointed(most.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SEEDS).select("item", "block"))
    seeds = pass_over(first, np.ones(len(items), np.int64))
    floors = np.ones(len(items), np.int64)
    for r in _ranked(seeds, top).filter(F.col("rank") == top).select("item", "score").collect():
        floors[r["item"]] = r["score"]
    low = spark.createDataFrame([(i, int(f)) for i, f in enumerate(floors)], "item int, floor long")
    rest = most.join(F.broadcast(low), "item").filter("bound >= floor").join(first, ["item", "block"], "left_anti").select("item", "block")
    ranked = _ranked(seeds.unionByName(pass_over(rest, floors)), top)
    named = spark.createDataFrame([(i, int(x)) for i, x in enumerate(numbers)], "item int, number long")
    return checkpointed(ranked.join(F.broadcast(named), "item").select("number", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """``item_id``, rank, doc_id, score: the ``top`` documents with a score above 0 for each item, best first, ties by doc_id (null last).

    Terms are runs of letters, digits and non-ASCII characters, only A-Z lower-cased. N documents with a term hold L terms,
    n of them in one document; its normaliser is m = 50 + (50 n N) div L. The score is the sum over the item's
    distinct terms of floor(1000 ln((2N + 2) / (2 df + 1))) * ((10^9 tf) div (1000 tf + 20 m)).

    Rows with one item id are one item with the terms of all their texts (null id: an item of its own); a document row is
    ranked by itself, also if its id repeats. Null, empty and termless texts are no documents, and give no rows as
    items. Other columns are ignored. Texts of any length are read in slices of 1 MB.

    Items are searched in blocks of at most 4,096 items and 65,536 terms (one item alone may have more), so what is sent to
    the tasks is bounded; each block makes one pass over the texts and keeps postings of its own terms only.
    """
    spark = docs.sparkSession
    given = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    kind = given.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t) for i, text in zip(batch.column(0), batch.column(1)) for t in terms(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i, _ in rows], batch.schema.field(0).type), pa.array([t for _, t in rows], pa.binary())], names=["item_id", "term"])

    pairs = given.mapInArrow(split, f"item_id {kind}, term binary").distinct()
    sized = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("terms"))
    numbered = checkpointed(sized.repartitionByRange("item_id").sortWithinPartitions("item_id").withColumn("number", F.monotonically_increasing_id()))
    joined = checkpointed(pairs.join(numbered, pairs.item_id.eqNullSafe(numbered.item_id)).select("number", "term"))
    parts, after = [], -1
    while True:
        ahead = numbered.filter(F.col("number") > after).orderBy("number").limit(ITEM_BLOCK).select("number", "terms").collect()
        if not ahead:
            break
        held = np.cumsum([r["terms"] for r in ahead])
        last = ahead[max(int(np.searchsorted(held, TERM_BLOCK, "right")), 1) - 1]["number"]
        block = joined.filter(F.col("number").between(after + 1, last)).groupBy("number").agg(F.collect_list("term").alias("t")).collect()
        parts.append(_search_block(docs, [(r["number"], [bytes(t) for t in r["t"]]) for r in sorted(block)], id_col, text_col, top))
        after = last
    ranks = spark.createDataFrame([], "number long, rank int, doc_id long, score long")
    for part in parts:
        ranks = ranks.unionByName(part)
    return ranks.join(numbered, "number").select(F.col("item_id").alias(item_id), F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
