"""Removal of lines that an earlier document holds, by patience alignment of overlapping pairs and their common runs."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_place
from tidemark.session import checkpointed

MIN_WORDS = 8
_ROWS = 256  # documents whose runs are held at once
_SHARE = 512  # pairs of one owner that go with one copy of its lines, at least
_FACTOR = 0x9E3779B97F4A7C17
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing run of ``values``, by patience sorting."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(at[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [v]
        at[pile : pile + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(early: list[int], late: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (place in ``early``, place in ``late``, length) of two lists of lines, by patience diff.

    Lines that occur once in either list and are in increasing order in both are anchors; an anchor grows up and
    down while the lines are equal; between two anchors the rest is aligned likewise. Without such a line in a
    stretch, its equal lines at the start and at the end are a block.
    """
    out, todo = [], [(0, len(early), 0, len(late))]
    while todo:
        a, b, c, d = todo.pop()
        head = 0
        while a + head < b and c + head < d and early[a + head] == late[c + head]:
            head += 1
        if head:
            out.append((a, c, head))
            a, c = a + head, c + head
        tail = 0
        while b - tail > a and d - tail > c and early[b - tail - 1] == late[d - tail - 1]:
            tail += 1
        if tail:
            out.append((b - tail, d - tail, tail))
            b, d = b - tail, d - tail
        if a == b or c == d:
            continue
        once = _once(early, a, b)
        pairs = sorted((i, once[line]) for line, i in _once(late, c, d).items() if line in once)
        if not pairs:
            continue
        x, y = a, c
        for k in _increasing([e for _, e in pairs]):
            late_at, early_at = pairs[k]
            if early_at < x or late_at < y:
                continue  # taken by the block before
            up = 0
            while early_at - up > x and late_at - up > y and early[early_at - up - 1] == late[late_at - up - 1]:
                up += 1
            down = 1
            while early_at + down < b and late_at + down < d and early[early_at + down] == late[late_at + down]:
                down += 1
            out.append((early_at - up, late_at - up, up + down))
            todo.append((x, early_at - up, y, late_at - up))
            x, y = early_at + down, late_at + down
        todo.append((x, b, y, d))
    return out


def _once(lines: list[int], a: int, b: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for i in range(a, b):
        seen[lines[i]] = -1 if lines[i] in seen else i
    return {line: i for line, i in seen.items() if i >= 0}


def _runs(lines: np.ndarray, words: np.ndarray, min_words: int, min_lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortest runs of at least ``min_lines`` lines and ``min_words`` words: (first place, end, hash).

    There is one from each line down and one up to each line, as far as the text goes. Every line of a block of that
    many lines and words is in a run within the block. Where a run ends depends on its own lines alone, so a
    list that holds a run's lines side by side has the same run. The hash is a polynomial in the lines' hashes.
    """
    n = len(lines)
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n + 1)
    end = np.maximum(np.searchsorted(total, total + min_words, "left"), at + min_lines)
    start = np.minimum(np.searchsorted(total, total - min_words, "right") - 1, at - min_lines)
    first, last = np.concatenate([at[end <= n], start[start >= 0]]), np.concatenate([end[end <= n], at[start >= 0]])
    power, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, f, np.uint64)]), dtype=np.uint64) for f in (_FACTOR, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.view(np.uint64) * power[:n], dtype=np.uint64)])
    return first, last, ((sums[last] - sums[first]) * back[first]).view(np.int64)


def _names(lines: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """Distinct hashes of the shortest runs that a common block can be told by: of any lines, and of two or more."""
    return np.unique(np.concatenate([_runs(lines, words, min_words, n)[2] for n in (1, 2)]))


def _left_over(early: np.ndarray, late: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """Places in ``late`` of common blocks whatever their order: all of two lines or more, single lines if repeated.

    A line that either list holds twice has no place of its own in the order; a single line that both hold once has
    one, and only the alignment judges it.
    """
    names, at, times = np.unique(late, return_index=True, return_counts=True)
    place = np.searchsorted(names, early).clip(max=len(names) - 1)
    known = names[place] == early
    # a line that only the early list holds is in no common run, whatever its words
    _, _, held = _runs(early, np.where(known, words[at[place]], 0), min_words, 2)
    first, last, runs = _runs(late, words, min_words, 2)
    shared = np.isin(runs, held)
    edge = np.bincount(first[shared], minlength=len(late) + 1) - np.bincount(last[shared], minlength=len(late) + 1)
    early_times = np.bincount(place[known], minlength=len(names))
    repeated = ((early_times > 0) & (early_times + times > 2))[np.searchsorted(names, late)]
    return np.flatnonzero((np.cumsum(edge)[:-1] > 0) | (repeated & (words >= min_words)))


def _cut(early: np.ndarray, late: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """Places in ``late`` of the common blocks with ``min_words`` words or more: the aligned ones and those left over."""
    total = np.concatenate([[0], np.cumsum(words)])
    blocks: list[list[int]] = []
    for e, l, n in sorted(align(early.tolist(), late.tolist())):  # blocks that touch in both lists are one
        if blocks and blocks[-1][0] + blocks[-1][2] == e and blocks[-1][1] + blocks[-1][2] == l:
            blocks[-1][2] += n
        else:
            blocks.append([e, l, n])
    kept = [np.arange(l, l + n) for _, l, n in blocks if total[l + n] - total[l] >= min_words]
    return np.unique(np.concatenate([*kept, _left_over(early, late, words, min_words)])).astype(np.int64)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with aligned common blocks of lines deleted from the later document, and n_lines, n_removed (long).

    Lines end at a line feed. Each line starts and ends a shortest run of lines with ``min_words`` words, and one of
    at least two lines. A document overlaps an earlier one (smaller id) if that is the first to hold one of its runs
    side by side; so a run names one partner however many documents share it, and every common block of ``min_words``
    words or more is covered by runs, each compared with a document that holds it whole. Runs of one owner name it
    once. A common run is treated like a rare one, as it costs no more: one partner for each document. The pairs of
    an owner that very many documents share are dealt over copies of its lines. Each pair is aligned by patience diff
    over all lines of both, and its common blocks of ``min_words`` words or more are deleted from the later text, with their line feeds. Blocks are judged on the input.
    So are the blocks that the alignment leaves because they are repeated in either text or stand in another order:
    all common runs of two lines or more, every time the later text holds them, and single lines that either text
    repeats. A single line that both hold once and that is out of order with the alignment stays.

    A null text stays null and an empty one empty (one line each); a text whose lines all go is empty. Rows without
    id stay whole and remove nothing. Rows that repeat an id are one document if their texts are equal and do not
    remove each other's lines if not. All columns of ``docs`` are kept; n_lines and n_removed replace such columns.
    """
    text, ident = F.col(text_col), F.col(id_col).cast("long")
    base = docs.filter(ident.isNotNull() & text.isNotNull()).select(ident.alias("id"), F.xxhash64(text).alias("key"), lines_of(text).alias("lines"))
    hashed = base.select("id", "key", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", _words).alias("words"))
    sequences = checkpointed(hashed)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                own = [_names(l.values.to_numpy(), w.values.to_numpy(), min_words) for l, w in zip(part.column(2), part.column(3))]
                sizes = [len(x) for x in own]
                ids, keys = (np.repeat(part.column(c).to_numpy(), sizes) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(np.concatenate(own))], names=["id", "key", "run"])

    # the first owner of each run that several documents hold; partial counts go first, so a hot run is a few rows
    occurs = sequences.select("id", "key", "hashes", "words").mapInArrow(name, "id long, key long, run long")
    first = occurs.groupBy("run").agg(F.min(F.struct("id", "key")).alias("owner"), F.max("id").alias("high"))
    shared = checkpointed(first.filter("owner.id < high").select("run", "owner"))
    pairs = occurs.join(shared, "run").filter("owner.id < id").select("id", "key", "owner").distinct()
    pairs = checkpointed(pairs.select("id", "key", F.col("owner.id").alias("early_id"), F.col("owner.key").alias("early_key")))
    early = sequences.select(F.col("id").alias("early_id"), F.col("key").alias("early_key"), F.col("hashes").alias("early")).dropDuplicates(["early_id", "early_key"])
    late = sequences.dropDuplicates(["id", "key"])
    both = _with_owner(pairs, early).join(late, ["id", "key"]).select("id", "key", "early", "hashes", "words")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, gone = [], [], []
            for i, k, e, l, w in zip(*(batch.column(c) for c in range(5))):
                cut = _cut(e.values.to_numpy(), l.values.to_numpy(), w.values.to_numpy(), min_words)
                if len(cut):
                    ids.append(i.as_py())
                    keys.append(k.as_py())
                    gone.append(cut)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int64()))], names=["id", "key", "gone"])

    found = both.mapInArrow(work, "id long, key long, gone array<long>")
    gone = checkpointed(found.groupBy("id", "key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))
    marks = gone.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("gone").alias("_gone"))
    rows, names = by_place(docs, ("n_lines", "n_removed"))
    text, ident = F.col(names[text_col]), F.col(names[id_col]).cast("long")
    joined = rows.join(marks, (ident == F.col("_id")) & (F.xxhash64(text) == F.col("_key")), "left")
    lines = lines_of(text)
    kept = F.array_join(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("_gone", s["i"].cast("long")))["x"], "\n")
    new = F.when(F.col("_gone").isNull(), text).otherwise(kept)
    return joined.select(
        *(new.alias(c) if c == text_col else F.col(n).alias(c) for c, n in names.items()),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def _with_owner(pairs: DataFrame, early: DataFrame) -> DataFrame:
    """``pairs`` with the line list of their owner; the pairs of a hot owner are dealt over copies of its list.

    Hot is an owner of more than ``_SHARE`` pairs and of more than a thousandth of all, so there are fewer than 1,000.
    """
    total = pairs.count()
    share = max(_SHARE, total // 1000)
    owners = pairs.groupBy("early_id", "early_key").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("copies")).filter("copies > 1")
    hot = F.broadcast(checkpointed(owners))
    copies, own = F.coalesce("copies", F.lit(1)), ["early_id", "early_key"]
    dealt = pairs.join(hot, own, "left").withColumn("copy", F.pmod(F.xxhash64("id", "key"), copies).cast("int")).drop("copies")
    copied = early.join(hot, own, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return dealt.join(copied, [*own, "copy"])


def _words(line):
    return F.size(F.filter(F.split(line, r"[ \t\r\f]+"), lambda w: w != "")).cast("long")
