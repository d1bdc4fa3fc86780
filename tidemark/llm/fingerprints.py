"""Document fingerprints from content-defined chunks, and the likeness of documents by shared chunk weight."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.anchors import mix
from tidemark.llm.common import range_bounds

LEAST, NORMAL, MOST = 32, 64, 256  # bytes of a chunk; the gear hash spans LEAST
_STRICT, _LOOSE = 7, 5  # bits that must be zero at a border before and after NORMAL bytes
_GEAR = np.random.default_rng(33).integers(0, 1 << 32, 256, dtype=np.uint32)
_VALUE = np.random.default_rng(34).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def chunk_ends(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of the texts ``data[start:end]`` (side by side): text of each chunk, and its end.

    A gear hash over the last 32 bytes marks borders: after ``NORMAL`` bytes a loose mark will do, before a strict
    one is needed, so lengths gather around the normal one; no chunk is under ``LEAST`` bytes but a text's
    last, none over ``MOST``. All texts of a batch take a step at a time.
    """
    h, size = _GEAR[data], 1
    while size < LEAST:
        h[size:] = h[size:] + (h[:-size] << np.uint32(size))
        size *= 2
    n = len(data)
    nearest = []
    for bits in (_STRICT, _LOOSE):  # first mark at or after each byte
        at = np.where(h >> np.uint32(32 - bits) == 0, np.arange(n), n + MOST)
        nearest.append(np.minimum.accumulate(at[::-1])[::-1])
    pad = np.full(MOST + 1, n + MOST)
    strict, loose = (np.concatenate([x, pad]) for x in nearest)
    text = np.flatnonzero(end > start)
    at = start[text]
    out_text, out_end = [], []
    while len(text):
        early = strict[np.minimum(at + LEAST - 1, n)] + 1
        late = np.maximum(loose[np.minimum(at + NORMAL - 1, n)] + 1, at + NORMAL)
        stop = np.where(early < at + NORMAL, early, np.minimum(late, at + MOST))
        stop = np.minimum(stop, end[text])
        out_text.append(text)
        out_end.append(stop)
        going = stop < end[text]
        text, at = text[going], stop[going]
    if not out_text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, stop = np.concatenate(out_text), np.concatenate(out_end)
    order = np.lexsort((stop, text))
    return text[order], stop[order]


def chunk_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct chunks of each text: text, 64-bit digest, length in bytes; ordered by text and digest."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(lengths)
    start = end - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text, stop = chunk_ends(data, start, end)
    first = np.where(np.concatenate([[True], text[1:] != text[:-1]]), start[text], np.concatenate([[0], stop[:-1]]))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _BASE)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_VALUE[data] * power[:-1], dtype=np.uint64)])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), _INVERSE)]), dtype=np.uint64)
    digest = mix((total[stop] - total[first]) * back[first] ^ mix((stop - first).astype(np.uint64)))
    order = np.lexsort((digest, text))
    text, digest, size = text[order], digest[order], (stop - first)[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (digest[1:] != digest[:-1])])
    return text[new], digest[new], size[new]


class Sets:
    def __init__(self, texts: list[bytes]):
        self.text, self.digest, self.size = chunk_sets(texts)
        self.border = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.weight = np.concatenate([[0], np.cumsum(self.size)])[self.border]
        self.weight = np.diff(self.weight)

    def strings(self) -> list[str]:
        """Digest sets as text: 16 digits of the digest and the length in hexadecimal, by digest."""
        each = [f"{d:016x}:{s:x}" for d, s in zip(self.digest.tolist(), self.size.tolist())]
        return [" ".join(each[a:b]) for a, b in zip(self.border[:-1].tolist(), self.border[1:].tolist())]


def containment(a: Sets, b: Sets, pick_b: np.ndarray) -> np.ndarray:
    """Share of the weight of each text of ``a`` that lies in chunks of text ``pick_b`` of ``b``; 1 if both are empty."""
    out = np.zeros(len(pick_b))
    for i, j in enumerate(pick_b.tolist()):
        own = slice(a.border[i], a.border[i + 1])
        other = slice(b.border[j], b.border[j + 1])
        if not a.weight[i]:
            out[i] = float(not b.weight[j])
            continue
        found = np.isin(a.digest[own], b.digest[other], assume_unique=True)
        out[i] = a.size[own][found].sum() / a.weight[i]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and fingerprint string, the set of chunk digests with lengths (null: empty text).

    Equal texts have equal fingerprints; an empty text has an empty one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                strings = Sets([t.encode() for t in part.column(1).fill_null("").to_pylist()]).strings()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(strings, pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, fingerprint string")
    return out.withColumnRenamed("id", id_col)


_LOWEST = -(1 << 63)
_RANGE = 8 << 20


def next_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document.

    The next document is that with the next smaller id (rows of one id: by text; null ids last; after the last
    the first). The edited text: the last floor(n/2) of n code points replaced by the first as many of the next
    text, or all of it. Likeness is containment: the share of a text's chunk weight (bytes of distinct chunks) that
    the other text has too, 1 if both are empty, 0 if one is. Null texts are empty. Returns per input row
    ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are dealt once, to ranges of the id of about 8 MB; within a range the next document is the next row. The
    last row of a range needs the first of the next range, so the first document of each range is read and sent
    there as well, one document per range.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = range_bounds(rows.select("id", F.octet_length("text").alias("w")), "id", "w", _RANGE)
    bounds = np.array(cuts, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            part = np.where(np.asarray(ids.is_valid()), np.searchsorted(bounds, np.asarray(ids.fill_null(_LOWEST)), "right") + 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *batch.columns], names=["part", *batch.schema.names])

    dealt = rows.mapInArrow(deal, "part long, id long, text string")
    # the first document of each range, in descending order of id: one row per range, whose number is bounded by
    # the input size over 8 MB; its text goes to the range before, the first of all to the last
    narrow = rows.select("id").mapInArrow(deal, "part long, id long")
    heads = narrow.groupBy("part").agg(F.max("id").alias("id")).orderBy(F.desc("part")).collect()
    if not heads:
        return dealt.select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in _OUT[1:]))
    first_id = [(heads[i - 1].part, heads[i].part, heads[i].id) for i in range(len(heads))]  # range that needs it
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(int(need), -1 if i is None else 0, 0 if i is None else int(i)) for need, _, i in first_id], "need long, none long, head long")
    keyed = rows.withColumn("head_key", F.coalesce("id", F.lit(0)))
    head_rows = keyed.join(F.broadcast(wanted.withColumnRenamed("head", "head_key")), "head_key").filter("(id is null) = (none < 0)")
    head_rows = head_rows.groupBy("need").agg(F.min("text").alias("text"))  # rows of one id: the first by text
    ghosts = head_rows.select(F.col("need").alias("part"), F.lit(None).cast("long").alias("id"), "text", F.lit(True).alias("ghost"))
    grouped = dealt.withColumn("ghost", F.lit(False)).unionByName(ghosts).groupBy("part")
    kind = ", ".join(f"{c} {t}" for c, t in _OUT)
    return grouped.applyInArrow(_range, kind).withColumnRenamed("id", id_col)


_OUT = [("id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]


def _range(group: pa.Table) -> pa.Table:
    ghost = group.filter(group.column("ghost")).column("text").to_pylist()[0]
    own = group.filter(pa.compute.invert(group.column("ghost"))).sort_by([("id", "descending"), ("text", "ascending")])
    parts = []
    for at in range(0, own.num_rows, 512):  # bounds the memory; the row after a slice is in the next one
        rows = own.slice(at, 512)
        texts = rows.column("text").to_pylist()
        after = own.column("text")[at + 512].as_py() if at + 512 < own.num_rows else ghost
        following = [*texts[1:], after]
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following)]
        own_sets, edit_sets = Sets([t.encode() for t in [*texts, after]]), Sets([t.encode() for t in edited])
        n = len(texts)
        parts.append(
            pa.table(
                {
                    "id": rows.column("id"),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                    "fingerprint": own_sets.strings()[:n],
                    "edited_fingerprint": edit_sets.strings(),
                    "near_edited": containment(own_sets, edit_sets, np.arange(n)),
                    "near_next": containment(own_sets, own_sets, np.arange(1, n + 1)),
                }
            )
        )
    return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for c, t in _OUT})
