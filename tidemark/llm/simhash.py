"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, n_tasks, release_memory
from tidemark.llm.embedding_dedup import Forest
from tidemark.session import checkpointed

SHINGLE = 4
RADIUS = 4
_TILE = 2048
_PART = 1 << 17  # fingerprints of a part: 1 MB
_CELLS = 1 << 18  # comparisons at a time
_LINKS = 1 << 16  # links that are folded into a forest together
_SEED = 42
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over word shingles: a bit is set if it is in over half of the shingles' hashes."""
    words = _WORDS((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, _SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    n, counts = len(stops), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounds the memory of very long texts
        hashes = np.array([digest(line[a:b], _SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << bit for bit in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, print, columns ``keep``): SimHash of each whole text as a long (the same 64 bits); null and wordless texts: 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), *batch.columns[2:]], names=["id", "print", *keep])
            release_memory()

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"), *keep)
    return given.mapInArrow(work, ", ".join(["id long, print long", *(f"{c} {given.schema[c].dataType.simpleString()}" for c in keep)]))


def _ordered(group: pa.Table, radius: int) -> pa.Table:
    """Distinct fingerprints of one part of a cell, ordered by the bit counts of their quarters, with its own links.

    ``root`` names the component of each fingerprint within the part, ``a`` and ``b`` are the edges of its forest.
    """
    prints = np.asarray(group.column("print")).view(np.uint64)
    prints = prints[np.lexsort(_quarters(prints).T)]
    forest = spanning(prints, prints, np.arange(len(prints)), radius, True)
    a, b = (pa.array([prints[side].view(np.int64)], pa.list_(pa.int64())) for side in forest.kept())
    place = [pa.array([group.column(c)[0].as_py()], pa.int32()) for c in ("cell", "part")]
    bodies = [pa.array([x.tobytes()], pa.binary()) for x in (prints, forest.label.astype(np.int32))]
    return pa.table([*place, *bodies, a, b], names=["cell", "part", "body", "root", "a", "b"])


def _quarters(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(prints).view(np.uint16).reshape(-1, 4)).astype(np.int64)


def _bounds(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(prints), _TILE)
    quarters = _quarters(prints)
    return np.minimum.reduceat(quarters, at), np.maximum.reduceat(quarters, at)


def compare(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of the pairs of fingerprints within ``radius`` bits, tile by tile.

    Each row of a tile is compared with the whole other tile by exclusive-or and bit counts; a pair of tiles is
    skipped if the bounds of its quarters' bit counts lie further apart than the radius.
    """
    (a_low, a_high), (b_low, b_high) = _bounds(a), _bounds(b)
    for i in range(len(a_low)):
        apart = np.maximum(np.maximum(a_low[i] - b_high, b_low - a_high[i]), 0).sum(axis=1)
        for j in np.flatnonzero(apart <= radius):
            if same and j < i:
                continue
            x, y = a[i * _TILE : (i + 1) * _TILE], b[j * _TILE : (j + 1) * _TILE]
            rows = max(_CELLS // len(y), 1)
            for at in range(0, len(x), rows):
                u, v = np.nonzero(np.bitwise_count(x[at : at + rows, None] ^ y[None, :]) <= radius)
                u += at
                if same and i == j:
                    u, v = u[u < v], v[u < v]
                if len(u):
                    yield u + i * _TILE, v + j * _TILE


def spanning(a: np.ndarray, b: np.ndarray, roots: np.ndarray, radius: int, same: bool) -> Forest:
    """Forest over the fingerprints of ``a`` and, unless they are the ``same``, of ``b`` behind them.

    ``roots`` names for each of them one of its component so far; links within a component are left out, so a group
    of near copies costs one edge for each component that it joins, and never its pairs.
    """
    forest = Forest(len(roots))
    forest.label = roots.astype(np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for u, v in compare(a, b, radius, same):
        v = v if same else v + len(a)
        apart = forest.label[u] != forest.label[v]
        if apart.any():
            held.append((u[apart], v[apart]))
            waiting += len(held[-1][0])
        if waiting >= _LINKS:
            forest.add(*(np.concatenate(side) for side in zip(*held)))
            held, waiting = [], 0
    if held:
        forest.add(*(np.concatenate(side) for side in zip(*held)))
    return forest


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of distinct values of ``prints.print``, which differ in 1 to ``radius`` bits: enough for its components.

    Fingerprints are dealt to cells by the bit counts of their two halves; a fingerprint has all its neighbours in
    cells whose two counts differ by ``radius`` in sum at most. A cell is cut into parts of about 2^17 by a hash,
    and each pair of parts that can hold neighbours is compared whole, by tiles of 2,048, in one task. A part is first
    compared with itself and keeps a spanning forest of its links; a pair of parts then keeps one over their
    components, so the links are a small multiple of the fingerprints however dense a group is. The
    comparisons are quadratic in the distinct fingerprints, as exact comparison is; equal fingerprints are one row.
    """
    distinct = checkpointed(prints.select("print").distinct())
    high, low = F.bit_count(F.shiftrightunsigned("print", 32)), F.bit_count(F.col("print").bitwiseAND(0xFFFFFFFF))
    celled = distinct.select("print", (high * 64 + low).cast("int").alias("cell"))
    # 33 x 33 cells at most, so the table of their sizes is small whatever the input
    sizes = celled.groupBy("cell").agg((F.floor(F.count(F.lit(1)) / _PART) + 1).cast("int").alias("parts"))
    sizes = F.broadcast(checkpointed(sizes))
    dealt = celled.join(sizes, "cell").select("print", "cell", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int").alias("part"))
    # a fixed number of tasks: the bytes of a part say little about its comparisons
    spread = dealt.repartition(n_tasks(dealt), "cell", "part").groupBy("cell", "part")
    parts = checkpointed(spread.applyInArrow(lambda part: _ordered(part, radius), "cell int, part int, body binary, root binary, a array<long>, b array<long>"))
    inner = parts.select(F.explode(F.arrays_zip("a", "b")).alias("l")).select("l.a", "l.b")
    parts = parts.select("cell", "part", "body", "root")
    # each pair of cells meets once, in the later one
    steps = [(h, w) for h in range(-radius, radius + 1) for w in range(-radius, radius + 1) if abs(h) + abs(w) <= radius and (h, w) >= (0, 0)]
    reach = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(w).alias("w")) for h, w in steps)))
    sent = parts.withColumn("to", reach).filter(F.expr("cell % 64 + to.w between 0 and 32"))
    sent = sent.select(F.expr("cell + 64 * to.h + to.w").alias("cell"), F.expr("to.h = 0 and to.w = 0").alias("home"), F.col("part").alias("from_part"), F.col("body").alias("other"), F.col("root").alias("other_root"))
    sent = sent.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.filter("not home or from_part < part").select("cell", "part", "other", "other_root")
    pairs = sent.join(parts.hint("shuffle_hash"), ["cell", "part"]).select("other", "other_root", "body", "root")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns):
                left, left_root, right, right_root = (np.frombuffer(x.as_py(), t) for x, t in zip(row, ("u8", "i4", "u8", "i4")))
                u, v = spanning(left, right, np.concatenate([left_root, right_root + len(left)]), radius, False).kept()
                both = np.concatenate([left, right]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[u]), pa.array(both[v])], names=["a", "b"])

    return inner.union(pairs.mapInArrow(near, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``id_col``, print (fingerprint as a long), component (least id reachable through links), root.

    Words are runs of non-blank characters, A-Z in lower case; shingles are ``SHINGLE`` words, repeats included; a
    text with fewer words is one shingle, one without words (or null) has fingerprint 0 and is linked like any
    other. Documents link if their fingerprints differ in ``radius`` bits or fewer. Repeated rows are kept.
    A null id is never the least; a component of null ids only has component null. Components that share their least
    id, as its rows hold different texts, differ in root, a fingerprint of each.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    least = checkpointed(prints.groupBy("print").agg(F.min("id").alias("least")))
    # components of fingerprints; the name of one is its least id
    member = checkpointed(components(least.select(F.col("print").alias("id")), links(least, radius)))
    named = member.join(least.withColumnRenamed("print", "id"), "id").select(F.col("id").alias("print"), "component", "least")
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    table = checkpointed(named.join(names, "component").select("print", F.col("name").alias("component"), F.col("component").alias("root")))
    return prints.join(table, "print").select(F.col("id").alias(id_col), "print", "component", "root")
