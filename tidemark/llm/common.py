"""Shared helpers of the training-data operators: tables, text blocks, id ranges, components."""

from __future__ import annotations

import contextlib
import ctypes
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_place(df: DataFrame, without: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ... by place, and the new name of each; columns ``without`` are left out.

    So an operator's own names never meet those of its caller.
    """
    names = {c: f"c{i}" for i, c in enumerate(c for c in df.columns if c not in without)}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def named_again(names: dict[str, str]) -> list[Column]:
    """The columns of :func:`by_place` under their names."""
    return [F.col(n).alias(c) for c, n in names.items()]


def dump(*parts) -> bytes:
    """Numpy arrays (and lists of them) as one compressed message between tasks of one job."""
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, protocol=5))


def load(body: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(body))


def release_memory() -> None:
    """Give a worker's freed memory back to its machine: workers live on between tasks, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(texts: pa.Array, at_once: int) -> list[tuple[int, int]]:
    """Ranges of rows of about ``at_once`` bytes of text, whole rows, none empty."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // at_once, prepend=0))
    return [(a, b) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(texts)]) if a < b]


def packed(df: DataFrame, text: str, block_bytes: int, level: int = 3) -> DataFrame:
    """``df`` as a written table of compressed blocks: block (unique number), n (rows), body.

    A block holds whole rows of one input partition, up to ``block_bytes`` of text, at least one row.
    The table is in the shared folder, so that every later step sees the same blocks.
    """
    schema_at = df.columns.index(text)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        squeeze = zstandard.ZstdCompressor(level=level)

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            whole = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, whole.schema) as out:
                out.write_table(whole)
            body = squeeze.compress(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "n": pa.array([whole.num_rows], pa.int64()), "body": pa.array([body], pa.binary())})

        for batch in batches:
            lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(schema_at)), 0))
            ends = np.cumsum(lengths.astype(np.int64))
            at = 0
            while at < batch.num_rows:
                used = ends[at - 1] if at else 0
                to = max(int(np.searchsorted(ends, used + block_bytes - size, "right")), at + (not held))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(ends[to - 1] - used)
                at = to
                if at < batch.num_rows:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()
        release_memory()

    return checkpointed(df.mapInArrow(pack, "block long, n long, body binary"))


def unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_all()


def utf8_bytes(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a text column side by side (null: empty), with first and end position of each text."""
    array = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    array = pa.concat_arrays([array.fill_null("")])
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends[:-1] - ends[0], ends[1:] - ends[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def broadcast_if_small(df: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """``df``, a written table, with a broadcast hint if its rows are proved to take ``max_bytes`` at most.

    The proof adds up the UTF-8 bytes of all columns; beyond the limit the optimizer's shuffle join is used.
    """
    width = sum((F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    size = df.agg(F.sum(width).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= max_bytes else df


def range_bounds(df: DataFrame, key: str, weight: str, target: int) -> list[int]:
    """Ascending cut points of the long ``key`` that leave about ``target`` of ``weight`` between two.

    Only the cut points reach the driver, one per ``target``: quantiles of the key over all rows.
    """
    total = df.agg(F.sum(weight).alias("n"), F.count(key).alias("m")).first()
    n = int((total["n"] or 0) // target)
    if n < 1 or not total["m"]:
        return []
    error = max(0.25 / (n + 1), 1e-5)
    cuts = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / (n + 1) for i in range(1, n + 1)], error)
    return sorted({int(c) for c in cuts})


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: (id, component), component = least id reachable; an id without edges is its own.

    Rounds of hooking to the least neighbour and pointer doubling; each round is a written table, and the
    edges shrink to edges between labels, so that chains take a logarithmic number of rounds. A star is
    aggregated before it is shuffled. ``edges`` has (a, b), in either direction, each pair once or more.
    """
    label = None  # id -> current label, kept for ids with edges only
    links = checkpointed(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps = []
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        # each label hooks to its least neighbour or itself; the hooks form a forest, compressed below
        parent = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        while True:
            up = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
            jumped = checkpointed(parent.join(up, "up", "left").select("id", F.col("up").alias("old"), F.coalesce("top", "up").alias("up")))
            moved = jumped.filter("old <> up").isEmpty()
            parent = jumped.select("id", "up")
            if moved:
                break
        maps.append(parent)
        pa_, pb = parent.select(F.col("id").alias("a"), F.col("up").alias("x")), parent.select(F.col("id").alias("b"), F.col("up").alias("y"))
        links = checkpointed(
            links.join(pa_, "a").join(pb, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    for m in maps:
        if label is None:
            label = m.select("id", F.col("up").alias("component"))
        else:
            label = label.join(m.select(F.col("id").alias("component"), "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    if label is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(checkpointed(label), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
