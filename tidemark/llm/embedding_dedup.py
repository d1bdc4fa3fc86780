"""Embedding near-duplicates by tiles whose dimensions are accumulated in order of their variance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordering import lookup
from tidemark.llm.common import components, dump, load, release_memory
from tidemark.session import checkpointed

THRESHOLD = 0.98
PART_ROWS = 4096  # vectors that travel together
TILE = 512  # vectors compared at a time
BOX = 8  # leading dimensions that bound a tile
_STEP = 8  # dimensions accumulated between two looks at the bound
_SPARSE = 0.05  # share of open pairs below which they go on one by one
_PAIRS = 1 << 14
SLACK = 1e-9

PART = "part long, label int, dim int, band long, low2 long, high2 long, rows int, low array<double>, high array<double>, body binary"


# --- kernel -----------------------------------------------------------------------------------------


def suffixes(x: np.ndarray) -> np.ndarray:
    """Norm of what follows each multiple of ``_STEP`` dimensions, a column per step (the first: the whole)."""
    squares = np.add.reduceat(x * x, np.arange(0, x.shape[1], _STEP), axis=1)
    return np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])


def survivors(a: np.ndarray, b: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (rows of ``a``, of ``b``) whose product of rotated unit vectors can reach ``threshold``, and the products made.

    Leading dimensions first: what is still to come is at most the product of the two suffix norms, so a pair ends as
    soon as the sum so far plus that bound is below the threshold.
    """
    dim, steps = a.shape[1], rest_a.shape[1]
    so_far, made = np.zeros((len(a), len(b))), 0
    for step in range(steps):
        at = slice(step * _STEP, min((step + 1) * _STEP, dim))
        so_far += a[:, at] @ b[:, at].T
        made += so_far.size
        last = step + 1 == steps
        bound = 0.0 if last else rest_a[:, step + 1, None] * rest_b[None, :, step + 1]
        i, j = np.nonzero(so_far + bound >= threshold - SLACK)
        if last or not len(i):
            return i, j, made
        if len(i) <= _SPARSE * so_far.size:
            value = so_far[i, j]
            for more in range(step + 1, steps):
                at = slice(more * _STEP, min((more + 1) * _STEP, dim))
                value = value + np.concatenate([np.einsum("ij,ij->i", a[i[k : k + _PAIRS], at], b[j[k : k + _PAIRS], at]) for k in range(0, len(i), _PAIRS)])
                made += len(i)
                bound = 0.0 if more + 1 == steps else rest_a[i, more + 1] * rest_b[j, more + 1]
                open_ = value + bound >= threshold - SLACK
                i, j, value = i[open_], j[open_], value[open_]
                if not len(i):
                    break
            return i, j, made
    return np.zeros(0, int), np.zeros(0, int), made


class Forest:
    """Spanning forest of links that arrive in portions: at most one edge fewer than nodes is kept."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            # one edge from each larger root to a smaller one: no cycles
            high, first = np.unique(np.maximum(a, b), return_index=True)
            self.edges.append((i[first], j[first]))
            up = np.arange(len(self.label))
            up[high] = np.minimum(a, b)[first]
            while not np.array_equal(up, up[up]):
                up = up[up]
            self.label = up[self.label]

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([np.zeros(0, int), *side]) for side in (zip(*self.edges) if self.edges else ((), ())))


def compare(left: tuple, right: tuple, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, tuple, int]:
    """(links of the left rows, of the right rows, forest edges, products made) of two parts; copies count as often as they occur."""
    (ids_a, times_a, own_a, x_a), (ids_b, times_b, own_b, x_b) = left, right
    n, m = len(ids_a), len(ids_b)
    rest_a, rest_b = suffixes(x_a), suffixes(x_b)
    links_a, links_b, made = np.zeros(n, np.int64), np.zeros(m, np.int64), 0
    forest = Forest(n if same else n + m)
    reach = 2.0 - 2.0 * threshold + SLACK
    box = [[(x[k : k + TILE, :BOX].min(0), x[k : k + TILE, :BOX].max(0)) for k in range(0, len(x), TILE)] for x in (x_a, x_b)]
    for p, (low_a, high_a) in enumerate(box[0]):
        for q, (low_b, high_b) in enumerate(box[1]):
            if (same and q < p) or (np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0.0) ** 2).sum() > reach:
                continue
            s, t = slice(p * TILE, (p + 1) * TILE), slice(q * TILE, (q + 1) * TILE)
            i, j, products = survivors(x_a[s], x_b[t], rest_a[s], rest_b[t], threshold)
            made += products
            i, j = i + p * TILE, j + q * TILE
            if same and p == q:
                i, j = i[i < j], j[i < j]
            # the cosine itself, from the vectors as they were given
            cosine = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", own_a[i[k : k + _PAIRS]], own_b[j[k : k + _PAIRS]]) for k in range(0, len(i), _PAIRS))])
            i, j = i[cosine >= threshold], j[cosine >= threshold]
            links_a += np.bincount(i, times_b[j], n).astype(np.int64)
            links_b += np.bincount(j, times_a[i], m).astype(np.int64)
            forest.add(i, j if same else j + n)
    u, v = forest.kept()
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    return (links_a + links_b, np.zeros(0, np.int64), (ids[u], ids[v]), made) if same else (links_a, links_b, (ids[u], ids[v]), made)


# --- tables ---------------------------------------------------------------------------------------------


def _usable(vector: Column) -> Column:
    """All components present and finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(batch_column: pa.ListArray, dim: int) -> np.ndarray:
    """Unit vectors in double precision; each is scaled by its largest component first, so that nothing overflows."""
    x = np.asarray(batch_column.flatten()).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def leading_directions(classes: DataFrame, dim: int) -> np.ndarray:
    """Principal directions of all unit vectors of one length, largest share first: the columns of an orthogonal matrix.

    Second moments are summed per task, then by cell of the matrix; only the ``dim`` squared sums reach the driver.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = _units(batch.column(0), dim)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "v"])

    rows = classes.filter(F.col("dim") == dim).select("embedding").mapInArrow(moments, "cell int, v double")
    sums = rows.groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(dim * dim)
    total[np.asarray(sums.column("cell"))] = np.asarray(sums.column("v"))
    total = total.reshape(dim, dim)
    return np.ascontiguousarray(np.linalg.eigh((total + total.T) / 2)[1][:, ::-1])


def _parts(classes: DataFrame, turn: dict[int, np.ndarray], reach: float) -> DataFrame:
    """Written parts of at most ``PART_ROWS`` vectors of one label and one band of the first direction, in order of the second."""
    sent = classes.sparkSession.sparkContext.broadcast(turn)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in set(batch.column("dim").to_pylist()):
                some = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                own = _units(some.column("embedding"), dim)
                x = own @ sent.value[dim]
                lead = x[:, min(1, dim - 1)]
                columns = [some.column("class"), some.column("times"), some.column("label"), some.column("dim"), pa.array(np.floor(x[:, 0] / reach).astype(np.int64)), pa.array(lead), _lists(own), _lists(x)]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "times", "label", "dim", "band", "second", "own", "x"])

    rotated = classes.mapInArrow(rotate, "class long, times long, label int, dim int, band long, second double, own array<double>, x array<double>")
    order = ["label", "dim", "band", "second", "class"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, key = TaskContext.get().partitionId() << 32, [], None

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            label, dim, band = key
            own, x = (np.concatenate([np.asarray(c.flatten()) for c in t.column(c).chunks]).reshape(-1, dim) for c in ("own", "x"))
            second = np.asarray(t.column("second"))
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([number], pa.int64()), "label": pa.array([label], pa.int32()), "dim": pa.array([dim], pa.int32()), "band": pa.array([band], pa.int64()),
                    "low2": pa.array([math.floor(second.min() / reach)], pa.int64()), "high2": pa.array([math.floor(second.max() / reach)], pa.int64()), "rows": pa.array([len(x)], pa.int32()),
                    "low": pa.array([x[:, :BOX].min(0)], pa.list_(pa.float64())), "high": pa.array([x[:, :BOX].max(0)], pa.list_(pa.float64())),
                    "body": pa.array([dump(np.asarray(t.column("class")), np.asarray(t.column("times")), own, x)], pa.binary()),
                }
            )

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "band"))))
            at = 0
            while at < len(keys):
                if held and (keys[at] != key or sum(map(len, held)) >= PART_ROWS):
                    yield row()
                    number, held = number + 1, []
                key, to, room = keys[at], at, PART_ROWS - sum(map(len, held))
                while to < len(keys) and to - at < room and keys[to] == key:
                    to += 1
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield row()
        release_memory()

    return checkpointed(rotated.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, PART))


def _pairs(parts: DataFrame, threshold: float) -> DataFrame:
    """(part, other): pairs of parts, once each, whose boxes are near enough to hold a link.

    Unit vectors with a cosine of the threshold differ by one band at most in each of the first two directions, so
    parts meet by (label, band, band of the second direction); a pair that meets in several cells counts in the first.
    """
    outline = parts.select("part", "label", "dim", "band", "low2", "high2", "low", "high")
    here = outline.withColumn("cell", F.explode(F.sequence("low2", "high2")))
    there = outline.select(*(F.col(c).alias(f"{c}_b") for c in outline.columns))
    there = there.withColumn("cell", F.explode(F.sequence(F.col("low2_b") - 1, F.col("high2_b") + 1)))
    there = there.withColumn("band", F.explode(F.array("band_b", F.col("band_b") + 1)))
    met = here.join(there.withColumnsRenamed({"label_b": "label", "dim_b": "dim"}), ["label", "dim", "band", "cell"])
    met = met.filter((F.col("cell") == F.greatest("low2", F.col("low2_b") - 1)) & ((F.col("band") != F.col("band_b")) | (F.col("part_b") <= F.col("part"))))
    gap = lambda low, high: F.zip_with(low, high, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    apart = F.aggregate(F.zip_with(gap("low", "high_b"), gap("low_b", "high"), lambda x, y: F.greatest(x, y)), F.lit(0.0), lambda s, x: s + x * x)
    return met.filter(apart <= 2.0 - 2.0 * threshold + SLACK).select("part", F.col("part_b").alias("other"))


def links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(kind, a, b, n) over ``classes`` (class, times, label, dim, embedding): kind 0 says that class a has n links to vectors
    of other classes in one pair of parts, kind 1 is an edge a-b of a forest that keeps the components.

    A pair of parts gives at most one edge a member, so a group of thousands of near copies never becomes its pairs.
    """
    dims = [r["dim"] for r in classes.select("dim").distinct().collect()]
    turn = {dim: leading_directions(classes, dim) for dim in dims}
    reach = math.sqrt(max(2.0 - 2.0 * threshold, 0.0)) + SLACK
    parts = _parts(classes, turn, reach)
    pairs = checkpointed(_pairs(parts, threshold))
    bodies = parts.select("part", "body")
    met = pairs.join(bodies, "part").join(bodies.select(F.col("part").alias("other"), F.col("body").alias("body_b")), "other")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, other, one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                left, right = load(one.as_py()), load(two.as_py())
                left_links, right_links, (a, b), _ = compare(left, right, part == other, threshold)
                ids = np.concatenate([left[0], right[0]]) if part != other else left[0]
                n = np.concatenate([left_links, right_links])
                ids, n = ids[n > 0], n[n > 0]
                kind = np.repeat([0, 1], [len(ids), len(a)]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([ids, a])), pa.array(np.concatenate([np.zeros(len(ids), np.int64), b])), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)]))], names=["kind", "a", "b", "n"])
            release_memory()

    return checkpointed(met.select("part", "other", "body", "body_b").mapInArrow(work, "kind byte, a long, b long, n long"))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null, they have as many components, and their cosine in double
    precision is ``threshold`` (above 0) or more. Vectors that are null, empty or zero, or hold a null or a component that
    is not finite, link with nothing, as do those without label. n_links counts the other rows linked directly; rows that
    repeat a vector (or a whole row) are other rows. component_id is the least id reachable, the row's own included; a
    null id never names a component, and one of null ids only has none. kept: the row's id names its component.

    Equal vectors of a label are one class with a count, found by a partial aggregate. Classes are rotated to principal
    directions, cut into parts by bands of the first two, and only parts whose boxes are near meet. The work is
    quadratic in the classes of one label within reach, as exact comparison is.
    """
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("int").alias("label"))
    given = given.withColumn("good", F.col("label").isNotNull() & _usable(F.col("embedding")))
    classes = given.filter("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
    classes = checkpointed(classes.withColumn("dim", F.size("embedding")).repartition("label", "embedding").withColumn("class", F.monotonically_increasing_id()))
    found = links(classes.select("class", "times", "label", "dim", "embedding"), threshold)
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("more"))
    member = components(classes.select(F.col("class").alias("id")), found.filter("kind = 1").select("a", "b")).withColumnRenamed("id", "class")
    named = checkpointed(classes.select("class", "least", "times", "label", "embedding").join(member, "class").join(counts, "class", "left"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(names, "component").select("label", "embedding", "times", (F.col("times") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    # a vector that many rows share is looked up where they are
    size = classes.agg(F.sum("times").alias("n")).first()["n"] or 0
    some = lookup(given.filter("good"), checkpointed(told), ["label", "embedding"], "times", max(size // 1000, 1000))
    rest = given.filter(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = some.select("vec_id", "n_links", "component_id").unionByName(rest)
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
