"""Vector blocks under a tree of pivots: the unit of work of all pairwise vector operators.

A tree of pivots is grown from a bounded sample: each node is split among up to ``FAN`` centres, until a leaf stands for
about half a block of rows. Vectors go down the tree to a leaf, are range-partitioned by (zone, leaf, distance
to its centre, id) and cut into blocks of a bounded number of rows; the id is part of the range, so a zone or a leaf
that holds a third of all rows is cut like any other. A block is one row with its vectors as a packed matrix and, for
each node on its path, the nearest and the farthest distance of a member to the centre, and a ball of its own.

Two subtrees, or two blocks, are at least as far apart as their centres less their radii. ``candidates`` walks the tree
against itself from the root: a pair of subtrees that lies beyond the limit of its left side is dropped with
all block pairs below it, so these are never listed, and matrices are joined for what is left only. They are joined
by tiles, groups of left and right blocks, so a matrix moves once for a group of partners (``meet``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, groupby

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import checkpointed

BLOCK_ROWS = 1024
FAN = 32
SAMPLE_BYTES = 16 << 20  # bounds the sample, and with it the tree and all that is broadcast of it
SAMPLE_PER_LEAF = 8
TILE_BYTES = 64 << 20  # matrices that a task holds at a time
TILES_PER_CORE = 4
SLACK = 1e-9

BLOCK_SCHEMA = (
    "block long, zone long, n int, node int, path array<int>, inner array<double>, outer array<double>, "
    "middle array<double>, radius double, min_tag double, max_tag double, ids binary, tags binary, mat binary"
)


@dataclass
class PivotTree:
    """Nodes in depth-first order; ``path[k, l]`` is the ancestor of k at level l, k itself below its own level."""

    centres: np.ndarray
    kids: list[np.ndarray]
    path: np.ndarray

    @property
    def depth(self) -> int:
        return self.path.shape[1] - 1

    def leaves_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row, by the nearest centre at each level, and its distance to the centre of the leaf."""
        node = np.zeros(len(x), dtype=int)
        open_ = np.unique(node) if len(self.kids[0]) else node[:0]
        while len(open_):
            below = []
            for k in open_:
                rows = np.nonzero(node == k)[0]
                node[rows] = self.kids[k][squared_distances(x[rows], self.centres[self.kids[k]]).argmin(1)]
                below += [c for c in np.unique(node[rows]) if len(self.kids[c])]
            open_ = np.array(below, dtype=int)
        return node, np.sqrt(((x - self.centres[node]) ** 2).sum(1))

    def meet(self, nodes: np.ndarray) -> int:
        """Lowest node above all ``nodes``."""
        paths = self.path[nodes]
        same = (paths == paths[0]).all(0)
        return int(paths[0][np.nonzero(same)[0].max()])


@dataclass
class Blocks:
    """Blocks of one vector table. ``nodes`` (level, node, up, centre, outer) is the tree, with what its blocks reach."""

    df: DataFrame
    nodes: DataFrame
    depth: int
    dim: int


def grow_tree(sample: np.ndarray, leaves: int) -> PivotTree:
    """Tree over a sample in random order: centres start as its first rows and are moved to the means of their rows."""
    per_leaf = max(len(sample) // max(leaves, 1), 1)
    centres, kids, up, level = [], [], [], []

    def split(rows: np.ndarray, centre: np.ndarray, above: int) -> int:
        me = len(centres)
        centres.append(centre)
        kids.append(np.zeros(0, dtype=int))
        up.append(above)
        level.append(level[above] + 1 if above >= 0 else 0)
        wanted = min(FAN, -(-len(rows) // per_leaf))
        if wanted > 1:
            x = sample[rows]
            means = np.unique(x[:wanted], axis=0)
            for _ in range(4):
                at = squared_distances(x, means).argmin(1)
                held = np.unique(at)
                means = np.stack([x[at == k].mean(0) for k in held])
            if len(held) > 1:
                at = squared_distances(x, means).argmin(1)
                kids[me] = np.array([split(rows[at == k], means[k], me) for k in np.unique(at)], dtype=int)
        return me

    split(np.arange(len(sample)), sample.mean(0) if len(sample) else np.zeros(sample.shape[1]), -1)
    path = np.zeros((len(centres), max(level) + 1), dtype=int)
    for k in range(len(centres)):
        path[k, : level[k]] = path[up[k], : level[k]] if k else 0
        path[k, level[k] :] = k
    return PivotTree(np.array(centres), kids, path)


def choose_sample(vectors: DataFrame, rows: int, block_rows: int) -> tuple[np.ndarray, int]:
    """Vectors the first by a hash of the id (a top-k, at most ``SAMPLE_BYTES``), and the leaves to grow from them."""
    dim = (vectors.select(F.size("embedding").alias("d")).first() or [0])[0]
    leaves = max(2 * rows // block_rows, 1)
    count = int(max(min(SAMPLE_PER_LEAF * leaves, rows, SAMPLE_BYTES // (8 * max(dim, 1))), 1))
    picked = vectors.orderBy(F.xxhash64("article_id"), "article_id").limit(count).select("embedding").collect()
    return np.array([r[0] for r in picked], dtype=float).reshape(len(picked), -1), min(leaves, max(count // SAMPLE_PER_LEAF, 1))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances; few dimensions are summed one by one, which is exact and symmetric.

    Many go through one product; pairs whose distance is small against their lengths, where that product
    cancels, are summed from their differences.
    """
    if a.shape[1] <= 32:
        out = np.zeros((len(a), len(b)))
        for k in range(a.shape[1]):
            diff = a[:, k, None] - b[None, :, k]
            out += diff * diff
        return out
    lengths = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    out = lengths - 2.0 * (a @ b.T)
    left, right = np.nonzero(out <= 1e-4 * lengths)
    for at in range(0, len(left), 1 << 14):
        i, j = left[at : at + (1 << 14)], right[at : at + (1 << 14)]
        out[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return out


def within(a: np.ndarray, b: np.ndarray, limit: np.ndarray, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and squared distances of the pairs (that ``open_`` marks) whose squared distance is not above ``limit`` of the row.

    One product in single precision, about the middle of ``b``, finds them with a margin above its own error; the distances of
    these few are then summed from their differences. Where the margin lets through too many, all distances are taken.
    """
    middle = b.mean(0)
    x, y = a - middle, b - middle
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    scale, most, found = max(xx.max(), yy.max()), yy.max(), None
    if np.isfinite(scale) and scale > 0:
        left = np.hstack([x / np.sqrt(scale), np.ones((len(a), 1))]).astype("float32")
        right = np.hstack([y / np.sqrt(scale / 4), -yy[:, None] / scale]).astype("float32")
        margin = (a.shape[1] + 16) * 2.0**-21 * (xx + most)
        least = np.maximum((xx - limit - margin) / scale, -8.0).astype("float32")  # no product is below -3
        found = left @ right.T >= least[:, None]
        if open_ is not None:
            found &= open_
        if np.count_nonzero(found) > found.size // 16:
            found = None
    if found is None:
        d = squared_distances(a, b)
        i, j = np.nonzero(d <= limit[:, None] if open_ is None else (d <= limit[:, None]) & open_)
        return i, j, d[i, j]
    i, j = np.divmod(np.flatnonzero(found), len(b))
    d = np.empty(len(i))
    for at in range(0, len(i), 1 << 14):
        part = slice(at, at + (1 << 14))
        d[part] = ((a[i[part]] - b[j[part]]) ** 2).sum(1)
    near = d <= limit[i]
    return i[near], j[near], d[near]


def rounded(d: np.ndarray) -> np.ndarray:
    """Distances to 36 binary digits, relative to each, so that ties do not hang on the order of a sum."""
    mantissa, exponent = np.frexp(d)
    return np.ldexp(np.round(mantissa * 2.0**36) / 2.0**36, exponent)


def build_blocks(
    vectors: DataFrame, zone: Column | None = None, tag: Column | None = None, block_rows: int = BLOCK_ROWS
) -> Blocks:
    """Blocks of ``vectors(article_id, embedding)``.

    ``zone`` keeps rows apart that need not meet (for example days). ``tag`` is one number per row that travels with
    the block. A block ends with its zone, when it is full, or with its leaf once it is a quarter full; so it may
    cover several small leaves, and then stands under the lowest node above them.
    """
    base = vectors.select(
        "article_id",
        "embedding",
        (zone if zone is not None else F.lit(0)).cast("long").alias("zone"),
        (tag if tag is not None else F.lit(0.0)).cast("double").alias("tag"),
    )
    sample, leaves = choose_sample(base, base.count(), block_rows)
    tree, dim = grow_tree(sample, leaves), sample.shape[1]
    sent = base.sparkSession.sparkContext.broadcast(tree)

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                leaf, dist = sent.value.leaves_of(np.stack(b["embedding"].to_numpy()))
                yield b.assign(leaf=leaf.astype("int32"), dist=dist)

    located = base.mapInPandas(
        locate, "article_id long, embedding array<double>, zone long, tag double, leaf int, dist double"
    )
    order = ["zone", "leaf", "dist", "article_id"]
    ranged = located.repartitionByRange(*order).sortWithinPartitions(*order)

    def block_row(name: int, held: list[pd.DataFrame]) -> pd.DataFrame:
        tree, rows = sent.value, pd.concat(held)
        # Members are kept in id order, so that the first of several equal distances has the lowest id.
        rows = rows.iloc[np.argsort(rows["article_id"].to_numpy())]
        ids, tags = rows["article_id"].to_numpy(), rows["tag"].to_numpy()
        mat = np.ascontiguousarray(np.stack(rows["embedding"].to_numpy()).astype(float))
        path = tree.path[tree.meet(rows["leaf"].unique())]
        middle = mat.mean(0)
        *reach, own = [np.sqrt(((mat - c) ** 2).sum(1)) for c in (*tree.centres[path], middle)]
        return pd.DataFrame(
            [
                {
                    "block": name,
                    "zone": int(rows["zone"].iloc[0]),
                    "n": len(ids),
                    "node": int(path[-1]),
                    "path": path.tolist(),
                    "inner": [float(d.min()) for d in reach],
                    "outer": [float(d.max()) for d in reach],
                    "middle": middle.tolist(),
                    "radius": float(own.max()),
                    "min_tag": float(tags.min()),
                    "max_tag": float(tags.max()),
                    "ids": ids.astype("int64").tobytes(),
                    "tags": tags.astype("float64").tobytes(),
                    "mat": mat.tobytes(),
                }
            ]
        )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        names = count(TaskContext.get().partitionId() << 32)  # not by an id, which may be repeated in another block
        for b in batches:
            for (z, leaf), part in b.groupby(["zone", "leaf"], sort=False):
                size = sum(map(len, held))
                if held and (held[0]["zone"].iloc[0] != z or (size >= block_rows // 4 and held[-1]["leaf"].iloc[0] != leaf)):
                    yield block_row(next(names), held)
                    held, size = [], 0
                while len(part):
                    if size >= block_rows:
                        yield block_row(next(names), held)
                        held, size = [], 0
                    held.append(part.iloc[: block_rows - size])
                    part = part.iloc[block_rows - size :]
                    size += len(held[-1])
        if held:
            yield block_row(next(names), held)

    df = checkpointed(ranged.mapInPandas(pack, BLOCK_SCHEMA))
    centres = base.sparkSession.createDataFrame(
        pd.DataFrame({"node": np.arange(len(tree.centres), dtype="int32"), "centre": tree.centres.tolist()}), "node int, centre array<double>"
    )
    steps = F.explode(F.sequence(F.lit(0), F.lit(tree.depth)))
    per = df.select("path", "outer", steps.alias("level")).groupBy("level", F.col("path")[F.col("level")].alias("node")).agg(
        F.max(F.col("path")[F.greatest(F.col("level") - 1, F.lit(0))]).alias("up"), F.max(F.col("outer")[F.col("level")]).alias("outer")
    )
    return Blocks(df, checkpointed(per.join(F.broadcast(centres), "node").select("level", "node", "up", "centre", "outer")), tree.depth, dim)


def _apart(centre_a, centre_b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(centre_a, centre_b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def outlines(blocks: Blocks, side: str) -> DataFrame:
    """The blocks without their matrices, columns suffixed with ``side``; radii to the centre of their node."""
    cols = ["block", "zone", "n", "node", "middle", "radius", "min_tag", "max_tag"]
    last = [F.col(c)[blocks.depth].alias(f"{c}_{side}") for c in ("inner", "outer")]
    return blocks.df.select(*[F.col(c).alias(f"{c}_{side}") for c in cols], *last)


def node_pairs(blocks: Blocks, worth=None, marks: DataFrame | None = None) -> DataFrame:
    """(node_a, node_b, apart): pairs of lowest nodes that survive the walk of the tree against itself.

    ``worth(bound, a, b)`` says whether two subtrees at least ``bound`` apart may matter; ``a`` and ``b`` name a column of
    ``marks`` (level, node, …) of either side. The tree is bounded by its sample, so a level is broadcast.
    """
    def level(n: int, side: str) -> DataFrame:
        rows = blocks.nodes.filter(F.col("level") == n)
        if marks is not None:
            rows = rows.join(F.broadcast(marks), ["level", "node"])
        return F.broadcast(rows.drop("level").select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns if c != "level"]))

    extra = [c for c in (marks.columns if marks is not None else []) if c not in ("level", "node")]
    pairs = level(0, "a").join(level(0, "b")).select("node_a", "node_b", F.lit(0.0).alias("apart"))
    for n in range(1, blocks.depth + 1):
        above = pairs.select(F.col("node_a").alias("up_a"), F.col("node_b").alias("up_b"))
        met = above.join(level(n, "a"), "up_a").join(level(n, "b"), "up_b").withColumn("apart", _apart("centre_a", "centre_b"))
        if worth is not None:
            bound = lowest(F.col("apart"), F.lit(0.0), F.col("outer_a"), F.lit(0.0), F.col("outer_b"), F.lit(False))
            met = met.filter(worth(bound, *({c: F.col(f"{c}_{side}") for c in extra} for side in "ab")))
        pairs = met.select("node_a", "node_b", "apart")
    return pairs


def lowest(apart: Column, inner_a: Column, outer_a: Column, inner_b: Column, outer_b: Column, same: Column) -> Column:
    """Least possible distance of two members: centres less radii, or between two shells about one centre."""
    shells = F.greatest(inner_a - outer_b, inner_b - outer_a)
    bound = F.when(same, shells).otherwise(apart - outer_a - outer_b)
    return F.greatest(bound - (apart + outer_a + outer_b + 1.0) * SLACK, F.lit(0.0))


def candidates(blocks: Blocks, worth=None, marks: DataFrame | None = None, near_zones: bool = False) -> DataFrame:
    """Pairs of block outlines (a, b) with ``bound`` and ``most``, the least and largest distance of their members.

    Both orders of a pair are listed, and each block with itself. ``worth`` and ``marks`` prune the walk of the tree.
    ``near_zones`` keeps pairs with zone_b equal to zone_a or one more.
    """
    a, b = outlines(blocks, "a"), outlines(blocks, "b")
    pairs = node_pairs(blocks, worth, marks).join(a, "node_a")
    if near_zones:
        pairs = pairs.withColumn("zone_b", F.explode(F.array("zone_a", F.col("zone_a") + 1)))
    joined = pairs.join(b, ["node_b", "zone_b"] if near_zones else ["node_b"])
    bound = lowest(F.col("apart"), F.col("inner_a"), F.col("outer_a"), F.col("inner_b"), F.col("outer_b"), F.col("node_a") == F.col("node_b"))
    zero, own = F.lit(0.0), _apart("middle_a", "middle_b")
    joined = joined.withColumns({"bound": bound, "own": own, "balls": F.col("radius_a") + F.col("radius_b")})
    nearer = lowest(F.col("own"), zero, F.col("radius_a"), zero, F.col("radius_b"), F.lit(False))
    most = (F.col("own") + F.col("balls")) * (1 + SLACK) + SLACK
    return joined.withColumns({"bound": F.greatest("bound", nearer), "most": most}).drop("own", "balls", "middle_a", "middle_b")


def by_level(blocks: Blocks, per_block: DataFrame, *aggregates: Column) -> DataFrame:
    """``marks`` for the walk: the aggregates of ``per_block(block, …)`` for each node of each level."""
    path = blocks.df.select("block", "path", F.explode(F.sequence(F.lit(0), F.lit(blocks.depth))).alias("level"))
    return path.join(per_block, "block").groupBy("level", F.col("path")[F.col("level")].alias("node")).agg(*aggregates)


def tile_sides(blocks: Blocks) -> DataFrame:
    """(block, tile): blocks in groups of neighbours, each at most ``TILE_BYTES`` of matrices and few enough to keep all cores busy.

    One narrow row per block is numbered, about a thousandth of the vectors.
    """
    cores = blocks.df.sparkSession.sparkContext.defaultParallelism
    size = blocks.df.agg(F.count(F.lit(1)).alias("blocks"), F.max("n").alias("rows")).first()
    held = TILE_BYTES // max(8 * blocks.dim * (size["rows"] or 1), 1)
    per = max(min(held, math.ceil(size["blocks"] / math.ceil(math.sqrt(TILES_PER_CORE * cores)))), 1)
    at = F.row_number().over(Window.orderBy("zone", "node", "block")) - 1
    return blocks.df.select("block", F.floor(at / per).alias("tile"))


def meet(pairs: DataFrame, blocks: Blocks, kernel, schema: str, extra: DataFrame | None = None) -> DataFrame:
    """Rows of ``kernel`` over ``pairs(block_a, block_b)``, which gets frames of pairs with the columns of both blocks.

    A tile is what a group of left blocks has to do with a group of right ones. A matrix travels once to each tile that needs it, not
    once per pair; the left blocks of a tile are held, the right ones go by one at a time, each with its partners. ``kernel``
    runs once per tile, so what it adds up leaves once per tile. ``extra(block, …)`` are further columns of a block.
    """
    side = blocks.df.select("block", "ids", "tags", "mat")
    side = side if extra is None else side.join(extra, "block")
    tiles = checkpointed(tile_sides(blocks))
    light = pairs.select("block_a", "block_b")
    for name in "ab":
        light = light.join(tiles.select(F.col("block").alias(f"block_{name}"), F.col("tile").alias(f"tile_{name}")), f"block_{name}")
    light = checkpointed(light)
    tile = ["tile_a", "tile_b"]
    left = light.select(*tile, F.col("block_a").alias("block"), F.lit(None).cast("array<long>").alias("partners")).distinct()
    right = light.groupBy(*tile, F.col("block_b").alias("block")).agg(F.array_sort(F.collect_list("block_a")).alias("partners"))
    rows = left.unionByName(right).withColumn("goes", F.col("partners").isNotNull()).join(side, "block")
    names = [c for c in side.columns if c != "block"]

    def frames(rows) -> Iterator[pd.DataFrame]:
        held = {}
        for row in rows:
            if not row.goes:
                held[row.block] = row
                continue
            near = [held[k] for k in row.partners]
            both = {"block_a": [x.block for x in near], "block_b": [row.block] * len(near)}
            both |= {f"{c}_a": [getattr(x, c) for x in near] for c in names} | {f"{c}_b": [getattr(row, c)] * len(near) for c in names}
            yield pd.DataFrame(both)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.itertuples(index=False))
        for _, mine in groupby(rows, key=lambda row: (row.tile_a, row.tile_b)):
            yield from kernel(frames(mine))

    return rows.repartition(*tile).sortWithinPartitions(*tile, "goes", "block").mapInPandas(run, schema)


def unpack(row, side: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(getattr(row, f"ids_{side}"), dtype="int64")
    tags = np.frombuffer(getattr(row, f"tags_{side}"), dtype="float64")
    return ids, tags, np.frombuffer(getattr(row, f"mat_{side}"), dtype="float64").reshape(len(ids), dim)
