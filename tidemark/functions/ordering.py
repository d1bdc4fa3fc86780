"""Dense numbering and skew-safe lookups without single-task sorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LEVELS = (12, 26, 40)  # bits below the ranges of each level


def dense_index(df: DataFrame, order_col: str, out: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """0-based position of each row by ``order_col``, a unique long (per group).

    Equals ``row_number() - 1`` over the whole group but never sorts a group in one task: the order
    value is cut into ranges of 2^12 values. A window numbers the rows inside one range, and the range
    counts give the offsets, through two more levels of ranges. As the values are unique, a range holds at most 2^12 rows,
    whatever the skew and however wide the rows, and a range of ranges at most 2^14 counts.
    """
    ranges = [f"_r{bits}" for bits in _LEVELS]
    rows = df.withColumns({r: F.shiftright(order_col, bits) for r, bits in zip(ranges, _LEVELS)})
    before = (Window.unboundedPreceding, -1)
    counts = rows.groupBy(*groups, *ranges).agg(F.count(F.lit(1)).alias("_n"))
    offsets, levels = None, counts
    for at, name in enumerate(ranges):
        above = ranges[at + 1 :]
        levels = levels if not at else levels.groupBy(*groups, name, *above).agg(F.sum("_n").alias("_n"))
        w = Window.partitionBy(*groups, *above).orderBy(name).rowsBetween(*before)
        here = levels.select(*groups, name, *above, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_off{at}"))
        offsets = here if offsets is None else offsets.join(here, [*groups, name, *above])
    total = sum((F.col(f"_off{at}") for at in range(1, len(ranges))), F.col("_off0"))
    # Placed by all keys: a side that lies by its highest range only would draw all rows of that range into one task.
    offsets = offsets.select(*groups, *ranges, total.alias("_off")).repartition(*groups, *ranges)
    w_row = Window.partitionBy(*groups, *ranges).orderBy(order_col)
    numbered = rows.withColumn("_rn", F.row_number().over(w_row))
    return (
        numbered.join(offsets, [*groups, *ranges])
        .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long"))
        .select(*df.columns, out)
    )


def lookup(big: DataFrame, small: DataFrame, on: list[str], weight: str, heavy: int) -> DataFrame:
    """Left join of ``big`` with ``small`` (unique on ``on``) that survives hot keys.

    ``weight`` is the number of rows of ``big`` behind each key of ``small``. Keys with more than
    ``heavy`` rows number at most ``rows / heavy``; with ``heavy`` = rows / 1000 that is under 1,000
    rows, so they are broadcast and their rows never move. All other keys take the shuffle join.
    """
    value_cols = [c for c in small.columns if c not in (*on, weight)]
    hot = small.filter(F.col(weight) > heavy).select(*on, *value_cols, F.lit(True).alias("_hot"))
    cold = small.filter(F.col(weight) <= heavy).select(*on, *value_cols)
    marked = big.join(F.broadcast(hot), on, "left")
    done = marked.filter(F.col("_hot")).select(*big.columns, *value_cols)
    rest = marked.filter(F.col("_hot").isNull()).select(*big.columns).join(cold, on, "left")
    return done.unionByName(rest.select(*big.columns, *value_cols))


def first_rows(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """First row per key by ``order_col``; a partial aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order_col).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def all_of(conditions):
    """AND of a list of conditions, true if there is none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else unchanged.

    The check reads ``max_rows + 1`` rows at most. Use it on materialised, narrow tables; beyond the
    limit the join is a shuffle join and AQE splits its skewed partitions.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
