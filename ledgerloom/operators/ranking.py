"""Order within groups, when a group may hold a third of all rows.

A window over a group sorts it in one task. Here groups of more than ``limit``
rows are first split at approximate quantiles of the order column (a mergeable
summary per group, a few hundred numbers), so the window sorts one slice of
a group, and the slices' counts, a few hundred rows a group, give each slice its
place. Every position is exact; only the slicing is approximate. Without such a
group nothing is split, and one window does the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import checkpointed

HOT_ROWS = 100_000
SLICES = 256
_SLICE = "_slice"


def same(keys: list[str], prefix: str) -> Column:
    """The keys equal their prefixed copies, nulls included."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(prefix + k))
    return on


def sliced(df: DataFrame, keys: list[str], order: str, limit: int = HOT_ROWS,
           slices: int = SLICES) -> tuple[DataFrame, bool]:
    """(``df`` with ``_slice``, whether any group is split). Slices of a group follow one
    another in ``order``; equal values share a slice."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = checkpointed(sizes.where(F.col("_n") > limit).select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    if hot.isEmpty():
        return df.withColumn(_SLICE, F.lit(0)), False
    cuts = [i / slices for i in range(1, slices)]
    points = df.join(hot, same(keys, "_h_"), "left_semi").groupBy(*[F.col(k).alias(f"_p_{k}") for k in keys]) \
        .agg(F.percentile_approx(order, cuts, 10 * slices).alias("_points"))
    found = df.join(checkpointed(points), same(keys, "_p_"), "left")
    at = F.coalesce(F.size(F.filter("_points", lambda p: p < F.col(order))), F.lit(0))
    at = F.when(F.col("_points").isNull(), F.lit(0)).otherwise(at)
    return found.withColumn(_SLICE, at).drop("_points", *[f"_p_{k}" for k in keys]), True


def running_total(df: DataFrame, keys: list[str], order: str, n: Column, out: str, ties: str | None = None,
                  limit: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """``df`` with ``out``: the sum of ``n`` over the rows of its group up to and
    including its own, in the order of ``order`` (and ``ties`` among equals)."""
    rows, split = sliced(df.withColumn("_w", n), keys, order, limit, slices)
    by = [order] + ([ties] if ties else [])
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn(out, F.sum("_w").over(inside))
    if split:
        before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        bases = rows.groupBy(*keys, _SLICE).agg(F.sum("_w").alias("_sum")).select(
            *[F.col(k).alias(f"_b_{k}") for k in keys], F.col(_SLICE).alias("_b_slice"),
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
        rows = rows.join(bases, same(keys, "_b_") & (F.col(_SLICE) == F.col("_b_slice"))) \
            .withColumn(out, F.col(out) + F.col("_base")).drop("_base", "_b_slice", *[f"_b_{k}" for k in keys])
    return rows.drop("_w", _SLICE)
