"""Duplicate rows and outliers of a sales table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.cleaning import q
from ledgerloom.operators.ranking import HOT_ROWS, SLICES, running_total, same
from ledgerloom.session import checkpointed

FENCE = 1.5


def quartiles(sales: DataFrame, value: str = "sales_quantity", limit: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """``sku_id, n_values, q1, q3`` per SKU: exact quartiles, interpolated between neighbours.

    Values are counted per (SKU, value) before anything is sorted, and
    the quartiles are read off the running counts: no list of a SKU's values exists.
    Null and NaN values have no rank; a SKU without any other has no row.
    """
    x = q(value).cast("double")
    counted = sales.select("sku_id", F.when(~F.isnan(x), x + F.lit(0.0)).alias("value")).where("value is not null") \
        .groupBy("sku_id", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(counted, ["sku_id"], "value", F.col("n"), "upto", limit=limit, slices=slices)
    totals = counted.groupBy(F.col("sku_id").alias("_t_sku_id")).agg(F.sum("n").alias("n_values"))
    ranked = upto.join(totals, same(["sku_id"], "_t_"))

    def at(rank: Column) -> Column:
        """The value of a rank counted from 0: the one row whose counts cover it."""
        return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col("value")))

    marks = {}
    for name, share in (("q1", 0.25), ("q3", 0.75)):
        place = (F.col("n_values") - 1) * F.lit(share)
        marks[f"{name}_low"], marks[f"{name}_high"] = at(F.floor(place)), at(F.ceil(place))
    found = ranked.groupBy("sku_id", "n_values").agg(*[c.alias(k) for k, c in marks.items()])

    def between(name: str, share: float) -> Column:
        place = (F.col("n_values") - 1) * F.lit(share)
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))

    return found.select("sku_id", "n_values", between("q1", 0.25).alias("q1"), between("q3", 0.75).alias("q3"))


def _packed(df: DataFrame) -> Column:
    """The row as one struct, so no column of it clashes with what is computed beside it."""
    return F.struct(*[q(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row")


def _unpacked(rows: DataFrame, names: list[str], new: list[str]) -> DataFrame:
    """The packed columns but for those called like ``new`` ones, and ``new``."""
    taken = {c.lower() for c in new}
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names) if c.lower() not in taken], *new)


def flag_outliers(sales: DataFrame, value: str = "sales_quantity", fence: float = FENCE,
                  limit: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """``sales`` with ``low_fence, high_fence`` (quartiles less and plus ``fence`` times
    their distance, per SKU) and ``outlier``: outside them. Null and NaN values are
    none. Columns of these names are replaced."""
    apart = F.col("q3") - F.col("q1")
    fences = quartiles(sales, value, limit, slices).select(
        F.col("sku_id").alias("_f_sku_id"), (F.col("q1") - F.lit(fence) * apart).alias("low_fence"),
        (F.col("q3") + F.lit(fence) * apart).alias("high_fence"))
    rows = sales.select(_packed(sales), "sku_id", q(value).cast("double").alias("x"))
    x = F.col("x")
    out = ((x < F.col("low_fence")) | (x > F.col("high_fence"))) & ~F.isnan(x)
    joined = rows.join(fences, same(["sku_id"], "_f_"), "left").withColumn("outlier", F.coalesce(out, F.lit(False)))
    return _unpacked(joined, sales.columns, ["low_fence", "high_fence", "outlier"])


def _canonical(df: DataFrame, name: str) -> Column:
    """A cell as text for hashing: NaN is one value, -0.0 is 0.0, null is told from any text."""
    c, kind = q(name), df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        c = F.when(F.isnan(c), F.lit("NaN")).otherwise((c + F.lit(0.0).cast(kind)).cast("string"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        c = F.to_json(F.struct(c))
    elif isinstance(kind, T.BinaryType):
        c = F.hex(c)
    else:
        c = c.cast("string")
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))


def duplicate_rows(df: DataFrame, order_col: str, columns: list[str] | None = None,
                   limit: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """``df`` with ``copies`` (rows equal to this one, itself included), ``occurrence``
    (1 for the first) and ``first_row`` (the ``order_col`` of the first). Columns of these
    names are replaced.

    Rows are equal when all ``columns`` (all but ``order_col`` by default) are; null
    equals null and NaN equals NaN. ``order_col`` is a unique number that orders rows.

    Rows are first counted by a 128-bit hash, then dealt by it once and compared column by
    column there. A row that more than ``limit`` rows repeat is left out of that: it is
    counted per task before a shuffle and numbered in slices.
    """
    columns = list(columns or [c for c in df.columns if c != order_col])
    # What Spark can group and compare; maps and variants go by their hash alone.
    exact = [c for c in columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    cells = F.struct(*[q(c).alias(f"e{i}") for i, c in enumerate(exact)], F.lit(0).alias("e"))
    hashed = df.select(_packed(df), q(order_col).alias("at"), cells.alias("cells"),
                       F.unhex(F.md5(F.concat(*[_canonical(df, c) for c in columns]))).alias("hash"))
    sizes = hashed.groupBy(F.col("hash").alias("s_hash")).agg(F.count(F.lit(1)).alias("n"))
    hot = checkpointed(sizes.where(F.col("n") > limit).select("s_hash"))
    is_hot = F.col("hash") == F.col("s_hash")
    some_hot = not hot.isEmpty()
    one = F.lit(1).cast("bigint")
    equal = Window.partitionBy("hash", "cells")
    both = (hashed.join(hot, is_hot, "left_anti") if some_hot else hashed).select(
        "row", F.count(F.lit(1)).over(equal).alias("copies"),
        F.row_number().over(equal.orderBy("at")).cast("bigint").alias("occurrence"),
        F.min("at").over(equal).alias("first_row"))
    if some_hot:
        many = hashed.join(hot, is_hot, "left_semi")
        firsts = many.groupBy(F.col("hash").alias("e_hash"), F.col("cells").alias("e_cells")).agg(
            F.count(F.lit(1)).alias("copies"), F.min("at").alias("first_row"))
        many = many.join(firsts, (F.col("hash") == F.col("e_hash")) & F.col("cells").eqNullSafe(F.col("e_cells")))
        many = running_total(many.select("row", "at", "copies", "first_row"), ["first_row"], "at", one, "occurrence",
                             limit=limit, slices=slices)
        both = both.unionByName(many.select("row", "copies", "occurrence", "first_row"))
    return _unpacked(both, df.columns, ["copies", "occurrence", "first_row"])


def drop_duplicate_rows(df: DataFrame, order_col: str, columns: list[str] | None = None) -> DataFrame:
    """The first row of each group of equal rows."""
    new = df.select(F.struct(*[q(c) for c in df.columns]).alias("whole"), q(order_col).alias("at"),
                    *[q(c).alias(f"d{i}") for i, c in enumerate(columns or [c for c in df.columns if c != order_col])])
    first = duplicate_rows(new, "at", [c for c in new.columns if c not in ("whole", "at")]).where("occurrence = 1")
    return first.select(*[F.col("whole").getField(c).alias(c) for c in df.columns])
