"""Time series of the sales table: rolling averages, lags, trends, price statistics.

Everything starts from ``daily_sales``, one row per SKU and day, which a partial
aggregate makes before anything is shuffled: a SKU that holds a third of all sales is then
as many rows as it has days. Windows run over those days, never over sales.

Sales without a date have no place in time and are left out; a null SKU is a
SKU of its own. Sums are exact (see ``sales.exact_sum``), so no result
depends on how rows are split over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.sales import exact_sum

#: Prices are taken at six decimals and below 10^11, so that a squared difference, of twelve
#: decimals, is exact.
PRICE_TYPE, APART_TYPE = "decimal(17,6)", "decimal(18,6)"

PERIODS = ("day", "week", "month")

#: Rows that a task sums or sorts: what it holds does not grow with the input.
ROWS_A_TASK = 250_000


def _tasks(rows: DataFrame) -> int:
    """Into how many tasks to deal ``rows``: in proportion to their number."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))


def daily_sales(sales: DataFrame, key: str = "sku_id") -> DataFrame:
    """One row per SKU (or other ``key``) and day with sales: ``sku_id, day, quantity, revenue, n_sales``."""
    return _daily(sales, key)[0]


def _daily(sales: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``daily_sales``, and the number of tasks that its rows fit in."""
    rows = sales.where(F.col("date").isNotNull()).select(key, "date", "sales_quantity", "sales_revenue")
    tasks = _tasks(rows)
    # Dealt by whole rows, so a hot SKU, or a hot day of it, is not one task's.
    days = rows.repartition(tasks, *rows.columns).groupBy(key, F.to_date("date").alias("day")).agg(
        F.coalesce(exact_sum(F.col("sales_quantity")), F.lit(0.0)).alias("quantity"),
        F.coalesce(exact_sum(F.col("sales_revenue")), F.lit(0.0)).alias("revenue"),
        F.count(F.lit(1)).alias("n_sales"))
    return days, tasks


def _at_least_a_day(days: Sequence[int]) -> None:
    if any(n < 1 for n in days):
        raise ValueError(f"numbers of days must be 1 at least, got {list(days)}")


def rolling_averages(sales: DataFrame, days: Sequence[int] = (7, 30), key: str = "sku_id") -> DataFrame:
    """For each SKU and day with sales, the mean per calendar day of the last N days.

    The N days end with the day itself. A day without sales counts as 0; days
    before the SKU's first sale are not counted. Columns: those of ``daily_sales``
    and ``quantity_Nd, revenue_Nd`` for each N.
    """
    _at_least_a_day(days)
    number = F.unix_date("day")
    per_key = Window.partitionBy(key).orderBy(number)
    first = F.min(number).over(per_key)
    out = {}
    for n in days:
        frame = per_key.rangeBetween(-(n - 1), Window.currentRow)
        counted = F.least(F.lit(n), number - first + 1)
        for c in ("quantity", "revenue"):
            out[f"{c}_{n}d"] = exact_sum(F.col(c), frame) / counted
    return daily_sales(sales, key).withColumns(out)


def lagged_sales(sales: DataFrame, lags: Sequence[int] = (7, 30), key: str = "sku_id", dense: bool = True) -> DataFrame:
    """Quantity and revenue of a day and of N calendar days before it.

    ``dense`` gives a row for every calendar day between a SKU's first and last
    sale, else only the days with sales have one. A day without sales is 0;
    where the day N days before comes before the first sale, the lag is null.
    Columns: ``sku_id, day, quantity, revenue`` and ``quantity_lag_N,
    revenue_lag_N`` for each N.

    The days are dealt once by SKU, which has as many rows as days; all lags are windows over
    them, and the calendar is made and met where the SKU's days are.
    """
    _at_least_a_day(lags)
    daily, tasks = _daily(sales, key)
    daily = daily.select(key, "day", "quantity", "revenue").repartition(tasks, key)
    zero = F.lit(0.0)
    if dense:
        spans = daily.groupBy(key).agg(F.min("day").alias("first"), F.max("day").alias("last"))
        daily = daily.unionByName(spans.select(key, F.explode(F.sequence("first", "last")).alias("day")),
                                  allowMissingColumns=True).repartition(tasks, key).groupBy(key, "day").agg(
            *[F.coalesce(F.max(c), zero).alias(c) for c in ("quantity", "revenue")])
    number = F.unix_date("day")
    per_key = Window.partitionBy(key).orderBy(number)
    first = F.min("day").over(per_key)
    out = []
    for n in lags:
        known = F.date_sub("day", n) >= first
        out += [F.when(known, F.coalesce(F.max(c).over(per_key.rangeBetween(-n, -n)), zero)).alias(f"{c}_lag_{n}")
                for c in ("quantity", "revenue")]
    return daily.select(key, "day", "quantity", "revenue", *out)


def _start(period: str, day: Column) -> Column:
    return day if period == "day" else F.trunc(day, period)


def _start_before(period: str, start: Column) -> Column:
    return {"day": F.date_sub(start, 1), "week": F.date_sub(start, 7),
            "month": F.add_months(start, -1)}[period].cast("date")


def sales_trend(sales: DataFrame) -> DataFrame:
    """Sales per day, week (from Monday) and month, of each SKU and of all, with
    the change against the period before.

    The days are dealt once by SKU, which has as many rows as days: its periods are made
    where its days are. Those of all SKUs are three groupings of few rows. Columns: ``period`` (day, week, month), ``start``, ``all_skus`` (then
    ``sku_id`` is null), ``quantity, revenue, n_sales``, ``revenue_change``
    (against the calendar period before, which is 0 when it had no sales; null
    for the first period) and ``revenue_change_pct`` (null where the period
    before is 0). Only periods with sales have a row.
    """
    daily, tasks = _daily(sales, "sku_id")
    days = daily.select("sku_id", *[_start(p, F.col("day")).alias(p) for p in PERIODS],
                        "quantity", "revenue", "n_sales").repartition(tasks, "sku_id")
    sums = [exact_sum(F.col("quantity")).alias("quantity"), exact_sum(F.col("revenue")).alias("revenue"),
            F.sum("n_sales").alias("n_sales")]
    rows = None
    for p in PERIODS:
        for keys in ([], ["sku_id"]):
            sku = F.col("sku_id") if keys else F.lit(None).cast(days.schema["sku_id"].dataType).alias("sku_id")
            # A day of a SKU is one row as it is.
            part = (days.select("sku_id", F.col(p).alias("start"), "quantity", "revenue", "n_sales")
                    if keys and p == "day" else days.groupBy(*keys, F.col(p).alias("start")).agg(*sums))
            w = Window.partitionBy(*keys).orderBy("start")
            before = F.when(F.lag("start").over(w) == _start_before(p, F.col("start")), F.lag("revenue").over(w))
            before = F.when(F.lag("start").over(w).isNotNull(), F.coalesce(before, F.lit(0.0)))
            part = part.select(F.lit(p).alias("period"), "start", F.lit(not keys).alias("all_skus"), sku,
                               "quantity", "revenue", "n_sales", before.alias("_before"))
            rows = part if rows is None else rows.unionByName(part)
    return rows.select(
        "period", "start", "all_skus", "sku_id", "quantity", "revenue", "n_sales",
        (F.col("revenue") - F.col("_before")).alias("revenue_change"),
        ((F.col("revenue") - F.col("_before")) / F.nullif(F.col("_before"), F.lit(0.0)) * F.lit(100.0))
        .alias("revenue_change_pct"))


def price_statistics(sales: DataFrame) -> DataFrame:
    """Per SKU: ``n_prices, min_price, max_price, mean_price, stddev_price`` (sample).

    Prices count at six decimals; null, NaN and infinite ones and those of 10^11 and more are
    left out, and a SKU with none has no row. One price has no deviation (null).

    Equal prices are counted first. Deviations are taken from the SKU's mean
    rounded to six decimals; their squares are summed as decimals, whole and
    fractional parts apart, so nothing cancels or rounds and the result does not depend on
    the order of rows.
    """
    price = F.col("unit_price").try_cast(PRICE_TYPE)
    counted = sales.select("sku_id", price.alias("price")).where("price is not null") \
        .groupBy("sku_id", "price").agg(F.count(F.lit(1)).cast("decimal(12,0)").alias("n"))
    means = counted.groupBy(F.col("sku_id").alias("_sku")).agg(
        F.sum("n").cast("bigint").alias("n_prices"), F.min("price").alias("low"), F.max("price").alias("high"),
        F.sum(F.col("price") * F.col("n")).cast("double").alias("total"))
    means = means.withColumn("mean", F.col("total") / F.col("n_prices")) \
        .withColumn("about", F.col("mean").cast(PRICE_TYPE))
    apart = counted.join(means, F.col("sku_id").eqNullSafe(F.col("_sku"))).withColumn(
        "d", (F.col("price") - F.col("about")).cast(APART_TYPE)).withColumn("square", F.col("d") * F.col("d"))
    whole = F.floor("square").cast("decimal(25,0)")
    part = (F.col("square") - whole).cast("decimal(13,12)")
    sums = apart.groupBy("sku_id", "n_prices", "low", "high", "mean").agg(
        F.sum(F.col("d") * F.col("n")).cast("double").alias("off"),
        F.sum(whole * F.col("n")).alias("whole"), F.sum(part * F.col("n")).alias("part"))
    # One number where it fits in one, as it nearly always does.
    squares = F.coalesce((F.col("whole").try_cast("decimal(24,0)") + F.col("part").try_cast("decimal(37,12)")).cast("double"),
                         F.col("whole").cast("double") + F.col("part").cast("double"))
    spread = F.greatest(squares - F.col("off") * F.col("off") / F.col("n_prices"), F.lit(0.0))
    return sums.select("sku_id", "n_prices", F.col("low").cast("double").alias("min_price"),
                       F.col("high").cast("double").alias("max_price"), F.col("mean").alias("mean_price"),
                       F.when(F.col("n_prices") > 1, F.sqrt(spread / (F.col("n_prices") - 1))).alias("stddev_price"))
