"""List, lookup, count and summary queries over the conformed sales table.

The table is expected partitioned by ``upload_id`` on disk, so the equality
filters below prune whole partitions and the ``sku_id`` filter reaches the
Parquet reader as a pushed predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ledgerloom.functions.constants import SALES_PAGE_DEFAULT, SALES_PAGE_MAX
from ledgerloom.functions.timeutil import isoformat

# Money and quantities are summed as fixed-point decimals with ten places: the
# total is then independent of how rows are split across tasks, which a double
# sum is not, and small amounts keep their digits. Values that no such decimal
# holds (infinities, NaN, beyond 10^28) are summed as doubles beside it.
SUM_TYPE = "decimal(38,10)"


def exact_sum(c: Column, over: WindowSpec | None = None) -> Column:
    """The sum of a DOUBLE column as DOUBLE, of a group or ``over`` a window; null
    when it has no value."""
    def total(aggregate: Column) -> Column:
        return aggregate if over is None else aggregate.over(over)

    exact = c.try_cast(SUM_TYPE)
    rest = total(F.sum(F.when(exact.isNull(), c)))
    return F.when(total(F.count(c)) > 0, F.coalesce(total(F.try_sum(exact)).cast("double"), F.lit(0.0))
                  + F.coalesce(rest, F.lit(0.0)))


def check_page(skip: int, limit: int, max_limit: int = SALES_PAGE_MAX) -> None:
    """Reject a page request outside ``skip >= 0`` and ``1 <= limit <= max_limit``."""
    if skip < 0:
        raise ValueError(f"skip must be >= 0, got {skip}")
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be between 1 and {max_limit}, got {limit}")


def page_allowed(skip: Column, limit: Column, max_limit: int = SALES_PAGE_MAX) -> Column:
    """``check_page`` over columns, for tables of requests."""
    return (skip >= 0) & limit.between(1, max_limit)


def sales_filter(upload_id: str | None = None, sku_id: str | None = None) -> Column:
    """Optional equality filters, ANDed; ``None`` or empty text means no filter."""
    cond = F.lit(True)
    if upload_id:
        cond = cond & (F.col("upload_id") == F.lit(upload_id))
    if sku_id:
        cond = cond & (F.col("sku_id") == F.lit(sku_id))
    return cond


def count_sales(sales: DataFrame, upload_id: str | None = None,
                sku_id: str | None = None) -> DataFrame:
    """Rows matching the filters, ignoring paging: one row ``total``."""
    return sales.filter(sales_filter(upload_id, sku_id)).agg(F.count(F.lit(1)).alias("total"))


def _page(df: DataFrame, skip: int, limit: int) -> DataFrame:
    # Newest first; ``id`` breaks ties so every page is deterministic. Sort +
    # offset + limit plans as a per-task top-(skip+limit) and one small merge.
    ordered = df.orderBy(F.col("date").desc(), F.col("id").asc())
    if skip:
        ordered = ordered.offset(skip)
    return ordered.limit(limit)


def _sale_columns(df: DataFrame, with_upload: bool) -> list[Column]:
    cols = [F.col("id")]
    if with_upload:
        cols.append(F.col("upload_id"))
    cols += [isoformat(F.col("date")).alias("date"), F.col("sku_id"), F.col("sales_quantity"),
             F.col("sales_revenue"), F.col("stock_level"), F.col("category"), F.col("unit_price")]
    if with_upload and "created_at" in df.columns:
        cols.append(isoformat(F.col("created_at")).alias("created_at"))
    return cols


def list_sales(sales: DataFrame, upload_id: str | None = None, sku_id: str | None = None,
               skip: int = 0, limit: int = SALES_PAGE_DEFAULT, after=None) -> DataFrame:
    """One page of sales, newest first, dates as ISO text.

    ``skip`` keeps skip + limit rows per task; to go deep, pass the last row
    of the page before as ``after=(date, id)`` instead, which costs the same on
    every page.
    """
    check_page(skip, limit)
    rows = sales.filter(sales_filter(upload_id, sku_id))
    if after is not None:
        date, last = F.lit(str(after[0])).cast("timestamp_ntz"), F.lit(after[1])
        rows = rows.filter((F.col("date") < date) | ((F.col("date") == date) & (F.col("id") > last)))
    page = _page(rows, skip, limit)
    return page.select(*_sale_columns(sales, with_upload=True))


def get_sale(sales: DataFrame, sale_id) -> DataFrame:
    """The sale with this id; an empty result means not found.

    Ids are ``<upload id>:<row>``; the upload prunes the scan to one partition.
    """
    match = F.col("id") == F.lit(sale_id)
    if ":" in str(sale_id):
        match = (F.col("upload_id") == F.lit(str(sale_id).rsplit(":", 1)[0])) & match
    return sales.filter(match).select(*_sale_columns(sales, with_upload=True))


def page_counts(sales: DataFrame, limit: int = SALES_PAGE_DEFAULT) -> DataFrame:
    """Per upload: its total and the number of pages of ``limit`` rows."""
    check_page(0, limit)
    return sales.groupBy("upload_id").agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / F.lit(limit)).cast("bigint"))


def sales_by_upload(sales: DataFrame, upload_id: str, skip: int = 0,
                    limit: int = SALES_PAGE_DEFAULT) -> DataFrame:
    """One page of one upload's sales, without ``upload_id`` and ``created_at``."""
    check_page(skip, limit)
    page = _page(sales.filter(sales_filter(upload_id)), skip, limit)
    return page.select(*_sale_columns(sales, with_upload=False))


def summary_aggregates() -> list[Column]:
    """Count, totals, averages, distinct SKUs and date range in one pass."""
    total_q, total_r = exact_sum(F.col("sales_quantity")), exact_sum(F.col("sales_revenue"))
    return [
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(total_q, F.lit(0.0)).alias("total_quantity"),
        F.coalesce(total_r, F.lit(0.0)).alias("total_revenue"),
        F.coalesce(total_q / F.count("sales_quantity"), F.lit(0.0)).alias("average_quantity"),
        F.coalesce(total_r / F.count("sales_revenue"), F.lit(0.0)).alias("average_revenue"),
        F.count_distinct("sku_id").alias("unique_skus"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
    ]


def sales_summary(sales: DataFrame, upload_id: str | None = None) -> DataFrame:
    """Summary per upload; with ``upload_id`` only that upload's partition is read.

    Plans as a partial aggregate per task, one shuffle on ``upload_id`` and a
    final aggregate; the distinct SKU count adds a partial-aggregated
    (upload_id, sku_id) stage, so a hot upload never lands whole in one task.
    """
    return sales.filter(sales_filter(upload_id)).groupBy("upload_id").agg(*summary_aggregates())
