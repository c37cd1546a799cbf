"""Trends, lags, rolling averages, price statistics, outliers, duplicates, sketches,
the CSV export and the JSON edge."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import jsonedge as J
from ledgerloom.operators import anomalies as A
from ledgerloom.operators import profiling as P
from ledgerloom.operators import sketches as K
from ledgerloom.operators import trends as T
from ledgerloom.plans.catalog import query
from ledgerloom.plans.queries_profile import _SAMPLES_SQL, _profile_query, _schema
from ledgerloom.session import staging_path
from ledgerloom.sources import export as E
from ledgerloom.sources import fixtures as X
from ledgerloom.sources.files import read_csv
from ledgerloom.sources.registry import SCHEMA_TYPE

_DAILY = ("daily", """select sku_id, cast(date as date) as day,
 cast(sum(cast(sales_quantity as decimal(38,4))) as double) as quantity,
 cast(sum(cast(sales_revenue as decimal(38,4))) as double) as revenue, count(*) as n_sales
 from sales group by 1, 2""")


def _rolling_sql(c: str, n: int) -> str:
    return (f"cast(sum(cast({c} as decimal(38,4))) over (partition by sku_id order by day range between "
            f"interval {n - 1} days preceding and current row) as double) / "
            f"least({n}, date_diff('day', min(day) over (partition by sku_id), day) + 1) as {c}_{n}d")


@query("rolling_averages", X.with_views(
    "select sku_id, day, quantity, revenue, n_sales, " + ", ".join(
        _rolling_sql(c, n) for n in (7, 30) for c in ("quantity", "revenue")) + " from daily", "sales", ctes=[_DAILY]))
def q_rolling_averages(spark, sf):
    return T.rolling_averages(X.sales(spark, sf))


def _lags_sql(key: str, rows: str) -> str:
    lags = ", ".join(f"case when c.day - {n} >= f.first then coalesce(d{n}.{c}, 0.0) end as {c}_lag_{n}"
                     for n in (7, 30) for c in ("quantity", "revenue"))
    joins = " ".join(f"left join daily d{n} on d{n}.{key} = c.{key} and d{n}.day = c.day - {n}" for n in (0, 7, 30))
    return (f"select c.{key}, c.day, coalesce(d0.quantity, 0.0) as quantity, coalesce(d0.revenue, 0.0) as revenue, {lags} "
            f"from {rows} c join spans f on f.{key} = c.{key} {joins}")


def _span_ctes(key: str) -> list[tuple[str, str]]:
    return [("daily", _DAILY[1].replace("sku_id", key)),
            ("spans", f"select {key}, min(day) as first, max(day) as last from daily group by 1"),
            ("calendar", f"select {key}, first + cast(unnest(range(date_diff('day', first, last) + 1)) as integer) as day "
                         "from spans")]


@query("lagged_sales", X.with_views(_lags_sql("sku_id", "daily"), "sales", ctes=_span_ctes("sku_id")))
def q_lagged_sales(spark, sf):
    """Per SKU, on its days with sales."""
    return T.lagged_sales(X.sales(spark, sf), dense=False)


@query("lagged_calendar", X.with_views(_lags_sql("category", "calendar"), "sales", ctes=_span_ctes("category")))
def q_lagged_calendar(spark, sf):
    """Per category, on every calendar day."""
    return T.lagged_sales(X.sales(spark, sf), key="category")


def _trend_sql(period: str, days_before: str, of_sku: bool) -> str:
    start = "day" if period == "day" else f"cast(date_trunc('{period}', day) as date)"
    sku = "sku_id" if of_sku else "cast(null as varchar)"
    over = f"over (partition by {sku} order by start)"
    base = (f"case when lag(start) {over} is null then null when lag(start) {over} = {days_before} "
            f"then lag(revenue) {over} else 0.0 end")
    return (f"select '{period}' as period, start, {'false' if of_sku else 'true'} as all_skus, sku_id, quantity, revenue, "
            f"n_sales, revenue - ({base}) as revenue_change, "
            f"(revenue - ({base})) / nullif({base}, 0.0) * 100.0 as revenue_change_pct from "
            f"(select {start} as start, {sku} as sku_id, cast(sum(cast(quantity as decimal(38,4))) as double) as quantity, "
            "cast(sum(cast(revenue as decimal(38,4))) as double) as revenue, cast(sum(n_sales) as bigint) as n_sales "
            "from daily group by 1, 2)")


@query("sales_trend", X.with_views("\nunion all\n".join(
    _trend_sql(p, before, sku) for p, before in (("day", "start - 1"), ("week", "start - 7"),
                                                 ("month", "cast(start - interval 1 month as date)"))
    for sku in (False, True)), "sales", ctes=[_DAILY]))
def q_sales_trend(spark, sf):
    return T.sales_trend(X.sales(spark, sf))


@query("price_statistics", X.with_views(
    """select sku_id, n_prices, min_price, max_price, mean_price, case when n_prices > 1
 then sqrt(greatest(squares - off * off / n_prices, 0.0) / (n_prices - 1)) end as stddev_price
 from (select sku_id, n_prices, cast(min(p) as double) as min_price, cast(max(p) as double) as max_price, mean_price,
  cast(sum(p - about) as double) as off, cast(sum(cast((p - about) * (p - about) as decimal(38,12))) as double) as squares
  from sold join (select sku_id, count(*) as n_prices, cast(sum(p) as double) / count(*) as mean_price,
   cast(cast(sum(p) as double) / count(*) as decimal(19,6)) as about from sold group by 1) m using (sku_id)
  group by sku_id, n_prices, mean_price)""", ctes=[("sold",
    "select concat('SKU', cast(l_partkey as varchar)) as sku_id, cast(round(l_extendedprice * (1 - l_discount), 4) "
    "as decimal(19,6)) as p from lineitem")]))
def q_price_statistics(spark, sf):
    """Prices after discount."""
    sold = X.fact_table(spark, sf, "lineitem", ["l_partkey", "l_extendedprice", "l_discount"]).select(
        F.concat(F.lit("SKU"), F.col("l_partkey").cast("string")).alias("sku_id"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("unit_price"))
    return T.price_statistics(sold)


@query("flag_outliers", X.with_views(
    """select id, s.sku_id, sales_quantity, q1 - 1.5 * (q3 - q1) as low_fence, q3 + 1.5 * (q3 - q1) as high_fence,
 sales_quantity < q1 - 1.5 * (q3 - q1) or sales_quantity > q3 + 1.5 * (q3 - q1) as outlier from sales s join (
  select sku_id, quantile_cont(sales_quantity, 0.25) as q1, quantile_cont(sales_quantity, 0.75) as q3
  from sales group by 1) q on q.sku_id = s.sku_id""", "sales"))
def q_flag_outliers(spark, sf):
    return A.flag_outliers(X.sales(spark, sf)).select("id", "sku_id", "sales_quantity", "low_fence", "high_fence", "outlier")


# Sales of one upload with the same SKU and quantity, in the order of a number from the row's hash.
@query("duplicate_rows", X.with_views(
    """select seq, upload_id, sku_id, sales_quantity, count(*) over w as copies, row_number() over (w order by seq) as occurrence,
 min(seq) over w as first_row from (select *, cast('0x' || substring(id, 1, 15) as bigint) as seq from sales)
 window w as (partition by upload_id, sku_id, sales_quantity)""", "sales"))
def q_duplicate_rows(spark, sf):
    rows = X.sales(spark, sf).select(F.conv(F.substring("id", 1, 15), 16, 10).cast("bigint").alias("seq"),
                                     "upload_id", "sku_id", "sales_quantity")
    return A.duplicate_rows(rows, "seq")


# The estimate itself has no SQL; that it is within four standard errors of the exact number has.
_ODD = ["U1", "U3", "U5", "U7", "U9"]


@query("approx_distinct_skus", X.with_views(
    "select 'all' as uploads, count(distinct sku_id) as exact_skus, true as close from sales union all "
    "select 'odd', count(distinct sku_id), true from sales where upload_id in ('U1', 'U3', 'U5', 'U7', 'U9') union all "
    "select upload_id, count(distinct sku_id), true from sales group by upload_id", "sales"))
def q_approx_distinct_skus(spark, sf):
    """Sketches stored per upload, read back and united over sets of uploads."""
    sales = X.sales(spark, sf)
    path = staging_path(spark, f"sketches-{uuid.uuid4().hex}")
    K.store_sketches(K.sku_sketches(sales), path)
    kept = K.read_sketches(spark, path)
    odd = F.col("upload_id").isin(_ODD)
    name = [("all", F.lit(True)), ("odd", odd)]
    estimates = K.distinct_skus(kept, by=["upload_id"]).withColumnRenamed("upload_id", "uploads")
    estimates = K.distinct_skus(kept).withColumn("uploads", F.lit("all")).unionByName(
        K.distinct_skus(kept, _ODD).withColumn("uploads", F.lit("odd"))).unionByName(estimates)
    exact = sales.select("sku_id", F.explode(F.array_compact(F.array(
        *[F.when(c, F.lit(n)) for n, c in name], F.col("upload_id")))).alias("u")).groupBy("u").agg(
        F.count_distinct("sku_id").alias("exact_skus"))
    error = F.abs(F.col("approx_skus") - F.col("exact_skus")) / F.col("exact_skus")
    return estimates.join(exact, F.col("uploads") == F.col("u")).select(
        "uploads", "exact_skus", (error <= F.lit(4 * 1.04 / 2 ** (K.LG_SIZE / 2))).alias("close"))


@query("csv_export", "select cast(doc_id as varchar) as doc_id, text, lang, source, cast(n_chars as varchar) as n_chars "
       "from documents")
def q_csv_export(spark, sf):
    """All documents written as CSV, in order, and read back by the library's reader."""
    path = staging_path(spark, f"export-{uuid.uuid4().hex}")
    E.export_csv(X.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path,
                 order=["doc_id"])
    return read_csv(spark, path, keep_empty=True)


@query("schema_json", _profile_query(
    "select l.column_name as name, detected_type, suggested_mapping, null_count, null_percentage, unique_count, "
    "coalesce(s.sample_text, '') as sample_text, false as unread from labels l left join "
    "(select ordinal, string_agg(sample_value, '|' order by sample_rank) as sample_text from samples "
    "group by ordinal) s on l.ordinal = s.ordinal", [("samples", _SAMPLES_SQL)]))
def q_schema_json(spark, sf):
    """The detected schema as a JSON document, and back."""
    schema = _schema(spark, sf, with_samples=True)
    text = J.to_json_text(P.schema_document(schema), ["detected_schema"])
    back = J.from_json_text(text, {"detected_schema": SCHEMA_TYPE})
    return back.select(F.inline("detected_schema.columns"), "detected_schema_unread").select(
        "name", "detected_type", "suggested_mapping", "null_count", "null_percentage", "unique_count",
        F.array_join("sample_values", "|").alias("sample_text"), F.col("detected_schema_unread").alias("unread"))
