"""Stage 0-1: sales list / lookup / summary and upload registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import sales as S
from ledgerloom.operators import uploads as U
from ledgerloom.plans.catalog import query
from ledgerloom.sources import fixtures as X

# Literals shared by the Spark queries and the oracle SQL.
UPLOAD = "U3"
SKU = "SKU42"
SKIP = 10
LIMIT = 1000
EXTRA_UPLOAD = "U99"

# ---------------------------------------------------------------------------
# Stage 0-1: sales and upload queries
# ---------------------------------------------------------------------------

_ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S')"
_SALE_COLS = ("id, upload_id, " + _ISO.format(c="date") + " as date, sku_id, sales_quantity, "
              "sales_revenue, stock_level, category, unit_price")
_SUMMARY_SQL = """count(*) as total_records,
 coalesce(cast(sum(cast(sales_quantity as decimal(38,4))) as double), 0.0) as total_quantity,
 coalesce(cast(sum(cast(sales_revenue as decimal(38,4))) as double), 0.0) as total_revenue,
 coalesce(cast(sum(cast(sales_quantity as decimal(38,4))) as double) / count(sales_quantity), 0.0) as average_quantity,
 coalesce(cast(sum(cast(sales_revenue as decimal(38,4))) as double) / count(sales_revenue), 0.0) as average_revenue,
 count(distinct sku_id) as unique_skus, min(date) as start_date, max(date) as end_date"""


@query("sales_summary", X.with_views(f"select upload_id, {_SUMMARY_SQL} from sales group by upload_id", "sales"))
def q_sales_summary(spark, sf):
    return S.sales_summary(X.sales(spark, sf))


@query("count_sales", X.with_views(
    f"select count(*) as total from sales where upload_id = '{UPLOAD}'", "sales"))
def q_count_sales(spark, sf):
    return S.count_sales(X.sales(spark, sf), upload_id=UPLOAD)


@query("list_sales", X.with_views(
    f"select {_SALE_COLS} from sales where upload_id = '{UPLOAD}' "
    f"order by sales.date desc, id asc limit {LIMIT} offset {SKIP}", "sales"))
def q_list_sales(spark, sf):
    return S.list_sales(X.sales(spark, sf), upload_id=UPLOAD, skip=SKIP, limit=LIMIT)


@query("list_sales_by_sku", X.with_views(
    f"select {_SALE_COLS} from sales where upload_id = '{UPLOAD}' and sku_id = '{SKU}' "
    f"order by sales.date desc, id asc limit 100", "sales"))
def q_list_sales_by_sku(spark, sf):
    return S.list_sales(X.sales(spark, sf), upload_id=UPLOAD, sku_id=SKU)


# The newest sale of an upload, so there is one at every size.
@query("get_sale", X.with_views(
    f"select {_SALE_COLS} from sales where upload_id = '{UPLOAD}' and id = (select arg_min(id, "
    f"(-epoch_us(date), id)) from sales where upload_id = '{UPLOAD}')", "sales"))
def q_get_sale(spark, sf):
    sales = X.sales(spark, sf).filter(S.sales_filter(UPLOAD))
    newest = S.list_sales(sales, limit=1).first()
    return S.get_sale(sales, newest["id"])


@query("list_sales_after", X.with_views(
    f"select {_SALE_COLS} from sales where upload_id = '{UPLOAD}' "
    f"order by sales.date desc, id asc limit 100 offset 100", "sales"))
def q_list_sales_after(spark, sf):
    """The second page, reached by the last row of the first."""
    sales = X.sales(spark, sf)
    last = S.list_sales(sales, upload_id=UPLOAD).collect()      # a page: at most 100 rows
    if len(last) < 100:
        return S.list_sales(sales, upload_id=UPLOAD, skip=100)
    return S.list_sales(sales, upload_id=UPLOAD, after=(last[-1]["date"], last[-1]["id"]))


@query("page_counts", X.with_views(
    "select upload_id, count(*) as total, (count(*) + 99) // 100 as pages from sales group by 1", "sales"))
def q_page_counts(spark, sf):
    return S.page_counts(X.sales(spark, sf))


@query("sales_by_upload", X.with_views(
    "select id, " + _ISO.format(c="date") + " as date, sku_id, sales_quantity, sales_revenue, "
    f"stock_level, category, unit_price from sales where upload_id = '{UPLOAD}' "
    f"order by sales.date desc, id asc limit {LIMIT} offset {SKIP}", "sales"))
def q_sales_by_upload(spark, sf):
    return S.sales_by_upload(X.sales(spark, sf), UPLOAD, skip=SKIP, limit=LIMIT)


_STATE_SQL = """select upload_id,
  arg_max(status, (event_ts, seq)) filter (where status is not null) as status,
  min(case when status = 'uploaded' then event_ts end) as uploaded_at,
  max(case when status = 'processed' then event_ts end) as processed_at,
  max(event_ts) as last_event_ts,
  arg_max(error_message, (event_ts, seq)) filter (where error_message is not null) as error_message
 from upload_events group by upload_id"""
_COUNTS_SQL = "select upload_id, count(*) as row_count from sales group by upload_id"
_SUMMARY_BY_UPLOAD_SQL = f"select upload_id, {_SUMMARY_SQL} from sales group by upload_id"


def _state_sql(body: str, *views: str, extra_upload: str | None = None,
               ctes: list[tuple[str, str]] | None = None) -> str:
    return X.with_views(body, "upload_events", *views, extra_upload=extra_upload,
                        ctes=[("state", _STATE_SQL)] + list(ctes or []))


def _state(spark, sf, extra_upload=None):
    return U.latest_state(X.upload_events(spark, sf, extra_upload=extra_upload))


@query("upload_latest_state", _state_sql(
    "select upload_id, status, uploaded_at, processed_at, last_event_ts, error_message from state"))
def q_upload_latest_state(spark, sf):
    return _state(spark, sf)


@query("list_uploads", _state_sql(
    "select s.upload_id, status, coalesce(row_count, 0) as row_count, uploaded_at, processed_at "
    "from state s left join counts c on s.upload_id = c.upload_id "
    "order by uploaded_at desc, s.upload_id asc limit 10", "sales", ctes=[("counts", _COUNTS_SQL)]))
def q_list_uploads(spark, sf):
    sales = X.sales(spark, sf)
    return U.list_uploads(_state(spark, sf), sales=sales)


@query("upload_pages", _state_sql("select count(*) as total, (count(*) + 9) // 10 as pages from state",
                                  extra_upload=EXTRA_UPLOAD))
def q_upload_pages(spark, sf):
    return U.upload_pages(_state(spark, sf, EXTRA_UPLOAD))


@query("upload_status", _state_sql(
    "select s.upload_id, status, coalesce(row_count, 0) as row_count, uploaded_at "
    "from state s left join counts c on s.upload_id = c.upload_id where s.upload_id = 'U4'",
    "sales", ctes=[("counts", _COUNTS_SQL)]))
def q_upload_status(spark, sf):
    sales = X.sales(spark, sf)
    return U.upload_status(U.with_row_counts(_state(spark, sf), sales), "U4")


@query("uploads_to_process", _state_sql(
    "select upload_id, status from state where upload_id not in "
    "(select upload_id from state where status = 'processed')"))
def q_uploads_to_process(spark, sf):
    events = X.upload_events(spark, sf)
    return U.uploads_to_process(U.latest_state(events), events.select("upload_id"))


@query("uploads_without_sales", _state_sql(
    "select upload_id, status, uploaded_at, processed_at, last_event_ts, error_message from state "
    "where upload_id not in (select upload_id from sales)", "sales", extra_upload=EXTRA_UPLOAD))
def q_uploads_without_sales(spark, sf):
    return U.uploads_without_sales(_state(spark, sf, EXTRA_UPLOAD), X.sales(spark, sf))


@query("upload_detail", _state_sql(
    "select s.upload_id, status, uploaded_at, processed_at, last_event_ts, error_message, "
    "coalesce(total_records, 0) as total_records, coalesce(total_quantity, 0.0) as total_quantity, "
    "coalesce(total_revenue, 0.0) as total_revenue, coalesce(average_quantity, 0.0) as average_quantity, "
    "coalesce(average_revenue, 0.0) as average_revenue, coalesce(unique_skus, 0) as unique_skus, "
    "start_date, end_date, case when coalesce(total_records, 0) = 0 "
    f"then '{U.NO_SALES_MESSAGE}' end as message "
    "from state s left join summary m on s.upload_id = m.upload_id",
    "sales", extra_upload=EXTRA_UPLOAD, ctes=[("summary", _SUMMARY_BY_UPLOAD_SQL)]))
def q_upload_detail(spark, sf):
    return U.upload_detail(_state(spark, sf, EXTRA_UPLOAD), X.sales(spark, sf))


# Amounts with four decimals: price after discount.
@query("sales_summary_fine", "select 'U' || (l_suppkey % 10) as upload_id, count(*) as total_records, "
       "cast(sum(cast(round(l_extendedprice * (1 - l_discount), 4) as decimal(18,4))) as double) as total_revenue, "
       "cast(sum(cast(round(l_extendedprice * (1 - l_discount), 4) as decimal(18,4))) as double) / count(*) "
       "as average_revenue from lineitem group by 1")
def q_sales_summary_fine(spark, sf):
    fine = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    rows = X.table(spark, sf, "lineitem").select(
        F.concat(F.lit("U"), (F.col("l_suppkey") % 10).cast("string")).alias("upload_id"),
        F.concat(F.lit("SKU"), F.col("l_partkey").cast("string")).alias("sku_id"),
        F.col("l_quantity").alias("sales_quantity"), fine.alias("sales_revenue"),
        F.col("l_shipdate").alias("date"))
    return S.sales_summary(rows).select("upload_id", "total_records", "total_revenue",
                                        "average_revenue")


# Registry attributes that events carry: set on arrival, the row count when processed.
@query("upload_payload", _state_sql(
    "select s.upload_id, s.upload_id || '.csv' as filename, status, cast(9 as bigint) as column_count, "
    "case when status = 'processed' then cast(length(s.upload_id) * 100 as bigint) end as row_count, "
    "uploaded_at, processed_at from state s order by uploaded_at desc, s.upload_id asc limit 10"))
def q_upload_payload(spark, sf):
    first, processed = F.col("seq") == 1, F.col("status") == "processed"
    events = X.upload_events(spark, sf).withColumns({
        "filename": F.when(first, F.concat("upload_id", F.lit(".csv"))),
        "column_count": F.when(first, F.lit(9).cast("bigint")),
        "row_count": F.when(processed, (F.length("upload_id") * 100).cast("bigint"))})
    return U.list_uploads(U.latest_state(events))


@query("list_sales_created", X.with_views(
    f"select {_SALE_COLS}, strftime(sales.date + interval 93784500 milliseconds, '%Y-%m-%dT%H:%M:%S.%f') "
    f"as created_at from sales where upload_id = '{UPLOAD}' order by sales.date desc, id asc limit 100", "sales"))
def q_list_sales_created(spark, sf):
    created = F.timestamp_add("MICROSECOND", F.lit(93_784_500_000), F.col("date"))
    return S.list_sales(X.sales(spark, sf).withColumn("created_at", created), upload_id=UPLOAD)
