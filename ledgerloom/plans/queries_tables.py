"""What is written is read back: the sales table, the registry; zones and page bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import timeutil as T
from ledgerloom.operators import sales as S
from ledgerloom.operators import uploads as U
from ledgerloom.plans.catalog import query
from ledgerloom.plans.queries_sales import UPLOAD, _state_sql
from ledgerloom.session import staging_path
from ledgerloom.sources import fixtures as X
from ledgerloom.sources import registry as R
from ledgerloom.sources.sales_table import read_sales, write_sales

CREATED = "2024-06-01"


@query("sales_table", X.with_views(
    f"select id, upload_id, date, sku_id, sales_quantity, sales_revenue, stock_level, category, unit_price, "
    f"timestamp '{CREATED} 00:00:00' as created_at, case when upload_id = '{UPLOAD}' then "
    f"(select count(*) from sales where upload_id = '{UPLOAD}') end as rows_replaced from sales", "sales"))
def q_sales_table(spark, sf):
    """All uploads loaded, one of them again: its rows are replaced, not doubled."""
    sales = X.sales(spark, sf)
    path = staging_path(spark, f"sales-{uuid.uuid4().hex}")
    write_sales(sales, path, as_of=CREATED)
    again = write_sales(sales.where(F.col("upload_id") == UPLOAD), path, as_of=CREATED)
    return read_sales(spark, path).withColumn(
        "rows_replaced", F.when(F.col("upload_id") == UPLOAD, F.lit(again).cast("bigint")))


@query("registry_written", _state_sql(
    "select upload_id, status, uploaded_at, processed_at, error_message, upload_id || '.csv' as filename, "
    "'order_date=date,' || upload_id || '=sku_id' as mapping from state"))
def q_registry_written(spark, sf):
    """Events appended to a registry, a mapping saved for every upload, and the state read back."""
    path = staging_path(spark, f"registry-{uuid.uuid4().hex}")
    rows = X.upload_events(spark, sf).collect()              # a few per upload
    events = [R.event(r.upload_id, r.status, r.event_ts, error_message=r.error_message,
                      filename=f"{r.upload_id}.csv" if r.status == "uploaded" else None) for r in rows]
    events += [R.event(u, None, column_mapping={"order_date": "date", u: "sku_id"})
               for u in sorted({r.upload_id for r in rows})]
    R.append_events(spark, path, events)
    mapping = F.array_join(F.transform(F.array_sort(F.map_entries("column_mapping")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])), ",")
    pairs = F.when(F.col("upload_id") < "order_date", F.array_join(F.reverse(F.split(mapping, ",")), ",")).otherwise(mapping)
    return U.latest_state(R.read_events(spark, path)).select(
        "upload_id", "status", "uploaded_at", "processed_at", "error_message", "filename", pairs.alias("mapping"))


@query("zones", "select event_id, ts as wall_utc, (ts at time zone 'UTC') at time zone 'America/New_York' as wall_new_york, "
       "epoch_us(ts) as micros from events")
def q_zones(spark, sf):
    """Naive UTC clocks as instants, and instants as another zone's wall clock."""
    events = X.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    at = T.ensure_utc(F.col("ts"))
    return events.select("event_id", T.make_naive(at).alias("wall_utc"),
                         T.make_naive(at, "America/New_York").alias("wall_new_york"), F.unix_micros(at).alias("micros"))


@query("page_bounds", "select o_orderkey, o_orderkey % 7 - 3 as skip, o_custkey % 1200 - 99 as \"limit\", "
       "o_orderkey % 7 >= 3 and o_custkey % 1200 between 100 and 1099 as allowed from orders")
def q_page_bounds(spark, sf):
    """Page requests from order numbers, by the bounds of a page."""
    asked = X.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 7 - 3).alias("skip"), (F.col("o_custkey") % 1200 - 99).alias("limit"))
    return asked.withColumn("allowed", S.page_allowed(F.col("skip"), F.col("limit")))
