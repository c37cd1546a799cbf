"""Upload registry queries: current state, listing, guards and joins with sales.

The registry is an append-only event log (see ``sources.registry``). The
current state of an upload folds its events: the status of the newest
event, and for every other attribute the newest non-null value. That fold is
one ``groupBy(upload_id)`` with ``max_by`` aggregates: a partial aggregate per
task (over rows sorted by upload, as the values are text) plus a final one, so
an upload with many events never sits whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.constants import (
    STATUS_PROCESSED,
    STATUS_UPLOADED,
    UPLOADS_PAGE_DEFAULT,
)
from ledgerloom.operators.sales import check_page, summary_aggregates

# Attributes carried from the newest event that sets them.
STATE_ATTRIBUTES = ["filename", "file_path", "file_size_bytes", "row_count", "column_count",
                    "detected_schema", "validation_report", "column_mapping", "error_message"]

NO_SALES_MESSAGE = "No sales data found for this upload"


def _event_order() -> Column:
    return F.struct(F.col("event_ts"), F.col("seq"))


def latest_state(events: DataFrame) -> DataFrame:
    """One row per upload: current status, timestamps and latest attributes."""
    order = _event_order()
    aggs = [
        # Mapping events carry no status, so only status-bearing events count.
        F.max_by(F.col("status"), F.when(F.col("status").isNotNull(), order)).alias("status"),
        F.min(F.when(F.col("status") == STATUS_UPLOADED, F.col("event_ts"))).alias("uploaded_at"),
        F.max(F.when(F.col("status") == STATUS_PROCESSED, F.col("event_ts"))).alias("processed_at"),
        F.max("event_ts").alias("last_event_ts"),
    ]
    for attr in STATE_ATTRIBUTES:
        if attr in events.columns:
            aggs.append(F.max_by(F.col(attr), F.when(F.col(attr).isNotNull(), order)).alias(attr))
    return events.groupBy("upload_id").agg(*aggs)


def sales_counts(sales: DataFrame) -> DataFrame:
    """Rows per upload in the sales table (partial aggregate, one row per upload)."""
    return sales.groupBy("upload_id").agg(F.count(F.lit(1)).alias("row_count"))


def with_row_counts(state: DataFrame, sales: DataFrame) -> DataFrame:
    """Fill ``row_count`` from the sales table (0 when an upload has none)."""
    counts = sales_counts(sales)
    base = state.drop("row_count") if "row_count" in state.columns else state
    return (base.join(counts, "upload_id", "left")
                .withColumn("row_count", F.coalesce(F.col("row_count"), F.lit(0))))


def list_uploads(state: DataFrame, skip: int = 0, limit: int = UPLOADS_PAGE_DEFAULT,
                 sales: DataFrame | None = None) -> DataFrame:
    """Newest uploads first, without the detected schema.

    The page is taken first; with ``sales``, ``row_count`` is then counted for
    its uploads only.
    """
    check_page(skip, limit, max_limit=1 << 30)
    ordered = state.orderBy(F.col("uploaded_at").desc(), F.col("upload_id").asc())
    if skip:
        ordered = ordered.offset(skip)
    page = ordered.limit(limit)
    if sales is not None:
        on_page = F.broadcast(page.select("upload_id"))          # at most ``limit`` rows
        page = with_row_counts(page, sales.join(on_page, "upload_id", "left_semi"))
    cols = [c for c in ["upload_id", "filename", "status", "row_count", "column_count",
                        "uploaded_at", "processed_at", "validation_report"] if c in page.columns]
    return page.select(*cols)


def upload_pages(state: DataFrame, limit: int = UPLOADS_PAGE_DEFAULT) -> DataFrame:
    """One row: how many uploads there are and how many pages of ``limit``."""
    check_page(0, limit, max_limit=1 << 30)
    return state.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / F.lit(limit)).cast("bigint"))


def upload_status(state: DataFrame, upload_id: str) -> DataFrame:
    """One upload's status row; empty when the id is unknown."""
    cols = [c for c in ["upload_id", "filename", "status", "row_count", "detected_schema",
                        "validation_report", "uploaded_at"] if c in state.columns]
    return state.filter(F.col("upload_id") == F.lit(upload_id)).select(*cols)


def uploads_to_process(state: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested uploads that exist and are not yet processed.

    ``processing`` and ``error`` may be retried; ``processed`` may not.
    ``requested`` has one column ``upload_id``.
    """
    processed = state.filter(F.col("status") == STATUS_PROCESSED).select("upload_id")
    known = state.select("upload_id", "status")
    return (requested.select("upload_id").distinct()
            .join(processed, "upload_id", "left_anti")
            .join(known, "upload_id", "inner"))


def uploads_without_sales(state: DataFrame, sales: DataFrame) -> DataFrame:
    """Registered uploads that have no sales rows.

    The sales side is first reduced to its distinct upload ids (a partial
    aggregate per task), so the anti join compares two small relations
    instead of shuffling the sales table.
    """
    present = sales.select("upload_id").distinct()
    return state.join(present, "upload_id", "left_anti")


def upload_detail(state: DataFrame, sales: DataFrame) -> DataFrame:
    """Upload state joined with its sales summary; empty uploads get a message."""
    summary = sales.groupBy("upload_id").agg(*summary_aggregates())
    detail = state.join(summary, "upload_id", "left")
    zero = F.coalesce(F.col("total_records"), F.lit(0)).alias("total_records")
    fills = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in
             ["total_quantity", "total_revenue", "average_quantity", "average_revenue"]}
    return (detail.withColumns(fills)
                  .withColumn("unique_skus", F.coalesce(F.col("unique_skus"), F.lit(0)))
                  .withColumn("total_records", zero)
                  .withColumn("message", F.when(F.col("total_records") == 0, F.lit(NO_SALES_MESSAGE))))
