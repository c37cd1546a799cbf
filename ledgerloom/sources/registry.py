"""The upload registry as an append-only Parquet event table.

Each state change is one event row; nothing is updated in place, so a
retried or concurrent writer never loses an earlier fact, and the current
state is a fold over events (``operators.uploads.latest_state``). Events lie in
``BUCKETS`` folders by a hash of the upload id, so reading one upload opens one
folder; ``append_events`` writes any number of events at once.
"""

from __future__ import annotations

import datetime as _dt
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.constants import (
    STATUS_ERROR,
    STATUS_PROCESSED,
    STATUS_PROCESSING,
    STATUS_UPLOADED,
)

BUCKET, BUCKETS = "bucket", 64

ISSUE_TYPE = T.StructType([
    T.StructField("severity", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("suggestion", T.StringType()),
])

REPORT_TYPE = T.StructType([
    T.StructField("is_valid", T.BooleanType()),
    T.StructField("total_issues", T.LongType()),
    T.StructField("errors", T.LongType()),
    T.StructField("warnings", T.LongType()),
    T.StructField("infos", T.LongType()),
    T.StructField("issues", T.ArrayType(ISSUE_TYPE)),
    T.StructField("summary", T.StringType()),
])

COLUMN_INFO_TYPE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("detected_type", T.StringType()),
    T.StructField("suggested_mapping", T.StringType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("null_percentage", T.DoubleType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
    T.StructField("coerced_count", T.LongType()),
])

SCHEMA_TYPE = T.StructType([
    T.StructField("columns", T.ArrayType(COLUMN_INFO_TYPE)),
    T.StructField("row_count", T.LongType()),
    T.StructField("column_count", T.LongType()),
    T.StructField("suggested_date_column", T.StringType()),
    T.StructField("suggested_sku_column", T.StringType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("upload_id", T.StringType(), False),
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("event_ts", T.TimestampNTZType(), False),
    T.StructField("status", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_size_bytes", T.LongType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("column_count", T.LongType()),
    T.StructField("detected_schema", SCHEMA_TYPE),
    T.StructField("validation_report", REPORT_TYPE),
    T.StructField("column_mapping", T.MapType(T.StringType(), T.StringType())),
    T.StructField("error_message", T.StringType()),
])

# Tie-break for events with the same timestamp: lifecycle order.
_SEQ = {STATUS_UPLOADED: 1, None: 2, STATUS_PROCESSING: 3, STATUS_PROCESSED: 4, STATUS_ERROR: 4}


def new_upload_id() -> str:
    return str(uuid.uuid4())


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def event(upload_id: str, status: str | None, event_ts: _dt.datetime | None = None, **attrs) -> dict:
    """One event as a row of the registry."""
    unknown = set(attrs) - set(EVENT_SCHEMA.fieldNames())
    if unknown:
        raise ValueError(f"unknown registry attributes: {sorted(unknown)}")
    row = dict.fromkeys(EVENT_SCHEMA.fieldNames())
    row.update(attrs)
    row.update(upload_id=upload_id, seq=_SEQ.get(status, 2), event_ts=event_ts or _now(),
               status=status)
    return row


def append_events(spark: SparkSession, registry_path: str, events: list[dict]) -> DataFrame | None:
    """Append event rows (see ``event``) in one write, and return them as a DataFrame."""
    if not events:
        return None
    df = spark.createDataFrame([tuple(e[f] for f in EVENT_SCHEMA.fieldNames()) for e in events],
                               EVENT_SCHEMA)
    df.withColumn(BUCKET, _bucket(F.col("upload_id"))).coalesce(1) \
        .write.mode("append").partitionBy(BUCKET).parquet(registry_path)
    return df


def _bucket(upload_id):
    return F.pmod(F.crc32(upload_id.cast("binary")), F.lit(BUCKETS)).cast("int")


def append_event(spark: SparkSession, registry_path: str, upload_id: str, status: str | None,
                 event_ts: _dt.datetime | None = None, **attrs) -> DataFrame:
    """Append one event row and return it as a DataFrame."""
    return append_events(spark, registry_path, [event(upload_id, status, event_ts, **attrs)])


def register_upload(spark: SparkSession, registry_path: str, upload_id: str, filename: str,
                    file_path: str, file_size_bytes: int | None = None,
                    row_count: int | None = None, column_count: int | None = None,
                    detected_schema: dict | None = None, validation_report: dict | None = None,
                    event_ts: _dt.datetime | None = None) -> DataFrame:
    """The ``uploaded`` event: file facts, profile and validation report."""
    return append_event(spark, registry_path, upload_id, STATUS_UPLOADED, event_ts,
                        filename=filename, file_path=file_path, file_size_bytes=file_size_bytes,
                        row_count=row_count, column_count=column_count,
                        detected_schema=detected_schema, validation_report=validation_report)


def record_status(spark: SparkSession, registry_path: str, upload_id: str, status: str,
                  error_message: str | None = None,
                  event_ts: _dt.datetime | None = None) -> DataFrame:
    """``processing``, ``processed`` or ``error`` (with its message)."""
    if status not in (STATUS_PROCESSING, STATUS_PROCESSED, STATUS_ERROR):
        raise ValueError(f"not a status change: {status}")
    return append_event(spark, registry_path, upload_id, status, event_ts,
                        error_message=error_message)


def save_mapping(spark: SparkSession, registry_path: str, upload_id: str,
                 mapping: dict[str, str], event_ts: _dt.datetime | None = None) -> DataFrame:
    """Record a column mapping (old name -> new name); status is unchanged."""
    return append_event(spark, registry_path, upload_id, None, event_ts,
                        column_mapping=dict(mapping))


def read_events(spark: SparkSession, registry_path: str, upload_id: str | None = None) -> DataFrame:
    """All events, or those of one upload (from its folder alone)."""
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField(BUCKET, T.IntegerType())])
    events = spark.read.schema(schema).parquet(registry_path)
    if upload_id is not None:
        # A number, not an expression: the folder is picked when the scan is planned.
        n = zlib.crc32(upload_id.encode()) % BUCKETS
        events = events.filter((F.col(BUCKET) == n) & (F.col("upload_id") == upload_id))
    return events.drop(BUCKET)
