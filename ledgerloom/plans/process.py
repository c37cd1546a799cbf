"""Clean an uploaded file and load it into the sales table.

The registry supplies the file path and saved column mapping; status events
``processing`` then ``processed`` (or ``error`` with the message) bracket
the load. The load replaces the upload's partition, so a retry after a
failure never leaves duplicate rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.constants import (
    CLEANED_PREVIEW_ROWS,
    STATUS_ERROR,
    STATUS_PROCESSED,
    STATUS_PROCESSING,
)
from ledgerloom.functions.text import clean_names
from ledgerloom.operators import cleaning as C
from ledgerloom.operators import profiling as P
from ledgerloom.operators.uploads import latest_state
from ledgerloom.sources import registry as R
from ledgerloom.sources.files import ROW_ID, read_file
from ledgerloom.sources.sales_table import write_sales


def upload_record(spark: SparkSession, registry_path: str, upload_id: str):
    """The current state of one upload (one row) or ``None``."""
    rows = latest_state(R.read_events(spark, registry_path, upload_id)).collect()
    return rows[0] if rows else None


def planned(spark: SparkSession, path: str) -> tuple[DataFrame, C.TypePlan]:
    """The file as text (staged once) and the types its columns take."""
    raw = read_file(spark, path, materialize=True)
    data = [c for c in raw.columns if c != ROW_ID]
    names = clean_names(data)
    renamed = raw.select(*[C.q(o).alias(n) for o, n in zip(data, names)], ROW_ID)
    return renamed, C.plan_types(renamed, names)


def cleaned_for_load(raw: DataFrame, plan: C.TypePlan, mapping: dict | None, as_of=None,
                     first: int | None = None) -> DataFrame:
    """Types and gaps -> saved mapping -> required columns; ``first`` rows only, if given."""
    cleaned = C.clean_dataframe(raw, as_of=as_of, keep=[ROW_ID], plan=plan,
                                first=(ROW_ID, first) if first else None)
    return C.conform_defaults(cleaned, mapping, as_of=as_of)


def process_upload(spark: SparkSession, registry_path: str, sales_path: str, upload_id: str,
                   as_of=None, record=None, events: list | None = None) -> dict:
    """Load one upload. With ``record`` (an object with ``status``, ``file_path``
    and ``column_mapping``) the registry is not read, and with ``events`` the status
    events are added to that list for a later ``registry.append_events``.
    The result also says what did not read as its column's
    type: ``coerced`` values per column (they were filled), and loaded rows
    without a date or quantity."""
    record = record or upload_record(spark, registry_path, upload_id)
    if record is None:
        raise ValueError(f"Upload {upload_id} not found")
    if record.status == STATUS_PROCESSED:
        raise ValueError(f"Upload {upload_id} already processed")

    def note(status, **attrs):
        if events is None:
            R.record_status(spark, registry_path, upload_id, status, **attrs)
        else:
            events.append(R.event(upload_id, status, **attrs))

    note(STATUS_PROCESSING)
    try:
        raw, plan = planned(spark, record.file_path)
        ready = cleaned_for_load(raw, plan, record.column_mapping, as_of)
        seen = Observation("conformed")
        # The id carries the upload (so a lookup reads one partition) and the row's place in the file.
        rows = C.conform_sales(ready.withColumn("_sale_id", F.concat_ws(
            ":", F.lit(upload_id), F.col(ROW_ID).cast("string"))), upload_id, id_col="_sale_id")
        rows = rows.observe(seen, F.count_if(F.col("date").isNull()).alias("date"),
                            F.count_if(F.col("sales_quantity").isNull()).alias("quantity"))
        n = write_sales(rows, sales_path, as_of=as_of)
    except Exception as e:
        note(STATUS_ERROR, error_message=str(e))
        raise
    note(STATUS_PROCESSED)
    return {"upload_id": upload_id, "status": STATUS_PROCESSED, "rows_processed": n,
            "rows_inserted": n, "coerced": {c: k for c, k in plan.coerced.items() if k},
            "rows_without_date": int(seen.get["date"]),
            "rows_without_quantity": int(seen.get["quantity"])}


def preview_processing(spark: SparkSession, registry_path: str, upload_id: str,
                       as_of=None) -> dict:
    """What the load would write: first 20 rows, total rows and the columns."""
    record = upload_record(spark, registry_path, upload_id)
    if record is None:
        raise ValueError(f"Upload {upload_id} not found")
    raw, plan = planned(spark, record.file_path)
    ready = cleaned_for_load(raw, plan, record.column_mapping, as_of, first=CLEANED_PREVIEW_ROWS)
    rows = [r.asDict() for r in P.preview(ready, ROW_ID, CLEANED_PREVIEW_ROWS).drop(ROW_ID).collect()]
    return {"preview": rows, "total_rows": raw.count(),
            "columns": [c for c in ready.columns if c != ROW_ID]}
