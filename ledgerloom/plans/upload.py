"""Profile and validate an uploaded file, then register it.

Jobs, in order:
1. admission of the file (metadata, then its content);
2. the text is read once and staged as Parquet, checking the encoding on the way;
3. the type-inference pass (one aggregate; one row per column to the driver);
4. the profile (one stacked aggregation plus the samples), from which every
   rule of the report follows;
5. one registry event with the schema document and the report.

Only per-column results, the issue list and a 10-row preview reach the
driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.constants import PREVIEW_ROWS, STATUS_UPLOADED
from ledgerloom.functions.text import clean_names
from ledgerloom.operators import cleaning as C
from ledgerloom.operators import profiling as P
from ledgerloom.operators import validation as V
from ledgerloom.session import checkpointed
from ledgerloom.sources import registry as R
from ledgerloom.sources.admission import file_admission
from ledgerloom.sources.files import ROW_ID, read_file


@dataclass
class UploadResult:
    upload_id: str
    filename: str
    status: str
    schema: dict
    validation: dict
    preview: list[dict]


def typed_upload(spark: SparkSession, path: str) -> tuple[DataFrame, C.TypePlan, DataFrame]:
    """(typed frame, its types, the text it was made of): read, clean headers,
    infer types (no gap filling, so null shares are real)."""
    raw = read_file(spark, path, materialize=True)
    data = [c for c in raw.columns if c != ROW_ID]
    names = clean_names(data)
    renamed = raw.select(*[C.q(o).alias(n) for o, n in zip(data, names)], ROW_ID)
    plan = C.plan_types(renamed, names)
    return C.apply_types(renamed, plan), plan, renamed


def profile_upload(spark: SparkSession, path: str, registry_path: str | None = None,
                   upload_id: str | None = None, as_of=None,
                   events: list | None = None) -> UploadResult:
    """Profile and register one file; with ``events`` the registry event is added to
    that list for a later ``registry.append_events`` instead of being written."""
    adm = file_admission(spark, path).collect()
    if not adm or not adm[0].accepted:
        reason = adm[0].reason if adm else "file is empty"
        raise ValueError(f"File rejected: {reason}")
    upload_id = upload_id or R.new_upload_id()
    typed, plan, text = typed_upload(spark, path)
    cols = [c for c in typed.columns if c != ROW_ID]
    # One row per column, read by the rules and by the document.
    schema = checkpointed(P.detect_schema(typed, ROW_ID, cols, as_of=as_of, coerced=plan.coerced))
    issues = V.validation_issues(schema, as_of)
    report_row = V.validation_report(issues).collect()[0].asDict(recursive=True)
    schema_doc = P.schema_document(schema).collect()[0]["detected_schema"].asDict(recursive=True)
    head = C.apply_types(C.first_rows(text, ROW_ID, PREVIEW_ROWS), plan)
    preview = [r.asDict() for r in P.preview(head, ROW_ID).drop(ROW_ID).collect()]
    filename = path.rstrip("/").split("/")[-1]
    facts = R.event(upload_id, STATUS_UPLOADED, filename=filename, file_path=path,
                    file_size_bytes=int(adm[0].length), row_count=int(schema_doc["row_count"]),
                    column_count=int(schema_doc["column_count"]), detected_schema=schema_doc,
                    validation_report=report_row)
    if events is not None:
        events.append(facts)
    elif registry_path:
        R.append_events(spark, registry_path, [facts])
    return UploadResult(upload_id, filename, "uploaded", schema_doc, report_row, preview)


__all__ = ["UploadResult", "profile_upload", "typed_upload"]
