"""Stage 5: admission screening over a landing folder.

The folder is the data directory itself: every file in it is screened by
extension, size and content. No SQL oracle: DuckDB sees the tables, not the
folder listing, so the driver records a rows-only check.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.catalog import query
from ledgerloom.sources import fixtures as X
from ledgerloom.sources.admission import file_admission, megabytes, verdict
from ledgerloom.sources.files import DIALECT


@query("file_admission")
def q_file_admission(spark, sf):
    return file_admission(spark, sf)


# Each document stands for an uploaded file: its name from its id, its length up to 60 MB, a NUL
# and a broken byte put into some contents.
_NAMES = [".csv", ".TXT", ".xlsx", ".pdf", ".xls"]


@query("admission_rules", f"""select doc_id, file_name, length, length / 1024 / 1024 as size_mb, reason is null as accepted, reason from (
 select doc_id, file_name, length, case
  when ext not in ('.csv', '.txt', '.xlsx', '.xls') then 'File type not allowed. Allowed: .csv, .xlsx, .xls, .txt'
  when length > 50 * 1024 * 1024 then 'File too large. Max size: 50.0MB'
  when doc_id % 7 = 0 then 'Invalid file content. File may be corrupted.' end as reason
 from (select doc_id, 'f' || doc_id || ['.csv', '.TXT', '.xlsx', '.pdf', '.xls'][doc_id % 5 + 1] as file_name,
   lower(['.csv', '.TXT', '.xlsx', '.pdf', '.xls'][doc_id % 5 + 1]) as ext,
   doc_id * 7919 % 61 * 1024 * 1024 as length from documents))""")
def q_admission_rules(spark, sf):
    key = F.col("doc_id")
    docs = X.table(spark, sf, "documents").select("doc_id", "text")
    name = F.concat(F.lit("f"), key.cast("string"),
                    F.get(F.array(*[F.lit(e) for e in _NAMES]), (key % 5).cast("int")))
    damaged = F.concat(F.unhex(F.lit("FF00")), F.col("text").cast("binary"))
    files = docs.select("doc_id", name.alias("file_name"),
                        (key * 7919 % 61 * 1024 * 1024).alias("length"),
                        F.when(key % 7 == 0, damaged).otherwise(F.col("text").cast("binary"))
                        .alias("content"))
    reason = verdict(F.col("file_name"), F.col("length"), F.col("content"))
    return files.select("doc_id", "file_name", "length", megabytes(F.col("length")).alias("size_mb"),
                        reason.isNull().alias("accepted"),
                        reason.alias("reason"))


@query("csv_cells", "select doc_id, md5(text) as text_md5, length(text) as n_chars, lang from documents")
def q_csv_cells(spark, sf):
    """Texts written as quoted cells (quotes, commas and line breaks inside) and read back."""
    docs = X.table(spark, sf, "documents")
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.concat(
        F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"')), F.col("lang"))
    options = {k: v for k, v in DIALECT.items() if k in ("quote", "escape", "mode", "nullValue", "emptyValue")}
    cells = F.from_csv(line, F.lit("doc_id bigint, text string, lang string"),
                       options | {"multiLine": "true", "maxCharsPerColumn": "-1"})
    return docs.select(cells.alias("r")).select(
        "r.doc_id", F.md5("r.text").alias("text_md5"), F.length("r.text").cast("bigint").alias("n_chars"),
        "r.lang")
