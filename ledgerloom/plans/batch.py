"""Profile, validate, register and load all files of a micro-batch at once.

What ``plans.upload`` and ``plans.process`` do for one file, keyed by (file,
column): the cells of all files are staged once, by position, and each step is
one job over all of them, whatever their number: parse counts, profile, samples,
rules, date modes and the load. The driver gets a row per file and column. Files
whose own content fails (no header, a row with too many cells, a date column that
holds numbers) are told apart by their number and do not stop the others.

Workbooks are not read here; ``streaming.landing`` sends them the way of one file.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.constants import (
    REQUIRED_DEFAULTS,
    SAMPLE_VALUES,
    STATUS_ERROR,
    STATUS_PROCESSED,
    STATUS_PROCESSING,
    STATUS_UPLOADED,
)
from ledgerloom.functions.text import clean_names
from ledgerloom.functions.timeutil import utc_midnight
from ledgerloom.operators import cleaning as C
from ledgerloom.operators import profiling as P
from ledgerloom.operators import validation as V
from ledgerloom.session import checkpointed, staged
from ledgerloom.sources import registry as R
from ledgerloom.sources.admission import file_admission
from ledgerloom.sources.files import ROW_ID, read_batch, suffix
from ledgerloom.sources.sales_table import write_sales

BATCH_SUFFIXES = (".csv", ".txt")
HEAD_ROWS = 200
_FAMILY = {"bigint": "integral", "double": "fractional", "boolean": "boolean", "timestamp_ntz": "timestamp",
           "string": "text"}
_COLUMNS = "file_no int, column_name string, ordinal int"


@dataclass
class BatchFile:
    """One file on its way through the batch; ``error`` says why it goes no further."""

    upload_id: str
    path: str
    length: int | None = None
    error: str | None = None
    names: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    coerced: dict[str, int] = field(default_factory=dict)
    rows: int = 0
    schema: dict | None = None
    validation: dict | None = None
    mapping: dict | None = None
    status: str | None = None

    @property
    def filename(self) -> str:
        return self.path.rstrip("/").split("/")[-1]


@dataclass
class Batch:
    """The files by number, and their staged cells."""

    files: dict[int, BatchFile]
    cells: DataFrame | None

    def going(self) -> dict[int, BatchFile]:
        return {n: f for n, f in self.files.items() if f.error is None}


def _admit(spark: SparkSession, files: dict[int, BatchFile]) -> None:
    def bare(path: str) -> str:
        return path.split(":", 1)[-1].lstrip("/")

    found = {bare(r.path): r for r in file_admission(spark, [f.path for f in files.values()]).collect()}
    for f in files.values():
        r = found.get(bare(f.path))
        if r is None or not r.accepted:
            f.error = f"File rejected: {r.reason if r else 'file is empty'}"
        else:
            f.length = r.length


def open_batch(spark: SparkSession, uploads: dict[str, str]) -> Batch:
    """Admit and read the files of ``uploads`` (upload id -> path) and stage their cells."""
    files = {n: BatchFile(u, p) for n, (u, p) in enumerate(sorted(uploads.items()))}
    _admit(spark, files)
    batch = Batch(files, None)
    if not batch.going():
        return batch
    cells, headers = read_batch(spark, {f.path: n for n, f in batch.going().items()})
    for n, f in batch.going().items():
        if n not in headers:
            f.error = "File rejected: file is empty"
        else:
            f.names = clean_names(headers[n])
    if cells is not None:
        batch.cells = staged(cells)
    return batch


def _long(batch: Batch) -> DataFrame:
    """(file_no, ordinal, v, row_id) for every cell of the files that go on."""
    going = batch.going()
    widths = F.create_map(*[F.lit(x) for n, f in going.items() for x in (n, len(f.names))])
    widest = max(len(f.names) for f in going.values())
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.col(f"c{i}").alias("v")) for i in range(widest)])
    rows = batch.cells.where(F.col("file_no").isin(list(going)))
    return rows.select("file_no", F.col(ROW_ID).alias("row_id"), F.inline(
        F.slice(cells, F.lit(1), F.element_at(widths, F.col("file_no")))))


def _columns(spark: SparkSession, batch: Batch) -> DataFrame:
    return spark.createDataFrame([(n, c, i) for n, f in batch.going().items() for i, c in enumerate(f.names)], _COLUMNS)


def plan_batch(spark: SparkSession, batch: Batch) -> None:
    """Types of every column (one job over all cells), and rows that do not fit their header."""
    for r in batch.cells.groupBy("file_no").agg(F.count(F.lit(1)).alias("n"), F.max("bad").alias("bad")).collect():
        f = batch.files[r.file_no]
        f.rows = r.n
        if r.bad is not None and f.error is None:
            f.error = f"a row has more than the header's {len(f.names)} cells: {r.bad[:200]}"
    if not batch.going():
        return
    keys = ["file_no", "ordinal"]
    choices = C.choose_types(C.measured(_columns(spark, batch), C.parse_counts(_long(batch), keys), keys))
    for f in batch.going().values():
        f.types = ["double"] * len(f.names)
    for r in choices.select("file_no", "ordinal", "column_name", "spark_type", "coerced_count").collect():
        f = batch.files[r.file_no]
        f.types[r.ordinal] = r.spark_type
        f.coerced[r.column_name] = r.coerced_count


def _typed_text(v: Column, kind: Column, kinds: set[str]) -> Column:
    """``v`` read as its column's type, as text for counting; only types that occur are in the plan."""
    out = F.when(kind == "string", v)
    for k in sorted(kinds - {"string"}):
        x = C.convert(v, k)
        out = out.when(kind == k, (x + F.lit(0.0) if k == "double" else x).cast("string"))
    return out


def profile_batch(spark: SparkSession, batch: Batch, as_of=None) -> None:
    """Schema document and validation report of every file, from one profile of all columns."""
    going = batch.going()
    if not going:
        return
    kinds = {k for f in going.values() for k in f.types}
    columns = spark.createDataFrame(
        [(n, c, i, k, _FAMILY[k], int(f.coerced.get(c, 0))) for n, f in going.items()
         for i, (c, k) in enumerate(zip(f.names, f.types))],
        f"{_COLUMNS}, spark_type string, family string, coerced_count bigint")
    meta = columns.select(F.col("file_no").alias("m_file"), F.col("ordinal").alias("m_ordinal"), "spark_type", "family")
    cells = _long(batch).join(F.broadcast(meta), (F.col("file_no") == F.col("m_file")) & (
        F.col("ordinal") == F.col("m_ordinal"))).select(
        "file_no", "ordinal", "row_id", "family", _typed_text(F.col("v"), F.col("spark_type"), kinds).alias("value"))
    at = F.when(F.col("family") == "timestamp", F.col("row_id"))
    keys = ["file_no", "ordinal"]
    profile = P.profiled(columns.drop("spark_type"), P.profile_cells(cells.withColumn("at", at), keys, as_of), keys)
    schema = profile.join(_samples(batch, cells), keys, "left").withColumn(
        "sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
    schema = checkpointed(schema.select("*", P.label_expr().alias("detected_type"),
                                        P.suggest_mapping_expr(F.col("column_name")).alias("suggested_mapping")))
    files = spark.createDataFrame([(n,) for n in going], "file_no int")
    issues = V.validation_issues(schema, as_of, ["file_no"])
    both = P.schema_document(schema, ["file_no"]).join(V.validation_report(issues, files), "file_no")
    for r in both.collect():                                  # one row per file
        row = r.asDict(recursive=True)
        f = batch.files[row.pop("file_no")]
        f.schema, f.validation = row.pop("detected_schema"), row
        f.status = STATUS_UPLOADED


def _samples(batch: Batch, cells: DataFrame) -> DataFrame:
    """The first values of each column: from the file's first rows, and further on only for columns
    too empty there (a rank that Spark cuts to the first few in every task)."""
    heads = batch.cells.groupBy(F.col("file_no").alias("h_file")).agg((F.min(ROW_ID) + HEAD_ROWS).alias("before"))
    near = cells.where("value is not null").join(F.broadcast(heads), F.col("file_no") == F.col("h_file"))
    early = near.where("row_id < before")
    full = early.groupBy("file_no", "ordinal").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_VALUES) \
        .select(F.col("file_no").alias("e_file"), F.col("ordinal").alias("e_ordinal"))
    rest = near.join(F.broadcast(full), (F.col("file_no") == F.col("e_file")) & (F.col("ordinal") == F.col("e_ordinal")),
                     "left").where(F.col("e_file").isNull() | (F.col("row_id") < F.col("before")))
    rank = F.row_number().over(Window.partitionBy("file_no", "ordinal").orderBy("row_id"))
    return rest.select("file_no", "ordinal", "row_id", "value").withColumn("sample_rank", rank) \
        .where(F.col("sample_rank") <= SAMPLE_VALUES).groupBy("file_no", "ordinal").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("sample_rank", "value"))), lambda s: s["value"]).alias("sample_values"))


# ---------------------------------------------------------------------------
# Load
# ---------------------------------------------------------------------------

#: Types a target cannot be made of (Spark has no such cast).
_NO_CAST = {"date": {"bigint", "double", "boolean"}, "sales_quantity": {"timestamp_ntz"},
            "sales_revenue": {"timestamp_ntz"}, "unit_price": {"timestamp_ntz"}, "stock_level": {"timestamp_ntz"}}


def _sources(f: BatchFile) -> dict[str, int]:
    """Target column -> position in the file, after the saved mapping."""
    mapping = f.mapping or {}
    present = set(f.names)
    missing = [k for k in mapping if k not in present]
    if missing and all(mapping[k] in present for k in missing):
        raise ValueError(f"column mapping must be old name -> new name; {missing} are not columns but their targets are")
    names = [mapping.get(c, c) for c in f.names]
    found = {t: names.index(t) for t, _ in REQUIRED_DEFAULTS if t in names}
    for t, i in found.items():
        if f.types[i] in _NO_CAST.get(t, ()):
            raise ValueError(f"column {f.names[i]} is of type {f.types[i]} and cannot be read as {t}")
    return found


def load_batch(spark: SparkSession, batch: Batch, numbers: list[int], sales_path: str, as_of=None) -> dict[int, dict]:
    """Clean the files ``numbers`` and write their rows, replacing their uploads' partitions: one
    job for the date modes, one for the write, one that counts what was written."""
    sources: dict[int, dict[str, int]] = {}
    for n in numbers:
        f = batch.files[n]
        try:
            sources[n] = _sources(f)
        except ValueError as e:
            f.error = str(e)
    if not sources:
        return {}
    modes = _modes(spark, batch, sources)
    targets = [t for t, _ in REQUIRED_DEFAULTS]
    plan = spark.createDataFrame(
        [(n, batch.files[n].upload_id, *[x for t in targets for x in (
            sources[n].get(t), batch.files[n].types[sources[n][t]] if t in sources[n] else None,
            modes.get((n, sources[n].get(t))))]) for n in sources],
        "p_file int, upload_id string, " + ", ".join(f"at_{t} int, type_{t} string, mode_{t} string" for t in targets))
    width = max(len(batch.files[n].names) for n in sources)
    cells = F.array(*[F.col(f"c{i}") for i in range(width)])
    rows = batch.cells.join(F.broadcast(plan), F.col("file_no") == F.col("p_file")).withColumn("cells", cells)
    frame = rows.select(
        F.concat_ws(":", "upload_id", F.col(ROW_ID).cast("string")).alias("id"), "upload_id",
        *[_target(t, default, {batch.files[n].types[s[t]] for n, s in sources.items() if t in s}, as_of).alias(t)
          for t, default in REQUIRED_DEFAULTS])
    write_sales(frame, sales_path, as_of=as_of)
    written = spark.read.schema("upload_id string, date timestamp_ntz, sales_quantity double").parquet(sales_path) \
        .where(F.col("upload_id").isin([batch.files[n].upload_id for n in sources]))
    counts = {r.upload_id: r for r in written.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("date").isNull()).alias("no_date"),
        F.count_if(F.col("sales_quantity").isNull()).alias("no_quantity")).collect()}
    out = {}
    for n in sources:
        f = batch.files[n]
        c = counts.get(f.upload_id)
        out[n] = {"rows_processed": c.rows if c else 0, "rows_inserted": c.rows if c else 0,
                  "coerced": {k: v for k, v in f.coerced.items() if v},
                  "rows_without_date": c.no_date if c else 0, "rows_without_quantity": c.no_quantity if c else 0}
    return out


def _modes(spark: SparkSession, batch: Batch, sources: dict[int, dict[str, int]]) -> dict[tuple[int, int], str]:
    """The most frequent value (the smallest on a tie) of every date column that is loaded, as text."""
    wanted = [(n, i) for n, s in sources.items() for i in set(s.values()) if batch.files[n].types[i] == "timestamp_ntz"]
    if not wanted:
        return {}
    want = spark.createDataFrame(wanted, "w_file int, w_ordinal int")
    values = _long(batch).join(F.broadcast(want), (F.col("file_no") == F.col("w_file")) & (
        F.col("ordinal") == F.col("w_ordinal"))).select("file_no", "ordinal", C.convert(F.col("v"), "timestamp_ntz").alias("value"))
    counts = values.where("value is not null").groupBy("file_no", "ordinal", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("file_no", "ordinal").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value")))
                                                    .cast("string").alias("mode"))
    return {(r.file_no, r.ordinal): r.mode for r in best.collect()}


def _target(target: str, default, kinds: set[str], as_of) -> Column:
    """A column of the sales table: the file's own column read as its type and filled, then cast."""
    v = F.get("cells", F.col(f"at_{target}"))

    def cast(x: Column) -> Column:
        if target in ("sku_id", "category"):
            return x.cast("string")
        if target == "date":
            return x.try_cast("timestamp_ntz")
        if target == "stock_level":
            return F.coalesce(x.try_cast("bigint").cast("double"), F.lit(0.0))
        return x.try_cast("double")

    filled = {
        "bigint": lambda: F.coalesce(C.convert(v, "bigint"), F.lit(0).cast("bigint")),
        "double": lambda: F.coalesce(C.convert(v, "double"), F.lit(0.0)),
        "boolean": lambda: F.coalesce(C.convert(v, "boolean"), F.lit(False)),
        "timestamp_ntz": lambda: F.coalesce(C.convert(v, "timestamp_ntz"), F.col(f"mode_{target}").cast("timestamp_ntz"),
                                            utc_midnight(as_of).cast("timestamp_ntz")),
        "string": lambda: F.coalesce(v, F.lit("")),
    }
    missing = utc_midnight(as_of) if target == "date" else F.lit(default)
    out = F.when(F.col(f"at_{target}").isNull(), cast(missing))
    for k in sorted(kinds):
        out = out.when(F.col(f"type_{target}") == k, cast(filled[k]()))
    return out


# ---------------------------------------------------------------------------
# The whole batch
# ---------------------------------------------------------------------------

def run_batch(spark: SparkSession, uploads: dict[str, str], registry_path: str, sales_path: str | None = None,
              mappings: dict[str, dict] | None = None, as_of=None) -> list[dict]:
    """Profile, validate and register ``uploads`` (id -> path of a CSV or text file), and load the
    valid ones when ``sales_path`` is given. All events go to the registry in one write."""
    for path in uploads.values():
        if suffix(path) not in BATCH_SUFFIXES:
            raise ValueError(f"not read in batches: {path}")
    batch = open_batch(spark, uploads)
    if batch.going():
        plan_batch(spark, batch)
        profile_batch(spark, batch, as_of)
    events = [R.event(f.upload_id, STATUS_UPLOADED, filename=f.filename, file_path=f.path, file_size_bytes=f.length,
                      row_count=f.schema["row_count"], column_count=f.schema["column_count"], detected_schema=f.schema,
                      validation_report=f.validation) for f in batch.going().values()]
    results = {n: {"upload_id": f.upload_id, "path": f.path, "status": f.status,
                   "valid": f.validation["is_valid"]} for n, f in batch.going().items()}
    if sales_path:
        ready = [n for n, f in batch.going().items() if f.validation["is_valid"]]
        for n in ready:
            batch.files[n].mapping = (mappings or {}).get(batch.files[n].upload_id)
        events += [R.event(batch.files[n].upload_id, STATUS_PROCESSING) for n in ready]
        for n, facts in load_batch(spark, batch, ready, sales_path, as_of).items():
            results[n].update(facts, status=STATUS_PROCESSED)
            events.append(R.event(batch.files[n].upload_id, STATUS_PROCESSED))
    for n, f in batch.files.items():
        if f.error is not None:
            events.append(R.event(f.upload_id, STATUS_ERROR, error_message=f.error, file_path=f.path, filename=f.filename))
            results[n] = {"upload_id": f.upload_id, "path": f.path, "status": STATUS_ERROR, "error": f.error}
    R.append_events(spark, registry_path, events)
    return [results[n] for n in sorted(results)]
