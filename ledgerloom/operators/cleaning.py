"""Header cleaning, type inference, gap filling and conforming to the sales schema.

Type inference needs the data to choose the output schema, so it is two
passes by nature:

1. ``parse_measures`` -- one global aggregate over the text columns (partial
   per task, a single tiny final row), unpacked to one row per column.
2. ``infer_types`` -- the driver reads those rows (one per column, so the
   collect is bounded by the column count, never by the data) and builds one
   ``select`` of typed conversions, which stays lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.constants import (
    PARSE_SHARE_THRESHOLD,
    REQUIRED_DEFAULTS,
)
from ledgerloom.functions.parsing import (
    date_text,
    is_boolean_text,
    na_to_null,
    parse_boolean,
    parse_datetime,
    parse_integer,
    parse_numeric,
    read_date,
    reads_as_integer,
    truncate_to_bigint,
)
from ledgerloom.functions.text import clean_names
from ledgerloom.functions.timeutil import as_of_column, utc_midnight

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
TIMESTAMP_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def q(name: str) -> Column:
    """A column by exact name (names may hold dots or other symbols)."""
    return F.col("`" + name.replace("`", "``") + "`")


# ---------------------------------------------------------------------------
# Headers and NA tokens
# ---------------------------------------------------------------------------

def clean_column_names(df: DataFrame) -> DataFrame:
    """Standardize headers; collisions get ``_1``, ``_2`` suffixes. Metadata only."""
    return df.toDF(*clean_names(df.columns))


def replace_na_tokens(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text equal to an NA token becomes null in every string column."""
    targets = set(columns or [f.name for f in df.schema.fields
                              if isinstance(f.dataType, T.StringType)])
    return df.select(*[na_to_null(q(c)).alias(c) if c in targets else q(c) for c in df.columns])


def apply_mapping(df: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    """Rename columns old -> new; names not in the frame are ignored.

    A mapping written the other way round (new -> old: its keys absent, its
    values present) is rejected instead of silently renaming nothing.
    """
    if not mapping:
        return df
    present = set(df.columns)
    missing_keys = [k for k in mapping if k not in present]
    if missing_keys and all(mapping[k] in present for k in missing_keys):
        raise ValueError(
            f"column mapping must be old name -> new name; {missing_keys} are not columns "
            f"but their targets are")
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in present})


# ---------------------------------------------------------------------------
# Type inference
# ---------------------------------------------------------------------------

_MEASURE_FIELDS = ["n_nonnull", "n_boolean", "n_numeric", "n_whole", "n_datetime"]
_MEASURES_SCHEMA = ("column_name string, ordinal int, n_rows bigint, "
                    + ", ".join(f"{m} bigint" for m in _MEASURE_FIELDS)
                    + ", numeric_ratio double, datetime_ratio double")


def parse_measures(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per text column: how many values are present and how many parse as each type.

    One row per column: ``column_name, ordinal, n_rows`` and the counts
    ``n_nonnull, n_boolean, n_numeric, n_whole, n_datetime``, plus the shares
    of all rows that parse as numbers and as dates. Dates are only tried on
    values that are not numbers: the two never overlap under the grammars.

    The columns are stacked into (ordinal, value) rows so each parse
    expression is generated once, then counted per ordinal: a partial
    aggregate per task leaves one row per column per task to shuffle.
    """
    cols = columns if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    spark = df.sparkSession
    meta = spark.createDataFrame([(c, i) for i, c in enumerate(cols)],
                                 "column_name string, ordinal int")
    if not cols:
        return spark.createDataFrame([], _MEASURES_SCHEMA)
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), q(c).cast("string").alias("v"))
                      for i, c in enumerate(cols)])
    return measured(meta, parse_counts(df.select(F.inline(cells)), ["ordinal"]), ["ordinal"])


def parse_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Parse outcomes of ``cells`` (``keys`` and the text ``v``), counted per key."""
    # Each parse is made once, in a projection below the counts. Dates are read once per text
    # that may be one (few cells hold any), after a partial aggregate per task.
    v, x = F.col("v"), F.col("x")
    parsed = cells.select(*keys, "v", parse_numeric(v).alias("x")).select(
        *keys, "v", "x", F.when(reads_as_integer(v, x), F.lit(True)).alias("whole"),
        F.when(x.isNull(), date_text(v)).alias("t"))
    per_text = parsed.groupBy(*keys, "t").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(v).alias("n_nonnull"),
        F.count_if(is_boolean_text(v)).alias("n_boolean"),
        F.count(x).alias("n_numeric"),
        F.count("whole").alias("n_whole"),
    )
    # A text that may be a date is no null, so its rows are its values.
    dated = per_text.select("*", read_date(F.col("t")).alias("ts"))
    return dated.groupBy(*keys).agg(
        *[F.sum(m).alias(m) for m in ("n_rows", "n_nonnull", "n_boolean", "n_numeric", "n_whole")],
        F.coalesce(F.sum(F.when(F.col("ts").isNotNull(), F.col("n_rows"))), F.lit(0)).alias("n_datetime"),
    )


def measured(columns: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """``columns`` (metadata: keys, ``column_name``, ``ordinal``) with their parse counts and shares.

    Every column sees every row, so an empty input is the only case where a
    column has no counts; the left join keeps it with zeros.
    """
    out = columns.join(counts, keys, "left").select(
        *columns.columns, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in ["n_rows"] + _MEASURE_FIELDS])
    share = lambda n: (F.col(n) / F.nullif(F.col("n_rows"), F.lit(0))).cast("double")
    return out.select(*columns.columns, "n_rows", *_MEASURE_FIELDS,
                      share("n_numeric").alias("numeric_ratio"),
                      share("n_datetime").alias("datetime_ratio"))


def type_choice() -> Column:
    """The inference rules, in order, as one expression over ``parse_measures``.

    1 all null -> double; 2 all boolean words -> boolean; 3 all numeric ->
    number; 4 numeric share > 0.8 -> number; 5 date share > 0.8 -> timestamp;
    6 otherwise string. A number is bigint when every parsed value is whole.
    """
    nonnull, n_num = F.col("n_nonnull"), F.col("n_numeric")
    number = F.when(F.col("n_whole") == n_num, F.lit("bigint")).otherwise(F.lit("double"))
    return (F.when(nonnull == 0, F.lit("double"))
             .when(F.col("n_boolean") == nonnull, F.lit("boolean"))
             .when(n_num == nonnull, number)
             .when(F.col("numeric_ratio") > PARSE_SHARE_THRESHOLD, number)
             .when(F.col("datetime_ratio") > PARSE_SHARE_THRESHOLD, F.lit("timestamp_ntz"))
             .otherwise(F.lit("string")))


def coerced_count() -> Column:
    """Present values that did not parse and became null under the chosen type."""
    t = F.col("spark_type")
    return (F.when(t.isin("bigint", "double"), F.col("n_nonnull") - F.col("n_numeric"))
             .when(t == "timestamp_ntz", F.col("n_nonnull") - F.col("n_datetime"))
             .when(t == "boolean", F.col("n_nonnull") - F.col("n_boolean"))
             .otherwise(F.lit(0)))


def choose_types(measures: DataFrame) -> DataFrame:
    """``parse_measures`` plus ``spark_type`` and ``coerced_count`` per column."""
    return measures.withColumn("spark_type", type_choice()).withColumn("coerced_count", coerced_count())


@dataclass(frozen=True)
class TypePlan:
    """Chosen Spark type per column name, and how many present values do not
    read as it (the result of pass 1)."""
    types: dict[str, str]
    coerced: dict[str, int] = field(default_factory=dict)

    @classmethod
    def from_choices(cls, choices: DataFrame) -> TypePlan:
        rows = choices.select("column_name", "spark_type", "coerced_count").collect()
        return cls({r.column_name: r.spark_type for r in rows},
                   {r.column_name: r.coerced_count for r in rows})


_CONVERT = {
    "double": parse_numeric,
    "bigint": parse_integer,
    "boolean": parse_boolean,
    "timestamp_ntz": parse_datetime,
}


def convert(c: Column, spark_type: str) -> Column:
    if spark_type == "string":
        return c
    return _CONVERT[spark_type](c)


def apply_types(df: DataFrame, plan: TypePlan) -> DataFrame:
    """Pass 2: lazy conversions; unplanned columns pass through. What may be a date is picked out
    in a projection of its own (see ``read_date``)."""
    dates = {c for c in df.columns if plan.types.get(c) == "timestamp_ntz"}
    if dates:
        df = df.select(*[date_text(q(c)).alias(c) if c in dates else q(c) for c in df.columns])
    out = []
    for c in df.columns:
        t = plan.types.get(c)
        if c in dates:
            out.append(read_date(q(c)).alias(c))
        else:
            out.append(q(c) if t is None else convert(q(c), t).alias(c))
    return df.select(*out)


def infer_types(df: DataFrame, columns: list[str] | None = None,
                plan: TypePlan | None = None) -> DataFrame:
    """Type every text column by the inference rules (two passes, see module doc)."""
    if plan is None:
        plan = TypePlan.from_choices(choose_types(parse_measures(df, columns)))
    return apply_types(df, plan)


# ---------------------------------------------------------------------------
# Gap filling
# ---------------------------------------------------------------------------

def column_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent non-null value per column, the smallest one on a tie.

    The columns are stacked, counted per (column, value) -- a partial
    aggregate per task, so a value holding a third of the rows is one row per
    task before the shuffle -- then the winner is picked per column.
    """
    if not columns:
        raise ValueError("column_modes needs at least one column")
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), q(c).alias("value")) for c in columns
    ])).alias("s")).select("s.*").filter(F.col("value").isNotNull())
    counts = stacked.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column_name").agg(
        F.min_by(F.col("value"), F.struct(-F.col("n"), F.col("value"))).alias("mode_value"))


def _literal(value, dt: T.DataType) -> Column:
    """A collected value as a literal of ``dt``; timestamps go through text so
    no zone conversion touches them."""
    import datetime as _dt

    if isinstance(value, _dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast(dt)
    return F.lit(value).cast(dt)


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def fill_missing(df: DataFrame, as_of=None, modes: dict | None = None,
                 skip: list[str] | None = None) -> DataFrame:
    """Fill gaps by type: numbers 0, timestamps the column mode (else today's
    UTC midnight), booleans false, text empty. NaN counts as a gap. Columns in
    ``skip`` pass through.

    Timestamp modes come from one ``column_modes`` job; the driver receives one
    value per timestamp column and inlines it as a literal.
    """
    skip = set(skip or [])
    ts_cols = [f.name for f in df.schema.fields
               if isinstance(f.dataType, TIMESTAMP_TYPES) and f.name not in skip]
    if modes is None:
        modes = {}
        if ts_cols:
            modes = {r.column_name: r.mode_value for r in column_modes(df, ts_cols).collect()}
    out = []
    for f in df.schema.fields:
        c, dt = q(f.name), f.dataType
        if f.name in skip:
            e = c
        elif isinstance(dt, (T.FloatType, T.DoubleType)):
            e = F.when(c.isNull() | F.isnan(c), F.lit(0.0).cast(dt)).otherwise(c)
        elif _is_numeric(dt):
            e = F.coalesce(c, F.lit(0).cast(dt))
        elif isinstance(dt, TIMESTAMP_TYPES):
            m = modes.get(f.name)
            fallback = _literal(m, dt) if m is not None else utc_midnight(as_of)
            e = F.coalesce(c, fallback.cast(dt))
        elif isinstance(dt, T.BooleanType):
            e = F.coalesce(c, F.lit(False))
        elif isinstance(dt, T.StringType):
            e = F.coalesce(c, F.lit(""))
        else:
            e = c
        out.append(e.alias(f.name))
    return df.select(*out)


def plan_types(df: DataFrame, columns: list[str] | None = None) -> TypePlan:
    """Pass 1 of inference over the whole frame."""
    return TypePlan.from_choices(choose_types(parse_measures(df, columns)))


def first_rows(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order_col``, computed now: a top-n per task and a
    small merge, whatever is built on top of them later."""
    from ledgerloom.session import checkpointed

    return checkpointed(df.orderBy(q(order_col).asc()).limit(n))


def clean_dataframe(df: DataFrame, as_of=None, keep: list[str] | None = None,
                    plan: TypePlan | None = None, first: tuple[str, int] | None = None) -> DataFrame:
    """Headers -> types -> gaps. ``keep`` names key columns left untouched.

    Types and date modes always come from the whole frame; the modes read the
    date columns only. ``first=(order column, n)`` then converts and fills just
    the first n rows, for previews. ``plan`` skips pass 1.
    """
    keep = list(keep or [])
    data = [c for c in df.columns if c not in keep]
    names = clean_names(data)
    renamed = df.select(*[q(k) for k in keep], *[q(o).alias(n) for o, n in zip(data, names)])
    if plan is None:
        plan = plan_types(renamed, [n for n in names if renamed.schema[n].dataType == T.StringType()])
    typed = apply_types(renamed, plan)
    dates = [f.name for f in typed.schema.fields
             if isinstance(f.dataType, TIMESTAMP_TYPES) and f.name not in keep]
    modes = {r.column_name: r.mode_value for r in column_modes(typed, dates).collect()} if dates else {}
    if first is not None:
        typed = apply_types(first_rows(renamed, *first), plan)
    return fill_missing(typed, as_of, modes=modes, skip=keep)


# ---------------------------------------------------------------------------
# Conforming to the sales table
# ---------------------------------------------------------------------------

def conform_defaults(df: DataFrame, mapping: dict[str, str] | None = None,
                     as_of=None) -> DataFrame:
    """Optional rename, then add each missing required column with its default.

    Extra columns are kept; ``conform_sales`` drops them.
    """
    df = apply_mapping(df, mapping)
    adds = {}
    for name, default in REQUIRED_DEFAULTS:
        if name in df.columns:
            continue
        if name == "date":
            adds[name] = utc_midnight(as_of)
        elif name == "stock_level":
            adds[name] = F.lit(default).cast("bigint")
        else:
            adds[name] = F.lit(default)
    return df.withColumns(adds) if adds else df


def conform_sales(df: DataFrame, upload_id: str, id_col: str | None = None,
                  with_created_at: bool = False, as_of=None) -> DataFrame:
    """Coerce rows to the sales table: numbers to double, stock truncated to
    a whole number (0 when missing; 64 bits, kept as double), category as text, extras dropped, ``upload_id``
    added."""
    cols = []
    if id_col:
        cols.append(q(id_col).alias("id"))
    cols += [
        F.lit(upload_id).alias("upload_id"),
        q("date").try_cast("timestamp_ntz").alias("date"),
        q("sku_id").cast("string").alias("sku_id"),
        q("sales_quantity").try_cast("double").alias("sales_quantity"),
        q("sales_revenue").try_cast("double").alias("sales_revenue"),
        F.coalesce(truncate_to_bigint(q("stock_level")).cast("double"),
                   F.lit(0.0)).alias("stock_level"),
        q("category").cast("string").alias("category"),
        q("unit_price").try_cast("double").alias("unit_price"),
    ]
    if with_created_at:
        cols.append(as_of_column(as_of).alias("created_at"))
    return df.select(*cols)


__all__ = [
    "apply_mapping", "apply_types", "choose_types", "clean_column_names",
    "clean_dataframe", "column_modes", "conform_defaults", "conform_sales", "fill_missing",
    "infer_types", "parse_measures", "replace_na_tokens", "TypePlan",
]
