"""Column profiles, type labels, name-based field suggestions and previews.

``profile_columns`` answers every column at once with one stacked
aggregation: each typed column becomes rows of (column, value as text),
those are counted per (column, value) -- a partial aggregate per task, so a
value holding a third of all rows is one row per task before the shuffle --
and rolled up per column. Exact distinct counts, the counts that the
validation rules need (negative, zero, future, old values) and the first
value of date columns come out of the same pass.

``sample_values`` takes the first values per column from the first rows (a
heap of that many rows per task, no sort); only a column that is too empty
there looks further, for its own first values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.constants import (
    BOOLEAN_LABEL_STRINGS,
    CATEGORICAL_MAX_DISTINCT,
    CATEGORICAL_RATIO,
    COLUMN_KEYWORDS,
    LABEL_BOOLEAN,
    LABEL_CATEGORICAL,
    LABEL_DATE,
    LABEL_DATETIME,
    LABEL_INTEGER,
    LABEL_NUMERIC,
    LABEL_STRING,
    LABEL_UNKNOWN,
    OLD_DATE,
    PREVIEW_ROWS,
    SAMPLE_VALUES,
)
from ledgerloom.functions.display import json_safe
from ledgerloom.functions.timeutil import as_of_column, is_midnight
from ledgerloom.operators.cleaning import first_rows, q

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
#: First rows that most columns find their samples and first value in.
HEAD_ROWS = 200


def type_family(dt: T.DataType) -> str:
    if isinstance(dt, INTEGRAL):
        return "integral"
    if isinstance(dt, FRACTIONAL):
        return "fractional"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, TIMES):
        return "timestamp"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "text"


def _as_text(c: Column, dt: T.DataType) -> Column:
    """A value as text for counting; NaN counts as missing, like pandas, and -0.0 is 0.0."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c + F.lit(0.0).cast(dt))
    return c.cast("string")


def columns_frame(spark: SparkSession, df: DataFrame, columns: list[str]) -> DataFrame:
    """Metadata: one row per profiled column (name, ordinal, type family)."""
    rows = [(c, i, type_family(df.schema[c].dataType)) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "column_name string, ordinal int, family string")


def stacked(df: DataFrame, columns: list[str], order_col: str | None = None) -> DataFrame:
    """(ordinal, value, at) for every cell of ``columns``; names stay in metadata.

    ``at`` is the row order of date cells, whose first value sets the label;
    other cells leave it null, so it costs nothing in the shuffle. An order that is no
    number is left out (see ``_first_dates``).
    """
    if order_col and not isinstance(df.schema[order_col].dataType, INTEGRAL):
        order_col = None
    dated = _dated(df, columns)
    none = F.lit(None).cast("bigint")
    cells = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), _as_text(q(c), df.schema[c].dataType).alias("value"),
                 (q(order_col).cast("bigint") if order_col and c in dated else none).alias("at"))
        for i, c in enumerate(columns)
    ])
    return df.select(F.inline(cells))


def _dated(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if type_family(df.schema[c].dataType) in ("date", "timestamp")]


def _first_dates(df: DataFrame, columns: list[str], order_col: str,
                 head: DataFrame | None = None) -> DataFrame:
    """(ordinal, first_value) of the date columns, in the order of any type of column.

    Text in an aggregate's buffer would make Spark sort all cells of the profile instead of
    hashing them; over the date columns alone, ungrouped, it costs nothing. With ``head``, the
    first HEAD_ROWS rows, only columns without a value there look at the others.
    """
    dated = _dated(df, columns)
    known = []
    if head is not None:
        seen = _firsts(head, dated, order_col, F.count(F.lit(1)).alias("n")).first()
        known = [(columns.index(c), seen[i]) for i, c in enumerate(dated) if seen[i] is not None or seen.n < HEAD_ROWS]
        dated = [c for c in dated if columns.index(c) not in dict(known)]
    found = df.sparkSession.createDataFrame(known, "ordinal int, first_value string")
    if not dated:
        return found
    firsts = _firsts(df, dated, order_col).select(F.inline(F.array(*[
        F.struct(F.lit(columns.index(c)).alias("ordinal"), F.col(f"d{i}").alias("first_value"))
        for i, c in enumerate(dated)])))
    return firsts.unionByName(found) if known else firsts


def _firsts(df: DataFrame, dated: list[str], order_col: str, *more: Column) -> DataFrame:
    return df.agg(*[F.min_by(q(c), F.when(q(c).isNotNull(), q(order_col))).cast("string").alias(f"d{i}")
                    for i, c in enumerate(dated)], *more)


def profile_columns(df: DataFrame, columns: list[str] | None = None,
                    order_col: str | None = None, as_of=None,
                    head: DataFrame | None = None) -> DataFrame:
    """One row per column: rows, nulls, null %, exact distinct count, the
    counts the type labels need and those the validation rules need.

    Columns: ``column_name, ordinal, family, n_rows, null_count,
    null_percentage, unique_count, n_nonnull, n_label_words, n_fraction,
    n_negative, n_zero`` (number columns), ``min_date, max_date, n_future,
    n_old`` (date columns; future is after ``as_of``) and ``first_value`` (first
    non-null value of a date column in ``order_col`` order, null without one).
    ``null_percentage`` is null for an empty frame. ``head``: the first HEAD_ROWS rows by
    ``order_col`` with their date columns, where known.
    """
    spark = df.sparkSession
    columns = list(columns if columns is not None else
                   [c for c in df.columns if c != order_col])
    meta = columns_frame(spark, df, columns)
    families = F.array(*[F.lit(type_family(df.schema[c].dataType)) for c in columns]).cast("array<string>")
    cells = stacked(df, columns, order_col).withColumn("family", F.get(families, F.col("ordinal")))
    counts = profile_cells(cells, ["ordinal"], as_of)
    if order_col and _dated(df, columns) and not isinstance(df.schema[order_col].dataType, INTEGRAL):
        counts = counts.drop("first_value").join(
            F.broadcast(_first_dates(df, columns, order_col, head)), "ordinal", "left")
    return profiled(meta, counts, ["ordinal"])


_COUNTS = ["n_rows", "null_count", "unique_count", "n_label_words", "n_fraction", "n_negative",
           "n_zero", "n_future", "n_old"]


def profile_cells(cells: DataFrame, keys: list[str], as_of=None) -> DataFrame:
    """The counts of ``profile_columns`` per key, from ``cells``: the keys, ``family``,
    ``value`` (text) and ``at`` (row order where the first value matters)."""
    per_value = cells.groupBy(*keys, "family", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    v, n, family = F.col("value"), F.col("n"), F.col("family")
    x = F.when(family.isin("integral", "fractional"), v.try_cast("double"))
    d = F.when(family.isin("date", "timestamp"), v.try_cast("timestamp_ntz"))
    is_fraction = (family == "fractional") & (x != F.floor(x))
    return per_value.groupBy(*keys).agg(
        F.sum(n).alias("n_rows"),
        F.sum(F.when(v.isNull(), n)).alias("null_count"),
        F.count(v).alias("unique_count"),
        F.sum(F.when(v.isin(BOOLEAN_LABEL_STRINGS), n)).alias("n_label_words"),
        F.sum(F.when(is_fraction, n)).alias("n_fraction"),
        F.sum(F.when(x < 0, n)).alias("n_negative"),
        F.sum(F.when(x == 0, n)).alias("n_zero"),
        F.sum(F.when(d > as_of_column(as_of), n)).alias("n_future"),
        F.sum(F.when(d < F.lit(OLD_DATE).cast("timestamp_ntz"), n)).alias("n_old"),
        F.min(d).alias("min_date"), F.max(d).alias("max_date"),
        F.min_by(d, F.when(d.isNotNull(), F.col("at"))).cast("string").alias("first_value"),
    )


def profiled(columns: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """``columns`` (metadata: keys, ``column_name``, ``ordinal``, ``family``) with their counts.

    A left join, so a column of an empty input still has a row.
    """
    prof = columns.join(counts, keys, "left").select(
        *columns.columns, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in _COUNTS],
        "min_date", "max_date", "first_value")
    return prof.select(
        "*", (F.col("n_rows") - F.col("null_count")).alias("n_nonnull"),
        ((F.col("null_count") / F.nullif(F.col("n_rows"), F.lit(0))) * F.lit(100.0))
        .alias("null_percentage"))


def _first_of_each(rows: DataFrame, order_col: str, columns: list[str], k: int) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(i).alias("ordinal"),
                 _as_text(q(c), rows.schema[c].dataType).alias("sample_value"))
        for i, c in enumerate(columns)
    ])
    long = rows.select(q(order_col).alias("_order"), F.inline(cells)).filter(
        F.col("sample_value").isNotNull())
    w = Window.partitionBy("ordinal").orderBy(F.col("_order").asc())
    return long.withColumn("sample_rank", F.row_number().over(w)).filter(
        F.col("sample_rank") <= k).select("ordinal", "sample_rank", "sample_value")


def _head(df: DataFrame, order_col: str, columns: list[str], n: int = HEAD_ROWS) -> DataFrame:
    return first_rows(df.select(q(order_col), *[q(c) for c in columns if c != order_col]), order_col, n)


def sample_values(df: DataFrame, order_col: str, columns: list[str] | None = None,
                  k: int = SAMPLE_VALUES, head_rows: int = HEAD_ROWS,
                  head: DataFrame | None = None) -> DataFrame:
    """First ``k`` non-null values of each column in row order, as text.

    Long form: ``column_name, ordinal, sample_rank, sample_value``. Most columns
    find theirs in the first ``head_rows`` rows, which a top-k per task picks;
    a column with fewer there and a full head takes the first ``k`` rows that
    hold a value for it. ``head``: the first ``head_rows`` rows, where known.
    """
    columns = list(columns if columns is not None else [c for c in df.columns if c != order_col])
    if head is None:
        head = _head(df, order_col, columns, head_rows)
    have = head.agg(F.count("*"), *[
        F.count(_as_text(q(c), df.schema[c].dataType)) for c in columns]).first()
    sparse = [i for i in range(len(columns)) if have[0] == head_rows and have[i + 1] < k]
    top = _first_of_each(head, order_col, columns, k).filter(~F.col("ordinal").isin(sparse))
    for i in sparse:
        value = _as_text(q(columns[i]), df.schema[columns[i]].dataType)
        first = df.select(q(order_col).alias("_order"), value.alias("sample_value")).filter(
            F.col("sample_value").isNotNull()).orderBy("_order").limit(k)
        rank = F.row_number().over(Window.orderBy("_order"))      # over k rows
        top = top.unionByName(first.select(F.lit(i).alias("ordinal"), rank.alias("sample_rank"),
                                           "sample_value"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("ordinal") + 1)
    return top.select(names.alias("column_name"), "ordinal", "sample_rank", "sample_value")


def sample_arrays(samples: DataFrame) -> DataFrame:
    """Long samples -> one row per column with ``sample_values`` ARRAY<STRING> (<= k each)."""
    return samples.groupBy("ordinal").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sample_rank", "sample_value"))),
                    lambda s: s["sample_value"]).alias("sample_values"))


def suggest_mapping_expr(name: Column) -> Column:
    """Field suggested by a column name: the first field with a contained keyword.

    One alternation per field: a regex search for any of the field's keywords
    is the same test as "some keyword is contained".
    """
    import re

    n = F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    out = None
    for field, keywords in COLUMN_KEYWORDS:
        cond = n.rlike("|".join(re.escape(kw) for kw in keywords))
        out = F.when(cond, F.lit(field)) if out is None else out.when(cond, F.lit(field))
    return out


def label_expr() -> Column:
    """Type label from a profile row joined with its first sample.

    Needs ``family, n_nonnull, unique_count, n_label_words, n_fraction`` and
    ``first_value`` (the first non-null value as text).
    """
    fam = F.col("family")
    nonnull, uniq = F.col("n_nonnull"), F.col("unique_count")
    first_ts = F.col("first_value").try_cast("timestamp_ntz")
    categorical = ((uniq / nonnull) < F.lit(CATEGORICAL_RATIO)) & (uniq < F.lit(CATEGORICAL_MAX_DISTINCT))
    return (F.when(nonnull == 0, F.lit(LABEL_UNKNOWN))
             .when(fam == "date", F.lit(LABEL_DATE))
             .when(fam == "timestamp",
                   F.when(is_midnight(first_ts), F.lit(LABEL_DATE)).otherwise(F.lit(LABEL_DATETIME)))
             .when(fam == "integral", F.lit(LABEL_INTEGER))
             .when(fam == "fractional",
                   F.when(F.col("n_fraction") == 0, F.lit(LABEL_INTEGER)).otherwise(F.lit(LABEL_NUMERIC)))
             .when(fam == "boolean", F.lit(LABEL_BOOLEAN))
             .when(F.col("n_label_words") == nonnull, F.lit(LABEL_BOOLEAN))
             .when(categorical, F.lit(LABEL_CATEGORICAL))
             .otherwise(F.lit(LABEL_STRING)))


def detect_schema(df: DataFrame, order_col: str, columns: list[str] | None = None,
                  with_samples: bool = True, as_of=None,
                  coerced: dict[str, int] | None = None, head: DataFrame | None = None) -> DataFrame:
    """One row per column: ``column_name, ordinal, detected_type,
    suggested_mapping, null_count, null_percentage, unique_count,
    coerced_count``, ``sample_values`` (when ``with_samples``) and the profile
    counts used by validation.

    ``coerced`` says per column how many present values the chosen type could
    not hold (``cleaning.TypePlan.coerced``); they are nulls in ``df``. ``head``: the first
    HEAD_ROWS rows of ``df`` by ``order_col``, the date columns at least, and all with samples.
    Give it where ``df`` is converted, from the frame before conversions (see ``preview``).
    """
    columns = list(columns if columns is not None else [c for c in df.columns if c != order_col])
    if head is None and with_samples:
        head = _head(df, order_col, columns)
    out = profile_columns(df, columns, order_col, as_of, head)
    if with_samples:
        arrays = sample_arrays(sample_values(df, order_col, columns, head=head))
        out = out.join(arrays, "ordinal", "left").withColumn(
            "sample_values", F.coalesce(F.col("sample_values"), F.array().cast("array<string>")))
    lost = F.array(*[F.lit(int((coerced or {}).get(c, 0))).cast("bigint") for c in columns])
    return out.select(*[c for c in out.columns if c != "first_value"],
                      F.get(lost, F.col("ordinal")).alias("coerced_count"),
                      label_expr().alias("detected_type"),
                      suggest_mapping_expr(F.col("column_name")).alias("suggested_mapping"))


def key_aggregates() -> list[Column]:
    """Suggested date and SKU columns, row count and column count, as aggregates."""
    is_date = ((F.col("suggested_mapping") == "date")
               & F.col("detected_type").isin(LABEL_DATE, LABEL_DATETIME))
    is_sku = F.col("suggested_mapping") == "sku"
    return [
        F.min_by(F.col("column_name"), F.when(is_date, F.col("ordinal"))).alias("suggested_date_column"),
        F.min_by(F.col("column_name"), F.when(is_sku, F.col("ordinal"))).alias("suggested_sku_column"),
        F.coalesce(F.max("n_rows"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
    ]


def suggested_keys(schema: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (per file, given the columns ``by`` that name one): the first date-like column
    suggested as ``date`` and the first column suggested as ``sku`` (by position), each
    null when there is none; plus row and column counts."""
    return schema.groupBy(*(by or [])).agg(*key_aggregates())


def schema_document(schema: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The whole detected schema as one nested row (per file, given ``by``) for the registry."""
    info = F.struct(
        F.col("column_name").alias("name"), "detected_type", "suggested_mapping", "null_count",
        "null_percentage", "unique_count", "sample_values", "coerced_count")
    cols = F.array_sort(F.collect_list(F.struct("ordinal", info.alias("info"))))
    doc = schema.groupBy(*(by or [])).agg(cols.alias("cols"), *key_aggregates())
    return doc.select(*(by or []), F.struct(
        F.transform("cols", lambda s: s["info"]).alias("columns"),
        "row_count", "column_count",
        "suggested_date_column", "suggested_sku_column").alias("detected_schema"))


def preview(df: DataFrame, order_col: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows in row order, JSON-safe (no NaN/Inf, ISO timestamps).

    Give the frame before conversions where there are any (``cleaning.apply_types``
    of ``cleaning.first_rows``): conversions below the sort run on every row.
    """
    return json_safe(first_rows(df, order_col, n))
