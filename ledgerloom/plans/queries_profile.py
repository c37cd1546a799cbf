"""Stage 3: column profiles, labels, suggestions, samples and previews.

Input is the typed ``raw_sales`` (the result of inference); row order is the
hash ``id``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.display import (
    dash_if_null,
    first_two_samples,
    grouped_count,
    json_safe,
    money,
)
from ledgerloom.operators import cleaning as C
from ledgerloom.operators import profiling as P
from ledgerloom.operators import sales as S
from ledgerloom.plans import sqltext as Q
from ledgerloom.plans.catalog import query
from ledgerloom.plans.queries_cleaning import (
    AS_OF,
    RAW_COLS,
    RAW_TYPES,
    _with_raw,
    raw,
    typed,
)
from ledgerloom.plans.queries_sales import _SUMMARY_BY_UPLOAD_SQL
from ledgerloom.sources import fixtures as X

FAMILY = {"timestamp_ntz": "timestamp", "bigint": "integral", "double": "fractional",
          "string": "text"}


def _schema(spark, sf, with_samples=False):
    # The types come from all rows; of the first ones, only these are converted.
    r = raw(spark, sf)
    plan = C.plan_types(r, RAW_COLS)
    shown = RAW_COLS if with_samples else [c for c in RAW_COLS if plan.types[c] == "timestamp_ntz"]
    head = C.apply_types(C.first_rows(r.select("id", *shown), "id", P.HEAD_ROWS), plan) if shown else None
    return P.detect_schema(C.infer_types(r, RAW_COLS, plan), "id", RAW_COLS, with_samples=with_samples,
                           as_of=AS_OF, head=head)


# --- oracle building blocks ------------------------------------------------

def _profile_sql(i: int, c: str) -> str:
    t = RAW_TYPES[c]
    frac = (f"count(*) filter (where coalesce({c} != floor({c}), false))" if t == "double" else "0")
    first = f"arg_min(cast({c} as varchar), id) filter (where {c} is not null)"
    return (f"select '{c}' as column_name, {i} as ordinal, '{FAMILY[t]}' as family, "
            f"count(*) as n_rows, count(*) - count({c}) as null_count, "
            f"count(distinct {c}) as unique_count, "
            f"count(*) filter (where coalesce({Q.boolean_label_text(f'cast({c} as varchar)')}, false)) as n_label_words, "
            f"{frac} as n_fraction, count({c}) as n_nonnull, "
            f"cast(count(*) - count({c}) as double) / nullif(count(*), 0) * 100.0 as null_percentage, "
            f"{first} as first_value from typed")


_PROFILE_SQL = "\nunion all\n".join(_profile_sql(i, c) for i, c in enumerate(RAW_COLS))


def _label_sql() -> str:
    ts = "try_cast(first_value as timestamp)"
    midnight = f"(hour({ts}) = 0 and minute({ts}) = 0 and second({ts}) = 0)"
    return (
        "case when n_nonnull = 0 then 'unknown' "
        f"when family = 'timestamp' then (case when {midnight} then 'date' else 'datetime' end) "
        "when family = 'integral' then 'integer' "
        "when family = 'fractional' then (case when n_fraction = 0 then 'integer' else 'numeric' end) "
        "when n_label_words = n_nonnull then 'boolean' "
        "when unique_count / n_nonnull < 0.1 and unique_count < 50 then 'categorical' "
        "else 'string' end")


# FIXED VALUES: the keywords of each field, in order, stated again for the oracle.
_FIELD_WORDS = [
    ("date", ["date", "day", "time", "timestamp", "datetime", "dt", "period"]),
    ("sku", ["sku", "product_id", "item_id", "product_code", "item_code", "id"]),
    ("quantity", ["quantity", "qty", "amount", "count", "units", "volume"]),
    ("revenue", ["revenue", "sales", "price", "total", "amount", "value", "turnover"]),
    ("stock", ["stock", "inventory", "on_hand", "available", "balance"]),
    ("category", ["category", "type", "group", "department", "class", "segment"]),
]


def _suggest_sql(name: str) -> str:
    n = f"replace(replace(lower({name}), ' ', '_'), '-', '_')"
    arms = " ".join(f"when contains({n}, '{kw}') then '{field}'"
                    for field, kws in _FIELD_WORDS for kw in kws)
    return f"(case {arms} end)"


_LABELS_SQL = (f"select *, {_label_sql()} as detected_type, {_suggest_sql('column_name')} "
               "as suggested_mapping from profile")


def _samples_sql(i: int, c: str) -> str:
    return (f"select '{c}' as column_name, {i} as ordinal, sample_rank, sample_value from "
            f"(select cast({c} as varchar) as sample_value, cast(row_number() over (order by id) as integer) as sample_rank "
            f"from typed where {c} is not null) where sample_rank <= 5")


_SAMPLES_SQL = "\nunion all\n".join(_samples_sql(i, c) for i, c in enumerate(RAW_COLS))


def _profile_query(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    base = _with_raw("select 1", "typed")
    ctes = [("profile", _PROFILE_SQL), ("labels", _LABELS_SQL)] + list(extra or [])
    head = base[: base.rindex("\nselect 1")]
    return head + ",\n" + ",\n".join(f"{n} as (\n{b}\n)" for n, b in ctes) + "\n" + body


# --- queries -----------------------------------------------------------------

_PROFILE_COLS = ["column_name", "ordinal", "family", "n_rows", "null_count", "unique_count",
                 "n_label_words", "n_fraction", "n_nonnull", "null_percentage"]


@query("column_profile", _profile_query("select " + ", ".join(_PROFILE_COLS) + " from profile"))
def q_column_profile(spark, sf):
    return P.profile_columns(typed(spark, sf), RAW_COLS).select(*_PROFILE_COLS)


@query("sample_values", _profile_query("select * from samples", [("samples", _SAMPLES_SQL)]))
def q_sample_values(spark, sf):
    return P.sample_values(typed(spark, sf), "id", RAW_COLS)


@query("detect_types", _profile_query("select column_name, ordinal, detected_type from labels"))
def q_detect_types(spark, sf):
    return _schema(spark, sf).select("column_name", "ordinal", "detected_type")


# Column headers as files spell them, one per part.
_HEADERS = ["Order Date", "SKU", "Qty Sold", "Unit-Price", "On Hand", "Product Type", "Notes",
            "Time Stamp", "item code", "Sales Amount", "Inventory", "Segment", "Color"]
_HEADER_LIST = ", ".join(f"'{h}'" for h in _HEADERS)


@query("suggest_mapping", f"select p_partkey, header, {_suggest_sql('header')} as suggested_mapping "
       f"from (select p_partkey, [{_HEADER_LIST}][p_partkey % {len(_HEADERS)} + 1] || ' ' || p_type as header "
       "from part)")
def q_suggest_mapping(spark, sf):
    part = X.table(spark, sf, "part").select("p_partkey", "p_type")
    names = F.array(*[F.lit(h) for h in _HEADERS])
    header = F.concat(F.get(names, (F.col("p_partkey") % len(_HEADERS)).cast("int")), F.lit(" "),
                      F.col("p_type"))
    return part.select("p_partkey", header.alias("header")).withColumn(
        "suggested_mapping", P.suggest_mapping_expr(F.col("header")))


@query("suggested_keys", _profile_query(
    "select arg_min(column_name, ordinal) filter (where suggested_mapping = 'date' and "
    "detected_type in ('date', 'datetime')) as suggested_date_column, "
    "arg_min(column_name, ordinal) filter (where suggested_mapping = 'sku') as suggested_sku_column, "
    "coalesce(max(n_rows), 0) as row_count, count(*) as column_count from labels"))
def q_suggested_keys(spark, sf):
    return P.suggested_keys(_schema(spark, sf))


@query("detect_schema", _profile_query(
    "select l.column_name, l.ordinal, detected_type, suggested_mapping, null_count, null_percentage, "
    "unique_count, coalesce(s.sample_text, '') as sample_text from labels l left join "
    "(select ordinal, string_agg(sample_value, '|' order by sample_rank) as sample_text from samples "
    "group by ordinal) s on l.ordinal = s.ordinal", [("samples", _SAMPLES_SQL)]))
def q_detect_schema(spark, sf):
    return _schema(spark, sf, with_samples=True).select(
        "column_name", "ordinal", "detected_type", "suggested_mapping", "null_count",
        "null_percentage", "unique_count", F.array_join("sample_values", "|").alias("sample_text"))


@query("display_columns", _profile_query(
    "select l.column_name, l.ordinal, coalesce(s.first_two, '') as first_samples, "
    "format('{:,}', unique_count) as unique_text, coalesce(suggested_mapping, '-') as mapping_text "
    "from labels l left join (select ordinal, string_agg(sample_value, ', ' order by sample_rank) "
    "filter (where sample_rank <= 2) as first_two from samples group by ordinal) s "
    "on l.ordinal = s.ordinal", [("samples", _SAMPLES_SQL)]))
def q_display_columns(spark, sf):
    return _schema(spark, sf, with_samples=True).select(
        "column_name", "ordinal", first_two_samples(F.col("sample_values")).alias("first_samples"),
        grouped_count(F.col("unique_count")).alias("unique_text"),
        dash_if_null(F.col("suggested_mapping")).alias("mapping_text"))


@query("display_summary", X.with_views(
    "select upload_id, format('{:,.2f}', total_revenue) as revenue_text, "
    "format('{:,.2f}', average_revenue) as average_revenue_text, "
    "format('{:,}', total_records) as records_text, "
    "coalesce(strftime(end_date, '%Y-%m-%d'), '-') as end_text from summary",
    "sales", ctes=[("summary", _SUMMARY_BY_UPLOAD_SQL)]))
def q_display_summary(spark, sf):
    s = S.sales_summary(X.sales(spark, sf))
    return s.select("upload_id", money(F.col("total_revenue")).alias("revenue_text"),
                    money(F.col("average_revenue")).alias("average_revenue_text"),
                    grouped_count(F.col("total_records")).alias("records_text"),
                    dash_if_null(F.date_format("end_date", "yyyy-MM-dd")).alias("end_text"))


@query("preview_raw", _with_raw("select * from r order by id limit 10", "r"))
def q_preview_raw(spark, sf):
    return P.preview(raw(spark, sf), "id")


def _json_safe_sql(c: str) -> str:
    t = RAW_TYPES[c]
    if t == "timestamp_ntz":
        return f"{Q.iso(c)} as {c}"
    if t == "double":
        return f"(case when isnan({c}) or isinf({c}) then null else {c} end) as {c}"
    return c


@query("json_safe_preview", _with_raw(
    "select id, " + ", ".join(_json_safe_sql(c) for c in RAW_COLS) + " from typed order by id limit 10",
    "typed"))
def q_json_safe_preview(spark, sf):
    # The types come from all rows; only the previewed ones are converted.
    r = raw(spark, sf)
    plan = C.plan_types(r, RAW_COLS)
    return json_safe(C.apply_types(C.first_rows(r, "id", 10), plan))


_MAPPED = {c: X.RAW_MAPPING.get(c, c) for c in RAW_COLS}


@query("preview_cleaned", _with_raw(
    "select id, " + ", ".join(
        (f"{Q.iso(c)} as {n}" if RAW_TYPES[c] == "timestamp_ntz" else f"{c} as {n}")
        for c, n in _MAPPED.items())
    + ", cast(0.0 as double) as sales_revenue from filled order by id limit 20", "filled"))
def q_preview_cleaned(spark, sf):
    cleaned = C.clean_dataframe(raw(spark, sf), as_of=AS_OF, keep=["id"], first=("id", 20))
    return json_safe(C.conform_defaults(cleaned, X.RAW_MAPPING, as_of=AS_OF))
