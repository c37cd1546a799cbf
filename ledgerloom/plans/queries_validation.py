"""Stage 4: data-quality rules, the issue list, the report and its badge.

Date and numeric rule counts read the conformed ``sales`` view; missing-value
issues and the whole validation read the typed ``raw_sales``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.constants import ISSUE_TEXT, OLD_DATE, SUMMARY_CLEAN, SUMMARY_ERRORS, SUMMARY_WARNINGS
from ledgerloom.functions.display import json_safe
from ledgerloom.functions.parsing import parse_datetime
from ledgerloom.operators import profiling as P
from ledgerloom.operators import validation as V
from ledgerloom.plans.catalog import query
from ledgerloom.plans.queries_cleaning import AS_OF, RAW_COLS, RAW_TYPES
from ledgerloom.plans.queries_profile import _profile_query, _schema
from ledgerloom.sources import fixtures as X

SALES_NUMERIC = ["sales_quantity", "sales_revenue", "stock_level", "unit_price"]
AS_OF_SQL = f"timestamp '{AS_OF} 00:00:00'"


def _text(kind: str) -> tuple[str, str]:
    return ISSUE_TEXT[kind]


def _sql_render(template: str, **values: str) -> str:
    """SQL concatenation for a fixed text with ``{name}`` placeholders."""
    import re

    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append("'" + template[pos:m.start()].replace("'", "''") + "'")
        parts.append(f"cast({values[m.group(1)]} as varchar)")
        pos = m.end()
    if pos < len(template):
        parts.append("'" + template[pos:].replace("'", "''") + "'")
    return " || ".join(parts)


def _issue_sql(rule: int, seq: str, severity: str, kind: str, column: str | None,
               source: str, where: str, **values: str) -> str:
    msg, sugg = _text(kind)
    col = column if column is not None else "cast(null as varchar)"
    return (f"select {rule} as rule_order, cast({seq} as integer) as seq, '{severity}' as severity, "
            f"'{kind}' as type, {col} as \"column\", {_sql_render(msg, **values)} as message, "
            f"'{sugg}' as suggestion from {source} where {where}")


# --- SQL pieces -------------------------------------------------------------------

def _date_counts_sql(table: str, col: str) -> str:
    return (f"select '{col}' as column_name, count({col}) as n_valid, min({col}) as min_date, "
            f"max({col}) as max_date, (epoch_us(max({col})) - epoch_us(min({col}))) // 86400000000 "
            f"as span_days, count(*) filter (where {col} > {AS_OF_SQL}) as n_future, "
            f"count(*) filter (where {col} < timestamp '{OLD_DATE} 00:00:00') as n_old, "
            f"max({col}) > {AS_OF_SQL} as has_future, "
            f"min({col}) < timestamp '{OLD_DATE} 00:00:00' as has_old from {table}")


def _date_issues_sql(src: str) -> str:
    return "\nunion all\n".join([
        _issue_sql(3, "1", "error", "invalid_dates", "column_name", src, "n_valid = 0",
                   col="column_name"),
        _issue_sql(3, "2", "warning", "future_dates", "column_name", src,
                   "n_valid > 0 and has_future", n="n_future"),
        _issue_sql(3, "3", "warning", "very_old_dates", "column_name", src,
                   "n_valid > 0 and has_old", n="n_old"),
        _issue_sql(3, "4", "warning", "short_date_range", "column_name", src,
                   "n_valid > 0 and span_days < 30", days="span_days"),
    ])


def _numeric_counts_sql(table: str, cols: list[tuple[int, str]]) -> str:
    return "\nunion all\n".join(
        f"select '{c}' as column_name, {o} as ordinal, count(*) as n_rows, "
        f"count(*) filter (where coalesce(cast({c} as double) < 0, false)) as n_negative, "
        f"count(*) filter (where coalesce(cast({c} as double) = 0, false)) as n_zero from {table}"
        for o, c in cols)


def _numeric_issues_sql(src: str) -> str:
    return "\nunion all\n".join([
        _issue_sql(4, "ordinal * 2", "info", "negative_values", "column_name", src, "n_negative > 0",
                   n="n_negative", col="column_name"),
        _issue_sql(4, "ordinal * 2 + 1", "warning", "many_zeros", "column_name", src,
                   "n_zero > n_rows * 0.5", col="column_name"),
    ])


def _missing_sql(src: str) -> str:
    pct = "printf('%.1f', null_percentage)"
    return "\nunion all\n".join([
        _issue_sql(2, "ordinal", "error", "excessive_missing_values", "column_name", src,
                   "null_percentage > 50", col="column_name", pct=pct),
        _issue_sql(2, "ordinal", "warning", "high_missing_values", "column_name", src,
                   "null_percentage > 20 and null_percentage <= 50", col="column_name", pct=pct),
        _issue_sql(2, "ordinal", "info", "missing_values", "column_name", src,
                   "null_percentage > 0 and null_percentage <= 20", col="column_name", pct=pct),
    ])


def _structure_sql() -> str:
    n_cols = len(RAW_COLS)
    return "\nunion all\n".join([
        _issue_sql(1, "1", "error", "empty_file", None, "(select count(*) as n from typed)", "n = 0"),
        _issue_sql(1, "2", "warning", "too_many_columns", None, "(select 1)", f"{n_cols} > 50",
                   n=str(n_cols)),
        _issue_sql(1, "3", "error", "too_few_columns", None, "(select 1)", f"{n_cols} < 2"),
    ])


_RAW_NUMERIC = [(i, c) for i, c in enumerate(RAW_COLS) if RAW_TYPES[c] in ("bigint", "double")]
_ISSUES_CTES = [
    ("dcounts", _date_counts_sql("typed", "order_date")),
    ("ncounts", _numeric_counts_sql("typed", _RAW_NUMERIC)),
    ("issues", "\nunion all\n".join([_structure_sql(), _missing_sql("profile"),
                                      _date_issues_sql("dcounts"), _numeric_issues_sql("ncounts")])),
]


def _report_sql() -> str:
    errors = "count(*) filter (where severity = 'error')"
    warnings = "count(*) filter (where severity = 'warning')"
    summary = (f"case when {errors} > 0 then {_sql_render(SUMMARY_ERRORS, n=errors)} "
               f"when {warnings} > 0 then {_sql_render(SUMMARY_WARNINGS, n=warnings)} "
               f"else '{SUMMARY_CLEAN}' end")
    listing = ("coalesce(string_agg(severity || ':' || type || ':' || coalesce(\"column\", ''), ',' "
               "order by rule_order, seq), '')")
    return (f"select {errors} = 0 as is_valid, count(*) as total_issues, {errors} as errors, "
            f"{warnings} as warnings, count(*) filter (where severity = 'info') as infos, "
            f"{listing} as issue_list, {summary} as summary from issues")


def _issue_list(report, *by):
    listing = F.transform("issues", lambda i: F.concat_ws(
        ":", i["severity"], i["type"], F.coalesce(i["column"], F.lit(""))))
    return report.select(*by, "is_valid", "total_issues", "errors", "warnings", "infos",
                         F.array_join(listing, ",").alias("issue_list"), "summary")


# --- queries -----------------------------------------------------------------

@query("missing_value_issues", _profile_query(_missing_sql("profile")))
def q_missing_value_issues(spark, sf):
    return V.missing_value_issues(_schema(spark, sf))


@query("date_rule_counts", X.with_views(_date_counts_sql("sales", "date"), "sales"))
def q_date_rule_counts(spark, sf):
    return V.date_rule_counts(X.sales(spark, sf), "date", AS_OF)


@query("date_issues", X.with_views(_date_issues_sql("dcounts"), "sales",
                                   ctes=[("dcounts", _date_counts_sql("sales", "date"))]))
def q_date_issues(spark, sf):
    return V.date_issues(V.date_rule_counts(X.sales(spark, sf), "date", AS_OF))


_SALES_NUMERIC = list(enumerate(SALES_NUMERIC))


@query("numeric_rule_counts", X.with_views(_numeric_counts_sql("sales", _SALES_NUMERIC), "sales"))
def q_numeric_rule_counts(spark, sf):
    return V.numeric_rule_counts(X.sales(spark, sf), SALES_NUMERIC)


@query("numeric_issues", X.with_views(_numeric_issues_sql("ncounts"), "sales",
                                      ctes=[("ncounts", _numeric_counts_sql("sales", _SALES_NUMERIC))]))
def q_numeric_issues(spark, sf):
    return V.numeric_issues(V.numeric_rule_counts(X.sales(spark, sf), SALES_NUMERIC))


def _issues(spark, sf):
    return V.validation_issues(_schema(spark, sf), AS_OF)


@query("validation_issues", _profile_query("select * from issues", _ISSUES_CTES))
def q_validation_issues(spark, sf):
    return _issues(spark, sf)


@query("validation_report", _profile_query(_report_sql(), _ISSUES_CTES))
def q_validation_report(spark, sf):
    return _issue_list(V.validation_report(_issues(spark, sf)))


@query("validation_badge", _profile_query(
    "select case when errors > 0 then 'error' when warnings > 0 then 'warning' when infos > 0 "
    "then 'info' else 'ok' end as badge, is_valid, errors, warnings, infos from report",
    _ISSUES_CTES + [("report", _report_sql())]))
def q_validation_badge(spark, sf):
    return V.validation_badge(V.validation_report(_issues(spark, sf)))


# ---------------------------------------------------------------------------
# Frames on which every rule fires, one row each per supplier
# ---------------------------------------------------------------------------

CASES_AS_OF = "2024-01-01"


def _case_frames(spark, sf):
    key = F.col("s_suppkey")
    rows = X.table(spark, sf, "supplier").select("s_suppkey", "s_name")

    def day(first, days):
        return F.date_add(F.lit(first).cast("date"), (key * 37 % days).cast("int")).cast("timestamp_ntz")

    base = rows.select(key.alias("id"), day("2020-01-01", 400).alias("order_date"),
                       F.concat(F.lit("SKU"), key.cast("string")).alias("sku_id"),
                       (key + 1).cast("bigint").alias("qty"), key.alias("k"))

    def gaps(tenths):
        return F.when(F.col("k") % 10 >= tenths, F.col("qty"))

    frames = {
        "clean": base,
        "few gaps": base.withColumn("stock", gaps(1)),
        "many gaps": base.withColumn("stock", gaps(3)),
        "mostly gaps": base.withColumn("stock", gaps(6)),
        "future dates": base.withColumn("order_date", F.col("order_date") + F.expr("interval 3650 days")),
        "old dates": base.withColumn("order_date", F.col("order_date") - F.expr("interval 10950 days")),
        "short range": base.withColumn("order_date", day_of(base, 9)),
        "zeros": base.withColumn("qty", F.when(F.col("k") % 10 >= 6, F.col("qty")).otherwise(0)),
        "negative": base.withColumn("qty", -F.col("qty")),
        "one column": base.select("id", "k", "qty"),
        "wide": base.select("*", *[F.lit(n + 1).alias(f"extra_{n}") for n in range(48)]),
        "empty": base.where("id < 0"),
    }
    return {n: f.drop("k") for n, f in frames.items()}


def day_of(base, days):
    return F.date_add(F.lit("2021-05-01").cast("date"),
                      (F.col("k") % days).cast("int")).cast("timestamp_ntz")


_CASES = [
    ("clean", 0, 0, 0, ""),
    ("few gaps", 0, 0, 1, "info:missing_values:stock"),
    ("many gaps", 0, 1, 0, "warning:high_missing_values:stock"),
    ("mostly gaps", 1, 0, 0, "error:excessive_missing_values:stock"),
    ("future dates", 0, 1, 0, "warning:future_dates:order_date"),
    ("old dates", 0, 1, 0, "warning:very_old_dates:order_date"),
    ("short range", 0, 1, 0, "warning:short_date_range:order_date"),
    ("zeros", 0, 1, 0, "warning:many_zeros:qty"),
    ("negative", 0, 0, 1, "info:negative_values:qty"),
    ("one column", 1, 0, 0, "error:too_few_columns:"),
    ("wide", 0, 1, 0, "warning:too_many_columns:"),
    ("empty", 1, 0, 0, "error:empty_file:"),
]


def _case_sql(name, errors, warnings, infos, issues):
    """What the rules say of a frame, given how it was built; the table only has to have rows."""
    badge = "error" if errors else "warning" if warnings else "info" if infos else "ok"
    summary = (f"File has {errors} error(s) that must be fixed before processing" if errors else
               f"File is valid but has {warnings} warning(s)" if warnings else
               "File validation passed with no issues")
    return (f"select '{name}' as frame, '{badge}' as badge, {str(not errors).lower()} as is_valid, "
            f"{errors}::bigint as errors, {warnings}::bigint as warnings, {infos}::bigint as infos, "
            f"'{issues}' as issue_list, '{summary}' as summary from (select count(*) as n from supplier) where n > 0")


@query("rule_cases", "\nunion all\n".join(_case_sql(*c) for c in _CASES))
def q_rule_cases(spark, sf):
    """One profile of all frames, keyed by (frame, column)."""
    cells = columns = None
    for name, frame in _case_frames(spark, sf).items():
        names = [c for c in frame.columns if c != "id"]
        meta = P.columns_frame(spark, frame, names).select(F.lit(name).alias("frame"), "*")
        family = F.get(F.array(*[F.lit(P.type_family(frame.schema[c].dataType)) for c in names]), F.col("ordinal"))
        part = P.stacked(frame, names, "id").select(F.lit(name).alias("frame"), "*", family.alias("family"))
        cells, columns = (part, meta) if cells is None else (cells.unionByName(part), columns.unionByName(meta))
    keys = ["frame", "ordinal"]
    profile = P.profiled(columns, P.profile_cells(cells, keys, CASES_AS_OF), keys)
    schema = profile.select("*", P.label_expr().alias("detected_type"),
                            P.suggest_mapping_expr(F.col("column_name")).alias("suggested_mapping"))
    issues = V.validation_issues(schema, CASES_AS_OF, ["frame"])
    report = V.validation_report(issues, columns.select("frame").distinct())
    return _issue_list(report, "frame").withColumn("badge", V.badge_expr()).select(
        "frame", "badge", "is_valid", "errors", "warnings", "infos", "issue_list", "summary")


@query("invalid_dates", "select 3 as rule_order, 1 as seq, 'error' as severity, 'invalid_dates' as type, "
       "'date' as \"column\" from (select count(*) as n from orders) where n > 0")
def q_invalid_dates(spark, sf):
    """A date column in which nothing reads as a date."""
    dates = X.table(spark, sf, "orders").select(
        parse_datetime(F.col("o_orderpriority")).alias("date"))
    return V.date_issues(V.date_rule_counts(dates, "date", AS_OF)).select(
        "rule_order", "seq", "severity", "type", "column")


@query("json_safe_values", "select l_orderkey, l_linenumber, l_partkey, case when l_orderkey % 5 = 0 or "
       "l_orderkey % 7 = 0 then null else l_quantity end as x, "
       "strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') as shipped from lineitem")
def q_json_safe_values(spark, sf):
    k = F.col("l_orderkey")
    x = F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(float("-inf"))).otherwise(
        F.col("l_quantity"))
    rows = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x.alias("x"),
                                                 F.col("l_shipdate").cast("timestamp_ntz").alias("shipped"))
    return json_safe(rows)
