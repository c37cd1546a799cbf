"""Data-quality rules with graded severities, and the validation report.

Every rule of a validation is evaluated from the column profile (one row per
column), which counts what they need in its own pass: no rule reads the data
again, and no data row reaches the driver. ``date_rule_counts`` and
``numeric_rule_counts`` count the same from a frame that has no profile, with
one aggregate each.

Issue rows: ``rule_order, seq, severity, type, column, message, suggestion``.
``rule_order`` keeps the report order: structure, missing values, dates,
numbers; ``seq`` orders issues within a rule (column position).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.constants import (
    ERROR,
    INFO,
    ISSUE_TEXT,
    LABEL_INTEGER,
    LABEL_NUMERIC,
    MAX_COLUMNS,
    MIN_COLUMNS,
    MISSING_ERROR_PCT,
    MISSING_WARNING_PCT,
    OLD_DATE,
    SHORT_RANGE_DAYS,
    SUMMARY_CLEAN,
    SUMMARY_ERRORS,
    SUMMARY_WARNINGS,
    WARNING,
    ZERO_SHARE,
)
from ledgerloom.functions.display import one_decimal
from ledgerloom.functions.timeutil import as_of_column, whole_days_between
from ledgerloom.operators.cleaning import q

ISSUE_COLUMNS = ["rule_order", "seq", "severity", "type", "column", "message", "suggestion"]
RULE_STRUCTURE, RULE_MISSING, RULE_DATE, RULE_NUMERIC = 1, 2, 3, 4

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` placeholders of a fixed text with column values."""
    parts, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)].cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def issue(rule: int, seq: Column, severity: str, kind: str, column: Column | None,
          **values: Column) -> Column:
    message, suggestion = ISSUE_TEXT[kind]
    return F.struct(
        F.lit(rule).alias("rule_order"), seq.cast("int").alias("seq"),
        F.lit(severity).alias("severity"), F.lit(kind).alias("type"),
        (column if column is not None else F.lit(None)).cast("string").alias("column"),
        render(message, **values).alias("message"), F.lit(suggestion).alias("suggestion"))


def _explode_issues(df: DataFrame, candidates: list[Column], by: list[str] | None = None) -> DataFrame:
    """Each candidate is a ``when(condition, issue(...))``; keep the ones that fire.

    ``by`` are columns that name the file, where the frame holds several.
    """
    return (df.select(*(by or []), F.explode(F.array(*candidates)).alias("i"))
              .filter(F.col("i").isNotNull()).select(*(by or []), "i.*"))


# ---------------------------------------------------------------------------
# Rules
# ---------------------------------------------------------------------------

def structure_issues(keys: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Empty file (error), more than 50 columns (warning), fewer than 2 (error).

    ``keys`` is the one-row ``suggested_keys`` frame (``row_count``, ``column_count``).
    """
    n_rows, n_cols = F.col("row_count"), F.col("column_count")
    return _explode_issues(keys, [
        F.when(n_rows == 0, issue(RULE_STRUCTURE, F.lit(1), ERROR, "empty_file", None)),
        F.when(n_cols > MAX_COLUMNS,
               issue(RULE_STRUCTURE, F.lit(2), WARNING, "too_many_columns", None, n=n_cols)),
        F.when(n_cols < MIN_COLUMNS, issue(RULE_STRUCTURE, F.lit(3), ERROR, "too_few_columns", None)),
    ], by)


def missing_value_issues(schema: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per column by null %: > 50 error, > 20 warning, > 0 info."""
    pct, name, seq = F.col("null_percentage"), F.col("column_name"), F.col("ordinal")
    shown = one_decimal(pct)
    one = (F.when(pct > MISSING_ERROR_PCT,
                  issue(RULE_MISSING, seq, ERROR, "excessive_missing_values", name, col=name, pct=shown))
            .when(pct > MISSING_WARNING_PCT,
                  issue(RULE_MISSING, seq, WARNING, "high_missing_values", name, col=name, pct=shown))
            .when(pct > 0,
                  issue(RULE_MISSING, seq, INFO, "missing_values", name, col=name, pct=shown)))
    return _explode_issues(schema, [one], by)


def date_rule_counts(df: DataFrame, date_col: str, as_of=None) -> DataFrame:
    """One row: parsed dates, range, whole days spanned, rows after ``as_of``
    and rows before 2000-01-01 in ``date_col``."""
    d = q(date_col).cast("timestamp_ntz")
    now = as_of_column(as_of)
    old = F.lit(OLD_DATE).cast("timestamp_ntz")
    counts = df.agg(
        F.count(d).alias("n_valid"),
        F.min(d).alias("min_date"),
        F.max(d).alias("max_date"),
        F.count_if(d > now).alias("n_future"),
        F.count_if(d < old).alias("n_old"),
    )
    return counts.select(
        F.lit(date_col).alias("column_name"), "n_valid", "min_date", "max_date",
        whole_days_between(F.col("min_date"), F.col("max_date")).alias("span_days"),
        "n_future", "n_old",
        (F.col("max_date") > now).alias("has_future"), (F.col("min_date") < old).alias("has_old"))


def date_issues(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """No parsed date: error (and no further date rule). Otherwise warnings for
    dates after ``as_of``, dates before 2000, and a span under 30 days."""
    name = F.col("column_name")
    none = F.col("n_valid") == 0
    return _explode_issues(counts, [
        F.when(none, issue(RULE_DATE, F.lit(1), ERROR, "invalid_dates", name, col=name)),
        F.when(~none & F.col("has_future"),
               issue(RULE_DATE, F.lit(2), WARNING, "future_dates", name, n=F.col("n_future"))),
        F.when(~none & F.col("has_old"),
               issue(RULE_DATE, F.lit(3), WARNING, "very_old_dates", name, n=F.col("n_old"))),
        F.when(~none & (F.col("span_days") < SHORT_RANGE_DAYS),
               issue(RULE_DATE, F.lit(4), WARNING, "short_date_range", name, days=F.col("span_days"))),
    ], by)


def numeric_rule_counts(df: DataFrame, columns: list[str],
                        ordinals: list[int] | None = None) -> DataFrame:
    """One row per numeric column: all rows, negative values, zero values.

    ``ordinals`` are the columns' positions in the file (default: list order).
    """
    ordinals = list(ordinals) if ordinals is not None else list(range(len(columns)))
    schema = "column_name string, ordinal int, n_rows bigint, n_negative bigint, n_zero bigint"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(columns):
        x = q(c).cast("double")
        aggs += [F.count_if(x < 0).alias(f"neg{i}"), F.count_if(x == 0).alias(f"zero{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(ordinals[i]).alias("ordinal"),
                              F.col(f"neg{i}").alias("n_negative"), F.col(f"zero{i}").alias("n_zero"))
                     for i, c in enumerate(columns)])
    return wide.select("n_rows", F.inline(rows)).select(
        "column_name", "ordinal", "n_rows", "n_negative", "n_zero")


def numeric_issues(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Negative values: info with the count. Zeros in more than half of all rows: warning."""
    name, seq = F.col("column_name"), F.col("ordinal")
    return _explode_issues(counts, [
        F.when(F.col("n_negative") > 0,
               issue(RULE_NUMERIC, seq * 2, INFO, "negative_values", name,
                     n=F.col("n_negative"), col=name)),
        F.when(F.col("n_zero") > F.col("n_rows") * F.lit(ZERO_SHARE),
               issue(RULE_NUMERIC, seq * 2 + 1, WARNING, "many_zeros", name, col=name)),
    ], by)


# ---------------------------------------------------------------------------
# Whole validation
# ---------------------------------------------------------------------------

def profile_date_counts(schema: DataFrame, as_of=None, by: list[str] | None = None) -> DataFrame:
    """The date rules' counts for the suggested date column, from its profile row."""
    from ledgerloom.operators.profiling import key_aggregates

    by = by or []
    now, old = as_of_column(as_of), F.lit(OLD_DATE).cast("timestamp_ntz")
    target = schema.groupBy(*by).agg(*key_aggregates()).select(
        *[F.col(k).alias(f"_{k}") for k in by], F.col("suggested_date_column").alias("_target"))
    on = F.col("column_name") == F.col("_target")
    for k in by:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return schema.join(target if by else F.broadcast(target), on).select(
        *by, "column_name", F.col("n_nonnull").alias("n_valid"), "min_date", "max_date",
        whole_days_between(F.col("min_date"), F.col("max_date")).alias("span_days"),
        "n_future", "n_old",
        (F.col("max_date") > now).alias("has_future"), (F.col("min_date") < old).alias("has_old"))


def profile_numeric_counts(schema: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The number rules' counts for every number column, from the profile."""
    return schema.filter(F.col("detected_type").isin(LABEL_NUMERIC, LABEL_INTEGER)).select(
        *(by or []), "column_name", "ordinal", "n_rows", "n_negative", "n_zero")


def validation_issues(schema: DataFrame, as_of=None, by: list[str] | None = None,
                      keys: DataFrame | None = None) -> DataFrame:
    """All issues in report order: structure, missing values, dates, numbers.

    ``schema`` comes from ``profiling.detect_schema`` with the same ``as_of``. With ``by``,
    the columns that name a file, it holds the columns of many files and the issues
    carry them; ``keys`` then adds files without any column (``by``, ``row_count``,
    ``column_count``).
    """
    from ledgerloom.operators.profiling import suggested_keys
    from ledgerloom.session import checkpointed

    schema = checkpointed(schema)      # one row per column, read by every rule
    parts = [structure_issues(keys if keys is not None else suggested_keys(schema, by), by),
             missing_value_issues(schema, by), date_issues(profile_date_counts(schema, as_of, by), by),
             numeric_issues(profile_numeric_counts(schema, by), by)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*(by or []), *ISSUE_COLUMNS)


def validation_report(issues: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: ``is_valid, total_issues, errors, warnings, infos, issues, summary``.

    With ``files`` (the columns that name a file, a row for each) one row per
    file, also for those without an issue.
    """
    by = files.columns if files is not None else []
    rows = files.join(issues, by, "left") if by else issues
    sev, found = F.col("severity"), F.col("severity").isNotNull()
    body = F.struct(*[F.col(c) for c in ["severity", "type", "column", "message", "suggestion"]])
    agg = rows.groupBy(*by).agg(
        F.count_if(found).alias("total_issues"),
        F.count_if(sev == ERROR).alias("errors"),
        F.count_if(sev == WARNING).alias("warnings"),
        F.count_if(sev == INFO).alias("infos"),
        F.array_sort(F.collect_list(F.when(found, F.struct("rule_order", "seq", body.alias("issue")))))
        .alias("ordered"),
    )
    summary = (F.when(F.col("errors") > 0, render(SUMMARY_ERRORS, n=F.col("errors")))
                .when(F.col("warnings") > 0, render(SUMMARY_WARNINGS, n=F.col("warnings")))
                .otherwise(F.lit(SUMMARY_CLEAN)))
    return agg.select(
        *by, (F.col("errors") == 0).alias("is_valid"), "total_issues", "errors", "warnings", "infos",
        F.transform("ordered", lambda s: s["issue"]).alias("issues"), summary.alias("summary"))


def badge_expr() -> Column:
    """Worst severity present in a report, else ``ok``."""
    return (F.when(F.col("errors") > 0, F.lit(ERROR))
             .when(F.col("warnings") > 0, F.lit(WARNING))
             .when(F.col("infos") > 0, F.lit(INFO))
             .otherwise(F.lit("ok")))


def validation_badge(report: DataFrame) -> DataFrame:
    return report.select(badge_expr().alias("badge"), "is_valid", "errors", "warnings", "infos")
