"""Presentation helpers: JSON-safe values and display strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.timeutil import isoformat


def one_decimal(x: Column) -> Column:
    """``f"{x:.1f}"``: half-even on the exact binary value, no grouping."""
    return F.regexp_replace(F.format_number(x, 1), ",", "")


def finite_or_null(x: Column) -> Column:
    """NaN and +/-Inf -> null (JSON has no spelling for them)."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def json_safe(df: DataFrame) -> DataFrame:
    """Every float non-finite -> null; every timestamp -> ISO text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = finite_or_null(c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = isoformat(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def first_two_samples(samples: Column) -> Column:
    """The first two sample values joined with ``", "``."""
    return F.array_join(F.slice(samples, 1, 2), ", ")


def money(x: Column) -> Column:
    """Two decimals with thousands grouping, like ``toFixed(2)`` plus grouping."""
    return F.format_number(x, 2)


def grouped_count(x: Column) -> Column:
    return F.format_number(x, 0)


def dash_if_null(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("-"))
