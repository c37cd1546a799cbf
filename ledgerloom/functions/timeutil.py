"""Time helpers: the clock parameter, UTC conversion and ISO text."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def session_zone() -> str:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return "UTC"
    return spark.conf.get("spark.sql.session.timeZone", "UTC") or "UTC"


def as_of_column(as_of=None) -> Column:
    """The reference clock as TIMESTAMP_NTZ in UTC.

    Every rule that compares with "now" takes ``as_of`` so results are
    reproducible; ``None`` means the current time.
    """
    if as_of is None:
        from ledgerloom.functions.parsing import to_utc_ntz

        return to_utc_ntz(F.current_timestamp())
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    if isinstance(as_of, _dt.date) and not isinstance(as_of, _dt.datetime):
        as_of = _dt.datetime(as_of.year, as_of.month, as_of.day)
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return ntz_literal(as_of)


def ntz_literal(value: _dt.datetime) -> Column:
    """A naive datetime as a TIMESTAMP_NTZ literal.

    Built from text: a Python datetime literal would pass through the Python
    process's local zone and then the session zone, shifting the wall clock
    whenever the two differ.
    """
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def utc_midnight(as_of=None) -> Column:
    """Today's UTC midnight relative to ``as_of`` (pandas ``normalize()``)."""
    return F.date_trunc("DAY", as_of_column(as_of)).cast("timestamp_ntz")


def ensure_utc(ntz: Column) -> Column:
    """A naive UTC wall clock -> a zoned TIMESTAMP instant."""
    zone = session_zone()
    if zone in ("UTC", "Etc/UTC", "GMT"):
        return ntz.cast("timestamp")
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ntz).cast("timestamp")


def make_naive(ts: Column, source_zone: str = "UTC") -> Column:
    """A zoned TIMESTAMP -> TIMESTAMP_NTZ keeping the wall clock of ``source_zone``."""
    zone = session_zone()
    local = ts.cast("timestamp_ntz")
    if zone == source_zone:
        return local
    return F.convert_timezone(F.lit(zone), F.lit(source_zone), local)


def normalize_utc(text: Column) -> Column:
    """Parse text; zoned values move to UTC and lose the zone (``+02:00``
    moves 2 h back), naive values stay as written."""
    from ledgerloom.functions.parsing import parse_iso

    return parse_iso(F.trim(text))


def isoformat(ts: Column) -> Column:
    """``datetime.isoformat()``: microseconds are printed when there are any.

    Built from the value's own text, which no zone touches.
    """
    text = ts.cast("timestamp_ntz").cast("string")
    fraction = F.regexp_extract(text, r"\.(\d+)$", 1)
    whole = F.replace(F.substring_index(text, ".", 1), F.lit(" "), F.lit("T"))
    return F.when(fraction == "", whole).otherwise(
        F.concat(whole, F.lit("."), F.rpad(fraction, 6, "0")))


def whole_days_between(start: Column, end: Column) -> Column:
    """``(end - start).days``: whole days, not calendar boundaries."""
    return F.timestamp_diff("DAY", start, end)


def is_midnight(ts: Column) -> Column:
    """Hour, minute and second all zero (fractions ignored)."""
    return (F.hour(ts) == 0) & (F.minute(ts) == 0) & (F.second(ts) == 0)
