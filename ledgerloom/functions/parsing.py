"""Column expressions that turn raw text into typed values.

All of these are built-in Spark expressions (no UDF). Generated code evaluates what
several places share (the parts of a written date, say) once, where all of them are
always reached: a guard goes on the text, not around the parse.

A whole-stage method that holds a date parse is 20 to 50 KB of bytecode, and the JVM
compiles none above 8 KB but interprets it. The one lambda, in the lookup of month
names, makes Spark generate such a projection outside whole-stage code, in small methods.
It is evaluated for written month names only.

ANSI mode is assumed on: every conversion uses a
``try_*`` form and returns null instead of failing the task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.constants import (
    BOOLEAN_FALSE_TOKENS,
    BOOLEAN_TRUE_TOKENS,
    NA_TOKENS,
)

# FIXED VALUES: the numeric grammar pandas' ``to_numeric`` accepts (digits with
# an optional point and exponent, optional sign and surrounding blanks) and
# the spellings of infinity. Rejected: thousands separators, currency, hex,
# underscores and Java type suffixes such as ``12d``.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(?i:inf|infinity)\s*$"
# Numeric text begins with a byte below this one (a digit, point, sign or blank). Comparing
# bytes spares most other text the pattern, which copies the text first.
_AFTER_DIGITS = ":"

# ISO text (what a cast accepts) is tried only when the value starts with a year
# and a month, so bare clock times such as ``12:30`` never resolve against
# today's date and bare numbers such as ``12345`` never become years.
ISO_GUARD = r"^\s*\d{4}-\d{1,2}"

# ISO text that names its zone after a clock time: an offset, Z, UTC/GMT, or
# a region id. A zone needs a time before it, so the day of ``2024-03-03``
# never reads as an offset.
ZONE_SUFFIX = (r"(?i)\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*"
               r"(z|[+-]\d{1,2}(:?\d{2})?|utc|gmt|[a-z]+/[a-z_]+)$")

# FIXED VALUES: the written dates accepted besides ISO text, each optionally
# followed by a clock time. Three numbers around one kind of separator (year
# first when it has four digits, else month first and, where that is no date,
# day first), or a month name with a day and a year.
YEAR_LAST = r"(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})"
YEAR_FIRST = r"(\d{4})([/.])(\d{1,2})\6(\d{1,2})"
DAY_NAME_YEAR = r"(\d{1,2})(?:st|nd|rd|th)?[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4}|\d{2})"
NAME_DAY_YEAR = r"([A-Za-z]{3,9})\.?[ -](\d{1,2})(?:st|nd|rd|th)?,?[ -](\d{4})"
CLOCK = (r" *[ T,]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6})\d*)?)?"
         r"\s*([AaPp])?\.?([Mm])?\.?")
WRITTEN = f"^(?:{YEAR_LAST}|{YEAR_FIRST}|{DAY_NAME_YEAR}|{NAME_DAY_YEAR})(?:{CLOCK})?$"
# What a written date is rewritten to: a mark, then its groups. Only one kind's are not empty.
_MARK = "\u0001"
_GROUPS = {"first": "$1", "second": "$3", "year": "$4$5$11$14", "month": "$7", "day": "$8$9$13", "name": "$10$12",
           "hour": "$15", "minute": "$16", "second_of": "$17", "fraction": "$18", "half": "$19", "m": "$20"}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december"]
# Two-digit years: 69-99 are 1969-1999, 00-68 are 2000-2068.
YEAR_PIVOT = 69

# What any of the above must look like; most text fails here and costs no more.
DATE_CANDIDATE = (r"^\s*(\d{4}-\d{1,2}|\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}"
                  r"|\d{1,2}(st|nd|rd|th)?[ -][A-Za-z]{3}|[A-Za-z]{3,9}\.?[ -]\d{1,2})")

# Largest magnitude that still fits BIGINT after a whole-number check.
_BIGINT_LIMIT = 9.2e18


def na_to_null(c: Column) -> Column:
    """Text equal to one of the NA tokens becomes null."""
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def is_numeric_text(c: Column) -> Column:
    """True where the text matches the numeric grammar (null stays null)."""
    return c.rlike(NUMERIC_PATTERN) | c.rlike(INFINITY_PATTERN)


def parse_numeric(c: Column) -> Column:
    """Text -> DOUBLE under the numeric grammar; anything else -> null.

    The regex guard is what keeps ``12d`` and ``1_000`` out: a bare cast
    would accept the first.
    """
    t = F.trim(c)
    inf = F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (F.when((c < _AFTER_DIGITS) & c.rlike(NUMERIC_PATTERN), t.try_cast("double"))
             .when(_begins_infinity(c) & c.rlike(INFINITY_PATTERN), inf))


def _begins_infinity(c: Column) -> Column:
    """The first byte is that of a blank, a sign or an ``i``: no more text needs the pattern."""
    return (c < "0") | ((c >= "I") & (c < "J")) | ((c >= "i") & (c < "j"))


def is_whole(x: Column) -> Column:
    """True where a DOUBLE is finite, integral and inside the BIGINT range."""
    return (F.abs(x) < F.lit(_BIGINT_LIMIT)) & (x == F.floor(x))


def parse_integer(c: Column, x: Column | None = None) -> Column:
    """Text -> BIGINT through the numeric grammar; ``12.0`` becomes 12.

    Plain digits are read as integers, never through a double, so 16- to
    18-digit codes keep every digit. ``x`` is the number, where it is known already.
    """
    plain = F.when((c < _AFTER_DIGITS) & c.rlike(INTEGER_PATTERN), F.trim(c).try_cast("bigint"))
    x = parse_numeric(c) if x is None else x
    return F.coalesce(plain, F.when(is_whole(x), x.try_cast("bigint")))


def reads_as_integer(c: Column, x: Column) -> Column:
    """True where ``parse_integer(c, x)`` is not null, given the number ``x``.

    The digits are read only where a double is too large to tell.
    """
    digits = (F.abs(x) >= F.lit(_BIGINT_LIMIT)) & c.rlike(INTEGER_PATTERN)
    return F.when(is_whole(x), F.lit(True)).otherwise(
        F.coalesce(F.when(digits, F.trim(c).try_cast("bigint").isNotNull()), F.lit(False)))


def is_boolean_text(c: Column) -> Column:
    return c.isin(BOOLEAN_TRUE_TOKENS + BOOLEAN_FALSE_TOKENS)


def parse_boolean(c: Column) -> Column:
    return (F.when(c.isin(BOOLEAN_TRUE_TOKENS), F.lit(True))
             .when(c.isin(BOOLEAN_FALSE_TOKENS), F.lit(False)))


def parse_datetime(c: Column) -> Column:
    """Text -> TIMESTAMP_NTZ, or null.

    Month-first is tried before day-first, so ``03/04/2024`` is 4 March and
    ``13/04/2024`` is 13 April. Naive text keeps its wall clock; text that
    names a zone is converted to UTC. No step looks at the session zone.
    """
    return read_date(date_text(c))


def date_text(c: Column) -> Column:
    """The text, trimmed, where it may be a date; null elsewhere. ISO text may be one, too."""
    # Every candidate holds a separator; looking for bytes spares most other text the pattern.
    separated = c.contains("-") | c.contains("/") | c.contains(" ") | c.contains(".")
    return F.when(separated & c.rlike(DATE_CANDIDATE), F.trim(c))


def read_date(t: Column) -> Column:
    """``date_text`` -> TIMESTAMP_NTZ, or null. Over many rows, give ``t`` a projection of its own
    (``cleaning.parse_counts``): generated code reads an expression again in every branch."""
    iso = t.rlike(ISO_GUARD)
    return _parse_written(F.when(~iso, t), F.when(iso, parse_iso(t)))


def _parse_written(t: Column, other: Column) -> Column:
    """A written date with an optional clock time, built from its numbers; ``other`` where ``t``
    is null.

    One pattern rewrites the text to its groups; text it does not match has no groups. The
    groups stand in the first condition, so generated code makes them once.
    """
    parts = F.split(F.regexp_replace(t, WRITTEN, "|".join([_MARK, *_GROUPS.values()])), r"\|", -1)
    part = {name: F.get(parts, F.lit(i)) for i, name in enumerate(_GROUPS, 1)}
    first, second, n = (part[k].try_cast("int") for k in ("first", "second", "year"))
    year = F.when(F.length(part["year"]) > 2, n).when(n < YEAR_PIVOT, n + 2000).otherwise(n + 1900)
    # Month first, and day first where that is no month: a day over 12 never makes a month.
    month = F.when(part["name"] != "", _month(part["name"])).when(part["month"] != "", part["month"].try_cast("int")) \
        .when(first > 12, second).otherwise(first)
    day = F.when(part["day"] != "", part["day"].try_cast("int")).when(first > 12, first).otherwise(second)
    hour, minute, at = (part[k].try_cast("int") for k in ("hour", "minute", "second_of"))
    micros = F.coalesce(F.rpad(part["fraction"], 6, "0").try_cast("int"), F.lit(0))
    half, m = F.lower(part["half"]), part["m"]
    hour24 = (F.when(half == "", hour)
               .when((hour < 1) | (hour > 12), F.lit(None).cast("int"))
               .when(half == "p", hour % 12 + 12).otherwise(hour % 12))
    at = F.coalesce(at, F.lit(0))
    # ``10:30 a`` and ``10:30 m`` are no times: both letters come or neither does.
    fits = (hour24 < 24) & (minute < 60) & (at < 60) & ((half == "") == (m == ""))
    micros = ((hour24 * 60 + minute) * 60 + at).cast("bigint") * 1_000_000 + micros
    zero = F.lit(0)
    midnight = F.try_make_timestamp_ntz(year, month, day, zero, zero, zero.cast("decimal(16,6)"))
    found = F.when(part["hour"] == "", midnight).when(fits, F.timestamp_add("MICROSECOND", micros, midnight))
    marked = (F.size(parts) == len(_GROUPS) + 1) & (F.get(parts, F.lit(0)) == _MARK)
    return F.when(marked, found).when(t.isNull(), other)


def _month(name: Column) -> Column:
    """The number of a month given by its name or a short form of it; null if unknown."""
    # ``sept`` is the one four-letter short form in common use.
    known = {"sept": 9} | {k: n for n, full in enumerate(MONTHS, 1) for k in (full, full[:3])}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # The lambda keeps every parse of dates out of whole-stage code (see the module's text).
    return F.get(F.transform(F.array(F.lower(name)), lambda n: F.try_element_at(table, n)), F.lit(0))


def parse_iso(t: Column) -> Column:
    """ISO text -> TIMESTAMP_NTZ: zoned text as its UTC wall clock, naive text as written."""
    # Spark's reader wants seconds before a zone; ``10:00Z`` becomes ``10:00:00Z``.
    with_seconds = F.regexp_replace(t, r"([T ]\d{1,2}:\d{2})(\s*([zZ]|[+-]|[A-Za-z]))", "$1:00$2")
    # A zone comes after a clock time, so a short text has none.
    zoned = (F.length(t) > 12) & t.rlike(ZONE_SUFFIX)
    return (F.when(zoned, to_utc_ntz(F.try_to_timestamp(with_seconds)))
             .otherwise(t.try_cast("timestamp_ntz")))


def to_utc_ntz(ts: Column) -> Column:
    """A zoned TIMESTAMP -> its UTC wall clock as TIMESTAMP_NTZ.

    Counted from the epoch, so neither the session zone nor its clock changes
    (a local hour that comes twice) can shift the result.
    """
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts),
                           F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def truncate_to_bigint(x: Column) -> Column:
    """Python ``int()`` on a number: truncation toward zero, null when it is no 64-bit number."""
    return x.try_cast("bigint")
