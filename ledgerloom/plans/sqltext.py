"""DuckDB text for the parsing rules, used only by the oracle SQL.

The rules are stated here anew, from the survey, and share no pattern, token
list or limit with the code they check.
"""

from __future__ import annotations

# FIXED VALUES: what pandas' CSV reader takes for a missing value, the boolean words and labels,
# and the written dates.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
           "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
BOOLEAN_WORDS = ["True", "TRUE", "true", "False", "FALSE", "false"]
BOOLEAN_LABELS = ["True", "False", "true", "false", "YES", "NO", "yes", "no"]
WRITTEN_DATES = ["%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%m/%d/%y", "%m-%d-%y", "%d %B %Y",
                 "%b %d, %Y"]


def lit_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def na(c: str) -> str:
    return f"(case when {c} in ({lit_list(MISSING)}) then null else {c} end)"


def num(c: str) -> str:
    """Digits with at most one point and an optional exponent, or an infinity."""
    t = f"lower(trim({c}))"
    bare = f"ltrim({t}, '+-')"
    digits = f"regexp_full_match({bare}, '([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?')"
    one_sign = f"length({t}) - length({bare}) <= 1"
    return (f"(case when {bare} in ('inf', 'infinity') and {one_sign} then "
            f"(case when {t}[1] = '-' then cast('-inf' as double) else cast('inf' as double) end) "
            f"when {digits} and {one_sign} then try_cast({t} as double) end)")


def integer(c: str) -> str:
    """Plain digits exactly; other numbers when they are whole and fit 64 bits."""
    t, x = f"trim({c})", num(c)
    return (f"(case when regexp_full_match({t}, '[+-]?[0-9]+') and try_cast({t} as bigint) is not null "
            f"then try_cast({t} as bigint) "
            f"when abs({x}) < 9.2e18 and {x} = floor({x}) then cast({x} as bigint) end)")


def dt(c: str) -> str:
    t = f"trim({c})"
    written = ", ".join(f"'{f}'" for f in WRITTEN_DATES)
    return (f"(case when regexp_matches({t}, '^[0-9]{{4}}-[0-9]') then try_cast({t} as timestamp) "
            f"else try_strptime({t}, [{written}]) end)")


def boolean_text(c: str) -> str:
    return f"({c} in ({lit_list(BOOLEAN_WORDS)}))"


def boolean_label_text(c: str) -> str:
    return f"({c} in ({lit_list(BOOLEAN_LABELS)}))"


def clean_name(c: str) -> str:
    return ("regexp_replace(replace(replace(lower(trim(" + c + ")), ' ', '_'), '-', '_'), "
            "'[^a-z0-9_]', '', 'g')")


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"
