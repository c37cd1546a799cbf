"""Header and text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DROP = re.compile(r"[^a-z0-9_]")


def clean_name(name: str) -> str:
    """strip -> lower -> space to ``_`` -> hyphen to ``_`` -> drop other characters."""
    out = str(name).strip().lower().replace(" ", "_").replace("-", "_")
    return _DROP.sub("", out)


def clean_names(names: list[str]) -> list[str]:
    """Clean every header, then make collisions unique with ``_1``, ``_2`` suffixes.

    An empty result (a header of symbols only) becomes ``column_<position>``.
    """
    cleaned = [clean_name(n) or f"column_{i + 1}" for i, n in enumerate(names)]
    seen: dict[str, int] = {}
    taken = set(cleaned)
    out = []
    for name in cleaned:
        if name not in seen:
            seen[name] = 0
            out.append(name)
            continue
        k = seen[name]
        candidate = name
        while candidate in taken:
            k += 1
            candidate = f"{name}_{k}"
        seen[name] = k
        taken.add(candidate)
        out.append(candidate)
    return out


def clean_name_expr(c: Column) -> Column:
    """The same header rule as a column expression, for headers stored as data."""
    stripped = F.regexp_replace(c, r"^\s+|\s+$", "")
    spaced = F.replace(F.replace(F.lower(stripped), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    return F.regexp_replace(spaced, "[^a-z0-9_]", "")


def file_suffix(path: Column) -> Column:
    """Lower-cased extension including the dot, or empty."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
