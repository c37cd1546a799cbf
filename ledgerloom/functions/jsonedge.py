"""JSON at the edge: nested columns as JSON text and back.

Inside the library schemas, reports and mappings are nested columns; other
systems store them as JSON. Writing has no spelling for NaN and infinities,
which become null; reading takes documents of any age: a field that is not there is
null, one that is not known is left aside, and NaN or Infinity, which some
writers put out, are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.display import finite_or_null
from ledgerloom.operators.cleaning import q

_BAD = "_unread_text"


def finite(c: Column, kind: T.DataType) -> Column:
    """``c`` with every number that is not finite, at any depth, as null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite_or_null(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: finite(x, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [finite(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def to_json_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with nested ``columns`` as JSON text; null fields are written, a null column is null."""
    out = {c: F.to_json(finite(q(c), df.schema[c].dataType), {"ignoreNullFields": "false"}) for c in columns}
    return df.withColumns(out)


def from_json_text(df: DataFrame, columns: dict[str, T.DataType]) -> DataFrame:
    """``df`` with JSON text ``columns`` as nested columns of the given types.

    Text that is no JSON object is null, and so is a whole column of null
    text; ``<column>_unread`` tells the first from the second.
    """
    out = {}
    for c, kind in columns.items():
        wide = T.StructType([*kind.fields, T.StructField(_BAD, T.StringType())]) if isinstance(kind, T.StructType) else kind
        read = F.from_json(q(c), wide, {"allowNonNumericNumbers": "true", "mode": "PERMISSIVE",
                                        "columnNameOfCorruptRecord": _BAD})
        shaped = F.coalesce(F.trim(q(c)).rlike(r"(?s)^\{.*\}$"), F.lit(False)) & read.isNotNull()
        if wide is not kind:
            shaped = shaped & read.getField(_BAD).isNull()
        out[f"{c}_unread"] = q(c).isNotNull() & ~shaped
        out[c] = F.when(shaped, finite(read, kind))
    return df.withColumns(out)
