"""CSV export that the library's own reader reads back to the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.constants import NA_TOKENS
from ledgerloom.functions.timeutil import isoformat
from ledgerloom.operators.cleaning import q

#: Every cell is quoted but a null one, which is empty; a quote inside is doubled. Blanks,
#: line breaks and backslashes stay as they are.
WRITE = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "false", "escapeQuotes": "true",
         "nullValue": "", "emptyValue": '""', "ignoreLeadingWhiteSpace": "false",
         "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8", "lineSep": "\n"}


def _text(df: DataFrame, name: str):
    """A cell as the text to write: times as ISO text, nested values as JSON."""
    c, kind = q(name), df.schema[name].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return isoformat(c)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(c)
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    return c.cast("string")


def export_csv(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write ``df`` as CSV files with a header each, in the order of the columns
    ``order`` (by ranges: files follow one another, no task holds more than its range).

    ``read_csv(..., keep_empty=True)`` gives the same cells as text: nulls and empty texts are
    told apart, and quotes, separators and line breaks come back. Without ``order``
    nothing is shuffled. In a frame of one column a null is written like an empty text, as
    a blank line is no row. (``read_file`` goes on to turn NA tokens into nulls; see
    ``ambiguous_cells``.)
    """
    texts = {c: _text(df, c) for c in df.columns}
    if len(texts) == 1:
        texts = {c: F.coalesce(e, F.lit("")) for c, e in texts.items()}
    if order:
        by = [q(c).asc_nulls_first() for c in order]
        df = df.repartitionByRange(*by).sortWithinPartitions(*by)
    df.select(*[e.alias(c) for c, e in texts.items()]).write.options(**WRITE).mode(mode).csv(path)


def ambiguous_cells(df: DataFrame) -> DataFrame:
    """One row per text column: ``column_name, n_na_tokens``, the cells that
    hold an NA token as text and that ``read_file`` would take for missing."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), q(c).isin(NA_TOKENS).alias("na")) for c in names])
    return df.select(F.inline(cells)).groupBy("column_name").agg(F.count_if("na").alias("n_na_tokens"))
