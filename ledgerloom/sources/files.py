"""Reading uploaded files as all-text DataFrames.

``read_file`` picks the reader by extension, reads every column as text (no
schema inference: the library's own inference runs later, on all rows),
turns NA tokens into nulls and adds ``_row_id``, which follows file order
(Spark assigns ids per partition in increasing order, and a file's splits
are partitions in offset order).

A first scan of a CSV or text file's raw lines tells, per file, whether its
bytes are UTF-8, whether a quoted cell breaks a line, and its header line; a header
line that ends inside a quoted cell is read on as a record. Files
that agree on these are read together, by their own header and encoding, and
the groups are put together by column name. A file without quoted line breaks
is read line-splittable, so a large one spreads over many tasks; one with them
takes a task. A row with more cells than the header is an error, as in pandas;
a shorter one is filled with nulls.
"""

from __future__ import annotations

import csv
import os
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.parsing import na_to_null
from ledgerloom.operators.cleaning import replace_na_tokens

ROW_ID = "_row_id"
_BAD = "_row_text"

# Stands for an empty cell that is not quoted where quoted ones are kept apart: no text holds it.
_BLANK = "\ufdd0\ufdd1"

# The dialect: cells quoted with ", a doubled quote inside stands for one.
DIALECT = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "enforceSchema": "true",
           "columnNameOfCorruptRecord": _BAD, "emptyValue": "", "nullValue": ""}


def suffix(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def file_traits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Per file: ``not_utf8``, ``breaks`` (a cell spans lines) and its ``header`` line.

    One scan of the raw lines, aggregated per task; no task holds a whole file.
    """
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), line.alias("line"), at.alias("at"),
        (~F.is_valid_utf8(line)).alias("not_utf8"), (quotes % 2 == 1).alias("odd"))
    return lines.groupBy("file").agg(
        F.bool_or("not_utf8").alias("not_utf8"), F.bool_or("odd").alias("breaks"),
        F.min_by(F.col("line").cast("binary"), F.col("at")).alias("header"))


def _readable(uri: str) -> str:
    """A file's name as a scan reports it (encoded), as a path to read that matches nothing else."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def header_cells(spark: SparkSession, file: str, line: str, sep: str, encoding: str) -> list[str]:
    """The cells of a header: of its ``line``, or, where a quoted cell breaks that line, of the
    file's first record (the reader stops there)."""
    if line.count('"') % 2 == 0:
        return next(csv.reader([line], delimiter=sep), [])
    record = (spark.read.options(**DIALECT).option("sep", sep).option("encoding", encoding)
              .option("multiLine", True).option("header", False).csv(_readable(file)).first())
    cells = [x or "" for x in record]
    return [cells[0].removeprefix("\ufeff"), *cells[1:]]


def header_names(cells: list[str]) -> list[str]:
    """Column names of a header's cells, as pandas gives them: a repeated name gets
    ``.1``, ``.2``; a blank one is ``Unnamed: i``. Names that differ only in case
    get ``_1``, ``_2`` (columns are looked up without case)."""
    out, seen, folded = [], {}, set()
    for i, raw in enumerate(cells):
        name = raw if raw != "" else f"Unnamed: {i}"
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        else:
            seen[name] = 0
        base, n = name, 0
        while name.lower() in folded:
            n += 1
            name = f"{base}_{n}"
        folded.add(name.lower())
        out.append(name)
    return out


def cells_beyond(bad: Column, width: int, sep: str) -> Column:
    """True where a row kept as text (``bad``) has more cells than ``width``."""
    plain = F.regexp_replace(bad, r'(?s)"(?:[^"]|"")*"', "q")
    cells = F.length(plain) - F.length(F.replace(plain, F.lit(sep), F.lit(""))) + 1
    return F.coalesce(cells > width, F.lit(False))


def _read_group(spark: SparkSession, files: list[str], names: list[str], sep: str, encoding: str,
                multiline: bool, keep_empty: bool) -> DataFrame:
    cols = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} string" for c in [*cols, _BAD])
    df = (spark.read.options(**DIALECT | ({"nullValue": _BLANK} if keep_empty else {}))
          .option("header", True).option("sep", sep)
          .option("encoding", encoding).option("multiLine", multiline).schema(schema).csv([_readable(f) for f in files]))
    # A row too long is never cut: reading it fails, naming the row.
    stop = F.raise_error(F.concat(F.lit(f"a row has more than the header's {len(names)} cells: "),
                                  F.substring(F.col(_BAD), 1, 200))).cast("string")
    first = F.when(cells_beyond(F.col(_BAD), len(names), sep), stop).otherwise(F.col("c0"))
    return df.select(first.alias("c0"), *cols[1:]).toDF(*names)


def read_batch(spark: SparkSession, files: dict[str, int]) -> tuple[DataFrame | None, dict[int, list[str]]]:
    """Many CSV and text files as one all-text frame, and the headers of each.

    ``files`` numbers the paths. The frame has ``file_no``, ``_row_id`` (in file order),
    ``bad`` (the text of a row with more cells than its header, else null) and the
    cells by position, ``c0, c1, ...``, NA tokens as nulls; a file with fewer columns
    than others has nulls behind its own. Files that agree on header, separator
    and encoding are read together; the plan has a scan for each such group, and
    one job reads the raw lines of all files first. A file without a line is not in the headers.
    """
    def bare(path: str) -> str:
        return path.split(":", 1)[-1].lstrip("/")

    numbers = {bare(p): n for p, n in files.items()}
    groups: dict[tuple, list[tuple[str, int]]] = {}
    headers: dict[int, list[str]] = {}
    for r in file_traits(spark, list(files)).collect():      # one row per file
        code = "ISO-8859-1" if r.not_utf8 else "UTF-8"
        header = bytes(r.header).decode(code.lower().replace("utf-8", "utf-8-sig"), "replace")
        mark = "," if suffix(r.file) == ".csv" else _separator(header, None)
        n = numbers[bare(unquote(r.file))]
        headers[n] = header_names(header_cells(spark, r.file, header, mark, code))
        groups.setdefault((len(headers[n]), mark, code, r.breaks), []).append((r.file, n))
    out, widest = None, max(map(len, headers.values()), default=0)
    for (width, mark, code, breaks), members in sorted(groups.items(), key=lambda g: sorted(g[1])):
        cols = [f"c{i}" for i in range(width)]
        df = (spark.read.options(**DIALECT).option("header", True).option("sep", mark)
              .option("encoding", code).option("multiLine", breaks)
              .schema(", ".join(f"{c} string" for c in [*cols, _BAD])).csv([_readable(f) for f, _ in members]))
        number = F.create_map(*[F.lit(x) for pair in members for x in pair])
        bad = F.when(cells_beyond(F.col(_BAD), width, mark), F.col(_BAD))
        part = df.select(F.element_at(number, F.col("_metadata.file_path")).alias("file_no"),
                         F.monotonically_increasing_id().alias(ROW_ID), bad.alias("bad"),
                         *[na_to_null(F.col(c)).alias(c) for c in cols],
                         *[F.lit(None).cast("string").alias(f"c{i}") for i in range(width, widest)])
        out = part if out is None else out.unionByName(part)
    return out, headers


def _separator(header: str, sep: str | None) -> str:
    """Text tables: tabs, or commas when the header has no tab but a comma."""
    if sep:
        return sep
    return "," if "\t" not in header and "," in header else "\t"


def read_csv(spark: SparkSession, paths: str | list[str], sep: str | None = ",",
             encoding: str | None = None, materialize: bool = False, keep_empty: bool = False) -> DataFrame:
    """CSV as text. Without an explicit ``encoding``, files that are valid
    UTF-8 are read as UTF-8 and the others as latin-1, which decodes every
    byte (so no further fallback is reachable). ``sep=None`` decides between tab
    and comma by each file's own header.

    Empty cells are null, as in pandas; with ``keep_empty`` a quoted empty cell (``""``) is an
    empty text. ``materialize`` stages the text once as Parquet, for callers that read it
    several times.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    groups: dict[tuple, list[str]] = {}
    for r in file_traits(spark, paths).collect():        # one row per file
        code = encoding or ("ISO-8859-1" if r.not_utf8 else "UTF-8")
        header = bytes(r.header).decode(code.lower().replace("utf-8", "utf-8-sig"), "replace")
        mark = _separator(header, sep)
        names = header_names(header_cells(spark, r.file, header, mark, code))
        groups.setdefault((tuple(names), mark, code, r.breaks), []).append(r.file)
    if not groups:
        raise ValueError(f"no rows in {', '.join(paths)}")
    out = None
    for (names, mark, code, breaks), files in sorted(groups.items(), key=lambda g: sorted(g[1])):
        part = _read_group(spark, sorted(files), list(names), mark, code, breaks, keep_empty)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if materialize:
        from ledgerloom.session import staged

        out = staged(out)
    return out


def read_text_table(spark: SparkSession, paths: str | list[str],
                    materialize: bool = False) -> DataFrame:
    """``.txt``: tab-separated; comma-separated where the file's header says so."""
    return read_csv(spark, paths, sep=None, materialize=materialize)


def read_file(spark: SparkSession, path: str, with_row_id: bool = True,
              materialize: bool = False) -> DataFrame:
    """An uploaded file as an all-text DataFrame with NA tokens as nulls.

    ``materialize`` stages the text once (see ``read_csv``) for callers
    that scan it several times, as type inference does.
    """
    ext = suffix(path)
    if ext == ".csv":
        df = read_csv(spark, path, materialize=materialize)
    elif ext == ".txt":
        df = read_text_table(spark, path, materialize=materialize)
    elif ext == ".xlsx":
        from ledgerloom.sources.xlsx import read_xlsx

        df = read_xlsx(spark, path)
    elif ext == ".xls":
        raise ValueError("Legacy .xls workbooks are not supported; save the file as .xlsx or .csv")
    else:
        raise ValueError(f"Unsupported file extension: {ext}")
    df = replace_na_tokens(df)
    if with_row_id:
        df = df.withColumn(ROW_ID, F.monotonically_increasing_id())
    return df
