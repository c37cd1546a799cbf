"""Admission screening of uploaded files.

``verdict`` states the rules over columns (name, length, content), so they run
on any table of files; ``file_admission`` applies them to a folder, one row
per file: ``path, file_name, length, size_mb, ext, accepted, reason``. A file is
accepted when its extension is allowed, it is at most 50 MB, and its first bytes
say workbook (zip or OLE2 container) or its content is text (valid UTF-8, or
free of NUL bytes).

Names and lengths come from a scan that reads no content. Content is read only
for files whose name and length pass: the reader skips other names by its path
filter and longer files by its length filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.constants import (
    ALLOWED_EXTENSIONS,
    MAGIC_XLS,
    MAGIC_XLSX,
    MAX_FILE_BYTES,
    REJECT_CONTENT,
    REJECT_EXTENSION,
    REJECT_SIZE,
)

from ledgerloom.functions.text import file_suffix


def megabytes(n_bytes) -> float:
    """Bytes -> MB (1024 * 1024 bytes)."""
    return n_bytes / 1024 / 1024


def verdict(name: Column, length: Column, content: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """The reason to reject a file, null when it is accepted.

    Rules in order: extension, size, content; null content fails the last.
    """
    ext_ok = file_suffix(name).isin(ALLOWED_EXTENSIONS)
    text = content.cast("string")
    content_ok = (F.hex(F.substring(content, 1, 4)).isin(MAGIC_XLSX, MAGIC_XLS)
                  | F.is_valid_utf8(text) | (F.instr(text, "\u0000") == 0))
    too_big = REJECT_SIZE.format(mb=float(megabytes(max_bytes)))
    return (F.when(~ext_ok, F.lit(REJECT_EXTENSION.format(allowed=", ".join(ALLOWED_EXTENSIONS))))
             .when(~(length <= max_bytes), F.lit(too_big))
             .when(~F.coalesce(content_ok, F.lit(False)), F.lit(REJECT_CONTENT)))


def _files(spark: SparkSession):
    return spark.read.format("binaryFile").option("recursiveFileLookup", True)


def _any_case(ext: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext)


def file_admission(spark: SparkSession, location: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    meta = _files(spark).load(location).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length",
        file_suffix(F.col("path")).alias("ext"))
    names = "{" + ",".join(f"*{_any_case(e)}" for e in ALLOWED_EXTENSIONS) + "}"
    content = (_files(spark).option("pathGlobFilter", names).load(location)
               .filter(F.col("length") <= max_bytes)
               .select("path", "length", "content")
               .select("path", verdict(F.col("path"), F.col("length"), F.col("content"), max_bytes)
                       .alias("found"), F.lit(True).alias("read")))
    checked = meta.join(content, "path", "left")
    unread = verdict(F.col("path"), F.col("length"), F.lit(None).cast("binary"), max_bytes)
    reason = F.when(F.col("read"), F.col("found")).otherwise(unread)
    return checked.select("path", "file_name", "length",
                          megabytes(F.col("length")).alias("size_mb"), "ext",
                          reason.isNull().alias("accepted"), reason.alias("reason"))
