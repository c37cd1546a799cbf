"""Helpers shared by the operators: reading tables, staging, sizes, sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import staging_path

# The code points SQL patterns and the byte kernels treat as white space.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it back.

    This cuts the lineage (a lost executor re-reads files), prunes columns on
    later reads, and gives the planner true sizes.
    """
    spark = df.sparkSession
    path = staging_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Mark ``df`` for broadcast only when its counted ``rows`` are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def wrapped(docs: DataFrame, **named) -> DataFrame:
    """``docs`` with each row as one struct ``row``, next to columns computed from it.

    Whatever the extra columns of ``docs`` are called, they clash with nothing.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, *[c.alias(n) for n, c in named.items()])


def unwrapped(df: DataFrame, columns: list[str], **replaced) -> DataFrame:
    """The columns that ``wrapped`` packed, some replaced or added."""
    new = {c: replaced.pop(c, None) for c in columns}
    return df.select(*[(F.col(f"row.`{c}`") if new[c] is None else new[c]).alias(c) for c in columns],
                     *[c.alias(n) for n, c in replaced.items()])


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores put before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def unit_hash(col):
    """A uniform number in [0, 1) from the text of ``col``: 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 13),
                  16, 10).cast("double") / F.lit(float(16 ** 13))


def crc_remainder(id_col, n: int):
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int,
                   held: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of at most about ``rows`` labelled documents outside the held-out part.

    Ids are taken in the order of a hash, so the sample is fixed; ``rows`` ids
    are what the broadcast is bound by. Rows with a null id or label are left out.
    """
    ids = labels.where(F.col(label).isNotNull() & (crc_remainder(F.col("doc_id"), modulus) != held)) \
        .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
    ids = ids.orderBy(unit_hash(F.col("_id")), "_id", "label").limit(rows)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select("text", "label")
