"""The conformed sales table on disk: Parquet partitioned by ``upload_id``.

Writes replace only the partitions present in the written frame (dynamic
partition overwrite), so reprocessing an upload replaces its rows instead of
appending a second copy. Rows are sorted by ``date`` within each file so
Parquet row-group statistics skip most of a file for date-range filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.timeutil import as_of_column

SALES_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("upload_id", T.StringType(), False),
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("sku_id", T.StringType()),
    T.StructField("sales_quantity", T.DoubleType()),
    T.StructField("sales_revenue", T.DoubleType()),
    T.StructField("stock_level", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("created_at", T.TimestampNTZType()),
])


def write_sales(conformed: DataFrame, path: str, as_of=None) -> int:
    """Write conformed rows, replacing their uploads' partitions; returns rows written.

    The count comes from an ``Observation`` on the write itself, so no
    second job runs to count.
    """
    if "id" not in conformed.columns:
        conformed = conformed.withColumn(
            "id", F.xxhash64("upload_id", F.monotonically_increasing_id()).cast("string"))
    if "created_at" not in conformed.columns:
        conformed = conformed.withColumn("created_at", as_of_column(as_of))
    obs = Observation("sales_write")
    out = conformed.select(*[F.col(f.name).cast(f.dataType) for f in SALES_SCHEMA.fields])
    out = out.observe(obs, F.count(F.lit(1)).alias("rows"))
    # No repartition: a write usually holds one upload, and hashing on
    # upload_id would send all of it to one task. Each task writes its own
    # sorted files into the upload's partition folder. The overwrite mode is
    # this write's own, so parallel writes of a session do not disturb each other.
    (out.sortWithinPartitions("upload_id", "date")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("upload_id").parquet(path))
    return int(obs.get["rows"])


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SALES_SCHEMA).parquet(path)
