"""Duplicate rows are found in one pass over the rows."""

from ledgerloom.operators import anomalies as A
from pyspark.sql import functions as F


def test_duplicates_read_the_rows_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(200).select(F.col("id").alias("at"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("a"),
                            F.when(F.col("id") % 3 > 0, F.lit(0.0)).otherwise(F.lit(-0.0)).alias("b")).write.parquet(path)
    df = spark.read.parquet(path)
    found = A.duplicate_rows(df, "at")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    seen = {}
    for r in sorted(df.collect(), key=lambda r: r.at):
        seen.setdefault(r.a, []).append(r.at)
    expected = {at: (len(g), i + 1, g[0]) for g in seen.values() for i, at in enumerate(g)}
    for limit in (1, 30, 100_000):                      # all, some and no groups beyond the limit
        got = A.duplicate_rows(df, "at", limit=limit, slices=4).collect()
        assert len(got) == 200
        assert {r.at: (r.copies, r.occurrence, r.first_row) for r in got} == expected
