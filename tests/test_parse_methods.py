"""No generated method that holds a parse is too large for the JVM to compile."""

import re

from ledgerloom.functions.parsing import parse_datetime, parse_integer, parse_numeric
from ledgerloom.operators import cleaning as C
from pyspark.sql import functions as F

JIT_LIMIT = 8000        # bytes of bytecode above which the JVM compiles no method


def _method_sizes(df):
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        text = debug.codegenString(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def test_parses_are_compiled(spark):
    words = spark.range(5).select(F.concat(F.lit("March "), F.col("id") + 1, F.lit(", 2024")).alias("a"),
                                  F.col("id").cast("string").alias("b"))
    cells = words.select(F.inline(F.array(F.struct(F.lit(0).alias("ordinal"), F.col("a").alias("v")),
                                          F.struct(F.lit(1).alias("ordinal"), F.col("b").alias("v")))))
    counts = C.parse_counts(cells, ["ordinal"])
    assert max(_method_sizes(counts)) < JIT_LIMIT
    assert max(_method_sizes(C.infer_types(words))) < JIT_LIMIT
    got = {r.ordinal: r for r in counts.collect()}
    assert (got[0].n_datetime, got[0].n_numeric, got[1].n_datetime, got[1].n_whole) == (5, 0, 0, 5)


def test_month_names(spark):
    texts = ["sept 3 2024", "5-Mar-24", "DECEMBER 31, 1999", "Foo 3, 2024", "Marc 3, 2024", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_datetime(F.col("t")).alias("d")).collect()
    assert [r.d and r.d.date().isoformat() for r in got] == ["2024-09-03", "2024-03-05", "1999-12-31", None, None, None]


def test_dates_are_read_once_per_text(spark):
    """Text that cannot be a date meets no parse, and a date that comes often is read once."""
    texts = ["2024-03-05", "3/4/2024", "SKU-1", "SMALL BRASS 5", "12", "inf", "-Infinity", "i", "1.5", "99999999999999999999",
             "9223372036854775807", "9.3e18", "2024-13-45", " 7 ", "-", "true", None]
    cells = spark.createDataFrame([(k, t) for k in range(2) for t in texts for _ in range(3)], "ordinal int, v string")
    counts = C.parse_counts(cells, ["ordinal"])
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    reads = [n for n, line in enumerate(plan.splitlines()) if "make_timestamp" in line.lower()]
    groups = [n for n, line in enumerate(plan.splitlines()) if "Aggregate" in line]
    assert len(groups) == 2 and reads and max(reads) <= groups[1]
    for r in counts.collect():
        assert (r.n_rows, r.n_nonnull, r.n_boolean, r.n_numeric, r.n_whole, r.n_datetime) == (51, 48, 3, 24, 9, 6)
    for t, x, whole in [("inf", float("inf"), None), ("i", None, None), (" 7 ", 7.0, 7), ("99999999999999999999", 1e20, None),
                        ("9223372036854775807", 2.0 ** 63, 2 ** 63 - 1), ("9.3e18", 9.3e18, None)]:
        row = spark.createDataFrame([(t,)], "v string").select(
            parse_numeric(F.col("v")).alias("x"), parse_integer(F.col("v")).alias("n")).select(
            "x", "n").first()
        assert (row.x, row.n) == (x, whole)
