import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.functions.parsing import na_to_null, parse_datetime, parse_integer, parse_numeric
from ledgerloom.functions.text import clean_name, clean_name_expr, clean_names
from ledgerloom.functions.timeutil import as_of_column, normalize_utc


def _one(spark, expr, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_numeric_grammar_accepts_and_rejects(spark):
    ok = ["1e5", ".5", "5.", "+3", "inf", " 12 ", "-Infinity", "20240301"]
    bad = ["12d", "0x10", "1,000", "$5", "1_000", "abc", "12f"]
    got_ok = _one(spark, parse_numeric, ok)
    assert got_ok == [1e5, 0.5, 5.0, 3.0, float("inf"), 12.0, float("-inf"), 20240301.0]
    assert _one(spark, parse_numeric, bad) == [None] * len(bad)


def test_integer_parse_is_whole_only(spark):
    assert _one(spark, parse_integer, ["12.0", "12.5", "7", "inf"]) == [12, None, 7, None]


def test_date_layouts_month_first_then_day_first(spark):
    got = _one(spark, parse_datetime, [
        "03/04/2024", "13/04/2024", "1 March 2024", "Mar 5, 2024", "2024/3/1", "3/1/24",
        "2024-03-01T10:20:30+02:00", "1600-01-01", "20240301", "12:30", "now", "soon"])
    assert got[:6] == [dt.datetime(2024, 3, 4), dt.datetime(2024, 4, 13), dt.datetime(2024, 3, 1),
                       dt.datetime(2024, 3, 5), dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 1)]
    assert got[6] == dt.datetime(2024, 3, 1, 8, 20, 30)   # converted to UTC
    assert got[7] == dt.datetime(1600, 1, 1)               # kept, unlike pandas
    assert got[8:] == [None, None, None, None]             # numbers and clock words are not dates


def test_na_tokens_become_null(spark):
    vals = ["", "N/A", "NA", "null", "NaN", "None", "x", "n/a", "-nan", "0"]
    assert _one(spark, na_to_null, vals) == [None] * 6 + ["x", None, None, "0"]


def test_header_cleaning_and_collisions():
    assert clean_name(" Unit-Price ($) ") == "unit_price_"
    assert clean_names(["Sales Qty", "sales-qty", "sales_qty", "$$"]) == \
        ["sales_qty", "sales_qty_1", "sales_qty_2", "column_4"]


def test_header_rule_as_expression_matches_python(spark):
    heads = [" Unit-Price ($) ", "Order Date", "SKU-ID", "4-NOT SPECIFIED", "Qty#"]
    got = _one(spark, clean_name_expr, heads)
    assert got == [clean_name(h) for h in heads]


def test_normalize_utc_converts_offsets(spark):
    got = _one(spark, normalize_utc, ["2024-03-01T10:20:30+02:00", "2024-03-01 10:20:30"])
    assert got == [dt.datetime(2024, 3, 1, 8, 20, 30), dt.datetime(2024, 3, 1, 10, 20, 30)]


def test_parsing_does_not_depend_on_session_zone(spark):
    vals = ["2024-03-01T10:20:30+02:00", "2024-03-01 10:20:30", "3/1/2024", "2024-03-03",
            "2024-03-03T10:00Z"]
    expect = [dt.datetime(2024, 3, 1, 8, 20, 30), dt.datetime(2024, 3, 1, 10, 20, 30),
              dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 3), dt.datetime(2024, 3, 3, 10)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ["America/Los_Angeles", "Asia/Kolkata"]:
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert _one(spark, parse_datetime, vals) == expect
            got = spark.range(1).select(as_of_column("2001-01-01").alias("t")).collect()[0].t
            assert got == dt.datetime(2001, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_zone_helpers(spark):
    from ledgerloom.functions.display import one_decimal
    from ledgerloom.functions.timeutil import ensure_utc, is_midnight, make_naive, utc_midnight

    df = spark.createDataFrame([(dt.datetime(2024, 3, 1, 10, 20, 30),)], "t timestamp_ntz")
    row = df.select(
        ensure_utc(F.col("t")).alias("aware"),
        make_naive(ensure_utc(F.col("t")), "UTC").alias("back"),
        make_naive(ensure_utc(F.col("t")), "Asia/Kolkata").alias("kolkata"),
        utc_midnight("2024-03-01T23:59:00").alias("midnight"),
        is_midnight(F.col("t")).alias("is_mid"),
    ).collect()[0]
    assert row.back == dt.datetime(2024, 3, 1, 10, 20, 30)
    assert row.kolkata == dt.datetime(2024, 3, 1, 15, 50, 30)
    assert row.midnight == dt.datetime(2024, 3, 1) and row.is_mid is False
    # One decimal like Python's "%.1f": half-even on the exact binary value.
    vals = spark.createDataFrame([(v,) for v in [12.25, 0.15, 2.5, 66.195]], "v double")
    got = [r[0] for r in vals.select(one_decimal(F.col("v"))).collect()]
    assert got == [f"{v:.1f}" for v in [12.25, 0.15, 2.5, 66.195]]
