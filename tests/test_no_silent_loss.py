"""Values that used to vanish without a word: dates, wide numbers, fractions, stock."""

import datetime as dt
import os

from pyspark.sql import functions as F

from ledgerloom.functions import parsing as N
from ledgerloom.functions.timeutil import isoformat
from ledgerloom.operators import cleaning as C
from ledgerloom.operators.sales import sales_summary
from ledgerloom.plans.process import process_upload
from ledgerloom.plans.upload import profile_upload
from ledgerloom.sources import registry
from ledgerloom.sources.sales_table import read_sales


def _dates(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(N.parse_datetime(F.col("t"))).collect()]


def test_dates_with_clock_times_and_names(spark):
    d = dt.datetime
    cases = {
        "3/1/2024 10:30": d(2024, 3, 1, 10, 30), "3/1/2024 10:30:00 PM": d(2024, 3, 1, 22, 30),
        "13/4/2024": d(2024, 4, 13), "March 5, 2024": d(2024, 3, 5), "5-Mar-2024": d(2024, 3, 5),
        "13/2/24": d(2024, 2, 13), "2024.03.01": d(2024, 3, 1), "Sept 9 2023": d(2023, 9, 9),
        "5th March 2024 12:00 am": d(2024, 3, 5), "1/2/71": d(1971, 1, 2),
        "2024-03-01T10:20:30+02:00": d(2024, 3, 1, 8, 20, 30),
        "2024-03-01 10:20:30.25": d(2024, 3, 1, 10, 20, 30, 250000),
        "3/1/2024 13:00 PM": None, "3/1/2024 25:00": None, "2/30/2024": None, "12:30": None,
        "12345": None, "soon": None, "": None, "99 Foo 2024": None,
    }
    got = _dates(spark, list(cases))
    assert {k: v for k, v, w in zip(cases, got, cases.values()) if v != w} == {}


def test_dates_in_zones_with_summer_time(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/Sao_Paulo", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            # Midnight that the clock skipped, an hour it ran twice, an hour it skipped.
            assert _dates(spark, ["11/4/2018", "2023-11-05T05:30:00Z", "2023-11-05T06:30:00Z",
                                  "3/12/2023 2:30"]) == [
                dt.datetime(2018, 11, 4), dt.datetime(2023, 11, 5, 5, 30),
                dt.datetime(2023, 11, 5, 6, 30), dt.datetime(2023, 3, 12, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_iso_text_prints_fractions(spark):
    row = spark.sql("select timestamp_ntz'2024-01-02 01:02:03.45' a, timestamp_ntz'2024-01-02 00:00:00' b")
    got = row.select(isoformat(F.col("a")), isoformat(F.col("b"))).collect()[0]
    assert tuple(got) == ("2024-01-02T01:02:03.450000", "2024-01-02T00:00:00")


def test_sums_keep_small_amounts_and_infinities(spark):
    def total(values):
        df = spark.createDataFrame([("U", "s", v, v, None) for v in values],
                                   "upload_id string, sku_id string, sales_quantity double, "
                                   "sales_revenue double, date timestamp_ntz")
        r = sales_summary(df).collect()[0]
        return r.total_revenue, r.average_revenue

    assert total([0.004] * 1000) == (4.0, 0.004)
    assert total([1.0, float("inf")]) == (float("inf"), float("inf"))
    assert total([None]) == (0.0, 0.0)


def test_wide_integers_and_stock(spark):
    codes = ["9007199254740993", "9007199254740992", "12345678901234567", "12345678901234568"]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert [r[0] for r in C.infer_types(df).collect()] == [int(c) for c in codes]
    big = spark.createDataFrame([(3_000_000_000.9,), (None,)], "stock_level double").withColumns({
        c: F.lit(None).cast("string") for c in ("date", "sku_id", "sales_quantity", "sales_revenue",
                                                "category", "unit_price")})
    assert [r.stock_level for r in C.conform_sales(big, "U").collect()] == [3_000_000_000.0, 0.0]


def test_forty_row_file_end_to_end(spark, tmpdir_path):
    lines = ["Order Date,SKU,Quantity,Revenue,Stock Level"]
    for i in range(40):
        lines.append(f"3/{i % 28 + 1}/2024 10:{i:02d},{9007199254740990 + i % 4},0.125,1.005,{3_000_000_000 + i}")
    lines[5] = lines[5].replace("0.125", "a few")
    path = os.path.join(tmpdir_path, "s.csv")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    reg, sales = os.path.join(tmpdir_path, "reg"), os.path.join(tmpdir_path, "sales")
    up = profile_upload(spark, path, reg, as_of="2024-07-01")
    info = {c["name"]: c for c in up.schema["columns"]}
    assert info["sku"]["unique_count"] == 4 and info["quantity"]["coerced_count"] == 1
    assert info["order_date"]["detected_type"] == "datetime"
    registry.save_mapping(spark, reg, up.upload_id, {
        "order_date": "date", "sku": "sku_id", "quantity": "sales_quantity",
        "revenue": "sales_revenue"})
    done = process_upload(spark, reg, sales, up.upload_id)
    assert done["rows_inserted"] == 40 and done["coerced"] == {"quantity": 1}
    assert done["rows_without_date"] == 0
    row = sales_summary(read_sales(spark, sales)).collect()[0]
    assert (row.total_quantity, row.total_revenue, row.unique_skus) == (4.875, 40.2, 4)
    assert read_sales(spark, sales).agg(F.max("stock_level")).collect()[0][0] == 3_000_000_039.0
