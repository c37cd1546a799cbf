"""Trends, outliers, duplicates, sketches, the CSV export and the JSON edge on hard cases."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import jsonedge as J
from ledgerloom.operators import anomalies as A
from ledgerloom.operators import ranking as R
from ledgerloom.operators import sketches as K
from ledgerloom.operators import trends as T
from ledgerloom.sources.export import ambiguous_cells, export_csv
from ledgerloom.sources.files import read_csv
from ledgerloom.sources.registry import REPORT_TYPE, SCHEMA_TYPE

SALES = "sku_id string, date timestamp_ntz, sales_quantity double, sales_revenue double, unit_price double"
nan, inf = float("nan"), float("inf")


def day(n, hour=0):
    return dt.datetime(2024, 2, 20, hour) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("A", day(0), 2.0, 10.0, 1.0), ("A", day(0, 9), 4.0, 10.0, 2.0), ("A", day(3), 6.0, 0.5, 3.0),
            ("A", day(12), 8.0, None, 4.0), ("A", None, 100.0, 1.0, 5.0), ("B", day(1), None, None, nan),
            (None, day(2), 1.0, 1.0, 7.5), (None, day(9), 3.0, 2.0, None)]
    return spark.createDataFrame(rows, SALES)


def test_rolling_averages(sales):
    got = {(r.sku_id, r.day): r for r in T.rolling_averages(sales, (7,)).collect()}
    assert len(got) == 6
    a = {k: got["A", day(k).date()] for k in (0, 3, 12)}
    assert (a[0].quantity, a[0].quantity_7d, a[0].n_sales) == (6.0, 6.0, 2)
    assert a[3].quantity_7d == 12.0 / 4 and a[12].quantity_7d == 8.0 / 7 and a[12].revenue_7d == 0.0
    assert got["B", day(1).date()].quantity_7d == 0.0
    assert got[None, day(9).date()].quantity_7d == 3.0 / 7
    with pytest.raises(ValueError):
        T.rolling_averages(sales, (0,))


def test_lags_on_a_dense_calendar(sales):
    got = {(r.sku_id, r.day): r for r in T.lagged_sales(sales, (3, 7)).collect()}
    assert len(got) == 13 + 1 + 8
    for n in range(13):
        r = got["A", day(n).date()]
        want = {0: 6.0, 3: 6.0, 12: 8.0}
        assert r.quantity == want.get(n, 0.0)
        assert r.quantity_lag_3 == (None if n < 3 else want.get(n - 3, 0.0))
        assert r.quantity_lag_7 == (None if n < 7 else want.get(n - 7, 0.0))
    assert got[None, day(9).date()].quantity_lag_7 == 1.0
    few = {(r.sku_id, r.day): r for r in T.lagged_sales(sales, (3, 7), dense=False).collect()}
    assert len(few) == 6 and all(got[k] == v for k, v in few.items())
    assert T.lagged_sales(sales.where("false")).count() == 0


def test_trend(sales):
    got = {(r.period, r.all_skus, r.sku_id, r.start): r for r in T.sales_trend(sales).collect()}
    monday = dt.date(2024, 2, 19)
    assert got["week", True, None, monday].revenue == 21.5
    week = got["week", True, None, monday + dt.timedelta(days=7)]
    assert (week.revenue, week.revenue_change) == (2.0, -19.5) and week.revenue_change_pct == pytest.approx(-19.5 / 21.5 * 100)
    # A null SKU is a SKU, and is not the total.
    assert got["week", False, None, monday].revenue == 1.0
    assert got["day", False, "A", day(0).date()].revenue_change is None
    # The day before had no sales: it is 0, and there is no percentage of it.
    assert (got["day", False, "A", day(3).date()].revenue_change, got["day", False, "A", day(3).date()].revenue_change_pct) == (0.5, None)
    assert got["month", True, None, dt.date(2024, 2, 1)].n_sales == 6


def test_price_statistics_do_not_cancel(spark, sales):
    got = {r.sku_id: r for r in T.price_statistics(sales).collect()}
    assert set(got) == {"A", None} and got[None].stddev_price is None and got[None].n_prices == 1
    assert got["A"].mean_price == 3.0 and got["A"].stddev_price == pytest.approx(statistics.stdev([1, 2, 3, 4, 5]), rel=1e-15)
    prices = [1e9 + i % 7 * 0.01 for i in range(900)]
    rows = spark.createDataFrame([("S", p) for p in prices], "sku_id string, unit_price double")
    one = T.price_statistics(rows.repartition(7)).first()
    exact = [round(i % 7 * 0.01, 2) for i in range(900)]
    assert one.stddev_price == pytest.approx(statistics.stdev(exact), rel=1e-9)
    assert one == T.price_statistics(rows.coalesce(1)).first()


def test_quartiles_and_fences(spark):
    r = random.Random(2)
    rows = [("hot", r.choice([float(r.randint(0, 50)), r.gauss(0, 1000), 5.0])) for _ in range(3000)]
    rows += [(f"s{i % 40}", float(i * 7919 % 100)) for i in range(400)] + [("one", 3.0), ("none", None), (None, -0.0), (None, 0.0)]
    df = spark.createDataFrame([*rows, ("hot", nan), ("hot", None)], "sku_id string, sales_quantity double")
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    for options in ({}, {"limit": 100, "slices": 16}):
        got = {x.sku_id: x for x in A.quartiles(df, **options).collect()}
        assert set(got) == set(by)
        for k, vs in by.items():
            q = statistics.quantiles(vs, n=4, method="inclusive") if len(vs) > 1 else [vs[0]] * 3
            assert (got[k].n_values, got[k].q1, got[k].q3) == (len(vs), pytest.approx(q[0], rel=1e-12), pytest.approx(q[2], rel=1e-12))
    flagged = A.flag_outliers(df.withColumn("q1", F.lit("own")), limit=100, slices=16)
    assert flagged.count() == df.count() and flagged.columns == ["sku_id", "sales_quantity", "q1", "low_fence", "high_fence", "outlier"]
    for x in flagged.where("sku_id = 'hot'").collect():
        v = x.sales_quantity
        assert x.outlier == (v is not None and not math.isnan(v) and not x.low_fence <= v <= x.high_fence)


def test_a_hot_group_is_sliced(spark):
    """No slice of a hot group holds more than a small part of it, and positions are exact."""
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
                                    (F.col("id") * 7919 % 20_011).alias("v"))
    rows, split = R.sliced(df, ["k"], "v", limit=1000, slices=32)
    sizes = {(r.k, r._slice): r["count"] for r in rows.groupBy("k", "_slice").count().collect()}
    assert split and max(sizes.values()) < 1200 and sum(n for (k, _), n in sizes.items() if k == "hot") > 13_000
    assert {s for k, s in sizes if k != "hot"} == {0}
    got = R.running_total(df, ["k"], "v", F.lit(1).cast("bigint"), "at", limit=1000, slices=32).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.v, r.at))
    assert all([a for _, a in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())


def test_duplicate_rows_are_null_and_nan_safe(spark):
    rows = [(0, "x", 1.0, None), (1, "x", 1.0, None), (2, None, nan, 5), (3, None, nan, 5), (4, "x", 1.0, 0),
            (5, "", -0.0, 1), (6, "", 0.0, 1), (7, "1:x", None, 1), (8, None, None, None), (9, None, None, None), (10, "x", 1.0, None)]
    df = spark.createDataFrame(rows, "at long, `c.o l` string, _n double, row int")
    for options in ({}, {"limit": 1, "slices": 3}):
        got = {r["at"]: (r["copies"], r["occurrence"], r["first_row"]) for r in A.duplicate_rows(df, "at", **options).collect()}
        assert got == {0: (3, 1, 0), 1: (3, 2, 0), 10: (3, 3, 0), 2: (2, 1, 2), 3: (2, 2, 2), 4: (1, 1, 4), 5: (2, 1, 5),
                       6: (2, 2, 5), 7: (1, 1, 7), 8: (2, 1, 8), 9: (2, 2, 8)}
    own = df.withColumnRenamed("row", "copies")
    assert A.duplicate_rows(own, "at", ["copies"]).columns == ["at", "c.o l", "_n", "copies", "occurrence", "first_row"]
    assert A.drop_duplicate_rows(own, "at", ["copies"]).columns == own.columns
    assert sorted(r["at"] for r in A.drop_duplicate_rows(df, "at").collect()) == [0, 2, 4, 5, 7, 8]
    assert A.duplicate_rows(df.where("false"), "at").count() == 0


def test_sketches_unite(spark, tmp_path):
    df = spark.range(30_000).select((F.col("id") % 5).cast("string").alias("upload_id"), (F.col("id") % 9000).cast("string").alias("sku_id"))
    df = df.unionByName(spark.createDataFrame([("nulls", None)], "upload_id string, sku_id string"))
    path = str(tmp_path / "s")
    K.store_sketches(K.sku_sketches(df), path)
    K.store_sketches(K.sku_sketches(df.where("upload_id = '1'")), path)      # stored again
    kept = K.read_sketches(spark, path)
    assert kept.count() == 6 and kept.where("upload_id = '1'").first().n_sales == 6000
    for uploads in (None, ["0", "3"], ["nulls"], ["no such"]):
        chosen = df if uploads is None else df.where(F.col("upload_id").isin(uploads))
        exact = chosen.agg(F.count_distinct("sku_id")).first()[0]
        assert K.distinct_skus(kept, uploads).first().approx_skus == pytest.approx(exact, rel=0.07)


HARD = [(1, None, "a"), (2, "", ""), (3, " lead ", "x,y"), (4, 'q"uo"te', "l1\nl2"), (5, "cr\rlf\r\nend", "\\back\\"),
        (6, '"', "\n"), (7, "''", "NA"), (8, "é漢🙂 x", "\t"), (9, "end\\", '\\"'), (10, None, None),
        (11, 'a"b\nc"d', " "), (12, "\x00z", "#c"), (13, "long " * 9000, ";")]


def test_export_reads_back(spark, tmp_path):
    df = spark.createDataFrame(HARD, "id long, `te,xt` string, u string").repartition(3)
    for order in (None, ["id"], ["u", "id"]):
        path = str(tmp_path / "-".join(["e", *(order or [])]))
        export_csv(df, path, order)
        got = sorted((int(a), b, c) for a, b, c in read_csv(spark, path, keep_empty=True).collect())
        assert got == HARD
    whole = spark.read.text(str(tmp_path / "e-id"), wholetext=True).collect()
    assert whole[0].value.startswith('id,"te,xt",u\n1,,a\n2,"",""\n3, lead ,"x,y"\n')
    path = str(tmp_path / "one")
    export_csv(df.select("u"), path)
    assert sorted(r[0] for r in read_csv(spark, path, keep_empty=True).collect()) == sorted(u or "" for _, _, u in HARD)
    typed = spark.sql("select timestamp_ntz'2024-01-02 03:04:05' as t, array(1, 2) as a, 1.5D as x, true as b, x'00FF' as y")
    path = str(tmp_path / "typed")
    export_csv(typed, path)
    assert tuple(read_csv(spark, path).first()) == ("2024-01-02T03:04:05", "[1,2]", "1.5", "true", "AP8=")
    assert {r.column_name: r.n_na_tokens for r in ambiguous_cells(df).collect()} == {"te,xt": 1, "u": 2}


def test_header_with_a_line_break(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"order\ndate",sku,"a ""b"""\n2024-01-01,x,1\n"2024\n-2",y,2\n')
    (tmp_path / "b.csv").write_bytes('﻿"order\ndate",sku,é\n1,2,3\n'.encode())
    a = read_csv(spark, str(tmp_path / "a.csv"))
    assert a.columns == ["order\ndate", "sku", 'a "b"'] and [tuple(r) for r in a.collect()] == [
        ("2024-01-01", "x", "1"), ("2024\n-2", "y", "2")]
    assert read_csv(spark, str(tmp_path / "b.csv")).columns == ["order\ndate", "sku", "é"]


def test_empty_upload_is_named_so(spark, tmp_path):
    from ledgerloom.plans.upload import profile_upload

    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="file is empty"):
        profile_upload(spark, str(tmp_path / "none.csv"))


def test_json_edge_round_trip(spark):
    doc = ([("c", "string", None, 1, nan, 2, ["a", None, "é\"\n"], 0), ("d", None, None, None, inf, None, None, None)], 3, 2, "d", None)
    report = (False, 2, 1, 1, 0, [("error", "t", None, "m", "s")], "sum")
    df = spark.createDataFrame([(1, doc, report, {"a": "b", "c": None}), (2, None, None, None), (3, ([], 0, 0, None, None), report, {})],
                               "id int, s " + SCHEMA_TYPE.simpleString() + ", r " + REPORT_TYPE.simpleString() + ", m map<string,string>")
    text = J.to_json_text(df, ["s", "r", "m"])
    assert "NaN" not in text.first().s and text.where("id = 2").first().s is None
    kinds = {c: df.schema[c].dataType for c in ("s", "r", "m")}
    back = J.from_json_text(text, kinds)
    want = df.withColumn("s", J.finite(F.col("s"), kinds["s"]))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, want.collect()))
    assert not back.where("s_unread or r_unread or m_unread").count()
    old = spark.createDataFrame([('{"columns": [{"name": "x", "null_percentage": NaN, "dropped": 1}], "row_count": 4}',),
                                 ("not json",), ("{broken",), ("[1]",), ("",), (None,)], "s string")
    got = J.from_json_text(old, {"s": SCHEMA_TYPE}).collect()
    assert got[0].s.row_count == 4 and got[0].s.columns[0].name == "x" and got[0].s.columns[0].null_percentage is None
    assert got[0].s.columns[0].coerced_count is None and got[0].s.suggested_sku_column is None
    assert [r.s is None for r in got] == [False, True, True, True, True, True]
    assert [r.s_unread for r in got] == [False, True, True, True, True, False]


def test_a_hot_sku_is_days_not_sales(spark):
    """Windows and calendars stand above a partial aggregate by day."""
    df = spark.createDataFrame([], SALES)
    for plan in (T.rolling_averages(df), T.lagged_sales(df), T.sales_trend(df)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "partial_sum" in text or "partial_try_sum" in text
        if "Window" in text:
            assert text.index("Window") < text.index("HashAggregate")
