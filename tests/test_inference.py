import datetime as dt

from pyspark.sql import types as T

from conftest import text_frame
from ledgerloom.operators import cleaning as C


def _types(spark, columns, rows):
    df = text_frame(spark, columns, rows)
    choices = C.choose_types(C.parse_measures(df, columns)).collect()
    return {r.column_name: r.spark_type for r in choices}


def test_share_threshold_is_strictly_above_80_percent(spark):
    # 10 rows each: 8 numeric (0.8, stays text) vs 9 numeric (0.9, becomes a number).
    eight = [str(i) for i in range(8)] + ["x", "y"]
    nine = [str(i) + ".5" for i in range(9)] + ["x"]
    t = _types(spark, ["a", "b"], list(zip(eight, nine)))
    assert t == {"a": "string", "b": "double"}


def test_all_numeric_is_numeric_regardless_of_nulls(spark):
    rows = [("1",), (None,), (None,)] * 3 + [("2",)]
    assert _types(spark, ["a"], rows) == {"a": "bigint"}


def test_boolean_all_null_and_whole_numbers(spark):
    rows = [("True", None, "1", "1.0", "inf"), ("false", None, "2.0", "2.5", "3")]
    t = _types(spark, ["b", "n", "i", "d", "f"], rows)
    assert t == {"b": "boolean", "n": "double", "i": "bigint", "d": "double", "f": "double"}


def test_dates_need_more_than_80_percent(spark):
    dates = [f"2024-03-{d:02d}" for d in range(1, 10)] + ["soon"]
    few = [f"2024-03-{d:02d}" for d in range(1, 9)] + ["soon", "later"]
    t = _types(spark, ["d", "e"], list(zip(dates, few)))
    assert t == {"d": "timestamp_ntz", "e": "string"}


def test_numbers_win_over_dates(spark):
    assert _types(spark, ["a"], [("20240301",), ("20240302",)]) == {"a": "bigint"}


def test_infer_types_converts_and_nulls_the_rest(spark):
    rows = [(f"{i}",) for i in range(9)] + [("oops",)]
    df = C.infer_types(text_frame(spark, ["q"], rows), ["q"])
    assert df.schema["q"].dataType == T.LongType()
    vals = [r.q for r in df.orderBy("rid").collect()]
    assert vals == list(range(9)) + [None]
    # coerced values are counted
    ch = C.choose_types(C.parse_measures(text_frame(spark, ["q"], rows), ["q"])).collect()[0]
    assert ch.coerced_count == 1


def test_fill_missing_by_type(spark):
    # 5 of 6 dates parse (83 %, above the 80 % bar); the gap takes the mode.
    rows = [("2024-01-02", "1", "a", "True", "1.5"), ("2024-01-02", None, None, None, None),
            ("2024-01-05", "3", "c", "false", "2.5"), (None, "4", "d", "true", "NaN"),
            ("2024-01-03", "5", "e", "true", "3.5"), ("2024-01-04", "6", "f", "true", "4.5")]
    cols = ["d", "n", "s", "b", "x"]
    typed = C.infer_types(C.replace_na_tokens(text_frame(spark, cols, rows)), cols)
    filled = C.fill_missing(typed, as_of="2030-01-01", skip=["rid"]).orderBy("rid").collect()
    day = lambda d: dt.datetime(2024, 1, d)
    assert [r.d for r in filled] == [day(2), day(2), day(5), day(2), day(3), day(4)]
    assert [r.n for r in filled] == [1, 0, 3, 4, 5, 6]
    assert [r.s for r in filled] == ["a", "", "c", "d", "e", "f"]
    assert [r.b for r in filled] == [True, False, False, True, True, True]
    assert [r.x for r in filled] == [1.5, 0.0, 2.5, 0.0, 3.5, 4.5]


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 3),), (dt.datetime(2024, 1, 1),),
                                (dt.datetime(2024, 1, 3),), (dt.datetime(2024, 1, 1),)],
                               "d timestamp_ntz")
    assert C.column_modes(df, ["d"]).collect()[0].mode_value == dt.datetime(2024, 1, 1)


def test_fill_without_any_date_uses_utc_midnight(spark):
    df = spark.createDataFrame([(None,)], "d timestamp_ntz")
    got = C.fill_missing(df, as_of="2024-05-06T13:14:15").collect()[0].d
    assert got == dt.datetime(2024, 5, 6)


def test_mapping_direction_and_defaults(spark):
    df = text_frame(spark, ["order_date", "qty"], [("2024-01-01", "3")])
    renamed = C.apply_mapping(df, {"order_date": "date", "absent": "x"})
    assert "date" in renamed.columns and "order_date" not in renamed.columns
    try:
        C.apply_mapping(df, {"date": "order_date"})
        raise AssertionError("reversed mapping accepted")
    except ValueError:
        pass
    conformed = C.conform_defaults(renamed, as_of="2024-02-03T10:00:00")
    row = conformed.collect()[0]
    assert row.sku_id == "UNKNOWN" and row.sales_revenue == 0.0 and row.stock_level == 0
    assert row.category == "" and row.date == "2024-01-01"
    only_qty = C.conform_defaults(text_frame(spark, ["qty"], [("3",)]), as_of="2024-02-03T10:00:00")
    assert only_qty.collect()[0].date == dt.datetime(2024, 2, 3)


def test_conform_sales_truncates_stock_like_int(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), "S1", 2.0, 3.0, 4.9, "Food", 1.5),
         (dt.datetime(2024, 1, 2), "S2", 2.0, 3.0, -4.9, "Food", 1.5),
         (dt.datetime(2024, 1, 3), "S3", 2.0, 3.0, None, None, 1.5)],
        "date timestamp_ntz, sku_id string, sales_quantity double, sales_revenue double, "
        "stock_level double, category string, unit_price double")
    out = C.conform_sales(df, "u1").orderBy("date").collect()
    assert [r.stock_level for r in out] == [4, -4, 0]
    assert {r.upload_id for r in out} == {"u1"}


def test_clean_dataframe_runs_all_three_steps(spark):
    rows = [("1", "2024-01-01"), (None, None)] + [(str(i), f"2024-01-0{i}") for i in range(2, 6)]
    df = text_frame(spark, [" Sales Qty ", "Order-Date"], rows)
    out = C.clean_dataframe(df, keep=["rid"]).orderBy("rid").collect()
    assert out[1].sales_qty == 0 and out[1].order_date == dt.datetime(2024, 1, 1)
