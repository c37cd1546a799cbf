import datetime as dt

from pyspark.sql import functions as F

from conftest import text_frame
from ledgerloom.operators import cleaning as C
from ledgerloom.operators import profiling as P
from ledgerloom.operators import validation as V


def _issues(spark, cols, rows, as_of="2024-07-01"):
    typed = C.infer_types(C.replace_na_tokens(text_frame(spark, cols, rows)), cols)
    schema = P.detect_schema(typed, "rid", cols, with_samples=False, as_of=as_of)
    return V.validation_issues(schema, as_of).orderBy("rule_order", "seq").collect()


def test_missing_value_thresholds_at_20_and_50(spark):
    # 10 rows: a 20 % null -> info; b 50 % -> warning; c 60 % -> error; d 0 % -> nothing.
    rows = []
    for i in range(10):
        rows.append(("x" if i >= 2 else None, "y" if i >= 5 else None, "z" if i >= 6 else None, "w"))
    got = [(i.type, i.column, i.message) for i in _issues(spark, ["a", "b", "c", "d"], rows)]
    assert got == [
        ("missing_values", "a", 'Column "a" has 20.0% missing values'),
        ("high_missing_values", "b", 'Column "b" has 50.0% missing values'),
        ("excessive_missing_values", "c", 'Column "c" has 60.0% missing values'),
    ]


def test_date_rules_with_as_of(spark):
    rows = [(f"2024-06-{d:02d}", "S") for d in range(1, 30)] + [("1999-12-31", "S"), ("2024-08-01", "S")]
    got = {i.type: i.message for i in _issues(spark, ["sale_date", "sku"], rows)}
    assert got["future_dates"] == "1 rows have future dates"
    assert got["very_old_dates"] == "1 rows have dates before year 2000"
    assert "short_date_range" not in got


def test_short_range_is_whole_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10),), (dt.datetime(2024, 1, 31, 9),)],
                               "date timestamp_ntz")
    issues = V.date_issues(V.date_rule_counts(df, "date", "2030-01-01")).collect()
    assert [(i.type, i.message) for i in issues] == [("short_date_range", "Data spans only 29 days")]


def test_no_parsed_date_is_an_error(spark):
    df = spark.createDataFrame([(None,)], "date timestamp_ntz")
    issues = V.date_issues(V.date_rule_counts(df, "date", "2030-01-01")).collect()
    assert [i.type for i in issues] == ["invalid_dates"]


def test_numeric_rules(spark):
    rows = [("-1", "0"), ("2", "0"), ("3", "0"), ("4", "5")]
    got = [(i.type, i.column, i.message) for i in _issues(spark, ["qty", "stock"], rows)]
    assert got == [("negative_values", "qty", '1 rows have negative values in "qty"'),
                   ("many_zeros", "stock", 'More than 50% of values in "stock" are zero')]


def test_exactly_half_zeros_is_fine(spark):
    rows = [("0",), ("0",), ("1",), ("2",)]
    assert _issues(spark, ["qty"], rows)[0].type == "too_few_columns"
    assert all(i.type != "many_zeros" for i in _issues(spark, ["qty"], rows))


def test_structure_rules(spark):
    empty = spark.createDataFrame([], "rid int, a string, b string")
    schema = P.detect_schema(empty, "rid", ["a", "b"], with_samples=False)
    issues = V.validation_issues(schema).collect()
    assert [i.type for i in issues] == ["empty_file"]
    wide_cols = [f"c{i}" for i in range(51)]
    wide = text_frame(spark, wide_cols, [tuple("x" for _ in wide_cols)])
    schema = P.detect_schema(wide, "rid", wide_cols, with_samples=False)
    got = [(i.type, i.message) for i in V.validation_issues(schema).collect()]
    assert got == [("too_many_columns", "File has 51 columns, which is unusual")]


def test_report_summary_and_badge(spark):
    rows = [("x" if i > 6 else None, str(i)) for i in range(10)]
    cols = ["mostly_empty", "qty"]
    typed = C.infer_types(C.replace_na_tokens(text_frame(spark, cols, rows)), cols)
    schema = P.detect_schema(typed, "rid", cols, with_samples=False)
    report = V.validation_report(V.validation_issues(schema)).collect()[0]
    assert not report.is_valid and report.errors == 1
    assert report.summary == "File has 1 error(s) that must be fixed before processing"
    badge = V.validation_badge(V.validation_report(V.validation_issues(schema)))
    assert badge.collect()[0].badge == "error"
    clean = spark.createDataFrame([], "severity string, type string, column string, message string, "
                                      "suggestion string, rule_order int, seq int")
    r = V.validation_report(clean).collect()[0]
    assert r.is_valid and r.total_issues == 0 and r.summary == "File validation passed with no issues"
    assert V.validation_badge(V.validation_report(clean)).collect()[0].badge == "ok"
    assert F is not None
