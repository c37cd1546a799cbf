import datetime as dt

from conftest import text_frame
from ledgerloom.operators import cleaning as C
from ledgerloom.operators import profiling as P


def _schema(spark, cols, rows, samples=True):
    typed = C.infer_types(C.replace_na_tokens(text_frame(spark, cols, rows)), cols)
    return {r.column_name: r for r in P.detect_schema(typed, "rid", cols, with_samples=samples).collect()}


def test_profile_counts_nulls_and_distinct(spark):
    rows = [("1", "a"), ("1.0", "a"), (None, "b"), ("2", None)]
    s = _schema(spark, ["n", "t"], rows)
    assert s["n"].null_count == 1 and s["n"].unique_count == 2   # 1 and 1.0 are one value
    assert s["n"].null_percentage == 25.0
    assert s["t"].unique_count == 2 and s["t"].n_rows == 4


def test_labels(spark):
    n = 600
    rows = [(f"2024-01-{1 + i % 28:02d}", f"2024-01-01 10:{i % 60:02d}:00", f"SKU{i % 50}",
             ["Food", "Toys"][i % 2], str(i), f"{i}.5", ["yes", "no"][i % 2], None)
            for i in range(n)]
    cols = ["d", "dt", "sku", "cat", "i", "x", "yn", "empty"]
    s = _schema(spark, cols, rows, samples=False)
    got = {c: s[c].detected_type for c in cols}
    assert got == {"d": "date", "dt": "datetime", "sku": "string", "cat": "categorical",
                   "i": "integer", "x": "numeric", "yn": "boolean", "empty": "unknown"}


def test_categorical_needs_fewer_than_50_distinct(spark):
    rows = [(f"v{i % 49}", f"w{i % 50}") for i in range(1000)]
    s = _schema(spark, ["a", "b"], rows, samples=False)
    assert s["a"].detected_type == "categorical" and s["b"].detected_type == "string"


def test_samples_are_first_five_in_row_order_with_repeats(spark):
    rows = [(v,) for v in [None, "Food", "Food", "Toys", None, "Food", "Tools", "Last"]]
    s = _schema(spark, ["c"], rows)
    assert s["c"].sample_values == ["Food", "Food", "Toys", "Food", "Tools"]


def test_suggest_mapping_traps(spark):
    names = ["Order Date", "width", "discount", "Product-Code", "unit_price", "on_hand",
             "segment", "notes"]
    expect = ["date", "date", "quantity", "sku", "revenue", "stock", "category", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(P.suggest_mapping_expr(df.n)).collect()] == expect


def test_suggested_keys_need_date_type(spark):
    rows = [("x", "2024-01-01", "S1")] * 3
    s = P.suggested_keys(P.detect_schema(
        C.infer_types(text_frame(spark, ["date_note", "sold_date", "sku"], rows),
                      ["date_note", "sold_date", "sku"]), "rid", with_samples=False)).collect()[0]
    assert s.suggested_date_column == "sold_date" and s.suggested_sku_column == "sku"
    assert s.row_count == 3 and s.column_count == 3


def test_preview_is_json_safe(spark):
    df = spark.createDataFrame([(2, float("nan"), dt.datetime(2024, 1, 1)),
                                (1, float("inf"), dt.datetime(2024, 1, 2, 3, 4, 5))],
                               "rid int, x double, t timestamp_ntz")
    rows = P.preview(df, "rid").collect()
    assert [r.x for r in rows] == [None, None]
    assert [r.t for r in rows] == ["2024-01-02T03:04:05", "2024-01-01T00:00:00"]


def test_schema_document_nests_columns(spark):
    typed = C.infer_types(text_frame(spark, ["a", "b"], [("1", "x"), ("2", "y")]), ["a", "b"])
    doc = P.schema_document(P.detect_schema(typed, "rid", ["a", "b"])).collect()[0][0]
    assert [c.name for c in doc.columns] == ["a", "b"] and doc.row_count == 2


def test_all_null_column_with_samples(spark):
    s = _schema(spark, ["a", "b"], [("1", None), ("2", None)])
    assert s["b"].detected_type == "unknown" and s["b"].sample_values == []


def test_zero_and_minus_zero_are_one_value(spark):
    df = spark.createDataFrame([(1, 0.0), (2, -0.0), (3, float("nan"))], "rid int, x double")
    row = P.profile_columns(df, ["x"], "rid").collect()[0]
    assert row.unique_count == 1 and row.null_count == 1 and row.n_zero == 2


def test_samples_of_a_column_that_starts_empty(spark):
    rows = [(i, "a", f"v{i}" if i >= 900 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "rid int, x string, late string")
    got = {}
    for r in P.sample_values(df, "rid", head_rows=50).collect():
        got.setdefault(r.column_name, []).append((r.sample_rank, r.sample_value))
    assert sorted(got["x"]) == [(k, "a") for k in range(1, 6)]
    assert sorted(got["late"]) == [(k, f"v{899 + k}") for k in range(1, 6)]
