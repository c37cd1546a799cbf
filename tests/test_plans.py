import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.sales import sales_summary
from ledgerloom.operators.uploads import latest_state
from ledgerloom.plans.process import preview_processing, process_upload
from ledgerloom.plans.upload import profile_upload
from ledgerloom.sources import registry as R
from ledgerloom.sources.sales_table import read_sales


def _sample_csv(folder):
    lines = ["Order Date,Product Code,Category,QTY,Unit Price,Stock Level"]
    for i in range(40):
        qty = -2 if i % 10 == 0 else i
        stock = "" if i % 8 == 0 else str(10 + i)
        lines.append(f"2024-0{1 + i % 3}-{1 + i % 27:02d},P{i % 4},{'AB'[i % 2]},{qty},{1.5 + i},{stock}")
    p = os.path.join(folder, "upload.csv")
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    return p


def test_upload_then_process_then_retry(spark, tmpdir_path):
    path = _sample_csv(tmpdir_path)
    reg = os.path.join(tmpdir_path, "registry")
    out = os.path.join(tmpdir_path, "sales")
    res = profile_upload(spark, path, reg, upload_id="u1", as_of="2024-02-15")
    cols = {c["name"]: c for c in res.schema["columns"]}
    assert cols["order_date"]["detected_type"] == "date"
    assert cols["qty"]["detected_type"] == "integer"
    assert cols["stock_level"]["null_count"] == 5
    assert res.schema["suggested_date_column"] == "order_date"
    assert res.schema["suggested_sku_column"] == "product_code"
    types = [i["type"] for i in res.validation["issues"]]
    assert types == ["missing_values", "future_dates", "negative_values"]
    assert len(res.preview) == 10 and res.preview[0]["qty"] == -2

    R.save_mapping(spark, reg, "u1", {"order_date": "date", "product_code": "sku_id",
                                      "qty": "sales_quantity"})
    prev = preview_processing(spark, reg, "u1", as_of="2024-02-15")
    assert prev["total_rows"] == 40 and len(prev["preview"]) == 20
    assert {"date", "sku_id", "sales_quantity", "sales_revenue"} <= set(prev["columns"])

    stats = process_upload(spark, reg, out, "u1", as_of="2024-02-15")
    assert stats["rows_inserted"] == 40
    with pytest.raises(ValueError, match="already processed"):
        process_upload(spark, reg, out, "u1")

    # An error status may be retried; the partition is replaced, not appended to.
    R.record_status(spark, reg, "u1", "error", error_message="disk full")
    process_upload(spark, reg, out, "u1", as_of="2024-02-15")
    summary = sales_summary(read_sales(spark, out)).collect()
    assert len(summary) == 1 and summary[0].total_records == 40
    assert summary[0].total_revenue == 0.0 and summary[0].unique_skus == 4
    state = latest_state(R.read_events(spark, reg)).filter(F.col("upload_id") == "u1").collect()[0]
    assert state.status == "processed" and state.row_count == 40 and state.column_count == 6


def test_rejected_file(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "notes.pdf")
    with open(p, "wb") as f:
        f.write(b"%PDF")
    with pytest.raises(ValueError, match="File type not allowed"):
        profile_upload(spark, p)


def test_write_replaces_only_its_upload(spark, tmpdir_path):
    import datetime as dt

    from ledgerloom.sources.sales_table import write_sales

    out = os.path.join(tmpdir_path, "sales")
    schema = ("upload_id string, date timestamp_ntz, sku_id string, sales_quantity double, "
              "sales_revenue double, stock_level int, category string, unit_price double")

    def frame(upload, n):
        return spark.createDataFrame(
            [(upload, dt.datetime(2024, 1, 1 + i), f"S{i}", 1.0, 2.0, 3, "c", 2.0) for i in range(n)],
            schema)

    assert write_sales(frame("a", 3), out) == 3
    assert write_sales(frame("b", 2), out) == 2
    assert write_sales(frame("a", 5), out) == 5          # replaces a, keeps b
    counts = {r.upload_id: r["count"] for r in read_sales(spark, out).groupBy("upload_id").count().collect()}
    assert counts == {"a": 5, "b": 2}
