import datetime as dt

import pytest

from ledgerloom.operators import sales as S
from ledgerloom.operators import uploads as U


@pytest.fixture()
def sales(spark):
    rows = [(f"id{i}", f"U{i % 2}", dt.datetime(2024, 1, 1 + i % 5), f"SKU{i % 3}", float(i),
             float(i) * 1.25, float(i), "Food", 1.25) for i in range(20)]
    return spark.createDataFrame(rows, "id string, upload_id string, date timestamp_ntz, "
                                       "sku_id string, sales_quantity double, sales_revenue double, "
                                       "stock_level double, category string, unit_price double")


def test_paging_bounds():
    for skip, limit in [(-1, 10), (0, 0), (0, 1001)]:
        with pytest.raises(ValueError):
            S.check_page(skip, limit)
    S.check_page(0, 1000)


def test_list_sales_orders_newest_first_with_id_tiebreak(sales):
    page = S.list_sales(sales, upload_id="U0", skip=1, limit=3).collect()
    assert [r.id for r in page] == ["id4", "id18", "id8"]
    assert page[0].date == "2024-01-05T00:00:00"
    assert S.count_sales(sales, upload_id="U0", sku_id="SKU0").collect()[0].total == 4
    assert S.count_sales(sales, upload_id="", sku_id=None).collect()[0].total == 20


def test_summary_and_lookup(sales):
    s = {r.upload_id: r for r in S.sales_summary(sales).collect()}
    assert s["U1"].total_records == 10 and s["U1"].total_quantity == 100.0
    assert s["U1"].average_revenue == 12.5 and s["U1"].unique_skus == 3
    assert S.get_sale(sales, "id3").collect()[0].sku_id == "SKU0"
    assert S.get_sale(sales, "missing").count() == 0


def test_latest_state_folds_events(spark, sales):
    ts = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([
        ("U0", 1, ts, "uploaded", None, None),
        ("U0", 2, ts + dt.timedelta(minutes=1), "processing", None, None),
        ("U0", 3, ts + dt.timedelta(minutes=2), "error", "bad date", None),
        ("U0", 2, ts + dt.timedelta(minutes=3), None, None, {"a": "b"}),
        ("U1", 1, ts, "uploaded", None, None),
        ("U2", 1, ts, "uploaded", None, None),
        ("U2", 4, ts + dt.timedelta(hours=1), "processed", None, None),
    ], "upload_id string, seq int, event_ts timestamp_ntz, status string, error_message string, "
       "column_mapping map<string,string>")
    st = {r.upload_id: r for r in U.latest_state(ev).collect()}
    assert st["U0"].status == "error" and st["U0"].error_message == "bad date"
    assert st["U0"].column_mapping == {"a": "b"}
    assert st["U2"].processed_at == ts + dt.timedelta(hours=1)
    state = U.latest_state(ev)
    todo = U.uploads_to_process(state, spark.createDataFrame([("U0",), ("U2",), ("U9",)], "upload_id string"))
    assert sorted(r.upload_id for r in todo.collect()) == ["U0"]
    without = U.uploads_without_sales(state, sales)
    assert [r.upload_id for r in without.collect()] == ["U2"]
    detail = {r.upload_id: r for r in U.upload_detail(state, sales).collect()}
    assert detail["U2"].total_records == 0 and detail["U2"].message.startswith("No sales data")
    assert detail["U0"].message is None
