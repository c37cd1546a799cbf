import os

from ledgerloom.operators.uploads import latest_state
from ledgerloom.sources import registry as R
from ledgerloom.sources.sales_table import read_sales
from ledgerloom.streaming.landing import start_intake


def test_landing_folder_intake(spark, tmpdir_path):
    landing = os.path.join(tmpdir_path, "landing")
    os.makedirs(landing)
    with open(os.path.join(landing, "a.csv"), "w") as f:
        f.write("date,sku_id,sales_quantity\n" + "".join(
            f"2024-01-{d:02d},S{d % 3},{d}\n" for d in range(1, 29)))
    with open(os.path.join(landing, "notes.pdf"), "wb") as f:
        f.write(b"%PDF")
    with open(os.path.join(landing, "broken.xlsx"), "wb") as f:
        f.write(b"PK\x03\x04 not really a workbook")
    reg, sales = os.path.join(tmpdir_path, "reg"), os.path.join(tmpdir_path, "sales")
    ck = os.path.join(tmpdir_path, "ck")
    q = start_intake(spark, landing, reg, ck, sales_path=sales, as_of="2024-06-01")
    q.awaitTermination(300)
    state = {r.filename: r for r in latest_state(R.read_events(spark, reg)).collect()}
    assert state["a.csv"].status == "processed"
    assert state["notes.pdf"].status == "error"
    assert state["broken.xlsx"].status == "error"
    assert read_sales(spark, sales).count() == 28
    # A second run finds nothing new.
    q2 = start_intake(spark, landing, reg, ck, sales_path=sales, as_of="2024-06-01")
    q2.awaitTermination(300)
    assert read_sales(spark, sales).count() == 28
