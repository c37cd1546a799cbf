"""All files of a micro-batch at once, against the plans of a single file."""

import json
import os

import pytest

from ledgerloom.operators.uploads import latest_state
from ledgerloom.plans import batch as B
from ledgerloom.plans.process import process_upload
from ledgerloom.plans.upload import profile_upload
from ledgerloom.sources import registry as R
from ledgerloom.sources.sales_table import read_sales

AS_OF = "2024-06-01"


def write_files(folder):
    os.makedirs(folder)
    days = [f"2024-01-{d:02d}" for d in range(1, 29)]
    texts = {
        "a.csv": "Date,SKU ID,Sales Quantity,Unit Price,In Promo\n" + "".join(
            f"{d},S{i % 3},{i if i % 4 else ''},{i}.5,{'true' if i % 2 else 'false'}\n" for i, d in enumerate(days)),
        "b.csv": "date,sku_id,sales_quantity\n" + "".join(f"{d},T{i},{-i}\n" for i, d in enumerate(days)) + "soon,T99,x\n",
        "c.txt": "date\tsku_id\tsales_quantity\tstock_level\n" + "".join(f"1/{i + 1}/2024 10:30\tU{i}\t0\t{i}.7\n" for i in range(12)),
        "quoted.csv": '"da\nte",sku_id,category,date\n' + "".join(f'x,Q{i},"line\none",2024-02-0{i + 1}\n' for i in range(9)),
        "latin é 1.csv": "date,sku_id,category\n2024-03-01,café,é\n2024-03-02,,N/A\n",
        "header.csv": "date,sku_id,sales_quantity\n",
        "one.csv": "date\n2024-01-01\n",
        "toolong.csv": "date,sku_id\n2024-01-01,a\n2024-01-02,b,c\n",
        "numbers.csv": "date,sku_id\n1,a\n2,b\n",
        "empty.csv": "",
        "text.csv": "sku_id,note\n" + "".join(f"s{i},{'' if i < 250 else f'n{i}'}\n" for i in range(300)),
    }
    for name, text in texts.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(text.encode("latin-1" if name.startswith("latin") else "utf-8"))
    return {n: os.path.join(folder, n) for n in texts}


def plain(x):
    return json.loads(json.dumps(x, default=str))


def sales_of(spark, path):
    rows = [r.asDict() for r in read_sales(spark, path).drop("created_at", "id").collect()]
    return sorted(json.dumps(r, default=str, sort_keys=True) for r in rows)


def test_the_batch_gives_what_single_files_give(spark, tmp_path):
    paths = write_files(str(tmp_path / "in"))
    reg, sales = str(tmp_path / "reg"), str(tmp_path / "sales")
    mappings = {"quoted.csv": {"category": "category"}, "text.csv": {"note": "category"}}
    got = {r["upload_id"]: r for r in B.run_batch(spark, paths, reg, sales, mappings, as_of=AS_OF)}
    assert set(got) == set(paths)
    state = {r.upload_id: r.asDict(recursive=True) for r in latest_state(R.read_events(spark, reg)).collect()}
    alone, failed = str(tmp_path / "alone"), set()
    for name, path in paths.items():
        own = str(tmp_path / f"reg-{len(name)}-{name[0]}")
        try:
            res = profile_upload(spark, path, own, upload_id=name, as_of=AS_OF)
            assert plain(state[name]["detected_schema"]) == plain(res.schema), name
            assert plain(state[name]["validation_report"]) == plain(res.validation), name
            assert state[name]["row_count"] == res.schema["row_count"] and state[name]["filename"] == name
            if not res.validation["is_valid"]:
                assert got[name]["status"] == "uploaded", name
                continue
            if name in mappings:
                R.save_mapping(spark, own, name, mappings[name])
            one = process_upload(spark, own, alone, name, as_of=AS_OF)
            assert {k: got[name][k] for k in one} == one, name
        except Exception as e:      # noqa: BLE001 - the same files must fail
            if isinstance(e, AssertionError):
                raise
            failed.add(name)
    assert failed == {n for n, r in got.items() if r["status"] == "error"} == {"toolong.csv", "numbers.csv", "empty.csv"}
    assert sales_of(spark, sales) == sales_of(spark, alone)
    assert state["toolong.csv"]["error_message"].endswith("2024-01-02,b,c")


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_depend_on_the_number_of_files(spark, tmp_path):
    counts = []
    for n in (3, 50):
        folder = tmp_path / f"f{n}"
        folder.mkdir()
        paths = {}
        for i in range(n):
            p = folder / f"{i}.csv"
            p.write_text(f"date,sku_id,sales_quantity,extra {i % 5}\n" + "".join(
                f"2024-01-{d:02d},S{i},{d},{i}\n" for d in range(1, 29)))
            paths[f"u{i}"] = str(p)
        out = []
        counts.append(jobs(spark, f"batch-{n}", lambda: out.extend(B.run_batch(
            spark, paths, str(tmp_path / f"r{n}"), str(tmp_path / f"s{n}"), as_of=AS_OF))))
        assert [r["status"] for r in out] == ["processed"] * n
        assert read_sales(spark, str(tmp_path / f"s{n}")).count() == 28 * n
    assert abs(counts[1] - counts[0]) <= 6, counts


def test_other_suffixes_are_refused(spark):
    with pytest.raises(ValueError):
        B.run_batch(spark, {"u": "/x/book.xlsx"}, "/x/reg")
