"""The physical plans the scale design relies on (see README "Scale design")."""

import datetime as dt

import pytest

from ledgerloom.operators import profiling as P
from ledgerloom.operators import validation as V
from ledgerloom.operators import sales as S
from ledgerloom.sources.sales_table import read_sales, write_sales


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed_sales(spark, tmp_path_factory):
    """Upload "hot" holds 80 % of the rows."""
    out = str(tmp_path_factory.mktemp("sales"))
    rows = []
    for i in range(2000):
        up = "hot" if i % 5 else f"u{i % 3}"
        rows.append((up, dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 90), f"S{i % 37}",
                     float(i % 7), 1.25 * (i % 7), i % 11, "c", 1.25))
    df = spark.createDataFrame(rows, "upload_id string, date timestamp_ntz, sku_id string, "
                                     "sales_quantity double, sales_revenue double, stock_level int, "
                                     "category string, unit_price double")
    for up in ["hot", "u0", "u1", "u2"]:
        write_sales(df.filter(df.upload_id == up), out)
    return out


def test_upload_filter_prunes_partitions(spark, skewed_sales):
    plan = _plan(S.sales_summary(read_sales(spark, skewed_sales), upload_id="u1"))
    assert "PartitionFilters: [isnotnull(upload_id" in plan and "(upload_id#" in plan


def test_sku_filter_is_pushed_to_parquet(spark, skewed_sales):
    plan = _plan(S.list_sales(read_sales(spark, skewed_sales), upload_id="hot", sku_id="S3"))
    assert "PushedFilters" in plan and "EqualTo(sku_id,S3)" in plan
    assert "TakeOrderedAndProject" in plan


def test_summary_aggregates_partially_and_is_exact_under_skew(spark, skewed_sales):
    df = S.sales_summary(read_sales(spark, skewed_sales))
    assert "partial_sum" in _plan(df) and "partial_count" in _plan(df)
    rows = {r.upload_id: r for r in df.collect()}
    assert rows["hot"].total_records == 1600
    assert sum(r.total_records for r in rows.values()) == 2000
    assert rows["hot"].total_quantity == sum(float(i % 7) for i in range(2000) if i % 5)


def test_date_mode_reads_only_its_column(spark):
    from ledgerloom.plans.catalog import queries

    plan = _plan(queries()["date_mode"](spark, "/root/testdata/sf0.001"))
    reads = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert reads and not any("p_type" in line or "l_quantity" in line for line in reads)


def test_previews_sort_no_whole_table(spark):
    from ledgerloom.plans.catalog import queries

    for name in ("preview_raw", "json_safe_preview", "preview_cleaned"):
        plan = _plan(queries()[name](spark, "/root/testdata/sf0.001"))
        # Built on the first rows alone: no scan of the table, no sort, no shuffle.
        assert "FileScan" not in plan and "Sort" not in plan and "Exchange" not in plan, name


def test_validation_reads_the_profile_only(spark, skewed_sales):
    sales = read_sales(spark, skewed_sales)
    schema = P.detect_schema(sales, "id", ["date", "sku_id", "sales_quantity"], with_samples=False)
    plan = _plan(V.validation_issues(schema))
    assert "parquet" not in plan.lower()


def test_profile_counts_partially_per_value(spark, skewed_sales):
    plan = _plan(P.profile_columns(read_sales(spark, skewed_sales), ["upload_id", "sku_id"]))
    assert "partial_count" in plan and "CartesianProduct" not in plan
