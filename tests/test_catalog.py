"""Every registered query against its DuckDB oracle on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as entry  # noqa: E402
from ledgerloom.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"file_admission"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ["part", "lineitem", "orders", "events", "supplier", "documents"]:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_unless_rows_only():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    from oracle_check import _rows, type_mismatches

    sdf = catalog.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert type_mismatches(sdf, rel) == []
    assert _rows(sdf.columns, srows, 9) == _rows(rel.columns, rel.fetchall(), 9)
