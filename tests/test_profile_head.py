"""The first rows answer what they can: no second pass for the first date of a column."""

import datetime

from ledgerloom.operators import profiling as P
from ledgerloom.session import staged

SCHEMA = "id string, d timestamp_ntz, n bigint"


def _frame(spark, rows):
    return staged(spark.createDataFrame(rows, SCHEMA))


def _head(df):
    return P._head(df, "id", ["d", "n"])


def test_first_date_from_the_first_rows(spark):
    noon = datetime.datetime(2024, 1, 2, 12)
    df = _frame(spark, [(f"{i:04d}", noon if i == 3 else datetime.datetime(2024, 1, 3) if i > 3 else None, i)
                        for i in range(300)] + [(None, datetime.datetime(2023, 1, 1), 5)])
    prof = P.profile_columns(df, ["d", "n"], "id", head=_head(df))
    plan = prof._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    got = {r.column_name: r for r in prof.collect()}
    assert got["d"].first_value == "2024-01-02 12:00:00" and got["n"].first_value is None
    schema = {r.column_name: r.detected_type for r in P.detect_schema(df, "id", ["d", "n"]).collect()}
    assert schema == {"d": "datetime", "n": "integer"}


def test_first_date_behind_the_first_rows(spark):
    noon = datetime.datetime(2024, 1, 2, 12)
    late = _frame(spark, [(f"{i:04d}", noon if i > 250 else None, i) for i in range(300)])
    never = _frame(spark, [(f"{i:04d}", None, i) for i in range(20)])
    nulls = _frame(spark, [(None, noon, i) for i in range(20)])
    for df, want in ((late, "2024-01-02 12:00:00"), (never, None), (nulls, None)):
        for head in (None, _head(df)):
            got = {r.column_name: r.first_value for r in P.profile_columns(df, ["d", "n"], "id", head=head).collect()}
            assert got == {"d": want, "n": None}
