"""Time series are dealt over tasks in proportion to their rows."""

import datetime as dt

from ledgerloom.operators import trends as T


def _sales(spark):
    rows = [(None if i % 11 == 0 else f"S{i % 4}", None if i % 23 == 0 else dt.datetime(2024, 1, 1 + i * 7 % 31, i % 24),
             None if i % 13 == 0 else float(i % 9), 0.25 * (i % 17)) for i in range(300)]
    return rows, spark.createDataFrame(rows, "sku_id string, date timestamp_ntz, sales_quantity double, sales_revenue double")


def test_tasks_of_time_series_grow_with_rows(spark, monkeypatch):
    rows, sales = _sales(spark)
    monkeypatch.setattr(T, "ROWS_A_TASK", 10)
    n = -(-sum(r[1] is not None for r in rows) // 10)
    for df in (T.lagged_sales(sales, (2,)), T.lagged_sales(sales, (2,), dense=False), T.sales_trend(sales)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f", {n}), REPARTITION_BY_NUM" in plan and "Expand" not in plan
    daily = {}
    for sku, at, quantity, revenue in rows:
        if at is not None:
            q, r = daily.get((sku, at.date()), (0.0, 0.0))
            daily[sku, at.date()] = (q + (quantity or 0.0), r + revenue)
    for dense in (True, False):
        got = {(r.sku_id, r.day): r for r in T.lagged_sales(sales, (2,), dense=dense).collect()}
        expected = set()
        for sku in {k[0] for k in daily}:
            days = sorted(d for s, d in daily if s == sku)
            every = [days[0] + dt.timedelta(i) for i in range((days[-1] - days[0]).days + 1)] if dense else days
            for day in every:
                expected.add((sku, day))
                back = day - dt.timedelta(2)
                lag = daily.get((sku, back), (0.0, 0.0)) if back >= days[0] else (None, None)
                r = got[sku, day]
                assert ((r.quantity, r.revenue), (r.quantity_lag_2, r.revenue_lag_2)) == (daily.get((sku, day), (0.0, 0.0)), lag)
        assert set(got) == expected
    trend = T.sales_trend(sales).collect()
    weeks = {(r.all_skus, r.sku_id, r.start): r.revenue for r in trend if r.period == "week"}
    expected = {}
    for (sku, day), (_, revenue) in daily.items():
        start = day - dt.timedelta(day.weekday())
        for key in ((False, sku, start), (True, None, start)):
            expected[key] = expected.get(key, 0.0) + revenue
    assert weeks == expected
    assert sum(r.period == "day" and not r.all_skus for r in trend) == len(daily)
