"""End-to-end point-in-time panel on the hand-built fixture (FIXTURES A1)."""
from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import d
from vintage.plans.panel import build_panel
from vintage.sources import sinks as SK


def _weekdays(a, b):
    x, end = d(a), d(b)
    while x <= end:
        if x.weekday() < 5:
            yield x
        x += dt.timedelta(days=1)


@pytest.fixture(scope="module")
def inputs(spark):
    daily = spark.createDataFrame([(p, x, 10.0 + p, 0.001) for p in (101, 202, 303)
                                   for x in _weekdays("2009-01-01", "2009-03-31")],
                                  "permno long, date date, prc double, ret double")
    sf1 = spark.createDataFrame([("AAPL", "ARQ", d("2009-01-21"), d("2008-12-31"), 10167000000, 1),
                                 ("MSFT", "ARQ", d("2009-02-15"), d("2008-12-31"), 16629000000, 2),
                                 ("AAPL", "ARY", d("2009-01-10"), d("2008-12-31"), 999, 3),
                                 ("NOPE", "ARQ", d("2009-01-05"), d("2008-12-31"), 5, 4)],
                                "ticker string, dimension string, datekey date, calendardate date, revenue long, "
                                "order_key int")
    tickers = spark.createDataFrame([("AAPL", 320193), ("MSFT", 789019), ("NOPE", 99999999)], "ticker string, cik long")
    ids = spark.createDataFrame([("AAPL", "0000320193", 101, d("2009-02-01"), None),
                                 ("MSFT", "0000789019", 202, d("2009-01-01"), None)],
                                "ticker string, cik string, permno long, date_in date, date_out date")
    return daily, sf1, tickers, ids


def test_panel_semantics(spark, inputs):
    out = build_panel(*inputs)
    rows = {(r.permno, r.date): r for r in out.collect()}
    assert {p for p, _ in rows} == {101, 202}                      # 303 struck, NOPE dropped
    assert rows[(101, d("2009-01-20"))].datekey is None             # before the first filing
    assert rows[(101, d("2009-01-21"))].revenue == 10167000000      # resolved by fallback window
    assert all(r.datekey is None or r.datekey <= r.date for r in rows.values())
    assert rows[(101, d("2009-01-30"))].in_universe is False and rows[(101, d("2009-02-02"))].in_universe is True
    assert all(r.in_universe for (p, _), r in rows.items() if p == 202)
    assert all(r.revenue != 999 for r in rows.values())             # ARY filtered


def test_panel_written_by_year(spark, inputs, tmp_path):
    out = build_panel(*inputs)
    path = str(tmp_path / "panel")
    SK.write_partitioned(out, path, sort_within=["permno", "date"])
    back = spark.read.parquet(path)
    assert [r.year for r in back.select("year").distinct().collect()] == [2009]
    assert back.filter(F.col("fund_age_days") < 0).count() == 0
    assert back.count() == out.count()


def test_panel_leakage_guard(spark, inputs):
    daily, sf1, tickers, ids = inputs
    bad = build_panel(daily, sf1, tickers, ids).withColumn("datekey", F.date_add("date", 30))
    from vintage.operators.gates import leakage_guarded
    with pytest.raises(Exception, match="LEAKAGE"):
        bad.withColumn("age", leakage_guarded(F.datediff("date", "datekey"), "datekey", "date")).collect()
