from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import d
from vintage.operators.asof import asof_join, days_since_event
from vintage.operators.gates import leakage_guarded
from vintage.plans import panel


def _weekdays(a: str, b: str):
    x, end = d(a), d(b)
    while x <= end:
        if x.weekday() < 5:
            yield x
        x += dt.timedelta(days=1)


@pytest.fixture(scope="module")
def daily(spark):
    rows = [(p, x, 10.0 + p, 0.001) for p in (101, 202) for x in _weekdays("2009-01-01", "2009-03-31")]
    return spark.createDataFrame(rows, "permno long, date date, prc double, ret double")


@pytest.fixture(scope="module")
def fund(spark):
    return spark.createDataFrame(
        [(101, d("2009-01-21"), 10167000000, 1), (202, d("2009-02-15"), 16629000000, 1)],
        "permno long, datekey date, revenue long, seq int")


@pytest.mark.parametrize("bucket", ["month", "day", "year"])
def test_asof_never_sees_future(daily, fund, bucket):
    out = asof_join(daily, fund, "permno", "date", "datekey", tie_break=["seq"], bucket=bucket)
    assert out.count() == daily.count()
    assert out.filter(F.col("datekey") > F.col("date")).count() == 0


@pytest.mark.parametrize("bucket", ["month", "day"])
def test_asof_rows_before_first_event_are_null(daily, fund, bucket):
    out = asof_join(daily, fund, "permno", "date", "datekey", tie_break=["seq"], bucket=bucket)
    rows = {(r.permno, r.date): r for r in out.collect()}
    assert rows[(101, d("2009-01-20"))].datekey is None
    assert rows[(101, d("2009-01-21"))].revenue == 10167000000
    # carried across month buckets
    assert rows[(101, d("2009-03-31"))].datekey == d("2009-01-21")
    assert rows[(202, d("2009-02-13"))].revenue is None
    assert rows[(202, d("2009-02-16"))].revenue == 16629000000


def test_asof_tie_break_last_wins_and_no_crossing(spark):
    left = spark.createDataFrame([(1, d("2020-01-05")), (2, d("2020-01-05"))], "e long, t date")
    right = spark.createDataFrame(
        [(1, d("2020-01-03"), 5, "a"), (1, d("2020-01-03"), 9, "b"), (1, d("2020-01-06"), 1, "c")],
        "e long, k date, seq int, v string")
    out = {r.e: r for r in asof_join(left, right, "e", "t", "k", tie_break=["seq"]).collect()}
    assert out[1].v == "b" and out[1].k == d("2020-01-03")
    assert out[2].v is None


def test_asof_inner_and_collision(spark):
    left = spark.createDataFrame([(1, d("2020-01-05")), (1, d("2019-01-01"))], "e long, t date")
    right = spark.createDataFrame([(1, d("2020-01-01"), "x")], "e long, k date, v string")
    assert asof_join(left, right, "e", "t", "k", how="inner").count() == 1
    with pytest.raises(ValueError):
        asof_join(left, right.withColumnRenamed("v", "t"), "e", "t", "k")


def test_days_since_filing(spark):
    filings = spark.createDataFrame(
        [("0000000101", d("2020-01-01"), "10-K"), ("0000000101", d("2020-02-01"), "10-Q")],
        "cik string, filing_date date, form_type string")
    pnl = spark.createDataFrame([(101, "0000000101", d(x)) for x in ("2020-01-05", "2020-02-05", "2020-03-10")],
                                "permno long, cik string, date date")
    out = days_since_event(pnl, filings, "cik", "date", "filing_date", "days_since_filing")
    assert sorted(r.days_since_filing for r in out.collect()) == [4, 4, 38]
    late = spark.createDataFrame([("0000000101", d("2020-06-01"), "10-K")], filings.schema)
    one = pnl.limit(1)
    assert days_since_event(one, late, "cik", "date", "filing_date").first().days_since is None


def test_leakage_guard_raises(spark, daily, fund):
    bad = fund.withColumn("datekey", F.date_add("datekey", 30))
    j = asof_join(daily, fund, "permno", "date", "datekey").withColumn("datekey", F.date_add("datekey", 30))
    guarded = j.withColumn("age", leakage_guarded(F.datediff("date", "datekey"), "datekey", "date"))
    with pytest.raises(Exception, match="LEAKAGE"):
        guarded.collect()
    assert bad.count() == 2


def test_pit_panel_smoke(spark):
    out = panel.build(spark, "/root/testdata/sf0.001")
    assert out.filter(F.col("fund_age_days") < 0).count() == 0
    assert out.count() == panel.roles.daily_bars(spark, "/root/testdata/sf0.001").count()


def test_asof_null_keys_never_match(spark):
    left = spark.createDataFrame([(None, d("2020-01-05")), (1, d("2020-01-05"))], "e long, t date")
    right = spark.createDataFrame([(None, d("2020-01-01"), "n"), (1, d("2020-01-01"), "x")], "e long, k date, v string")
    got = {r.e: r.v for r in asof_join(left, right, "e", "t", "k").collect()}
    assert got == {None: None, 1: "x"}
