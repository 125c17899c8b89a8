"""Steps of the training panel: their rows by brute force, and plans that neither repeat nor fan out their input."""
from __future__ import annotations

import datetime as dt

from conftest import d
from pyspark.sql import functions as F

from vintage.functions import text as TX
from vintage.operators import temporal as T
from vintage.operators import vectors as V
from vintage.plans import roles


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trailing_count_without_a_row_per_covered_day(spark):
    panel = [("a", "2020-01-31", 1), ("a", "2020-02-03", 2), ("a", "2020-02-03", 3), ("a", "2020-02-08", 4), ("b", "2020-02-03", 5),
             (None, "2020-02-03", 6), ("a", None, 7)]
    events = [("a", "2020-01-27", 2), ("a", "2020-02-01", 1), ("a", "2020-02-01", 3), ("b", "2020-02-04", 1), (None, "2020-02-03", 9), ("a", None, 9)]
    p = spark.createDataFrame(panel, "k string, date string, row int").withColumn("date", F.to_date("date"))
    e = spark.createDataFrame(events, "k string, day string, n int").withColumn("day", F.to_date("day"))
    out = T.trailing_event_count(p, e, "k", "date", "day", 7, weight="n")
    assert out.columns == ["k", "date", "row", "doc_count_7d"]
    assert "Join" not in _plan(out)
    want = {row: sum(n for k2, day, n in events if k and k == k2 and date and day
                     and d(date) - dt.timedelta(days=7) <= d(day) <= d(date)) for k, date, row in panel}
    assert {r.row: r.doc_count_7d for r in out.collect()} == want


def test_exact_lag_reads_its_rows_once(spark):
    rows = [("a", "2020-01-01", 1), ("a", "2020-01-08", 2), ("a", "2020-01-09", 3), ("a", "2020-01-15", None), ("a", "2020-01-22", 5),
            ("b", "2020-01-08", 6), (None, "2020-01-01", 7), (None, "2020-01-08", 8), ("a", None, 9)]
    x = spark.createDataFrame(rows, "k string, date string, v int").withColumn("date", F.to_date("date"))
    out = T.exact_lag(x, "k", "date", ["v"], 7)
    assert out.columns == ["k", "date", "v", "v_lag"] and "Join" not in _plan(out)
    at = {(k, date): v for k, date, v in rows if k and date}
    want = {(k, date, v, at.get((k, str(d(date) - dt.timedelta(days=7)))) if k and date else None) for k, date, v in rows}
    assert {(r.k, str(r.date) if r.date else None, r.v, r.v_lag) for r in out.collect()} == want


def test_stockday_vectors_pool_before_they_meet_the_grid(spark):
    docs = [(1, "c1", "2020-01-20", [1.0, 0.0]), (2, "c1", "2020-02-10", [0.0, 1.0]), (3, "c2", "2020-02-10", [3.0, 1.0]), (4, "c3", "2020-02-01", [9.0, 9.0])]
    bridge = [("e1", "c1"), ("e1", "c2"), ("e2", "c9"), (None, "c3")]
    days = ["2020-01-10", "2020-01-20", "2020-02-11", "2020-03-05", "2020-06-01"]  # a grid with holes, one day before the first document
    dd = spark.createDataFrame(docs, "doc_id long, cik string, day string, vec array<float>").withColumn("day", F.to_date("day"))
    bb = spark.createDataFrame(bridge, "e string, cik string")
    gg = spark.createDataFrame([(e, x) for e in ("e1", "e2", None) for x in days], "e string, date string").withColumn("date", F.to_date("date"))
    out = V.stockday_vectors(gg, dd, bb, "e", "date", "cik", "doc_id", "day", "vec", dtype="float64")
    assert _plan(out).count("Join") == 2  # documents with their vectors and with the bridge, no join on days
    want, last = {}, None
    for x in days:
        hits = [(0.5 ** ((d(x) - d(day)).days / V.HALF_LIFE_DAYS), v) for _, c, day, v in docs
                if c in ("c1", "c2") and 0 <= (d(x) - d(day)).days <= V.WINDOW_DAYS]
        if hits:
            last = [round(sum(w * v[i] for w, v in hits) / sum(w for w, _ in hits), 9) for i in range(2)]
        if last:
            want["e1", x] = last
    assert {(r.e, str(r.date)): [round(y, 9) for y in r.vec] for r in out.collect()} == want


def test_content_counts_as_token_by_token(spark):
    texts = [None, "", "  ", "Hello, world", "a bb 1c ab1 12 x:y k=v \"q\" p/q", " ünïcode straße \U00010400\U00010401x 1\U00010400 ",
             "a" * 40 + " " + "b" * 41, "ab12 abc12 --x x-- ..", "tab\tnew\nline\u0085end\n"]
    x = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    tok = TX.tokens(TX.collapse_ws("t"))
    want = x.select("i", F.size(tok).alias("n_tokens"), F.size(F.filter(TX.content_flags(tok), lambda b: b)).alias("n_content"))
    got = TX.content_counts(x, "t").select("i", "n_tokens", "n_content")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tickers_are_normalised_once_per_supplier(spark, tmp_path):
    spark.createDataFrame([(1, 7, "2020-01-02")], "l_orderkey long, l_suppkey long, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "2020-01-01", 5.0, "1-URGENT")], "o_orderkey long, o_orderdate string, o_totalprice double, o_orderpriority string") \
        .write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, " a.b ")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    out = roles.sf1_rows(spark, str(tmp_path))
    plan = _plan(out)
    assert "regexp_replace" in plan and "regexp_replace" not in plan[:plan.index("Join")]
    assert [(r.ticker, r.dimension, str(r.datekey), r.order_key, r.revenue) for r in out.collect()] == [("A-B", "ARQ", "2020-01-01", 1, 5.0)]
