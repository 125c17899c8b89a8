from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from vintage.plans.catalog import ORACLE, QUERIES
from vintage.streaming import incremental as ST


def test_clean_resumes_with_only_new_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "doc_id long, html string"
    spark.createDataFrame([(1, "<p>a &amp; b</p>")], schema).write.parquet(str(src / "b1"))
    sink, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream = ST.file_stream(spark, str(src / "*"), spark.read.parquet(str(src / "b1")).schema)
    ST.run_available(ST.clean_new_documents(stream, "doc_id", "html"), sink, ckpt)
    assert [r.clean_text for r in spark.read.parquet(sink).collect()] == ["a & b"]
    spark.createDataFrame([(2, "<b>c</b>")], schema).write.parquet(str(src / "b2"))
    stream = ST.file_stream(spark, str(src / "*"), spark.read.parquet(str(src / "b1")).schema)
    q = ST.run_available(ST.clean_new_documents(stream, "doc_id", "html"), sink, ckpt)
    assert sorted(r.doc_id for r in spark.read.parquet(sink).collect()) == [1, 2]
    assert q.lastProgress is None or q.lastProgress["numInputRows"] <= 1


def _files(spark, folder, rows, schema, n):
    """``rows`` in ``n`` files, dealt round, in the order of the rows."""
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.read.parquet(str(folder)).schema


EVENTS = [("c1", "2020-06-01"), ("c1", "2020-06-03"), ("c1", "2020-06-05"), ("c1", "2020-06-15"), ("c2", "2020-06-06"),
          ("c1", "2020-01-01"), ("c2", "2021-06-06"), (None, "2020-06-06"), ("c3", "2019-06-06"), (None, "2020-06-07")]


@pytest.mark.parametrize("files_per_batch", [1, 2, 4])
def test_dedupe_whatever_the_batches(spark, tmp_path, files_per_batch):
    schema = _files(spark, tmp_path / "in", EVENTS, "cik string, d string", 4)
    sink, ckpt = str(tmp_path / "out"), str(tmp_path / "ck")
    s = ST.file_stream(spark, str(tmp_path / "in"), schema, max_files=files_per_batch)
    ST.run_dedupe(s, "cik", sink, ckpt)
    got = [r.cik for r in ST.read_log(spark, sink).collect()]
    assert sorted(map(str, got)) == ["None", "c1", "c2", "c3"]
    # new files: only new keys are added
    _files(spark, tmp_path / "in", [("c1", "2022-01-01"), ("c9", "2018-01-01")], "cik string, d string", 1)
    ST.run_dedupe(ST.file_stream(spark, str(tmp_path / "in"), schema, max_files=files_per_batch), "cik", sink, ckpt)
    assert sorted(str(r.cik) for r in ST.read_log(spark, sink).collect()) == ["None", "c1", "c2", "c3", "c9"]


@pytest.mark.parametrize("files_per_batch", [1, 2, 4])
def test_trailing_counts_whatever_the_batches(spark, tmp_path, files_per_batch):
    schema = _files(spark, tmp_path / "in", EVENTS, "cik string, d string", 4)
    sink, ckpt = str(tmp_path / "out"), str(tmp_path / "ck")
    s = ST.file_stream(spark, str(tmp_path / "in"), schema, max_files=files_per_batch).selectExpr("cik", "to_timestamp(d) AS ts")
    ST.run_daily_counts(s, "cik", "ts", sink, ckpt)
    got = {(r.cik, str(r.date)): r.n for r in ST.trailing_counts(spark, sink, "cik", 7).collect()}
    want = {}
    for c, d in EVENTS:
        for k in range(8):
            day = str(dt.date.fromisoformat(d) + dt.timedelta(days=k))
            want[(c, day)] = want.get((c, day), 0) + 1
    assert got == want


def test_trailing_counts_of_every_day_by_one_shuffle(spark, tmp_path):
    sink, first = str(tmp_path / "out"), dt.date(1969, 11, 20)
    days = [(k, first + dt.timedelta(days=d), 1 + d % 3) for k in ("a", None) for d in range(0, 90, 1 if k else 5)]
    for i in range(2):  # every day in two batches
        ST._write_batch(spark.createDataFrame([*days, ("a", None, 2)], "k string, _day date, _n long"), sink, i)
    out = ST.trailing_counts(spark, sink, "k", 7)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = {("a", None): 2 * 2 * 8}
    for k, d, n in days:
        for i in range(8):
            at = (k, d + dt.timedelta(days=i))
            want[at] = want.get(at, 0) + 2 * n
    rows = out.collect()
    assert len(rows) == len(want) and {(r.k, r.date): r.n for r in rows} == want


def test_repeated_batch_adds_nothing(spark, tmp_path):
    sink = str(tmp_path / "out")
    for _ in range(2):
        ST._write_batch(spark.createDataFrame([("a", 1)], "k string, _n long"), sink, 0)
    assert ST.read_log(spark, sink).count() == 1


def test_trailing_counts_independent_of_session_time_zone(spark, tmp_path):
    src = tmp_path / "ev"
    spark.createDataFrame([("c1", "2020-06-01 23:30:00"), ("c1", "2020-06-03 00:10:00")], "cik string, d string") \
        .selectExpr("cik", "to_timestamp_ntz(d) AS ts").write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        sink, ckpt = str(tmp_path / "c"), str(tmp_path / "k")
        ST.run_daily_counts(ST.file_stream(spark, str(src), schema), "cik", "ts", sink, ckpt)
        got = {str(r.date): r.n for r in ST.trailing_counts(spark, sink, "cik", 7).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got["2020-06-01"] == 1 and got["2020-06-03"] == 2 and got["2020-06-08"] == 2 and got["2020-06-09"] == 1
    assert "2020-05-31" not in got and "2020-06-11" not in got


def _orders_and_lines(spark, folder):
    """Five orders of two days, and lines with repeated, missing and foreign keys."""
    orders = [(i, f"2020-06-0{1 + i % 2}") for i in range(5)]
    lines = [(i % 4, 1 + i % 2, "2020-07-01") for i in range(9)] + [(None, 1, "2020-07-01"), (77, 2, "2020-07-02")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate string").selectExpr(
        "o_orderkey", "date(o_orderdate) AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_shipdate string").selectExpr(
        "l_orderkey", "l_suppkey", "date(l_shipdate) AS l_shipdate").write.parquet(f"{folder}/lineitem.parquet")
    return orders, lines


def test_stream_dedup_orders_has_every_key_once(spark, tmp_path):
    _, lines = _orders_and_lines(spark, tmp_path)
    got = [r.order_key for r in QUERIES["stream_dedup_orders"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted({str(k) for k, _, _ in lines})


def test_stream_doc_count_counts_every_line_of_an_order(spark, tmp_path):
    orders, lines = _orders_and_lines(spark, tmp_path)
    got = {(r.cik, str(r.date)): r.n for r in QUERIES["stream_doc_count"](spark, str(tmp_path)).collect()}
    day, want = dict(orders), {}
    for key, supplier, _ in lines:
        for k in range(8) if key in day else ():
            at = (f"{supplier:010d}", str(dt.date.fromisoformat(day[key]) + dt.timedelta(days=k)))
            want[at] = want.get(at, 0) + 1
    assert got == want


def test_stream_doc_count_equals_its_sql_where_days_and_suppliers_are_missing(spark, tmp_path):
    orders = [(1, "2020-06-01"), (1, "2020-06-01"), (2, None), (3, None), (4, "2020-06-06"), (None, "2020-06-06")]
    lines = [(1, 1), (1, None), (2, 1), (2, 1), (3, 2), (3, None), (4, 1), (None, 1), (9, 2)]
    spark.createDataFrame(orders, "o_orderkey long, d string").selectExpr(
        "o_orderkey", "to_timestamp_ntz(d) AS o_orderdate", "0D AS o_totalprice", "'' AS o_orderpriority").write.parquet(
        str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = [(r.cik, r.date, r.n) for r in QUERIES["stream_doc_count"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(ORACLE["stream_doc_count"]).fetchall()
    assert ("0000000001", None, 16) in want and (None, None, 8) in want
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("folder", [True, False])
def test_stream_clean_pages_reads_a_folder_or_one_file(spark, tmp_path, folder):
    rows = spark.createDataFrame([(i, f"<p>page {i}</p>") for i in range(6)], "page_id long, html string")
    rows.repartition(3 if folder else 1).write.parquet(str(tmp_path / "pages.parquet"))
    if not folder:
        part = next((tmp_path / "pages.parquet").glob("*.parquet"))
        (tmp_path / "one").mkdir()
        (tmp_path / "one" / "pages.parquet").write_bytes(part.read_bytes())
    got = QUERIES["stream_clean_pages"](spark, str(tmp_path if folder else tmp_path / "one")).collect()
    assert sorted((r.page_id, r.clean_text) for r in got) == [(i, f"page {i}") for i in range(6)]
