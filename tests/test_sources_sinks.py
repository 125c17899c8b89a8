from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from conftest import d
from vintage.sources import files as SF
from vintage.sources import sinks as SK
from vintage.sources.tables import read_table, scan_window

INDEX = """Quarterly index, made up for this test

CIK|Company Name|Form Type|Date Filed|Filename
--------------------------------------------------------------------------------
4400017|Tansy Kettle Works|10-K|2031-02-03|edgar/data/4400017/0004400017-31-000007.txt
5500023|BRAMBLE TRAMWAY CO|10-Q|2031-03-04|edgar/data/5500023/0007700031-31-000815.txt
6600042|Quill & Otter Trust|SC 13G|2031-03-09|edgar/data/6600042/0006600042-31-000003.txt
4400017|Tansy Kettle Works|8-K|2031-15-41|edgar/data/4400017/0004400017-31-000099.txt
4400017|Tansy Kettle Works|8-K|2031-04-01|edgar/data/4400017/notes.txt
"""


def test_master_index(spark, tmp_path):
    p = tmp_path / "master.idx"
    p.write_text(INDEX, encoding="latin-1")
    idx = SF.read_master_index(spark, str(p))
    rows = idx.orderBy("filing_date").collect()
    assert [r.cik for r in rows] == ["0004400017", "0005500023", "0006600042", "0004400017"]
    assert all(len(r.cik) == 10 for r in rows)
    uni = spark.createDataFrame([("0004400017",), ("0005500023",)], "cik string")
    good, rejects = SF.collect_filings(idx, uni)
    assert sorted(r.accession for r in good.collect()) == ["0004400017-31-000007", "0007700031-31-000815"]
    assert rejects.count() == 1


def test_raw_files_decode_and_filter(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_bytes(b"caf\xc3\xa9 ok \xff bad")
    (tmp_path / "a" / "two.htm").write_bytes(b"<p>x</p>")
    (tmp_path / "a" / "skip.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in SF.read_raw_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"one.txt", "two.htm"}
    assert got["one.txt"] == "café ok  bad"


def test_ticker_map_json_later_duplicate_wins(spark):
    js = json.dumps({"0": {"cik_str": "320193", "ticker": "aapl"}, "1": {"cik_str": "1", "ticker": "brk.b"},
                     "2": {"cik_str": "2", "ticker": "BRK.B"}})
    m = {r.ticker: r.cik for r in SF.ticker_map_from_json(spark.createDataFrame([(js,)], "value string")).collect()}
    assert m == {"AAPL": "0000320193", "BRK-B": "0000000002"}


def test_html_cells_tables_and_lists(spark):
    page = ("<table><tr><th>Symbol</th><th>Date added</th></tr><tr><td>brk.b</td><td>2010-01-01</td></tr>"
            "<tr><td>nan</td><td></td></tr></table><ul><li>one</li><li>two &amp; three</li></ul>")
    cells = SF.html_cells(spark.createDataFrame([(1, page)], "page_id int, html string"), "page_id")
    assert cells.filter("kind = 'table'").count() == 6
    assert [r.text for r in cells.filter("kind = 'ul'").orderBy("row_no").collect()] == ["one", "two & three"]
    col = SF.column_by_header(cells, "page_id", "symbol", "ticker").orderBy("row_no").collect()
    assert [r.ticker for r in col] == ["brk.b", "nan"]


def test_quarters(spark):
    q = SF.quarters(spark, 2023, 2024).collect()
    assert len(q) == 8 and q[0].index_path == "full-index/2023/QTR1/master.idx"


def test_partitioned_write_resume_and_window_scan(spark, tmp_path):
    path = str(tmp_path / "panel")
    df = spark.createDataFrame([(1, d("2009-01-02"), 2009), (1, d("2010-01-04"), 2010)],
                               "permno long, date date, year int")
    SK.write_partitioned(df, path, sort_within=["permno", "date"])
    present = SK.existing_partitions(spark, path)
    wanted = spark.createDataFrame([(2009,), (2010,), (2011,)], "year int")
    assert [r.year for r in SK.missing_partitions(wanted, present).collect()] == [2011]
    assert SK.existing_partitions(spark, str(tmp_path / "nothing")).count() == 0
    w = scan_window(spark, path, "date", "2010-01-01", "2010-12-31")
    assert w.count() == 1
    with pytest.raises(Exception):
        read_table(spark, str(tmp_path / "absent"))


def test_todo_done_and_min_length(spark):
    items = spark.createDataFrame([(i, "x" * (i * 300)) for i in range(1, 4)], "acc int, text string")
    done = spark.createDataFrame([(1,)], "acc int")
    assert sorted(r.acc for r in SK.todo(items, done, "acc").collect()) == [2, 3]
    assert SK.done_only(items, done, "acc").count() == 1
    assert SK.long_enough(items, "text").count() == 2


def test_clobber_guard(spark, tmp_path):
    path = str(tmp_path / "summary")
    spark.createDataFrame([(1, False)], "walk int, synthetic boolean").write.parquet(path)
    with pytest.raises(RuntimeError):
        SK.guard_clobber(spark, path, writing_synthetic=True)
    SK.guard_clobber(spark, str(tmp_path / "none"), writing_synthetic=True)


def test_membership_from_page_fixture_cases(spark):
    from vintage.operators.intervals import reconstruct_membership
    page = ("<table><tr><th>Symbol</th><th>Security</th></tr><tr><td>aaa</td><td>A</td></tr>"
            "<tr><td>bbb</td><td>B</td></tr></table>"
            "<table><tr><th>Date</th><th>Added</th><th>Removed</th></tr>"
            "<tr><td>2015-06-01</td><td></td><td>ccc</td></tr>"
            "<tr><td>2012-01-01</td><td></td><td>ddd</td></tr>"
            "<tr><td>2011-05-05</td><td>eee</td><td></td></tr>"
            "<tr><td>2010-03-01</td><td>bbb</td><td></td></tr>"
            "<tr><td>2008-01-01</td><td></td><td>ddd</td></tr>"
            "<tr><td>2006-01-01</td><td>ddd</td><td></td></tr>"
            "<tr><td>2005-02-01</td><td>ccc</td><td></td></tr>"
            "<tr><td>n/a</td><td>zzz</td><td></td></tr></table>")
    pages = spark.createDataFrame([(1, page)], "page_id int, html string")
    current, changes = SF.membership_from_pages(pages, "page_id")
    assert sorted(r.ticker for r in current.collect()) == ["AAA", "BBB"]
    assert "ZZZ" not in {r.ticker for r in changes.collect()}
    iv = reconstruct_membership(changes.drop("page_id"), current, "2000-01-01", "2025-12-31")
    got = sorted((r.ticker, str(r.date_in), str(r.date_out)) for r in iv.collect())
    assert got == sorted([("AAA", "2000-01-01", "None"), ("BBB", "2010-03-01", "None"),
                          ("CCC", "2005-02-01", "2015-06-01"), ("DDD", "2006-01-01", "2008-01-01"),
                          ("DDD", "2000-01-01", "2012-01-01"), ("EEE", "2011-05-05", "None")])


def test_master_index_latin1_names(spark, tmp_path):
    p = tmp_path / "latin1.idx"
    p.write_bytes(("CIK|Company Name|Form Type|Date Filed|Filename\n" + "-" * 40 + "\n"
                   "1234|Société Générale|10-K|2024-01-05|edgar/data/1234/0000001234-24-000001.txt\n")
                  .encode("latin-1"))
    rows = SF.read_master_index(spark, str(p)).collect()
    assert [r.company for r in rows] == ["Société Générale"] and rows[0].cik == "0000001234"


def _cells(spark, html):
    got = SF.html_cells(spark.createDataFrame([(1, html)], "page_id int, html string"), "page_id").collect()
    return {(r.table_no, r.row_no, r.col_no): r.text for r in got}


def test_html_cells_without_end_tags(spark):
    assert _cells(spark, "<table><tr><td>a<td>b<tr><td>c<td>d</table>") == {
        (0, 0, 0): "a", (0, 0, 1): "b", (0, 1, 0): "c", (0, 1, 1): "d"}
    assert _cells(spark, "<ul><li>a<li>b</ul>") == {(0, 0, 0): "a", (0, 1, 0): "b"}
    assert _cells(spark, "<table><tr><td>open") == {(0, 0, 0): "open"}


def test_html_cells_spans(spark):
    got = _cells(spark, "<table><tr><th rowspan=2>D</th><th colspan='2'>A</th><th rowspan=9>R</th></tr>"
                        "<tr><th>t</th><th>s</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>")
    assert got == {(0, 0, 0): "D", (0, 0, 1): "A", (0, 0, 2): "A", (0, 0, 3): "R", (0, 1, 0): "D", (0, 1, 1): "t",
                   (0, 1, 2): "s", (0, 1, 3): "R", (0, 2, 0): "1", (0, 2, 1): "2", (0, 2, 2): "3", (0, 2, 3): "R"}


def test_html_cells_wide_spans_stay_small(spark):
    cell = "<td colspan=1000 rowspan=65534>x"
    page = "<table>" + "<tr>" + cell * 60 + "<tr><td>end</table>"
    parser = SF._TableParser()
    parser.feed(page)
    parser.close()
    assert len(parser.out) == 61 and len(parser.stack) == 0  # one record a cell, whatever it covers
    cells = SF.html_cells(spark.createDataFrame([(1, page)], "page_id int, html string"), "page_id")
    assert cells.count() == 2 * 60 * 1000 + 1
    assert cells.select("row_no", "col_no").distinct().count() == 2 * 60 * 1000 + 1
    assert cells.filter("text = 'end'").select("row_no", "col_no").collect() == [(1, 60_000)]


def test_html_cells_row_reaches_past_a_wide_cell(spark):
    got = _cells(spark, "<table><tr><td rowspan=3>a</td><td>b</td></tr><tr><td rowspan=2 colspan=2>c</td></tr><tr><td>d</td></tr></table>")
    assert got == {(0, 0, 0): "a", (0, 0, 1): "b", (0, 1, 0): "a", (0, 1, 1): "c", (0, 1, 2): "c",
                   (0, 2, 0): "a", (0, 2, 1): "c", (0, 2, 2): "c", (0, 2, 3): "d"}


def test_html_cells_nested_table(spark):
    got = _cells(spark, "<table><tr><td>x<table><tr><td>in</td></tr></table>y</td><td>z</td></tr></table>")
    assert got == {(0, 0, 0): "xiny", (0, 0, 1): "z", (1, 0, 0): "in"}


def test_two_level_change_table(spark):
    page = ("<table><tr><th>Symbol</th></tr><tr><td>AAA</td></tr></table>"
            "<table><tr><th rowspan=2>Date</th><th colspan=2>Added</th><th colspan=2>Removed</th><th rowspan=2>Reason</th></tr>"
            "<tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr>"
            "<tr><td>2019-03-04</td><td>NEW</td><td>New Corp</td><td>OLD</td><td>Old Corp</td><td>merged</td></tr>"
            "<tr><td>2018-01-02</td><td></td><td></td><td>GON</td><td>Gone Ltd</td><td></td></tr></table>")
    current, changes = SF.membership_from_pages(spark.createDataFrame([(1, page)], "page_id int, html string"), "page_id")
    assert [r.ticker for r in current.collect()] == ["AAA"]
    assert sorted((str(r.date), r.op, r.ticker) for r in changes.collect()) == [
        ("2018-01-02", "removed", "GON"), ("2019-03-04", "added", "NEW"), ("2019-03-04", "removed", "OLD")]


def test_guards_fail_closed(spark, tmp_path):
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        SK.guard_clobber(spark, str(broken), writing_synthetic=True)
    with pytest.raises(Exception):
        SK.existing_partitions(spark, str(broken)).collect()
    assert SK.existing_partitions(spark, str(tmp_path / "none")).count() == 0


def test_partitioned_write_leaves_the_session_alone(spark, tmp_path):
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    df = spark.createDataFrame([(2001, i, i % 3) for i in range(300)] + [(2002, 1, 1)], "year int, v int, e int")
    SK.write_partitioned(df, str(tmp_path / "p"), sort_within=["e", "v"], spread_by="e", files_per_partition=4)
    SK.write_partitioned(df.filter("year = 2002"), str(tmp_path / "p"))
    assert spark.conf.get(key) == before
    assert spark.read.parquet(str(tmp_path / "p")).count() == 301  # the other year was kept


def test_text_scans_spread_only_when_told(spark):
    from vintage.plans import roles
    sf, was = "/root/testdata/sf0.001", spark.conf.get(roles.TEXT_PARTITIONS)
    try:
        spark.conf.set(roles.TEXT_PARTITIONS, "3")
        told = roles.table(spark, sf, "documents")
        assert "Repartition" in told._jdf.queryExecution().optimizedPlan().toString()
        spark.conf.unset(roles.TEXT_PARTITIONS)
        plain = roles.table(spark, sf, "documents")
        assert "Repartition" not in plain._jdf.queryExecution().optimizedPlan().toString()
        assert plain.exceptAll(told).isEmpty() and told.count() == plain.count()
    finally:
        spark.conf.set(roles.TEXT_PARTITIONS, was)
