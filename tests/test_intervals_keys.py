from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import d
from vintage.functions import keys as K
from vintage.operators import intervals as IV

START, END = "2000-01-01", "2025-12-31"


def _one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr.alias("y")).first().y


def test_membership_fixture_cases(spark):
    ch = spark.createDataFrame([
        ("B", d("2010-03-01"), 1, "added"),
        ("C", d("2015-06-01"), 2, "removed"), ("C", d("2005-02-01"), 3, "added"),
        ("D", d("2012-01-01"), 4, "removed"), ("D", d("2008-01-01"), 5, "removed"),
        ("D", d("2006-01-01"), 6, "added"),
        ("E", d("2011-05-05"), 7, "added"),
    ], "ticker string, date date, seq long, op string")
    cur = spark.createDataFrame([("A",), ("B",)], "ticker string")
    got = sorted((r.ticker, r.date_in, r.date_out) for r in IV.reconstruct_membership(ch, cur, START, END).collect())
    assert got == sorted([
        ("A", d(START), None), ("B", d("2010-03-01"), None), ("C", d("2005-02-01"), d("2015-06-01")),
        ("D", d("2006-01-01"), d("2008-01-01")), ("D", d(START), d("2012-01-01")), ("E", d("2011-05-05"), None)])


def _stack_walk(changes, current, start, end):
    """Brute-force restatement of the newest-to-oldest stack walk."""
    out = []
    by = {}
    for t, day, seq, op in changes:
        by.setdefault(t, []).append((day, seq, op))
    for t in set(by) | set(current):
        stack = [[None, None]] if t in current else []
        done = []
        for day, seq, op in sorted(by.get(t, []), key=lambda x: (x[0], x[1], x[2] == "added"), reverse=True):
            if op == "added":
                if stack:
                    iv = stack.pop()
                    iv[0] = day
                    done.append(iv)
                else:
                    done.append([day, None])
            else:
                stack.append([None, day])
        done += [[start, o] for _, o in stack]
        for i, o in done:
            if i <= end and (o is None or o >= start):
                i = max(i, start)
                o = None if (o is not None and o > end) else o
                if o is None or i <= o:
                    out.append((t, i, o))
    return sorted(out, key=lambda r: (r[0], r[1], r[2] or dt.date.max))


def test_membership_matches_stack_walk_on_events(spark):
    from vintage.plans import catalog as C
    ch, cur = C._membership_inputs(spark, "/root/testdata/sf0.001")
    s, e = d(C.MEMBERSHIP_START), d(C.MEMBERSHIP_END)
    rows = [(r.ticker, r.date, r.seq, r.op) for r in ch.collect()]
    current = {r.ticker for r in cur.collect()}
    got = sorted(((r.ticker, r.date_in, r.date_out) for r in
                  IV.reconstruct_membership(ch, cur, C.MEMBERSHIP_START, C.MEMBERSHIP_END).collect()),
                 key=lambda r: (r[0], r[1], r[2] or dt.date.max))
    assert got == _stack_walk(rows, current, s, e)


def test_resolve_by_window_primary_fallback_and_drop(spark):
    rows = spark.createDataFrame([("AAPL", "0000320193", d("2009-01-21")), ("MSFT", "0000789019", d("2009-02-15")),
                                  ("NOPE", "0099999999", d("2009-01-01"))], "ticker string, cik string, datekey date")
    ids = spark.createDataFrame([("0000320193", 101, d("2009-02-01"), None), ("0000789019", 202, d("2009-01-01"), None)],
                                "cik string, permno long, date_in date, date_out date")
    out = {r.ticker: (r.permno, r.in_window) for r in IV.resolve_by_window(rows, "cik", "datekey", ids, "permno").collect()}
    assert out == {"AAPL": (101, False), "MSFT": (202, True)}


def test_largest_overlap_cases(spark):
    left = spark.createDataFrame([(1, "AAPL", d("2000-01-01"), d("2025-12-31")), (2, "META", d("2013-12-23"), d("2025-12-31")),
                                  (3, "GOOG", d("2015-08-25"), d("2025-12-31")), (4, "ZZZZ", d("2015-01-01"), None)],
                                 "rid int, ticker string, date_in date, date_out date")
    right = spark.createDataFrame([(14593, "AAPL", d("1980-12-12"), None), (13407, "META", d("2022-06-09"), None),
                                   (11111, "GOOG", d("1995-01-01"), d("2004-08-18")), (90319, "GOOG", d("2014-04-03"), None)],
                                  "permno long, ticker string, namedt date, nameenddt date")
    got = {r.rid: r.permno for r in IV.largest_overlap(left, right, "ticker", "date_in", "date_out", "namedt",
                                                       "nameenddt", "permno").collect()}
    assert got == {1: 14593, 2: 13407, 3: 90319, 4: None}


@pytest.mark.parametrize("path,expected", [
    ("edgar/data/320193/0000320193-24-000123-index.htm", "0000320193-24-000123"),
    ("edgar/data/789019/000156459024041223/msft-20240630.htm", "0001564590-24-041223"),
    ("edgar/data/1/readme.txt", None)])
def test_accession(spark, path, expected):
    assert _one(spark, K.accession_from_path("x"), path) == expected


def test_ticker_and_cik(spark):
    assert _one(spark, K.normalize_ticker("x"), "brk.b") == "BRK-B"
    assert _one(spark, K.normalize_ticker("x"), "nan") is None
    assert _one(spark, K.normalize_cik("x"), "320193.0") == "0000320193"
    assert _one(spark, K.normalize_cik(F.col("x")), 320193.0, "double") == "0000320193"
    assert _one(spark, K.normalize_cik("x"), "abc") is None
    assert _one(spark, K.number_from_url("x"), "https://x/cgi?action=getcompany&CIK=0000320193&type=10-K") == 320193
