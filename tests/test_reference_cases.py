"""Restatements of the reference's hand-built cases (FIXTURES A2, A4, A7, A11, A12)."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import d
from vintage.functions.keys import normalize_cik, number_from_url
from vintage.operators import gates as G
from vintage.operators import intervals as IV
from vintage.operators import metrics as M
from vintage.operators import scoring as SC
from vintage.operators import vectors as V
from vintage.sources import files as SF


def test_low_match_rate_raises(spark):
    left = spark.createDataFrame([(t, d("2000-01-01"), d("2025-12-31")) for t in ("AAPL", "X1", "X2", "X3", "X4")],
                                 "ticker string, date_in date, date_out date")
    right = spark.createDataFrame([(14593, "AAPL", d("1980-12-12"), None)],
                                  "permno long, ticker string, namedt date, nameenddt date")
    res = IV.largest_overlap(left, right, "ticker", "date_in", "date_out", "namedt", "nameenddt", "permno")
    with pytest.raises(G.GateError, match="0.95"):
        G.enforce(G.match_rate_table(res, "permno", 0.95))


def test_vendor_ticker_resolution(spark):
    tickers = spark.createDataFrame([
        ("SF1", 1, "AAPL", "Apple", "https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=0000320193"),
        ("SF1", 2, "MSFT", "Microsoft", "https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=0000789019"),
        ("SF1", 3, "ZZZ", "Other", "https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=0000999999")],
        "table string, permaticker long, ticker string, name string, secfilings string")
    m = tickers.select("ticker", normalize_cik(number_from_url("secfilings")).alias("cik"))
    uni = spark.createDataFrame([(320193,), (789019,)], "cik long").select(normalize_cik(F.col("cik")).alias("cik"))
    got = sorted(r.ticker for r in IV.keys_in_universe(m, uni, "cik", "ticker").collect())
    assert got == ["AAPL", "MSFT"]
    one = spark.createDataFrame([(320193.0,)], "cik double").select(normalize_cik(F.col("cik")).alias("cik"))
    assert [r.ticker for r in IV.keys_in_universe(m, one, "cik", "ticker").collect()] == ["AAPL"]
    none = spark.createDataFrame([(1,)], "cik long").select(normalize_cik(F.col("cik")).alias("cik"))
    with pytest.raises(ValueError):
        IV.require_rows(IV.keys_in_universe(m, none, "cik", "ticker"), "tickers in universe")
    fund = spark.createDataFrame([("AAPL", "ARQ"), ("AAPL", "ARY"), ("AAPL", "MRQ")], "ticker string, dimension string")
    assert sorted(r.dimension for r in SF.as_reported(fund).collect()) == ["ARQ", "ARY"]


def test_training_matrix_cases(spark):
    emb = spark.createDataFrame([(101, d("2007-06-07"), [1.0, 2.0, 3.0]), (101, d("2007-06-08"), [1.0, 2.0, 3.0]),
                                 (999, d("2007-06-07"), [1.0, 2.0, 3.0]), (101, d("2008-01-04"), [1.0, 2.0, 3.0]),
                                 (303, d("2013-01-15"), [1.0, 2.0, 3.0]), (101, d("2024-06-15"), [1.0, 2.0, 3.0])],
                                "permno long, date date, vec array<double>")
    ids = spark.createDataFrame([(101, d("2000-01-01"), None), (303, d("2010-01-01"), d("2012-12-31"))],
                                "permno long, date_in date, date_out date")
    m = V.training_matrix(emb, ids, "permno", "date", "vec", "2007-01-01", "2007-12-31")
    assert m.count() == 2 and {r.permno for r in m.collect()} == {101}
    assert V.training_matrix(emb, ids, "permno", "date", "vec", "2013-01-01", "2013-12-31").count() == 0
    assert V.training_matrix(emb, ids, "permno", "date", "vec", "2024-01-01", "2024-12-31").count() == 1
    empty = V.training_matrix(emb, ids.limit(0), "permno", "date", "vec", "2007-01-01", "2007-12-31")
    assert empty.count() == 0 and empty.columns == ["permno", "date", "vec"]


def test_assemble_walk_features(spark):
    rows = []
    for day in ("2020-01-03", "2020-01-10", "2020-01-08"):
        for e in (1, 2):
            rows.append((e, d(day), 0.01 * e, 1.0 * e, 0.5, 20.0, 0.1, float(e)))
    panel = spark.createDataFrame(rows, "permno long, date date, fwd_ret_5d double, feature_x double, "
                                        "text_novelty double, macro_vixcls double, pca_0 double, pca_1 double")
    fr = SC.assemble_walk_features(panel, None, "permno", "date", "fwd_ret_5d", 8)
    assert fr.filter(F.weekday("date") != 4).count() == 0
    assert sorted(r.group_size for r in fr.select("date", "group_size").distinct().collect()) == [2, 2]
    feats = SC.feature_columns(fr)
    assert "permno" not in feats and "fwd_ret_5d" not in feats and "y_excess" not in feats and "target" not in feats
    assert set(feats) == {"feature_x", "text_novelty", "macro_vixcls", "pca_0", "pca_1"}


def test_equal_weight_rewards_are_zero(spark):
    df = spark.createDataFrame([("EW", d(f"2020-01-{3 + 7 * i:02d}"), r, r, r, 0.0)
                                for i, r in enumerate((0.01, -0.02, 0.03, 0.0))],
                               "s string, date date, port double, base double, spr double, cost double")
    out = M.reward_columns(df, "s", "date", "port", "base", "spr", "cost").collect()
    assert all(r.excess_return == 0 and r.reward_excess == 0 for r in out)


def test_observation_width(spark):
    k = 30
    rows = [(d("2020-01-03"), s, float(s), 0.1, 0.2, 0.3, 0.4, None, 20.0, 4.0, 0.5, 1.0 / k) for s in range(1, k + 1)]
    b = spark.createDataFrame(rows, "date date, slot int, score double, f1 double, f2 double, f3 double, f4 double, "
                                    "f5 double, macro_vixcls double, macro_dgs10 double, macro_t10y2y double, w double")
    b = b.withColumn("last_ret", F.lit(0.0))
    obs = M.pack_observation(b, "date", "slot", ["w", "score", "f1", "f2", "f3", "f4", "f5"],
                             ["macro_vixcls", "macro_dgs10", "macro_t10y2y", "last_ret"]).first().obs
    assert len(obs) == 214 and all(x is not None for x in obs)


def test_year_validator(spark):
    rows = [(2002, 0.1 if i % 20 else None, 1.0) for i in range(100)] + [(2003, None, 1.0) for _ in range(10)]
    df = spark.createDataFrame(rows, "year int, text_novelty double, fwd_ret_5d double")
    rep = G.validate(df, "year", ["fwd_ret_5d"], {"text_novelty": 0.10, "fwd_ret_5d": 0.05}, min_rows=50)
    bad = {(r.scope, r.rule) for r in rep.filter(~F.col("ok")).collect()}
    assert bad == {("2003", "MIN_ROWS"), ("2003", "NULL_RATE:text_novelty")}
    with pytest.raises(G.GateError):
        G.enforce(rep)
    with pytest.raises(G.GateError, match="missing"):
        G.validate(df, "year", ["days_since_filing"], {})
