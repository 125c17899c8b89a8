from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import d
from vintage.operators import crosssection as X
from vintage.operators import metrics as M
from vintage.operators import portfolio as P
from vintage.operators import ranking as RK
from vintage.operators import temporal as T


def test_friday_only(spark):
    from vintage.functions.core import is_friday
    df = spark.createDataFrame([(d(x),) for x in ("2020-01-01", "2020-01-02", "2020-01-03", "2020-01-06",
                                                   "2020-01-10")], "date date")
    assert [r.date for r in df.filter(is_friday("date")).orderBy("date").collect()] == [d("2020-01-03"),
                                                                                        d("2020-01-10")]


def test_excess_buckets_monotone_and_null(spark):
    rows = [(d("2020-01-03"), e, r) for e, r in enumerate((0.01, 0.02, 0.03))]
    rows += [(d("2020-01-10"), e, r) for e, r in enumerate((-0.01, 0.0, 0.01))]
    rows += [(d("2020-01-10"), 9, None)]
    df = spark.createDataFrame(rows, "date date, e long, r double")
    out = X.excess_return_buckets(df, "date", "r", n_buckets=3).orderBy("date", "e").collect()
    by_date = {}
    for row in out:
        by_date.setdefault(row.date, []).append(row.target)
    # pandas pct ranks 1/3, 2/3, 1 -> floor(pct * 3) capped at 2
    assert by_date[d("2020-01-03")] == [1, 2, 2]
    assert by_date[d("2020-01-10")][:3] == [1, 2, 2] and by_date[d("2020-01-10")][3] is None


def test_average_rank_matches_pandas(spark):
    import pandas as pd
    vals = [3.0, 1.0, 3.0, 2.0, None, 3.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "g int, i int, x double")
    got = [r.p for r in df.select("i", X.average_rank_pct("x", "g").alias("p")).orderBy("i").collect()]
    exp = pd.Series(vals).rank(pct=True, method="average").tolist()
    for a, b in zip(got, exp):
        assert (a is None and math.isnan(b)) or a == pytest.approx(b)


def test_top_k_per_date(spark):
    rng = np.random.RandomState(0)
    rows = [(d(f"2020-01-{day:02d}"), e, float(rng.randn())) for day in (3, 10, 17, 24) for e in range(60)]
    df = spark.createDataFrame(rows, "date date, e long, score double")
    top = X.top_k(df, "date", "score", 30, "e", rank_col="slot")
    counts = {r.date: r.n for r in top.groupBy("date").agg(F.count("*").alias("n")).collect()}
    assert set(counts.values()) == {30}
    for day in (3, 10, 17, 24):
        s = [r.score for r in top.filter(F.col("date") == d(f"2020-01-{day:02d}")).orderBy("slot").collect()]
        assert s == sorted(s, reverse=True)


def test_zero_info_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (3.0, None, 5.0)],
                               "good double, all_nan double, constant double")
    val = spark.createDataFrame([(9.0, 1.0, 2.0)], df.schema)
    tr, va = X.drop_zero_info(df, df.columns, val)
    assert tr.columns == ["good"] and va.columns == ["good"]


def test_ndcg_perfect_and_reversed(spark):
    rows = [(1, e, float(lbl), lbl) for e, lbl in enumerate((3, 2, 1, 0))]
    rows += [(2, e, float(lbl), lbl) for e, lbl in enumerate((4, 3, 2, 1, 0))]
    df = spark.createDataFrame(rows, "g int, e long, score double, label int")
    perfect = RK.ndcg_by_group(df, "g", "score", "label", k=3, entity="e").agg(F.avg("ndcg")).first()[0]
    assert perfect == pytest.approx(1.0)
    rev = df.withColumn("score", -F.col("score"))
    assert RK.ndcg_by_group(rev, "g", "score", "label", 3, "e").agg(F.avg("ndcg")).first()[0] < 1.0


def test_ranking_summary_keys_and_jaccard_range(spark):
    rng = np.random.RandomState(1)
    rows = [(d(f"2020-02-{day:02d}"), e, float(rng.randn()), float(rng.randn()))
            for day in (7, 14, 21, 28) for e in range(40)] + \
           [(d("2020-03-06"), e, float(rng.randn()), float(rng.randn())) for e in range(40)]
    df = spark.createDataFrame(rows, "date date, e long, score double, y double")
    df = X.excess_return_buckets(df, "date", "y", 8, "ye", "label")
    out = {r.metric: r.value for r in RK.ranking_summary(df, "date", "score", "ye", "label", "e", k=5).collect()}
    assert set(out) == {"ndcg_at_30", "rank_ic_mean", "rank_ic_ir", "decile_spread_bps", "hit_rate",
                        "top_k_jaccard"}
    assert 0.0 <= out["top_k_jaccard"] <= 1.0
    no_ids = {r.metric for r in RK.ranking_summary(df, "date", "score", "ye", "label", None, k=5).collect()}
    assert "top_k_jaccard" not in no_ids


def _ref_water_fill(a, cap):
    """Plain restatement of the iterative capping loop, for comparison."""
    k = len(a)
    w = np.exp(a - a.max())
    w = w / w.sum()
    for _ in range(k):
        over = w > cap + 1e-12
        if not over.any():
            break
        excess = (w[over] - cap).sum()
        w[over] = cap
        under = ~over
        us = w[under].sum()
        w[under] = w[under] + excess * (w[under] / us) if us > 0 else excess / max(1, under.sum())
    return w / w.sum()


@pytest.mark.parametrize("method", ["exact", "rounds"])
def test_capped_softmax(spark, method):
    df = spark.createDataFrame([(1, e, float(s)) for e, s in enumerate((1, 2, 3, 4))] +
                               [(2, e, 100.0 if e == 0 else 0.0) for e in range(30)],
                               "d int, e long, s double")
    g1 = P.capped_softmax(df.filter("d = 1"), "d", "s", 0.5, "e", method=method).orderBy("e").collect()
    w1 = [r.w for r in g1]
    assert w1 == sorted(w1) and sum(w1) == pytest.approx(1.0) and max(w1) <= 0.5 + 1e-9
    g2 = [r.w for r in P.capped_softmax(df.filter("d = 2"), "d", "s", 0.1, "e", method=method).collect()]
    assert max(g2) <= 0.1 + 1e-9 and sum(g2) == pytest.approx(1.0)
    if method == "rounds":
        exp = _ref_water_fill(np.array([100.0] + [0.0] * 29), 0.1)
        assert sorted(g2) == pytest.approx(sorted(exp))


def test_cap_infeasible_raises(spark):
    df = spark.createDataFrame([(1, e, float(e)) for e in range(3)], "d int, e long, s double")
    with pytest.raises(Exception, match="infeasible"):
        P.capped_softmax(df, "d", "s", 0.2, "e").collect()


def test_min_variance_weights(spark):
    rng = np.random.RandomState(0)
    w = P.min_variance_solve(rng.randn(50, 3) * 0.01, cap=0.5)
    assert w == pytest.approx([1 / 3] * 3, abs=0.1) and w.sum() == pytest.approx(1.0)
    w10 = P.min_variance_solve(rng.randn(50, 10) * 0.01, cap=0.2)
    assert w10.max() <= 0.2 + 1e-9 and w10.min() >= -1e-12


def test_metrics_invariants(spark):
    rng = np.random.RandomState(0)
    rows = [("S", d("2020-01-03") .__class__.fromordinal(d("2020-01-03").toordinal() + 7 * i),
             float(rng.randn() * 0.02), 0.2) for i in range(52)]
    df = spark.createDataFrame(rows, "strategy string, date date, return_gross double, turnover double")
    m = M.strategy_metrics(P.net_returns(df, 5.0), "strategy", "date").first().asDict()
    for k in M.METRIC_NAMES:
        assert k in m
    flat = spark.createDataFrame([("S", d("2020-01-03"), r, 0.0) for r in (0.01,)] +
                                 [("S", d(f"2020-01-{10 + 7 * i:02d}"), r, 0.0) for i, r in enumerate((-0.005, 0.02, 0.0))],
                                 df.schema)
    m2 = M.strategy_metrics(P.net_returns(flat, 5.0), "strategy", "date").first()
    assert m2.total_return_gross == pytest.approx(m2.total_return_net)
    neg = spark.createDataFrame([("S", d("2020-01-03").fromordinal(d("2020-01-03").toordinal() + 7 * i), -0.005, 0.0)
                                 for i in range(52)], df.schema)
    m3 = M.strategy_metrics(P.net_returns(neg, 5.0), "strategy", "date").first()
    assert m3.annualized_return < 0 and m3.max_drawdown < 0


def test_turnover_slot_first_previous_is_equal_weight(spark):
    w = spark.createDataFrame([("EW", d("2020-01-03"), s, 0.2) for s in range(1, 6)] +
                              [("EW", d("2020-01-10"), s, 0.2) for s in range(1, 6)],
                              "strategy string, date date, slot int, w double")
    t = {r.date: r.turnover for r in P.turnover_slot(w, "strategy", "date", "slot").collect()}
    assert t[d("2020-01-03")] == pytest.approx(0.0) and t[d("2020-01-10")] == pytest.approx(0.0)


def test_turnover_name_counts_entries_and_exits(spark):
    w = spark.createDataFrame([("X", d("2020-01-03"), 1, 0.5), ("X", d("2020-01-03"), 2, 0.5),
                               ("X", d("2020-01-10"), 2, 0.5), ("X", d("2020-01-10"), 3, 0.5)],
                              "strategy string, date date, e long, w double")
    t = {r.date: r.turnover for r in P.turnover_name(w, "strategy", "date", "e").collect()}
    assert t[d("2020-01-03")] == pytest.approx(0.0) and t[d("2020-01-10")] == pytest.approx(1.0)


def test_forward_returns_and_no_crossing(spark):
    rets = (0.01, -0.02, 0.03, 0.0, 0.05, -0.01)
    days = ("2020-01-02", "2020-01-03", "2020-01-06", "2020-01-07", "2020-01-08", "2020-01-09")
    df = spark.createDataFrame([(101, d(x), r) for x, r in zip(days, rets)] +
                               [(202, d("2020-01-02"), 0.1), (202, d("2020-01-03"), 0.2)],
                               "permno long, date date, ret double")
    out = T.forward_returns(df, "permno", "date", "ret", (1, 5)).orderBy("permno", "date").collect()
    a = [r for r in out if r.permno == 101]
    assert a[0].fwd_ret_1d == pytest.approx(-0.02) and a[-1].fwd_ret_1d is None
    assert a[0].fwd_ret_5d == pytest.approx(np.prod([1 + r for r in rets[1:6]]) - 1)
    assert all(r.fwd_ret_5d is None for r in a[1:])
    b = [r for r in out if r.permno == 202]
    assert b[-1].fwd_ret_1d is None and b[0].fwd_ret_1d == pytest.approx(0.2)


def test_novelty_cases(spark):
    v = spark.createDataFrame([(101, d("2020-01-08"), [1.0, 0.0]), (101, d("2020-01-15"), [1.0, 0.0]),
                               (202, d("2020-01-08"), [1.0, 0.0]), (202, d("2020-01-15"), [0.0, 1.0]),
                               (303, d("2020-01-08"), [1.0, 0.0]), (404, d("2020-01-15"), [1.0, 0.0])],
                              "permno long, date date, vec array<float>")
    got = {(r.permno, r.date): r.text_novelty for r in T.text_novelty(v, "permno", "date").collect()}
    assert got[(101, d("2020-01-08"))] is None and got[(101, d("2020-01-15"))] == pytest.approx(0.0)
    assert got[(202, d("2020-01-15"))] == pytest.approx(1.0)
    assert got[(404, d("2020-01-15"))] is None


def test_doc_count_window(spark):
    f = spark.createDataFrame([("c1", d(x)) for x in ("2020-06-01", "2020-06-03", "2020-06-05", "2020-06-15")] +
                              [("c2", d("2020-06-06")), ("c1", d("2019-01-01"))], "cik string, filing_date date")
    p = spark.createDataFrame([(1, "c1", d("2020-06-07")), (3, "c3", d("2020-06-07"))],
                              "permno long, cik string, date date")
    got = {r.permno: r.doc_count_7d for r in T.trailing_event_count(p, f, "cik", "date", "filing_date").collect()}
    assert got == {1: 3, 3: 0}


def test_macro_pivot_and_fill(spark):
    long = spark.createDataFrame([(d("2020-01-01"), "VIXCLS", 25.0), (d("2020-01-01"), "DGS10", 1.8),
                                  (d("2020-01-02"), "VIXCLS", 27.0), (d("2020-01-02"), "DGS10", 1.9)],
                                 "date date, series string, value double")
    wide = T.pivot_wide(long, "date", "series", "value", ["VIXCLS", "DGS10"])
    assert wide.columns == ["date", "macro_dgs10", "macro_vixcls"]
    sparse = spark.createDataFrame([(d("2020-01-01"), "VIXCLS", 25.0), (d("2020-01-03"), "VIXCLS", 27.0)],
                                   long.schema)
    axis = spark.createDataFrame([(d(f"2020-01-0{i}"),) for i in (1, 2, 3)], "date date")
    filled = T.fill_on_axis(axis, T.pivot_wide(sparse, "date", "series", "value", ["VIXCLS"]), "date")
    assert [r.macro_vixcls for r in filled.orderBy("date").collect()] == [25.0, 25.0, 27.0]
    dup = long.unionByName(long)
    with pytest.raises(Exception, match="duplicate"):
        T.pivot_wide(dup, "date", "series", "value", ["VIXCLS", "DGS10"]).collect()


def test_unpivot_drops_nulls(spark):
    wide = spark.createDataFrame([(d("2020-01-01"), 1.0, None), (d("2020-01-02"), 2.0, 3.0)],
                                 "date date, DGS3MO double, VIXCLS double")
    assert T.unpivot_long(wide, ["date"], ["DGS3MO", "VIXCLS"]).count() == 3


@pytest.mark.parametrize("method", ["array", "asof"])
def test_membership_flag_and_filter(spark, method):
    p = spark.createDataFrame([(101, d("2009-01-15")), (101, d("2009-02-02")), (202, d("2009-01-15")),
                               (303, d("2009-01-15"))], "permno long, date date")
    w = spark.createDataFrame([(101, d("2009-02-01"), None), (202, d("2009-01-01"), d("2009-12-31"))],
                              "permno long, date_in date, date_out date")
    got = {(r.permno, r.date): r.in_universe for r in T.membership_flag(p, w, "permno", "date", method=method).collect()}
    assert got == {(101, d("2009-01-15")): False, (101, d("2009-02-02")): True,
                   (202, d("2009-01-15")): True, (303, d("2009-01-15")): False}
    assert T.membership_filter(p, w, "permno", "date", method=method).count() == 2


def test_weights_from_rule_and_rollup(spark):
    import pandas as pd
    b = spark.createDataFrame([(d("2020-01-03"), e, float(e)) for e in range(4)], "date date, e long, score double")

    def rule(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["w"] = pdf["score"] / pdf["score"].sum()
        return pdf
    w = P.weights_from_rule(b, "date", rule)
    assert sum(r.w for r in w.collect()) == pytest.approx(1.0)
    s = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.2)], "walk int, ic double")
    got = {r.walk: r.ic_drift for r in M.rollup_vs_first(s, "walk", ["ic"]).collect()}
    assert got[1] == 0 and got[2] == pytest.approx(0.2) and got[3] == pytest.approx(-0.3)


def test_pca_model_roundtrip(spark, tmp_path):
    from pyspark.ml.feature import PCAModel
    from vintage.operators import vectors as V
    rng = np.random.RandomState(0)
    m = spark.createDataFrame([(i, [float(x) for x in rng.randn(4)]) for i in range(30)], "i int, vec array<double>")
    sc, model = V.fit_pca(m, "vec", 2)
    p = V.save_walk_model(model, str(tmp_path), 1)
    back = V.load_walk_model(PCAModel, str(tmp_path), 1)
    assert back.getK() == 2 and p.endswith("walk-001")
    out = V.project(m, sc, back, "vec", ["i"])
    assert out.columns == ["i", "pca_0", "pca_1"]
    with pytest.raises(ValueError):
        V.fit_pca(m.limit(1), "vec", 2)


def test_average_rank_split_equals_window(spark):
    rng = np.random.RandomState(3)
    rows = [(d("2020-01-03"), i, float(rng.randint(0, 50))) for i in range(3000)]
    rows += [(d("2020-01-10"), i, float(v)) for i, v in enumerate(rng.randn(200))] + [(d("2020-01-10"), 999, None)]
    df = spark.createDataFrame(rows, "date date, e long, x double")
    a = {(r.date, r.e): r.p for r in df.select("date", "e", X.average_rank_pct("x", "date").alias("p")).collect()}
    b = {(r.date, r.e): r.p for r in X.average_rank_split(df, "x", "date", "p", splits=16).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None and b[k] is None) or a[k] == pytest.approx(b[k], abs=1e-12)


def test_excess_buckets_split_option(spark):
    rng = np.random.RandomState(5)
    rows = [(d("2020-01-03"), i, float(rng.randn())) for i in range(500)] + [(d("2020-01-10"), 1, None)]
    df = spark.createDataFrame(rows, "date date, e long, r double")
    a = {r.e: (r.target, r.y_excess) for r in X.excess_return_buckets(df, "date", "r", 8).collect()}
    b = {r.e: (r.target, r.y_excess) for r in X.excess_return_buckets(df, "date", "r", 8, split=8).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0]


def test_fill_on_axis_asof_carry(spark):
    wide = spark.createDataFrame([(d("2019-12-30"), 20.0), (d("2020-01-02"), 22.0)], "date date, macro_vix double")
    axis = spark.createDataFrame([(d(x),) for x in ("2019-12-31", "2020-01-01", "2020-01-03")], "date date")
    par = [r.macro_vix for r in T.fill_on_axis(axis, wide, "date").orderBy("date").collect()]
    asof = [r.macro_vix for r in T.fill_on_axis(axis, wide, "date", carry="asof").orderBy("date").collect()]
    assert par == [None, None, None]      # prints off the axis are lost; fill restarts in January
    assert asof == [20.0, 20.0, 22.0]


def test_forward_return_total_loss_is_null(spark):
    df = spark.createDataFrame([(1, d(f"2020-01-0{i}"), r) for i, r in ((1, 0.1), (2, -1.0), (3, 0.2), (4, 0.1))],
                               "e long, date date, ret double")
    got = [r.fwd_ret_1d for r in T.forward_returns(df, "e", "date", "ret", (1,)).orderBy("date").collect()]
    assert got[0] is None and got[1] == pytest.approx(0.2) and got[3] is None
