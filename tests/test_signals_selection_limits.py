"""Trailing features in blocks, exact selection, limits and stability across walks."""
from __future__ import annotations

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage.operators import gates as G
from vintage.operators import limits as LI
from vintage.operators import portfolio as P
from vintage.operators import rolling as R
from vintage.operators import selection as SEL
from vintage.operators import stability as STB

DAY = dt.date(2020, 1, 1)


def bars(rng, sizes):
    rows = []
    for e, n in sizes.items():
        day = DAY
        for i in range(n):
            day += dt.timedelta(days=int(rng.integers(1, 12)))
            ret = [None, float("nan"), -1.0][i % 3] if rng.random() < 0.04 else float(rng.normal(0, 0.02))
            rows.append((e, day, i, ret, float(rng.normal(0, 0.01)), float(rng.integers(0, 4) * 100)))
    return rows


BAR = "e string, d date, i int, ret double, mkt double, dollars double"


def features():
    return {
        "mom": R.compounded("ret", 5), "mom_skip": R.compounded("ret", 4, 3), "sd": R.volatility("ret", 6, 1.0),
        "beta": R.beta("ret", "mkt", 7), "adv": R.mean_of(F.col("dollars"), 3, "dollars"),
        "illiq": R.illiquidity("ret", F.col("dollars"), 2, 1.0), "calm": R.none_of(F.col("dollars") == 0, 3)}


def brute_features(hist, j):
    """Features of row j of one entity's ordered rows, from plain lists."""
    ok = lambda x: x is not None and not math.isnan(x)

    def last(n, skip=0):
        return hist[j - skip - n + 1: j - skip + 1] if j - skip - n + 1 >= 0 else None

    def grow(rows):
        if rows is None or any(not ok(r[3]) or r[3] <= -1 for r in rows):
            return None
        return math.prod(1 + r[3] for r in rows) - 1
    out = {"mom": grow(last(5)), "mom_skip": grow(last(4, 3))}
    w = last(6)
    out["sd"] = statistics.stdev(r[3] for r in w) if w and all(ok(r[3]) for r in w) else None
    w = last(7)
    out["beta"] = None
    if w and all(ok(r[3]) for r in w):
        c = np.cov([r[3] for r in w], [r[4] for r in w])
        out["beta"] = c[0, 1] / c[1, 1]
    w = last(3)
    out["adv"] = sum(r[5] for r in w) / 3 if w else None
    w = last(2)
    out["illiq"] = sum(abs(r[3]) / r[5] for r in w) / 2 if w and all(ok(r[3]) and r[5] for r in w) else None
    out["calm"] = all(r[5] != 0 for r in hist[max(0, j - 2): j + 1])
    return out


@pytest.mark.parametrize("block_rows", [7, 11, 400])
def test_trailing_features_equal_plain_lists(spark, block_rows):
    rows = bars(np.random.default_rng(5), {"a": 90, "b": 1, "c": 7, "d": 8, None: 23})
    df = spark.createDataFrame(rows, BAR).repartition(5)
    got = {(r.e, r.i): r for r in R.trailing(df, "e", "d", 7, features(), block_rows=block_rows).collect()}
    assert len(got) == len(rows)
    for e in {r[0] for r in rows}:
        hist = [r for r in rows if r[0] == e]
        for j, r in enumerate(hist):
            for name, want in brute_features(hist, j).items():
                value = got[e, r[2]][name]
                assert (value is None) == (want is None), (e, j, name)
                if want is not None:
                    assert value == pytest.approx(want, rel=1e-9, abs=1e-12), (e, j, name)


def test_positions_with_ties_null_dates_and_repeats(spark):
    rows = [("a", None, 3), ("a", DAY, 2), ("a", DAY, 1), ("a", DAY + dt.timedelta(40), 9), ("a", DAY, 1), ("b", None, 1)]
    df = spark.createDataFrame(rows, "e string, d date, k int")
    got = sorted((r.e, r["__pos"], r.k) for r in R.row_positions(df, "e", "d", "k").collect())
    assert got == [("a", 0, 3), ("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("a", 4, 9), ("b", 0, 1)]


def test_trailing_empty_table_and_bad_frames(spark):
    df = spark.createDataFrame([], BAR)
    out = R.trailing(df, "e", "d", 7, features())
    assert out.isEmpty() and out.columns == [*df.columns, *features()]
    with pytest.raises(ValueError):
        R.trailing(df, "e", "d", 4, {"x": R.compounded("ret", 4, 1)})
    with pytest.raises(ValueError):
        R.trailing(df, "e", "d", 10, {"x": R.compounded("ret", 4)}, block_rows=5)


def test_no_task_holds_more_than_a_block_and_its_lookback(spark):
    df = spark.range(5000).select(F.lit("hot").alias("e"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("d"),
                                  F.lit(1.0).alias("x"))
    rows = R.Feature({"x": F.col("x")}, 10, lambda s: s, [("x",)], full=False)
    # running sums start with the block: without the frame's subtraction they are the rows a task has seen
    out = R.trailing(df, "e", "d", 10, {"s": rows}, block_rows=100)
    assert out.agg(F.max("s"), F.count(F.lit(1))).first() == (10.0, 5000)
    plan = out._jdf.queryExecution().toString()
    assert "windowspecdefinition(e" in plan and "__block" in plan


def test_frames_with_infinite_values_and_a_still_market(spark):
    rows = [("a", i, [1.0, float("inf"), 2.0, 3.0, 5.0][i % 5], 0.25 if i > 20 else i * 0.01) for i in range(60)]
    df = spark.createDataFrame(rows, "e string, d int, x double, m double")
    f = {"avg": R.mean_of(F.col("x"), 3, "x"), "b": R.beta("d2", "m", 4)}
    got = R.trailing(df.withColumn("d2", F.col("d") * 1.0), "e", "d", 4, f, bucket=F.lit(0), block_rows=9).collect()
    for r in got:
        last = [rows[j][2] for j in range(r.d - 2, r.d + 1)] if r.d > 1 else [float("inf")]
        assert r.avg == (None if float("inf") in last else pytest.approx(sum(last) / 3))
        assert r.b == (None if r.d < 3 or r.d > 23 else pytest.approx(
            np.cov(range(r.d - 3, r.d + 1), [rows[j][3] for j in range(r.d - 3, r.d + 1)])[0, 1]
            / np.var([rows[j][3] for j in range(r.d - 3, r.d + 1)], ddof=1)))


def test_eligible_unknown_is_not_eligible(spark):
    rows = [(5.0, 9.0, True), (5.0, 9.0, False), (4.9, 9.0, True), (5.0, 0.1, True), (None, 9.0, True), (5.0, 9.0, None)]
    df = spark.createDataFrame(rows, "adv double, p double, u boolean")
    assert [r[0] for r in df.select(R.eligible("adv", "p", "u", 5.0, 1.0)).collect()] == [True] + [False] * 5


@pytest.mark.parametrize("limit", [1, 5, 100_000])
def test_quantiles_equal_numpy_at_every_bracket_size(spark, limit):
    rng = np.random.default_rng(8)
    groups = {"wide": rng.lognormal(0, 6, 900), "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([3.5]),
              "two": np.array([-1.0, 4.0]), "same": np.full(40, 2.25), None: rng.normal(size=33)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("wide", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    qs = {"lo": 0.0, "q1": 0.1, "med": 0.5, "q3": 0.93, "hi": 1.0}
    got = {r.g: r for r in SEL.group_quantiles(df, "g", "v", qs, limit).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g].n_values == len(vs)
        for name, q in qs.items():
            assert got[g][name] == pytest.approx(float(np.quantile(vs, q)), rel=1e-12, abs=1e-12), (g, name)


def test_quantiles_of_the_whole_table_and_of_nothing(spark):
    df = spark.range(2001).select((F.col("id") % 1000).cast("double").alias("v"))
    r = SEL.group_quantiles(df, [], "v", {"a": 0.25, "b": 0.5}, limit=20).first()
    want = np.quantile(np.arange(2001) % 1000, [0.25, 0.5])
    assert (r.n_values, r.a, r.b) == (2001, *want)
    empty = spark.createDataFrame([], "g string, v double")
    assert SEL.group_quantiles(empty, "g", "v", {"a": 0.5}).isEmpty()
    assert SEL.fill_with_median(empty, "g", ["v"]).columns == ["g", "v"]


def test_median_fill(spark):
    rows = [(1, "x", 1.0, 5.0), (1, "x", None, 6.0), (1, "x", 4.0, None), (1, "y", None, 1.0), (2, None, 7.0, 2.0),
            (2, None, float("nan"), 2.0), (1, "x", None, 6.0)]
    df = spark.createDataFrame(rows, "d int, s string, a double, b double")
    got = sorted(map(tuple, SEL.fill_with_median(df, ["d", "s"], ["a", "b"]).collect()), key=str)
    want = [(1, "x", 1.0, 5.0), (1, "x", 2.5, 6.0), (1, "x", 4.0, 6.0), (1, "y", None, 1.0), (2, None, 7.0, 2.0),
            (2, None, 7.0, 2.0), (1, "x", 2.5, 6.0)]
    assert got == sorted(want, key=str)
    kept = SEL.fill_with_median(df, ["d", "s"], ["a"], suffix="_filled")
    assert kept.columns == ["d", "s", "a", "b", "a_filled"] and kept.filter("a is null").count() == 3


def test_calibration_bins(spark):
    rng = np.random.default_rng(1)
    s = np.round(rng.normal(size=300), 1)
    y = s + rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(s, y)] + [(None, 1.0)], "s double, y double")
    edges = np.quantile(s, [0.25, 0.5, 0.75])
    cell = (s[:, None] > edges).sum(1)
    got = {r.bin: r for r in SEL.calibration_table(df, "s", "y", 4, limit=3).collect()}
    for b in range(4):
        assert got[b].n_rows == (cell == b).sum() and got[b].mean_realised == pytest.approx(y[cell == b].mean())
        assert got[b].mean_score == pytest.approx(s[cell == b].mean())


def brute_cap(dates, tau, limits=None):
    """dates: list of target dicts in order -> list of held dicts."""
    out = [dict(dates[0])]
    for i, t in enumerate(dates[1:], 1):
        p = out[-1]
        names = sorted(set(p) | set(t))
        move = np.array([t.get(k, 0.0) - p.get(k, 0.0) for k in names])
        norm = np.abs(move).sum()
        move = move if norm <= tau else move * tau / norm
        if limits:
            cap = np.array([limits[i].get(k, np.inf) for k in names])
            move = np.clip(move, -cap, cap)
        out.append({k: p.get(k, 0.0) + m for k, m in zip(names, move)})
    return out


@pytest.mark.parametrize("limited", [False, True])
def test_turnover_cap_equals_brute_force(spark, limited):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for s in ("ew", "tilt", "gone"):
        dates, caps = [], []
        for i in range(12):
            names = rng.choice(9, size=4, replace=False)
            w = rng.dirichlet(np.ones(4))
            dates.append({f"n{k}": float(x) for k, x in zip(names, w)})
            caps.append({f"n{k}": 0.02 * float(k + 1) for k in names if k % 2})
            rows += [(s, DAY + dt.timedelta(7 * i), n, x, caps[-1].get(n)) for n, x in dates[-1].items()]
        for i, held in enumerate(brute_cap(dates, 0.3, caps if limited else None)):
            want |= {(s, DAY + dt.timedelta(7 * i), n): x for n, x in held.items() if abs(x) > 1e-12}
    rows += [("ew", None, "n1", 1.0, None), ("ew", DAY, None, 1.0, None)]
    df = spark.createDataFrame(rows, "s string, d date, n string, w double, cap double").repartition(6)
    out = LI.cap_turnover(df, "s", "d", "n", "w", 0.3, "cap" if limited else None)
    got = {(r.s, r.d, r.n): r.w for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


def test_turnover_cap_small_batches_repeats_and_empty(spark):
    rows = [("a", 1, "x", 0.5), ("a", 1, "x", 0.5), ("a", 2, "y", 1.0), ("a", 3, "y", 1.0), ("b", 1, "z", None)]
    df = spark.createDataFrame(rows, "s string, d int, n string, w double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {(r.s, r.d, r.n): round(r.w, 9) for r in LI.cap_turnover(df, "s", "d", "n", "w", 0.5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {("a", 1, "x"): 1.0, ("a", 2, "x"): 0.75, ("a", 2, "y"): 0.25, ("a", 3, "x"): 0.5, ("a", 3, "y"): 0.5}
    assert LI.cap_turnover(df.filter("d > 9"), "s", "d", "n", "w").isEmpty()


def test_subspace_cosines_equal_svd(spark):
    rng = np.random.default_rng(6)
    bases = {w: np.linalg.qr(rng.normal(size=(7, 3)))[0] for w in (1, 2, 3)}
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    bases[4] = bases[1] @ turn  # the same space under another basis
    rows = [(w, j, i, float(x)) for w, b in bases.items() for (i, j), x in np.ndenumerate(b)]
    df = spark.createDataFrame(rows, "w int, c int, f int, x double").repartition(4)
    got = {(r.walk, r.place): r.cosine for r in STB.subspace_cosines(df, "w", "c", "f", "x", 1).collect()}
    for w, b in bases.items():
        want = np.clip(np.linalg.svd(bases[1].T @ b, compute_uv=False), 0, 1)
        assert [got[w, i] for i in (1, 2, 3)] == pytest.approx(list(want), abs=1e-9)
    assert [got[4, i] for i in (1, 2, 3)] == pytest.approx([1, 1, 1])


def test_rank_correlation_of_shared_features(spark):
    rows = [(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0), (1, "d", 0.5), (2, "a", 1.0), (2, "b", 1.0), (2, "c", 5.0),
            (2, "e", 9.0), (3, "a", 7.0), (3, "b", 7.0), (3, "c", 7.0), (3, "d", None)]
    df = spark.createDataFrame(rows, "w int, f string, v double")
    got = {(r.walk_a, r.walk_b): (r.n_features, r.rank_corr) for r in STB.rank_correlation(df, "w", "f", "v").collect()}
    want = np.corrcoef([3, 2, 1], [1.5, 1.5, 3])[0, 1]
    assert got == {(1, 2): (3, pytest.approx(want)), (1, 3): (3, None), (2, 3): (3, None)}


def test_expanding_correlation_equals_whole_windows(spark):
    rng = np.random.default_rng(9)
    rows = [(int(y), float(1e6 + x), None if rng.random() < 0.1 else float(x + rng.normal()), 4.0)
            for y in range(2000, 2005) for x in rng.normal(size=30)]
    df = spark.createDataFrame(rows, "yr int, x double, t double, flat double").repartition(5)
    got = {(r.yr, r.feature): (r.n, r["corr"]) for r in
           STB.expanding_correlation(STB.moments_by(df, "yr", ["x", "flat"], "t"), "yr").collect()}
    for y in range(2000, 2005):
        part = [(a, b) for yr, a, b, _ in rows if yr <= y and b is not None]
        n, c = got[y, "x"]
        assert n == len(part) and c == pytest.approx(np.corrcoef(*zip(*part))[0, 1], abs=1e-8)
        assert got[y, "flat"][1] is None


def test_concentration(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("a", 0.0), ("a", None), ("b", 1.0)], "g string, w double")
    got = {r.g: (r.n_holdings, r.max_weight, r.herfindahl) for r in STB.concentration(df, "g", "w").collect()}
    assert got == {"a": (2, 0.5, 0.5), "b": (1, 1.0, 1.0)}


def test_match_rate_report_is_written_before_the_error(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", None, "y"), ("c", None, "z"), ("d", 4, "w")], "t string, id int, more string")
    assert G.require_match_rate(df, "id", ["t"], str(tmp_path / "none"), 0.5) is df
    assert not (tmp_path / "none").exists()
    for frame, want in ((df, ["b", "c"]), (df.filter("t = 'q'"), [])):
        path = str(tmp_path / f"unresolved-{len(want)}")
        with pytest.raises(G.GateError, match="unresolved"):
            G.require_match_rate(frame, "id", ["t"], path, 0.95)
        assert sorted(r.t for r in spark.read.option("header", "true").schema("t string").csv(path).collect()) == want


def test_sixty_forty_takes_the_yield_of_the_day(spark):
    df = spark.createDataFrame([(1, 0.01, 0.5, 2.6), (2, 0.01, 0.5, None), (3, 0.01, 0.5, float("nan"))],
                               "d int, return_gross double, turnover double, macro_dgs10 double")
    got = {r.d: (r.return_gross, r.turnover) for r in P.sixty_forty(df).collect()}
    held = 0.006 + 0.4 * 4.0 / 5200
    assert got == {1: (pytest.approx(0.006 + 0.4 * 2.6 / 5200), 0.3), 2: (pytest.approx(held), 0.3), 3: (pytest.approx(held), 0.3)}


def test_walk_menu_agrees_with_its_parts(spark):
    from conftest import SF_SMALL

    from vintage.plans import signals as S
    got = {r.strategy: r for r in S.q_walk_menu(spark, SF_SMALL).collect()}
    assert {"EW", "SP", "TILT", "SIXTY_FORTY"} <= set(got)
    from vintage.operators import metrics as M
    parts = S._walk_returns(spark, SF_SMALL)
    for r in M.strategy_metrics(parts, "strategy", "date").collect():
        assert got[r.strategy].total_return_net == pytest.approx(r.total_return_net, abs=1e-6)
