"""The listwise objective, the parameter search and walks that resume."""
from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintage.operators import lambdarank as L
from vintage.operators import scoring as SC
from vintage.operators import search as SE
from vintage.operators import walks as W
from vintage.operators.ranking import ndcg_by_group


def brute_gradients(rows, k, sigma=1.0):
    """All pairs of a date; rows: (entity, label, score)."""
    rows = [r for r in rows if r[1] is not None]
    order = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    disc = {e: 1 / math.log2(i + 2) if i < k else 0.0 for e, i in order.items()}
    ideal = sum((2.0 ** y - 1) / math.log2(i + 2) for i, y in enumerate(sorted((r[1] for r in rows), reverse=True)[:k]))
    out = {r[0]: [0.0, 0.0] for r in rows}
    for e, y, s in rows:
        for e2, y2, s2 in rows:
            if y > y2 and ideal > 0:
                w = (2.0 ** y - 2.0 ** y2) * abs(disc[e] - disc[e2]) / ideal
                rho = 1 / (1 + math.exp(sigma * (s - s2)))
                for who, sign in ((e, -1), (e2, 1)):
                    out[who][0] += sign * sigma * rho * w
                    out[who][1] += sigma * sigma * rho * (1 - rho) * w
    return out


def test_gradients_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(d, e, None if rng.random() < 0.05 else int(rng.integers(0, 6)), float(np.round(rng.normal(), 1)))
            for d in range(6) for e in range((3, 40, 1, 12, 90, 8)[d])]
    rows += [(9, e, 0, float(e)) for e in range(4)]  # no positive label
    df = spark.createDataFrame(rows, "d int, e int, y int, s double").repartition(7)
    for k in (1, 5, 1000):
        got = {(r.g, r.e): (r.grad, r.hess) for r in L.pair_gradients(df, "d", "e", "y", "s", k, 1.3).collect()}
        want = {(d, e): v for d in {r[0] for r in rows} for e, v in brute_gradients([r[1:] for r in rows if r[0] == d], k, 1.3).items()}
        assert got.keys() == want.keys()
        for key, v in want.items():
            assert got[key] == pytest.approx(v, abs=1e-9)
    assert L.pair_gradients(df.filter("d > 100"), "d", "e", "y", "s", 3).isEmpty()


def test_best_split_equals_exhaustive_search(spark):
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 6, size=(200, 3)).astype(np.uint8)
    g, h = rng.normal(size=200), rng.random(200)
    df = spark.createDataFrame([(float(a), float(b), bytes(x)) for a, b, x in zip(g, h, bins)], "grad double, hess double, bins binary").repartition(4)
    r = L.best_splits(L.histograms(df, L.Tree(), [0], [0, 1, 2], 3, 6), 10, 0.5).first()
    best = None
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 0.5)
    for f in range(3):
        for b in range(6):
            for missing in (True, False):
                left = (bins[:, f] <= b) & (bins[:, f] > 0) | (bins[:, f] == 0) & missing
                if 10 <= left.sum() <= 190:
                    gain = part(left) + part(~left) - part(left | True)
                    best = max(best or (0, 0, 0, 0), (round(gain, 9), -f, -b, missing))
    assert (round(r.best.gain, 9), r.best.f, r.best.b, r.best.missing_left) == best
    assert r.n == 200 and r.grad == pytest.approx(g.sum())


def planted(spark):
    """Returns with a signal in the ranks and a few huge outliers."""
    rng = np.random.default_rng(0)
    rows = []
    for d in range(60):
        a, b, c = rng.normal(size=(3, 30))
        ret = 0.02 * (a + 0.5 * np.sin(2 * b)) + 0.005 * rng.normal(size=30)
        ret[rng.random(30) < 0.03] += 40 * rng.normal()
        a[rng.random(30) < 0.1] = np.nan
        split = "train" if d < 40 else "val" if d < 50 else "test"
        rows += [(d, e, None if np.isnan(a[e]) else float(a[e]), float(b[e]), float(c[e]), float(ret[e]), split) for e in range(30)]
    df = spark.createDataFrame(rows, "date int, entity_id int, a double, b double, c double, ret double, split string")
    return SC.excess_return_buckets(df, "date", "ret", 8).cache()


FIT = dict(k=5, n_estimators=5, max_depth=3, num_leaves=8, learning_rate=0.3, min_data_in_leaf=20, early_stopping_rounds=3, bagging_fraction=1.0)


def test_listwise_fit_beats_regression_on_planted_ranks(spark):
    df, feats = planted(spark), ["a", "b", "c"]
    model = L.fit_rank(df, feats, "date", "entity_id", "target", **FIT)
    again = L.RankModel.from_json(model.to_json())
    assert again == model and model.history[-1] > 0.75 and dict(L.gain_by_feature(model))["a"] > 0
    test = df.filter("split = 'test'")
    scored = L.score_rank(test, again)
    assert scored.columns == [*test.columns, "score"] and scored.filter("score IS NULL").isEmpty()
    ndcg = lambda x: ndcg_by_group(x, "date", "score", "target", 5, "entity_id").agg(F.avg("ndcg")).first()[0]
    regression = SC.fit_walk(df, feats, max_iter=5, max_depth=3, step_size=0.3)
    assert ndcg(scored) > ndcg(SC.score(regression, test, feats))
    assert L.score_rank(test.drop("c"), again).count() == test.count()


def test_fit_without_signal_or_rows_stops(spark):
    df = planted(spark)
    assert L.fit_rank(df.withColumn("target", F.lit(0)), ["a"], "date", "entity_id", "target", **FIT).trees == []
    assert L.fit_rank(df.filter("split = 'none'"), ["a"], "date", "entity_id", "target", **FIT).trees == []


SPACE = (SE.Dim("x", -3, 3), SE.Dim("n", 1, 9, "int"), SE.Dim("r", 0.01, 1.0, "log"))


def hill(p, report=None):
    return -(p["x"] - 1) ** 2 - (p["n"] - 4) ** 2 / 4 - math.log(p["r"] / 0.1) ** 2


def test_search_resumes_and_repeats(spark, tmp_path):
    calls = []

    def objective(p, report):
        if len(calls) == 4 and not getattr(objective, "again", False):
            raise RuntimeError("killed")
        calls.append(p)
        return hill(p)
    path = str(tmp_path / "trials")
    with pytest.raises(RuntimeError):
        SE.search(spark, objective, SPACE, 7, path)
    assert [t.trial for t in SE.read_trials(spark, path)] == [0, 1, 2, 3]
    objective.again = True
    trials = SE.search(spark, objective, SPACE, 7, path)
    assert len(calls) == 7 and SE.search(spark, objective, SPACE, 7, path) == trials and len(calls) == 7
    whole = SE.search(spark, lambda p, r: hill(p), SPACE, 7, str(tmp_path / "whole"))
    assert [(t.params, t.value) for t in whole] == [(t.params, t.value) for t in trials]
    assert all(1 <= t.params["n"] <= 9 and 0.01 <= t.params["r"] <= 1 for t in trials)
    assert SE.best_params(trials) == max(trials, key=lambda t: t.value).params
    assert SE.trial_table(spark, trials).count() == 7 and SE.read_trials(spark, str(tmp_path / "nothing")) == []


def test_density_ratio_beats_random_draws():
    def run(n_random):
        trials = []
        for i in range(40):
            p = SE.suggest(SPACE, trials, seed=s, n_random=n_random)
            trials.append(SE.Trial(i, p, "complete", hill(p), []))
        return max(t.value for t in trials)
    better = 0
    for s in range(10):
        better += run(8) > run(100)
    assert better >= 8


def test_median_pruning_stops_a_slow_trial(spark, tmp_path):
    speed = iter([1.0, 1.1, 0.9, 0.1, 2.0])
    ran = []

    def objective(p, report):
        v, steps = next(speed), 0
        for i in range(6):
            steps += 1
            if report(i, v * (i + 1)):
                ran.append(steps)
                raise SE.Pruned
        ran.append(steps)
        return v * 6
    trials = SE.search(spark, objective, SPACE, 5, str(tmp_path / "t"), n_random=3)
    assert [t.state for t in trials] == ["complete"] * 3 + ["pruned", "complete"] and ran == [6, 6, 6, 1, 6]
    assert SE.best_params(trials) == trials[4].params
    with pytest.raises(ValueError):
        SE.best_params([trials[3]])


def test_walks_resume_without_refits(spark, tmp_path):
    store, fits, evals = str(tmp_path / "walks"), [], []

    def fit(w):
        fits.append(w)
        return f"model {w}"

    def evaluate(w, model):
        assert model == f"model {w}"
        evals.append(w)
        if w == 2 and evals.count(2) == 1:
            raise RuntimeError("killed after the model was stored")
        return {"ndcg": w / 10, "none": None}

    def run(key="a", walks=(1, 2, 3)):
        return W.run_walks(spark, walks, store, "all", lambda w: W.run_key(k=key, w=w), fit, evaluate)
    with pytest.raises(RuntimeError):
        run()
    assert fits == [1, 2]
    done = run()
    assert fits == [1, 2, 3] and (done.fitted, done.scored, done.kept) == ([3], [2, 3], [1])
    again = run()
    assert fits == [1, 2, 3] and (again.fitted, again.kept) == ([], [1, 2, 3]) and W.stored_model(spark, store, "all", 2) == "model 2"
    assert sorted((r.walk_id, r.numbers["ndcg"]) for r in again.results.collect()) == [(1, 0.1), (2, 0.2), (3, 0.3)]
    other = run("b", (1,))
    assert other.fitted == [1] and other.results.count() == 1 and run("b", (1,)).fitted == []
    assert W.run_walks(spark, (1,), store, "no_text", lambda w: "k", fit, evaluate).fitted == [1]


def test_rank_walks_read_the_frozen_parameters(spark, tmp_path):
    df = planted(spark)
    frame = df.withColumn("walk_id", F.lit(1)).unionByName(df.filter("date >= 20").withColumn("walk_id", F.lit(2)))
    small = {k: v for k, v in FIT.items() if k != "k"} | {"n_estimators": 2, "max_depth": 1}
    run = SC.rank_walks(frame, ["a", "b", "c"], "entity_id", "date", str(tmp_path / "w"), small, k=5)
    again = SC.rank_walks(frame, ["a", "b", "c"], "entity_id", "date", str(tmp_path / "w"), small, k=5)
    assert run.fitted == [1, 2] and again.fitted == [] and again.kept == [1, 2]
    rows = {r.walk_id: r for r in SC.numbers_as_columns(again.results, 5).collect()}
    assert rows[1].n_train == 1200 and rows[2].n_train == 600 and rows[1].ndcg > 0 and rows[1].ic_gate
    assert L.RankModel.from_json(W.stored_model(spark, str(tmp_path / "w"), "all", 1)).trees
