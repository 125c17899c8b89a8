from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF_SMALL
from vintage.operators import scoring as SC
from vintage.plans import catalog as C


def test_fit_score_importance_and_summary(spark):
    fr = C._walk_frame(spark, SF_SMALL)
    feats = SC.feature_columns(fr)
    assert feats and not set(feats) & set(SC.NON_FEATURE_COLS)
    w1 = fr.filter(F.col("walk_id") == 1)
    model = SC.fit_walk(w1, feats, max_iter=5, max_depth=3)
    scored = SC.score(model, w1.filter(F.col("split") == "test"), feats)
    assert "score" in scored.columns and scored.filter(F.col("score").isNull()).count() == 0
    imp = SC.feature_importance(model, feats, spark).collect()
    assert len(imp) == len(feats) and abs(sum(r.importance for r in imp) - 1.0) < 1e-6
    summ = SC.walk_summary(fr.filter("walk_id = 1"), feats, "entity_id", "date", 2, "all", max_iter=5, max_depth=3).collect()
    assert len(summ) == 1 and summ[0].n_train > 0 and "ic_gate" in summ[0].asDict()


def test_stopping_point():
    assert SC.stopping_point([3.0, 2.0, 2.5, 2.4, 1.0, 1.5, 1.5, 0.5], 3) == (8, False)
    assert SC.stopping_point([3.0, 2.0, 2.5, 2.4, 2.3, 1.0], 3) == (2, True)
    assert SC.stopping_point([1.0], 1) == (1, False) and SC.stopping_point([1.0, 1.0], 1) == (1, True)


def _planted_rows(spark, n=400):
    import numpy as np
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 3))
    y = np.sin(2 * x[:, 0]) + 0.5 * (x[:, 1] > 0.3) + rng.normal(size=n) * 0.4
    rows = [(*map(float, r), float(t), ("train", "train", "val")[i % 3]) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "a double, b double, c double, y_excess double, split string").coalesce(1)


def test_fit_with_patience_goes_on_to_its_stopping_point(spark):
    """The fit equals a fit of all trees cut at the stopping point, whatever the number of repeats."""
    fr, feats = _planted_rows(spark), ["a", "b", "c"]
    fit = dict(max_depth=2, step_size=0.3)
    got = SC.fit_walk(fr, feats, patience=2, max_iter=60, **fit)
    whole = SC.fit_walk(fr, feats, patience=60, max_iter=60, **fit).stages[-1]
    full = SC.regressor(feats, validation_col=None, max_iter=60, **fit).fit(fr.filter("split = 'train'")).stages[-1]
    val = got.transform(fr.filter("split = 'val'")).drop("score")
    errors = full.evaluateEachIteration(val.select("features", "y_excess"), "squared")
    best, stopped = SC.stopping_point(errors, 2)
    assert stopped and best > 4 and got.stages[-1].getNumTrees == best
    assert whole.getNumTrees == errors.index(min(errors)) + 1
    assert got.stages[-1].treeWeights == [1.0] + [0.3] * (best - 1)
    by_hand = sum(w * t.predict(r.features) for r in val.limit(1).collect() for w, t in zip(full.treeWeights[:best], full.trees))
    scored = SC.score(got, fr.filter("split = 'val'").limit(1), feats).first()
    assert abs(scored.score - by_hand) < 1e-9
    assert abs(sum(r.importance for r in SC.feature_importance(got, feats, spark).collect()) - 1.0) < 1e-6


def test_fit_with_patience_without_validation_rows(spark):
    fr = _planted_rows(spark, 60).withColumn("split", F.lit("train"))
    assert SC.fit_walk(fr, ["a", "b", "c"], patience=2, max_iter=6, max_depth=2).stages[-1].getNumTrees == 6


def test_text_walks_are_fitted_whole(spark, monkeypatch):
    """Fits of walk_summary_text aren't held to a few shallow trees, nor ended by the first tree without gain."""
    import datetime as dt

    import numpy as np
    rng = np.random.default_rng(5)
    tp, mat = [], []
    for week in range(0, 208, 4):
        day = dt.date(1995, 1, 6) + dt.timedelta(weeks=week)
        for e in range(12):
            v = rng.normal(size=2) * (2.0, 1.0)
            prc = rng.normal()
            y = 0.02 * np.sin(2 * v[0]) * (1 if v[1] > 0 else -1) + 0.01 * np.sin(3 * prc) + rng.normal() * 0.005
            tp.append((e, day, float(prc), float(y)))
            mat.append((e, day, [float(a) for a in v], day.year))
    tp = spark.createDataFrame(tp, "entity_id int, date date, prc double, fwd_ret_5d double")
    mat = spark.createDataFrame(mat, "entity_id int, date date, vec array<float>, year int")
    monkeypatch.setattr(C.panel, "training_panel", lambda *a: tp)
    monkeypatch.setattr(C, "_pca_matrix", lambda *a: mat)
    monkeypatch.setitem(C.GBT_WHOLE, "patience", 10)  # a shorter test
    models, fit = {}, SC.fit_walk

    def kept(frame, features, **params):
        return models.setdefault(tuple(features), fit(frame, features, **params))
    monkeypatch.setattr(SC, "fit_walk", kept)
    rows = C.q_walk_summary_text(spark, "nowhere").collect()
    assert [(r.walk_id, r.variant) for r in rows] == [(1, "all"), (1, "no_text")]
    gbt = models["prc", "pca_0", "pca_1"].stages[-1]
    assert gbt.getNumTrees > 5 and max(t.depth for t in gbt.trees) > 3
    assert rows[0].rank_ic_mean > rows[1].rank_ic_mean


def test_conform_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    out = SC.conform_columns(df, ["b", "c", "a"])
    assert out.columns == ["b", "c", "a"] and out.first().c is None


def test_gram_pass_equals_numpy(spark):
    import numpy as np

    from vintage.operators import vectors as V
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    year = [1995 + i % 3 for i in range(300)]
    df = spark.createDataFrame([(y, [float(a) for a in r]) for y, r in zip(year, x)], "year int, vec array<double>").repartition(5)
    rows = {r.key: r for r in V.gram_by(df, "year", "vec").collect()}
    assert set(rows) == {1995, 1996, 1997}
    use = np.array(year) <= 1996
    n, mean, cov = V.add_grams([rows[1995], rows[1996]])
    assert n == use.sum() and np.allclose(mean, x[use].mean(axis=0)) and np.allclose(cov, np.cov(x[use], rowvar=False))
    share = V.explained_shares(cov)
    assert abs(share.sum() - 1) < 1e-12 and (np.diff(share) <= 1e-12).all()
    assert V.width_for(np.array([0.5, 0.3, 0.2]), 0.8) == 3 and V.width_for(np.array([0.97, 0.03]), 0.95) == 2
    d = V.components_of(cov, 2)
    got = V.project_on(df, mean, d, "vec", ["year"]).select("pca_0", "pca_1").collect()
    want = (x - mean) @ d
    assert np.allclose(sorted(r.pca_0 for r in got), sorted(want[:, 0]), atol=1e-4)


def test_minimum_variance_keeps_empty_lag_dates(spark):
    """A lag date on which no name has a return is a row of zeros in the covariance."""
    import datetime as dt

    import numpy as np

    from vintage.operators import portfolio as P
    rng = np.random.default_rng(1)
    days = [dt.date(2020, 1, 3) + dt.timedelta(days=7 * i) for i in range(9)]
    hist = [(d, e, float(rng.normal()) if i not in (2, 5) else None) for i, d in enumerate(days[:8]) for e in (1, 2, 3)]
    h = spark.createDataFrame(hist, "date date, e int, r double")
    b = spark.createDataFrame([(days[8], e) for e in (1, 2, 3)], "date date, e int")
    w = {r.e: r.w for r in P.min_variance_weights(b, h, [], "date", "e", "r", cap=0.8, lookback=8).collect()}
    m = np.array([[0.0 if r is None else r for d, e, r in hist if d == day] for day in days[:8]])
    want = P.min_variance_solve(m, 0.8)
    assert np.allclose([w[1], w[2], w[3]], want, atol=1e-4)


def test_walks_follow_the_data(spark):
    import datetime as dt

    from vintage.operators import temporal as T
    df = spark.createDataFrame([(dt.date(1995, 5, 1),), (dt.date(2001, 11, 4),)], "date date")
    got = T.walk_schedule_of(df, "date", "1995-01-01", 1996).orderBy("walk_id").collect()
    assert [r.walk_id for r in got] == [1, 2, 3, 4] and str(got[-1].test_start) == "2001-01-01"
    assert T.walk_schedule_of(df.limit(0), "date", "1995-01-01", 1996).count() == 0


def test_attach_on_day(spark):
    import datetime as dt

    from vintage.operators import temporal as T
    day = dt.date(2033, 5, 6)
    df = spark.createDataFrame([(7, day, 1.0), (8, day, 2.0)], "e int, date date, r double")
    ev = spark.createDataFrame([(7, day, -0.4, 512)], "e int, date date, dlret double, dlstcd int")
    got = {r.e: (r.r, r.dlret, r.dlstcd) for r in T.attach_on_day(df, ev, "e", "date", {"dlret": "double", "dlstcd": "int"}).collect()}
    assert got == {7: (1.0, -0.4, 512), 8: (2.0, None, None)}
    none = T.attach_on_day(df, ev.select("e", "date").limit(0), "e", "date", {"dlret": "double"})
    assert none.filter("dlret IS NULL").count() == 2
