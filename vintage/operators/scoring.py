"""Supervised scoring on walk-forward windows (I1-I8) with MLlib.

The feature frame is built with DataFrame operators (Friday filter, joins,
cross-sectional demeaning, buckets). Fits are distributed MLlib estimators;
only the loop over walks / grid points runs on the driver, one distributed
fit per iteration, and only metric rows come back.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintage.functions.core import is_friday, nan_to_null, numeric_columns
from vintage.operators.crosssection import excess_return_buckets, zero_info_columns
from vintage.operators.lambdarank import RankModel, boost, fit_rank, prepare_rank, score_rank
from vintage.operators.ranking import ranking_summary
from vintage.operators.search import Dim, Pruned, Trial, search
from vintage.operators.walks import Run, run_key, run_walks

# Identifier, label and metadata columns never used as features.
NON_FEATURE_COLS = (
    "permno", "entity_id", "date", "cik", "ret", "ticker", "fiscalperiod", "datekey", "calendardate",
    "reportperiod", "lastupdated", "dimension", "in_universe", "fwd_ret_1d", "fwd_ret_5d",
    "year", "walk_id", "split", "y_excess", "target", "group_size", "score",
)


def feature_columns(df: DataFrame, deny: Sequence[str] = NON_FEATURE_COLS) -> list[str]:
    """C14: numeric columns not denied (schema only)."""
    return numeric_columns(df, deny)


def conform_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Select a model's column list, missing columns as NULL doubles."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in cols])


def assemble_walk_features(panel: DataFrame, embed_pca: DataFrame | None, entity: str, date: str,
                           target: str = "fwd_ret_5d", n_buckets: int = 32) -> DataFrame:
    """Friday rows (C9), inner-joined to the reduced text (D8) when given,
    rows without target dropped, excess target and its bucket label per date,
    group size per date."""
    x = panel.filter(is_friday(date))
    if embed_pca is not None:
        x = x.join(embed_pca, [entity, date], "inner")
    x = x.filter(F.col(target).isNotNull())
    x = excess_return_buckets(x, date, target, n_buckets, "y_excess", "target")
    return x.withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(date)))


def drop_text_columns(df: DataFrame, prefixes: Sequence[str] = ("pca_",),
                      names: Sequence[str] = ("text_novelty", "days_since_filing", "doc_count_7d")) -> DataFrame:
    """The no-text arm (text-derived columns removed)."""
    return df.drop(*[c for c in df.columns if c.startswith(tuple(prefixes)) or c in names])


def regressor(features: Sequence[str], label: str = "y_excess", max_iter: int = 40, max_depth: int = 5,
              step_size: float = 0.05, subsample: float = 0.9, seed: int = 42,
              validation_col: str | None = "is_val") -> Pipeline:
    """Median imputation plus a missing-value indicator per feature (trees
    then see "missing" as its own signal, as LightGBM does natively) ->
    assembler -> gradient-boosted trees, early-stopped on the validation rows
    when ``validation_col`` is given."""
    from pyspark.ml.feature import SQLTransformer
    imputed = [f"{c}__imp" for c in features]
    flags = [f"{c}__isna" for c in features]
    ind = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"CAST(`{c}` IS NULL AS DOUBLE) AS `{f}`" for c, f in zip(features, flags)) + " FROM __THIS__")
    imp = Imputer(inputCols=list(features), outputCols=imputed, strategy="median")
    asm = VectorAssembler(inputCols=imputed + flags, outputCol="features", handleInvalid="keep")
    extra = dict(validationIndicatorCol=validation_col, validationTol=0.0) if validation_col else {}
    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="score", maxIter=max_iter,
                       maxDepth=max_depth, stepSize=step_size, subsamplingRate=subsample, seed=seed,
                       featureSubsetStrategy="0.9", **extra)
    return Pipeline(stages=[ind, imp, asm, gbt])


def _clean(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) if c in features else F.col(c)
                       for c in df.columns])


def fit_walk(frame: DataFrame, features: Sequence[str], patience: int | None = None, **params) -> PipelineModel:
    """Fit on train rows with validation rows as the early-stopping set.

    MLlib itself ends a fit at the first tree that does not lower the validation
    error. With ``patience`` the fit ends only when so many trees in a row have
    not, as LightGBM's early stopping does, and keeps the trees up to the best.
    """
    from vintage.session import materialize
    tv = _clean(frame.filter(F.col("split").isin("train", "val")), features)
    tv = materialize(tv.withColumn("is_val", F.col("split") == "val"), "fit_frame")
    if patience is None:
        return regressor(features, **params).fit(tv)
    *before, gbt = regressor(features, validation_col=None, **params).getStages()
    prepared = Pipeline(stages=before).fit(tv)
    rows = materialize(prepared.transform(tv).select("features", gbt.getLabelCol(), "is_val"), "fit_vectors")
    return PipelineModel([*prepared.stages, _boost(gbt, rows.filter("NOT is_val"), rows.filter("is_val"), patience)])


def stopping_point(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """Trees up to the least error, and whether ``patience`` trees in a row after them have not lowered it."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def _boost(gbt: GBTRegressor, train: DataFrame, val: DataFrame, patience: int) -> GBTRegressionModel:
    """Trees up to the stopping point on ``val``, ``maxIter`` at most (all of them where ``val`` is empty).

    MLlib cannot go on with a fit. One that ends before its stopping point is
    repeated with twice the trees; seed and rows are the same, so its trees are too.
    """
    most = gbt.getMaxIter()
    judged = not val.isEmpty()
    n = min(most, 2 * patience) if judged else most
    while True:
        model = gbt.copy({gbt.maxIter: n}).fit(train)
        if not judged:
            return model
        best, stopped = stopping_point(model.evaluateEachIteration(val, "squared"), patience)
        if stopped or n == most:
            return _first_trees(model, best)
        n = min(most, 2 * n)


def _first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first ``n`` trees."""
    java, gateway = model._java_obj, SparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(ml.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i, (t, w) in enumerate(zip(list(java.trees())[:n], list(java.treeWeights())[:n])):
        trees[i], weights[i] = t, w
    return model._copyValues(GBTRegressionModel(ml.GBTRegressionModel(model.uid, trees, weights, model.numFeatures)))


def score(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``score`` column from a fitted pipeline."""
    out = model.transform(_clean(df, features))
    return out.drop("features", *[c for c in out.columns if c.endswith(("__imp", "__isna"))])


def feature_importance(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Importance per feature (its value and its missing indicator summed), as a table."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    n = len(features)
    vals = [float(imp[i]) + (float(imp[n + i]) if n + i < len(imp) else 0.0) for i in range(n)]
    return spark.createDataFrame(list(zip(features, vals)), "feature string, importance double")


def walk_summary(frame: DataFrame, features: Sequence[str], entity: str, date: str,
                 k: int = 30, variant: str = "all", **params) -> DataFrame:
    """One row per walk: split sizes and test diagnostics.

    ``frame`` carries ``walk_id`` and ``split`` (from ``assign_walks``). The loop
    is over its walks; each iteration is one distributed fit and one metrics query.
    """
    from vintage.session import materialize
    spark = frame.sparkSession
    frame = materialize(frame, "walk_frame")  # cut lineage: every fit pass rereads a table
    rows = []
    walks = sorted(r[0] for r in frame.select("walk_id").distinct().collect())  # one row per walk
    for w in walks:
        fw = frame.filter(F.col("walk_id") == w)
        sizes = {r["split"]: r["n"] for r in fw.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes.get("train") or not sizes.get("test"):
            continue
        # Columns without information in this walk's train rows are left out
        dropped = set(zero_info_columns(fw.filter(F.col("split") == "train"), features))
        feats = [c for c in features if c not in dropped]
        model = fit_walk(fw, feats, **params)
        test = score(model, fw.filter(F.col("split") == "test"), feats)
        m = {r["metric"]: r["value"] for r in
             ranking_summary(test, date, "score", "y_excess", "target", entity, k=k, ndcg_k=k).collect()}
        rows.append((w, variant, sizes.get("train", 0), sizes.get("val", 0), sizes.get("test", 0),
                     m.get(f"ndcg_at_{k}"), m.get("rank_ic_mean"), m.get("rank_ic_ir"), m.get("decile_spread_bps"),
                     m.get("hit_rate"), m.get("top_k_jaccard")))
    schema = ("walk_id int, variant string, n_train long, n_val long, n_test long, ndcg double, rank_ic_mean double, "
              "rank_ic_ir double, decile_spread_bps double, hit_rate double, top_k_jaccard double")
    out = spark.createDataFrame(rows, schema)
    return out.withColumn("ic_gate", F.col("rank_ic_mean") > 0)


def grid_search(frame: DataFrame, features: Sequence[str], grid: Sequence[dict], entity: str, date: str,
                k: int = 30) -> DataFrame:
    """Small fixed grid, each point scored by validation NDCG@k."""
    from vintage.operators.ranking import ndcg_by_group
    from vintage.session import materialize
    spark = frame.sparkSession
    frame = materialize(frame, "grid_frame")
    tr = frame.filter(F.col("split") == "train")
    va = frame.filter(F.col("split") == "val")
    rows = []
    for i, params in enumerate(grid):
        model = regressor(features, validation_col=None, **params).fit(_clean(tr, features))
        s = score(model, va, features)
        nd = ndcg_by_group(s, date, "score", "target", k, entity).agg(F.coalesce(F.avg("ndcg"), F.lit(0.0))).first()[0]
        rows.append((i, str(sorted(params.items())), float(nd)))
    return spark.createDataFrame(rows, "trial int, params string, val_ndcg double")


# ------------------------------------------------ the listwise arm: search once, freeze, resume

#: The searched parameters and their ranges.
RANK_SPACE = (Dim("num_leaves", 15, 127, "int"), Dim("learning_rate", 0.01, 0.1, "log"), Dim("min_data_in_leaf", 20, 200, "int"),
              Dim("feature_fraction", 0.6, 1.0), Dim("bagging_fraction", 0.6, 1.0), Dim("lambda_l2", 0.0, 5.0))


def search_rank_params(frame: DataFrame, features: Sequence[str], entity: str, date: str, label: str, path: str,
                       n_trials: int = 15, space: Sequence[Dim] = RANK_SPACE, seed: int = 42, n_random: int = 5,
                       k: int = 30, max_bins: int = 63, **fixed) -> list[Trial]:
    """Trials on one walk's train and val rows, binned once, by validation NDCG@k; pruned trials stop early."""
    data = prepare_rank(_clean(frame, features), features, date, entity, label, k=k, max_bins=max_bins)

    def objective(params: dict, report) -> float:
        stopped = []

        def watch(step: int, value: float) -> bool:
            if report(step, value):
                stopped.append(step)
            return bool(stopped)
        model = boost(data, report=watch, **{**fixed, **params})
        if stopped:
            raise Pruned
        return max(model.history, default=0.0)
    return search(frame.sparkSession, objective, space, n_trials, path, seed, n_random)


def rank_walks(frame: DataFrame, features: Sequence[str], entity: str, date: str, store: str, params: dict,
               label: str = "target", target: str = "y_excess", k: int = 30, variant: str = "all") -> Run:
    """I7 with the listwise objective: every walk with the frozen ``params``, resumed from ``store``.

    ``frame`` carries ``walk_id`` and ``split``. Features without information in
    a walk's train rows are left out (E11). The results' numbers are the split
    sizes, the trees used and the test diagnostics (J1-J6).
    """
    from vintage.session import materialize
    spark = frame.sparkSession
    frame = materialize(frame, "rank_walks")
    sizes: dict[int, dict[str, int]] = {}
    ends: dict[int, list[str]] = {}
    for r in frame.groupBy("walk_id", "split").agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("a"), F.max(date).alias("b")).collect():
        sizes.setdefault(r.walk_id, {})[r.split] = r.n  # three rows per walk
        ends.setdefault(r.walk_id, []).append(f"{r.split} {r.a} {r.b} {r.n}")
    walks = sorted(w for w, s in sizes.items() if s.get("train") and s.get("test"))

    def rows(w: int, *splits: str) -> DataFrame:
        return _clean(frame.filter((F.col("walk_id") == w) & F.col("split").isin(*splits)), features)

    def fit(w: int) -> str:
        dropped = set(zero_info_columns(rows(w, "train"), features))
        return fit_rank(rows(w, "train", "val"), [c for c in features if c not in dropped], date, entity, label, k=k, **params).to_json()

    def evaluate(w: int, text: str) -> dict[str, float]:
        model = RankModel.from_json(text)
        scored = score_rank(rows(w, "test"), model)
        m = {r["metric"]: r["value"] for r in ranking_summary(scored, date, "score", target, label, entity, k=k, ndcg_k=k).collect()}
        return m | {f"n_{s}": sizes[w].get(s, 0) for s in ("train", "val", "test")} | {"n_trees": model.best_iteration}
    return run_walks(spark, walks, store, variant, lambda w: run_key(params=params, features=list(features), ends=sorted(ends[w]), k=k),
                     fit, evaluate)


def numbers_as_columns(results: DataFrame, k: int) -> DataFrame:
    """The results of :func:`rank_walks` with the columns of :func:`walk_summary`, and n_trees."""
    n = {c: F.col("numbers")[c] for c in ("n_train", "n_val", "n_test", "n_trees", "rank_ic_mean", "rank_ic_ir", "decile_spread_bps",
                                          "hit_rate", "top_k_jaccard")}
    out = results.select("walk_id", "variant", *[n[c].cast("long").alias(c) for c in ("n_train", "n_val", "n_test", "n_trees")],
                         F.col("numbers")[f"ndcg_at_{k}"].alias("ndcg"),
                         *[n[c].alias(c) for c in ("rank_ic_mean", "rank_ic_ir", "decile_spread_bps", "hit_rate", "top_k_jaccard")])
    return out.withColumn("ic_gate", F.col("rank_ic_mean") > 0)
