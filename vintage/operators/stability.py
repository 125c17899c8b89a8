"""Stability across walks: angles between subspaces, rank correlation of importances (N7), concentration."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage.functions.core import as_list, nan_to_null


def subspace_cosines(loadings: DataFrame, walk: str, component: str, feature: str, loading: str,
                     base_walk) -> DataFrame:
    """(walk, place, cosine): cosines of the principal angles between a walk's component space and the base's.

    Inner products are a join on the feature and a sum; only the k x k matrix of a walk reaches a task.
    Components are taken as orthonormal; a feature that a walk lacks counts as zero there.
    """
    base = loadings.filter(F.col(walk) == F.lit(base_walk)).select(
        F.col(feature).alias("__f"), F.col(component).alias("__i"), F.col(loading).alias("__x"))
    rows = loadings.select(F.col(walk).alias("walk"), F.col(component).alias("__j"), F.col(feature).alias("__g"),
                           F.col(loading).alias("__y"))
    dots = rows.join(base, F.col("__f") == F.col("__g")).groupBy("walk", "__i", "__j").agg(
        F.sum(F.col("__x") * F.col("__y")).alias("dot"))
    kind = dict(loadings.dtypes)[walk]

    def angles(key, pdf):
        import pandas as pd
        m = pdf.pivot(index="__i", columns="__j", values="dot").fillna(0.0).to_numpy()
        s = np.clip(np.linalg.svd(m, compute_uv=False), 0.0, 1.0)
        return pd.DataFrame({"walk": key[0], "place": np.arange(1, len(s) + 1, dtype="int32"), "cosine": s})

    return dots.groupBy("walk").applyInPandas(angles, f"walk {kind}, place int, cosine double")


def rank_correlation(importances: DataFrame, walk: str, feature: str, importance: str) -> DataFrame:
    """(walk_a, walk_b, n_features, rank_corr): Spearman of the features two walks share, a < b.

    Ranks (ties get their mean) are taken over the shared features of each pair; a pair whose ranks
    are all tied has a NULL correlation. Rows are few: features times walks squared.
    """
    x = importances.select(F.col(walk).alias("walk"), F.col(feature).alias("feature"),
                           F.col(importance).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    a = x.select(F.col("walk").alias("walk_a"), "feature", F.col("v").alias("va"))
    b = x.select(F.col("walk").alias("walk_b"), "feature", F.col("v").alias("vb"))
    pairs = a.join(b, "feature").filter("walk_a < walk_b")

    def mean_rank(c):
        w = Window.partitionBy("walk_a", "walk_b")
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(w.partitionBy("walk_a", "walk_b", c)) - 1) / 2

    ranked = pairs.select("walk_a", "walk_b", mean_rank("va").alias("ra"), mean_rank("vb").alias("rb"))
    flat = (F.var_samp("ra") == 0) | (F.var_samp("rb") == 0)
    return ranked.groupBy("walk_a", "walk_b").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.when(~flat, F.try_divide(F.covar_samp("ra", "rb"), F.stddev_samp("ra") * F.stddev_samp("rb"))).alias("rank_corr"))


def concentration(weights: DataFrame, by, weight: str) -> DataFrame:
    """Per group the number of holdings (weights above zero), the largest weight and the Herfindahl index."""
    held = F.coalesce(F.col(weight), F.lit(0.0))
    return weights.groupBy(*as_list(by)).agg(
        F.sum((held > 0).cast("int")).alias("n_holdings"), F.max(held).alias("max_weight"),
        F.sum(held * held).alias("herfindahl"))


def moments_by(df: DataFrame, by: str, features: list[str], target: str) -> DataFrame:
    """(by, feature, n, mean_x, mean_y, m2x, m2y, cxy): co-moments of each feature with the target in one pass.

    Rows where the feature or the target is NULL or NaN are left out for that feature.
    """
    y = nan_to_null(F.col(target).cast("double"))
    aggs = []
    for c in features:
        x = nan_to_null(F.col(c).cast("double"))
        xx, yy = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        n = F.count(xx)
        aggs.append(F.struct(F.lit(c).alias("feature"), n.alias("n"), F.avg(xx).alias("mean_x"), F.avg(yy).alias("mean_y"),
                             (F.var_pop(xx) * n).alias("m2x"), (F.var_pop(yy) * n).alias("m2y"),
                             (F.covar_pop(xx, yy) * n).alias("cxy")))
    return df.groupBy(by).agg(F.array(*aggs).alias("__m")).select(by, F.explode("__m").alias("__m")).select(by, "__m.*")


def expanding_correlation(moments: DataFrame, by: str, first=None) -> DataFrame:
    """(by, feature, n, corr): correlation over all groups up to and including each one (from ``first`` on).

    Group means are taken from the feature's middle first, so values far from zero cost no digits; sums then run
    over the groups and nothing is read again. One row per (group, feature) comes in, so a feature's window is as
    long as there are groups.
    """
    whole = Window.partitionBy("feature")
    w = Window.partitionBy("feature").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    m = moments.filter("n > 0")
    m = m.withColumns({c: F.col(c) - F.avg(c).over(whole) for c in ("mean_x", "mean_y")})
    n, sx, sy = F.sum("n").over(w), F.sum(F.col("n") * F.col("mean_x")).over(w), F.sum(F.col("n") * F.col("mean_y")).over(w)

    def total(within, a, b, sa, sb):
        return F.sum(F.col(within) + F.col("n") * F.col(a) * F.col(b)).over(w) - sa * sb / n

    vx, vy = total("m2x", "mean_x", "mean_x", sx, sx), total("m2y", "mean_y", "mean_y", sy, sy)
    corr = F.when((vx > 0) & (vy > 0), F.try_divide(total("cxy", "mean_x", "mean_y", sx, sy), F.sqrt(vx) * F.sqrt(vy)))
    out = m.select(by, "feature", n.alias("n"), corr.alias("corr"))
    return out if first is None else out.filter(F.col(by) >= F.lit(first))
