"""Ranking diagnostics over scored cross-sections.

Each metric is first a per-date table (one row per cross-section), then a
mean over dates. :func:`ranking_summary` returns a long ``(metric, value)``
table so metrics combine with ``unionByName`` rather than joins.
Ties in score are broken by ascending entity in every engine.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage.operators.crosssection import average_rank

DECILES = [i / 10 for i in range(11)]


def _order(score: str, entity: str | None, desc: bool = True):
    o = [F.col(score).desc() if desc else F.col(score).asc()]
    if entity:
        o.append(F.col(entity).asc())
    return o


def ndcg_by_group(df: DataFrame, group: str, score: str, label: str, k: int = 30,
                  entity: str | None = None) -> DataFrame:
    """J1 per group: ``sum (2^label - 1) / log2(rank + 2)`` over the top ``min(k, n)``
    by score, divided by the same over the top by label."""
    w = Window.partitionBy(group)
    rs = F.row_number().over(w.orderBy(*_order(score, entity)))
    rl = F.row_number().over(w.orderBy(*_order(label, entity)))
    gain = F.pow(F.lit(2.0), F.col(label).cast("double")) - 1.0
    t = df.select(group, gain.alias("_g"), rs.alias("_rs"), rl.alias("_rl"))
    return (t.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("_rs") <= k, F.col("_g") / F.log2(F.col("_rs") + 1.0))).alias("dcg"),
        F.sum(F.when(F.col("_rl") <= k, F.col("_g") / F.log2(F.col("_rl") + 1.0))).alias("idcg"))
        .withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))))


def rank_ic_by_date(df: DataFrame, date: str, score: str, target: str) -> DataFrame:
    """J2 per date: Spearman correlation (Pearson of average ranks) on complete rows."""
    c = df.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    r = c.select(date, average_rank(score, date).alias("_rs"), average_rank(target, date).alias("_rt"))
    # Pearson of the ranks; a constant column (zero spread) gives NULL, not an error
    ic = F.try_divide(F.covar_samp("_rs", "_rt"), F.stddev_samp("_rs") * F.stddev_samp("_rt"))
    return r.groupBy(date).agg(ic.alias("ic")).filter(F.col("ic").isNotNull() & ~F.isnan("ic"))


def decile_spread_by_date(df: DataFrame, date: str, score: str, target: str,
                          min_rows: int = 10) -> DataFrame:
    """J3 per date with at least ``min_rows`` rows: mean target of the highest minus
    the lowest score decile; deciles from linear-interpolated quantile edges with
    duplicate edges dropped, right-closed bins, lowest bin inclusive."""
    edges = (df.groupBy(date)
             .agg(F.count(F.lit(1)).alias("_n"),
                  F.array_distinct(F.percentile(F.col(score), F.array(*[F.lit(q) for q in DECILES])))
                  .alias("_e"))
             .filter((F.col("_n") >= min_rows) & (F.size("_e") >= 2)))
    j = df.select(date, score, target).join(edges, date)
    interior = F.slice(F.col("_e"), 2, F.size("_e") - 2)
    j = j.withColumn("_bin", F.size(F.filter(interior, lambda x: x < F.col(score))))
    g = j.groupBy(date, "_bin").agg(F.avg(target).alias("_m"))
    return g.groupBy(date).agg(
        (F.max_by("_m", "_bin") - F.min_by("_m", "_bin")).alias("spread"))


def hit_by_date(df: DataFrame, date: str, score: str, target: str, k: int,
                entity: str | None = None) -> DataFrame:
    """J4 per date with at least ``2k`` rows: 1.0 when mean target of the top K by
    score beats the bottom K, else 0.0."""
    w = Window.partitionBy(date)
    top = F.row_number().over(w.orderBy(*_order(score, entity)))
    bot = F.row_number().over(w.orderBy(F.col(score).asc(), *([F.col(entity).desc()] if entity else [])))
    t = df.select(date, target, top.alias("_t"), bot.alias("_b"), F.count(F.lit(1)).over(w).alias("_n"))
    g = t.filter(F.col("_n") >= 2 * k).groupBy(date).agg(
        F.avg(F.when(F.col("_t") <= k, F.col(target))).alias("_top"),
        F.avg(F.when(F.col("_b") <= k, F.col(target))).alias("_bot"))
    return g.select(date, (F.col("_top") > F.col("_bot")).cast("double").alias("hit"))


def topk_jaccard_by_date(df: DataFrame, date: str, score: str, entity: str, k: int) -> DataFrame:
    """``|A ∩ B| / |A ∪ B|`` of consecutive dates' top-K entity sets.

    Sets hold at most K ids; the consecutive-date window runs over one row
    per date (a calendar-sized table).
    """
    rn = F.row_number().over(Window.partitionBy(date).orderBy(*_order(score, entity)))
    sets = (df.select(date, entity, rn.alias("_r")).filter(F.col("_r") <= k)
            .groupBy(date).agg(F.collect_set(entity).alias("_s")))
    prev = F.lag("_s").over(Window.orderBy(date))
    s = sets.withColumn("_p", prev).filter(F.col("_p").isNotNull())
    inter = F.size(F.array_intersect("_s", "_p"))
    union = F.size(F.array_union("_s", "_p"))
    return s.filter(union > 0).select(date, (inter / union).alias("jaccard"))


def ranking_summary(df: DataFrame, date: str, score: str, target: str, label: str,
                    entity: str | None, k: int = 30, ndcg_k: int = 30) -> DataFrame:
    """All diagnostics as ``(metric, value)`` rows, from one pass over ``df``.

    Every per-row quantity (ranks by score/label, average ranks, decile edges,
    group size) is a window column over the same date partitioning; one
    aggregate per date gives each metric's per-date value; one window over the
    per-date table (a calendar-sized table) gives the consecutive-date sets.
    """
    w = Window.partitionBy(date)
    c = df.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    edges = F.array_distinct(F.percentile(F.col(score), F.array(*[F.lit(q) for q in DECILES])).over(w))
    x = c.select(
        date, target, *([entity] if entity else []), score,
        (F.pow(F.lit(2.0), F.col(label).cast("double")) - 1.0).alias("_g"),
        F.row_number().over(w.orderBy(*_order(score, entity))).alias("_rs"),
        F.row_number().over(w.orderBy(*_order(label, entity))).alias("_rl"),
        F.row_number().over(w.orderBy(F.col(score).asc(), *([F.col(entity).desc()] if entity else []))).alias("_rb"),
        average_rank(score, date).alias("_ars"), average_rank(target, date).alias("_art"),
        F.count(F.lit(1)).over(w).alias("_n"), edges.alias("_e"))
    interior = F.slice(F.col("_e"), 2, F.size("_e") - 2)
    x = x.withColumn("_bin", F.when((F.col("_n") >= 10) & (F.size("_e") >= 2),
                                    F.size(F.filter(interior, lambda e: e < F.col(score)))))
    x = x.withColumn("_top", F.max("_bin").over(w)).withColumn("_bot", F.min("_bin").over(w))
    t = F.col(target)
    per = x.groupBy(date).agg(
        F.sum(F.when(F.col("_rs") <= ndcg_k, F.col("_g") / F.log2(F.col("_rs") + 1.0))).alias("dcg"),
        F.sum(F.when(F.col("_rl") <= ndcg_k, F.col("_g") / F.log2(F.col("_rl") + 1.0))).alias("idcg"),
        F.try_divide(F.covar_samp("_ars", "_art"), F.stddev_samp("_ars") * F.stddev_samp("_art")).alias("ic"),
        (F.avg(F.when(F.col("_bin") == F.col("_top"), t)) - F.avg(F.when(F.col("_bin") == F.col("_bot"), t)))
        .alias("spread"),
        F.first("_n").alias("n"),
        F.avg(F.when(F.col("_rs") <= k, t)).alias("_tm"), F.avg(F.when(F.col("_rb") <= k, t)).alias("_bm"),
        *([F.collect_set(F.when(F.col("_rs") <= k, F.col(entity))).alias("_s")] if entity else []))
    per = (per.withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")))
           .withColumn("ic", F.when(~F.isnan("ic"), F.col("ic")))
           .withColumn("hit", F.when(F.col("n") >= 2 * k, (F.col("_tm") > F.col("_bm")).cast("double"))))
    if entity:
        prev = F.lag("_s").over(Window.orderBy(date))
        union = F.size(F.array_union("_s", prev))
        per = per.withColumn("jaccard", F.when(prev.isNotNull() & (union > 0),
                                               F.size(F.array_intersect("_s", prev)) / union))
    aggs = [F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias(f"ndcg_at_{ndcg_k}"), F.avg("ic").alias("rank_ic_mean"),
            F.when((F.count("ic") > 1) & (F.stddev_samp("ic") > 0), F.avg("ic") / F.stddev_samp("ic"))
            .alias("rank_ic_ir"),
            (F.avg("spread") * 1e4).alias("decile_spread_bps"), F.avg("hit").alias("hit_rate")]
    if entity:
        aggs.append(F.avg("jaccard").alias("top_k_jaccard"))
    one = per.agg(*aggs)
    names = [a for a in one.columns]
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                               for n in names]))
    return one.select(long.alias("m")).select("m.metric", "m.value")
