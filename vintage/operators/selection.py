"""Exact order statistics of groups of any size, and what is built on them.

Values are counted per (group, value) first. Then every wanted rank has a
bracket of values that holds it. While a bracket still holds more than
``limit`` distinct values, approximate percentiles (a mergeable sketch) only
propose cut points; the rows of each cell between cuts are counted exactly and
the bracket shrinks to the cell with the rank, so a poor sketch costs a round
and never a wrong answer. What is left is ranked inside the bracket: no task
ever holds a whole group.

Rules: NULL and NaN values are left out; NULL is a group of its own; a group
without values has no row (``group_quantiles``) or keeps its NULLs (``fill_with_median``).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage.functions.core import as_list, nan_to_null
from vintage.operators.rolling import _same
from vintage.session import materialize

#: Cut points proposed per round: a bracket keeps about 1 % of its values.
CUTS = [i / 100 for i in range(1, 100)]


def _targets(counts: DataFrame, by: list[str], qs: Sequence[float]) -> DataFrame:
    """One row per (group, wanted rank): bracket ``lo``..``hi``, rows ``below`` it, distinct values in it."""
    groups = counts.groupBy(*by).agg(F.sum("__n").alias("__rows"), F.min("__v").alias("lo"), F.max("__v").alias("hi"),
                                     F.count(F.lit(1)).alias("distinct"))
    ranks = [f((F.col("__rows") - 1) * F.lit(float(q))).cast("long") for q in qs for f in (F.floor, F.ceil)]
    return groups.select(*by, F.explode(F.array_distinct(F.array(*ranks))).alias("rank"), "lo", "hi",
                         F.lit(0).cast("long").alias("below"), "distinct", "__rows")


def _inside(counts: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    t = targets.select(*[F.col(c).alias(f"__t_{c}") for c in by], *[c for c in targets.columns if c not in by])
    within = F.col("__v").between(F.col("lo"), F.col("hi"))
    # without groups there are two brackets a quantile at most: a broadcast of a few rows
    pairs = counts.join(t, _same(by, "__t_") & within) if by else counts.join(F.broadcast(t), within)
    return pairs.select(
        *by, "__v", "__n", "rank", "lo", "hi", "below", "__rows")


def _narrow(counts: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    rows = _inside(counts, targets, by)
    keys = [*by, "rank"]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("__v", CUTS, 10_000).alias("cuts"))
    cuts = cuts.select(*[F.col(c).alias(f"__c_{c}") for c in keys], "cuts")
    cell = F.size(F.filter("cuts", lambda c: c < F.col("__v")))
    cells = rows.join(cuts, _same(keys, "__c_")).withColumn("cell", cell).groupBy(*keys, "below", "__rows", "cell").agg(
        F.sum("__n").alias("__n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count(F.lit(1)).alias("distinct"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("cell"))  # at most 100 cells a rank
    cells = cells.withColumn("__before", F.col("below") + upto - F.col("__n"))
    hold = F.col("rank").between(F.col("__before"), F.col("__before") + F.col("__n") - 1)
    return cells.filter(hold).select(*by, "rank", "lo", "hi", F.col("__before").alias("below"), "distinct", "__rows")


def order_statistics(df: DataFrame, by, value: str, qs: Sequence[float], limit: int = 100_000) -> DataFrame:
    """(by, rank, value, __rows): the values at the ranks (from 0) around each quantile of ``qs``."""
    by = as_list(by)
    v = nan_to_null(F.col(value).cast("double")) + F.lit(0.0)
    counts = df.select(*by, v.alias("__v")).filter(F.col("__v").isNotNull()).groupBy(*by, "__v").agg(
        F.count(F.lit(1)).alias("__n"))
    counts = materialize(counts, "value_counts")
    targets = materialize(_targets(counts, by, qs), "ranks")
    widest = targets.agg(F.max("distinct")).first()[0] or 0
    while widest > limit:
        narrow = _narrow(counts, targets.filter(F.col("distinct") > limit), by)
        targets = materialize(targets.filter(F.col("distinct") <= limit).unionByName(narrow), "ranks")
        now = targets.agg(F.max("distinct")).first()[0]
        if now >= widest:
            break
        widest = now
    upto = F.col("below") + F.sum("__n").over(Window.partitionBy(*by, "rank").orderBy("__v"))
    rows = _inside(counts, targets, by).withColumn("__upto", upto)
    hold = F.col("rank").between(F.col("__upto") - F.col("__n"), F.col("__upto") - 1)
    return rows.filter(hold).select(*by, "rank", F.col("__v").alias("value"), "__rows")


def group_quantiles(df: DataFrame, by, value: str, qs: dict[str, float], limit: int = 100_000) -> DataFrame:
    """One row per group with values: ``n_values`` and a column per quantile, interpolated linearly."""
    by = as_list(by)
    at = order_statistics(df, by, value, list(qs.values()), limit)
    groups = at.groupBy(*by).agg(F.first("__rows").alias("n_values"),  # at most two ranks per quantile
                                 F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("__at"))
    out = []
    for name, q in qs.items():
        place = (F.col("n_values") - 1) * F.lit(float(q))
        lo, hi = F.col("__at")[F.floor(place)], F.col("__at")[F.ceil(place)]
        out.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return groups.select(*by, "n_values", *out)


def fill_with_median(df: DataFrame, by, cols: Sequence[str], limit: int = 100_000, suffix: str = "") -> DataFrame:
    """NULL and NaN in ``cols`` become the exact median of the row's group (date, sector)."""
    by, out = as_list(by), df
    for c in cols:
        med = group_quantiles(df, by, c, {"__med": 0.5}, limit)
        med = med.select(*[F.col(k).alias(f"__m_{k}") for k in by], "__med")
        filled = F.coalesce(nan_to_null(F.col(c).cast("double")), F.col("__med"))
        names = [*out.columns, *([c + suffix] if suffix else [])]
        out = out.join(med, _same(by, "__m_"), "left").withColumn(c + suffix, filled).select(*names)
    return out


def calibration_table(df: DataFrame, score: str, realised: str, bins: int = 10, limit: int = 100_000) -> DataFrame:
    """Per score-quantile bin (over all rows, edges to the lower bin) the rows, mean score and mean realised value."""
    edges = group_quantiles(df, [], score, {f"q{i}": i / bins for i in range(1, bins)}, limit).first()  # one row
    s = nan_to_null(F.col(score).cast("double"))
    rows = df.select(s.alias("__s"), nan_to_null(F.col(realised).cast("double")).alias("__y")).filter("__s is not null")
    cell = F.size(F.filter(F.array(*[F.lit(edges[f"q{i}"]) for i in range(1, bins)]), lambda e: e < F.col("__s")))
    return rows.groupBy(cell.alias("bin")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("__s").alias("mean_score"), F.avg("__y").alias("mean_realised"))
