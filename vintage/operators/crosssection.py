"""Cross-sectional operators: per-date demeaning, average ranks, return buckets,
z-scores, top-K selection and zero-information column detection.

Per-date windows hold one cross-section (one row per entity on that date),
so their size is bounded by the universe width. Top-K uses ``row_number() <=
K``, which Spark plans as a partial ``WindowGroupLimit`` *before* the
shuffle: at most K rows per date and map task cross the network, however
many rows one date holds.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintage.functions.core import as_list


def demean(df: DataFrame, by, col: str, out_col: str | None = None) -> DataFrame:
    """H5: ``x - mean(x)`` within each ``by`` group (NULLs ignored in the mean)."""
    w = Window.partitionBy(*as_list(by))
    return df.withColumn(out_col or f"{col}_demeaned", F.col(col) - F.avg(col).over(w))


# Values equal to this many decimals rank as ties: mathematically equal values
# (e.g. the same returns compounded in another order) differ in the last bits
# depending on summation order, and float noise must not decide a rank.
TIE_DIGITS = 12


def average_rank(col: str, by, tie_digits: int | None = TIE_DIGITS) -> Column:
    """1-based average rank within the group (NULL stays NULL)."""
    by = as_list(by)
    x = F.col(col) if tie_digits is None else F.round(F.col(col), tie_digits)
    r = F.rank().over(Window.partitionBy(*by).orderBy(x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), r + (ties - 1) / 2.0)


def average_rank_pct(col: str, by, tie_digits: int | None = TIE_DIGITS) -> Column:
    """Percentile rank with average ties, denominator = non-null count (pandas
    ``rank(pct=True, method='average')``); NULL stays NULL."""
    n = F.count(F.col(col)).over(Window.partitionBy(*as_list(by)))
    return average_rank(col, by, tie_digits) / n


def excess_return_buckets(df: DataFrame, date: str, ret: str, n_buckets: int = 32,
                          excess_col: str = "y_excess", bucket_col: str = "target",
                          split: int | None = None) -> DataFrame:
    """H6: excess over the date mean -> average-tie percentile -> ``floor(pct * n)``
    capped at ``n - 1``; NULL return gives NULL bucket.

    With ``split`` the per-date work avoids whole-date windows (mean as an
    aggregate joined back, ranks by :func:`average_rank_split`) for very wide
    cross-sections.
    """
    if split:
        means = df.groupBy(date).agg(F.avg(ret).alias("_mean"))
        out = df.join(means, date).withColumn(excess_col, F.col(ret) - F.col("_mean")).drop("_mean")
        out = average_rank_split(out, excess_col, date, "_pct", splits=split)
        b = F.when(F.col("_pct").isNotNull(), F.least(F.floor(F.col("_pct") * n_buckets),
                                                      F.lit(n_buckets - 1))).cast("int")
        return out.withColumn(bucket_col, b).drop("_pct")
    out = demean(df, date, ret, excess_col)
    pct = average_rank_pct(excess_col, date)
    # least() skips NULLs, so the NULL case is explicit
    b = F.when(pct.isNotNull(), F.least(F.floor(pct * n_buckets), F.lit(n_buckets - 1))).cast("int")
    return out.withColumn(bucket_col, b)


def zscore(df: DataFrame, by, cols: Sequence[str], eps: float = 1e-8, fill: float | None = 0.0,
           suffix: str = "") -> DataFrame:
    """H7: ``(x - mean) / (std_pop + eps)`` within the group, NULL-aware; NULL -> ``fill``."""
    w = Window.partitionBy(*as_list(by))
    out = df
    for c in cols:
        z = (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + F.lit(eps))
        out = out.withColumn(c + suffix, F.coalesce(z, F.lit(fill)) if fill is not None else z)
    return out


def rank_within(by, order: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*as_list(by)).orderBy(*order))


def top_k(df: DataFrame, date: str, score: str, k: int, entity: str,
          rank_col: str | None = None) -> DataFrame:
    """the K highest scores per date (fewer if the date has fewer rows);
    ties broken by ascending entity."""
    rn = rank_within(date, [F.col(score).desc_nulls_last(), F.col(entity).asc()])
    out = df.withColumn("_rn", rn).filter(F.col("_rn") <= k)
    if rank_col:
        return out.withColumnRenamed("_rn", rank_col)
    return out.drop("_rn")


def head_tail_flags(df: DataFrame, date: str, score: str, k: int, entity: str) -> DataFrame:
    """``is_top`` / ``is_bottom`` for the K highest / lowest scores of each date."""
    top = rank_within(date, [F.col(score).desc(), F.col(entity).asc()])
    bot = rank_within(date, [F.col(score).asc(), F.col(entity).desc()])
    return df.withColumn("is_top", top <= k).withColumn("is_bottom", bot <= k)


def zero_info_columns(train: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns that are all NULL or hold at most one distinct non-null value
    **in train**. One aggregate pass (min, max, count per column); the single
    result row is all that reaches the driver."""
    if not cols:
        return []
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"n__{c}"), F.min(c).alias(f"lo__{c}"), F.max(c).alias(f"hi__{c}")]
    row = train.agg(*aggs).first()
    return [c for c in cols if row[f"n__{c}"] == 0 or row[f"lo__{c}"] == row[f"hi__{c}"]]


def drop_zero_info(train: DataFrame, cols: Sequence[str], *others: DataFrame) -> tuple[DataFrame, ...]:
    """Drop the zero-information columns of ``train`` from train and every other frame."""
    drop = zero_info_columns(train, cols)
    return tuple(f.drop(*drop) for f in (train, *others))


def average_rank_split(df: DataFrame, col: str, by, out: str, pct: bool = True, splits: int = 64,
                       tie_digits: int | None = TIE_DIGITS) -> DataFrame:
    """Average rank (or percentile) of ``col`` within ``by`` for groups too large
    for one task (e.g. one date holding a large share of all rows).

    Counts per ``(group, value)`` are a partial aggregate; each group's values
    are cut into ``splits`` ranges at approximate quantiles; ranks are taken
    within a range and offset by the counts of all lower ranges. The result is
    exact (the quantiles only choose where to cut); no task sees a whole group.
    """
    by = as_list(by)
    x = F.col(col) if tie_digits is None else F.round(F.col(col), tie_digits)
    keyed = df.withColumn("_x", x)
    cnt = keyed.filter(F.col("_x").isNotNull()).groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    qs = [i / splits for i in range(1, splits)]
    cuts = cnt.groupBy(*by).agg(F.percentile_approx("_x", qs, 1000).alias("_q"),
                                F.sum("_c").alias("_n"))
    c = cnt.join(cuts, by).withColumn("_sb", F.size(F.filter(F.array_distinct("_q"), lambda q: q < F.col("_x"))))
    sizes = c.groupBy(*by, "_sb").agg(F.sum("_c").alias("_sc"))
    off = sizes.withColumn("_off", F.coalesce(F.sum("_sc").over(
        Window.partitionBy(*by).orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.join(off.select(*by, "_sb", "_off"), by + ["_sb"])
    below = F.coalesce(F.sum("_c").over(Window.partitionBy(*by, "_sb").orderBy("_x")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("_rank", F.col("_off") + below + (F.col("_c") + 1) / 2.0)
    val = (F.col("_rank") / F.col("_n")) if pct else F.col("_rank")
    ranks = c.select(*by, "_x", val.alias(out))
    return keyed.join(ranks, by + ["_x"], "left").drop("_x")
