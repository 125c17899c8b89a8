"""Strategy analytics over weekly return series (long ``(strategy, date, ...)``).

Windows here are partitioned by strategy and ordered by date: one row per
rebalance date, so each group is calendar-sized.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage.functions.core import as_list

METRIC_NAMES = ("total_return_gross", "total_return_net", "annualized_return", "annualized_vol",
                "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate", "avg_turnover")


def equity_curve(df: DataFrame, by, date: str, gross: str = "return_gross", net: str = "return_net") -> DataFrame:
    """H8/H9: cumulative ``prod(1 + r)`` gross and net, running peak and drawdown.

    The running maximum starts at the first equity value (a first-week loss is
    not a drawdown), as in the reference.
    """
    w = Window.partitionBy(*as_list(by)).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    out = (df.withColumn("equity_gross", F.product(F.lit(1.0) + F.col(gross)).over(w))
           .withColumn("equity_net", F.product(F.lit(1.0) + F.col(net)).over(w)))
    return out.withColumn("drawdown", F.col("equity_net") / F.max("equity_net").over(w) - F.lit(1.0))


def strategy_metrics(df: DataFrame, by, date: str, gross: str = "return_gross", net: str = "return_net",
                     turnover: str = "turnover", periods_per_year: int = 52) -> DataFrame:
    """K9: total gross/net, annualised return and volatility (ddof 1), Sharpe,
    Sortino (ddof-1 std of negative returns only), max drawdown, Calmar, hit rate,
    mean turnover; zero denominators give NULL; ``n`` = number of periods."""
    by = as_list(by)
    eq = equity_curve(df, by, date, gross, net)
    sq = math.sqrt(periods_per_year)
    g = eq.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_periods"),
        (F.product(F.lit(1.0) + F.col(gross)) - 1.0).alias("total_return_gross"),
        (F.product(F.lit(1.0) + F.col(net)) - 1.0).alias("total_return_net"),
        F.stddev_samp(net).alias("_sd"),
        F.count(F.when(F.col(net) < 0, 1)).alias("_nneg"),
        F.stddev_samp(F.when(F.col(net) < 0, F.col(net))).alias("_dsd"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col(net) > 0).cast("double")).alias("hit_rate"),
        F.avg(turnover).alias("avg_turnover"))
    ann = F.pow(F.lit(1.0) + F.col("total_return_net"), F.lit(float(periods_per_year)) / F.col("n_periods")) - 1.0
    g = g.withColumn("annualized_return", ann)
    g = g.withColumn("annualized_vol", F.when(F.col("n_periods") > 1, F.col("_sd") * sq).otherwise(F.lit(0.0)))
    g = g.withColumn("_dvol", F.when(F.col("_nneg") > 1, F.col("_dsd") * sq).otherwise(F.lit(0.0)))
    g = (g.withColumn("sharpe", F.when(F.col("annualized_vol") > 0, F.col("annualized_return") / F.col("annualized_vol")))
         .withColumn("sortino", F.when(F.col("_dvol") > 0, F.col("annualized_return") / F.col("_dvol")))
         .withColumn("calmar", F.when(F.col("max_drawdown") < 0,
                                      F.col("annualized_return") / F.abs(F.col("max_drawdown")))))
    return g.select(*by, "n_periods", *METRIC_NAMES)


def rolling_reward(df: DataFrame, by, date: str, value: str, window: int, cost: str | None = None,
                   eps: float = 1e-6, out: str = "reward") -> DataFrame:
    """Rolling ``mean / (std_pop + eps)`` of ``value`` over the last ``window``
    rows including the current one, once at least 2 values exist, minus cost;
    otherwise ``value - cost``."""
    w = Window.partitionBy(*as_list(by)).orderBy(date).rowsBetween(-(window - 1), 0)
    c = F.col(cost) if cost else F.lit(0.0)
    r = F.when(F.count(value).over(w) >= 2,
               F.avg(value).over(w) / (F.stddev_pop(value).over(w) + F.lit(eps)) - c).otherwise(F.col(value) - c)
    return df.withColumn(out, r)


def reward_columns(df: DataFrame, by, date: str, port: str, base: str, sp: str, cost: str,
                   window: int = 16, downside_lambda: float = 5.0) -> DataFrame:
    """The reward variants as columns over a returns table with the portfolio,
    equal-weight and score-weighted baseline returns and the period cost."""
    out = (df.withColumn("excess_return", F.col(port) - F.col(base))
           .withColumn("reward_excess", F.col("excess_return") - F.col(cost))
           .withColumn("reward_return_only", F.col(port) - F.col(cost))
           .withColumn("reward_downside", F.col("excess_return")
                       - F.lit(downside_lambda) * F.greatest(F.lit(0.0), -F.col(port)) - F.col(cost))
           .withColumn("active_return", F.col(port) - F.col(sp)))
    out = rolling_reward(out, by, date, "excess_return", window, cost, out="reward_sharpe")
    out = rolling_reward(out, by, date, port, window, cost, out="reward_sharpe_total")
    return rolling_reward(out, by, date, "active_return", window, cost, out="reward_ir_vs_baseline")


def lagged_returns(df: DataFrame, by, date: str, value: str, history_len: int = 4,
                   prefix: str = "ret_lag_") -> DataFrame:
    """The last ``history_len`` values before each row, zero when absent
    (``ret_lag_1`` is the most recent)."""
    w = Window.partitionBy(*as_list(by)).orderBy(date)
    out = df
    for k in range(1, history_len + 1):
        out = out.withColumn(f"{prefix}{k}", F.coalesce(F.lag(value, k).over(w), F.lit(0.0)))
    return out


def mean_annualised(df: DataFrame, by, net: str = "return_net", periods_per_year: int = 52) -> DataFrame:
    """``(1 + mean)^52 - 1`` per group."""
    return df.groupBy(*as_list(by)).agg(
        (F.pow(F.lit(1.0) + F.avg(net), F.lit(float(periods_per_year))) - 1.0).alias("annualized_from_mean"))


def compare_to_base(metrics: DataFrame, key: str, base_value: str, cols: Sequence[str] = ("sharpe",),
                    extra_keys: Sequence[str] = ()) -> DataFrame:
    """Each strategy's metrics next to the base strategy's and their difference;
    ``win`` when the first metric beats the base. The base row is found with a
    window over the (small, one row per strategy) metrics table."""
    w = Window.partitionBy(*extra_keys) if extra_keys else Window.partitionBy()
    out = metrics
    for c in cols:
        out = out.withColumn(f"base_{c}", F.max(F.when(F.col(key) == base_value, F.col(c))).over(w))
        out = out.withColumn(f"diff_{c}", F.col(c) - F.col(f"base_{c}"))
    return out.withColumn("win", F.col(f"diff_{cols[0]}") > 0)


def leaderboard(results: DataFrame, by_metric: str, descending: bool = True) -> DataFrame:
    """Experiment rows ranked by a metric (rank column; the sink orders)."""
    o = F.col(by_metric).desc_nulls_last() if descending else F.col(by_metric).asc_nulls_last()
    return results.withColumn("rank", F.row_number().over(Window.orderBy(o)))


def rollup_vs_first(df: DataFrame, order: str, cols: Sequence[str], suffix: str = "_drift") -> DataFrame:
    """Per-walk rows next to their drift from the first row in ``order``
    (one row per walk: a small table, a single global window is fine)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df
    for c in cols:
        out = out.withColumn(c + suffix, F.col(c) - F.first(c).over(w))
    return out


def pack_observation(board: DataFrame, date: str, slot: str, per_name: Sequence[str],
                     per_date: Sequence[str]) -> DataFrame:
    """K11 packed form: one array per date — each per-name column in slot order,
    then the per-date values; NULL/NaN -> 0. The array length is
    ``K * len(per_name) + len(per_date)`` (bounded by K)."""
    g = board.groupBy(date).agg(
        F.sort_array(F.collect_list(F.struct(F.col(slot), *[F.col(c).cast("double").alias(c) for c in per_name])))
        .alias("_s"),
        *[F.first(c).cast("double").alias(c) for c in per_date])
    def field(name):
        return lambda s: s[name]

    parts = [F.transform("_s", field(c)) for c in per_name]
    parts.append(F.array(*[F.col(c) for c in per_date]))
    obs = F.transform(F.concat(*parts), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    return g.select(date, obs.alias("obs"))
