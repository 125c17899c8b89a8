"""Walk-forward rank -> scoreboard -> strategies -> weekly returns -> metrics.

All strategies (and walks) are rows of one long table, so the whole backtest
is one plan; nothing loops over dates on the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintage.functions.core import is_friday, nan_to_zero
from vintage.operators import crosssection as X
from vintage.operators import metrics as M
from vintage.operators import portfolio as P
from vintage.operators import temporal as T
from vintage.plans import roles

# Fixed values of the backtest role on the driver tables.
TOP_K = 5
N_BUCKETS = 8
MAX_WEIGHT = 0.3
COST_BPS = 5.0
TILT_SCALE = 0.5


def friday_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, date, ret, vol, fwd_ret_1d, fwd_ret_5d, score) on Fridays.

    Forward returns are computed on the full daily series first, then
    Fridays are kept (C9). ``score = -100 * ret`` (a one-day reversal signal)
    plays the ranker's output (I4).
    """
    d = roles.daily_bars(spark, sf_dir).select("entity_id", "date", "ret", "vol")
    f = T.forward_returns(d, "entity_id", "date", "ret", (1, 5))
    return f.filter(is_friday("date")).withColumn("score", F.lit(-100.0) * F.col("ret"))


def action_expr() -> F.Column:
    """External action per (entity, date): hash-free arithmetic, portable to SQL."""
    day = F.dayofmonth("date")
    return (F.pmod(F.col("entity_id") * 31 + day, F.lit(11)) - 5).cast("double") / 5.0


def scoreboard(fri: DataFrame, k: int = TOP_K) -> DataFrame:
    """top-K names per Friday with their slot (1 = highest score)."""
    return X.top_k(fri, "date", "score", k, "entity_id", rank_col="slot")


def strategy_weights(board: DataFrame, cap: float = MAX_WEIGHT, method: str = "exact",
                     loosen_cap: bool = False) -> DataFrame:
    """Long weights (strategy, date, entity_id, slot, w, fwd_ret_5d) for EW, SP, TILT.

    All rules are computed as columns of one board (windows over the same
    date partitioning) and turned long with ``explode`` — one pass over the
    board instead of one branch per strategy. A date with fewer than 1/cap names
    can't meet the cap: it raises, or with ``loosen_cap`` takes 1/n instead.
    """
    x = P.equal_weights(board, "date", "w_ew")
    x = x.withColumn("_cap", F.greatest(F.lit(float(cap)), F.col("w_ew")))
    eff = F.col("_cap") if loosen_cap and method == "exact" else cap
    x = P.capped_softmax(x, "date", "score", eff, "entity_id", "w_sp", method)
    x = P.tilted_weights(x.withColumn("action", action_expr()), "date", "w_sp", "action", TILT_SCALE, eff,
                         "entity_id", "w_tilt", method)
    arms = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(c).alias("w"))
                     for n, c in (("EW", "w_ew"), ("SP", "w_sp"), ("TILT", "w_tilt"))])
    return x.select("date", "entity_id", "slot", "fwd_ret_5d", F.explode(arms).alias("a")).select(
        "a.strategy", "date", "entity_id", "slot", "a.w", "fwd_ret_5d")


def weekly_returns(weights: DataFrame, cost_bps: float = COST_BPS, series_by=("strategy",),
                   with_sixty_forty: bool = True) -> DataFrame:
    """(strategy, date, return_gross, turnover, return_net); turnover in slot mode.

    Return and turnover come from one aggregate per (series, date); the 60/40
    proxy is emitted from the equal-weight rows (K5), not from a second branch.
    """
    sb = list(series_by)
    k = F.count(F.lit(1)).over(Window.partitionBy(*sb, "date"))
    prev = F.lag("w").over(Window.partitionBy(*sb, "slot").orderBy("date"))
    x = weights.select(*sb, "date", "w", "fwd_ret_5d",
                       F.abs(F.col("w") - F.coalesce(prev, F.lit(1.0) / k)).alias("_d"))
    r = x.groupBy(*sb, "date").agg(
        F.sum(F.col("w") * nan_to_zero("fwd_ret_5d")).alias("return_gross"),
        F.sum("_d").alias("turnover"))
    if with_sixty_forty:
        ew = F.col("strategy") == "EW"
        arms = F.when(ew, F.array(F.struct(F.col("strategy"), F.col("return_gross"), F.col("turnover")),
                                  F.struct(F.lit("SIXTY_FORTY").alias("strategy"),
                                           (F.lit(0.6) * F.col("return_gross") + F.lit(0.4 * 4.0 / 5200.0))
                                           .alias("return_gross"),
                                           (F.lit(0.6) * F.col("turnover")).alias("turnover")))
                      ).otherwise(F.array(F.struct(F.col("strategy"), F.col("return_gross"), F.col("turnover"))))
        others = [c for c in sb if c != "strategy"]
        r = r.select(*others, "date", F.explode(arms).alias("a")).select(
            "a.strategy", *others, "date", "a.return_gross", "a.turnover")
    return P.net_returns(r, cost_bps)


def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = weekly_returns(strategy_weights(scoreboard(friday_panel(spark, sf_dir)), loosen_cap=True))
    return M.strategy_metrics(r, "strategy", "date")
