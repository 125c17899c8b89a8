"""Registered queries of the price signals, limits and stability checks (N1-N8) and the walks with every arm.

Same conventions as ``catalog``; the tables play the roles of ``roles``: a supplier's
ship day is a bar, ``prc`` its traded dollars, ``prc / vol`` its price, the supplier's
region its sector, and a day of at most ``HALT_UNITS`` units a halt.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vintage.functions.core import round_doubles
from vintage.operators import limits as LI
from vintage.operators import metrics as M
from vintage.operators import portfolio as P
from vintage.operators import rolling as R
from vintage.operators import selection as SEL
from vintage.operators import stability as STB
from vintage.operators import vectors as V
from vintage.operators.asof import asof_join
from vintage.plans import backtest as BT
from vintage.plans import roles
from vintage.plans.catalog import (FIRST_TRAIN_END, SQL_DAILY, SQL_FRI, SQL_WALK_RETURNS, SQL_WEIGHTS, TRAIN_START,
                                   _pca_walk_grams, _walk_returns, register)
from vintage.session import materialize

# Rows of a year, a quarter and a month, and the eligibility limits on the roles above.
YEAR, QUARTER, MONTH, WEEK = 252, 63, 21, 5
MIN_ADV, MIN_PRICE, HALT_UNITS = 40_000.0, 1_200.0, 5
MAX_TURNOVER = 0.30


def _last(n: int, skip: int = 0) -> str:
    return f"(PARTITION BY entity_id ORDER BY date ROWS BETWEEN {n + skip - 1} PRECEDING AND {skip} PRECEDING)"


def _sql_full(value: str, n: int, result: str, skip: int = 0) -> str:
    return f"CASE WHEN count({value}) OVER {_last(n, skip)} = {n} THEN {result} END"


def _sql_return(n: int, skip: int = 0) -> str:
    return _sql_full("ln(1 + ret)", n, f"exp(sum(ln(1 + ret)) OVER {_last(n, skip)}) - 1", skip)


SQL_SIGNALS = f"""
mkt AS (SELECT date, avg(ret) AS market FROM daily GROUP BY date),
sig0 AS (SELECT d.*, m.market FROM daily d JOIN mkt m ON d.date = m.date),
sig AS (SELECT *, {_sql_return(MONTH)} AS mom_21, {_sql_return(QUARTER)} AS mom_63, {_sql_return(2 * QUARTER)} AS mom_126,
  {_sql_return(YEAR - MONTH, MONTH)} AS mom_252_skip_21, {_sql_return(WEEK)} AS ret_5,
  {_sql_full("ret", MONTH, f"stddev_samp(ret) OVER {_last(MONTH)} * sqrt(252)")} AS vol_21,
  {_sql_full("ret", QUARTER, f"stddev_samp(ret) OVER {_last(QUARTER)} * sqrt(252)")} AS vol_63,
  {_sql_full("ret", YEAR, f"covar_samp(ret, market) OVER {_last(YEAR)} / var_samp(market) OVER {_last(YEAR)}")} AS beta_252,
  {_sql_full("prc", MONTH, f"avg(prc) OVER {_last(MONTH)}")} AS adv_21,
  {_sql_full("prc", MONTH, f"avg(abs(ret) / prc * 1e6) OVER {_last(MONTH)}")} AS amihud_21,
  max(CASE WHEN vol <= {HALT_UNITS} THEN 1 ELSE 0 END) OVER {_last(WEEK)} = 0 AS unhalted_5,
  prc / vol AS price FROM sig0)"""

SIGNALS = ["mom_21", "mom_63", "mom_126", "mom_252_skip_21", "ret_5", "vol_21", "vol_63", "beta_252", "adv_21", "amihud_21"]


def price_signals(spark, sf_dir):
    """N1, N2, N4 on the daily bars: one row per (entity, date)."""
    daily = materialize(roles.daily_bars(spark, sf_dir), "daily")
    market = daily.groupBy("date").agg(F.avg("ret").alias("market"))
    out = R.trailing(daily.join(market, "date"), "entity_id", "date", YEAR, {
        "mom_21": R.compounded("ret", MONTH), "mom_63": R.compounded("ret", QUARTER),
        "mom_126": R.compounded("ret", 2 * QUARTER), "mom_252_skip_21": R.compounded("ret", YEAR - MONTH, MONTH),
        "ret_5": R.compounded("ret", WEEK), "vol_21": R.volatility("ret", MONTH), "vol_63": R.volatility("ret", QUARTER),
        "beta_252": R.beta("ret", "market", YEAR), "adv_21": R.mean_of(F.col("prc"), MONTH, "prc"),
        "amihud_21": R.illiquidity("ret", F.col("prc"), MONTH), "unhalted_5": R.none_of(F.col("vol") <= HALT_UNITS, WEEK)})
    return out.withColumn("price", F.col("prc") / F.col("vol"))


@register("price_signals", f"""
WITH {SQL_DAILY}, {SQL_SIGNALS}
SELECT entity_id, date, {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in SIGNALS)}, unhalted_5,
  coalesce(adv_21 >= {MIN_ADV} AND price >= {MIN_PRICE} AND unhalted_5, false) AS eligible FROM sig
""")
def q_price_signals(spark, sf_dir):
    ok = R.eligible("adv_21", "price", "unhalted_5", MIN_ADV, MIN_PRICE).alias("eligible")
    return round_doubles(price_signals(spark, sf_dir).select("entity_id", "date", *SIGNALS, "unhalted_5", ok))


@register("sector_median_fill", f"""
WITH {SQL_DAILY}, {SQL_SIGNALS},
s AS (SELECT sig.*, n.n_regionkey AS sector FROM sig JOIN supplier s ON sig.entity_id = s.s_suppkey
      JOIN nation n ON s.s_nationkey = n.n_nationkey)
SELECT entity_id, date, sector,
  {", ".join(f"round(coalesce({c}, median({c}) OVER (PARTITION BY date, sector)), 6) + 0.0 AS {c}" for c in ("adv_21", "vol_63"))}
FROM s
""")
def q_sector_median_fill(spark, sf_dir):
    """A signal that a name does not have yet becomes the exact median of its date and sector."""
    nation = roles.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("sector"))
    sector = roles.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), "s_nationkey").join(nation, "s_nationkey")
    sig = price_signals(spark, sf_dir).select("entity_id", "date", "adv_21", "vol_63").join(sector.drop("s_nationkey"), "entity_id")
    out = SEL.fill_with_median(materialize(sig, "signals"), ["date", "sector"], ["adv_21", "vol_63"])
    return round_doubles(out.select("entity_id", "date", "sector", "adv_21", "vol_63"))


QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}


@register("source_length_quantiles", f"""
SELECT source, count(*) AS n_values, {", ".join(
    f"round(quantile_cont(CAST(length(text) AS DOUBLE), CAST({q} AS DOUBLE)), 6) + 0.0 AS {n}" for n, q in QUANTILES.items())}
FROM documents WHERE text IS NOT NULL GROUP BY source
""")
def q_source_length_quantiles(spark, sf_dir):
    """E6 on groups of any size: exact quantiles of the text lengths of each source."""
    lengths = roles.table(spark, sf_dir, "documents").select("source", F.length("text").alias("n_chars"))
    return round_doubles(SEL.group_quantiles(lengths, "source", "n_chars", QUANTILES))


@register("score_calibration", f"""
WITH {SQL_DAILY}, {SQL_FRI},
e AS (SELECT quantile_cont(score, [{", ".join(f"CAST({i / 10} AS DOUBLE)" for i in range(1, 10))}]) AS q FROM fri)
SELECT CAST(len(list_filter(e.q, lambda x: x < fri.score)) AS INTEGER) AS bin, count(*) AS n_rows,
  round(avg(score), 6) + 0.0 AS mean_score, round(avg(fwd_ret_5d), 6) + 0.0 AS mean_realised FROM fri, e GROUP BY 1
""")
def q_score_calibration(spark, sf_dir):
    """Realised forward return by score-quantile bin."""
    fri = materialize(BT.friday_panel(spark, sf_dir).select("score", "fwd_ret_5d"), "scores")
    return round_doubles(SEL.calibration_table(fri, "score", "fwd_ret_5d", 10))


@register("turnover_capped_weights", f"""
WITH RECURSIVE {SQL_DAILY}, {SQL_FRI}, {SQL_WEIGHTS},
dts AS (SELECT strategy, date, row_number() OVER (PARTITION BY strategy ORDER BY date) AS i
        FROM (SELECT DISTINCT strategy, date FROM weights)),
tgt AS (SELECT w.strategy, d.i, map_from_entries(list((w.entity_id, w.w))) AS m
        FROM weights w JOIN dts d ON w.strategy = d.strategy AND w.date = d.date GROUP BY ALL),
held AS (
  SELECT strategy, i, m FROM tgt WHERE i = 1
  UNION ALL
  SELECT strategy, i, map_from_entries(list_transform(ks, lambda k: (k, coalesce(p[k], 0.0)
           + least(1.0, {MAX_TURNOVER} / nullif(l1, 0.0)) * (coalesce(m[k], 0.0) - coalesce(p[k], 0.0))))) AS m
  FROM (SELECT *, list_sum(list_transform(ks, lambda k: abs(coalesce(m[k], 0.0) - coalesce(p[k], 0.0)))) AS l1
        FROM (SELECT t.strategy, t.i, t.m, h.m AS p, list_distinct(list_concat(map_keys(t.m), map_keys(h.m))) AS ks
              FROM held h JOIN tgt t ON t.strategy = h.strategy AND t.i = h.i + 1))),
out AS (SELECT h.strategy, d.date, unnest(map_entries(h.m)) AS e FROM held h JOIN dts d ON h.strategy = d.strategy AND h.i = d.i)
SELECT strategy, date, e.key AS entity_id, round(e.value, 6) + 0.0 AS w FROM out WHERE round(e.value, 6) > 0
""")
def q_turnover_capped_weights(spark, sf_dir):
    """The weights after the turnover cap; positions below half a millionth are not listed."""
    w = BT.strategy_weights(BT.scoreboard(BT.friday_panel(spark, sf_dir)), loosen_cap=True)
    out = round_doubles(LI.cap_turnover(w, "strategy", "date", "entity_id", "w", MAX_TURNOVER))
    return out.filter("w > 0")


@register("holdings_concentration", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_WEIGHTS},
a AS (SELECT strategy, date, w FROM weights UNION ALL
      SELECT 'UNIVERSE', date, 1.0 / count(*) OVER (PARTITION BY date) FROM fri)
SELECT strategy, date, count(*) FILTER (w > 0) AS n_holdings, round(max(w), 6) + 0.0 AS max_weight,
       round(sum(w * w), 6) + 0.0 AS herfindahl FROM a GROUP BY strategy, date
""")
def q_holdings_concentration(spark, sf_dir):
    """Holdings, largest weight and Herfindahl index of every arm and of the equal-weight universe."""
    fri = materialize(BT.friday_panel(spark, sf_dir), "fri")
    width = fri.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    whole = fri.select("date").join(width, "date").select(F.lit("UNIVERSE").alias("strategy"), "date", (1.0 / F.col("n")).alias("w"))
    arms = BT.strategy_weights(BT.scoreboard(fri), loosen_cap=True).select("strategy", "date", "w")
    return round_doubles(STB.concentration(arms.unionByName(whole), ["strategy", "date"], "w"))


_IMPORTANCE = ["mom_21", "mom_63", "ret_5", "vol_21", "vol_63", "adv_21", "amihud_21", "ret", "vol", "price"]


@register("importance_rank_correlation", f"""
WITH {SQL_DAILY}, {SQL_SIGNALS}, {SQL_FRI},
x AS (SELECT sig.*, fwd.fwd_ret_5d AS y FROM sig JOIN fwd ON sig.entity_id = fwd.entity_id AND sig.date = fwd.date
      WHERE fwd.fwd_ret_5d IS NOT NULL),
wk AS (SELECT unnest(range(1, (SELECT CAST(max(year(date)) AS BIGINT) - 1996 FROM daily))) AS walk),
imp AS ({" UNION ALL ".join(
    f"SELECT walk, '{c}' AS feature, abs(corr(x.{c}, y)) AS v FROM x JOIN wk ON year(x.date) <= 1995 + walk WHERE x.{c} IS NOT NULL GROUP BY walk"
    for c in _IMPORTANCE)}),
pr AS (SELECT a.walk AS walk_a, b.walk AS walk_b, a.v AS va, b.v AS vb FROM imp a JOIN imp b ON a.feature = b.feature AND a.walk < b.walk
       WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
rk AS (SELECT walk_a, walk_b, rank() OVER (PARTITION BY walk_a, walk_b ORDER BY va) + (count(*) OVER (PARTITION BY walk_a, walk_b, va) - 1) / 2.0 AS ra,
              rank() OVER (PARTITION BY walk_a, walk_b ORDER BY vb) + (count(*) OVER (PARTITION BY walk_a, walk_b, vb) - 1) / 2.0 AS rb FROM pr)
SELECT CAST(walk_a AS INTEGER) AS walk_a, CAST(walk_b AS INTEGER) AS walk_b, count(*) AS n_features,
       round(corr(ra, rb), 6) + 0.0 AS rank_corr FROM rk GROUP BY walk_a, walk_b
""")
def q_importance_rank_correlation(spark, sf_dir):
    """Rank correlation across walks of the features' |correlation| with the forward return.

    Every training window is an expanding one, so a walk's moments are running sums of the yearly moments:
    rows are read once, whatever the number of walks.
    """
    sig = price_signals(spark, sf_dir)
    fwd = BT.T.forward_returns(sig, "entity_id", "date", "ret", (5,)).filter("fwd_ret_5d is not null")
    moments = STB.moments_by(fwd.withColumn("year", F.year("date")), "year", _IMPORTANCE, "fwd_ret_5d")
    imp = STB.expanding_correlation(moments, "year", first=1996).withColumn("walk", F.col("year") - 1995)
    last = sig.agg(F.max(F.year("date"))).first()[0]
    imp = imp.filter(F.col("year") < F.lit(last) - 1).withColumn("importance", F.abs("corr"))
    return round_doubles(STB.rank_correlation(materialize(imp, "importances"), "walk", "feature", "importance"))


@register("subspace_drift")
def q_subspace_drift(spark, sf_dir):
    """Cosines of the principal angles between each walk's leading components and walk 1's."""
    rows, width = [], None
    for w, (n, _, cov) in _pca_walk_grams(spark, sf_dir):
        if n < 2:
            continue
        width = V.width_for(V.explained_shares(cov), 0.95) if width is None else width
        top = np.linalg.eigh(cov)[1][:, ::-1][:, :width]
        rows += [(w.walk_id, j, i, float(x)) for (i, j), x in np.ndenumerate(top)]
    loadings = spark.createDataFrame(rows, "walk_id int, component int, feature int, loading double")
    first = min((r[0] for r in rows), default=1)
    return STB.subspace_cosines(loadings, "walk_id", "component", "feature", "loading", first)


# The stitched walks with every arm
SQL_YIELD = """
yld AS (SELECT CAST(o_orderdate AS DATE) AS print_date, avg(o_totalprice) / 50000 AS macro_yield FROM orders
        WHERE o_orderpriority = '2-HIGH' GROUP BY CAST(o_orderdate AS DATE))"""


def _macro_yield(spark, sf_dir):
    """(print_date, macro_yield): the mean value of high-priority orders per order day plays a bond yield in per cent."""
    od = roles.table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "2-HIGH")
    return od.groupBy(F.to_date("o_orderdate").alias("print_date")).agg((F.avg("o_totalprice") / 50000).alias("macro_yield"))


def _sixty_forty(spark, sf_dir, returns):
    """60/40 rows from the equal-weight rows, with the last yield printed by the date."""
    ew = returns.filter(F.col("strategy") == "EW").drop("return_net").withColumn("__one", F.lit(1))
    prints = _macro_yield(spark, sf_dir).withColumn("__one", F.lit(1))
    held = asof_join(ew, prints, "__one", "date", "print_date").drop("__one", "print_date")
    out = P.sixty_forty(held, yield_col="macro_yield").withColumn("strategy", F.lit("SIXTY_FORTY"))
    return P.net_returns(out, BT.COST_BPS)


@register("walk_sixty_forty", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_WALK_RETURNS}, {SQL_YIELD},
x AS (SELECT w.walk_id, w.date, y.macro_yield, 0.6 * w.return_gross + 0.4 * coalesce(y.macro_yield, 4.0) / 5200.0 AS return_gross,
             0.6 * w.turnover AS turnover FROM wret w ASOF LEFT JOIN yld y ON w.date >= y.print_date WHERE w.strategy = 'EW')
SELECT walk_id, date, round(macro_yield, 6) + 0.0 AS macro_yield, round(return_gross, 8) + 0.0 AS return_gross,
       round(turnover, 6) + 0.0 AS turnover, round(return_gross - {BT.COST_BPS / 1e4} * turnover, 8) + 0.0 AS return_net FROM x
""")
def q_walk_sixty_forty(spark, sf_dir):
    """The 60/40 arm of every walk with the macro yield known on the date."""
    out = _sixty_forty(spark, sf_dir, materialize(_walk_returns(spark, sf_dir), "walk_returns"))
    return round_doubles(out.select("walk_id", "date", "macro_yield", "return_gross", "turnover", "return_net"),
                         exact={"return_gross": 8, "return_net": 8})


@register("walk_menu")
def q_walk_menu(spark, sf_dir):
    """Metrics of all five arms (EW, SP, TILT, 60/40, minimum variance) over the stitched test weeks of the walks."""
    fri = materialize(BT.friday_panel(spark, sf_dir), "fri")
    board = BT.scoreboard(fri)
    arms = BT.strategy_weights(board, loosen_cap=True)
    mv = P.min_variance_weights(board, fri, [], "date", "entity_id", "fwd_ret_5d", cap=BT.MAX_WEIGHT)
    mv = mv.join(board.select("date", "entity_id", "slot", "fwd_ret_5d"), ["date", "entity_id"])
    w = materialize(arms.unionByName(mv.select(F.lit("MINVAR").alias("strategy"), *[c for c in arms.columns if c != "strategy"])), "weights")
    walks = BT.T.walk_schedule_of(w, "date", TRAIN_START, FIRST_TRAIN_END)
    lab = BT.T.assign_walks(w, walks, "date").filter(F.col("split") == "test").drop("split")
    r = materialize(BT.weekly_returns(lab, series_by=("strategy", "walk_id"), with_sixty_forty=False), "walk_returns")
    both = r.unionByName(_sixty_forty(spark, sf_dir, r).select(*r.columns))
    return round_doubles(M.strategy_metrics(both, "strategy", "date"))
