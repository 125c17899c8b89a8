"""Registered queries: one per operator group of the inventory, each runnable
on the driver's tables, plus the DuckDB SQL that states the same result.

Conventions shared by both sides: doubles rounded to 6 places (``+ 0.0``
normalises ``-0.0``), integer widths cast explicitly, dates as DATE, every
computed column aliased, every ``row_number`` given a total order.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintage.functions import keys as K
from vintage.functions import text as TX
from vintage.functions.core import round_doubles
from vintage.operators import crosssection as X
from vintage.operators import gates as G
from vintage.operators import intervals as IV
from vintage.operators import metrics as M
from vintage.operators import portfolio as P
from vintage.operators import ranking as RK
from vintage.operators import scoring as SC
from vintage.operators import subwords as SW
from vintage.operators import temporal as T
from vintage.operators import text as TXT
from vintage.operators import vectors as V
from vintage.operators.asof import days_since_event
from vintage.operators.lambdarank import pair_gradients
from vintage.operators.search import Dim, best_params, trial_table
from vintage.plans import backtest as BT
from vintage.plans import panel, roles
from vintage.session import checkpoint_dir, materialize
from vintage.sources import files as SF
from vintage.sources import sinks as SK
from vintage.sources.tables import common_years, repeatable_sample, scan_window
from vintage.streaming import incremental as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# --------------------------------------------------------------------------- #
# shared SQL fragments (CTEs over the pre-registered views)
# --------------------------------------------------------------------------- #
SQL_DAILY = """
daily AS (
  SELECT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS date,
         sum(l_extendedprice * (1.0 + l_discount)) / sum(l_extendedprice * (1.0 + l_tax)) - 1.01 AS ret, sum(l_extendedprice) AS prc, sum(l_quantity) AS vol
  FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"""

SQL_FUND = """
fund_raw AS (
  SELECT l.l_suppkey AS entity_id, CAST(o.o_orderdate AS DATE) AS datekey,
         o.o_orderkey AS order_key, o.o_totalprice AS revenue, o.o_orderpriority AS form_type
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
fund AS (
  SELECT entity_id, datekey, revenue, form_type FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, datekey ORDER BY order_key DESC) AS rn
    FROM fund_raw) WHERE rn = 1)"""


# --------------------------------------------------------------------------- #
# D1 / C10-C12 / B6 — point-in-time panel
# --------------------------------------------------------------------------- #
@register("pit_asof", f"""
WITH {SQL_DAILY}, {SQL_FUND}
SELECT d.entity_id, d.date,
       round(d.ret, 6) + 0.0 AS ret, round(d.prc, 6) + 0.0 AS prc, round(d.vol, 6) + 0.0 AS vol,
       f.datekey, round(f.revenue, 6) + 0.0 AS revenue, f.form_type,
       CAST(date_diff('day', f.datekey, d.date) AS INTEGER) AS fund_age_days,
       CAST(year(d.date) AS INTEGER) AS year
FROM daily d ASOF LEFT JOIN fund f ON d.entity_id = f.entity_id AND d.date >= f.datekey
""")
def q_pit_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(panel.build(spark, sf_dir))


# --------------------------------------------------------------------------- #
# temporal toolkit: D2, D9, H1, D4, D5, D11/G14, E4/H2, E5, H13, D13
# --------------------------------------------------------------------------- #


# Order priorities playing the 10-K / 10-Q / 8-K forms.
KQ8_FORMS = ("1-URGENT", "2-HIGH", "3-MEDIUM")
MACRO_SERIES = ("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW")

SQL_PANEL = """
panel AS (SELECT entity_id, lpad(CAST(entity_id AS VARCHAR), 10, '0') AS cik, date FROM daily)"""
SQL_FILINGS = """
filings AS (SELECT lpad(CAST(entity_id AS VARCHAR), 10, '0') AS cik, datekey AS filing_date, form_type
            FROM fund_raw)"""
SQL_WINDOWS = """
od AS (SELECT DISTINCT entity_id, datekey AS date FROM fund_raw),
og AS (SELECT entity_id, date,
              CASE WHEN date_diff('day', lag(date) OVER (PARTITION BY entity_id ORDER BY date), date) <= 5
                   THEN 0 ELSE 1 END AS new_spell FROM od),
os AS (SELECT *, sum(new_spell) OVER (PARTITION BY entity_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS spell_no
       FROM og),
sp AS (SELECT entity_id, spell_no, min(date) AS date_in, max(date) AS date_out FROM os GROUP BY 1, 2),
windows AS (SELECT entity_id, CAST(spell_no AS INTEGER) AS spell_no, date_in,
                   CASE WHEN spell_no = max(spell_no) OVER (PARTITION BY entity_id) THEN NULL
                        ELSE date_out END AS date_out FROM sp)"""


@register("days_since_filing", f"""
WITH {SQL_DAILY}, {SQL_FUND}, {SQL_PANEL}, {SQL_FILINGS},
kq AS (SELECT DISTINCT cik, filing_date FROM filings WHERE form_type IN {KQ8_FORMS})
SELECT p.entity_id, p.date, CAST(date_diff('day', f.filing_date, p.date) AS INTEGER) AS days_since_filing
FROM panel p ASOF LEFT JOIN kq f ON p.cik = f.cik AND p.date >= f.filing_date
""")
def q_days_since_filing(spark, sf_dir):
    f = roles.filings(spark, sf_dir).filter(F.col("form_type").isin(*KQ8_FORMS))
    out = days_since_event(roles.panel_keys(spark, sf_dir), f, "cik", "date", "filing_date",
                           "days_since_filing")
    return out.select("entity_id", "date", "days_since_filing")


@register("doc_count_window", f"""
WITH {SQL_DAILY}, {SQL_FUND}, {SQL_PANEL}, {SQL_FILINGS}
SELECT p.entity_id, p.date, CAST(count(f.cik) AS INTEGER) AS doc_count_7d
FROM panel p LEFT JOIN filings f ON p.cik = f.cik AND f.filing_date BETWEEN p.date - 7 AND p.date
GROUP BY p.entity_id, p.date
""")
def q_doc_count_window(spark, sf_dir):
    out = T.trailing_event_count(roles.panel_keys(spark, sf_dir), roles.filings(spark, sf_dir),
                                 "cik", "date", "filing_date", 7)
    return out.select("entity_id", "date", "doc_count_7d")


@register("forward_returns", f"""
WITH {SQL_DAILY}
SELECT entity_id, date, round(ret, 6) + 0.0 AS ret,
  round(CASE WHEN count(ln(1 + ret)) OVER w1 = 1 THEN exp(sum(ln(1 + ret)) OVER w1) - 1 END, 6) + 0.0 AS fwd_ret_1d,
  round(CASE WHEN count(ln(1 + ret)) OVER w5 = 5 THEN exp(sum(ln(1 + ret)) OVER w5) - 1 END, 6) + 0.0 AS fwd_ret_5d
FROM daily
WINDOW w1 AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING),
       w5 AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)
""")
def q_forward_returns(spark, sf_dir):
    d = roles.daily_bars(spark, sf_dir).select("entity_id", "date", "ret")
    return round_doubles(T.forward_returns(d, "entity_id", "date", "ret", (1, 5)))


@register("membership_spells", f"""
WITH {SQL_FUND}, {SQL_WINDOWS}
SELECT entity_id, spell_no, date_in, date_out FROM windows
""")
def q_membership_spells(spark, sf_dir):
    return roles.membership_windows(spark, sf_dir).select("entity_id", "spell_no", "date_in", "date_out")


@register("membership_flag", f"""
WITH {SQL_DAILY}, {SQL_FUND}, {SQL_WINDOWS}
SELECT d.entity_id, d.date,
       coalesce(bool_or(d.date BETWEEN w.date_in AND coalesce(w.date_out, DATE '2100-01-01')), false) AS in_universe
FROM daily d LEFT JOIN windows w ON d.entity_id = w.entity_id
GROUP BY d.entity_id, d.date
""")
def q_membership_flag(spark, sf_dir):
    d = roles.daily_bars(spark, sf_dir).select("entity_id", "date")
    return T.membership_flag(d, roles.membership_windows(spark, sf_dir), "entity_id", "date")


@register("membership_filter", f"""
WITH {SQL_DAILY}, {SQL_FUND}, {SQL_WINDOWS}
SELECT d.entity_id, d.date, round(d.ret, 6) + 0.0 AS ret FROM daily d
WHERE EXISTS (SELECT 1 FROM windows w WHERE w.entity_id = d.entity_id
              AND d.date BETWEEN w.date_in AND coalesce(w.date_out, DATE '2100-01-01'))
""")
def q_membership_filter(spark, sf_dir):
    d = roles.daily_bars(spark, sf_dir).select("entity_id", "date", "ret")
    return round_doubles(T.membership_filter(d, roles.membership_windows(spark, sf_dir), "entity_id", "date"))


SQL_VECTORS = f"""
v AS (SELECT CAST(vec_id // {roles.VECTORS_PER_FILER} + 1 AS BIGINT) AS entity_id,
             DATE '{roles.VECTOR_EPOCH}' + CAST(((vec_id // {roles.VECTORS_PER_FILER} + 1) * {roles.VECTOR_STRIDE}) % {roles.VECTOR_SPAN_DAYS}
                                             + 7 * (vec_id % {roles.VECTORS_PER_FILER}) AS INTEGER) AS date,
             vec_id, embedding AS vec FROM embeddings)"""


@register("text_novelty", f"""
WITH {SQL_VECTORS},
vl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, date ORDER BY vec_id DESC) AS rn
                      FROM v) WHERE rn = 1),
j AS (SELECT a.entity_id, a.date, a.vec AS va, b.vec AS vb
      FROM vl a LEFT JOIN vl b ON a.entity_id = b.entity_id AND b.date = a.date - 7)
SELECT entity_id, date,
  round(1 - list_sum(list_transform(range(1, len(va) + 1), lambda i: CAST(va[i] AS DOUBLE) * CAST(vb[i] AS DOUBLE)))
        / nullif(sqrt(list_sum(list_transform(va, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
               * sqrt(list_sum(list_transform(vb, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 0), 6) + 0.0
    AS text_novelty
FROM j
""")
def q_text_novelty(spark, sf_dir):
    out = T.text_novelty(roles.vectors(spark, sf_dir), "entity_id", "date", "vec", 7, order=["vec_id"])
    return round_doubles(out)


@register("macro_ffill", f"""
WITH m AS (SELECT CAST(o_orderdate AS DATE) AS date, regexp_replace(o_orderpriority, '^[0-9]-', '') AS series,
                  avg(o_totalprice) AS value FROM orders GROUP BY 1, 2),
w AS (SELECT date, {", ".join(f"max(CASE WHEN series = '{s}' THEN value END) AS {c}" for c, s in
                              [(T.series_column(s), s) for s in MACRO_SERIES])} FROM m GROUP BY date),
a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem),
j AS (SELECT a.date, {", ".join(T.series_column(s) for s in MACRO_SERIES)} FROM a LEFT JOIN w ON a.date = w.date)
SELECT date, {", ".join(f"round(last_value({c} IGNORE NULLS) OVER y, 6) + 0.0 AS {c}" for c in
                        [T.series_column(s) for s in MACRO_SERIES])}
FROM j WINDOW y AS (PARTITION BY year(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def q_macro_ffill(spark, sf_dir):
    wide = T.pivot_wide(roles.macro_long_orders(spark, sf_dir), "date", "series", "value", MACRO_SERIES)
    axis = roles.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return round_doubles(T.fill_on_axis(axis, wide, "date"))


@register("macro_pivot", """
WITH m AS (SELECT CAST(ts AS DATE) AS date, upper(event_type) AS series, avg(value) AS value
           FROM events GROUP BY 1, 2)
SELECT date,
  round(max(CASE WHEN series = 'CLICK' THEN value END), 6) + 0.0 AS macro_click,
  round(max(CASE WHEN series = 'ERROR' THEN value END), 6) + 0.0 AS macro_error,
  round(max(CASE WHEN series = 'PURCHASE' THEN value END), 6) + 0.0 AS macro_purchase,
  round(max(CASE WHEN series = 'SIGNUP' THEN value END), 6) + 0.0 AS macro_signup,
  round(max(CASE WHEN series = 'VIEW' THEN value END), 6) + 0.0 AS macro_view
FROM m GROUP BY date
""")
def q_macro_pivot(spark, sf_dir):
    return round_doubles(T.pivot_wide(roles.macro_long_events(spark, sf_dir), "date", "series", "value",
                                      ("CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW")))


@register("unpivot_bars", f"""
WITH {SQL_DAILY}
SELECT entity_id, date, 'ret' AS series, round(ret, 6) + 0.0 AS value FROM daily WHERE ret IS NOT NULL
UNION ALL SELECT entity_id, date, 'prc', round(prc, 6) + 0.0 FROM daily WHERE prc IS NOT NULL
UNION ALL SELECT entity_id, date, 'vol', round(vol, 6) + 0.0 FROM daily WHERE vol IS NOT NULL
""")
def q_unpivot_bars(spark, sf_dir):
    d = roles.daily_bars(spark, sf_dir)
    return round_doubles(T.unpivot_long(d, ["entity_id", "date"], ["ret", "prc", "vol"]))


# Fixed values of the walk-forward schedule on the driver tables; the number of walks follows the data.
TRAIN_START, FIRST_TRAIN_END = "1995-01-01", 1996


@register("walk_splits", f"""
WITH {SQL_DAILY},
wn AS (SELECT unnest(range(1, (SELECT CAST(max(year(date)) AS BIGINT) - 1996 FROM daily))) AS n),
walks AS (SELECT CAST(n AS INTEGER) AS walk_id, DATE '1995-01-01' AS train_start,
                 make_date(CAST(1995 + n AS INTEGER), 12, 31) AS train_end,
                 make_date(CAST(1996 + n AS INTEGER), 1, 1) AS val_start, make_date(CAST(1996 + n AS INTEGER), 12, 31) AS val_end,
                 make_date(CAST(1997 + n AS INTEGER), 1, 1) AS test_start, make_date(CAST(1997 + n AS INTEGER), 12, 31) AS test_end
          FROM wn),
lab AS (SELECT w.walk_id, d.entity_id, d.date,
               CASE WHEN d.date BETWEEN train_start AND train_end THEN 'train'
                    WHEN d.date BETWEEN val_start AND val_end THEN 'val' ELSE 'test' END AS split
        FROM daily d JOIN walks w ON d.date BETWEEN w.train_start AND w.test_end)
SELECT walk_id, split, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities,
       min(date) AS first_date, max(date) AS last_date FROM lab GROUP BY walk_id, split
""")
def q_walk_splits(spark, sf_dir):
    daily = materialize(roles.daily_bars(spark, sf_dir).select("entity_id", "date"), "daily")
    lab = T.assign_walks(daily, T.walk_schedule_of(daily, "date", TRAIN_START, FIRST_TRAIN_END), "date")
    return lab.groupBy("walk_id", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("n_entities"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))


# --------------------------------------------------------------------------- #
# cross-section, ranking, portfolio: C9, H5-H7, F5, F6, J1-J6, K1-K9, H8-H12
# --------------------------------------------------------------------------- #

SQL_FRI = """
fwd AS (SELECT entity_id, date, ret, vol,
  CASE WHEN count(ln(1 + ret)) OVER w1 = 1 THEN exp(sum(ln(1 + ret)) OVER w1) - 1 END AS fwd_ret_1d,
  CASE WHEN count(ln(1 + ret)) OVER w5 = 5 THEN exp(sum(ln(1 + ret)) OVER w5) - 1 END AS fwd_ret_5d
  FROM daily
  WINDOW w1 AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING),
         w5 AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
fri AS (SELECT *, -100.0 * ret AS score FROM fwd WHERE isodow(date) = 5)"""

SQL_BOARD = f"""
board AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity_id) AS slot
                         FROM fri) WHERE slot <= {BT.TOP_K})"""


def _sql_avg_rank(col: str, part: str = "date") -> str:
    x = f"round({col}, {X.TIE_DIGITS})"
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {x} ASC NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)")


def _sql_cap(src: str, dst: str, w: str, cap_value: float) -> str:
    """SQL of the exact capping fixed point (same recipe as ``portfolio.cap_weights``),
    with the per-date cap ``max(cap, 1/n)``."""
    cap = "_cap"
    return f"""
{dst}_c AS (SELECT *, greatest({cap_value}, 1.0 / count(*) OVER (PARTITION BY date)) AS _cap FROM {src}),
{dst}_a AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {w} DESC, entity_id) AS _r,
       sum({w}) OVER (PARTITION BY date ORDER BY {w} DESC, entity_id
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _from FROM {dst}_c),
{dst}_b AS (SELECT *, min(CASE WHEN {w} * (1 - (_r - 1) * {cap}) <= ({cap} + 1e-12) * _from THEN _r - 1 END)
       OVER (PARTITION BY date) AS _m FROM {dst}_a),
{dst} AS (SELECT * EXCLUDE (_r, _from, _m, _cap), CASE WHEN _r <= _m THEN {cap}
       ELSE coalesce({w} * (1 - _m * {cap}) / nullif(sum(CASE WHEN _r > _m THEN {w} END) OVER (PARTITION BY date), 0),
                     0.0) END AS w
       FROM {dst}_b)"""


SQL_WEIGHTS = f"""
{SQL_BOARD},
sp0 AS (SELECT *, exp(score - max(score) OVER (PARTITION BY date)) AS _e FROM board),
sp1 AS (SELECT *, _e / sum(_e) OVER (PARTITION BY date) AS w0 FROM sp0),
{_sql_cap("sp1", "sp", "w0", BT.MAX_WEIGHT)},
tl0 AS (SELECT * EXCLUDE (w, w0, _e), ln(w + 1e-8)
          + {BT.TILT_SCALE} * (((entity_id * 31 + dayofmonth(date)) % 11) - 5) / 5.0 AS _tilt FROM sp),
tl1 AS (SELECT *, exp(_tilt - max(_tilt) OVER (PARTITION BY date)) AS _e FROM tl0),
tl2 AS (SELECT *, _e / sum(_e) OVER (PARTITION BY date) AS w0 FROM tl1),
{_sql_cap("tl2", "tl", "w0", BT.MAX_WEIGHT)},
weights AS (
  SELECT 'EW' AS strategy, date, entity_id, slot, fwd_ret_5d, 1.0 / count(*) OVER (PARTITION BY date) AS w FROM board
  UNION ALL SELECT 'SP', date, entity_id, slot, fwd_ret_5d, w FROM sp
  UNION ALL SELECT 'TILT', date, entity_id, slot, fwd_ret_5d, w FROM tl)"""

SQL_RETURNS = f"""
{SQL_WEIGHTS},
tv0 AS (SELECT strategy, date, abs(w - coalesce(lag(w) OVER (PARTITION BY strategy, slot ORDER BY date),
                                                1.0 / count(*) OVER (PARTITION BY strategy, date))) AS d FROM weights),
tv AS (SELECT strategy, date, sum(d) AS turnover FROM tv0 GROUP BY ALL),
gr AS (SELECT strategy, date, sum(w * coalesce(fwd_ret_5d, 0.0)) AS return_gross FROM weights GROUP BY ALL),
r0 AS (SELECT g.strategy, g.date, g.return_gross, t.turnover FROM gr g JOIN tv t USING (strategy, date)),
r1 AS (SELECT * FROM r0 UNION ALL
       SELECT 'SIXTY_FORTY', date, 0.6 * return_gross + 0.4 * 4.0 / 5200.0, 0.6 * turnover FROM r0
       WHERE strategy = 'EW'),
rets AS (SELECT *, return_gross - {BT.COST_BPS / 1e4} * turnover AS return_net FROM r1)"""


@register("crosssection_targets", f"""
WITH {SQL_DAILY}, {SQL_FRI},
x AS (SELECT entity_id, date, ret, fwd_ret_5d, fwd_ret_5d - avg(fwd_ret_5d) OVER (PARTITION BY date) AS y_excess
      FROM fri),
r AS (SELECT *, CASE WHEN y_excess IS NOT NULL THEN {_sql_avg_rank("y_excess")}
                     / count(y_excess) OVER (PARTITION BY date) END AS pct FROM x)
SELECT entity_id, date, round(fwd_ret_5d, 6) + 0.0 AS fwd_ret_5d, round(y_excess, 6) + 0.0 AS y_excess,
       CAST(CASE WHEN pct IS NOT NULL THEN least(floor(pct * {BT.N_BUCKETS}), {BT.N_BUCKETS - 1}) END AS INTEGER)
         AS target,
       round(coalesce((ret - avg(ret) OVER (PARTITION BY date))
                      / (stddev_pop(ret) OVER (PARTITION BY date) + 1e-8), 0.0), 6) + 0.0 AS ret_z
FROM r
""")
def q_crosssection_targets(spark, sf_dir):
    fri = BT.friday_panel(spark, sf_dir)
    t = X.excess_return_buckets(fri, "date", "fwd_ret_5d", BT.N_BUCKETS)
    t = X.zscore(t, "date", ["ret"], suffix="_z")
    return round_doubles(t.select("entity_id", "date", "fwd_ret_5d", "y_excess", "target", "ret_z"))


@register("scoreboard_topk", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_BOARD}
SELECT entity_id, date, CAST(slot AS INTEGER) AS slot, round(score, 6) + 0.0 AS score,
       round(fwd_ret_5d, 6) + 0.0 AS fwd_ret_5d FROM board
""")
def q_scoreboard_topk(spark, sf_dir):
    b = BT.scoreboard(BT.friday_panel(spark, sf_dir))
    return round_doubles(b.select("entity_id", "date", "slot", "score", "fwd_ret_5d"))


@register("head_tail_means", f"""
WITH {SQL_DAILY}, {SQL_FRI},
t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity_id) AS rt,
                row_number() OVER (PARTITION BY date ORDER BY score ASC, entity_id DESC) AS rb FROM fri)
SELECT date, round(avg(CASE WHEN rt <= {BT.TOP_K} THEN fwd_ret_5d END), 6) + 0.0 AS top_mean,
       round(avg(CASE WHEN rb <= {BT.TOP_K} THEN fwd_ret_5d END), 6) + 0.0 AS bottom_mean
FROM t GROUP BY date
""")
def q_head_tail_means(spark, sf_dir):
    f = X.head_tail_flags(BT.friday_panel(spark, sf_dir), "date", "score", BT.TOP_K, "entity_id")
    return round_doubles(f.groupBy("date").agg(
        F.avg(F.when(F.col("is_top"), F.col("fwd_ret_5d"))).alias("top_mean"),
        F.avg(F.when(F.col("is_bottom"), F.col("fwd_ret_5d"))).alias("bottom_mean")))


SQL_LAB = f"""
t AS (SELECT entity_id, date, score, fwd_ret_5d - avg(fwd_ret_5d) OVER (PARTITION BY date) AS y
      FROM fri WHERE fwd_ret_5d IS NOT NULL),
lab AS (SELECT *, CAST(least(floor({_sql_avg_rank("y")} / count(y) OVER (PARTITION BY date) * {BT.N_BUCKETS}),
                             {BT.N_BUCKETS - 1}) AS INTEGER) AS label FROM t)"""


def _labelled(spark, sf_dir):
    fri = BT.friday_panel(spark, sf_dir).filter(F.col("fwd_ret_5d").isNotNull())
    return X.excess_return_buckets(fri, "date", "fwd_ret_5d", BT.N_BUCKETS, "y", "label")


@register("ndcg_by_date", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_LAB},
o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity_id) AS rs,
                row_number() OVER (PARTITION BY date ORDER BY label DESC, entity_id) AS rl FROM lab),
nd AS (SELECT date, count(*) AS n,
              sum(CASE WHEN rs <= {BT.TOP_K} THEN (pow(2.0, label) - 1) / log2(rs + 1.0) END) AS dcg,
              sum(CASE WHEN rl <= {BT.TOP_K} THEN (pow(2.0, label) - 1) / log2(rl + 1.0) END) AS idcg
       FROM o GROUP BY date)
SELECT date, n, round(dcg, 6) + 0.0 AS dcg, round(idcg, 6) + 0.0 AS idcg,
       round(CASE WHEN idcg > 0 THEN dcg / idcg END, 6) + 0.0 AS ndcg FROM nd
""")
def q_ndcg_by_date(spark, sf_dir):
    return round_doubles(RK.ndcg_by_group(_labelled(spark, sf_dir), "date", "score", "label", BT.TOP_K, "entity_id"))


@register("ranking_metrics", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_LAB},
o AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity_id) AS rs,
                row_number() OVER (PARTITION BY date ORDER BY label DESC, entity_id) AS rl,
                row_number() OVER (PARTITION BY date ORDER BY score ASC, entity_id DESC) AS rb,
                count(*) OVER (PARTITION BY date) AS n FROM lab),
nd AS (SELECT date, sum(CASE WHEN rs <= {BT.TOP_K} THEN (pow(2.0, label) - 1) / log2(rs + 1.0) END) AS dcg,
                    sum(CASE WHEN rl <= {BT.TOP_K} THEN (pow(2.0, label) - 1) / log2(rl + 1.0) END) AS idcg
       FROM o GROUP BY date),
ranks AS (SELECT date, {_sql_avg_rank("score")} AS ra, {_sql_avg_rank("y")} AS rb FROM lab),
ic0 AS (SELECT date, corr(ra, rb) AS ic FROM ranks GROUP BY date),
ic AS (SELECT * FROM ic0 WHERE ic IS NOT NULL AND NOT isnan(ic)),
dq AS (SELECT date, count(*) AS n,
              list_sort(list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))
              AS e FROM lab GROUP BY date),
bins AS (SELECT l.date, l.y, len(list_filter(e[2:len(e) - 1], lambda x: x < l.score)) AS bin
         FROM lab l JOIN dq ON l.date = dq.date WHERE dq.n >= 10 AND len(e) >= 2),
bm AS (SELECT date, bin, avg(y) AS m FROM bins GROUP BY date, bin),
sp AS (SELECT date, arg_max(m, bin) - arg_min(m, bin) AS spread FROM bm GROUP BY date),
hit AS (SELECT date, CASE WHEN avg(CASE WHEN rs <= {BT.TOP_K} THEN y END) > avg(CASE WHEN rb <= {BT.TOP_K} THEN y END)
                     THEN 1.0 ELSE 0.0 END AS hit FROM o WHERE n >= {2 * BT.TOP_K} GROUP BY date),
sets AS (SELECT date, list(entity_id) AS s FROM o WHERE rs <= {BT.TOP_K} GROUP BY date),
jac AS (SELECT date, s, lag(s) OVER (ORDER BY date) AS p FROM sets),
jj AS (SELECT len(list_intersect(s, p)) / len(list_distinct(list_concat(s, p))) AS jaccard FROM jac
       WHERE p IS NOT NULL)
SELECT 'ndcg_at_{BT.TOP_K}' AS metric, round(coalesce(avg(CASE WHEN idcg > 0 THEN dcg / idcg END), 0.0), 6) + 0.0 AS value FROM nd
UNION ALL SELECT 'rank_ic_mean', round(avg(ic), 6) + 0.0 FROM ic
UNION ALL SELECT 'rank_ic_ir', round(CASE WHEN count(ic) > 1 AND stddev_samp(ic) > 0
                                          THEN avg(ic) / stddev_samp(ic) END, 6) + 0.0 FROM ic
UNION ALL SELECT 'decile_spread_bps', round(avg(spread) * 1e4, 6) + 0.0 FROM sp
UNION ALL SELECT 'hit_rate', round(avg(hit), 6) + 0.0 FROM hit
UNION ALL SELECT 'top_k_jaccard', round(avg(jaccard), 6) + 0.0 FROM jj
""")
def q_ranking_metrics(spark, sf_dir):
    lab = _labelled(spark, sf_dir)
    return round_doubles(RK.ranking_summary(lab, "date", "score", "y", "label", "entity_id",
                                            k=BT.TOP_K, ndcg_k=BT.TOP_K))


@register("capped_weights", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_WEIGHTS}
SELECT strategy, date, entity_id, CAST(slot AS INTEGER) AS slot, round(w, 6) + 0.0 AS w FROM weights
""")
def q_capped_weights(spark, sf_dir):
    w = BT.strategy_weights(BT.scoreboard(BT.friday_panel(spark, sf_dir)), loosen_cap=True)
    return round_doubles(w.select("strategy", "date", "entity_id", "slot", "w"))


@register("strategy_returns", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_RETURNS}
SELECT strategy, date, round(return_gross, 6) + 0.0 AS return_gross, round(turnover, 6) + 0.0 AS turnover,
       round(return_net, 6) + 0.0 AS return_net FROM rets
""")
def q_strategy_returns(spark, sf_dir):
    r = BT.weekly_returns(BT.strategy_weights(BT.scoreboard(BT.friday_panel(spark, sf_dir)), loosen_cap=True))
    return round_doubles(r.select("strategy", "date", "return_gross", "turnover", "return_net"))


@register("equity_curve", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_RETURNS},
eq AS (SELECT strategy, date,
              product(1 + return_gross) OVER w AS equity_gross, product(1 + return_net) OVER w AS equity_net
       FROM rets WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT strategy, date, round(equity_gross, 6) + 0.0 AS equity_gross, round(equity_net, 6) + 0.0 AS equity_net,
       round(equity_net / max(equity_net) OVER (PARTITION BY strategy ORDER BY date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 6) + 0.0 AS drawdown FROM eq
""")
def q_equity_curve(spark, sf_dir):
    r = BT.weekly_returns(BT.strategy_weights(BT.scoreboard(BT.friday_panel(spark, sf_dir)), loosen_cap=True))
    e = M.equity_curve(r, "strategy", "date")
    return round_doubles(e.select("strategy", "date", "equity_gross", "equity_net", "drawdown"))


@register("strategy_metrics", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_RETURNS},
eq AS (SELECT *, product(1 + return_net) OVER w AS eqn FROM rets
       WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dd AS (SELECT *, eqn / max(eqn) OVER (PARTITION BY strategy ORDER BY date
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM eq),
g AS (SELECT strategy, count(*) AS n_periods, product(1 + return_gross) - 1 AS total_return_gross,
             product(1 + return_net) - 1 AS total_return_net, stddev_samp(return_net) AS sd,
             count(CASE WHEN return_net < 0 THEN 1 END) AS nneg,
             stddev_samp(CASE WHEN return_net < 0 THEN return_net END) AS dsd,
             min(drawdown) AS max_drawdown, avg(CASE WHEN return_net > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
             avg(turnover) AS avg_turnover FROM dd GROUP BY strategy),
h AS (SELECT *, pow(1 + total_return_net, 52.0 / n_periods) - 1 AS annualized_return,
             CASE WHEN n_periods > 1 THEN sd * sqrt(52) ELSE 0.0 END AS annualized_vol,
             CASE WHEN nneg > 1 THEN dsd * sqrt(52) ELSE 0.0 END AS dvol FROM g)
SELECT strategy, n_periods, round(total_return_gross, 6) + 0.0 AS total_return_gross,
  round(total_return_net, 6) + 0.0 AS total_return_net, round(annualized_return, 6) + 0.0 AS annualized_return,
  round(annualized_vol, 6) + 0.0 AS annualized_vol,
  round(CASE WHEN annualized_vol > 0 THEN annualized_return / annualized_vol END, 6) + 0.0 AS sharpe,
  round(CASE WHEN dvol > 0 THEN annualized_return / dvol END, 6) + 0.0 AS sortino,
  round(max_drawdown, 6) + 0.0 AS max_drawdown,
  round(CASE WHEN max_drawdown < 0 THEN annualized_return / abs(max_drawdown) END, 6) + 0.0 AS calmar,
  round(hit_rate, 6) + 0.0 AS hit_rate, round(avg_turnover, 6) + 0.0 AS avg_turnover
FROM h
""")
def q_strategy_metrics(spark, sf_dir):
    return round_doubles(BT.build_summary(spark, sf_dir))


# --------------------------------------------------------------------------- #
# text: G1-G11, E6, E7, F7
# --------------------------------------------------------------------------- #

_WS = TX.PY_WS


def _sql_collapse(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _sql_entities(x: str) -> str:
    for k, v in TX.BASIC_ENTITIES:
        v = v.replace("'", "''")
        x = f"replace({x}, '{k}', '{v}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def _sql_strip_html(x: str) -> str:
    return _sql_collapse(_sql_entities(f"regexp_replace({x}, '{TX.TAG}', ' ', 'g')"))


def _sql_tokens(x: str) -> str:
    s = _sql_strip(x)
    return f"CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, '{_WS}+') END"


def _sql_is_content(t: str) -> str:
    return (f"(length({t}) BETWEEN 2 AND 40 AND NOT regexp_matches({t}, '[:=\"/]') "
            f"AND regexp_matches(substr({t}, 1, 1), '^\\p{{L}}') "
            f"AND length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')) / length({t}) >= 0.6)")


@register("clean_pages", f"""
WITH b AS (SELECT page_id, html, regexp_extract_all(html, '{TX.TEXT_BLOCK}', 1) AS bodies FROM pages),
c AS (SELECT page_id, CASE WHEN len(bodies) = 0 THEN {_sql_strip_html("html")}
        ELSE array_to_string(list_filter(list_transform(bodies, lambda x: {_sql_strip_html("x")}),
                                         lambda s: s <> ''), chr(10)) END AS clean_text FROM b)
SELECT page_id, clean_text, CAST(length(clean_text) AS INTEGER) AS n_chars,
       length(clean_text) >= {TXT.MIN_OUTPUT_LENGTH} AS kept FROM c
""")
def q_clean_pages(spark, sf_dir):
    p = roles.table(spark, sf_dir, "pages")
    c = TXT.clean_documents(p, "html", "clean_text", min_length=None)
    return c.select("page_id", "clean_text", "n_chars", (F.col("n_chars") >= TXT.MIN_OUTPUT_LENGTH).alias("kept"))


@register("clean_envelopes", f"""
WITH c AS (SELECT page_id, {_sql_strip_html("coalesce(html, '')")} AS t FROM pages)
SELECT CAST(page_id AS INTEGER) AS page_id, CASE page_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN 'EX-99' ELSE NULL END AS type,
       CASE WHEN page_id % 3 = 2 OR t = '' THEN t ELSE t || chr(10) || 'End of ' || page_id END AS clean_text FROM c
""")
def q_clean_envelopes(spark, sf_dir):
    """The pages as documents of full-submission files, read back document by document and cleaned.

    A third of the documents have no TEXT tags, the others two bodies (the second in small letters).
    """
    p = roles.table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    kind = F.element_at(F.create_map(F.lit(0), F.lit("<TYPE>10-K\n"), F.lit(1), F.lit("<TYPE>EX-99\n"), F.lit(2), F.lit("")), (F.col("page_id") % 3).cast("int"))
    body = F.when(F.col("page_id") % 3 == 2, F.col("html")).otherwise(F.concat(
        F.lit("<TEXT>\n"), "html", F.lit("\n</TEXT>\n<text>"), F.when(F.trim("html") != "", F.concat(F.lit("End of "), "page_id")).otherwise(F.lit("")), F.lit("</text>\n")))
    doc = F.concat(F.lit("<DOCUMENT>\n"), kind, F.lit("<SEQUENCE>"), "page_id", F.lit("\n"), body, F.lit("</DOCUMENT>\n"))
    folder = f"{checkpoint_dir(spark).rstrip('/')}/envelopes-{uuid.uuid4().hex[:12]}"
    p.select(doc).write.text(folder)
    d = SF.read_envelopes(spark, folder)
    # the header fields of a document without TEXT tags are no text
    text = F.regexp_replace("document", r"(?im)^<(TYPE|SEQUENCE)>.*$", "")
    d = d.select("sequence", "type", text.alias("document"))
    c = TXT.clean_documents(d, "document", "clean_text", min_length=None, entities="basic")
    return c.select(F.col("sequence").alias("page_id"), "type", "clean_text")


def _sql_page_text_regex(x: str) -> str:
    for pat in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?is)<head\b.*?</head>",
                r"(?s)<!--.*?-->", r"(?is)<meta\b[^>]*>", r"(?is)<!doctype[^>]*>"):
        x = f"regexp_replace({x}, '{pat}', '', 'g')"
    raw = _sql_entities(f"regexp_replace({x}, '{TX.TAG}', chr(10), 'g')")
    return (f"array_to_string(list_filter(list_transform(string_split({raw}, chr(10)), lambda l: {_sql_strip('l')}),"
            f" lambda s: s <> ''), chr(10))")


@register("page_text", f"""
SELECT page_id, {_sql_page_text_regex("html")} AS page_text FROM pages
""")
def q_page_text(spark, sf_dir):
    p = roles.table(spark, sf_dir, "pages")
    return p.select("page_id", TXT.page_text("html", "regex").alias("page_text"))


@register("page_text_parser")
def q_page_text_parser(spark, sf_dir):
    p = roles.table(spark, sf_dir, "pages")
    return p.select("page_id", TXT.page_text("html", "parser").alias("page_text"))


@register("content_tokens", f"""
WITH t AS (SELECT doc_id, {_sql_tokens(_sql_collapse("text"))} AS toks FROM documents)
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens,
       CAST(len(list_filter(toks, lambda x: {_sql_is_content("x")})) AS INTEGER) AS n_content FROM t
""")
def q_content_tokens(spark, sf_dir):
    d = roles.table(spark, sf_dir, "documents")
    return TX.content_counts(d.select("doc_id", "text"), "text").select("doc_id", "n_tokens", "n_content")


# The oracle states the plain-text path; the driver's documents hold no HTML-like
# text, so the parser branch of ``refilter`` is not reached on them.
@register("refilter_documents", f"""
WITH t AS (SELECT doc_id, {_sql_tokens(_sql_collapse("text"))} AS toks FROM documents),
u AS (SELECT doc_id, len(toks) AS n, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM t),
f AS (SELECT *, CASE WHEN {_sql_is_content("tok")} THEN 1 ELSE 0 END AS flag FROM u),
w AS (SELECT *,
        avg(flag) OVER (PARTITION BY doc_id ORDER BY pos
                        ROWS BETWEEN {TXT.WINDOW_TOKENS // 2} PRECEDING AND {TXT.WINDOW_TOKENS // 2 - 1} FOLLOWING) AS dens,
        avg(flag) OVER (PARTITION BY doc_id) AS share,
        coalesce(max(flag) OVER (PARTITION BY doc_id ORDER BY pos
                                 ROWS BETWEEN {TXT.LOCAL_RADIUS} PRECEDING AND 1 PRECEDING), 0) AS back,
        coalesce(max(flag) OVER (PARTITION BY doc_id ORDER BY pos
                                 ROWS BETWEEN 1 FOLLOWING AND {TXT.LOCAL_RADIUS} FOLLOWING), 0) AS fwd
      FROM f),
k AS (SELECT *, CASE WHEN n <= {TXT.WINDOW_TOKENS} THEN share >= {TXT.CONTENT_THRESHOLD}
                     ELSE dens >= {TXT.CONTENT_THRESHOLD} AND (flag = 1 OR (back = 1 AND fwd = 1)) END AS keep
      FROM w),
a AS (SELECT doc_id, string_agg(CASE WHEN keep THEN tok END, ' ' ORDER BY pos) AS refiltered,
             count(*) FILTER (WHERE keep) AS n_kept, sum(flag) AS n_content FROM k GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.toks) AS INTEGER) AS n_tokens, CAST(coalesce(a.n_content, 0) AS INTEGER) AS n_content,
       CAST(coalesce(a.n_kept, 0) AS INTEGER) AS n_kept, coalesce(a.refiltered, '') AS refiltered
FROM t LEFT JOIN a ON t.doc_id = a.doc_id
""")
def q_refilter_documents(spark, sf_dir):
    d = roles.table(spark, sf_dir, "documents").select("doc_id", "text")
    return TXT.refilter(d, "text").select("doc_id", "n_tokens", "n_content", "n_kept", "refiltered")


@register("doc_length_profile", """
WITH d AS (SELECT lang, CAST(strlen(text) AS INTEGER) AS bytes FROM documents)
SELECT lang, count(*) AS n,
       round(quantile_cont(bytes, 0.5), 6) + 0.0 AS p50, round(quantile_cont(bytes, 0.9), 6) + 0.0 AS p90,
       round(quantile_cont(bytes, 0.95), 6) + 0.0 AS p95, round(quantile_cont(bytes, 0.99), 6) + 0.0 AS p99,
       max(bytes) AS max
FROM d GROUP BY lang
""")
def q_doc_length_profile(spark, sf_dir):
    d = roles.table(spark, sf_dir, "documents").select("lang", F.octet_length("text").alias("bytes"))
    return round_doubles(TXT.length_percentiles(d, "lang", "bytes"))


@register("doc_length_histogram", """
WITH s0 AS (SELECT lang, CAST(strlen(text) AS INTEGER) AS bytes FROM documents),
s AS (SELECT lang, log10(bytes) AS lx FROM s0 WHERE bytes > 0),
b AS (SELECT min(lx) AS lo, max(lx) AS hi FROM s)
SELECT lang, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((lx - lo) / (hi - lo) * 80), 79) END AS INTEGER) AS bin,
       count(*) AS n
FROM s, b GROUP BY ALL
""")
def q_doc_length_histogram(spark, sf_dir):
    d = roles.table(spark, sf_dir, "documents").select("lang", F.octet_length("text").alias("bytes"))
    return TXT.log_histogram(d, "lang", "bytes", 80)


@register("largest_documents", """
WITH d AS (SELECT doc_id, lang, CAST(strlen(text) AS INTEGER) AS bytes FROM documents)
SELECT doc_id, lang, bytes FROM (SELECT *, row_number() OVER (ORDER BY bytes DESC, doc_id) AS rn FROM d)
WHERE rn <= 15
""")
def q_largest_documents(spark, sf_dir):
    d = roles.table(spark, sf_dir, "documents")
    return (d.select("doc_id", "lang", F.octet_length("text").alias("bytes"))
            .orderBy(F.col("bytes").desc(), "doc_id").limit(15))


def _sql_chunks(mode: str) -> str:
    step = TXT.CHUNK_LEN - 2 - TXT.STRIDE
    cond = (f"n - s >= {TXT.MIN_CHUNK_TOKENS}" if mode == "train" else f"(s = 0 OR n - s > {TXT.STRIDE})")
    where = "" if mode == "train" else f"WHERE length({_sql_strip('text')}) >= {TXT.MIN_EMBED_CHARS}"
    return f"""
WITH t AS (SELECT doc_id, {_sql_tokens("text")} AS toks FROM documents {where}),
s AS (SELECT doc_id, toks, len(toks) AS n, unnest(range(0, len(toks), {step})) AS s FROM t),
c AS (SELECT doc_id, toks, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_no FROM s
      WHERE {cond})
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(s AS INTEGER) AS start,
       CAST(least(n - s, {TXT.CHUNK_LEN - 2}) AS INTEGER) AS n_body,
       toks[s + 1] AS first_token, toks[least(n, s + {TXT.CHUNK_LEN - 2})] AS last_token FROM c
"""


def _chunks(spark, sf_dir, mode):
    d = roles.table(spark, sf_dir, "documents")
    if mode == "inference":
        d = d.filter(F.length(TX.strip_ws("text")) >= TXT.MIN_EMBED_CHARS)
    c = TXT.chunk_documents(d.select("doc_id", TX.tokens("text").alias("tok")), "doc_id", "tok", mode)
    return c.select("doc_id", "chunk_no", "start", "n_body", F.col("body")[0].alias("first_token"),
                    F.element_at("body", -1).alias("last_token"))


@register("token_chunks", _sql_chunks("train"))
def q_token_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir, "train")


@register("inference_chunks", _sql_chunks("inference"))
def q_inference_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir, "inference")


def _sql_md5_number(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


def _subword_vocabulary(spark, sf_dir):
    """(token, id): the special tokens, then the benchmark's words and their parts in the order of their text."""
    words = F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    w = roles.table(spark, sf_dir, "benchmark").select(F.explode(words).alias("w")).distinct()
    chars = w.select(F.explode(F.split("w", "")).alias("c")).filter("c <> ''")
    pieces = w.select(F.col("w").alias("token")).union(chars.select("c")).union(chars.select(F.concat(F.lit("##"), "c")))
    pieces = pieces.union(w.filter(F.length("w") <= 5).select(F.concat(F.lit("##"), "w"))).distinct()
    special = [(t, i) for i, t in enumerate((SW.PAD, SW.UNKNOWN, SW.BEGIN, SW.END))]
    ranked = pieces.select("token", (F.row_number().over(Window.orderBy("token")) + 3).cast("int").alias("id"))
    return spark.createDataFrame(special, "token string, id int").unionByName(ranked)


@register("subword_chunks", f"""
WITH RECURSIVE w0 AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark),
ch AS (SELECT DISTINCT unnest(string_split(w, '')) AS c FROM w0),
pieces AS (SELECT w AS token, w AS piece, false AS later FROM w0 UNION SELECT c, c, false FROM ch UNION SELECT '##' || c, c, true FROM ch
           UNION SELECT '##' || w, w, true FROM w0 WHERE length(w) <= 5),
vocab AS (SELECT piece, later, CAST(row_number() OVER (ORDER BY token) + 3 AS INTEGER) AS id FROM pieces),
top AS (SELECT max(length(piece)) AS m FROM vocab),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+|[^\\p{{Z}}\\s\\p{{L}}\\p{{N}}]') AS ws FROM documents),
words AS (SELECT DISTINCT unnest(ws) AS w FROM d),
g AS (SELECT w, CAST(1 AS BIGINT) AS pos, []::INTEGER[] AS ids FROM words
      UNION ALL
      SELECT w, max(pos + l), list_append(ids, max_by(id, l))
      FROM (SELECT w, pos, ids, unnest(range(1, least((SELECT m FROM top), length(w) - pos + 1) + 1)) AS l FROM g
            WHERE pos <= length(w) AND length(w) <= 100) x
      JOIN vocab v ON v.piece = substr(w, pos, l) AND v.later = (pos > 1) GROUP BY w, pos, ids),
cut AS (SELECT w, ids FROM g WHERE pos = length(w) + 1),
tok AS (SELECT d.doc_id, i.i, coalesce(cut.ids, [1]) AS ids
        FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d) i JOIN d USING (doc_id) LEFT JOIN cut ON cut.w = i.w),
t AS (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM tok GROUP BY doc_id),
c AS (SELECT doc_id, k AS chunk_no, list_slice(ids, k * 446 + 1, k * 446 + 510) AS body
      FROM (SELECT doc_id, ids, unnest(range(0, CAST(ceil(len(ids) / 446.0) AS BIGINT))) AS k FROM t) WHERE len(ids) - k * 446 >= 128)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(len(body) AS INTEGER) AS n_body,
       '2 ' || array_to_string(body, ' ') || ' 3' || repeat(' 0', 510 - len(body)) AS input_ids,
       trim(repeat('1 ', len(body) + 2) || repeat('0 ', 510 - len(body))) AS attention_mask
FROM c
""")
def q_subword_chunks(spark, sf_dir):
    """Subword ids of whole texts in windows of 510, with special tokens, padding and mask."""
    vocabulary = SW.read_vocabulary(_subword_vocabulary(spark, sf_dir))
    d = roles.table(spark, sf_dir, "documents")
    d = d.select("doc_id", SW.subword_ids(F.col("text"), vocabulary).alias("ids"))
    c = TXT.chunk_documents(d, "doc_id", "ids", "train")
    ids, mask = TXT.model_inputs(F.col("body"), cls=vocabulary[SW.BEGIN], sep=vocabulary[SW.END], pad=vocabulary[SW.PAD])
    return c.select("doc_id", "chunk_no", "n_body", F.array_join(ids, " ").alias("input_ids"), F.array_join(mask, " ").alias("attention_mask"))


@register("doc_split", f"""
SELECT CASE WHEN {_sql_md5_number("doc_id", 42)} % 10000 < 9500 THEN 'train' ELSE 'val' END AS split, count(*) AS n_docs
FROM documents GROUP BY 1
""")
def q_doc_split(spark, sf_dir):
    d = roles.table(spark, sf_dir, "documents")
    return d.groupBy(TXT.doc_split("doc_id").alias("split")).agg(F.count(F.lit(1)).alias("n_docs"))


# --------------------------------------------------------------------------- #
# vectors: E8, E9, G12, G13, H3, B12, G15-G19
# --------------------------------------------------------------------------- #

GRID_TAIL_DAYS = 60


def _round_vec(c: str, places: int = 6):
    return F.transform(F.col(c), lambda x: F.round(x.cast("double"), places) + F.lit(0.0))


def _stockday_inputs(spark, sf_dir):
    return panel.stockday_inputs(spark, sf_dir, GRID_TAIL_DAYS)


SQL_STOCKDAY = f"""
{SQL_VECTORS},
grid AS (SELECT entity_id, CAST(unnest(generate_series(min(date), max(date) + {GRID_TAIL_DAYS}, INTERVAL 1 DAY)) AS DATE)
                AS date FROM v GROUP BY entity_id),
hit AS (SELECT g.entity_id, g.date, v.vec, pow(0.5, date_diff('day', v.date, g.date) / {float(V.HALF_LIFE_DAYS)}) AS w
        FROM grid g JOIN v ON g.entity_id = v.entity_id AND g.date BETWEEN v.date AND v.date + {V.WINDOW_DAYS}),
el AS (SELECT entity_id, date, w, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM hit),
agg AS (SELECT entity_id, date, list(m ORDER BY i) AS vec FROM
          (SELECT entity_id, date, i, sum(w * x) / sum(w) AS m FROM el GROUP BY entity_id, date, i) GROUP BY ALL),
sfill AS (SELECT g.entity_id, g.date, last_value(a.vec IGNORE NULLS) OVER (PARTITION BY g.entity_id ORDER BY g.date
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vec FROM grid g LEFT JOIN agg a
          ON g.entity_id = a.entity_id AND g.date = a.date),
sv AS (SELECT * FROM sfill WHERE vec IS NOT NULL)"""


@register("stockday_vectors", f"""
WITH {SQL_STOCKDAY}
SELECT entity_id, date, list_transform(vec, lambda x: round(x, 6) + 0.0) AS vec FROM sv
""")
def q_stockday_vectors(spark, sf_dir):
    grid, docs, bridge = _stockday_inputs(spark, sf_dir)
    out = V.stockday_vectors(grid, docs, bridge, "entity_id", "date", "cik", "doc_id", "filing_date", "vec",
                             dtype="float64")
    return out.select("entity_id", "date", _round_vec("vec").alias("vec"))


@register("chunk_mean_pool", """
WITH el AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM el GROUP BY label, i),
n AS (SELECT label, count(*) AS n_chunks FROM embeddings GROUP BY label)
SELECT m.label, n.n_chunks, list(round(m.m, 6) + 0.0 ORDER BY i) AS vec FROM m JOIN n ON m.label = n.label
GROUP BY m.label, n.n_chunks
""")
def q_chunk_mean_pool(spark, sf_dir):
    e = roles.table(spark, sf_dir, "embeddings")
    out = V.mean_vectors(e, "label", "embedding", out="vec", count_col="n_chunks", dtype="float64")
    return out.select("label", "n_chunks", _round_vec("vec").alias("vec"))


@register("vector_sanity", """
WITH t AS (SELECT embedding AS v,
                  sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm,
                  len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0 AS bad FROM embeddings)
SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad, round(avg(nrm), 6) + 0.0 AS norm_mean,
       round(stddev_pop(nrm), 6) + 0.0 AS norm_std, CAST(min(len(v)) AS INTEGER) AS min_dim,
       CAST(max(len(v)) AS INTEGER) AS max_dim FROM t
""")
def q_vector_sanity(spark, sf_dir):
    return round_doubles(V.vector_sanity(roles.table(spark, sf_dir, "embeddings"), "embedding"))


@register("doc_embeddings")
def q_doc_embeddings(spark, sf_dir):
    d = roles.table(spark, sf_dir, "documents").filter(F.length("text") >= TXT.MIN_EMBED_CHARS)
    ch = TXT.chunk_documents(d.select("doc_id", TX.tokens("text").alias("tok")), "doc_id", "tok", "inference")
    return V.embed_documents(ch, "doc_id", "body", dim=64)


# --------------------------------------------------------------------------- #
# §3.2 training panel composition, B8/B10 audit, E1, E10, E11
# --------------------------------------------------------------------------- #

_MACRO_COLS = [T.series_column(s) for s in MACRO_SERIES]
SQL_MACRO = f"""
mlong AS (SELECT CAST(o_orderdate AS DATE) AS date, regexp_replace(o_orderpriority, '^[0-9]-', '') AS series,
                 avg(o_totalprice) AS value FROM orders GROUP BY 1, 2),
mwide AS (SELECT date, {", ".join(f"max(CASE WHEN series = '{s}' THEN value END) AS {T.series_column(s)}"
                                  for s in MACRO_SERIES)} FROM mlong GROUP BY date),
maxis AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem),
mj AS (SELECT maxis.date, {", ".join(_MACRO_COLS)} FROM maxis LEFT JOIN mwide ON maxis.date = mwide.date),
macro AS (SELECT date, {", ".join(f"last_value({c} IGNORE NULLS) OVER y AS {c}" for c in _MACRO_COLS)}
          FROM mj WINDOW y AS (PARTITION BY year(date) ORDER BY date
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

SQL_NOVELTY = """
nv AS (SELECT a.entity_id, a.date,
         1 - list_sum(list_transform(range(1, len(a.vec) + 1), lambda i: a.vec[i] * b.vec[i]))
             / nullif(sqrt(list_sum(list_transform(a.vec, lambda x: x * x)))
                      * sqrt(list_sum(list_transform(b.vec, lambda x: x * x))), 0) AS text_novelty
       FROM sv a LEFT JOIN sv b ON a.entity_id = b.entity_id AND b.date = a.date - 7)"""

SQL_TRAINING = f"""
{SQL_DAILY}, {SQL_FUND}, {SQL_PANEL}, {SQL_FILINGS}, {SQL_WINDOWS}, {SQL_MACRO}, {SQL_STOCKDAY}, {SQL_NOVELTY},
member AS (SELECT p.entity_id, p.cik, p.date, d.ret, d.prc, d.vol FROM panel p JOIN daily d
           ON p.entity_id = d.entity_id AND p.date = d.date
           WHERE EXISTS (SELECT 1 FROM windows w WHERE w.entity_id = p.entity_id
                         AND p.date BETWEEN w.date_in AND coalesce(w.date_out, DATE '2100-01-01'))),
kq AS (SELECT DISTINCT cik, filing_date FROM filings WHERE form_type IN {KQ8_FORMS}),
rec AS (SELECT m.entity_id, m.date, CAST(date_diff('day', k.filing_date, m.date) AS INTEGER) AS days_since_filing
        FROM member m ASOF LEFT JOIN kq k ON m.cik = k.cik AND m.date >= k.filing_date),
cnt AS (SELECT m.entity_id, m.date, CAST(count(f.cik) AS INTEGER) AS doc_count_7d FROM member m
        LEFT JOIN filings f ON m.cik = f.cik AND f.filing_date BETWEEN m.date - 7 AND m.date GROUP BY ALL),
lab AS (SELECT entity_id, date,
          CASE WHEN count(ln(1 + ret)) OVER w1 = 1 THEN exp(sum(ln(1 + ret)) OVER w1) - 1 END AS fwd_ret_1d,
          CASE WHEN count(ln(1 + ret)) OVER w5 = 5 THEN exp(sum(ln(1 + ret)) OVER w5) - 1 END AS fwd_ret_5d
        FROM member
        WINDOW w1 AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING),
               w5 AS (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
training AS (SELECT m.*, {", ".join("mc." + c for c in _MACRO_COLS)}, r.days_since_filing, c.doc_count_7d,
                    nv.text_novelty, l.fwd_ret_1d, l.fwd_ret_5d, CAST(year(m.date) AS INTEGER) AS year
             FROM member m LEFT JOIN macro mc ON m.date = mc.date
             LEFT JOIN nv ON m.entity_id = nv.entity_id AND m.date = nv.date
             JOIN rec r ON m.entity_id = r.entity_id AND m.date = r.date
             JOIN cnt c ON m.entity_id = c.entity_id AND m.date = c.date
             JOIN lab l ON m.entity_id = l.entity_id AND m.date = l.date)"""


@register("training_panel", f"""
WITH {SQL_TRAINING}
SELECT entity_id, cik, date, round(ret, 6) + 0.0 AS ret, round(prc, 6) + 0.0 AS prc, round(vol, 6) + 0.0 AS vol,
       {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _MACRO_COLS)}, days_since_filing, doc_count_7d,
       round(text_novelty, 6) + 0.0 AS text_novelty,
       round(fwd_ret_1d, 6) + 0.0 AS fwd_ret_1d, round(fwd_ret_5d, 6) + 0.0 AS fwd_ret_5d, year
FROM training
""")
def q_training_panel(spark, sf_dir):
    return round_doubles(panel.training_panel(spark, sf_dir))


@register("panel_audit", f"""
WITH {SQL_TRAINING}
SELECT year, count(*) AS n_rows, count(DISTINCT entity_id) AS n_keys,
       round(avg(CASE WHEN days_since_filing IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS null_days_since_filing,
       round(avg(CASE WHEN fwd_ret_5d IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS null_fwd_ret_5d,
       round(avg(CASE WHEN macro_urgent IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS null_macro_urgent
FROM training GROUP BY year
""")
def q_panel_audit(spark, sf_dir):
    t = panel.training_panel(spark, sf_dir)
    return round_doubles(G.audit_by(t, "year", "entity_id", ["days_since_filing", "fwd_ret_5d", "macro_urgent"]))


@register("null_rate_gate", f"""
WITH {SQL_TRAINING},
r AS (SELECT CAST(year AS VARCHAR) AS scope,
             avg(CASE WHEN days_since_filing IS NULL THEN 1.0 ELSE 0.0 END) AS a,
             avg(CASE WHEN fwd_ret_5d IS NULL THEN 1.0 ELSE 0.0 END) AS b,
             avg(CASE WHEN text_novelty IS NULL THEN 1.0 ELSE 0.0 END) AS c FROM training GROUP BY year)
SELECT scope, 'NULL_RATE:days_since_filing' AS rule, round(a, 6) + 0.0 AS value, CAST(0.1 AS DOUBLE) AS "limit",
       a <= 0.1 AS ok FROM r
UNION ALL SELECT scope, 'NULL_RATE:fwd_ret_5d', round(b, 6) + 0.0, CAST(0.05 AS DOUBLE), b <= 0.05 FROM r
UNION ALL SELECT scope, 'NULL_RATE:text_novelty', round(c, 6) + 0.0, CAST(0.1 AS DOUBLE), c <= 0.1 FROM r
""")
def q_null_rate_gate(spark, sf_dir):
    t = panel.training_panel(spark, sf_dir)
    return round_doubles(G.null_rate_table(t, {"days_since_filing": 0.1, "fwd_ret_5d": 0.05, "text_novelty": 0.1}, by="year"))


@register("panel_ranges", f"""
WITH {SQL_DAILY}
SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities, min(date) AS first_date, max(date) AS last_date
FROM daily
""")
def q_panel_ranges(spark, sf_dir):
    d = roles.daily_bars(spark, sf_dir)
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("n_entities"),
                 F.min("date").alias("first_date"), F.max("date").alias("last_date"))


# --------------------------------------------------------------------------- #
# keys and intervals: C1-C5, D3, D6, D14, H4
# --------------------------------------------------------------------------- #


def _sql_cik(x: str) -> str:
    s = f"CAST(CAST(TRY_CAST({x} AS DOUBLE) AS BIGINT) AS VARCHAR)"
    return f"CASE WHEN length({s}) >= 10 THEN {s} ELSE lpad({s}, 10, '0') END"


def _sql_ticker(x: str) -> str:
    t = f"regexp_replace(upper(trim({x})), '\\.', '-', 'g')"
    return f"CASE WHEN {t} IN ('NAN', '') THEN NULL ELSE {t} END"


@register("url_keys", f"""
SELECT page_id, TRY_CAST(regexp_extract(url, 'page=(\\d+)', 1) AS BIGINT) AS page_no,
       {_sql_cik("page_id")} AS cik,
       {_sql_ticker("regexp_extract(url, '//([^/]+)', 1)")} AS host_ticker,
       coalesce(nullif(regexp_extract(url, '{K.ACCESSION_DASHED}', 1), ''),
                CASE WHEN nullif(regexp_extract(url, '{K.ACCESSION_DIGITS}', 1), '') IS NOT NULL THEN
                  concat_ws('-', substr(regexp_extract(url, '{K.ACCESSION_DIGITS}', 1), 1, 10),
                            substr(regexp_extract(url, '{K.ACCESSION_DIGITS}', 1), 11, 2),
                            substr(regexp_extract(url, '{K.ACCESSION_DIGITS}', 1), 13, 6)) END) AS accession,
       lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[A-Za-z0-9]+)$', 1)) AS suffix
FROM pages
""")
def q_url_keys(spark, sf_dir):
    p = roles.table(spark, sf_dir, "pages")
    return p.select("page_id", K.number_from_url("url", "page").alias("page_no"),
                    K.normalize_cik(F.col("page_id")).alias("cik"),
                    K.normalize_ticker(F.regexp_extract("url", "//([^/]+)", 1)).alias("host_ticker"),
                    K.accession_from_path("url").alias("accession"),
                    K.suffix(F.regexp_replace("url", "[?#].*$", "")).alias("suffix"))


@register("path_keys", f"""
WITH p AS (SELECT page_id, lpad(CAST(page_id * 7919 % 10000000000 AS VARCHAR), 10, '0') AS a, lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') AS b,
                  lpad(CAST(page_id % 1000000 AS VARCHAR), 6, '0') AS c FROM pages)
SELECT page_id, CASE WHEN page_id % 3 < 2 THEN a || '-' || b || '-' || c END AS accession,
       CASE WHEN page_id % 3 < 2 THEN 'clean/' || {_sql_cik("page_id")} || '/' || a || '-' || b || '-' || c || '.txt' END AS path FROM p
""")
def q_path_keys(spark, sf_dir):
    """Accession numbers of file paths (dashed, as a run of digits, absent), and the path of the cleaned text."""
    digit = lambda x, n: F.lpad(x.cast("string"), n, "0")
    i = F.col("page_id")
    a, b, c = digit(i * 7919 % 10000000000, 10), digit(i % 100, 2), digit(i % 1000000, 6)
    name = F.when(i % 3 == 0, F.concat_ws("-", a, b, c)).when(i % 3 == 1, F.concat(a, b, c)).otherwise(F.lit("index"))
    p = roles.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("edgar/data/"), i.cast("string"), F.lit("/"), name, F.lit(".txt")).alias("raw"))
    p = p.withColumn("accession", K.accession_from_path("raw"))
    return p.select("page_id", "accession", K.text_path("clean", K.normalize_cik(i), F.col("accession")).alias("path"))


def _sql_spells(src: str, name: str, gap: int) -> str:
    return f"""
{name}_g AS (SELECT entity_id, date, CASE WHEN date_diff('day', lag(date) OVER (PARTITION BY entity_id ORDER BY date),
                   date) <= {gap} THEN 0 ELSE 1 END AS nw FROM (SELECT DISTINCT entity_id, date FROM {src})),
{name}_s AS (SELECT *, sum(nw) OVER (PARTITION BY entity_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS spell_no
             FROM {name}_g),
{name}_a AS (SELECT entity_id, spell_no, min(date) AS date_in, max(date) AS date_out FROM {name}_s GROUP BY 1, 2),
{name} AS (SELECT entity_id, CAST(spell_no AS INTEGER) AS spell_no, date_in,
                  CASE WHEN spell_no = max(spell_no) OVER (PARTITION BY entity_id) THEN NULL ELSE date_out END
                  AS date_out FROM {name}_a)"""


SQL_XWALK = f"""
{SQL_DAILY}, {SQL_FUND}, {_sql_spells("daily", "ship", 14)},
tmap AS (SELECT {_sql_ticker("s_name")} AS ticker, {_sql_cik("s_suppkey")} AS cik FROM supplier WHERE s_acctbal >= 0),
uids AS (SELECT {_sql_cik("entity_id")} AS cik, entity_id + 100000 AS permno, date_in, date_out FROM ship),
srows AS (SELECT DISTINCT {_sql_ticker("s.s_name")} AS ticker, f.datekey FROM fund_raw f
          JOIN supplier s ON f.entity_id = s.s_suppkey)"""


@register("crosswalk_resolve", f"""
WITH {SQL_XWALK},
r AS (SELECT r.ticker, r.datekey, m.cik FROM srows r LEFT JOIN tmap m ON r.ticker = m.ticker),
c AS (SELECT r.*, u.permno, r.datekey BETWEEN u.date_in AND coalesce(u.date_out, DATE '2100-01-01') AS inw,
             u.date_in FROM r JOIN uids u ON r.cik = u.cik),
p AS (SELECT *, row_number() OVER (PARTITION BY ticker, datekey ORDER BY inw DESC, date_in, permno) AS rn FROM c),
anyin AS (SELECT ticker, datekey, bool_or(inw) AS in_window FROM c GROUP BY ALL)
SELECT p.ticker, p.datekey, p.cik, p.permno, a.in_window FROM p JOIN anyin a USING (ticker, datekey) WHERE rn = 1
""")
def q_crosswalk_resolve(spark, sf_dir):
    f = roles.fundamentals(spark, sf_dir)
    s = roles.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = (f.join(s, f.entity_id == s.s_suppkey).select(K.normalize_ticker("s_name").alias("ticker"), "datekey")
            .distinct().join(roles.ticker_map(spark, sf_dir), "ticker", "left"))
    out = IV.resolve_by_window(rows, "cik", "datekey", roles.universe_ids(spark, sf_dir), "permno")
    return out.select("ticker", "datekey", "cik", "permno", "in_window")


@register("largest_overlap", f"""
WITH {SQL_DAILY}, {SQL_FUND}, {_sql_spells("daily", "ship", 14)},
od0 AS (SELECT DISTINCT entity_id, datekey AS date FROM fund_raw), {_sql_spells("od0", "ords", 14)},
c AS (SELECT o.entity_id, o.spell_no, s.entity_id * 1000 + s.spell_no AS ship_id,
             date_diff('day', greatest(o.date_in, s.date_in),
                       least(coalesce(o.date_out, DATE '2100-01-01'), coalesce(s.date_out, DATE '2100-01-01'))) AS ov
      FROM ords o JOIN ship s ON o.entity_id = s.entity_id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, spell_no ORDER BY ov DESC, ship_id) AS rn
                     FROM c WHERE ov > 0) WHERE rn = 1)
SELECT o.entity_id, o.spell_no, o.date_in, o.date_out, b.ship_id, CAST(b.ov AS INTEGER) AS overlap_days
FROM ords o LEFT JOIN b ON o.entity_id = b.entity_id AND o.spell_no = b.spell_no
""")
def q_largest_overlap(spark, sf_dir):
    left = T.spells(roles.fundamentals(spark, sf_dir).select("entity_id", F.col("datekey").alias("date")),
                    "entity_id", "date", 14)
    right = roles.ship_spells(spark, sf_dir).select(
        "entity_id", (F.col("entity_id") * 1000 + F.col("spell_no")).alias("ship_id"),
        F.col("date_in").alias("r_in"), F.col("date_out").alias("r_out"))
    out = IV.largest_overlap(left, right, "entity_id", "date_in", "date_out", "r_in", "r_out", "ship_id")
    return out.select("entity_id", "spell_no", "date_in", "date_out", "ship_id", "overlap_days")


@register("universe_tickers", f"""
WITH {SQL_XWALK}
SELECT DISTINCT ticker FROM tmap WHERE cik IN (SELECT cik FROM uids)
""")
def q_universe_tickers(spark, sf_dir):
    return IV.keys_in_universe(roles.ticker_map(spark, sf_dir), roles.universe_ids(spark, sf_dir), "cik", "ticker")


MEMBERSHIP_START, MEMBERSHIP_END = "2024-01-03", "2024-01-28"


def _membership_inputs(spark, sf_dir):
    ch = roles.membership_changes(spark, sf_dir)
    ev = roles.table(spark, sf_dir, "events")
    cur = (ev.filter(F.col("event_type") == "purchase")
           .groupBy(F.format_string("U%d", F.col("user_id")).alias("ticker"))
           .agg(F.max(F.to_date("ts")).alias("last_purchase"))
           .filter(F.col("last_purchase") >= F.lit(MEMBERSHIP_END).cast("date")).select("ticker"))
    return ch, cur


@register("membership_intervals", f"""
WITH ch AS (SELECT printf('U%d', user_id) AS t, CAST(ts AS DATE) AS d, event_id AS q,
                   CASE WHEN event_type = 'signup' THEN 'added' ELSE 'removed' END AS op
            FROM events WHERE event_type IN ('signup', 'error')),
cur AS (SELECT printf('U%d', user_id) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1
        HAVING max(CAST(ts AS DATE)) >= DATE '{MEMBERSHIP_END}'),
u AS (SELECT t, d, q, op, 1 AS k0, CASE WHEN op = 'added' THEN 0 ELSE 1 END AS k3 FROM ch
      UNION ALL SELECT t, NULL, NULL, 'current', 0, 1 FROM cur),
s AS (SELECT *, CASE WHEN op = 'added' THEN -1 ELSE 1 END AS delta,
             sum(CASE WHEN op = 'added' THEN -1 ELSE 1 END) OVER w AS s,
             min(x) OVER wp AS mprev
      FROM (SELECT *, sum(CASE WHEN op = 'added' THEN -1 ELSE 1 END) OVER
                        (PARTITION BY t ORDER BY k0, d DESC, q DESC, k3 ROWS UNBOUNDED PRECEDING) AS x FROM u)
      WINDOW w AS (PARTITION BY t ORDER BY k0, d DESC, q DESC, k3 ROWS UNBOUNDED PRECEDING),
             wp AS (PARTITION BY t ORDER BY k0, d DESC, q DESC, k3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, s - delta - least(0, coalesce(mprev, 0)) AS before FROM s),
kk AS (SELECT *, CASE WHEN op <> 'added' THEN 'push' WHEN before > 0 THEN 'pop' ELSE 'new' END AS kind,
              CASE WHEN op <> 'added' THEN before + 1 WHEN before > 0 THEN before END AS lvl FROM k),
st AS (SELECT *, lead(kind) OVER lw AS nk, lead(d) OVER lw AS nd FROM kk WHERE kind <> 'new'
       WINDOW lw AS (PARTITION BY t, lvl ORDER BY k0, d DESC, q DESC, k3)),
iv AS (SELECT t, CASE WHEN nk = 'pop' THEN nd ELSE DATE '{MEMBERSHIP_START}' END AS date_in, d AS date_out
       FROM st WHERE kind = 'push'
       UNION ALL SELECT t, d, NULL FROM kk WHERE kind = 'new'),
c1 AS (SELECT t, greatest(date_in, DATE '{MEMBERSHIP_START}') AS date_in,
              CASE WHEN date_out > DATE '{MEMBERSHIP_END}' THEN NULL ELSE date_out END AS date_out
       FROM iv WHERE date_in <= DATE '{MEMBERSHIP_END}' AND (date_out IS NULL OR date_out >= DATE '{MEMBERSHIP_START}'))
SELECT t AS ticker, date_in, date_out FROM c1 WHERE date_out IS NULL OR date_in <= date_out
""")
def q_membership_intervals(spark, sf_dir):
    ch, cur = _membership_inputs(spark, sf_dir)
    return IV.reconstruct_membership(ch, cur, MEMBERSHIP_START, MEMBERSHIP_END)


# --------------------------------------------------------------------------- #
# sources and resume: A5, A12, B4, B5
# --------------------------------------------------------------------------- #


@register("page_cells")
def q_page_cells(spark, sf_dir):
    return SF.html_cells(roles.table(spark, sf_dir, "pages"), "page_id")


@register("sample_documents", f"""
SELECT doc_id, lang, n_chars FROM documents ORDER BY {_sql_md5_number("doc_id", 0)}, doc_id LIMIT 25
""")
def q_sample_documents(spark, sf_dir):
    d = roles.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return repeatable_sample(d, "doc_id", 25)


@register("unlabelled_documents", """
SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def q_unlabelled_documents(spark, sf_dir):
    d = roles.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return SK.todo(d, roles.table(spark, sf_dir, "labels"), "doc_id")


@register("labelled_long_documents", """
SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS n_chars FROM documents d
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND length(text) >= 500
""")
def q_labelled_long_documents(spark, sf_dir):
    d = roles.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    x = SK.long_enough(SK.done_only(d, roles.table(spark, sf_dir, "labels"), "doc_id"), "text")
    return x.select("doc_id", "lang", F.length("text").alias("n_chars"))


# --------------------------------------------------------------------------- #
# scoring and reduction: I1-I8, J5, G15-G19, K4 (iterative fits: rows-only checks)
# --------------------------------------------------------------------------- #

GBT_PARAMS = dict(max_iter=20, max_depth=4, step_size=0.1)
# The reference's fit of a walk: trees of 64 leaves until 50 in a row bring nothing on the validation rows, 2,000 at most.
GBT_WHOLE = dict(max_iter=2000, max_depth=6, step_size=0.05, patience=50)
# Such a fit is a long chain of small jobs; so many run side by side (each takes memory of the driver).
FITS_AT_ONCE = 2


def _walk_frame(spark, sf_dir):
    tp = panel.training_panel(spark, sf_dir)
    fr = SC.assemble_walk_features(tp, None, "entity_id", "date", "fwd_ret_5d", BT.N_BUCKETS)
    return T.assign_walks(fr, T.walk_schedule_of(tp, "date", TRAIN_START, FIRST_TRAIN_END), "date")


@register("walk_summary")
def q_walk_summary(spark, sf_dir):
    fr = _walk_frame(spark, sf_dir)
    feats = SC.feature_columns(fr)
    arms = SC.walk_summary(fr, feats, "entity_id", "date", BT.TOP_K, "all", **GBT_PARAMS)
    no_text = SC.drop_text_columns(fr)
    arm2 = SC.walk_summary(no_text, SC.feature_columns(no_text), "entity_id", "date", BT.TOP_K, "no_text",
                           **GBT_PARAMS)
    return arms.unionByName(arm2)


@register("walk_frame_sizes", f"""
WITH {SQL_TRAINING},
wk AS (SELECT unnest(range(1, (SELECT CAST(max(year(date)) AS BIGINT) - 1996 FROM training))) AS n),
x AS (SELECT n, year(date) AS y FROM training JOIN wk ON year(date) <= 1997 + n
      WHERE isodow(date) = 5 AND fwd_ret_5d IS NOT NULL)
SELECT CAST(n AS INTEGER) AS walk_id,
       CASE WHEN y <= 1995 + n THEN 'train' WHEN y = 1996 + n THEN 'val' ELSE 'test' END AS split, count(*) AS n_rows
FROM x GROUP BY ALL
""")
def q_walk_frame_sizes(spark, sf_dir):
    """The rows that every walk trains, validates and tests on."""
    return _walk_frame(spark, sf_dir).groupBy("walk_id", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("walk_summary_text")
def q_walk_summary_text(spark, sf_dir):
    """D8/I1/I7/I8 with reduced text: each walk's directions come from its own training window (the width
    is locked at walk 1); the arm with all features against the one without text."""
    tp = materialize(panel.training_panel(spark, sf_dir), "training_panel")
    mat = _pca_matrix(spark, sf_dir)
    walks = T.walk_schedule_of(tp, "date", TRAIN_START, FIRST_TRAIN_END)
    width, arms, out = None, [], None
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        for w, (n, mean, cov) in _pca_walk_grams(spark, sf_dir, mat):
            if n < 2:
                continue
            width = V.width_for(V.explained_shares(cov), 0.95) if width is None else width
            reduced = V.project_on(mat, mean, V.components_of(cov, width), "vec", ["entity_id", "date"])
            fr = SC.assemble_walk_features(tp, reduced, "entity_id", "date", "fwd_ret_5d", BT.N_BUCKETS)
            fr = materialize(T.assign_walks(fr, walks.filter(F.col("walk_id") == w.walk_id), "date"), "text_frame")
            for arm, f in (("all", fr), ("no_text", SC.drop_text_columns(fr))):
                arms.append(pool.submit(SC.walk_summary, f, SC.feature_columns(f), "entity_id", "date", BT.TOP_K, arm, **GBT_WHOLE))
        for a in arms:
            out = a.result() if out is None else out.unionByName(a.result())
    return out


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    fr = _walk_frame(spark, sf_dir).filter(F.col("walk_id") == 1)
    feats = SC.feature_columns(fr)
    return SC.feature_importance(SC.fit_walk(fr, feats, **GBT_PARAMS), feats, spark)


# A short search and few trees: the query shows the whole path on the driver's tables.
RANK_FIT = dict(n_estimators=3, max_depth=2, max_bins=31, early_stopping_rounds=2)
RANK_SEARCH = (Dim("num_leaves", 3, 8, "int"), Dim("learning_rate", 0.05, 0.3, "log"), Dim("min_data_in_leaf", 5, 40, "int"),
               Dim("feature_fraction", 0.6, 1.0), Dim("bagging_fraction", 0.6, 1.0), Dim("lambda_l2", 0.0, 5.0))


def _rank_search(fr, feats, n_trials):
    """The trials on walk 1."""
    path = f"{checkpoint_dir(fr.sparkSession).rstrip('/')}/trials-{uuid.uuid4().hex[:12]}"
    return SC.search_rank_params(fr.filter(F.col("walk_id") == 1), feats, "entity_id", "date", "target", path, n_trials=n_trials,
                                 space=RANK_SEARCH, n_random=2, k=BT.TOP_K, **RANK_FIT)


@register("param_search")
def q_param_search(spark, sf_dir):
    """The trial table of the search on walk 1."""
    fr = _walk_frame(spark, sf_dir)
    trials = _rank_search(fr, SC.feature_columns(fr), 5)
    won = json.dumps(best_params(trials), sort_keys=True)
    return trial_table(spark, trials).withColumn("winner", F.col("params") == won)


@register("rank_walk_summary")
def q_rank_walk_summary(spark, sf_dir):
    """One search on walk 1, its winner frozen, and the listwise ranker on every walk."""
    fr = materialize(_walk_frame(spark, sf_dir), "walk_frame")
    feats = SC.feature_columns(fr)
    params = {**RANK_FIT, **best_params(_rank_search(fr, feats, 3))}
    store = f"{checkpoint_dir(spark).rstrip('/')}/walks-{uuid.uuid4().hex[:12]}"
    run = SC.rank_walks(fr, feats, "entity_id", "date", store, params, k=BT.TOP_K)
    return SC.numbers_as_columns(run.results, BT.TOP_K).withColumn("params", F.lit(json.dumps(params, sort_keys=True)))


@register("rank_gradients", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_LAB},
o AS (SELECT date, entity_id, label, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity_id) AS r,
             row_number() OVER (PARTITION BY date ORDER BY label DESC, entity_id) AS rl FROM lab),
d AS (SELECT *, CASE WHEN r <= {BT.TOP_K} THEN 1 / log2(r + 1.0) ELSE 0 END AS disc, pow(2.0, label) - 1 AS gain,
             sum(CASE WHEN rl <= {BT.TOP_K} THEN (pow(2.0, label) - 1) / log2(rl + 1.0) END) OVER (PARTITION BY date) AS ideal FROM o),
p AS (SELECT a.date, a.entity_id, CASE WHEN a.ideal > 0 THEN abs(a.gain - b.gain) * abs(a.disc - b.disc) / a.ideal ELSE 0 END AS w,
             sign(a.label - b.label) AS side, 1 / (1 + exp(sign(a.label - b.label) * (a.score - b.score))) AS rho
      FROM d a JOIN d b ON a.date = b.date AND a.entity_id <> b.entity_id AND a.label <> b.label),
g AS (SELECT date, entity_id, sum(-side * rho * w) AS grad, sum(rho * (1 - rho) * w) AS hess FROM p GROUP BY date, entity_id)
SELECT d.date, d.entity_id, round(coalesce(grad, 0), 6) + 0.0 AS grad, round(coalesce(hess, 0), 6) + 0.0 AS hess
FROM d LEFT JOIN g USING (date, entity_id)
""")
def q_rank_gradients(spark, sf_dir):
    """The listwise objective's derivatives at the scores of the Friday panel."""
    g = pair_gradients(_labelled(spark, sf_dir), "date", "entity_id", "label", "score", BT.TOP_K)
    return round_doubles(g.select(F.col("g").alias("date"), F.col("e").alias("entity_id"), "grad", "hess"))


def _pca_matrix(spark, sf_dir):
    """The stock-day vectors of member days, written once for every pass that follows."""
    grid, docs, bridge = _stockday_inputs(spark, sf_dir)
    mat = V.stockday_vectors(grid, docs, bridge, "entity_id", "date", "cik", "doc_id", "filing_date", "vec")
    mat = T.membership_filter(mat, roles.membership_windows(spark, sf_dir), "entity_id", "date")
    return materialize(mat.withColumn("year", F.year("date")), "pca_matrix")


def _pca_walk_grams(spark, sf_dir, mat=None):
    """(walk row, Gram sums of its training years) per walk of the H13 schedule."""
    mat = _pca_matrix(spark, sf_dir) if mat is None else mat
    by_year = {r.key: r for r in V.gram_by(mat, "year", "vec").collect()}  # one row per year
    walks = T.walk_schedule_of(mat, "date", TRAIN_START, FIRST_TRAIN_END).orderBy("walk_id").collect()
    return [(w, V.add_grams([g for y, g in by_year.items() if y <= w.train_end.year])) for w in walks]


# Fixed values of the reduction gates (B9): rows per fit and width.
PCA_MIN_ROWS, PCA_MAX_WIDTH = 100_000, 100


@register("pca_walks")
def q_pca_walks(spark, sf_dir):
    """An expanding training window per walk; the width is locked at walk 1 (95% explained
    variance, +1); drift vs walk 1; the row and width gates as columns."""
    rows, locked, base = [], None, None
    for w, (n, _, cov) in _pca_walk_grams(spark, sf_dir):
        if n < 2:
            continue
        share = V.explained_shares(cov)
        locked = V.width_for(share, 0.95) if locked is None else locked
        captured = float(share[:locked].sum())
        base = captured if base is None else base
        rows.append((w.walk_id, n, locked, captured, captured - base, n >= PCA_MIN_ROWS, locked < PCA_MAX_WIDTH))
    return spark.createDataFrame(rows, "walk_id int, n_train long, n_components int, var_captured double, "
                                       "drift_vs_walk1 double, enough_rows boolean, narrow boolean")


@register("pca_walk_variance", f"""
WITH {SQL_DAILY}, {SQL_FUND}, {SQL_FILINGS}, {SQL_WINDOWS}, {SQL_STOCKDAY},
m AS (SELECT * FROM sv WHERE EXISTS (SELECT 1 FROM windows w WHERE w.entity_id = sv.entity_id
      AND sv.date BETWEEN w.date_in AND coalesce(w.date_out, DATE '2100-01-01'))),
wk AS (SELECT unnest(range(1, (SELECT CAST(max(year(date)) AS BIGINT) - 1996 FROM m))) AS n),
x AS (SELECT wk.n, m.entity_id, m.date, unnest(vec) AS x, generate_subscripts(vec, 1) AS i
      FROM m JOIN wk ON year(m.date) <= 1995 + wk.n),
pv AS (SELECT n, i, var_samp(CAST(x AS FLOAT)) AS v, count(*) AS c FROM x GROUP BY n, i)
SELECT CAST(n AS INTEGER) AS walk_id, max(c) AS n_train, round(sum(v), 4) + 0.0 AS total_variance FROM pv GROUP BY n
""")
def q_pca_walk_variance(spark, sf_dir):
    """G15/G16 as numbers that SQL can state: training rows and total variance (trace) of every walk."""
    rows = [(w.walk_id, n, round(float(cov.trace()), 4) + 0.0) for w, (n, _, cov) in _pca_walk_grams(spark, sf_dir) if n > 1]
    return spark.createDataFrame(rows, "walk_id int, n_train long, total_variance double")


@register("pca_projection")
def q_pca_projection(spark, sf_dir):
    mat = _pca_matrix(spark, sf_dir)
    sc, model = V.fit_pca(mat, "vec", 8)
    return V.project(mat, sc, model, "vec", ["entity_id", "date"])


@register("minvar_optimality", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_BOARD}
SELECT date, count(*) AS n_names, true AS feasible, true AS optimal FROM board
WHERE date > (SELECT date FROM (SELECT DISTINCT date FROM fri) ORDER BY date LIMIT 1 OFFSET 25)
GROUP BY date HAVING count(*) * {BT.MAX_WEIGHT} >= 1
""")
def q_minvar_optimality(spark, sf_dir):
    """K4 stated as feasibility and optimality on every date with a full history."""
    fri = materialize(BT.friday_panel(spark, sf_dir), "friday_panel")
    board = materialize(BT.scoreboard(fri), "board")
    w = P.min_variance_weights(board, fri, [], "date", "entity_id", "fwd_ret_5d", cap=BT.MAX_WEIGHT)
    th = P.trailing_history(board.select("date", "entity_id"), fri, "date", "entity_id", "fwd_ret_5d")
    out = P.min_variance_check(w, P.covariance_long(th, "date", "entity_id", "fwd_ret_5d"), "date", "entity_id", BT.MAX_WEIGHT)
    full = th.groupBy("date").agg(F.max("lag_no").alias("_l")).filter("_l = 26").select("date")
    return out.join(full, "date").filter(F.col("n_names") * BT.MAX_WEIGHT >= 1)


@register("minvar_weights")
def q_minvar_weights(spark, sf_dir):
    fri = BT.friday_panel(spark, sf_dir)
    board = BT.scoreboard(fri)
    return P.min_variance_weights(board, fri, [], "date", "entity_id", "fwd_ret_5d", cap=BT.MAX_WEIGHT)


# --------------------------------------------------------------------------- #
# portfolio analytics continued: D15, E13, K10, K11, K13-K16, E11
# --------------------------------------------------------------------------- #
LOOKBACK = 26


@register("trailing_covariance", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_BOARD},
hd AS (SELECT DISTINCT date FROM fri),
hn AS (SELECT date, row_number() OVER (ORDER BY date) AS hn FROM hd),
flags AS (SELECT date, max(h) AS h FROM (SELECT date, 0 AS h FROM board UNION ALL SELECT date, 1 FROM hd) GROUP BY date),
bef AS (SELECT date, coalesce(sum(h) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hb
        FROM flags),
sp0 AS (SELECT b.date, b.entity_id, be.hb, unnest(range(1, {LOOKBACK + 1})) AS lag_no FROM board b
        JOIN bef be ON b.date = be.date),
sp AS (SELECT *, hb - lag_no + 1 AS hn FROM sp0 WHERE hb - lag_no + 1 >= 1),
tr AS (SELECT s.date, s.entity_id, s.lag_no, coalesce(f.fwd_ret_5d, 0.0) AS x FROM sp s JOIN hn ON s.hn = hn.hn
       LEFT JOIN fri f ON f.entity_id = s.entity_id AND f.date = hn.date),
c AS (SELECT a.date, a.entity_id AS i, b.entity_id AS j, covar_samp(a.x, b.x) AS cov FROM tr a JOIN tr b
      ON a.date = b.date AND a.lag_no = b.lag_no GROUP BY a.date, a.entity_id, b.entity_id)
SELECT date, i, j, round(cov + CASE WHEN i = j THEN 1e-6 ELSE 0.0 END, 6) + 0.0 AS cov FROM c
""")
def q_trailing_covariance(spark, sf_dir):
    fri = BT.friday_panel(spark, sf_dir)
    board = BT.scoreboard(fri).select("date", "entity_id")
    th = P.trailing_history(board, fri, "date", "entity_id", "fwd_ret_5d", LOOKBACK)
    return round_doubles(P.covariance_long(th, "date", "entity_id", "fwd_ret_5d"))


def _sql_roll(v: str, c: str = "cost", w: int = 16) -> str:
    frame = f"OVER (ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN count({v}) {frame} >= 2 THEN avg({v}) {frame} / (stddev_pop({v}) {frame} + 1e-6) - {c} "
            f"ELSE {v} - {c} END")


@register("reward_series", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_RETURNS},
p AS (SELECT date, max(CASE WHEN strategy = 'TILT' THEN return_gross END) AS port,
             max(CASE WHEN strategy = 'EW' THEN return_gross END) AS base,
             max(CASE WHEN strategy = 'SP' THEN return_gross END) AS spr,
             max(CASE WHEN strategy = 'TILT' THEN turnover END) * {BT.COST_BPS / 1e4} AS cost FROM rets GROUP BY date),
q AS (SELECT *, port - base AS excess_return, port - spr AS active_return FROM p)
SELECT date, round(excess_return, 6) + 0.0 AS excess_return, round(excess_return - cost, 6) + 0.0 AS reward_excess,
  round(port - cost, 6) + 0.0 AS reward_return_only,
  round(excess_return - 5.0 * greatest(0.0, -port) - cost, 6) + 0.0 AS reward_downside,
  round({_sql_roll("excess_return")}, 6) + 0.0 AS reward_sharpe,
  round({_sql_roll("port")}, 6) + 0.0 AS reward_sharpe_total,
  round({_sql_roll("active_return")}, 6) + 0.0 AS reward_ir_vs_baseline
FROM q
""")
def q_reward_series(spark, sf_dir):
    r = BT.weekly_returns(BT.strategy_weights(BT.scoreboard(BT.friday_panel(spark, sf_dir)), loosen_cap=True))
    p = r.groupBy("date").agg(
        F.max(F.when(F.col("strategy") == "TILT", F.col("return_gross"))).alias("port"),
        F.max(F.when(F.col("strategy") == "EW", F.col("return_gross"))).alias("base"),
        F.max(F.when(F.col("strategy") == "SP", F.col("return_gross"))).alias("spr"),
        (F.max(F.when(F.col("strategy") == "TILT", F.col("turnover"))) * (BT.COST_BPS / 1e4)).alias("cost"))
    out = M.reward_columns(p.withColumn("series", F.lit("TILT")), "series", "date", "port", "base", "spr", "cost")
    return round_doubles(out.select("date", "excess_return", "reward_excess", "reward_return_only", "reward_downside",
                                    "reward_sharpe", "reward_sharpe_total", "reward_ir_vs_baseline"))


@register("observation_table", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_RETURNS},
z AS (SELECT date, entity_id, CAST(slot AS INTEGER) AS slot,
        {", ".join(f"coalesce(({c} - avg({c}) OVER d) / (stddev_pop({c}) OVER d + 1e-8), 0.0) AS {c}_z"
                   for c in ("score", "ret", "vol"))}
      FROM board WINDOW d AS (PARTITION BY date)),
l AS (SELECT date, {", ".join(f"coalesce(lag(return_gross, {k}) OVER (ORDER BY date), 0.0) AS ret_lag_{k}"
                               for k in range(1, 5))} FROM rets WHERE strategy = 'SP')
SELECT z.date, z.entity_id, z.slot, {", ".join(f"round({c}_z, 6) + 0.0 AS {c}_z" for c in ("score", "ret", "vol"))},
       {", ".join(f"round(l.ret_lag_{k}, 6) + 0.0 AS ret_lag_{k}" for k in range(1, 5))}
FROM z JOIN l ON z.date = l.date
""")
def q_observation_table(spark, sf_dir):
    board = BT.scoreboard(BT.friday_panel(spark, sf_dir))
    z = X.zscore(board, "date", ["score", "ret", "vol"], suffix="_z").select(
        "date", "entity_id", "slot", "score_z", "ret_z", "vol_z")
    r = BT.weekly_returns(BT.strategy_weights(board, loosen_cap=True)).filter(F.col("strategy") == "SP")
    lags = M.lagged_returns(r, "strategy", "date", "return_gross", 4).select("date", *[f"ret_lag_{k}" for k in range(1, 5)])
    return round_doubles(z.join(lags, "date"))


SQL_WALK_RETURNS = f"""
{SQL_WEIGHTS},
wk AS (SELECT CAST(n AS INTEGER) AS walk_id, make_date(CAST(1997 + n AS INTEGER), 1, 1) AS t0,
              make_date(CAST(1997 + n AS INTEGER), 12, 31) AS t1
       FROM (SELECT unnest(range(1, (SELECT CAST(max(year(date)) AS BIGINT) - 1996 FROM weights))) AS n)),
ww AS (SELECT w.*, k.walk_id FROM weights w JOIN wk k ON w.date BETWEEN k.t0 AND k.t1),
wtv0 AS (SELECT walk_id, strategy, date, abs(w - coalesce(lag(w) OVER (PARTITION BY strategy, walk_id, slot ORDER BY date),
                                                      1.0 / count(*) OVER (PARTITION BY strategy, walk_id, date))) AS d
         FROM ww),
wtv AS (SELECT walk_id, strategy, date, sum(d) AS turnover FROM wtv0 GROUP BY ALL),
wgr AS (SELECT walk_id, strategy, date, sum(w * coalesce(fwd_ret_5d, 0.0)) AS return_gross FROM ww GROUP BY ALL),
wret AS (SELECT g.*, t.turnover, g.return_gross - {BT.COST_BPS / 1e4} * t.turnover AS return_net
         FROM wgr g JOIN wtv t USING (walk_id, strategy, date))"""


def _walk_returns(spark, sf_dir):
    w = materialize(BT.strategy_weights(BT.scoreboard(BT.friday_panel(spark, sf_dir)), loosen_cap=True), "weights")
    walks = T.walk_schedule_of(w, "date", TRAIN_START, FIRST_TRAIN_END)
    lab = T.assign_walks(w, walks, "date").filter(F.col("split") == "test").drop("split")
    return BT.weekly_returns(lab, series_by=("strategy", "walk_id"), with_sixty_forty=False)


@register("walk_returns", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_WALK_RETURNS}
SELECT walk_id, strategy, date, round(return_gross, 6) + 0.0 AS return_gross, round(turnover, 6) + 0.0 AS turnover,
       round(return_net, 6) + 0.0 AS return_net FROM wret
""")
def q_walk_returns(spark, sf_dir):
    r = _walk_returns(spark, sf_dir)
    return round_doubles(r.select("walk_id", "strategy", "date", "return_gross", "turnover", "return_net"))


@register("walk_annualised", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_WALK_RETURNS}
SELECT walk_id, strategy, round(pow(1 + avg(return_net), 52.0) - 1, 6) + 0.0 AS annualized_from_mean
FROM wret GROUP BY walk_id, strategy
""")
def q_walk_annualised(spark, sf_dir):
    return round_doubles(M.mean_annualised(_walk_returns(spark, sf_dir), ["walk_id", "strategy"]))


_SQL_METRICS_BODY = ORACLE["strategy_metrics"].split("WITH ", 1)[1]


@register("strategy_comparison", f"""
WITH m AS (WITH {_SQL_METRICS_BODY})
SELECT strategy, sharpe, max(CASE WHEN strategy = 'EW' THEN sharpe END) OVER () AS base_sharpe,
       round(sharpe - max(CASE WHEN strategy = 'EW' THEN sharpe END) OVER (), 6) + 0.0 AS diff_sharpe,
       sharpe - max(CASE WHEN strategy = 'EW' THEN sharpe END) OVER () > 0 AS win
FROM m
""")
def q_strategy_comparison(spark, sf_dir):
    m = round_doubles(BT.build_summary(spark, sf_dir))
    c = M.compare_to_base(m, "strategy", "EW", ["sharpe"])
    return round_doubles(c.select("strategy", "sharpe", "base_sharpe", "diff_sharpe", "win"))


@register("strategy_leaderboard", f"""
WITH m AS (WITH {_SQL_METRICS_BODY})
SELECT strategy, sharpe, CAST(row_number() OVER (ORDER BY sharpe DESC NULLS LAST) AS INTEGER) AS rank FROM m
""")
def q_strategy_leaderboard(spark, sf_dir):
    m = round_doubles(BT.build_summary(spark, sf_dir))
    return M.leaderboard(m, "sharpe").select("strategy", "sharpe", "rank")


_ZI_COLS = ["prc", "vol", *[T.series_column(s) for s in MACRO_SERIES], "days_since_filing", "doc_count_7d"]


@register("zero_info_report", f"""
WITH {SQL_TRAINING}
{" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_values, "
                    f"round(CAST(min({c}) AS DOUBLE), 6) + 0.0 AS min_value, round(CAST(max({c}) AS DOUBLE), 6) + 0.0 AS max_value, "
                    f"count({c}) = 0 OR min({c}) = max({c}) AS zero_info FROM training" for c in _ZI_COLS)}
""")
def q_zero_info_report(spark, sf_dir):
    t = panel.training_panel(spark, sf_dir)
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n_values"),
                               F.min(c).cast("double").alias("min_value"), F.max(c).cast("double").alias("max_value"))
                      for c in _ZI_COLS])
    rows = t.agg(parts.alias("r")).select(F.explode("r").alias("r")).select("r.*")
    rows = rows.withColumn("zero_info", (F.col("n_values") == 0) | (F.col("min_value") == F.col("max_value")))
    return round_doubles(rows)


# --------------------------------------------------------------------------- #
# streaming: L1-L3 (each runs a stream to completion, then reads its sink)
# --------------------------------------------------------------------------- #


def _stream_of(spark, sf_dir, name):
    """The table as a stream, be it one file or a folder of files: a stream takes a pattern for either."""
    base = sf_dir.rstrip("/")
    return ST.file_stream(spark, f"{base}/{name}[.]parquet", spark.read.parquet(f"{base}/{name}.parquet").schema)


def _split_stream(spark, df, name, batches=4):
    """The rows as a stream of about ``batches`` batches; the files are as many as the shuffle has partitions, two at least."""
    src = materialize(df.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))), f"{name}_files")
    files = src.inputFiles()
    return ST.file_stream(spark, files[0].rsplit("/", 1)[0], src.schema, max_files=max(1, len(files) // batches))


@register("stream_clean_pages", f"""
SELECT page_id, clean_text, n_chars FROM ({ORACLE["clean_pages"]})
""")
def q_stream_clean_pages(spark, sf_dir):
    sink, ckpt = ST.stream_paths(spark, "clean_pages")
    ST.run_available(ST.clean_new_documents(_stream_of(spark, sf_dir, "pages"), "page_id", "html"), sink, ckpt)
    return spark.read.parquet(sink).select("page_id", "clean_text", F.col("n_chars").cast("int").alias("n_chars"))


@register("stream_dedup_orders", """
SELECT DISTINCT l_orderkey AS order_key FROM lineitem
""")
def q_stream_dedup_orders(spark, sf_dir):
    sink, ckpt = ST.stream_paths(spark, "dedup_orders")
    s = _split_stream(spark, roles.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate"), "lineitem")
    ST.run_dedupe(s, "l_orderkey", sink, ckpt)
    return ST.read_log(spark, sink).select(F.col("l_orderkey").alias("order_key"))


@register("stream_doc_count", f"""
WITH {SQL_FUND}, {SQL_FILINGS},
days AS (SELECT cik, filing_date + CAST(unnest(range(0, 8)) AS INTEGER) AS date FROM filings)
SELECT cik, date, count(*) AS n FROM days GROUP BY cik, date
""")
def q_stream_doc_count(spark, sf_dir):
    sink, ckpt = ST.stream_paths(spark, "doc_count")
    orders = _split_stream(spark, roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "orders")
    # written once: every batch joins these two columns, not the whole table
    li = materialize(roles.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", K.normalize_cik(F.col("l_suppkey")).alias("cik")), "stream_side")
    ev = orders.join(li, orders.o_orderkey == li.l_orderkey).select("cik", "o_orderdate")
    ST.run_daily_counts(ev, "cik", "o_orderdate", sink, ckpt)
    return ST.trailing_counts(spark, sink, "cik", 7).select("cik", "date", "n")


# --------------------------------------------------------------------------- #
# gates and audits: B6, B7, B9, B11, E2, F8
# --------------------------------------------------------------------------- #
@register("leakage_gate", f"""
WITH {SQL_DAILY}, {SQL_FUND},
p AS (SELECT d.date, f.datekey FROM daily d ASOF LEFT JOIN fund f ON d.entity_id = f.entity_id AND d.date >= f.datekey)
SELECT 'all' AS scope, 'LEAKAGE' AS rule, CAST(count(*) FILTER (WHERE datekey > date) AS DOUBLE) AS value,
       CAST(0.0 AS DOUBLE) AS "limit", count(*) FILTER (WHERE datekey > date) <= 0 AS ok FROM p
""")
def q_leakage_gate(spark, sf_dir):
    j = panel.pit_panel(roles.daily_bars(spark, sf_dir), roles.fundamentals(spark, sf_dir))
    return G.leakage_table(j, "datekey", "date")


@register("match_rate_gate", f"""
WITH {SQL_XWALK},
r AS (SELECT r.ticker, r.datekey, m.cik FROM srows r LEFT JOIN tmap m ON r.ticker = m.ticker),
x AS (SELECT r.*, EXISTS (SELECT 1 FROM uids u WHERE u.cik = r.cik) AS resolved FROM r)
SELECT 'all' AS scope, 'MATCH_RATE' AS rule, round(avg(CASE WHEN resolved THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS value,
       CAST(0.95 AS DOUBLE) AS "limit", avg(CASE WHEN resolved THEN 1.0 ELSE 0.0 END) >= 0.95 AS ok FROM x
""")
def q_match_rate_gate(spark, sf_dir):
    f = roles.fundamentals(spark, sf_dir)
    s = roles.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = (f.join(s, f.entity_id == s.s_suppkey).select(K.normalize_ticker("s_name").alias("ticker"), "datekey")
            .distinct().join(roles.ticker_map(spark, sf_dir), "ticker", "left"))
    res = IV.resolve_by_window(rows, "cik", "datekey", roles.universe_ids(spark, sf_dir), "permno",
                               drop_unresolved=False)
    return round_doubles(G.match_rate_table(res, "permno", 0.95))


@register("min_rows_gate", f"""
WITH {SQL_TRAINING}
SELECT CAST(year AS VARCHAR) AS scope, 'MIN_ROWS' AS rule, CAST(count(*) AS DOUBLE) AS value,
       CAST(1000.0 AS DOUBLE) AS "limit",
       count(*) >= 1000 AS ok FROM training GROUP BY year
""")
def q_min_rows_gate(spark, sf_dir):
    return G.min_count_table(panel.training_panel(spark, sf_dir), 1000, by="year")


@register("coverage_audit", f"""
WITH {SQL_XWALK}
SELECT count(*) AS n_tickers,
       count(*) FILTER (WHERE cik IN (SELECT cik FROM uids)) AS n_in_universe,
       round(avg(CASE WHEN cik IN (SELECT cik FROM uids) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_in_universe,
       (SELECT min(date_in) FROM uids) AS first_date, (SELECT max(date_in) FROM uids) AS last_date
FROM tmap
""")
def q_coverage_audit(spark, sf_dir):
    tm = roles.ticker_map(spark, sf_dir)
    u = roles.universe_ids(spark, sf_dir)
    flag = tm.join(u.select("cik").distinct().withColumn("_in", F.lit(True)), "cik", "left")
    # one pass over both tables (a union), no join of one-row aggregates
    t = flag.select(F.lit(1).alias("_t"), F.col("_in").isNotNull().alias("_hit"), F.lit(None).cast("date").alias("d"))
    v = u.select(F.lit(0).alias("_t"), F.lit(None).cast("boolean").alias("_hit"), F.col("date_in").alias("d"))
    a = t.unionByName(v).agg(
        F.count_if(F.col("_t") == 1).alias("n_tickers"), F.count_if(F.col("_hit")).alias("n_in_universe"),
        F.avg(F.when(F.col("_t") == 1, F.col("_hit").cast("double"))).alias("share_in_universe"),
        F.min("d").alias("first_date"), F.max("d").alias("last_date"))
    return round_doubles(a)


@register("filings_per_year", f"""
WITH {SQL_FUND}, {SQL_FILINGS}
SELECT CAST(year(filing_date) AS INTEGER) AS year, form_type, count(*) AS n FROM filings GROUP BY ALL
""")
def q_filings_per_year(spark, sf_dir):
    f = roles.filings(spark, sf_dir)
    return f.groupBy(F.year("filing_date").alias("year"), "form_type").agg(F.count(F.lit(1)).alias("n"))


@register("scoreboard_extension", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_BOARD},
present AS (SELECT DISTINCT date FROM board WHERE year(date) < 2000),
wanted AS (SELECT DISTINCT date FROM fri WHERE year(date) >= 1999),
todo AS (SELECT date FROM wanted EXCEPT SELECT date FROM present)
SELECT b.entity_id, b.date, CAST(b.slot AS INTEGER) AS slot FROM board b WHERE b.date IN (SELECT date FROM todo)
""")
def q_scoreboard_extension(spark, sf_dir):
    """F8: score only the dates still missing from a stored scoreboard (here:
    the board before 2000 is 'present'; Fridays from 1999 on are 'wanted')."""
    fri = BT.friday_panel(spark, sf_dir)
    present = BT.scoreboard(fri.filter(F.year("date") < 2000)).select("date").distinct()
    wanted = fri.filter(F.year("date") >= 1999).select("date").distinct()
    todo_dates = SK.missing_partitions(wanted, present, "date")
    new = BT.scoreboard(fri.join(todo_dates, "date", "left_semi"))
    return new.select("entity_id", "date", "slot")


@register("scoreboard_log", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_BOARD}
SELECT entity_id, date, CAST(slot AS INTEGER) AS slot, CASE WHEN year(date) < 2000 THEN 'first' ELSE 'second' END AS run_id FROM board
""")
def q_scoreboard_log(spark, sf_dir):
    """A stored scoreboard, extended by the dates it lacks; every run is sent twice and counts once."""
    fri = materialize(BT.friday_panel(spark, sf_dir), "friday_panel")
    path = f"{checkpoint_dir(spark).rstrip('/')}/scoreboard-{uuid.uuid4().hex[:12]}"
    for run_id, dates in (("first", F.year("date") < 2000), ("second", F.year("date") >= 1999)) * 2:
        SK.extend_log(path, run_id, BT.scoreboard(fri.filter(dates)).select("entity_id", "date", "slot"), "date")
    return SK.read_runs(spark, path)


@register("strategy_menu")
def q_strategy_menu(spark, sf_dir):
    """EW, SP, TILT, 60/40 and minimum-variance on one scoreboard (written
    once: it feeds every strategy branch and the min-variance history)."""
    fri = materialize(BT.friday_panel(spark, sf_dir), "friday_panel")
    board = BT.scoreboard(fri)
    w = BT.strategy_weights(board, loosen_cap=True)
    mv = P.min_variance_weights(board, fri, [], "date", "entity_id", "fwd_ret_5d", cap=BT.MAX_WEIGHT)
    mv = mv.join(board.select("date", "entity_id", "slot", "fwd_ret_5d"), ["date", "entity_id"]).select(
        F.lit("MINVAR").alias("strategy"), "date", "entity_id", "slot", "w", "fwd_ret_5d")
    r = BT.weekly_returns(w.unionByName(mv))
    return M.rollup_vs_first(M.strategy_metrics(r, "strategy", "date"), "strategy", ["sharpe"])


@register("delisting_panel", f"""
WITH {SQL_DAILY},
dl AS (SELECT entity_id, max(date) AS date, -0.3 AS dlret, CAST(500 + entity_id % 5 AS INTEGER) AS dlstcd
       FROM daily GROUP BY entity_id)
SELECT d.entity_id, d.date, round(d.ret, 6) + 0.0 AS ret, CAST(dl.dlret AS DOUBLE) AS dlret, dl.dlstcd
FROM daily d LEFT JOIN dl USING (entity_id, date)
""")
def q_delisting_panel(spark, sf_dir):
    """Delisting returns on the matching row of the daily table (here: every entity's last day)."""
    daily = materialize(roles.daily_bars(spark, sf_dir).select("entity_id", "date", "ret"), "daily")
    dl = daily.groupBy("entity_id").agg(F.max("date").alias("date")).select(
        "entity_id", "date", F.lit(-0.3).alias("dlret"), (500 + F.col("entity_id") % 5).cast("int").alias("dlstcd"))
    return round_doubles(T.attach_on_day(daily, dl, "entity_id", "date", {"dlret": "double", "dlstcd": "int"}))


@register("common_years", f"""
WITH {SQL_DAILY}
SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM daily WHERE year(date) >= 1996
  AND year(date) IN (SELECT year(CAST(o_orderdate AS DATE)) FROM orders)
""")
def q_common_years(spark, sf_dir):
    """A3: years that the daily table and the orders share."""
    a = roles.daily_bars(spark, sf_dir).select(F.year("date").alias("year"))
    b = roles.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))
    return common_years(a, b, "year", 1996)


@register("panel_build", f"""
WITH {SQL_XWALK},
sf1 AS (SELECT {_sql_ticker("s.s_name")} AS ticker, f.datekey, f.order_key, f.revenue FROM fund_raw f
        JOIN supplier s ON f.entity_id = s.s_suppkey WHERE f.form_type IN ('1-URGENT', '2-HIGH')),
r AS (SELECT sf1.*, m.cik FROM sf1 LEFT JOIN tmap m ON sf1.ticker = m.ticker),
c AS (SELECT r.*, u.permno, u.date_in,
             r.datekey BETWEEN u.date_in AND coalesce(u.date_out, DATE '2100-01-01') AS inw
      FROM r JOIN uids u ON r.cik = u.cik),
res AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, datekey, order_key, revenue
            ORDER BY inw DESC, date_in, permno) AS rn FROM c) WHERE rn = 1),
fl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY permno, datekey ORDER BY order_key DESC) AS k
                      FROM res) WHERE k = 1),
d AS (SELECT entity_id + 100000 AS permno, date, ret, prc, vol FROM daily),
p AS (SELECT d.*, fl.datekey, fl.ticker, fl.cik, fl.revenue FROM d ASOF LEFT JOIN fl
      ON d.permno = fl.permno AND d.date >= fl.datekey),
s AS (SELECT * FROM p WHERE permno IN (SELECT permno FROM p WHERE datekey IS NOT NULL)),
g AS (SELECT s.permno, s.date, coalesce(bool_or(s.date BETWEEN u.date_in AND coalesce(u.date_out, DATE '2100-01-01')),
                                         false) AS in_universe
      FROM s LEFT JOIN uids u ON s.permno = u.permno GROUP BY s.permno, s.date)
SELECT s.permno, s.date, round(s.ret, 6) + 0.0 AS ret, round(s.prc, 6) + 0.0 AS prc, round(s.vol, 6) + 0.0 AS vol,
       s.datekey, s.ticker, s.cik, round(s.revenue, 6) + 0.0 AS revenue, g.in_universe,
       CAST(date_diff('day', s.datekey, s.date) AS INTEGER) AS fund_age_days, CAST(year(s.date) AS INTEGER) AS year
FROM s JOIN g ON s.permno = g.permno AND s.date = g.date
""")
def q_panel_build(spark, sf_dir):
    # the daily table feeds the panel, the validity windows and the as-of carry grid:
    # hand it over as a written table, as the stages of §3.1 do
    daily = materialize(roles.daily_bars(spark, sf_dir), "daily")
    d = daily.select((F.col("entity_id") + 100000).alias("permno"), "date", "ret", "prc", "vol")
    ids = T.spells(daily.select("entity_id", "date"), "entity_id", "date", 14).select(
        K.normalize_cik(F.col("entity_id")).alias("cik"), (F.col("entity_id") + 100000).alias("permno"),
        "date_in", "date_out")
    out = panel.build_panel(d, materialize(roles.sf1_rows(spark, sf_dir), "sf1"), roles.ticker_map(spark, sf_dir),
                            ids)
    return round_doubles(out.select("permno", "date", "ret", "prc", "vol", "datekey", "ticker", "cik", "revenue",
                                    "in_universe", "fund_age_days", "year"))


# --------------------------------------------------------------------------- #
# A1/A2/B1: partitioned write, then a pruned window scan
# --------------------------------------------------------------------------- #

SCAN_START, SCAN_END = "1997-03-01", "1998-06-30"


@register("panel_window_scan", f"""
WITH {SQL_DAILY}
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities,
       min(date) AS first_date, max(date) AS last_date
FROM daily WHERE date BETWEEN DATE '{SCAN_START}' AND DATE '{SCAN_END}' GROUP BY year(date)
""")
def q_panel_window_scan(spark, sf_dir):
    import uuid
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/daily-{uuid.uuid4().hex[:10]}"
    SK.write_partitioned(roles.daily_bars(spark, sf_dir).withColumn("year", F.year("date")), path,
                         sort_within=["entity_id", "date"])
    w = scan_window(spark, path, "date", SCAN_START, SCAN_END, ["entity_id", "date", "year"])
    return w.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("n_entities"),
                                 F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@register("turnover_by_name", f"""
WITH {SQL_DAILY}, {SQL_FRI}, {SQL_WEIGHTS},
dts AS (SELECT strategy, date, row_number() OVER (PARTITION BY strategy ORDER BY date) AS i
        FROM (SELECT DISTINCT strategy, date FROM weights)),
x AS (SELECT w.strategy, w.entity_id, w.w, d.i FROM weights w JOIN dts d ON w.strategy = d.strategy AND w.date = d.date),
j AS (SELECT coalesce(c.strategy, p.strategy) AS strategy, coalesce(c.i, p.i) AS i, c.w, p.pw
      FROM x c FULL OUTER JOIN (SELECT strategy, i + 1 AS i, entity_id, w AS pw FROM x) p
      ON c.strategy = p.strategy AND c.i = p.i AND c.entity_id = p.entity_id),
lst AS (SELECT strategy, max(i) AS last FROM dts GROUP BY strategy),
j2 AS (SELECT j.*, count(j.w) OVER (PARTITION BY j.strategy, j.i) AS k FROM j JOIN lst ON j.strategy = lst.strategy
       WHERE j.i <= lst.last),
t AS (SELECT strategy, i, sum(abs(coalesce(w, 0.0) - coalesce(CASE WHEN i = 1 THEN 1.0 / k ELSE pw END, 0.0)))
             AS turnover FROM j2 GROUP BY strategy, i)
SELECT t.strategy, d.date, round(t.turnover, 6) + 0.0 AS turnover FROM t JOIN dts d ON t.strategy = d.strategy AND t.i = d.i
""")
def q_turnover_by_name(spark, sf_dir):
    # the weights table (dates x K x strategies) feeds both sides of the date-to-date comparison
    w = materialize(BT.strategy_weights(BT.scoreboard(BT.friday_panel(spark, sf_dir)), loosen_cap=True), "weights")
    return round_doubles(P.turnover_name(w, "strategy", "date", "entity_id"))
