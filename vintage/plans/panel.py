"""Point-in-time panel (slice 0): daily bars + latest already-filed fundamentals.

scan -> daily bars -> backward as-of fundamentals (tie-break by order key)
-> leakage guard -> fundamental age -> year.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.operators.asof import asof_join
from vintage.operators.gates import leakage_guarded
from vintage.plans import roles


def pit_panel(daily: DataFrame, fund: DataFrame, entity: str = "entity_id",
              date: str = "date", datekey: str = "datekey",
              tie_break=("order_key",), payload=("revenue", "form_type"),
              bucket: str = "month") -> DataFrame:
    """Panel rows with the fundamentals known on each date, their age and year."""
    j = asof_join(daily, fund, entity, date, datekey, tie_break=list(tie_break),
                  right_cols=list(payload), bucket=bucket)
    age = leakage_guarded(F.datediff(F.col(date), F.col(datekey)), datekey, date)
    return j.withColumn("fund_age_days", age).withColumn("year", F.year(date))


def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit_panel(roles.daily_bars(spark, sf_dir), roles.fundamentals(spark, sf_dir))


# Fixed values of the training-panel role: order priorities playing 10-K/10-Q/8-K.
KQ8_FORMS = ("1-URGENT", "2-HIGH", "3-MEDIUM")
MACRO_SERIES = ("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW")


def macro_on_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide macro series forward-filled on the ship-day axis (one row per day)."""
    from vintage.operators import temporal as T
    wide = T.pivot_wide(roles.macro_long_orders(spark, sf_dir), "date", "series", "value", MACRO_SERIES)
    axis = roles.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return T.fill_on_axis(axis, wide, "date")


def stockday_inputs(spark: SparkSession, sf_dir: str, tail_days: int = 60):
    """(grid, docs, bridge) for the stock-day vectors: each filer's daily calendar
    from its first document to ``tail_days`` after its last; documents keyed by
    cik; the identity bridge (a filer is its own entity)."""
    v = roles.vectors(spark, sf_dir)
    docs = v.select(F.col("entity_id").alias("cik"), F.col("vec_id").alias("doc_id"),
                    F.col("date").alias("filing_date"), "vec")
    bridge = v.select("entity_id", F.col("entity_id").alias("cik")).distinct()
    span = v.groupBy("entity_id").agg(F.min("date").alias("d0"), F.max("date").alias("d1"))
    grid = span.select("entity_id", F.explode(F.sequence("d0", F.date_add("d1", tail_days))).alias("date"))
    return grid, docs, bridge


def training_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§3.2 stages 5-6: member rows of the daily panel + macro + recency + filing
    count + text novelty + forward labels on member rows + year (no year loop:
    whole table).

    Filings are aggregated once per (cik, day) — all forms and the 10-K/10-Q/8-K
    roles — and written once; recency, trailing counts and membership spells
    all read that table. The member panel is written once as well, labels
    included, since the as-of and the counts start from it.
    """
    from vintage.operators import temporal as T
    from vintage.operators.asof import days_since_event
    from vintage.session import materialize
    f = roles.filings(spark, sf_dir)
    ev = materialize(f.groupBy("cik", "filing_date").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("form_type").isin(*KQ8_FORMS)).alias("n_kq8")),
        "filing_days")
    spells = T.spells(ev.select(F.col("cik").cast("long").alias("entity_id"), F.col("filing_date").alias("date")),
                      "entity_id", "date", 5)
    d = roles.daily_bars(spark, sf_dir).select(
        "entity_id", F.lpad(F.col("entity_id").cast("string"), 10, "0").alias("cik"), "date", "ret", "prc", "vol")
    # the member panel with its labels feeds several steps (as-of, counts): write it once
    member = T.forward_returns(T.membership_filter(d, spells, "entity_id", "date"), "entity_id", "date", "ret", (1, 5))
    member = materialize(member, "member_panel")
    x = days_since_event(member, ev.filter(F.col("n_kq8") > 0), "cik", "date", "filing_date", "days_since_filing")
    x = T.trailing_event_count(x, ev, "cik", "date", "filing_date", 7, weight="n_all")
    # novelty on the daily stock-day vectors (decay-weighted, forward-filled)
    from vintage.operators import vectors as V
    grid, docs, bridge = stockday_inputs(spark, sf_dir)
    sv = V.stockday_vectors(grid, docs, bridge, "entity_id", "date", "cik", "doc_id", "filing_date", "vec",
                            dtype="float64")
    x = x.join(T.text_novelty(sv, "entity_id", "date", "vec", 7), ["entity_id", "date"], "left")
    # the macro series last: a small table, so its columns cross no shuffle of the panel
    macro = macro_on_axis(spark, sf_dir)
    x = x.join(macro, "date", "left")
    return x.select("entity_id", "date", "cik", "ret", "prc", "vol", *[c for c in macro.columns if c != "date"],
                    "days_since_filing", "doc_count_7d", "text_novelty", "fwd_ret_1d", "fwd_ret_5d",
                    F.year("date").alias("year"))


def build_panel(daily: DataFrame, sf1: DataFrame, tickers: DataFrame, entity_ids: DataFrame,
                permno: str = "permno", date: str = "date", ticker: str = "ticker", cik: str = "cik",
                datekey: str = "datekey", tie_break=("order_key",), dimension: str | None = "ARQ",
                bucket: str = "month") -> DataFrame:
    """§3.1 as one lazy plan: as-reported filter (C6) -> ticker->cik (left) ->
    cik->permno through validity windows (D3, fallback to the earliest window,
    unresolved dropped) -> backward as-of by permno (D1) -> strike permnos
    without any fundamental (D13) -> membership flag (D4) -> leakage guard (B6)
    -> fundamental age (C11) and year (C12)."""
    from vintage.functions.keys import normalize_cik
    from vintage.operators import temporal as T
    from vintage.operators.intervals import resolve_by_window
    f = sf1.filter(F.col("dimension") == dimension) if dimension else sf1
    tmap = tickers.select(ticker, normalize_cik(F.col(cik)).alias(cik)).dropDuplicates([ticker])
    ids = entity_ids.select(normalize_cik(F.col(cik)).alias(cik), permno, "date_in", "date_out")
    f = f.join(tmap, ticker, "left")
    f = resolve_by_window(f, cik, datekey, ids, permno)
    payload = [c for c in f.columns if c not in (permno, datekey, "in_window", *tie_break)]
    rename = {c: f"fund_{c}" for c in payload if c in daily.columns}
    for a, b in rename.items():
        f = f.withColumnRenamed(a, b)
    payload = [rename.get(c, c) for c in payload]
    j = asof_join(daily, f, permno, date, datekey, tie_break=list(tie_break), right_cols=payload, bucket=bucket)
    j = T.strike_without(j, permno, datekey)
    j = T.membership_flag(j, entity_ids.select(permno, "date_in", "date_out"), permno, date)
    age = leakage_guarded(F.datediff(F.col(date), F.col(datekey)), datekey, date)
    return j.withColumn("fund_age_days", age).withColumn("year", F.year(date))
