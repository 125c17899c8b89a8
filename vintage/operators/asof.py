"""Backward as-of joins (point-in-time lookups).

``asof_join`` attaches to every left row the latest right row of the same key
whose time is ``<=`` the left time (equality allowed). Ties on the right time
are resolved by an explicit tie-break: the *last* row in tie-break order wins.

Plan (no range join, no per-key fan-out):

1. Right rows keep their tie-break columns; ties on the time resolve in the
   window order (last in tie-break order wins), so no de-duplication pass.
2. Time is cut into buckets (``month`` by default). For every
   ``(key, bucket)`` the last right row of all *earlier* buckets is computed
   from a small per-bucket table and injected as a "carry" row at the start
   of the bucket.
3. Left rows, right rows and carry rows are unioned and one window
   ``last(payload, ignorenulls)`` runs over ``(key, bucket)`` ordered by time.

Step 3 is the only shuffle of the left side. Window groups are
``(key, bucket)``, so a key that holds a third of all rows is still spread
over as many tasks as it has buckets; pick a finer bucket for extreme skew.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintage.functions.core import as_list

_BUCKETS = {"year", "quarter", "month", "week", "day"}


def _bucket(t: Column, unit: str) -> Column:
    if unit not in _BUCKETS:
        raise ValueError(f"bucket must be one of {sorted(_BUCKETS)}")
    return F.to_date(F.date_trunc(unit, t))


def asof_join(left: DataFrame, right: DataFrame, by, left_on: str, right_on: str,
              tie_break=(), right_cols=None, bucket: str = "month",
              how: str = "left") -> DataFrame:
    """Backward as-of join of ``left`` to ``right`` on equal ``by`` keys.

    Returns the left columns plus ``right_on`` and the right payload columns.
    Unmatched left rows keep NULLs (``how="left"``) or are dropped
    (``how="inner"``). Ties on ``right_on`` go to the last row in ``tie_break``
    order: the tie-break is part of the window order, so no separate
    de-duplication pass is needed.
    """
    by = as_list(by)
    tb = as_list(tie_break)
    rcols = [c for c in (right_cols or right.columns) if c not in by and c != right_on]
    clash = (set(rcols) | {right_on}) & set(left.columns)
    if clash:
        raise ValueError(f"right columns collide with left columns: {sorted(clash)}")
    payload_names = [right_on] + rcols
    tb_names = [f"_tb{i}" for i in range(len(tb))]
    # NULL keys never match (Spark join semantics), so such right rows are dropped
    keyed = F.col(right_on).isNotNull()
    for c in by:
        keyed = keyed & F.col(c).isNotNull()
    r = right.filter(keyed).select(
        *by, F.col(right_on).cast("timestamp").alias("_t"), _bucket(F.col(right_on), bucket).alias("_b"),
        F.struct(*[F.col(c) for c in payload_names]).alias("_r"),
        *[F.col(c).alias(n) for c, n in zip(tb, tb_names)])

    # carry: for each (key, bucket) seen on either side, the last right row of earlier buckets
    order_key = F.struct(F.col("_t"), *[F.col(n) for n in tb_names])
    per_bucket_r = r.groupBy(*by, "_b").agg(F.max_by("_r", order_key).alias("_last"))
    left_buckets = left.select(*by, _bucket(F.col(left_on), bucket).alias("_b")).distinct()
    grid = left_buckets.join(per_bucket_r, by + ["_b"], "full")
    wk = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (grid.withColumn("_r", F.last("_last", ignorenulls=True).over(wk))
             .filter(F.col("_r").isNotNull())
             .select(*by, "_b", F.col("_b").cast("timestamp").alias("_t"), "_r", F.lit(0).alias("_side")))

    lcols = left.columns
    lt = left.select(*[F.col(c) for c in lcols],
                     F.col(left_on).cast("timestamp").alias("_t"),
                     _bucket(F.col(left_on), bucket).alias("_b"),
                     F.lit(2).alias("_side"))
    rr = r.withColumn("_side", F.lit(1))
    u = lt.unionByName(rr, allowMissingColumns=True).unionByName(carry, allowMissingColumns=True)
    w = (Window.partitionBy(*by, "_b").orderBy("_t", "_side", *tb_names)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = (u.withColumn("_m", F.last("_r", ignorenulls=True).over(w))
           .filter(F.col("_side") == 2))
    if how == "inner":
        out = out.filter(F.col("_m").isNotNull())
    elif how != "left":
        raise ValueError("how must be 'left' or 'inner'")
    return out.select(*[F.col(c) for c in lcols], *[F.col(f"_m.{c}").alias(c) for c in payload_names])


def days_since_event(panel: DataFrame, events: DataFrame, by, date_col: str, event_date: str,
                     out_col: str = "days_since", bucket: str = "month") -> DataFrame:
    """Calendar days from the latest event on or before each panel date (NULL before the first)."""
    ev = events.select(*as_list(by), F.col(event_date).alias("_event_date"))
    j = asof_join(panel, ev, by, date_col, "_event_date", bucket=bucket)
    return j.withColumn(out_col, F.datediff(F.col(date_col), F.col("_event_date"))).drop("_event_date")
