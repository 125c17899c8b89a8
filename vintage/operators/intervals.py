"""Interval resolution: identifier crosswalks through validity windows (D3),
largest-overlap matching (D6), key-set resolution (D14) and membership
reconstruction from a change log (H4).

Windows are few per key (an identifier has a handful of validity periods),
so they are collapsed to one sorted array per key and joined many-to-one;
the large side never fans out.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintage.functions.core import FAR_FUTURE, open_end


def _far() -> F.Column:
    return F.lit(FAR_FUTURE).cast("date")


def resolve_by_window(rows: DataFrame, key: str, date: str, windows: DataFrame, id_col: str,
                      date_in: str = "date_in", date_out: str = "date_out", drop_unresolved: bool = True,
                      out: str | None = None) -> DataFrame:
    """D3: attach ``id_col`` from the window of the same ``key`` that contains
    ``date`` (closed, open end = far future; first by ``(date_in, id)``), else
    the key's earliest window; rows whose key has no window are dropped (NULL keys
    before the shuffle, so that they do not gather in one task)."""
    out = out or id_col
    w = (windows.filter(F.col(key).isNotNull() & F.col(id_col).isNotNull())
         .groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
             F.col(date_in).alias("i"), F.col(id_col).alias("id"), open_end(date_out).alias("o")))).alias("_w")))
    j = rows.join(w, key, "inner" if drop_unresolved else "left")
    d = F.col(date)
    inside = F.filter("_w", lambda x: (d >= x["i"]) & (d <= x["o"]))
    first = F.try_element_at(inside, F.lit(1))
    earliest = F.try_element_at(F.col("_w"), F.lit(1))
    pick = F.coalesce(first["id"], earliest["id"])
    res = j.withColumn(out, pick).withColumn("in_window", F.size(inside) > 0).drop("_w")
    return res.filter(F.col(out).isNotNull()) if drop_unresolved else res


def largest_overlap(left: DataFrame, right: DataFrame, key: str, l_in: str, l_out: str,
                    r_in: str, r_out: str, id_col: str, out: str | None = None) -> DataFrame:
    """Per left row, the right row of the same key with the largest positive
    overlap in days (open ends filled with the far-future date; ties -> smallest
    id); left rows without a positive overlap keep NULL."""
    out = out or id_col
    r = (right.filter(F.col(key).isNotNull())
         .groupBy(key).agg(F.collect_list(F.struct(F.col(r_in).alias("i"), F.col(r_out).alias("o"),
                                                    F.col(id_col).alias("id"))).alias("_r")))
    j = left.join(r, key, "left")
    li, lo = F.col(l_in), F.coalesce(F.col(l_out), _far())

    def overlap(x):
        return F.datediff(F.least(lo, F.coalesce(x["o"], _far())), F.greatest(li, x["i"]))

    scored = F.transform("_r", lambda x: F.struct((-overlap(x)).alias("neg"), x["id"].alias("id")))
    best = F.sort_array(F.filter(scored, lambda s: s["neg"] < 0))
    top = F.try_element_at(best, F.lit(1))
    return (j.withColumn(out, top["id"]).withColumn("overlap_days", -top["neg"]).drop("_r"))


def keys_in_universe(mapping: DataFrame, universe: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct ``value`` (e.g. tickers) whose ``key`` (cik) is in the universe."""
    return mapping.join(universe.select(key).distinct(), key, "left_semi").select(value).distinct()


def match_rate(left: DataFrame, resolved_col: str) -> DataFrame:
    """B7 helper: share of rows with a resolved id."""
    return left.agg(F.avg(F.col(resolved_col).isNotNull().cast("double")).alias("match_rate"))


def reconstruct_membership(changes: DataFrame, current: DataFrame, start: str, end: str,
                           ticker: str = "ticker", date: str = "date", seq: str = "seq",
                           op: str = "op") -> DataFrame:
    """H4: rebuild ``(ticker, date_in, date_out)`` intervals from current members and
    a change log (``op`` in {'added', 'removed'}).

    The reference walks changes newest -> oldest with a stack of open intervals:
    a current member pushes an open interval; ``removed(d)`` pushes ``[?, d]``;
    ``added(d)`` gives the most recently pushed open interval ``date_in = d``, or
    starts ``[d, open)`` when none is open; leftovers start at ``start``; then
    intervals are clipped to ``[start, end]``. Same-date order: larger ``seq``
    first, and ``added`` before ``removed`` within one change row.

    Stack depth is a running sum clamped at zero (``S - min(0, running min S)``);
    at any one depth pushes and pops alternate, so each pop matches the
    previous event at its depth (``lag``). No group is gathered into an array.
    """
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    ev = changes.select(F.col(ticker).alias("t"), F.col(date).alias("d"), F.col(seq).cast("long").alias("q"),
                        F.col(op).alias("op"))
    cur = current.select(F.col(ticker).alias("t")).distinct().select(
        "t", F.lit(None).cast("date").alias("d"), F.lit(None).cast("long").alias("q"), F.lit("current").alias("op"))
    u = ev.unionByName(cur)
    # scan order: current first, then date desc, seq desc, added before removed
    u = u.withColumn("_k0", F.when(F.col("op") == "current", 0).otherwise(1))
    u = u.withColumn("_k3", F.when(F.col("op") == "added", 0).otherwise(1))
    order = [F.col("_k0"), F.col("d").desc(), F.col("q").desc(), F.col("_k3")]
    w = Window.partitionBy("t").orderBy(*order)
    delta = F.when(F.col("op") == "added", -1).otherwise(1)
    u = (u.withColumn("_delta", delta)
         .withColumn("_s", F.sum("_delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_mprev", F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    floor_prev = F.least(F.lit(0), F.coalesce(F.col("_mprev"), F.lit(0)))
    depth_before = F.col("_s") - F.col("_delta") - floor_prev
    u = u.withColumn("_before", depth_before)
    is_pop = (F.col("op") == "added") & (F.col("_before") > 0)
    is_push = F.col("op") != "added"
    u = (u.withColumn("_kind", F.when(is_push, "push").when(is_pop, "pop").otherwise("new"))
         .withColumn("_level", F.when(is_push, F.col("_before") + 1).when(is_pop, F.col("_before"))))
    # pairing at each depth: the pop right after a push at that depth closes it
    stacked = u.filter(F.col("_kind") != "new")
    lw = Window.partitionBy("t", "_level").orderBy(*order)
    stacked = stacked.withColumn("_next_kind", F.lead("_kind").over(lw)).withColumn("_next_d", F.lead("d").over(lw))
    pushes = stacked.filter(F.col("_kind") == "push").select(
        "t", F.when(F.col("_next_kind") == "pop", F.col("_next_d")).otherwise(s).alias("date_in"),
        F.col("d").alias("date_out"))
    news = u.filter(F.col("_kind") == "new").select("t", F.col("d").alias("date_in"),
                                                     F.lit(None).cast("date").alias("date_out"))
    iv = pushes.unionByName(news)
    iv = iv.filter(F.col("date_in") <= e).filter(F.col("date_out").isNull() | (F.col("date_out") >= s))
    iv = (iv.withColumn("date_in", F.greatest(F.col("date_in"), s))
          .withColumn("date_out", F.when(F.col("date_out") > e, F.lit(None).cast("date")).otherwise(F.col("date_out"))))
    iv = iv.filter(F.col("date_out").isNull() | (F.col("date_in") <= F.col("date_out")))
    return iv.select(F.col("t").alias(ticker), "date_in", "date_out")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Raise when ``df`` is empty (one-row probe), else return it unchanged."""
    if df.limit(1).count() == 0:
        raise ValueError(f"no rows: {what}")
    return df
