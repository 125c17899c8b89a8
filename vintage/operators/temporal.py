"""Generic point-in-time toolkit: forward labels, calendar-range counts,
exact-lag lookups, interval membership, forward fills and walk schedules.

Grain assumption: per-entity windows run on tables unique on
``(entity, date)``; such a group holds at most one row per calendar day, so
its size is bounded by the calendar, not by the data volume. Operators whose
input may repeat a key first collapse it with a partial aggregate.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintage.functions.core import as_list, open_end


# --------------------------------------------------------------------------- #
# H1 — forward compounded returns over the next h rows
# --------------------------------------------------------------------------- #
def forward_returns(df: DataFrame, by, date: str, ret: str = "ret",
                    horizons: Sequence[int] = (1, 5), prefix: str = "fwd_ret_") -> DataFrame:
    """``fwd_ret_{h}d = expm1(sum(log1p(ret)))`` over rows t+1..t+h of the entity.

    NULL when fewer than h rows follow or any of them is missing. ``ret = -1``
    gives ``log1p = NULL`` and so a NULL label, like the pandas rolling sum.
    """
    by = as_list(by)
    lr = F.log1p(F.col(ret))
    base = Window.partitionBy(*by).orderBy(date)
    out = df
    for h in horizons:
        w = base.rowsBetween(1, h)
        out = out.withColumn(f"{prefix}{h}d", F.when(F.count(lr).over(w) == h,
                                                     F.expm1(F.sum(lr).over(w))))
    return out


# --------------------------------------------------------------------------- #
# D9 — number of events of the key in [date - window, date]
# --------------------------------------------------------------------------- #
def trailing_event_count(panel: DataFrame, events: DataFrame, by, date: str, event_date: str,
                         window_days: int = 7, out_col: str | None = None, weight: str | None = None) -> DataFrame:
    """Count events per key in the closed calendar range ``[date - window_days, date]``.

    Events are counted per ``(key, day)`` first (a partial aggregate); panel rows
    and event days then meet in the months an event reaches, and one range window
    per ``(key, month)`` adds up the days — no range join, no row per covered day,
    and a key with many rows is spread over its months. Missing -> 0 (int32).
    ``weight`` counts each input row that many times (pre-aggregated events).
    """
    by = as_list(by)
    out_col = out_col or f"doc_count_{window_days}d"
    one = F.col(weight) if weight else F.lit(1)
    keyed = F.col(event_date).isNotNull()
    for c in by:
        keyed = keyed & F.col(c).isNotNull()
    daily = (events.filter(keyed).select(*by, F.col(event_date).alias(date), one.alias("_one"))
             .groupBy(*by, date).agg(F.sum("_one").alias("_n")))
    months = F.sequence(F.trunc(date, "month"), F.trunc(F.date_add(date, window_days), "month"), F.expr("INTERVAL 1 MONTH"))
    reach = daily.select(*by, date, "_n", F.explode(months).alias("_b"), F.lit(False).alias("_row"))
    u = (panel.withColumn("_b", F.trunc(date, "month")).withColumn("_row", F.lit(True))
         .unionByName(reach, allowMissingColumns=True))
    w = Window.partitionBy(*by, "_b").orderBy(F.unix_date(date)).rangeBetween(-window_days, 0)
    rest = [c for c in panel.columns if c not in (*by, date)]
    return (u.withColumn(out_col, F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("int")).filter("_row")
            .select(*by, date, *rest, out_col))


# --------------------------------------------------------------------------- #
# D11 / G14 — exact calendar lag lookup and cosine novelty
# --------------------------------------------------------------------------- #
def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """E3 with an explicit order: one row per ``keys``, the last in ``order``."""
    others = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*others), F.struct(*[F.col(c) for c in order])).alias("_r"))
            .select(*keys, "_r.*"))


def exact_lag(df: DataFrame, by, date: str, cols: Sequence[str], lag_days: int,
              suffix: str = "_lag") -> DataFrame:
    """Attach the same entity's ``cols`` at exactly ``date - lag_days`` (NULL if absent).

    A range window of one day per entity, so the rows are not computed and
    shuffled twice; ``df`` must be unique on ``(entity, date)``.
    """
    by = as_list(by)
    known = F.col(date).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    w = Window.partitionBy(*by).orderBy(F.unix_date(date)).rangeBetween(-lag_days, -lag_days)
    then = F.collect_list(F.struct(*[F.col(c).alias(c + suffix) for c in cols])).over(w)
    rest = [c for c in df.columns if c not in (*by, date)]
    x = df.withColumn("_then", then).withColumn("_then", F.explode_outer(F.when(known, F.col("_then"))))
    return x.select(*by, date, *rest, *[F.col(f"_then.{c + suffix}") for c in cols])


def attach_on_day(df: DataFrame, events: DataFrame, by, date: str, cols: dict[str, str]) -> DataFrame:
    """The ``cols`` (name -> type) of the event on the same entity and day, NULL elsewhere.

    Rows of ``df`` stay as they are; a table without events, or without some of
    the columns, gives NULL columns of the stated types. Several events on one
    (entity, day) repeat the row.
    """
    keys = as_list(by) + [date]
    have = [F.col(c).cast(t).alias(c) if c in events.columns else F.lit(None).cast(t).alias(c) for c, t in cols.items()]
    return df.join(events.select(*keys, *have), keys, "left")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; zero norm -> NULL."""
    return F.try_divide(dot(a, b), F.nullif(l2norm(a) * l2norm(b), F.lit(0.0)))


def text_novelty(vecs: DataFrame, by, date: str, vec: str = "vec", lookback_days: int = 7,
                 order: Sequence[str] | None = None, out_col: str = "text_novelty") -> DataFrame:
    """``1 - cos(v_t, v_{t - lookback})`` per entity; NULL without the exact lagged row.

    Duplicate ``(entity, date)`` rows are collapsed first: the last in
    ``order`` wins.
    """
    by = as_list(by)
    v = vecs.select(*by, date, vec, *as_list(order))
    if order:
        v = last_per_key(v, by + [date], order)
    v = v.select(*by, date, vec)
    j = exact_lag(v, by, date, [vec], lookback_days)
    return j.select(*by, date, (F.lit(1.0) - cosine(F.col(vec), F.col(vec + "_lag"))).alias(out_col))


# --------------------------------------------------------------------------- #
# D4 / D5 — interval membership without fanning out the panel
# --------------------------------------------------------------------------- #
def _windows_by_key(windows: DataFrame, by, date_in: str, date_out: str) -> DataFrame:
    by = as_list(by)
    return (windows.filter(F.col(date_in).isNotNull())
            .groupBy(*by).agg(F.collect_list(F.struct(F.col(date_in).alias("i"),
                                                      open_end(date_out).alias("o"))).alias("_w")))


def membership_flag(panel: DataFrame, windows: DataFrame, by, date: str,
                    date_in: str = "date_in", date_out: str = "date_out",
                    out_col: str = "in_universe", method: str = "array") -> DataFrame:
    """``out_col`` = the date lies in any closed window of the entity; no window -> false.

    ``array`` (default, for the usual handful of windows per key): each key's
    windows collapse to one array, joined many-to-one and tested with
    ``exists`` — one shuffle, the panel never multiplies.

    ``asof`` (for keys with many windows): a date is inside some window exactly
    when the largest end among windows starting on or before it reaches the
    date, so the running maximum of window ends is looked up with the
    backward as-of join — no per-row scan of a window list.
    """
    by = as_list(by)
    if method == "array":
        w = _windows_by_key(windows, by, date_in, date_out)
        d = F.col(date)
        return (panel.join(w, by, "left")
                .withColumn(out_col, F.coalesce(F.exists("_w", lambda x: (d >= x["i"]) & (d <= x["o"])),
                                                F.lit(False)))
                .drop("_w"))
    if method != "asof":
        raise ValueError("method must be 'array' or 'asof'")
    from vintage.operators.asof import asof_join
    w = windows.filter(F.col(date_in).isNotNull()).select(*by, F.col(date_in).alias("_win"),
                                                            open_end(date_out).alias("_wout"))
    run = Window.partitionBy(*by).orderBy("_win", "_wout").rowsBetween(Window.unboundedPreceding, 0)
    ends = w.withColumn("_reach", F.max("_wout").over(run))
    j = asof_join(panel, ends.select(*by, "_win", "_reach"), by, date, "_win", tie_break=["_reach"],
                  right_cols=["_reach"])
    return (j.withColumn(out_col, F.coalesce(F.col("_reach") >= F.col(date), F.lit(False)))
            .drop("_win", "_reach"))


def membership_filter(panel: DataFrame, windows: DataFrame, by, date: str,
                      date_in: str = "date_in", date_out: str = "date_out", method: str = "array") -> DataFrame:
    """Keep rows inside any window of their entity (interval semi-join, no duplicates)."""
    return (membership_flag(panel, windows, by, date, date_in, date_out, "_in", method)
            .filter("_in").drop("_in"))


def spells(days: DataFrame, by, date: str, max_gap_days: int, open_last: bool = True) -> DataFrame:
    """Sessionise distinct event days into ``(by, spell_no, date_in, date_out)`` intervals.

    A new spell starts when the gap to the previous day exceeds
    ``max_gap_days``. With ``open_last`` the entity's final spell is left open
    (``date_out`` NULL).
    """
    by = as_list(by)
    d = days.select(*by, date).distinct()
    w = Window.partitionBy(*by).orderBy(date)
    gap = F.datediff(F.col(date), F.lag(date).over(w))
    d = d.withColumn("_new", F.when(gap.isNull() | (gap > max_gap_days), 1).otherwise(0))
    d = d.withColumn("spell_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = d.groupBy(*by, "spell_no").agg(F.min(date).alias("date_in"), F.max(date).alias("date_out"))
    if open_last:
        last = F.max("spell_no").over(Window.partitionBy(*by))
        s = s.withColumn("date_out", F.when(F.col("spell_no") == last, F.lit(None).cast("date"))
                         .otherwise(F.col("date_out")))
    return s.withColumn("spell_no", F.col("spell_no").cast("int"))


# --------------------------------------------------------------------------- #
# D13 — keep entities that have at least one non-null value
# --------------------------------------------------------------------------- #
def strike_without(panel: DataFrame, by, required: str) -> DataFrame:
    """Drop every entity none of whose rows carries ``required`` (one pass, window per entity)."""
    by = as_list(by)
    has = F.max(F.col(required).isNotNull().cast("int")).over(Window.partitionBy(*by))
    return panel.withColumn("_has", has).filter(F.col("_has") == 1).drop("_has")


# --------------------------------------------------------------------------- #
# E4 / H2 / E5 — macro series: pivot, forward fill on an axis, unpivot
# --------------------------------------------------------------------------- #
def series_column(name: str, prefix: str = "macro_") -> str:
    return prefix + "".join(ch if ch.isalnum() else "_" for ch in name.lower())


def pivot_wide(long: DataFrame, date: str, series: str, value: str, values: Sequence[str],
               prefix: str = "macro_") -> DataFrame:
    """One column ``macro_<series lower>`` per series, columns sorted by name.

    ``values`` must be given (no extra distinct job); duplicates of
    ``(date, series)`` are rejected at run time, like pandas ``pivot``.
    """
    cnt = F.count(F.lit(1))
    wide = (long.groupBy(date).pivot(series, list(values))
            .agg(F.when(cnt > 1, F.raise_error(F.lit("duplicate (date, series) in pivot")))
                 .otherwise(F.first(value))))
    cols = sorted((series_column(v, prefix), v) for v in values)
    return wide.select(date, *[F.col(f"`{v}`").cast("double").alias(c) for c, v in cols])


def forward_fill(df: DataFrame, order: str, cols: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace NULLs by the last non-null value in ``order`` within ``partition_by``."""
    w = (Window.partitionBy(*partition_by) if partition_by else Window.partitionBy(F.lit(0)))
    w = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[F.last(F.col(c), ignorenulls=True).over(w).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def fill_on_axis(axis: DataFrame, wide: DataFrame, date: str, restart_yearly: bool = True,
                 carry: str = "axis") -> DataFrame:
    """Reindex ``wide`` to the ``axis`` dates and forward-fill.

    ``carry="axis"`` (reference parity): values published on dates off the
    axis are dropped before the fill; with ``restart_yearly`` the fill
    restarts each 1 January (the reference builds the axis per year).
    ``carry="asof"``: each axis date takes the latest value published on or
    before it, wherever it was published (no loss, no yearly restart).
    The axis holds one row per calendar day, so these windows are small.
    """
    cols = [c for c in wide.columns if c != date]
    if carry == "asof":
        ax = axis.select(date).distinct().withColumn("_ax", F.lit(1))
        u = ax.unionByName(wide.withColumn("_ax", F.lit(0)), allowMissingColumns=True)
        w = Window.partitionBy(F.lit(0)).orderBy(date, "_ax").rowsBetween(Window.unboundedPreceding, 0)
        filled = u.select(date, "_ax", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols])
        return filled.filter(F.col("_ax") == 1).drop("_ax")
    if carry != "axis":
        raise ValueError("carry must be 'axis' or 'asof'")
    a = axis.select(date).distinct().join(wide, date, "left")
    if restart_yearly:
        a = a.withColumn("_y", F.year(date))
        return forward_fill(a, date, cols, ["_y"]).drop("_y")
    return forward_fill(a, date, cols)


def unpivot_long(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str],
                 var_name: str = "series", value_name: str = "value") -> DataFrame:
    """Wide -> long, NULL values dropped."""
    return (df.unpivot(list(ids), list(value_cols), var_name, value_name)
            .filter(F.col(value_name).isNotNull()))


# --------------------------------------------------------------------------- #
# H13 — walk-forward schedule and row labelling
# --------------------------------------------------------------------------- #
def _schedule(ids: DataFrame, train_start: str, first_train_end_year: int) -> DataFrame:
    y = F.lit(first_train_end_year) + F.col("id") - 1
    return ids.select(
        F.col("id").cast("int").alias("walk_id"),
        F.lit(train_start).cast("date").alias("train_start"),
        F.make_date(y, F.lit(12), F.lit(31)).alias("train_end"),
        F.make_date(y + 1, F.lit(1), F.lit(1)).alias("val_start"),
        F.make_date(y + 1, F.lit(12), F.lit(31)).alias("val_end"),
        F.make_date(y + 2, F.lit(1), F.lit(1)).alias("test_start"),
        F.make_date(y + 2, F.lit(12), F.lit(31)).alias("test_end"))


def walk_schedule(spark: SparkSession, n_walks: int, train_start: str, first_train_end_year: int) -> DataFrame:
    """``(walk_id, train_start, train_end, val_start, val_end, test_start, test_end)``.

    Walk n trains on ``train_start .. (first_train_end_year + n - 1)-12-31``,
    validates on the next calendar year and tests on the one after.
    """
    return _schedule(spark.range(1, n_walks + 1), train_start, first_train_end_year)


def walk_schedule_of(df: DataFrame, date: str, train_start: str, first_train_end_year: int) -> DataFrame:
    """The walks of :func:`walk_schedule` up to the one that tests on the last year of ``df``
    (also when that year is not complete); none when the data ends before the first test year."""
    last = df.agg(F.max(F.year(date)).alias("y")).select((F.col("y") - F.lit(first_train_end_year + 1)).alias("n"))
    ids = last.filter("n > 0").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("id"))
    return _schedule(ids, train_start, first_train_end_year)


def assign_walks(df: DataFrame, walks: DataFrame, date: str) -> DataFrame:
    """Label rows with every ``(walk_id, split)`` whose window contains the date.

    The schedule has one row per walk (its size is the walk count), so it is
    broadcast; a row belongs to at most ``n_walks`` windows by construction.
    """
    d = F.col(date)
    w = F.broadcast(walks)
    split = (F.when(d.between(F.col("train_start"), F.col("train_end")), F.lit("train"))
             .when(d.between(F.col("val_start"), F.col("val_end")), F.lit("val"))
             .when(d.between(F.col("test_start"), F.col("test_end")), F.lit("test")))
    j = df.join(w, d.between(F.col("train_start"), F.col("test_end")), "inner")
    return j.withColumn("split", split).drop(*[c for c in walks.columns if c != "walk_id"])
