"""Trading limits: an ordered fold over dates that carries the held weights."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.functions.core import as_list

#: Holdings below this are closed: a scaled move only approaches zero.
DUST = 1e-12


def step(held: dict, target: dict, limit: dict, max_turnover: float) -> dict:
    """The next holdings: the move towards ``target``, scaled so that its L1 norm is at most
    ``max_turnover``, then each name's trade cut to its own ``limit`` (none: not cut)."""
    moves = {k: target.get(k, 0.0) - held.get(k, 0.0) for k in held.keys() | target.keys()}
    norm = sum(abs(moves[k]) for k in sorted(moves))
    scale = 1.0 if norm <= max_turnover else max_turnover / norm
    out = {}
    for k, m in moves.items():
        m *= scale
        cap = limit.get(k)
        if cap is not None:
            m = max(-cap, min(cap, m))
        w = held.get(k, 0.0) + m
        if abs(w) > DUST:
            out[k] = w
    return out


def cap_turnover(weights: DataFrame, by, date: str, name: str, weight: str, max_turnover: float = 0.30,
                 trade_limit: str | None = None) -> DataFrame:
    """(by, date, name, weight) after the turnover cap, and the per-name trade limit if given.

    The first date of a series is bought as it stands. A name that leaves the target is sold as far as
    the cap allows and stays in the result until it is gone. NULL weights are zero, rows with a NULL date or
    name are left out, repeated (series, date, name) rows add up. ``trade_limit`` is the largest change of the
    name's weight that day; NULL: no limit; negative: zero.

    A series is one chain (each date needs the one before), so it is one sorted stream in one task that
    holds a date and the current holdings; series (strategies times walks) run side by side.
    """
    by = as_list(by)
    cap = F.greatest(F.max(trade_limit).cast("double"), F.lit(0.0)) if trade_limit else F.lit(None).cast("double")
    if trade_limit:
        cap = F.when(F.max(trade_limit).isNotNull(), cap)
    rows = weights.filter(F.col(date).isNotNull() & F.col(name).isNotNull()).groupBy(*by, date, name).agg(
        F.sum(F.coalesce(F.col(weight), F.lit(0.0))).cast("double").alias(weight), cap.alias("__cap"))
    rows = rows.repartition(*by) if by else rows.coalesce(1)
    rows = rows.sortWithinPartitions(*by, date, name)
    schema = rows.select(*by, date, name, weight).schema

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series = day = None
        held, target, limit, first = {}, {}, {}, True

        def close():
            nonlocal held
            held = step({} if first else held, target, {} if first else limit,
                        float("inf") if first else max_turnover)
            names = sorted(held)
            return pd.DataFrame([(*series, day, k, held[k]) for k in names], columns=[*by, date, name, weight])

        for pdf in batches:
            made = []
            for *key, d, n, w, c in pdf[[*by, date, name, weight, "__cap"]].itertuples(index=False, name=None):
                key = tuple(None if pd.isna(x) else x for x in key)
                if (key, d) != (series, day):
                    if series is not None:
                        made.append(close())
                        first = key != series
                    if key != series:
                        held, first = {}, True
                    series, day, target, limit = key, d, {}, {}
                target[n] = w
                if not pd.isna(c):
                    limit[n] = c
            if made:
                yield pd.concat(made)
        if series is not None:
            yield close()

    return rows.mapInPandas(fold, schema)
