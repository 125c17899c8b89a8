"""Trailing features over the last n rows of an entity, without a window over the whole entity.

Rows are numbered per entity from counts per (entity, time bucket) and a
``row_number`` inside each bucket, then cut into blocks of ``block_rows`` rows.
The last ``lookback - 1`` rows of a block also travel to the next one, where
they only feed frames. A task therefore sorts at most ``block_rows + lookback``
rows of one entity, however long its history or however fine its bars are.

Frames are differences of running sums inside the block (a sliding frame would
add up all n rows again for each row), so a row costs the same for any n. Moments
are taken about the block's mean; the error of a sum is relative to the block's
values, not to the entity's history.

Rules: NULL is an entity (and a time) of its own, NULL times come first; rows at
one time are ordered by ``tie``; a repeated row counts as often as it occurs. A
feature is NULL while the frame holds fewer than n usable values (NULL, NaN and
infinite ones are not usable). An empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintage.functions.core import as_list, safe_div


@dataclass(frozen=True)
class Feature:
    """A feature of the rows t-skip-n+1 .. t-skip.

    ``values``: what is summed; a row counts where all of them are usable. ``result``: from the sums of the
    products named in ``sums`` (tuples of value names), in that order, to a column. ``centred`` values are
    taken about the block's mean. ``full``: NULL unless all n rows count. Values with one name are one value.
    """
    values: dict[str, Column]
    n: int
    result: Callable[..., Column]
    sums: list[tuple[str, ...]] = field(default_factory=list)
    skip: int = 0
    centred: bool = False
    full: bool = True


def usable(c: str | Column) -> Column:
    """NULL for NULL, NaN and infinite values."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _same(keys: Sequence[str], other: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys])


def row_positions(df: DataFrame, by, order: str, tie=(), bucket: Column | None = None,
                  pos_col: str = "__pos") -> DataFrame:
    """``pos_col``: the row's number (from 0) in its entity by (order, tie).

    ``bucket`` is a coarsening of ``order`` (default: its month) that bounds the
    rows one task has to sort; it must never decrease as ``order`` grows.
    """
    by, tie = as_list(by), as_list(tie)
    b = df.withColumn("__bucket", F.trunc(order, "month") if bucket is None else bucket)
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = b.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(*[F.col(c).alias(f"__s_{c}") for c in (*by, "__bucket")],
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(order, *tie)) - 1
    out = b.join(starts, _same([*by, "__bucket"], "__s_")).withColumn(pos_col, F.col("__start") + inside)
    return out.select(*df.columns, pos_col)


def trailing(df: DataFrame, by, order: str, lookback: int, features: dict[str, Feature], tie=(),
             block_rows: int | None = None, bucket: Column | None = None) -> DataFrame:
    """``df`` with one column per feature; no frame may reach back further than ``lookback`` rows
    (the row itself included)."""
    by = as_list(by)
    size = block_rows or 4 * lookback
    if size < lookback:
        raise ValueError("block_rows must be at least lookback")
    for name, f in features.items():
        if f.n + f.skip > lookback:
            raise ValueError(f"{name} needs lookback >= {f.n + f.skip}")
    rows = row_positions(df, by, order, tie, bucket).withColumn("__own", F.floor(F.col("__pos") / size))
    feeds_next = F.col("__pos") % size > size - lookback
    blocks = F.when(feeds_next, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))
    dealt = rows.withColumn("__block", F.explode(blocks))
    block = Window.partitionBy(*by, "__block")
    running = block.orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)

    # the values of each family of features: usable together, about the block's mean where asked
    families: dict[tuple, tuple[str, Feature]] = {}
    for f in features.values():
        families.setdefault((f.centred, *sorted(f.values)), (f"__f{len(families)}", f))
    values, centres, wanted = {}, {}, {}
    for tag, f in families.values():
        together = reduce(lambda a, b: a & b, [v.isNotNull() for v in f.values.values()])
        values |= {f"{tag}_{k}": F.when(together, v) for k, v in f.values.items()}
        if f.centred:
            centres |= {f"{tag}_{k}": F.col(f"{tag}_{k}") - F.avg(f"{tag}_{k}").over(block) for k in f.values}
    x = dealt.withColumns(values)
    x = x.withColumns(centres) if centres else x
    for f in features.values():
        tag = families[(f.centred, *sorted(f.values))][0]
        wanted[f"{tag}__n"] = F.count(f"{tag}_{next(iter(f.values))}").over(running)
        for names in f.sums:
            term = reduce(lambda a, b: a * b, [F.col(f"{tag}_{k}") for k in names])
            wanted[f"{tag}__{'_'.join(names)}"] = F.sum(F.coalesce(term, F.lit(0.0))).over(running)
    x = x.withColumns(wanted)
    at = block.orderBy("__pos")

    def frame(total: str, f: Feature) -> Column:
        upto = F.lag(total, f.skip).over(at) if f.skip else F.col(total)
        return upto - F.coalesce(F.lag(total, f.n + f.skip).over(at), F.lit(0))

    made = []
    for name, f in features.items():
        tag = families[(f.centred, *sorted(f.values))][0]
        result = f.result(*[frame(f"{tag}__{'_'.join(names)}", f) for names in f.sums])
        made.append((F.when(frame(f"{tag}__n", f) == f.n, result) if f.full else result).alias(name))
    out = x.select(*df.columns, "__block", "__own", *made).filter(F.col("__block") == F.col("__own"))
    return out.select(*df.columns, *features)


def compounded(ret: str, n: int, skip: int = 0) -> Feature:
    """The return over n rows, ending ``skip`` rows back. A return of -1 or less leaves it NULL."""
    r = usable(ret)
    return Feature({f"log_{ret}": F.when(r > -1, F.log1p(r))}, n, F.expm1, [(f"log_{ret}",)], skip)


def _squares(xx: Column, x: Column, n: int) -> Column:
    return F.greatest(xx - x * x / n, F.lit(0.0))


def volatility(ret: str, n: int, per_year: float = 252.0) -> Feature:
    """Annualised sample standard deviation of the last n returns (n of 2 or more)."""
    def result(x, xx):
        return F.sqrt(_squares(xx, x, n) / (n - 1)) * F.lit(per_year ** 0.5)
    return Feature({ret: usable(ret)}, n, result, [(ret,), (ret, ret)], centred=True)


def beta(ret: str, market: str, n: int) -> Feature:
    """Sample covariance with the market over the market's variance; NULL where the market does not
    move (a variance of at most 1e-10 of its mean square about the block's mean)."""
    def result(x, y, xy, yy):
        var = _squares(yy, y, n)
        return F.when(var > 1e-10 * yy, safe_div(xy - x * y / n, var))
    return Feature({ret: usable(ret), market: usable(market)}, n, result,
                   [(ret,), (market,), (ret, market), (market, market)], centred=True)


def mean_of(value: Column, n: int, name: str) -> Feature:
    """The mean of the last n values (dollar volume and the like); ``name`` tells values apart."""
    return Feature({name: usable(value)}, n, lambda s: s / n, [(name,)])


def illiquidity(ret: str, dollars: Column, n: int, scale: float = 1e6) -> Feature:
    """Mean of ``|ret| / dollar volume`` times ``scale``; days without volume are not usable."""
    return mean_of(safe_div(F.abs(usable(ret)), dollars) * F.lit(scale), n, f"illiquid_{ret}")


def none_of(flag: Column, n: int, name: str = "flag") -> Feature:
    """True where none of the last n rows (fewer at the start) has the flag; NULL is no flag."""
    return Feature({name: F.coalesce(flag.cast("double"), F.lit(0.0))}, n, lambda s: s == 0, [(name,)], full=False)


def eligible(adv: str, price: str, unhalted: str, min_adv: float, min_price: float) -> Column:
    """Enough dollar volume, a high enough price, no recent halt. Unknown values are not eligible."""
    ok = (F.col(adv) >= min_adv) & (F.col(price) >= min_price) & F.col(unhalted)
    return F.coalesce(ok, F.lit(False))
