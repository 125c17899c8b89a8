"""Scalar column helpers used at table boundaries and in every operator.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``
so they stay inside whole-stage codegen.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Far-future sentinel for open interval ends.
FAR_FUTURE = "2100-01-01"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """pandas treats NaN as missing; Spark counts and averages it. Convert at ingest."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def nan_to_zero(c: str | Column) -> Column:
    """``np.nan_to_num`` for returns: NaN/NULL -> 0."""
    return F.coalesce(nan_to_null(c), F.lit(0.0))


def as_date(c: str | Column) -> Column:
    """Normalise a timestamp / timestamp_ntz / string to a DATE; bad input -> NULL."""
    return F.to_date(col(c))


def open_end(c: str | Column) -> Column:
    """Null upper bound of a closed interval -> far-future sentinel."""
    return F.coalesce(col(c), F.lit(FAR_FUTURE).cast("date"))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """Division with zero/NULL denominator -> NULL (ANSI division throws)."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0)))


def weekday(c: str | Column) -> Column:
    """Monday = 0 ... Sunday = 6 (pandas ``dayofweek``)."""
    return F.weekday(col(c))


def is_friday(c: str | Column) -> Column:
    return weekday(c) == 4


def numeric_columns(df: DataFrame, deny: Iterable[str] = ()) -> list[str]:
    """Schema-only feature selection: numeric type and not denied (no job)."""
    deny = set(deny)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in deny]


def round_doubles(df: DataFrame, places: int = 6, exact: dict[str, int] | None = None) -> DataFrame:
    """Round every double column and normalise -0.0 (for cross-engine comparison).

    ``exact`` overrides the places per column: compounded products of short
    decimals are exact decimals whose 7th digit is often a tie, so they are
    rounded past their last digit instead.
    """
    exact = exact or {}
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            p = exact.get(f.name, places)
            out.append((F.round(F.col(f.name).cast("double"), p) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (list, tuple)):
        return list(x)
    return [x]


def md5_number(key, seed: int) -> Column:
    """A number from 0 to 2**32 - 1 by the MD5 of ``seed:key``; NULL for a NULL key."""
    text = F.concat(F.lit(f"{seed}:"), col(key).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
