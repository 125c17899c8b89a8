"""Table sources: Parquet scans with partition pruning, windowed scans and
parallelism for CPU-heavy per-row work."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.functions.core import md5_number


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A1: read every Parquet file/partition under ``path`` (partition discovery);
    fail fast when nothing is there."""
    df = spark.read.parquet(path)
    if not df.columns:
        raise FileNotFoundError(f"no parquet shards under {path}")
    return df.select(*columns) if columns else df


def scan_window(spark: SparkSession, path: str, date_col: str, start: str, end: str,
                columns: Sequence[str] | None = None, year_col: str | None = "year") -> DataFrame:
    """A2: rows with ``start <= date <= end`` from a ``year=``-partitioned table.

    The predicate is stated on the partition column *and* the date, so
    partitions outside the years are pruned at listing time and row groups
    by min/max statistics; only ``columns`` are read.
    """
    df = read_table(spark, path)
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    cond = F.col(date_col).between(s, e)
    if year_col and year_col in df.columns:
        cond = F.col(year_col).between(F.year(s), F.year(e)) & cond
    out = df.filter(cond)
    return out.select(*columns) if columns else out


def common_years(a: DataFrame, b: DataFrame, year_col: str = "year", min_year: int | None = None) -> DataFrame:
    """A3: years present in both inputs (and >= ``min_year``)."""
    y = a.select(year_col).distinct().intersect(b.select(year_col).distinct())
    return y.filter(F.col(year_col) >= min_year) if min_year is not None else y


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin repartition to ``partitions``, for CPU-heavy per-row work on
    files of few row groups; None leaves the scan as it is (the normal case for
    large tables, whose splits are many)."""
    return df if partitions is None else df.repartition(partitions)


def repeatable_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A deterministic sample of ``n`` rows (hash order, re-runnable)."""
    return df.orderBy(md5_number(key, seed), F.col(key)).limit(n)
