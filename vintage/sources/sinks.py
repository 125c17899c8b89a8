"""Sinks, resume and guards.

Writes go through Spark's commit protocol (a task's output becomes visible
only when the job commits), so no half-written shard is ever read; resume is
set arithmetic on keys (left-anti), never a file probe per item.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, partition_cols: Sequence[str] = ("year",),
                      mode: str = "overwrite", dynamic: bool = True, compression: str = "zstd",
                      sort_within: Sequence[str] | None = None, spread_by: str | None = None,
                      files_per_partition: int = 1) -> None:
    """Partitioned Parquet; with ``dynamic`` only the partitions present in
    ``df`` are replaced. Rows are sorted within files by ``sort_within`` so
    min/max statistics prune later scans. ``files_per_partition`` writers share
    a partition, its rows dealt out by the hash of ``spread_by``."""
    out = df
    if sort_within:
        keys = [F.col(c) for c in partition_cols]
        if spread_by and files_per_partition > 1:
            keys.append(F.pmod(F.xxhash64(spread_by), F.lit(files_per_partition)))
        out = out.repartition(*keys).sortWithinPartitions(*sort_within)
    w = out.write.mode(mode).option("compression", compression)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.partitionBy(*partition_cols).parquet(path)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, None only where no such path exists; other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def existing_partitions(spark: SparkSession, path: str, col: str = "year") -> DataFrame:
    """Partition values already written under ``path`` (empty when nothing is there)."""
    found = read_if_there(spark, path)
    return spark.createDataFrame([], f"{col} int") if found is None else found.select(col).distinct()


def missing_partitions(wanted: DataFrame, present: DataFrame, col: str = "year") -> DataFrame:
    """B2: partitions still to compute (``wanted EXCEPT present``)."""
    return wanted.select(col).distinct().join(present.select(col), col, "left_anti")


def todo(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items not yet done (left-anti on the key)."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def done_only(index: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Index rows whose item is done (left-semi)."""
    return index.join(done.select(key).distinct(), key, "left_semi")


def long_enough(df: DataFrame, text_col: str, min_length: int = 500) -> DataFrame:
    """Keep texts of at least ``min_length`` characters."""
    return df.filter(F.length(text_col) >= min_length)


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Persist a result table (parquet, csv with header, or json); ``append``
    mode for experiment logs."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", "true")
    getattr(w, fmt)(path)


def append_run(df: DataFrame, path: str, run_id: str) -> bool:
    """Append ``df`` to the log at ``path`` as the rows of ``run_id``; False (and nothing
    written) where the log has that run. A run's rows are one partition and appear with its commit."""
    present = read_if_there(df.sparkSession, path)
    if present is not None and not present.filter(F.col("run_id") == run_id).isEmpty():
        return False
    write_partitioned(df.withColumns({"run_id": F.lit(run_id), "_run": F.lit(run_id)}), path, ("_run",))
    return True


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an append log, with their ``run_id``."""
    return spark.read.parquet(path).drop("_run")


def extend_log(path: str, run_id: str, new: DataFrame, key: str) -> bool:
    """F8: append the rows of ``new`` whose ``key`` the log doesn't hold; what it holds is read, not made again."""
    present = read_if_there(new.sparkSession, path)
    rows = new if present is None else todo(new, present, key)
    return append_run(rows, path, run_id)


def guard_clobber(spark: SparkSession, summary_path: str, flag_col: str = "synthetic",
                  writing_synthetic: bool = True) -> None:
    """Refuse to overwrite real artifacts with synthetic ones (reads the flag
    column of the existing summary, a few rows)."""
    if not writing_synthetic:
        return
    existing = read_if_there(spark, summary_path)
    if existing is None:
        return
    if flag_col in existing.columns and existing.filter(~F.col(flag_col)).limit(1).count() > 0:
        raise RuntimeError(f"refusing to overwrite real artifacts at {summary_path} with synthetic output")
