"""Shared pieces of the operators: table access, hand-offs and row rules."""
from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintage.session import materialize, ship_package

#: ASCII white space of the text contracts: space, tab, line feed, vertical tab, form feed, return.
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Bytes and rows of one Arrow batch at most.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2048

#: Rows of a few numbers that make one file of a hand-off.
FILE_ROWS = 1 << 18


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors and keep the Arrow batches of text functions small.

    A batch is held by the JVM and by Python at once, and the JVM also holds the
    other columns of its rows; at the defaults (64 MB, 10,000 rows) and two
    tasks an executor that is a large part of its memory.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back."""
    return materialize(df, name)


def in_few(slim: DataFrame, rows: int) -> DataFrame:
    """``slim``, of about ``rows`` rows of a few numbers, in as many partitions as these need.

    At least one per core; never more than ``slim`` has. Each task that writes
    opens files and, on a local file system, starts processes for them, so a
    table of few rows should not come in as many files as the shuffle has
    partitions.
    """
    return slim.coalesce(max(slim.sparkSession.sparkContext.defaultParallelism, ceil(rows / FILE_ROWS)))


def id_remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; NULL for a NULL id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(mod)


def smallest_by_hash(ids: DataFrame, by: list[str], hashed: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of each group with the smallest hash (as unsigned numbers), ties by ``key``.

    Counts per group and hash bucket tell which of 4,096 buckets matter; only
    their rows are ranked, so a group that holds most rows is not gathered.
    """
    b = ids.withColumn("__b", F.shiftrightunsigned(hashed, 52))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = b.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    needed = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    needed = needed.filter(F.col("__before") < k).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__b").alias("__c"))
    same = F.col("__b") == F.col("__c")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("__b", hashed, key))
    found = b.join(needed, same).select(*b.columns).withColumn("__k", rank).filter(F.col("__k") <= k)
    return found.drop("__b", "__k")


def join_listed(rows: DataFrame, listed: DataFrame, same: Column, keys: list[str], times: str) -> DataFrame:
    """The ``rows`` that a slim table lists, once per listed key.

    ``listed`` is a written table with one row per key; ``times`` says how often
    the key occurs in ``rows``. Its side is hashed, so the wide rows are not
    sorted. Only keys that repeat need another pass, which is left out where no
    key does.
    """
    once = rows.join(listed.filter(F.col(times) == 1).hint("shuffle_hash"), same)
    if listed.filter(F.col(times) > 1).isEmpty():
        return once
    more = rows.join(listed.filter(F.col(times) > 1).hint("shuffle_hash"), same).dropDuplicates(keys)
    return once.unionByName(more)
