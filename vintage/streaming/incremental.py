"""Incremental (resumable) processing with Structured Streaming (L1-L3).

The reference resumes batch jobs by probing which outputs exist. Here the
streaming checkpoint records what was processed: re-running a query with
``trigger(availableNow=True)`` handles only new input files, and a lost
executor or driver restart resumes from the checkpoint.

Sinks and checkpoints live under the session's shared checkpoint folder.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vintage.operators.text import clean_text
from vintage.session import checkpoint_dir


def stream_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh ``(sink, checkpoint)`` folders for a named stream."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:10]}"
    return f"{base}/out", f"{base}/_checkpoint"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files: int | None = None, glob: str | None = None) -> DataFrame:
    """New files of the folder ``path`` (optionally only names matching ``glob``)
    as a stream (schema given: no inference on a stream)."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def run_available(df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                  output_mode: str = "append") -> StreamingQuery:
    """Process everything available now, then stop (resumable via ``checkpoint``)."""
    q = (df.writeStream.format(fmt).outputMode(output_mode).option("checkpointLocation", checkpoint)
         .option("path", sink).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# --------------------------------------------------------------------------- #
# L1 — incremental cleaning of new documents
# --------------------------------------------------------------------------- #
def clean_new_documents(stream: DataFrame, key: str, text: str, min_length: int | None = None,
                        entities: str = "full") -> DataFrame:
    """L1: the stateless cleaner (G1-G3) applied to a stream of documents."""
    out = stream.select(key, clean_text(text, entities=entities).alias("clean_text"))
    out = out.withColumn("n_chars", F.length("clean_text"))
    return out.filter(F.col("n_chars") >= min_length) if min_length else out


# --------------------------------------------------------------------------- #
# batches of one log
# --------------------------------------------------------------------------- #
def _run_batches(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    q = (df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def _write_batch(df: DataFrame, sink: str, batch_id: int) -> None:
    """One folder per batch: a repeated batch replaces its own rows and adds none."""
    df.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/_batch={batch_id}")


def _begin_log(like: DataFrame, sink: str) -> None:
    """A batch without rows, so that a log without input can be read."""
    path = f"{sink.rstrip('/')}/_batch=-1"
    like.sparkSession.createDataFrame([], like.schema).write.mode("ignore").parquet(path)


def read_log(spark: SparkSession, sink: str) -> DataFrame:
    """All rows of a batch log, with their ``_batch``."""
    return spark.read.option("basePath", sink).parquet(sink)


# --------------------------------------------------------------------------- #
# L2 — duplicate-safe ingestion
# --------------------------------------------------------------------------- #
#: Settings of a query with much keyed state: on disk, and only changes are written per batch.
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """The settings of :data:`_STATE` for queries that start inside."""
    old = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_dedupe(stream: DataFrame, keys, sink: str, checkpoint: str) -> StreamingQuery:
    """L2: append the rows whose key no earlier batch wrote, one row per key.

    The keys are the query's state, partitioned by their hash, with no time
    limit; a batch looks up its own keys and writes its changes, so its cost does
    not grow with what was written before. The result has every key once however
    many files a batch takes. NULL keys are equal. Of rows with one key in a
    batch, any one stays.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    _begin_log(stream, sink)
    with _keyed_state(stream.sparkSession):
        return _run_batches(stream.dropDuplicates(keys), checkpoint, lambda batch, i: _write_batch(batch, sink, i))


# --------------------------------------------------------------------------- #
# L3 — trailing event count
# --------------------------------------------------------------------------- #
def run_daily_counts(stream: DataFrame, key: str, event_time: str, sink: str, checkpoint: str) -> StreamingQuery:
    """L3, first half: events per (key, day) of each batch, added to the log.

    Counts add up, so late rows count like any other and the result does not
    depend on how the files fall into batches. Days are calendar days of the
    timestamps as they read, whatever the session time zone is.
    """
    def daily(events: DataFrame) -> DataFrame:
        day = F.to_date(F.col(event_time)).alias("_day")
        return events.select(key, day).groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(daily(batch), sink, batch_id)

    _begin_log(daily(stream), sink)
    return _run_batches(stream, checkpoint, write)


def trailing_counts(spark: SparkSession, sink: str, key: str, days: int = 7) -> DataFrame:
    """L3, second half: (key, date, n), the events of [date - days, date] (D9), for dates with any.

    An event counts on ``days + 1`` dates; one without a day counts as often, with date NULL.
    The counts of a key go by blocks of days, and a day near the end of its block to the next one
    too: so one shuffle of the log serves both sums, and the ``days + 1`` dates are made behind it.
    """
    size = 4 * (days + 1)

    def block(d) -> Column:
        return F.floor(F.unix_date(d) / F.lit(size))

    blocks = F.array_distinct(F.array(block(F.col("_day")), block(F.date_add("_day", days))))
    log = read_log(spark, sink).select(key, "_day", "_n", F.explode(blocks).alias("_block")).repartition(key, "_block")
    daily = log.groupBy(key, "_block", "_day").agg(F.sum("_n").alias("_n"))
    offsets = F.array(*[F.lit(i) for i in range(days + 1)])
    cover = daily.select(key, "_block", "_day", "_n", F.explode(offsets).alias("_i"))
    cover = cover.select(key, "_block", "_n", F.date_add("_day", F.col("_i")).alias("date"))
    cover = cover.filter(block(F.col("date")).eqNullSafe(F.col("_block")))
    return cover.groupBy(key, "_block", "date").agg(F.sum("_n").alias("n")).drop("_block")
