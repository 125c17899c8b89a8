"""Session helpers: one place that knows how a session is built and where
durable intermediate data goes.

Library functions never create a session; they take DataFrames and return
DataFrames. Only tests, ``bench.py`` and command-line entry points call
:func:`get_spark`.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "vintage", cpus: int | str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Local session tuned for the small scale factors used in tests/bench.

    On a cluster the session comes from the platform; nothing here is needed
    there except :func:`checkpoint_dir`, which reads the cluster's setting.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", os.environ.get("VINTAGE_DRIVER_MEMORY", "16g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.python.worker.reuse", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("vintage.text.partitions", str(spark.sparkContext.defaultParallelism))  # small files of one row group
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``vintage`` importable on executors: zip the package once and add it
    with ``addPyFile`` (Python UDFs reference its functions by module)."""
    sc = spark.sparkContext
    if getattr(sc, "_vintage_shipped", False):
        return
    import shutil
    pkg_root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = tempfile.mkdtemp(prefix="vintage-pkg-")
    archive = shutil.make_archive(os.path.join(out, "vintage"), "zip", root_dir=pkg_root, base_dir="vintage")
    sc.addPyFile(archive)
    sc._vintage_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    Reads ``spark.checkpoint.dir`` (the cluster's shared storage). Only when it
    is unset *and* the master is local (tests, bench) is a scratch folder made.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    d = tempfile.mkdtemp(prefix="vintage-ckpt-", dir=os.environ.get("VINTAGE_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, name: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor recomputes from the written table, not from
    the sources) and lets later actions reuse the result.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name or 't'}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
