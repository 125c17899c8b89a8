"""Walk-forward runs that resume (B2, A13, I7): stored models and a completion log.

Every (variant, walk) has its own partition in two tables under one folder:
``models`` holds the fitted model as text, ``log`` the walk's result row. The
model is written first, the log row last, each by Spark's commit protocol, so a
logged walk always has its model. A run reads the log and computes what is
missing; a walk that was cut off after its model is scored from the stored one
and not fitted again. The log row carries a key of everything the fit depends on
(parameters, features, dates), so other settings are computed anew, in place.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.sources.sinks import read_if_there, write_partitioned


@dataclass
class Run:
    """What a run did: the result rows of all walks, and the walks it fitted, scored and found done."""

    results: DataFrame
    fitted: list[int]
    scored: list[int]
    kept: list[int]


def run_key(**parts) -> str:
    """Key of a walk's settings."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def _stored(spark: SparkSession, path: str, variant: str, columns: Sequence[str]) -> dict[int, dict]:
    """Rows of one variant by walk (one small row per walk)."""
    found = read_if_there(spark, path)
    if found is None:
        return {}
    rows = found.filter(F.col("variant") == variant).select("walk_id", *columns).collect()
    return {int(r.walk_id): r.asDict() for r in rows}


def stored_model(spark: SparkSession, store: str, variant: str, walk_id: int) -> str:
    """The stored model of a walk."""
    return read_if_there(spark, f"{store}/models").filter((F.col("variant") == variant) & (F.col("walk_id") == walk_id)).first().model


def run_walks(spark: SparkSession, walks: Sequence[int], store: str, variant: str, key_of: Callable[[int], str],
              fit: Callable[[int], str], evaluate: Callable[[int, str], dict[str, float]]) -> Run:
    """Fit and evaluate the walks that ``store`` lacks.

    ``fit(walk)`` returns a model as text, ``evaluate(walk, model)`` its numbers.
    """
    log, models = f"{store}/log", f"{store}/models"
    done = {w: r for w, r in _stored(spark, log, variant, ["key"]).items()}
    have = {w: r for w, r in _stored(spark, models, variant, ["key"]).items()}
    fitted, scored, kept = [], [], []
    for w in walks:
        key = key_of(w)
        if done.get(w, {}).get("key") == key:
            kept.append(w)
            continue
        if have.get(w, {}).get("key") == key:
            model = stored_model(spark, store, variant, w)
        else:
            model = fit(w)
            row = spark.createDataFrame([(key, model, variant, w)], "key string, model string, variant string, walk_id int")
            write_partitioned(row.coalesce(1), models, ("variant", "walk_id"))
            fitted.append(w)
        scored.append(w)
        numbers = {k: None if v is None else float(v) for k, v in evaluate(w, model).items()}
        row = spark.createDataFrame([(key, numbers, variant, w)], "key string, numbers map<string,double>, variant string, walk_id int")
        write_partitioned(row.coalesce(1), log, ("variant", "walk_id"))
    out = read_if_there(spark, log)
    out = out.filter((F.col("variant") == variant) & F.col("walk_id").isin([int(w) for w in walks]))
    return Run(out.select(F.col("walk_id").cast("int").alias("walk_id"), F.col("variant").cast("string").alias("variant"), "numbers"),
               fitted, scored, kept)
