"""Validation gates (leakage, match rate, null rates, minimum sizes).

Every gate has two forms:

* an **inline** form: a column expression that raises inside the job that
  computes the data (``raise_error``), so checking costs no extra pass;
* a **table** form: one aggregate producing ``(scope, rule, value, limit, ok)``
  rows, which :func:`enforce` turns into an exception on the driver. Only the
  tiny aggregate result reaches the driver.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage.functions.core import as_list


class GateError(RuntimeError):
    pass


def leakage_guarded(value: Column, known_at: str, as_of: str, what: str = "LEAKAGE") -> Column:
    """``value``, or a runtime error when ``known_at > as_of`` on that row (B6 inline)."""
    bad = F.col(known_at) > F.col(as_of)
    return F.when(bad, F.raise_error(F.concat(
        F.lit(f"{what}: {known_at} > {as_of} at "), F.col(known_at).cast("string"),
        F.lit(" > "), F.col(as_of).cast("string")))).otherwise(value)


def leakage_table(df: DataFrame, known_at: str, as_of: str) -> DataFrame:
    """B6 table form: number of rows whose ``known_at`` lies after ``as_of``."""
    return df.agg(F.count_if(F.col(known_at) > F.col(as_of)).cast("double").alias("value")).select(
        F.lit("all").alias("scope"), F.lit("LEAKAGE").alias("rule"), "value",
        F.lit(0.0).alias("limit"), (F.col("value") <= 0).alias("ok"))


def match_rate_table(df: DataFrame, resolved_col: str, min_rate: float = 0.95) -> DataFrame:
    """Share of rows whose ``resolved_col`` is not null."""
    return df.agg(F.avg(F.col(resolved_col).isNotNull().cast("double")).alias("value")).select(
        F.lit("all").alias("scope"), F.lit("MATCH_RATE").alias("rule"),
        F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(min_rate).alias("limit"),
        (F.coalesce("value", F.lit(0.0)) >= min_rate).alias("ok"))


def require_match_rate(df: DataFrame, resolved_col: str, report: list[str], path: str, min_rate: float = 0.95) -> DataFrame:
    """``df`` itself where enough rows are resolved; else the ``report`` columns of every unresolved row
    are written to ``path`` (CSV with a header) before the error is raised. An empty table is not resolved."""
    rate = match_rate_table(df, resolved_col, min_rate).first()
    if not rate.ok:
        df.filter(F.col(resolved_col).isNull()).select(*report).write.mode("overwrite").option("header", "true").csv(path)
        raise GateError(f"{rate.value:.1%} of the rows have {resolved_col}, {min_rate:.0%} are needed; unresolved rows: {path}")
    return df


def null_rate_table(df: DataFrame, limits: dict[str, float], by: str | None = None) -> DataFrame:
    """Per ``by`` group (or overall) the null rate of each column vs its limit."""
    aggs = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in limits]
    g = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs).withColumn("_scope", F.lit("all"))
    scope = F.col(by).cast("string") if by else F.col("_scope")
    stack = F.explode(F.array(*[F.struct(F.lit(f"NULL_RATE:{c}").alias("rule"),
                                         F.col(c).alias("value"),
                                         F.lit(float(lim)).alias("limit")) for c, lim in limits.items()]))
    return (g.select(scope.alias("scope"), stack.alias("r"))
            .select("scope", "r.rule", "r.value", "r.limit",
                    (F.col("r.value") <= F.col("r.limit")).alias("ok")))


def min_count_table(df: DataFrame, min_rows: int, by: str | None = None,
                    rule: str = "MIN_ROWS") -> DataFrame:
    """At least ``min_rows`` rows (per ``by`` group or overall)."""
    g = df.groupBy(by).count() if by else df.agg(F.count(F.lit(1)).alias("count")).withColumn(by or "_s", F.lit("all"))
    scope = F.col(by).cast("string") if by else F.col("_s")
    return g.select(scope.alias("scope"), F.lit(rule).alias("rule"),
                    F.col("count").cast("double").alias("value"),
                    F.lit(float(min_rows)).alias("limit"),
                    (F.col("count") >= min_rows).alias("ok"))


def expected_columns(df: DataFrame, required: Iterable[str]) -> None:
    """B8 schema part: raise when required columns are missing (schema only, no job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise GateError(f"missing columns: {missing}")


def enforce(report: DataFrame) -> DataFrame:
    """Raise :class:`GateError` listing the failed rules; return the report otherwise.

    The report is a handful of rows, so collecting it is bounded.
    """
    failed = report.filter(~F.col("ok")).collect()
    if failed:
        msg = "; ".join(f"{r['rule']}[{r['scope']}]={r['value']} (limit {r['limit']})" for r in failed)
        raise GateError(msg)
    return report


def audit_by(df: DataFrame, by: str, key: str, null_cols: Iterable[str]) -> DataFrame:
    """Rows, distinct keys and null rates per group."""
    null_cols = as_list(list(null_cols))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(key).alias("n_keys"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"null_{c}") for c in null_cols])


def validate(df: DataFrame, by: str, required: Iterable[str], null_limits: dict[str, float],
             min_rows: int = 1) -> DataFrame:
    """Required columns present (schema check, raises), then one report
    table per ``by`` group with the row-count rule and every null-rate rule;
    pass it to :func:`enforce` to fail the run."""
    expected_columns(df, list(required) + [by] + list(null_limits))
    rep = min_count_table(df, min_rows, by)
    return rep.unionByName(null_rate_table(df, null_limits, by)) if null_limits else rep
