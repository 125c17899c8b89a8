"""A few registered queries against their DuckDB SQL on the smallest tables."""
from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

TABLES = "lineitem orders supplier events documents embeddings pages labels".split()
SMOKE = ["pit_asof", "membership_intervals", "capped_weights", "refilter_documents", "stockday_vectors",
         "crosswalk_resolve", "ranking_metrics"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _normalised(pdf):
    import importlib.util
    import os
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools", "check_oracle.py")
    spec = importlib.util.spec_from_file_location("check_oracle", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod._norm(pdf)


@pytest.mark.parametrize("name", SMOKE)
def test_query_matches_sql(spark, con, name):
    got = _normalised(entry.queries()[name](spark, SF_SMALL).toPandas())
    exp = _normalised(con.execute(entry.oracle_sql()[name]).fetchdf())
    assert list(got.columns) == list(exp.columns)
    assert got.values.tolist() == exp.values.tolist()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "fund_age_days" in df.columns
