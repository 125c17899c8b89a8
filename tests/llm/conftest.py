from __future__ import annotations

import os

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("id", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("fp", T.DoubleType()),
    T.StructField("k", T.StringType()), T.StructField("keep_id", T.StringType()), T.StructField("votes", T.StringType()),
])


def rows(*docs):
    """(doc_id, text, lang, source) rows with the clashing columns filled in."""
    return [(*d, None, "x", 7, 0.5, "k", "y", "z") for d in docs]


EDGE = rows(
    (1, "the and of thing in that was", "en", "a"), (2, "the and of  thing in that was ", "en", "a"),
    (3, None, None, None), (4, "", "en", "b"), (5, " \t\n\x0b\x0c\r", "fr", "b"), (None, "the and of thing in that was", "en", "a"),
    (6, "x" * 70_000, "de", "a"), (7, "un dans le que est", "fr", None), (7, "un dans le que est", "fr", None),
    (8, "word " * 30_000, "en", "a"), (9, "!!! 123 ???", None, "c"), (10, " é́ \U0001F642 中文 \x00", "es", "c"),
)


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(EDGE, DOC).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF2}/documents.parquet").cache()


def duck(sf: str = SF2):
    """A DuckDB connection with the test tables as views."""
    import duckdb

    con = duckdb.connect()
    for t in ("benchmark", "documents", "embeddings", "pages", "conversations", "labels"):
        assert os.path.exists(f"{sf}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con
