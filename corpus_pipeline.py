"""Corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of ``documents``. :func:`run` writes every stage's rows to
the shared checkpoint folder as Parquet and hands the reread table to the next,
so a lost executor repeats at most the tasks of one stage.

1. language_id: documents that no language model accepts go (also those without a letter).
2. exact_dedup: one document of each group of equal texts stays.
3. near_dedup: one document of each SimHash component stays (3-word shingles, 3 bits).
4. mixing: sources are brought to weights 3, 1, 2, ... at 150 % of all words; a document may come twice.
5. bpe: every remaining text as token ids.

An empty table passes through all stages. Rows with NULL text go at stage 1.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm import bpe, exact_dedup, langid, mixing, simhash
from vintage.llm.common import prepare, table, written
from vintage.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents teach."""
    prepare(spark)
    return langid.drop_rejected(docs, langid.train(docs))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=3)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    prepare(spark)
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digests of ids and decoded text."""
    prepare(spark)
    fields = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    encoded = bpe.encode_column(F.col("text"), tokenizer_path(), fields)
    return docs.select("doc_id", "source", encoded.alias("__e")).select("doc_id", "source", "__e.*")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_deduplication),
    ("near_dedup", near_deduplication),
    ("mixing", source_mixing),
    ("bpe", tokens),
]

#: SQL can state neither the language models, nor XXH64, nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
