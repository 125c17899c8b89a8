"""Toxicity by multiple-instance learning: sentences judged from document labels.

A document is a bag of sentences. Each sentence has a score
p = sigmoid(bias + sum of its words' weights); a word's weight is the sum of the
hashed weights of the word itself and of its first 4 to 7 characters. The
document's score is the noisy-or 1 - prod(1 - p): one toxic sentence suffices.
Only document labels are needed to learn, by gradient descent on the noisy-or
likelihood with a proximal L1 step that leaves harmless words at zero. Weights
are not negative: a harmless word doesn't excuse a toxic one beside it. The
trained sentence scores then locate the offending sentences.

Learning reads at most ``docs_per_class`` labelled documents of each class,
those with the smallest id hash (a bounded sample for a classifier), in one
task; classes are weighted back to their share of all labelled documents.
Scoring covers every text as a whole.

Defined cases: a NULL or empty text has no sentence and scores the noisy-or of
nothing, 0. Labels that are NULL, and ids with two labels, teach nothing. With
no label of either class every score is 0. Rows that repeat stay repeated; ids
may be NULL. Extra columns are ignored.
"""
from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, StringType, StructField, StructType)

from vintage.llm.common import id_remainder, smallest_by_hash, written

BITS = 18
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6, 7)
MIN_WORDS = 5


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-cased word."""
    out = [zlib.crc32(f"w{word}".encode()) >> (32 - BITS)]
    out += [zlib.crc32(f"{n}{word[:n]}".encode()) >> (32 - BITS) for n in _PREFIXES if len(word) >= n]
    return out


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, distinct lower-cased words) of each sentence that holds a word.

    A sentence of fewer than MIN_WORDS words is taken together with the next one.
    """
    begin, at, words = 0, 0, []
    for m in [*_SENTENCE.finditer(text), None]:
        end = m.end() if m else len(text)
        words += _WORD.findall(text[at:end].lower())
        at = end
        if words and (len(words) >= MIN_WORDS or m is None):
            yield begin, end, list(dict.fromkeys(words))
            begin, words = end, []


@dataclass
class SentenceScorer:
    """Trained weights; word weights are remembered up to a fixed number."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.5
    remember: int = 200_000

    def __post_init__(self) -> None:
        self.words: dict[str, float] = {}

    def _word(self, word: str) -> float:
        w = float(self.weights[word_features(word)].sum())
        if len(word) <= 64:
            if len(self.words) >= self.remember:
                self.words.clear()
            self.words[word] = w
        return w

    def _logit(self, words: list[str]) -> float:
        get, z = self.words.get, self.bias
        for w in words:
            x = get(w)
            z += self._word(w) if x is None else x
        return z

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentence scores."""
        if not text:
            return 0.0
        z = np.array([self._logit(ws) for _, _, ws in sentences(text)], float)
        return float(-np.expm1(-np.logaddexp(0, z).sum()))

    def offending(self, text: str | None) -> list[tuple[str, float]]:
        """The sentences whose own score reaches the threshold, in order."""
        out = []
        for a, b, words in sentences(text or ""):
            p = float(1 / (1 + np.exp(-self._logit(words))))
            if p >= self.threshold:
                out.append((text[a:b].strip(), p))
        return out


def fit(texts: list[str], labels: np.ndarray, share: float, steps: int = 150, rate: float = 1.0,
        l1: float = 0.1) -> tuple[np.ndarray, float]:
    """(weights, bias) from document labels; ``share`` is the toxic share to weight the classes to.

    ``l1`` is in units of one toxic document's weight.
    """
    ids: dict[str, int] = {}
    f_id, f_word, word_of, doc_of, sizes = (array("i") for _ in range(5))
    for d, t in enumerate(texts):
        for _, _, ws in sentences(t):
            for w in ws:
                k = ids.setdefault(w, len(ids))
                if k == len(ids) - 1 and (not f_word or f_word[-1] != k):
                    own = word_features(w)
                    f_id.extend(own)
                    f_word.extend([k] * len(own))
                word_of.append(k)
            sizes.append(len(ws))
            doc_of.append(d)
    n_sent, n_word = len(sizes), len(ids)
    del ids
    dim = 1 << BITS
    if not n_sent:
        return np.zeros(dim), -20.0
    word_of, doc, f_word, f_id = map(np.asarray, (word_of, doc_of, f_word, f_id))
    sent = np.repeat(np.arange(n_sent, dtype=np.int32), np.asarray(sizes))
    used, f_id = np.unique(f_id, return_inverse=True)
    n_doc, y = len(texts), labels.astype(float)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) / n_doc
    l1 = l1 * float(weight[y == 1].max(initial=0.0))
    w, b = np.zeros(len(used)), -5.0
    g2, gb2 = np.full(len(used), 1e-8), 1e-8
    for _ in range(steps):
        ww = np.bincount(f_word, w[f_id], n_word)
        z = b + np.bincount(sent, ww[word_of], n_sent)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n_doc)
        whole = np.maximum(-np.expm1(log_none), 1e-12)
        slope = np.where(y == 1, -(1 - whole) / whole, 1.0) * weight
        gz = slope[doc] * p
        gw = np.bincount(word_of, gz[sent], n_word)
        g, gb = np.bincount(f_id, gw[f_word], len(used)), gz.sum()
        g2 += g * g
        gb2 += gb * gb
        step = rate / np.sqrt(g2)
        w -= step * g
        w = np.maximum(w - step * l1, 0)
        b -= rate * gb / np.sqrt(gb2)
    out = np.zeros(dim)
    out[used] = w
    return out, float(b)


def _fit_task(share: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by([("r", "ascending"), ("id", "ascending")])
        w, b = fit([x or "" for x in t.column("text").to_pylist()], t.column("y").to_numpy(), share)
        return pa.table({"weights": pa.array([w.astype("<f4").tobytes()]), "bias": pa.array([b])})
    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    docs_per_class: int) -> tuple[DataFrame, float]:
    """(id, y, r, text) to learn from, written, and the share of label 1 over all rows that may teach."""
    y = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
         .filter("y in (0, 1)").filter(id_remainder("id", 4) != 2)
         .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("hi")).filter("y = hi").drop("hi"))
    y = written(y.withColumn("r", F.xxhash64(F.lit("learn"), "id")), "labels")
    share = y.agg(F.avg("y")).first()[0]
    ids = F.broadcast(smallest_by_hash(y, ["y"], "r", "id", docs_per_class))  # 2 * docs_per_class rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id")
    return written(texts.groupBy("id", "y", "r").agg(F.min("text").alias("text")), "label-sample"), share or 0.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", docs_per_class: int = 2000) -> SentenceScorer:
    """A scorer from labels whose crc32(id) mod 4 is not 2."""
    s, share = labelled_sample(docs, labels, id_col, text_col, label_col, docs_per_class)
    if not 0 < share < 1:
        return SentenceScorer(np.zeros(1 << BITS), -np.inf)
    got = s.groupBy(F.lit(0).alias("all")).applyInArrow(_fit_task(share), "weights binary, bias double").first()
    if got is None:
        return SentenceScorer(np.zeros(1 << BITS), -np.inf)
    return SentenceScorer(np.frombuffer(got.weights, "<f4").astype(float), got.bias)


SCORED = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])
SPAN = ArrayType(StructType([StructField("sentence", StringType()), StructField("score", DoubleType())]))


def score_column(text: Column, scorer: SentenceScorer, spark, cut: float = 0.3) -> Column:
    """score and predicted (score >= cut) per text."""
    shared = spark.sparkContext.broadcast(scorer)  # 2**BITS weights

    @F.arrow_udf(SCORED)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = shared.value
        for t in texts:
            p = np.array([s.score(x.as_py()) for x in t], float)
            yield pa.StructArray.from_arrays([pa.array(p), pa.array((p >= cut).astype(np.int32))], names=SCORED.names)
    return run(text)


def offending_column(text: Column, scorer: SentenceScorer, spark) -> Column:
    """The offending sentences of each text with their scores."""
    shared = spark.sparkContext.broadcast(scorer)

    @F.arrow_udf(SPAN)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = shared.value
        for t in texts:
            yield pa.array([[{"sentence": a, "score": b} for a, b in s.offending(x.as_py())] for x in t],
                           pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())])))
    return run(text)


def scores(docs: DataFrame, scorer: SentenceScorer, id_col: str = "doc_id", text_col: str = "text",
           cut: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    held = F.coalesce(id_remainder(id_col, 4) == 2, F.lit(False))
    return docs.select(F.col(id_col), held.alias("held_out"),
                       score_column(F.col(text_col), scorer, docs.sparkSession, cut).alias("__s")).select(
        id_col, "held_out", "__s.score", "__s.predicted")
