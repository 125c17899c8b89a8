"""Quality classifier from weak labels.

Ten overlapping heuristics vote good, bad or nothing on every document. The
number of documents with each vote pattern (at most 3**10 patterns) is all that
expectation-maximisation needs: it estimates how often each heuristic is right
on good and on bad documents, and gives every pattern a posterior. These
posteriors are the soft labels on which a hashed linear scorer is trained; it
judges a text from its words' hashed features (the word and its shape, averaged
over the words) and a few hashed document features.

Votes and pattern counts cover all documents. The scorer learns from at most
``max_docs`` documents, those with the smallest id hash (a bounded sample for a
classifier), in one task. Scoring covers every text as a whole.

Defined cases: a NULL text counts as empty; a text without a word is bad by the
length rule and scored by its document features. With no document there is no
row. Rows that repeat stay repeated; ids may be NULL. Extra columns are ignored.
"""
from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField, StructType)

from vintage.llm.common import smallest_by_hash, written

BITS = 17
#: Characters of markup and code rather than prose.
_SYMBOLS = b"#$%&*|<>{}[]^~\\=_@+"
#: Common function words of English, German, French and Spanish.
_STOP_WORDS = frozenset("""the of and to in a is that for it on with as was by this are be or from
der die das und in zu den von ist mit ein eine im nicht auf sich
le la les de des et en un une du que est pour qui dans au par sur
el los las y del se por con para una su al""".split())
_DELETE_LOWER = bytes(range(97, 123))
_DELETE_UPPER = bytes(range(65, 91))
LABELLERS = ("symbols", "capitals", "exclamation", "variety", "lines", "function_words", "word_length", "sentences", "length", "repeats")


def measures(text: str) -> dict[str, float]:
    """What the heuristics look at."""
    raw = text.encode()
    words = text.split()
    n, size = len(words), max(1, len(raw))
    upper, lower = len(raw) - len(raw.translate(None, _DELETE_UPPER)), len(raw) - len(raw.translate(None, _DELETE_LOWER))
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "n": n,
        "symbols": (len(raw) - len(raw.translate(None, _SYMBOLS))) / size,
        "capitals": upper / max(1, upper + lower),
        "exclamation": text.count("!") / max(1, n),
        "variety": len(set(words)) / max(1, n),
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "function_words": sum(w in _STOP_WORDS for w in (x.lower().strip(".,;:!?") for x in words)) / max(1, n),
        "word_length": sum(map(len, words)) / max(1, n),
        "repeats": sum(map(str.__eq__, words, words[1:])) / max(1, n - 1),
        "sentences": len(re.findall(r"[.!?](?=\s|$)", text)) / max(1, n),
    }


def votes(m: dict[str, float]) -> str:
    """One character per heuristic: 1 good, 0 bad, - nothing."""
    def rule(bad: bool, good: bool) -> str:
        return "0" if bad else "1" if good else "-"

    enough = m["n"] >= 20
    return "".join([
        rule(m["symbols"] > 0.04, m["symbols"] < 0.01),
        rule(m["capitals"] > 0.3, m["capitals"] < 0.1),
        rule(m["exclamation"] > 0.2, m["exclamation"] < 0.05),
        rule(enough and m["variety"] < 0.2, enough and m["variety"] > 0.4),
        rule(m["lines"] > 0.3, m["lines"] < 0.1),
        rule(enough and m["function_words"] < 0.03, m["function_words"] > 0.1),
        rule(enough and not 2 <= m["word_length"] <= 15, 3 <= m["word_length"] <= 11),
        rule(enough and not 0.004 <= m["sentences"] <= 0.5, enough and 0.01 <= m["sentences"] <= 0.35),
        rule(m["n"] < 3, m["n"] >= 8),
        rule(m["repeats"] > 0.1, m["repeats"] < 0.05),
    ])


def vote_column(text: Column) -> Column:
    """The vote pattern of each text."""
    @F.arrow_udf(StringType())
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array([votes(measures(x.as_py() or "")) for x in t], pa.string())
    return run(text)


@dataclass
class LabelModel:
    """Estimated accuracies and the posterior of good for each vote pattern."""

    prior: float
    right_good: np.ndarray  # P(votes good | good, votes)
    right_bad: np.ndarray  # P(votes bad | bad, votes)
    posterior: dict[str, float]


def estimate(patterns: list[str], counts: np.ndarray, steps: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and their numbers of documents.

    Heuristics are detectors of one fault each: they rarely call a good text bad
    and see only some of the bad ones. EM starts there (99 % right on good, 30 %
    on bad texts), and a weak prior keeps a heuristic without votes there.
    """
    v = np.array([[{"1": 1, "0": 0, "-": -1}[c] for c in p] for p in patterns]).reshape(len(patterns), len(LABELLERS))
    good, bad = (v == 1).astype(float), (v == 0).astype(float)
    tg, tb = np.full(len(LABELLERS), 0.99), np.full(len(LABELLERS), 0.3)
    prior, post = 0.8, np.zeros(len(patterns))
    for _ in range(steps):
        lg = np.log(prior) + good @ np.log(tg) + bad @ np.log(1 - tg)
        lb = np.log(1 - prior) + bad @ np.log(tb) + good @ np.log(1 - tb)
        post = 1 / (1 + np.exp(np.clip(lb - lg, -500, 500)))
        wg, wb = counts * post, counts * (1 - post)
        tg = np.clip((wg @ good + 9.9) / (wg @ (good + bad) + 10), 0.02, 0.999)
        tb = np.clip((wb @ bad + 3) / (wb @ (good + bad) + 10), 0.02, 0.999)
        new = float(np.clip((wg.sum() + 8) / (counts.sum() + 10), 0.01, 0.99))
        if abs(new - prior) < 1e-10:
            break
        prior = new
    return LabelModel(prior, tg, tb, dict(zip(patterns, post.tolist())))


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) >> (32 - BITS)


def _shape(word: str) -> str:
    """Runs of upper, lower, digit and other characters."""
    out = ""
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out.endswith(k):
            out += k
    return out[:12]


def word_features(word: str) -> tuple[int, int]:
    """Hashed features of one word."""
    return _hash(f"w{word.lower()}"), _hash(f"s{_shape(word)}")


def document_features(m: dict[str, float]) -> list[int]:
    """Hashed features of the whole text: binned measures."""
    bins = {"n": np.log2(m["n"] + 1), "variety": m["variety"] * 10, "lines": m["lines"] * 5,
            "function_words": min(m["function_words"], 0.5) * 20, "sentences": min(m["sentences"], 1) * 10, "repeats": m["repeats"] * 10}
    return [_hash(f"d{k}{int(x)}") for k, x in bins.items()]


@dataclass
class LinearScorer:
    """Hashed weights; word weights are remembered up to a fixed number."""

    weights: np.ndarray
    bias: float
    remember: int = 200_000

    def __post_init__(self) -> None:
        self.words: dict[str, float] = {}

    def _word(self, word: str) -> float:
        w = float(self.weights[list(word_features(word))].sum())
        if len(word) <= 64:
            if len(self.words) >= self.remember:
                self.words.clear()
            self.words[word] = w
        return w

    def score(self, text: str | None) -> float:
        """Probability of good."""
        m = measures(text or "")
        get, z, words = self.words.get, 0.0, (text or "").split()
        for w in words:
            x = get(w)
            z += self._word(w) if x is None else x
        z = z / max(1, len(words)) + self.bias + float(self.weights[document_features(m)].sum()) / 2
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(texts: list[str], good: np.ndarray, steps: int = 120, rate: float = 0.5, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """(weights, bias) of the linear scorer from soft labels, by full-batch Adagrad on the logistic loss."""
    ids: dict[str, int] = {}
    feats, word_of, doc_of, share = array("i"), array("i"), array("i"), array("d")
    f_doc, f_id = array("i"), array("i")
    for d, t in enumerate(texts):
        ws = t.split()
        for w, c in Counter(ws).items():
            k = ids.setdefault(w, len(ids))
            if 2 * k == len(feats):
                feats.extend(word_features(w))
            word_of.append(k)
            doc_of.append(d)
            share.append(c / len(ws))
        for x in document_features(measures(t)):
            f_doc.append(d)
            f_id.append(x)
    dim, n = 1 << BITS, len(texts)
    w, b, g2, gb2 = np.zeros(dim), 0.0, np.full(dim, 1e-8), 1e-8
    word_of, doc_of, share, f_doc, f_id = map(np.asarray, (word_of, doc_of, share, f_doc, f_id))
    table = np.asarray(feats).reshape(-1, 2)
    for _ in range(steps):
        ww = w[table].sum(axis=1)
        z = b + np.bincount(doc_of, ww[word_of] * share, n) + np.bincount(f_doc, w[f_id], n) / 2
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good) / n
        gw = np.bincount(word_of, e[doc_of] * share, len(table))
        g = np.bincount(table[:, 0], gw, dim) + np.bincount(table[:, 1], gw, dim) if len(table) else np.zeros(dim)
        g = g + np.bincount(f_id, e[f_doc] / 2, dim) + l2 * w
        g2 += g * g
        gb2 += e.sum() ** 2
        w -= rate * g / np.sqrt(g2)
        b -= rate * e.sum() / np.sqrt(gb2)
    return w, float(b)


def _fit_task(key: tuple, table: pa.Table) -> pa.Table:
    t = table.sort_by([("r", "ascending"), ("id", "ascending")])
    w, b = fit([x or "" for x in t.column("text").to_pylist()], t.column("good").to_numpy())
    return pa.table({"weights": pa.array([w.astype("<f4").tobytes()]), "bias": pa.array([b])})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_docs: int = 5000) -> tuple[LabelModel, LinearScorer]:
    """The label model over all documents and the scorer learned from its posteriors."""
    spark = docs.sparkSession
    v = docs.select(F.col(id_col).cast("long").alias("id"), vote_column(F.col(text_col)).alias("votes"))
    v = written(v.withColumn("r", F.xxhash64(F.lit("quality"), "id")), "votes")
    rows = v.groupBy("votes").count().orderBy("votes").collect()  # one row per pattern
    model = estimate([r.votes for r in rows], np.array([r["count"] for r in rows], float))
    if not rows:
        return model, LinearScorer(np.zeros(1 << BITS), 0.0)
    soft = spark.createDataFrame([(p, x) for p, x in model.posterior.items()], "votes string, good double")
    ids = v.groupBy("r", "id").agg(F.min("votes").alias("votes")).withColumn("all", F.lit(0))
    ids = smallest_by_hash(ids, ["all"], "r", "id", max_docs).drop("all").join(F.broadcast(soft), "votes")
    texts = docs.select(F.col(id_col).cast("long").alias("tid"), F.col(text_col).alias("text"))
    ids = F.broadcast(ids)  # max_docs rows at most
    s = texts.join(ids, F.col("tid").eqNullSafe(F.col("id"))).groupBy("r", "id", "good").agg(F.min("text").alias("text"))
    got = (s.groupBy(F.lit(0).alias("all")).applyInArrow(_fit_task, "weights binary, bias double")).first()
    return model, LinearScorer(np.frombuffer(got.weights, "<f4").astype(float), got.bias)


SCORED = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])


def score_column(text: Column, scorer: LinearScorer, spark, cut: float = 0.5) -> Column:
    """score and predicted (1: good, score >= cut) per text."""
    shared = spark.sparkContext.broadcast(scorer)  # 2**BITS weights

    @F.arrow_udf(SCORED)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = shared.value
        for t in texts:
            p = np.array([s.score(x.as_py()) for x in t], float)
            yield pa.StructArray.from_arrays([pa.array(p), pa.array((p >= cut).astype(np.int32))], names=SCORED.names)
    return run(text)


def scores(docs: DataFrame, scorer: LinearScorer, id_col: str = "doc_id", text_col: str = "text",
           cut: float = 0.5) -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    return docs.select(F.col(id_col), score_column(F.col(text_col), scorer, docs.sparkSession, cut).alias("__s")).select(
        id_col, "__s.score", "__s.predicted")
