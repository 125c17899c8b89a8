"""Listwise ranking by boosted trees (I2): pairwise gradients weighted by the change of NDCG@k.

Two rows of a date whose labels differ push each other by the logistic loss of
their score difference, times what swapping their places changes in NDCG@k.
Places beyond k have no discount, so a pair where neither row is among the k
best scores changes nothing. Every other pair holds one of these k rows: each row
meets its date's k best in one joined row, so a date of any width is split over
tasks, and no task sees all pairs or all rows of a date.

A round of boosting is: the k best per date, the gradients (written once), then
a histogram of gradients per (leaf, feature, bin) and level. Each task sums its
rows into one histogram, whose size is leaves x features x bins; these are added
by Spark, and the best split of each leaf is found by windows over its bins. Only
one row per leaf comes to the driver. Features are binned once, to a byte each;
a missing value is a bin of its own and goes to the side that gains more. The
rows themselves are never changed: scores are recomputed from the trees.
"""
from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from vintage.operators.ranking import ndcg_by_group
from vintage.session import materialize

#: Parameters of a fit and their values unless given.
DEFAULTS = dict(num_leaves=31, max_depth=6, learning_rate=0.05, n_estimators=500, early_stopping_rounds=50,
                feature_fraction=0.9, bagging_fraction=0.9, bagging_freq=5, min_data_in_leaf=50, lambda_l2=1.0,
                sigma=1.0, seed=42)

# ------------------------------------------------------------------- gradients


def with_ideal(df: DataFrame, group: str, label: str, entity: str, k: int) -> DataFrame:
    """``ideal``: the DCG@k of the group's labels in the best order."""
    w = Window.partitionBy(group).orderBy(F.col(label).desc(), F.col(entity))
    best = df.filter(F.col(label).isNotNull()).select(group, entity, label).withColumn("_r", F.row_number().over(w))
    gain = F.pow(F.lit(2.0), F.col(label).cast("double")) - 1.0
    ideal = best.filter(F.col("_r") <= k).groupBy(group).agg(F.sum(gain / F.log2(F.col("_r") + 1.0)).alias("ideal"))
    return df.join(ideal, group)


def _pairs(sigma: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gradients of rows that carry their date's best rows, and what rows outside give to each of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            y, s, ideal = (b[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("y", "s", "ideal"))
            rank = b["r"].to_numpy(zero_copy_only=False)
            m = b["top"].value_lengths().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(n), m)
            top = b["top"].flatten()
            ty, ts = (top.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("y", "s"))
            tr = top.field("r").to_numpy(zero_copy_only=False)
            # discounts; a rank of 0 says that the row isn't among the best
            d, td = np.where(rank > 0, 1 / np.log2(np.maximum(rank, 1) + 1.0), 0.0), 1 / np.log2(tr + 1.0)
            side = np.sign(y[of] - ty)
            weight = np.where(ideal[of] > 0, np.abs(2.0 ** y[of] - 2.0 ** ty) * np.abs(d[of] - td) / np.where(ideal > 0, ideal, 1.0)[of], 0.0)
            rho = 1 / (1 + np.exp(np.clip(sigma * side * (s[of] - ts), -700, 700)))
            g, h = -side * sigma * rho * weight, sigma * sigma * rho * (1 - rho) * weight * np.abs(side)
            own_g, own_h = np.bincount(of, g, n), np.bincount(of, h, n)
            # outside rows also push the best rows: one sum per best row of a date in this batch
            out = rank[of] == 0
            group = b["g"].dictionary_encode()
            code = group.indices.to_numpy(zero_copy_only=False).astype(np.int64)[of] * (int(m.max()) + 1) + tr
            keys, first, where = np.unique(code[out], return_index=True, return_inverse=True)
            pushed = np.flatnonzero(out)[first]
            e = top.field("e").take(pa.array(pushed))
            cols = {"g": pa.concat_arrays([b["g"], b["g"].take(pa.array(of[pushed]))]),
                    "e": pa.concat_arrays([b["e"], e]),
                    "grad": pa.array(np.concatenate([own_g, np.bincount(where, -g[out], len(keys))])),
                    "hess": pa.array(np.concatenate([own_h, np.bincount(where, h[out], len(keys))])),
                    "best": pa.array(np.concatenate([rank > 0, np.ones(len(keys), bool)])),
                    "bins": pa.concat_arrays([b["bins"], pa.nulls(len(keys), pa.binary())])}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def pair_gradients(df: DataFrame, group: str, entity: str, label: str, score: str, k: int = 30,
                   sigma: float = 1.0, bins: Column | None = None) -> DataFrame:
    """g, e, grad, hess and bins of each row: first and second derivative of the ranking loss by its score.

    Rows are unique on (``group``, ``entity``). Ties in score stand in the order
    of ``entity``. Groups without a positive label have zero gradients. An
    ``ideal`` column (:func:`with_ideal`) is used where there is one.
    """
    x = df if "ideal" in df.columns else with_ideal(df, group, label, entity, k)
    rows = x.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).select(
        F.col(group).alias("g"), F.col(entity).alias("e"), F.col(label).cast("double").alias("y"),
        F.col(score).cast("double").alias("s"), "ideal", (F.lit(None).cast("binary") if bins is None else bins).alias("bins"))
    w = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("e"))
    top = rows.select("g", "e", "y", "s").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    top = top.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("r", "e", "y", "s"))).alias("top"))
    met = rows.join(top, "g")
    place = F.coalesce(F.get(F.filter("top", lambda t: t["e"] == F.col("e")), 0)["r"], F.lit(0))
    met = met.select("g", "e", "y", "s", "ideal", "bins", place.alias("r"), "top")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("g", "e")}
    raw = materialize(met.mapInArrow(_pairs(sigma), f"g {kind['g']}, e {kind['e']}, grad double, hess double, best boolean, bins binary"),
                      "pair_gradients")
    best = raw.filter("best").groupBy("g", "e").agg(F.sum("grad").alias("grad"), F.sum("hess").alias("hess"), F.max("bins").alias("bins"))
    return raw.filter("NOT best").select("g", "e", "grad", "hess", "bins").unionByName(materialize(best, "pair_gradients"))


# ----------------------------------------------------------------------- model


@dataclass
class Tree:
    """Nodes of one tree; node 0 is the root, a feature of -1 marks a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int, missing_left: bool, gain: float) -> tuple[int, int]:
        """Turn a leaf into a node with two leaves."""
        n = len(self.feature)
        self.feature[node], self.bin[node], self.missing_left[node], self.gain[node] = feature, bin, missing_left, gain
        self.left[node], self.right[node] = n, n + 1
        for _ in range(2):
            for values, empty in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, 0),
                                  (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
                values.append(empty)
        return n, n + 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of binned features."""
        feature, cut, missing = (np.array(x) for x in (self.feature, self.bin, self.missing_left))
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(len(bins), np.int64)
        while True:
            f = feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return node
            at = node[inner]
            x = bins[inner, f[inner]]
            go_left = np.where(x == 0, missing[at], x <= cut[at])
            node[inner] = np.where(go_left, left[at], right[at])


@dataclass
class RankModel:
    """Binning edges and trees; ``history`` is the validation NDCG after each tree."""

    features: list[str]
    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    @property
    def best_iteration(self) -> int:
        """Trees up to the best validation NDCG (all where there was no validation)."""
        return int(np.argmax(self.history)) + 1 if self.history else len(self.trees)

    def raw_scores(self, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees[:trees]:
            out += np.array(t.value)[t.leaves(bins)]
        return out

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Bins of feature values: 0 is missing, bin i ends at the i-th edge (included)."""
        out = np.zeros(values.shape, np.uint8)
        for f, e in enumerate(self.edges):
            known = ~np.isnan(values[:, f])
            out[known, f] = 1 + np.searchsorted(np.array(e), values[known, f], side="left")
        return out

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "edges": self.edges, "trees": [vars(t) for t in self.trees], "history": self.history})

    @classmethod
    def from_json(cls, text: str) -> RankModel:
        d = json.loads(text)
        return cls(d["features"], d["edges"], [Tree(**t) for t in d["trees"]], d["history"])


def _values(features: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def _matrix(a: pa.Array, width: int) -> np.ndarray:
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _bytes(a: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(a.to_pylist()), np.uint8).reshape(-1, width)


def bins_column(model: RankModel) -> Column:
    """A byte per feature of the row."""
    width = len(model.features)

    @F.arrow_udf(BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([r.tobytes() for r in model.binned(_matrix(a, width))], pa.binary())
    return run(_values(model.features))


def score_column(model: RankModel, trees: int | None = None) -> Column:
    """The model's score from feature columns, by default of its best iteration."""
    width, used = len(model.features), model.best_iteration if trees is None else trees

    @F.arrow_udf(DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array(model.raw_scores(model.binned(_matrix(a, width)), used))
    return run(_values(model.features))


def _binned_score(model: RankModel) -> Column:
    width = len(model.features)

    @F.arrow_udf(DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array(model.raw_scores(_bytes(a, width)) if len(a) else np.empty(0))
    return run(F.col("bins"))


def score_rank(df: DataFrame, model: RankModel) -> DataFrame:
    """``df`` with the model's ``score``; columns that the model has and ``df`` lacks count as missing."""
    missing = [F.lit(None).cast("double").alias(c) for c in model.features if c not in df.columns]
    return df.select("*", *missing).withColumn("score", score_column(model)).drop(*[c for c in model.features if c not in df.columns])


def gain_by_feature(model: RankModel) -> list[tuple[str, float]]:
    """The gain of each feature's splits over the trees in use, largest first."""
    total = dict.fromkeys(model.features, 0.0)
    for t in model.trees[:model.best_iteration]:
        for f, g in zip(t.feature, t.gain):
            if f >= 0:
                total[model.features[f]] += g
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))


# -------------------------------------------------------------------- boosting


def feature_edges(df: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """Upper edges of each feature's bins: approximate quantiles, one pass over the rows."""
    share = [i / max_bins for i in range(1, max_bins)]
    found = df.select([F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)]).agg(
        *[F.percentile_approx(F.when(~F.isnan(f"_{i}"), F.col(f"_{i}")), share, 10_000).alias(f"_{i}") for i in range(len(features))]).first()
    return [sorted(set(found[i] or [])) for i in range(len(features))]


def histograms(grads: DataFrame, tree: Tree, active: Sequence[int], used: Sequence[int], width: int, bins: int) -> DataFrame:
    """node, feature, bin, grad, hess, n: gradient sums of the leaves ``active``; a task gives one histogram."""
    slot = np.full(len(tree.feature), -1)
    slot[list(active)] = np.arange(len(active))
    used_at = np.array(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(active) * len(used) * bins
        total = np.zeros((3, size))
        for b in batches:
            if not b.num_rows:
                continue
            x = _bytes(b["bins"], width)
            at = slot[tree.leaves(x)]
            keep = np.flatnonzero(at >= 0)
            cell = (at[keep, None] * len(used) + np.arange(len(used))) * bins + x[keep][:, used_at]
            for row, w in ((0, b["grad"]), (1, b["hess"]), (2, None)):
                v = np.ones(len(keep)) if w is None else w.to_numpy()[keep]
                total[row] += np.bincount(cell.ravel(), np.repeat(v, len(used)), size)
        cells = np.flatnonzero(total[2])
        node, rest = np.divmod(cells, len(used) * bins)
        f, bin_ = np.divmod(rest, bins)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(active, np.int32)[node]), pa.array(used_at[f].astype(np.int32)), pa.array(bin_.astype(np.int32)),
             pa.array(total[0][cells]), pa.array(total[1][cells]), pa.array(total[2][cells].astype(np.int64))],
            names=["node", "feature", "bin", "grad", "hess", "n"])
    parts = grads.select("grad", "hess", "bins").mapInArrow(run, "node int, feature int, bin int, grad double, hess double, n long")
    # dealt by leaf and feature: the windows of best_splits need no other shuffle
    return parts.repartition("node", "feature").groupBy("node", "feature", "bin").agg(F.sum("grad").alias("grad"), F.sum("hess").alias("hess"), F.sum("n").alias("n"))


def best_splits(hist: DataFrame, min_data_in_leaf: int, lambda_l2: float) -> DataFrame:
    """Per node: its gradient sums and the split of most gain (NULL where none is allowed)."""
    whole = Window.partitionBy("node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist
    for c in ("grad", "hess", "n"):
        none = F.coalesce(F.sum(F.when(F.col("bin") == 0, F.col(c))).over(whole), F.lit(0))
        h = h.withColumns({f"{c}_all": F.sum(c).over(whole), f"{c}_none": none, f"{c}_upto": F.sum(c).over(upto)})
    h = h.withColumn("missing_left", F.explode(F.array(F.lit(True), F.lit(False))))
    left = {c: F.col(f"{c}_upto") - F.when(F.col("missing_left"), F.lit(0)).otherwise(F.col(f"{c}_none")) for c in ("grad", "hess", "n")}
    h = h.withColumns({f"{c}_left": left[c] for c in left})
    part = lambda g, q: g * g / (q + F.lit(float(lambda_l2) + 1e-12))
    gain = (part(F.col("grad_left"), F.col("hess_left")) + part(F.col("grad_all") - F.col("grad_left"), F.col("hess_all") - F.col("hess_left"))
            - part(F.col("grad_all"), F.col("hess_all")))
    fits = (F.col("n_left") >= min_data_in_leaf) & (F.col("n_all") - F.col("n_left") >= min_data_in_leaf) & (gain > 1e-12)
    fits = fits & ((F.col("bin") > 0) | (F.col("missing_left") & (F.col("n_none") > 0)))
    order = F.struct(F.round(gain, 10).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "missing_left",
                     "grad_left", "hess_left")
    return h.groupBy("node").agg(F.max("grad_all").alias("grad"), F.max("hess_all").alias("hess"), F.max("n_all").alias("n"),
                                 F.max(F.when(fits, order)).alias("best"))


def _grow(grads: DataFrame, width: int, bins: int, used: Sequence[int], p: dict) -> Tree:
    """One tree: level by level, the leaves of most gain first, until the leaves are used up."""
    tree, n_leaves = Tree(), 1
    sums: dict[int, tuple[float, float]] = {}
    active = [0]
    for _ in range(p["max_depth"]):
        rows = best_splits(histograms(grads, tree, active, used, width, bins), p["min_data_in_leaf"], p["lambda_l2"]).collect()  # a row per leaf
        sums |= {r.node: (r.grad, r.hess) for r in rows}
        active = []
        for r in sorted((r for r in rows if r.best is not None), key=lambda r: (-r.best.gain, r.node)):
            if n_leaves >= p["num_leaves"]:
                break
            lo, hi = tree.split(r.node, -r.best.f, -r.best.b, r.best.missing_left, r.best.gain)
            sums[lo] = (r.best.grad_left, r.best.hess_left)
            sums[hi] = (r.grad - r.best.grad_left, r.hess - r.best.hess_left)
            active += [lo, hi]
            n_leaves += 1
        if not active or n_leaves >= p["num_leaves"]:
            break
    for node, (g, h) in sums.items():
        if tree.feature[node] < 0:
            tree.value[node] = -p["learning_rate"] * g / (h + p["lambda_l2"] + 1e-12)
    return tree


@dataclass
class Prepared:
    """Binned train and val rows of one fit: what every fit with other parameters can share."""

    features: list[str]
    edges: list[list[float]]
    rows: DataFrame
    k: int
    bins: int
    validate: bool


def prepare_rank(frame: DataFrame, features: Sequence[str], group: str, entity: str, label: str, split: str = "split",
                 k: int = 30, max_bins: int = 63) -> Prepared:
    """Bin the train and val rows by the train rows' quantiles and write them once."""
    edges = feature_edges(frame.filter(F.col(split) == "train"), features, max_bins)
    rows = frame.filter(F.col(split).isin("train", "val") & F.col(label).isNotNull())
    rows = rows.select(F.col(group).alias("g"), F.col(entity).alias("e"), F.col(label).cast("double").alias("y"),
                       F.col(split).alias("split"), bins_column(RankModel(list(features), edges)).alias("bins"))
    rows = materialize(with_ideal(rows, "g", "y", "e", k), "rank_frame")
    return Prepared(list(features), edges, rows, k, max_bins + 1, not rows.filter("split = 'val'").isEmpty())


def boost(data: Prepared, report: Callable[[int, float], bool] | None = None, **params) -> RankModel:
    """Trees until ``n_estimators``, or until the validation NDCG@k has not risen for some.

    ``report`` gets (tree number, validation NDCG) and may end the fit by returning True.
    """
    p = {**DEFAULTS, **params}
    model, width = RankModel(data.features, data.edges), len(data.features)
    train, val = data.rows.filter("split = 'train'"), data.rows.filter("split = 'val'")
    for i in range(p["n_estimators"]):
        rng = random.Random(f"{p['seed']}-{i}")
        used = sorted(rng.sample(range(width), max(1, round(p["feature_fraction"] * width))))
        grads = pair_gradients(train.withColumn("s", _binned_score(model)), "g", "e", "y", "s", data.k, p["sigma"], F.col("bins"))
        if p["bagging_fraction"] < 1:
            bag = F.pmod(F.xxhash64(F.lit(p["seed"]), F.lit(i // max(1, p["bagging_freq"])), "g", "e"), F.lit(10_000))
            grads = grads.filter(bag < int(p["bagging_fraction"] * 10_000))
        tree = _grow(grads, width, data.bins, used, p)
        if len(tree.feature) == 1:
            break
        model.trees.append(tree)
        if not data.validate:
            continue
        scored = val.withColumn("s", _binned_score(model))
        ndcg = ndcg_by_group(scored, "g", "s", "y", data.k, "e").agg(F.coalesce(F.avg("ndcg"), F.lit(0.0))).first()[0]
        model.history.append(float(ndcg))
        if report and report(i, float(ndcg)):
            break
        if len(model.history) - model.best_iteration >= p["early_stopping_rounds"]:
            break
    return model


def fit_rank(frame: DataFrame, features: Sequence[str], group: str, entity: str, label: str, split: str = "split",
             k: int = 30, max_bins: int = 63, **params) -> RankModel:
    """Fit on rows whose ``split`` is train; val rows stop it early by their mean NDCG@k."""
    return boost(prepare_rank(frame, features, group, entity, label, split, k, max_bins), **params)
