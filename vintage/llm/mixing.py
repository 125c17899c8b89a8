"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a word budget from its weight. A source takes each document
``base`` times (the whole part of budget / size) and then fills the remaining
budget: documents are counted by exact length, every length gets its share, and
a bounded-knapsack program over the lengths that are left hits what remains as
closely as it can. Which documents of a length are taken once more follows from
a seeded hash of their ids, so reruns agree.

Only counts leave the documents: one row per (source, length) goes to the task
that fits a source, so its work grows with the number of distinct lengths. The
documents of one (source, length) are ranked within 4,096 hash buckets whose
quotas come from bucket counts; a group that holds a third of all rows is dealt
out. Tables with one row per source are sorted in one task.

Defined cases: a NULL text has no word; documents without a word are taken
``base`` times (0 words). A NULL source is a source of its own, the last one. A
NULL id ranks by one hash. Rows with the same id, source and length are copies
of one document: they are ranked together and stay separate rows of the
result. An empty table gives an empty result. Extra columns pass through
:func:`mix`.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintage.llm.common import join_listed, written

WORD = r"[^\x20\x09-\x0D]+"
_DP_WORDS = 1 << 16


def word_count(text: Column) -> Column:
    """Number of words, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, size) rows.

    Weights repeat over the sources in code-point order (NULL last). The target
    sum is ``share`` times all sizes. No target exceeds ``most`` times its
    source; the excess goes to the others by weight. Sorted by size / weight,
    the sources up to some point are at their limit and the others share evenly.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything, before = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumns({"total": total, "full": left / left_w >= F.col("cap") / F.col("w")})
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)
    even = (F.col("total") - spent) / F.when(open_w > 0, open_w) * F.col("w")
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least(even, "cap")).alias("target"))


def subset_sum(lengths: np.ndarray, available: np.ndarray, goal: int) -> np.ndarray:
    """How many of each length to take so that the sum is as close to ``goal`` as possible.

    Bounded knapsack by binary splitting over sums up to twice the goal; ``last``
    holds the item that first reached a sum, which is the way back.
    """
    take = np.zeros(len(lengths), np.int64)
    if goal <= 0:
        return take
    size = 2 * goal + 1
    reach = np.zeros(size, bool)
    reach[0] = True
    last = np.full(size, -1, np.int32)
    items: list[tuple[int, int]] = []
    for j in np.flatnonzero((available > 0) & (lengths < size)):
        left, step = int(min(available[j], (size - 1) // lengths[j])), 1
        while left and not reach[goal]:
            n = min(step, left)
            w = n * int(lengths[j])
            new = reach[:size - w] & ~reach[w:]
            last[w:][new] = len(items)
            reach[w:] |= new
            items.append((int(j), n))
            left, step = left - n, step * 2
        if reach[goal]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - goal))])
    while at:
        j, n = items[last[at]]
        take[j] += n
        at -= n * int(lengths[j])
    return take


def fit_source(lengths: np.ndarray, counts: np.ndarray, target: float, order: np.ndarray) -> tuple[int, np.ndarray]:
    """(base, extra by length): every document ``base`` times, ``extra`` of each length once more.

    ``order``: a seeded order of the lengths, for ties.
    """
    extra = np.zeros(len(lengths), np.int64)
    size = int((lengths * counts).sum())
    if size == 0:
        return 0, extra
    base = int(target // size)
    rest = target - base * size
    exact = counts * (rest / size)
    some = lengths > 0
    extra[some] = np.floor(exact[some]).astype(np.int64)
    left = int(round(rest - float((extra * lengths).sum())))
    for j in np.lexsort((order, extra - exact)):  # largest remainder first, down to what the program covers
        if left <= _DP_WORDS:
            break
        if some[j] and extra[j] < counts[j] and lengths[j] <= left:
            n = int(min(counts[j] - extra[j], max(1, (left - _DP_WORDS) // lengths[j])))
            extra[j] += n
            left -= n * int(lengths[j])
    spare = np.where(some, counts - extra, 0)
    if left > _DP_WORDS:  # nothing that fits is left; the shortest may still come closer than nothing
        j = int(np.argmin(np.where(spare > 0, lengths, np.iinfo(np.int64).max)))
        extra[j] += int(spare[j] > 0 and lengths[j] < 2 * left)
        return base, extra
    at = np.argsort(order, kind="stable")
    extra[at] += subset_sum(lengths[at], spare[at], left)
    return base, extra


def _fit_group(seed: int):
    def run(table: pa.Table) -> pa.Table:
        lengths, counts = table.column("size").to_numpy(), table.column("n").to_numpy()
        by = np.argsort(lengths)
        lengths, counts = lengths[by], counts[by]
        order = np.random.default_rng(seed).permutation(len(lengths))
        base, extra = fit_source(lengths, counts, table.column("target")[0].as_py(), order)
        return pa.table({"source": table.column("source"), "size": lengths, "base": np.full(len(lengths), base),
                         "extra": extra})
    return run


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"))


def _same(a: str, b: str, *cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def copies(slim: DataFrame, seed: int = 11, **targets) -> DataFrame:
    """(id, source, size, reps, base, more, source_size, target) by distinct (id, source, size).

    Of the ``reps`` rows with that key, ``more`` are taken base + 1 times, the others base times.
    """
    budget = source_targets(slim, **targets)
    budget = written(budget, "mix-targets")
    hist = slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    fitted = (hist.alias("h").join(budget.alias("t"), _same("h", "t", "source"))
              .select("h.source", "h.size", "h.n", "t.target").groupBy("source")
              .applyInArrow(_fit_group(seed), "source string, size long, base long, extra long"))
    fitted = written(fitted, "mix-fit")
    d = slim.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("reps"))
    d = d.withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("b", F.shiftrightunsigned("h", 52))
    d = written(d, "mix-documents")
    buckets = d.groupBy("source", "size", "b").agg(F.sum("reps").alias("m"))
    upto = Window.partitionBy("source", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("off", F.coalesce(F.sum("m").over(upto), F.lit(0)))
    quota = F.greatest(F.lit(0), F.least(F.col("f.extra") - F.col("k.off"), F.col("k.m")))
    buckets = buckets.alias("k").join(fitted.alias("f"), _same("k", "f", "source", "size")).select(
        "k.source", "k.size", "k.b", "f.base", quota.alias("quota"))
    inner = Window.partitionBy("source", "size", "b").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("off", F.coalesce(F.sum("reps").over(inner), F.lit(0)))
    d = d.alias("d").join(buckets.alias("k"), _same("d", "k", "source", "size", "b"))
    more = F.greatest(F.lit(0), F.least(F.col("k.quota") - F.col("d.off"), F.col("d.reps")))
    d = d.select("d.id", "d.source", "d.size", "d.reps", "k.base", more.alias("more"))
    return d.alias("d").join(budget.alias("t"), _same("d", "t", "source")).select("d.*", "t.source_size", "t.target")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            seed: int = 11, **targets) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    c = copies(written(_sizes(docs, id_col, text_col, source_col), "mix-sizes"), seed, **targets)
    k = F.explode(F.sequence(F.lit(1).cast("long"), F.col("reps"))).alias("k")
    times = F.col("base") + F.when(F.col("k") <= F.col("more"), 1).otherwise(0)
    return c.select("*", k).select(F.col("id").alias(id_col), "size", "source_size", "target",
                                   (F.col("size") * times).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 11, **targets) -> DataFrame:
    """``docs`` as the mixture takes them: each row as often as it is taken, all columns kept."""
    cols = docs.columns
    c = copies(written(_sizes(docs, id_col, text_col, source_col), "mix-sizes"), seed, **targets)
    times = c.withColumn("times", F.col("base") * F.col("reps") + F.col("more")).filter("times > 0").select(
        F.col("id").alias("__cid"), F.col("source").alias("__csource"), F.col("size").alias("__csize"),
        F.col("times").alias("__times"), F.col("reps").alias("__reps"))
    times = written(times, "mix-times")
    rows = docs.withColumns({"__id": F.col(id_col).cast("long"), "__source": F.col(source_col).cast("string"),
                             "__size": word_count(F.col(text_col))})
    same = (F.col("__id").eqNullSafe(F.col("__cid")) & F.col("__source").eqNullSafe(F.col("__csource"))
            & (F.col("__size") == F.col("__csize")))
    rows = join_listed(rows, times, same, ["__id", "__source", "__size"], "__reps")
    return rows.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))).alias("__k")).select(*cols)
