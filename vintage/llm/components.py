"""Connected components of a link table, as Spark joins and aggregates.

Each round hooks every node to its smallest neighbour, follows these parents
until they no longer change, and moves the links to the roots; links inside a
component vanish. Nodes that are no local minimum disappear, so a round at
least halves the nodes that still have links. Tables are written between steps,
so a lost executor never recomputes the chain. Hubs: minima are pre-aggregated,
and joins meet a table with one row per node, which adaptive skew joins split.
A round's tables come in files that follow its number of links, not in as many as
the shuffle has partitions: the rounds get small fast.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.llm.common import in_few, written


def _follow(parents: DataFrame, rows: int) -> DataFrame:
    """(node, root) from (node, parent) with parent <= node, by pointer doubling; about ``rows`` rows."""
    while True:
        up = parents.select(F.col("node").alias("u"), F.col("root").alias("up"))
        nxt = parents.join(up, F.col("root") == F.col("u"), "left").select(
            "node", F.coalesce("up", "root").alias("root"),
            (F.coalesce("up", "root") != F.col("root")).alias("moved"))
        nxt = written(in_few(nxt, rows), "roots")
        parents = nxt.select("node", "root")
        if nxt.filter("moved").isEmpty():
            return parents


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node of its component.

    Rows with a NULL end and loops link nothing. Repeated links count once.
    An empty table gives an empty result. ``rows``: about how many links there
    are, if known; it only sets the number of files.
    """
    e = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = written(e if rows is None else in_few(e, rows), "links")
    labels, first = None, 0
    while left := e.count():
        first = first or 2 * left  # nodes at most
        near = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        tops = e.select(F.col("a").alias("node")).distinct().join(near, "node", "left_anti")
        parents = near.unionByName(tops.select("node", F.col("node").alias("root")))
        roots = _follow(written(in_few(parents, 2 * left), "parents"), 2 * left)
        if labels is None:
            labels = roots
        else:
            up = roots.select(F.col("node").alias("u"), F.col("root").alias("up"))
            moved = labels.join(up, F.col("root") == F.col("u"), "left").select("node", F.coalesce("up", "root").alias("root"))
            labels = written(in_few(moved, first), "labels")
        ra = roots.select(F.col("node").alias("a"), F.col("root").alias("x"))
        rb = roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
        e = (e.join(ra, "a").join(rb, "b").filter("x <> y")
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        e = written(in_few(e, left), "links")
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
