"""Exact top-k inner-product search with dual cover trees.

Queries and candidates lie in cells of one coarse cover: a bounded number of
seeded pivots, each vector with its nearest. Cells are dealt into blocks of
bounded size; a task gets one query block and one candidate block, builds a
cover tree over each and searches them together.

A cover-tree node has a centre and a covering radius; its children are centres
further apart than half that radius, so that every point lies within half of it
from one of them. Where trials show that hardly any point has such a neighbour
(as in random directions), the rest of the node stays one list. For a pair of
nodes, and likewise of cells,

    max q.c <= centre.centre + |centre_q| r_c + |centre_c| r_q + r_q r_c

and when that is below the worst kth score of the query node's queries, the
whole pair is pruned. Pairs are visited best bound first; leaves are compared
with one matrix product.

Two rounds: each query cell is searched against the candidate cells of the best
bounds that hold k rows. That gives each query a kth score, and a pair of cells whose bound
is below the worst of them is dropped before anything of it is shuffled. The
other pairs follow, with these scores as first thresholds. The best k of every
block meet per query. No vector but the pivots is sent to the driver.

Scores are exact: products run in double precision where every partial sum
stays below 2**53; rows too large for that are compared in Python integers, and
only they.

Defined cases: vectors that are NULL, empty, or hold a NULL or non-finite
component take no part. Vectors of different lengths are not compared. Equal
scores go to the smaller id; a query doesn't meet rows with its own id. A row
that comes several times is as many candidates, and under one query id all rows
with it ask. NULL ids take no part. Scores beyond 64 bits are ranked by their
true value and shown as the end of the 64-bit range. An empty table gives an
empty result; extra columns are ignored.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintage.llm.common import written

LEAF = 64
#: Single points in a row of trials after which the rest of a node is left as one list.
PROBES = 64


@dataclass
class Node:
    """A cover-tree node: its centre, covering radius and either children or points."""

    centre: np.ndarray
    norm: float
    radius: float
    points: np.ndarray  # rows below this node
    children: list["Node"] = field(default_factory=list)


def cover_tree(x: np.ndarray, rows: np.ndarray, centre: int | None = None) -> Node:
    """The cover tree of ``x[rows]`` with x[centre] as its centre (the first row by default)."""
    centre = int(rows[0]) if centre is None else centre
    c = x[centre]
    dist = np.sqrt(np.maximum(((x[rows] - c) ** 2).sum(axis=1), 0))
    radius = float(dist.max())
    node = Node(c, float(np.sqrt((c ** 2).sum())), radius, rows)
    if len(rows) <= LEAF or radius == 0:
        return node
    half = radius / 2
    near = dist <= half
    groups: list[tuple[int, np.ndarray]] = [(centre, rows[near])] if near.sum() > 1 else []
    rest = rows[~near] if groups else rows
    lone: list[int] = []
    while len(rest) and not (len(lone) >= PROBES and len(lone) > 3 * len(groups)):
        # the next point that no centre covers is further than half the radius from all of them
        d = np.sqrt(np.maximum(((x[rest] - x[rest[0]]) ** 2).sum(axis=1), 0))
        own = d <= half
        if own.sum() == 1:
            lone.append(int(rest[0]))
        else:
            groups.append((int(rest[0]), rest[own]))
        rest = rest[~own]
    if not groups:
        return node
    lone += rest.tolist()  # points that hardly group: one list below this centre
    node.children = [cover_tree(x, r, k) for k, r in groups]
    if lone:
        r = np.array(sorted(lone))
        d = np.sqrt(((x[r] - c) ** 2).sum(axis=1).max())
        node.children.append(Node(c, node.norm, float(d), r))
    return node


#: Vectors shorter than this have products below 2**53 with one another.
_SHORT = 2.0 ** 26


class Search:
    """Best k candidates of each query, from one pair of blocks; ``floor``: scores below it aren't needed."""

    def __init__(self, q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.k, self.q_id, self.c_id = k, q_id, c_id
        self.q, self.c = q.astype(np.float64), c.astype(np.float64)
        with np.errstate(over="ignore"):
            self.short_q, self.short_c = ((x ** 2).sum(axis=1) < _SHORT ** 2 for x in (self.q, self.c))
            top = [float(np.sqrt((x[s] ** 2).sum(axis=1).max(initial=0))) for x, s in ((self.q, self.short_q), (self.c, self.short_c))]
        self.slack = top[0] * top[1] * 1e-9 + 1e-6
        self.score = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), -1, np.int64)  # rows of c
        self.floor = np.full(len(q), -np.inf) if floor is None else floor
        self.pruned = 0

    def _bound(self, a: Node, b: Node) -> float:
        return float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius + self.slack

    def _compare(self, a: np.ndarray, b: np.ndarray) -> None:
        worst = np.maximum(self.score[a, -1], self.floor[a])
        s = self.q[a] @ self.c[b].T
        hit = s >= worst[:, None]
        hit &= self.q_id[a][:, None] != self.c_id[b][None, :]
        for i in np.flatnonzero(hit.any(axis=1)):
            r, on = a[i], hit[i]
            sc = np.concatenate([self.score[r], s[i, on]])
            at = np.concatenate([self.found[r], b[on]])
            by = np.lexsort((self.c_id[at], -sc))[:self.k]
            self.score[r], self.found[r] = sc[by], at[by]

    def run(self) -> Iterator[tuple[int, int, int]]:
        """(row of q, row of c, score), k or fewer for each query; short rows by the trees, the others exactly."""
        qs, cs = np.flatnonzero(self.short_q), np.flatnonzero(self.short_c)
        if len(qs) and len(cs):
            self._trees(qs, cs)
        long_c = np.flatnonzero(~self.short_c)
        whole_c = {j: [int(v) for v in self.c[j]] for j in (range(len(self.c)) if not self.short_q.all() else long_c)}
        for i in range(len(self.q)):
            best = [(int(s), int(f)) for s, f in zip(self.score[i], self.found[i]) if f >= 0]
            others = long_c if self.short_q[i] else range(len(self.c))
            if len(others):
                row = [int(v) for v in self.q[i]]
                best += [(sum(map(mul, row, whole_c[j])), int(j)) for j in others if self.c_id[j] != self.q_id[i]]
                best = heapq.nsmallest(self.k, best, key=lambda x: (-x[0], self.c_id[x[1]]))
            for s, j in best:
                yield i, j, s

    def _trees(self, qs: np.ndarray, cs: np.ndarray) -> None:
        tq, tc = cover_tree(self.q, qs), cover_tree(self.c, cs)
        queue, n = [(-self._bound(tq, tc), 0, tq, tc)], 0
        while queue:
            bound, _, a, b = heapq.heappop(queue)
            if -bound < np.maximum(self.score[a.points, -1], self.floor[a.points]).min():
                self.pruned += len(a.points) * len(b.points)
                continue
            if not a.children and not b.children:
                for i in range(0, len(a.points), 1024):  # bounded products
                    for j in range(0, len(b.points), 4096):
                        self._compare(a.points[i:i + 1024], b.points[j:j + 4096])
                continue
            split_a = a.children and (not b.children or a.radius >= b.radius)
            for x, y in ([(s, b) for s in a.children] if split_a else [(a, s) for s in b.children]):
                n += 1
                heapq.heappush(queue, (-self._bound(x, y), n, x, y))


_LOW, _HIGH = -2 ** 63, 2 ** 63 - 1


def _beyond(score: int) -> bytes | None:
    """A key that sorts scores beyond 64 bits; None for others."""
    return None if _LOW <= score <= _HIGH else (score + (1 << 2200)).to_bytes(276, "big")


FOUND = "dim int, cell int, query_id long, vec_id long, score long, beyond binary, copies long"


def _search_task(k: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        ids, asks, copies = (t[c].to_numpy() for c in ("id", "is_query", "m"))
        floor = t["floor"].to_numpy()
        vecs = t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        qs, cs = np.flatnonzero(asks), np.flatnonzero(~asks)
        qs, cs = qs[np.argsort(ids[qs], kind="stable")], cs[np.argsort(ids[cs], kind="stable")]
        out: list[tuple] = []
        if len(qs) and len(cs):
            s = Search(vecs[qs], ids[qs], vecs[cs], ids[cs], k, floor[qs])
            out = [(key[0].as_py(), key[1].as_py(), int(ids[qs[i]]), int(ids[cs[j]]), min(max(v, _LOW), _HIGH), _beyond(v),
                    int(copies[qs[i]]) * int(copies[cs[j]])) for i, j, v in s.run()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)],
                                         names=[f.split()[0] for f in FOUND.split(", ")])
    return run


def scaled_floor(embedding: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of each component as doubles; NULL for a vector that takes no part."""
    usable = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.when((F.size(embedding) > 0) & usable, embedding)
    # floor to a double: Spark's floor() gives a long, which large components overflow
    return F.transform(whole, lambda x: _floor(F.lit(factor) * x.cast("double")))


def _floor(x: Column) -> Column:
    small = F.abs(x) < 2.0 ** 53  # larger doubles are whole numbers
    return F.when(small, F.floor(F.when(small, x)).cast("double")).otherwise(x)


def in_cells(v: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``v`` with cell (the nearest pivot of its dimension; -1, the origin, where there is none) and d, the distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, cell, dist = b["dim"].to_numpy(), np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                x = b["v"].take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                with np.errstate(over="ignore", invalid="ignore"):
                    p = pivots.get(int(d))
                    if p is not None:
                        near = np.nan_to_num((p ** 2).sum(axis=1)[None, :] - 2 * x @ p.T, nan=np.inf, posinf=np.inf, neginf=-np.inf).argmin(axis=1)
                        cell[at], x = near, x - p[near]
                    dist[at] = np.nan_to_num(np.sqrt((x ** 2).sum(axis=1)), nan=np.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], names=[*b.schema.names, "cell", "d"])
    fields = "id long, is_query boolean, v array<double>, dim int, m long"
    return v.select("id", "is_query", "v", "dim", "m").mapInArrow(run, f"{fields}, cell int, d double")


def cell_bounds(cells: list, pivots: dict[int, np.ndarray]) -> list[tuple[int, int, int, float]]:
    """(dim, query cell, candidate cell, bound of their scores) of cells given as rows dim, cell, nq, r, rq."""
    out = []
    for q in cells:
        for c in cells if q.nq else ():
            if c.dim == q.dim:
                p = pivots.get(q.dim)
                a, b = (p[x.cell] if x.cell >= 0 else np.zeros(q.dim) for x in (q, c))
                with np.errstate(over="ignore", invalid="ignore"):
                    size = np.sqrt((a ** 2).sum()), np.sqrt((b ** 2).sum())
                    bound = float(a @ b + size[0] * c.r + size[1] * q.rq + q.rq * c.r)
                    bound += 1e-9 * float((size[0] + q.rq) * (size[1] + c.r)) + 1e-6
                out.append((q.dim, q.cell, c.cell, float("inf") if np.isnan(bound) else bound))
    return out


def _searched(v: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """:data:`FOUND` rows of the given pairs of cells (dim, cell, other, q_parts, c_parts), block by block."""
    h = F.xxhash64("id")
    p = F.broadcast(pairs)  # at most max_pivots squared rows a dimension
    ask = v.filter("is_query").join(p, ["dim", "cell"]).select(
        "dim", "cell", "other", F.pmod(h, F.col("q_parts")).alias("qp"), F.explode(F.sequence(F.lit(0), F.col("c_parts") - 1)).alias("cp"),
        "id", F.lit(True).alias("is_query"), "v", "m", "floor")
    cand = v.withColumnRenamed("cell", "other").join(p, ["dim", "other"]).select(
        "dim", "cell", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts").cast("long") - 1)).alias("qp"),
        F.pmod(h, F.col("c_parts")).cast("int").alias("cp"), "id", F.lit(False).alias("is_query"), "v", "m", F.lit(0.0).alias("floor"))
    return ask.unionByName(cand).groupBy("dim", "cell", "other", "qp", "cp").applyInArrow(_search_task(k), FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          factor: float = 64.0, query_block: int = 4096, candidate_block: int = 16384, max_pivots: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each query.

    ``max_pivots``: cells of the coarse cover at most; a larger cell is dealt into more blocks.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e"),
                       is_query.alias("is_query")).filter("id is not null")
    v = v.withColumn("is_query", F.coalesce("is_query", F.lit(False)))
    v = v.withColumn("v", scaled_floor(F.col("e"), factor)).filter(F.col("v").isNotNull())
    v = v.groupBy("id", "v").agg(F.max("is_query").alias("is_query"), F.count(F.lit(1)).alias("m"))
    v = written(v.select("id", "is_query", "v", F.size("v").alias("dim"), "m"), "vectors")
    cells_wanted = min(max_pivots, max(1, v.count() // candidate_block))
    pivots: dict[int, list] = {}
    for r in v.orderBy(F.xxhash64("id"), "id").select("dim", "v").limit(cells_wanted).collect():
        pivots.setdefault(r.dim, []).append(r.v)
    centres = {d: np.array(p, np.float64) for d, p in pivots.items()}
    v = written(in_cells(v, centres), "vectors-in-cells")
    # one row per cell
    cells = v.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("nq"), F.max("d").alias("r"),
                                         F.coalesce(F.max(F.when(F.col("is_query"), F.col("d"))), F.lit(0.0)).alias("rq")).collect()
    size = {(c.dim, c.cell): c for c in cells}
    bounds = sorted(cell_bounds(cells, centres), key=lambda b: (b[0], b[1], -b[3], b[2]))
    held: dict[tuple[int, int], int] = {}
    first, later = [], []
    for dim, q, c, bound in bounds:
        enough = held.get((dim, q), 0) > k  # more than k rows: one may be the query's own
        held[dim, q] = held.get((dim, q), 0) + (0 if enough else size[dim, c].n)
        (later if enough else first).append((dim, q, c, bound))

    def pairs(some: list) -> DataFrame:
        rows = [(d, q, c, -(-size[d, q].nq // query_block), -(-size[d, c].n // candidate_block)) for d, q, c, _ in some]
        return spark.createDataFrame(rows, "dim int, cell int, other int, q_parts int, c_parts int")
    got = written(_searched(v.withColumn("floor", F.lit(float("-inf"))), pairs(first), k), "search-first")
    if later:
        nth = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc_nulls_last(), "vec_id")
        kth = got.withColumn("r", F.row_number().over(nth)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
        # a whole score as a double may be rounded up: one step below it is safe
        least = F.coalesce(F.col("kth") - F.abs("kth") * 1e-15 - 1, F.lit(float("-inf")))
        v = written(v.join(kth, "id", "left").withColumn("floor", F.when(F.col("is_query"), least).otherwise(F.lit(0.0))).drop("kth"), "vectors-asked")
        worst = {(r.dim, r.cell): r.w for r in v.filter("is_query").groupBy("dim", "cell").agg(F.min("floor").alias("w")).collect()}
        left = [b for b in later if b[3] >= worst.get((b[0], b[1]), -np.inf)]
        if left:
            got = got.unionByName(_searched(v, pairs(left), k))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("beyond").desc_nulls_last(), "vec_id")
    top = got.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    # rows that come several times are several candidates
    top = top.withColumn("again", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    return (top.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
