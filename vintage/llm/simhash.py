"""SimHash near-duplicates with meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most ``d`` bits have a value midway
between them. Every distinct fingerprint emits all values within half that
radius; fingerprints that emit the same value collide, and colliding pairs are
verified by their bit distance.

Fewer values by parity, for odd d = 2r + 1: the distance of two fingerprints is
even exactly when their bit counts have the same parity. Fingerprints of even
parity emit the values at distance r, r - 2, ...; those of odd parity the values
at distance r + 1, r - 1, ... Every pair within d still meets: same-parity
pairs have distance 2m <= 2r and meet at (m, m) or (m - 1, m + 1), mixed ones
at (m, m + 1) or (m + 1, m). For d = 3 that is 64 values for one half and 2,017
for the other. A value reached within r is a centre: everything else that emits
that value lies within d of it, so each emitter links to the smallest centre
there and no group is expanded into all its pairs. Two emitters at distance
r + 1 alone are further apart than d or meet elsewhere.

Shuffle: values are dealt out by ``bucket_bits`` parity bits, bit j being the
parity of the fingerprint bits i with i mod bucket_bits = j. Flipping w bits
flips at most w bucket bits, so all values of a fingerprint that fall into one
bucket are shipped as one row (17 rows in place of 2,017 at 6 bits) and the
task of that bucket lists them. Near copies differ in some bit and so spread
over the buckets. The number of buckets follows the number of distinct
fingerprints; a bucket works in blocks of bounded size. The links of a block are
verified and reduced to a forest at once, those of a bucket again before they
leave, so a bucket that holds one group of near copies never holds its pairs.

Defined cases: a NULL or empty text, or one of white space, has fingerprint
zero, linked like any other. Texts with fewer words than a shingle hash the
whole word sequence. Rows with a NULL id are linked; their component is named
by the smallest id that is not NULL (NULL if there is none). Repeated rows stay
repeated. An empty table gives an empty result. Extra columns are ignored by
:func:`near_groups` and kept by :func:`drop_near_duplicates`.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vintage.llm.common import in_few, join_listed, written
from vintage.llm.components import components

_BLOCK = 1 << 16
_SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of one UTF-8 text: bit set if set in over half of the shingle hashes."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    total = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, total, _BLOCK):  # long texts block by block
        ws = words[at:at + min(_BLOCK, total - at) + shingle - 1]
        joined = b" ".join(ws)
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        if len(ws) < shingle:
            hashes = digest(joined, _SEED)
        else:
            spans = zip(starts[:len(ws) - shingle + 1].tolist(), (ends[shingle - 1:] - 1).tolist())
            hashes = b"".join([digest(joined[s:e], _SEED) for s, e in spans])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of each text as a long."""
    @F.arrow_udf(LongType())
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            t = t.cast(pa.large_binary())
            yield pa.array((fingerprint(x.as_buffer().to_pybytes(), shingle) if x.is_valid else 0 for x in t),
                           pa.int64(), size=len(t))
    return F.coalesce(run(text), F.lit(0).cast("long"))  # never NULL: no second evaluation to test that


def _bucket_of(fp: Column, bits: int) -> Column:
    """The bucket of a fingerprint, by bit counts."""
    out = F.lit(0)
    for j in range(bits):
        mask = sum(1 << i for i in range(j, 64, bits))
        mask -= (mask >> 63) << 64
        out = out + F.shiftleft(F.bit_count(fp.bitwiseAND(F.lit(mask))) % 2, j)
    return out.cast("int")


def _masks(weight: int, bits: int) -> dict[int, np.ndarray]:
    """All values of ``weight`` set bits, by the bucket bits they flip."""
    if weight == 0:
        return {0: np.zeros(1, np.uint64)}
    sets = np.array(list(combinations(range(64), weight)), np.uint64)
    values = np.bitwise_or.reduce(np.uint64(1) << sets, axis=1)
    flips = np.bitwise_xor.reduce(np.uint64(1) << (sets % np.uint64(bits)), axis=1)
    order = np.argsort(flips, kind="stable")
    keys, at = np.unique(flips[order], return_index=True)
    return dict(zip(keys.tolist(), np.split(values[order], at[1:])))


def _weights(d: int) -> tuple[list[int], list[int]]:
    """Distances emitted by fingerprints of even and of odd parity."""
    r = d // 2
    if d % 2:
        return list(range(r, -1, -2)), list(range(r + 1, -1, -2))
    return list(range(r, -1, -1)), list(range(r, -1, -1))


def _local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as (node, smallest node of its component within these links)."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = idx[:len(a)], idx[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = np.minimum(new, new[root])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _near_forest(a: np.ndarray, b: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) of different fingerprints within ``d`` bits, as a forest."""
    close = np.bitwise_count(a ^ b) <= d
    close &= a != b
    return _local_forest(a[close], b[close])


def _emit(fps: np.ndarray, delta: np.ndarray, masks: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(value, fingerprint) of the values that fall into this bucket, block by block."""
    for flip in np.unique(delta):
        m = masks.get(int(flip))
        if m is None:
            continue
        own = fps[delta == flip]
        step = max(1, (1 << 21) // len(m))
        for at in range(0, len(own), step):
            f = own[at:at + step]
            yield (f[:, None] ^ m[None, :]).ravel(), np.repeat(f, len(m))


def _collide(d: int, bits: int):
    """The task of one bucket: collisions, verified, as a forest of links."""
    even, odd = _weights(d)
    r = d // 2
    masks = {w: _masks(w, bits) for w in {*even, *odd}}
    parity = [np.uint64(sum(1 << i for i in range(j, 64, bits))) for j in range(bits)]

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column("fp").to_numpy(zero_copy_only=False) for b in batches]
        fps = np.concatenate(parts).astype(np.int64).view(np.uint64)
        own = np.zeros(len(fps), np.uint64)
        for j, p in enumerate(parity):
            own |= (np.bitwise_count(fps & p).astype(np.uint64) & np.uint64(1)) << np.uint64(j)
        delta = own ^ np.uint64(key[0].as_py())
        is_odd = np.bitwise_count(fps) % 2 == 1
        centres, outer = [], []
        for rows, weights in ((~is_odd, even), (is_odd, odd)):
            for w in weights:
                (outer if w > r else centres).append((rows, w))
        found = [x for rows, w in centres for x in _emit(fps[rows], delta[rows], masks[w])]
        value, fp = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
        order = np.lexsort((fp, value))
        value, fp = value[order], fp[order]
        first = np.ones(len(value), bool)
        first[1:] = value[1:] != value[:-1]
        spots, smallest = value[first], fp[first]
        rep = smallest[np.cumsum(first) - 1] if len(value) else fp
        links = [_near_forest(fp[~first], rep[~first], d)]
        if len(spots):
            shift = np.uint64(64 - max(10, min(24, int(len(spots)).bit_length() + 4)))
            mix = np.uint64(0x9E3779B97F4A7C15)
            seen = np.zeros(1 << (64 - int(shift)), bool)
            seen[(spots * mix) >> shift] = True
            for rows, w in outer:
                for v, f in _emit(fps[rows], delta[rows], masks[w]):
                    near = seen[(v * mix) >> shift]
                    v, f = v[near], f[near]
                    at = np.minimum(np.searchsorted(spots, v), len(spots) - 1)
                    hit = spots[at] == v
                    if hit.any():
                        links.append(_near_forest(f[hit], smallest[at[hit]], d))
        a, b = _local_forest(*(np.concatenate([x[i] for x in links]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
    return run


def near_links(fps: DataFrame, max_bits: int = 3, bucket_bits: int | None = None,
               values_per_bucket: int = 1 << 22) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``max_bits``.

    ``fps``: one long column ``fp`` of distinct fingerprints. ``bucket_bits`` is
    taken from their number unless given.
    """
    even, odd = _weights(max_bits)
    if bucket_bits is None:
        per = (sum(comb(64, w) for w in even) + sum(comb(64, w) for w in odd)) / 2
        bucket_bits = int(min(20, max(5, ceil(log2(max(1, fps.count()) * per / values_per_bucket + 1)))))
    deltas = [sorted({f for w in weights for f in _masks(w, bucket_bits)}) for weights in (even, odd)]
    flips = F.when(F.bit_count("fp") % 2 == 0, F.array(*map(F.lit, deltas[0]))).otherwise(F.array(*map(F.lit, deltas[1])))
    sent = fps.select("fp", F.explode(flips).alias("flip")).select(
        "fp", _bucket_of(F.col("fp"), bucket_bits).bitwiseXOR(F.col("flip").cast("int")).alias("bucket"))
    return sent.groupBy("bucket").applyInArrow(_collide(max_bits, bucket_bits), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                max_bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    slim = written(docs.select(F.col(id_col).cast("long").alias("id"), fingerprints(F.col(text_col), shingle).alias("fp")),
                   "simhash")
    rows = slim.count()
    low = written(in_few(slim.groupBy("fp").agg(F.min("id").alias("low")), rows), "simhash-low")
    roots = components(near_links(low.select("fp"), max_bits), rows=rows)
    named = roots.join(low, roots.node == low.fp).groupBy("root").agg(F.min("low").alias("least"))
    linked = roots.join(named, "root").select(F.col("node").alias("fp"), "least")
    of_fp = low.join(linked, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id"))
    of_fp = written(in_few(of_fp, rows), "simhash-of")  # else the join below shares its shuffle and cannot split many copies
    return slim.join(of_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component, all columns kept.

    The smallest id stays; a row without an id stays only where its whole
    component has none (then the one with the smallest fingerprint). Of rows
    with the same id and fingerprint, one (any) stays.
    """
    cols = docs.columns
    fp = fingerprints(F.col(text_col), shingle)
    slim = written(docs.select(F.col(id_col).cast("long").alias("id"), fp.alias("fp")), "simhash")
    rows = slim.count()
    distinct = written(in_few(slim.select("fp").distinct(), rows), "fingerprints")
    roots = components(near_links(distinct, max_bits), rows=rows)
    g = slim.groupBy("id", "fp").agg(F.count(F.lit(1)).alias("times"))
    g = g.join(roots, g.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    best = g.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "times")).alias("s"))
    stay = best.select(F.col("s.id").alias("__wid"), F.col("s.fp").alias("__wfp"), F.col("s.times").alias("__times"))
    stay = written(stay, "simhash-stay")
    rows = docs.withColumns({"__id": F.col(id_col).cast("long"), "__fp": fp})
    same = F.col("__id").eqNullSafe(F.col("__wid")) & (F.col("__fp") == F.col("__wfp"))
    return join_listed(rows, stay, same, ["__id", "__fp"], "__times").select(*cols)
