"""Exact de-duplication with a two-pass Bloom filter.

Pass 1 reads the text hashes and counts, per filter slot, how often the slot is
hit (0, 1, 2 or more). Pass 2 tests each hash: when all its slots were hit at
least twice it may be repeated, and only those rows shuffle. A hash with a slot
that was hit once occurs once for certain, so its row passes straight through.
False positives only shuffle in vain; the groups are formed on the full SHA-256.

Size: the filter has ``slots_per_row`` one-bit slots for each row, at most
``max_slots`` (2**28 bits, 32 MB), which bounds what is broadcast. Beyond about
``max_slots / 4`` rows more rows shuffle; the result stays the same.

Defined cases: a NULL text counts as empty; all texts without a visible
character are equal. A NULL id comes after every other id. Rows that repeat
with the same id, length and text count as many times as they occur, and one of
them stays. An empty table gives an empty result. Extra columns pass through.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from vintage.llm.common import ASCII_SPACE, join_listed, written

#: Odd multipliers of the slot hashes (multiplicative hashing, upper bits).
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_SEGMENT_BITS = 16


def normalised(text: Column) -> Column:
    """The text without ASCII white space; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text).cast("binary"), 256)


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Slot numbers, one row per multiplier."""
    u = hashes.astype(np.uint64)
    return np.stack([(u * np.uint64(m)) >> np.uint64(64 - bits) for m in _MULTIPLIERS])


def _slot_counts(bits: int):
    """Per task: the slots hit once and those hit more often, by segment of the filter."""
    shift = min(_SEGMENT_BITS, bits)

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slots, n = np.unique(np.concatenate(parts), return_counts=True)
        segment = (slots >> np.uint64(shift)).astype(np.int64)
        cut = np.flatnonzero(np.diff(segment)) + 1
        rest = (slots & np.uint64((1 << shift) - 1)).astype(np.uint32)
        rows = [(int(s[0]), r[c == 1].tobytes(), r[c > 1].tobytes())
                for s, r, c in zip(np.split(segment, cut), np.split(rest, cut), np.split(n, cut))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
             pa.array([r[2] for r in rows], pa.binary())], names=["segment", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            if b.num_rows:
                parts.append(_slots(b.column(0).to_numpy(zero_copy_only=False), bits).ravel())
                held += b.num_rows
            if held >= 1_000_000:  # bounded memory; a slot may then come twice, which the merge adds up
                yield from flush(parts)
                parts, held = [], 0
        if held:
            yield from flush(parts)
    return run


def _merge_segment(bits: int):
    """One segment: a bit for each slot that was hit at least twice over all tasks."""
    size = 1 << min(_SEGMENT_BITS, bits)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.uint8)
        for b in batches:
            for once in b.column("once"):
                at = np.frombuffer(once.as_py(), np.uint32)
                seen[at] = np.minimum(seen[at] + 1, 2)
            for more in b.column("more"):
                seen[np.frombuffer(more.as_py(), np.uint32)] = 2
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(seen == 2).tobytes()], pa.binary())],
            names=["segment", "bits"])
    return run


def possibly_repeated(digests: DataFrame, digest: str, slots_per_row: int = 16, max_slots: int = 1 << 28,
                      rows: int | None = None) -> Column:
    """A Boolean column for ``digests``: false only where the digest occurs once for certain.

    ``digests`` is read for pass 1, so hand in a written table.
    """
    spark = digests.sparkSession
    n = digests.count() if rows is None else rows
    bits = max(10, min(max_slots, max(1, n * slots_per_row)).bit_length())
    hashes = digests.select(F.xxhash64(digest).alias("h"))
    parts = hashes.mapInArrow(_slot_counts(bits), "segment long, once binary, more binary")
    merged = parts.groupBy("segment").applyInArrow(_merge_segment(bits), "segment long, bits binary")
    width = 1 << min(_SEGMENT_BITS, bits)
    filled = np.zeros((1 << bits) // width * (width // 8), np.uint8)
    for row in merged.collect():  # together one bit for each slot, max_slots at most
        at = row.segment * (width // 8)
        filled[at:at + width // 8] = np.frombuffer(row.bits, np.uint8)
    shared = spark.sparkContext.broadcast(filled.tobytes())

    @F.arrow_udf(BooleanType())
    def test(h: pa.Array) -> pa.Array:
        table = np.frombuffer(shared.value, np.uint8)
        hit = np.ones(len(h), bool)
        for s in _slots(h.to_numpy(zero_copy_only=False), bits):
            hit &= (table[s >> np.uint64(3)] >> (7 - (s & np.uint64(7))).astype(np.uint8)) & 1 == 1
        return pa.array(hit)

    return test(F.xxhash64(digest))


def _decide(candidates: DataFrame, id_col: str) -> DataFrame:
    """Groups of the possibly repeated rows: (id, sha, len, times, keep_id, group_size, wins)."""
    g = candidates.groupBy(id_col, "__sha", "__len").agg(F.count(F.lit(1)).alias("__times"))
    rank = F.struct(F.col("__len"), F.col(id_col).isNotNull().alias("has"),
                    F.bitwise_not(F.coalesce(F.col(id_col), F.lit(0).cast("long"))).alias("back"))
    g = g.withColumn("__rank", rank)
    best = g.groupBy("__sha").agg(F.max("__rank").alias("__best"), F.sum("__times").alias("__size"))
    j = g.join(written(best, "exact-groups"), "__sha")  # a plain shuffle on both sides: skewed hashes can be split
    return (j.withColumn("__keep", F.when(F.col("__best.has"), F.bitwise_not(F.col("__best.back"))))
            .withColumn("__wins", F.col("__rank") == F.col("__best")))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("__id"), text_digest(F.col(text_col)).alias("__sha"),
                       F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("__len"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_size) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    d = written(_digests(docs, id_col, text_col), "exact-digests")
    flagged = d.withColumn("__maybe", possibly_repeated(d, "__sha", **filter_size))
    flagged = written(flagged, "exact-flagged")
    single = flagged.filter(~F.col("__maybe")).select(
        F.col("__id").alias(id_col), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("__sha").alias("text_sha256"))
    g = _decide(flagged.filter("__maybe"), "__id")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))).alias("__copy")
    groups = g.select("*", copies).select(
        F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
        (F.col("__wins") & (F.col("__copy") == 1)).alias("kept"), F.col("__sha").alias("text_sha256"))
    return single.unionByName(groups)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_size) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    The row that stays is that of :func:`exact_groups`. Of rows with the same
    id and the same text, one (any) stays.
    """
    cols = docs.columns
    d = written(_digests(docs, id_col, text_col), "exact-digests")
    maybe = possibly_repeated(d, "__sha", **filter_size)
    winners = _decide(d.filter(maybe), "__id").filter("__wins").select(
        F.col("__id").alias("__wid"), F.col("__sha").alias("__wsha"), F.col("__len").alias("__wlen"), "__times")
    winners = written(winners, "exact-winners")
    rows = docs.withColumns({"__id": F.col(id_col).cast("long"), "__sha": text_digest(F.col(text_col)),
                             "__len": F.length(F.coalesce(F.col(text_col), F.lit("")))})
    rows = rows.withColumn("__maybe", maybe)
    single = rows.filter(~F.col("__maybe")).select(*cols)
    same = (F.col("__id").eqNullSafe(F.col("__wid")) & (F.col("__sha") == F.col("__wsha"))
            & (F.col("__len") == F.col("__wlen")))
    kept = join_listed(rows.filter("__maybe"), winners, same, ["__id", "__sha"], "__times")
    return single.unionByName(kept.select(*cols))
