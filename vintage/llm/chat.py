"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Chat logs often hold every snapshot of a growing conversation. Each turn gets a
128-bit hash of (position, role, text); the running XOR of these hashes
identifies the turn prefix that ends there. A conversation whose whole-hash is a
proper prefix hash of another one is an earlier snapshot: an anti-join drops it.
Of conversations with the same turns one stays (the smallest id). The rest are
rendered.

Positions and running hashes are taken within blocks of turns, and block totals
are scanned per conversation, so a conversation that holds a third of all rows
is still dealt out by (conversation, block). Prefix hashes are made distinct
before the anti-join, so a first turn that everybody shares is one row.

Defined cases: turns are ordered by turn (NULL first), role, then text hash;
ties after that are the same turn twice and both stay. A NULL role or text
counts as empty. A NULL conversation id is one conversation, and it sorts after
all others when the smallest id is taken. An empty table gives an empty result;
extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintage.llm.common import written

def _hashes(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    return turns.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"), r.alias("r"),
                        F.xxhash64(F.lit("a"), r, t).alias("h1"), F.xxhash64(F.lit("b"), t, r).alias("h2"))


def prefix_hashes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text", block: int = 256) -> DataFrame:
    """One row per turn: c (conversation), pos (from 1), n (turns in all), p1 and p2 (hash of the prefix)."""
    t = _hashes(turns, conv, turn, role, text).withColumn("b", F.floor(F.col("t") / F.lit(block)))
    key = F.struct(F.col("b").isNotNull().alias("known"), F.col("b"))
    counts = t.groupBy("c", "b").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("c").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("c")
    counts = counts.select("c", "b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("off"),
                           F.sum("m").over(whole).alias("n"))
    same = F.col("l.c").eqNullSafe(F.col("k.c")) & F.col("l.b").eqNullSafe(F.col("k.b"))
    inner = Window.partitionBy("c", "b").orderBy("t", "r", "h1", "h2")
    t = t.alias("l").join(counts.alias("k"), same).select("l.*", "k.off", "k.n")
    t = t.withColumn("pos", F.col("off") + F.row_number().over(inner))
    t = t.withColumns({"x1": F.xxhash64("pos", "h1", "h2"), "x2": F.xxhash64("h2", "pos", "h1")})
    run = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({"y1": F.bit_xor("x1").over(run), "y2": F.bit_xor("x2").over(run)})
    sums = t.groupBy("c", "b").agg(F.bit_xor("x1").alias("z1"), F.bit_xor("x2").alias("z2"))
    zero = F.lit(0).cast("long")
    sums = sums.select("c", "b", F.coalesce(F.bit_xor("z1").over(before), zero).alias("o1"),
                       F.coalesce(F.bit_xor("z2").over(before), zero).alias("o2"))
    return (t.alias("l").join(sums.alias("k"), same)
            .select("l.c", "l.pos", "l.n", F.col("y1").bitwiseXOR(F.col("o1")).alias("p1"),
                    F.col("y2").bitwiseXOR(F.col("o2")).alias("p2")))


def maximal_conversations(turns: DataFrame, conv: str = "conv_id", **names) -> DataFrame:
    """conv_id, n_turns and copies (logged conversations with the same turns) of those that no longer one extends."""
    p = written(prefix_hashes(turns, conv=conv, **names), "turn-prefixes")
    whole = (p.filter("pos = n").groupBy("n", "p1", "p2")
             .agg(F.min("c").alias(conv), F.count(F.lit(1)).alias("copies")))
    proper = p.filter("pos < n").select(F.col("pos").alias("n"), "p1", "p2").distinct()
    return whole.join(proper, ["n", "p1", "p2"], "left_anti").select(
        conv, F.col("n").cast("long").alias("n_turns"), "copies")


def render_turn(role: Column, text: Column) -> Column:
    """One turn in the ChatML form."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """conv_id, n_turns, copies, rendered: the maximal conversations as one training text each."""
    best = maximal_conversations(turns, conv=conv, turn=turn, role=role, text=text)
    best = written(best.withColumnRenamed(conv, "k"), "conversations")
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = turns.select(F.col(conv).alias("c"), F.struct(
        F.col(turn).cast("long").alias("t"), r.alias("r"), F.xxhash64(F.lit("a"), r, t).alias("h1"),
        F.xxhash64(F.lit("b"), t, r).alias("h2"), render_turn(r, t).alias("s")).alias("x"))
    kept = rows.join(best, F.col("c").eqNullSafe(F.col("k")))
    return kept.groupBy("c", "n_turns", "copies").agg(F.sort_array(F.collect_list("x")).alias("xs")).select(
        F.col("c").alias(conv), "n_turns", "copies", F.array_join(F.transform("xs", lambda x: x["s"]), "").alias("rendered"))
