"""Benchmark decontamination with one Aho-Corasick automaton over the test items.

Texts are normalised to words: A-Z lower-cased, words are runs of anything but
the ASCII characters that are neither letter nor digit. An item gives every run
of ``window`` consecutive words, a shorter one gives all its words as one run.
The automaton's alphabet is the items' words: each distinct word is one symbol,
and every word that no item has is one other symbol, so a text becomes a string
of symbols and is scanned once, whatever the number of items. The place of a
symbol is a word's place; it is mapped to character offsets in the original text
for the texts that are hit.

The windows are prepared in Spark. Where they outnumber ``per_automaton``, they
are dealt by hash over several automata of at most about that size, and the
texts are scanned once per automaton; only texts that are hit are then joined,
by the SHA-256 of their text. So what a worker holds and what the driver hands
over is bounded for any benchmark. With one automaton nothing shuffles but the
items.

Defined cases: NULL and texts without a word have no words and no hits; an item
without a word hits nothing; rows with the same item id are one item; the words
of an item with a NULL id count as hit, but it is in no list of items. Repeated
documents and NULL ids stay, extra columns are ignored, empty tables give no
hits or no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from vintage.llm.common import written

#: Every byte of a word as it is normalised, every other byte as a space.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: What a scan tells of a text: its words, the hit ranges in words and in characters (ends excluded), the items found.
FOUND = StructType([
    StructField("n_words", LongType()),
    StructField("hits", ArrayType(StructType([StructField("first_word", LongType()), StructField("end_word", LongType())]))),
    StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
    StructField("items", ArrayType(StringType())),
])


def item_windows(benchmark: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window: w (its words, space-joined) and items (the ids that hold it, sorted)."""
    words = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                             "abcdefghijklmnopqrstuvwxyz"),
                                 F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), words.alias("x")).filter(F.size("x") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("x") - F.lit(window - 1), F.lit(1)))
    w = items.select("i", "x", F.explode(starts).alias("p")).select("i", F.array_join(F.slice("x", F.col("p"), window), " ").alias("w"))
    return w.groupBy("w").agg(F.sort_array(F.collect_set("i")).alias("items"))


class Automaton:
    """Windows as strings of word symbols, and the scan of a text."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        found: dict[str, list[str]] = {}
        known: dict[str, str] = {}
        for w, items in windows:
            # symbols skip the surrogates, which are no characters
            found["".join([known.setdefault(x, chr(n if (n := len(known) + 1) < 0xD800 else n + 0x800)) for x in w.split(" ")])] = items
        self.symbol = _Symbols((x.encode(), s) for x, s in known.items())
        self.automaton = ahocorasick.Automaton()
        for key, items in found.items():
            self.automaton.add_word(key, (len(key), tuple(items)))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]], list[str]]:
        """The fields of :data:`FOUND` for one text in UTF-8."""
        plain = raw.translate(_KEEP)
        words = plain.split()
        if self.empty or not words:
            return len(words), [], [], []
        ranges: list[list[int]] = []
        items: set[str] = set()
        for last, (n, ids) in self.automaton.iter("".join(map(self.symbol.__getitem__, words))):
            items.update(ids)
            first = last + 1 - n
            while ranges and ranges[-1][1] >= first:  # a longer window may reach back over earlier ones
                first = min(first, ranges.pop()[0])
            ranges.append([first, last + 1])
        if not ranges:
            return len(words), [], [], []
        inside = np.frombuffer(plain, np.uint8) != 32
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        spans, chars, at = [], 0, 0
        for first, end in ranges:
            lo, hi = int(edge[2 * first]), int(edge[2 * end - 1])
            start = chars + len(raw[at:lo].decode())
            chars, at = start + len(raw[lo:hi].decode()), hi
            spans.append((start, chars))
        return len(words), [(a, b) for a, b in ranges], spans, sorted(items)


class _Symbols(dict):
    """Words to symbols; every word that no item has is symbol zero."""

    def __missing__(self, key: bytes) -> str:
        return "\0"


_BUILT: dict[str, Automaton] = {}


def _automaton(key: str, shared) -> Automaton:
    """The automaton of a broadcast list of windows, built once per Python process."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(shared.value)
    return _BUILT[key]


def scan_column(text: Column, spark, windows: list[tuple[str, list[str]]]) -> Column:
    """A struct :data:`FOUND` per text, for a bounded list of windows."""
    key = hashlib.sha256(repr(windows).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(windows)

    @F.arrow_udf(FOUND)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = _automaton(key, shared)
        for t in texts:
            found = [a.scan(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in t]
            cols = [pa.array([f[0] for f in found], pa.int64()),
                    _ranges([f[1] for f in found], ("first_word", "end_word")),
                    _ranges([f[2] for f in found], ("start", "end")),
                    pa.array([f[3] for f in found], pa.list_(pa.string()))]
            yield pa.StructArray.from_arrays(cols, names=FOUND.names)
    return run(text)


def _ranges(rows: list[list[tuple[int, int]]], names: tuple[str, str]) -> pa.Array:
    """Lists of pairs as a list column of structs."""
    flat = np.array([p for r in rows for p in r], np.int64).reshape(-1, 2)
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=list(names))
    return pa.ListArray.from_arrays(pa.array(ends), pairs)


def _merged(ranges: str, lo: str, hi: str) -> Column:
    """Ranges of several automata, sorted and joined where they touch or overlap."""
    return F.expr(f"""aggregate(array_sort({ranges}), cast(array() as array<struct<{lo}:bigint,{hi}:bigint>>), (acc, r) ->
        CASE WHEN size(acc) > 0 AND element_at(acc, -1).{hi} >= r.{lo}
             THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('{lo}', element_at(acc, -1).{lo}, '{hi}', greatest(element_at(acc, -1).{hi}, r.{hi}))))
             ELSE concat(acc, array(r)) END)""")


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text", per_automaton: int = 100_000) -> DataFrame:
    """``id_col``, ``text_col`` and the fields of :data:`FOUND` for every document.

    ``per_automaton``: windows that one automaton takes, at most a million states
    at 10 words a window (and no more words than there are characters for symbols).
    """
    spark = docs.sparkSession
    windows = written(item_windows(benchmark, window, item_id, item_text), "item-windows")
    parts = max(1, -(-windows.count() // per_automaton))
    if parts == 1:
        got = docs.select(F.col(id_col), F.col(text_col), scan_column(F.col(text_col), spark, _collected(windows)).alias("__f"))
        return got.select(id_col, text_col, "__f.*")
    digest = F.sha2(F.col(text_col).cast("binary"), 256)
    hit = None
    for part in range(parts):
        mine = windows.filter(F.pmod(F.xxhash64("w"), F.lit(parts)) == part)
        f = docs.select(digest.alias("__h"), scan_column(F.col(text_col), spark, _collected(mine)).alias("f"))
        f = written(f.filter(F.size("f.hits") > 0).select("__h", "f.hits", "f.spans", "f.items").dropDuplicates(["__h"]), "item-hits")
        hit = f if hit is None else hit.unionByName(f)
    total = hit.groupBy("__h").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "spans", "items")])
    total = total.select("__h", _merged("hits", "first_word", "end_word").alias("hits"),
                         _merged("spans", "start", "end").alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    n_words = scan_column(F.col(text_col), spark, []).alias("__f")
    rows = docs.select(F.col(id_col), F.col(text_col), n_words).withColumn("__h", digest)
    empty = [F.coalesce(F.col(f"t.{c}"), F.col(f"r.__f.{c}")).alias(c) for c in ("hits", "spans", "items")]
    return rows.alias("r").join(total.alias("t"), F.col("r.__h") == F.col("t.__h"), "left").select(
        F.col(f"r.{id_col}"), F.col(f"r.{text_col}"), F.col("r.__f.n_words"), *empty)


def _collected(windows: DataFrame) -> list[tuple[str, list[str]]]:
    """A bounded share of the windows, in a fixed order."""
    return sorted((r.w, list(r["items"])) for r in windows.collect())


def hit_passages(found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per hit passage of :func:`find_items`: id, start, end (characters) and the passage as the document has it."""
    s = found.select(id_col, text_col, F.explode("spans").alias("s"))
    return s.select(id_col, "s.start", "s.end", F.substring(F.col(text_col), (F.col("s.start") + 1).cast("int"),
                                                            (F.col("s.end") - F.col("s.start")).cast("int")).alias("passage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, text_col: str = "text", **names) -> DataFrame:
    """Documents of which at most ``max_share`` of the words lie in benchmark passages; all columns stay."""
    key = docs.withColumn("__row", F.struct(*docs.columns))
    found = find_items(key, benchmark, id_col="__row", text_col=text_col, **names)
    return found.filter(n_hit() <= F.lit(max_share) * F.col("n_words")).select("__row.*")


def n_hit() -> Column:
    """Words of a document inside benchmark passages."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end_word"] - r["first_word"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    f = find_items(docs, benchmark, id_col=id_col, **names)
    return f.select(id_col, "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                    (F.size("hits") > 0).alias("contaminated"))
