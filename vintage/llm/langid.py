"""Language identification with interpolated Kneser-Ney character models.

One model per language over the letters of the lower-cased text; every run of
other characters is one space. A language is counted and fitted by the task that
holds its sample, alone: per order a sorted array of 64-bit n-gram hashes with
their log-probabilities (already interpolated), and a sorted array of context
hashes with the weights that lead to the next shorter context. All languages
share the size of the alphabet below their shortest context. Only these compact
arrays come to the driver and are broadcast. A block of text looks up each of
its distinct n-grams once per language; the language with the lowest
cross-entropy per character wins.

Rejection: labelled documents that the models did not see are scored in Spark.
The cross-entropy of the right language has mean m and, for a text of n
characters, spread s(n) = sqrt(a + b / n). The bound of a language is
m + z s(n); ``reject_rate`` is the share of its own documents that may lie
above it. Rates below what the sample can show are read off an exponential
tail that is fitted to the largest tenth of the sample (its mean excess), so a
smaller rate always gives a wider bound. z is read off the language's own
sample and off that of all languages; the wider one holds. The score is the softmax of the
negative cross-entropies, its scale fitted to the same documents.

Learning reads at most ``docs_per_lang`` documents of each language, those with
the smallest id hash, and ``max_docs`` in all (a bounded sample for a classifier). Scoring covers every
text as a whole; long texts are scored in blocks that overlap by the context.

Defined cases: a text that is NULL or has no letter is ``und``, score 0, not
accepted. Documents without a language or an id teach nothing; they are scored
like all others. Of equal cross-entropies the language that sorts first wins.
Rows that repeat stay repeated. Without any labelled document every text is
``und``. Extra columns pass through :func:`drop_rejected`.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from vintage.llm.common import id_remainder, smallest_by_hash, written

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 19
_ARRAYS = ["lang", "level", "keys", "logp", "contexts", "logw"]
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; a run of anything else is one 32. Empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _letters()[codes]
    if not ok.any():
        return np.zeros(0, np.uint32)
    codes = np.where(ok, codes, np.uint32(32))
    keep = ok.copy()
    keep[1:] |= ok[:-1]
    codes = codes[keep]
    return codes if codes[0] != 32 else codes[1:]


def _hash_orders(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """hashes[n][i]: the n characters that end at i, n from 0 to ``order`` (positions before that are void)."""
    one = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    one ^= one >> np.uint64(29)
    out = [np.zeros(len(codes), np.uint64), one]
    for _ in range(order - 1):
        prev = np.empty_like(one)
        prev[0] = 0
        prev[1:] = out[-1][:-1]
        nxt = prev * _MULT
        nxt ^= nxt >> np.uint64(31)
        out.append(nxt + one)
    return out


def _representatives(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of representatives and, by value, which of them is equal to it.

    A table by upper bits finds them without sorting; of values that share a
    slot, one is found again and the others stand for themselves.
    """
    n = np.arange(len(h), dtype=np.int32)
    bits = max(4, len(h).bit_length() + 1)
    slot = (h >> np.uint64(64 - bits)).astype(np.int32)
    last = np.empty(1 << bits, np.int32)
    last[slot] = n
    rep = last[slot]
    rep = np.where(h[rep] == h, rep, n)
    chosen = np.zeros(len(h), bool)
    chosen[rep] = True
    return np.flatnonzero(chosen), (np.cumsum(chosen, dtype=np.int32) - 1)[rep]


@dataclass
class SortedHashes:
    """A sorted hash array with an index on the upper bits."""

    keys: np.ndarray
    start: np.ndarray = field(init=False)
    shift: int = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        bits = max(4, int(len(self.keys)).bit_length())
        self.shift = 64 - bits
        self.start = np.searchsorted(self.keys >> np.uint64(self.shift), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.start).max()) if len(self.keys) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        at = self.start[h >> np.uint64(self.shift)]
        out = np.full(len(h), -1, np.int32)
        last = len(self.keys) - 1
        todo = None
        for step in range(self.longest):
            if todo is None:
                row = np.minimum(at, last)
                hit = self.keys[row] == h
                out[hit] = row[hit]
                todo = np.flatnonzero(~hit)
            else:
                row = np.minimum(at[todo] + step, last)
                k = self.keys[row]
                hit = k == h[todo]
                out[todo[hit]] = row[hit]
                todo = todo[k < h[todo]]  # sorted: beyond a larger key there is nothing
            if not len(todo):
                break
        return out


@dataclass
class LangModel:
    """The Kneser-Ney model of one language in sorted hash arrays."""

    grams: list[SortedHashes]  # by order - 1
    logp: list[np.ndarray]
    contexts: list[SortedHashes]
    logw: list[np.ndarray]

    def log_probabilities(self, hs: list[np.ndarray], before: list[np.ndarray], floor: float) -> np.ndarray:
        """By n-gram: log-probability of its last character; hashes of its ends and of what precedes the last one."""
        total = np.zeros(len(hs[0]), np.float32)
        todo = np.arange(len(total))
        for n in range(len(self.grams), 0, -1):
            row = self.grams[n - 1].find(hs[n][todo])
            hit = row >= 0
            total[todo[hit]] += self.logp[n - 1][row[hit]]
            todo = todo[~hit]
            if not len(todo):
                return total
            ctx = self.contexts[n - 1].find(before[n - 1][todo])
            known = ctx >= 0
            total[todo[known]] += self.logw[n - 1][ctx[known]]
        total[todo] += np.float32(floor)
        return total


@dataclass
class CharModels:
    """One model per language and the rejection bounds."""

    langs: list[str]
    order: int
    models: list[LangModel]
    floor: float  # log-probability of a character that no language has, before weights
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None  # (a, b) by language
    z: np.ndarray | None = None
    scale: float = 1.0

    def _block(self, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities by language and position; the first order - 1 positions are context only."""
        hs = _hash_orders(codes, self.order)
        lead = self.order - 1
        at, inv = _representatives(hs[self.order][lead:])
        at += lead
        ends, before = [h[at] for h in hs], [h[at - 1] for h in hs]
        return np.stack([m.log_probabilities(ends, before, self.floor)[inv] for m in self.models])

    def cross_entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Nats per character, by text and language; inf for a text without letters."""
        lead = self.order - 1
        pad = np.full(lead, 32, np.uint32)
        out = np.zeros((len(texts), len(self.langs)))
        queue, size = [], 0  # (text number, codes with their context)

        def flush() -> None:
            block = self._block(np.concatenate([c for _, c in queue]))
            at = 0
            for text, c in queue:  # what follows a text's own positions belongs to the next one's context
                out[text] -= block[:, at:at + len(c) - lead].sum(axis=1, dtype=np.float64)
                at += len(c)
            queue.clear()

        for i, t in enumerate(texts):
            whole = np.concatenate([pad, t])
            for at in range(0, len(t), _BLOCK):
                part = whole[at:at + _BLOCK + lead]
                queue.append((i, part))
                size += len(part)
                if size >= _BLOCK:
                    flush()
                    size = 0
        if queue:
            flush()
        n = np.array([len(t) for t in texts])
        return np.where(n[:, None] > 0, out / np.maximum(n, 1)[:, None], np.inf)

    def calibrate(self, ce: np.ndarray, n: np.ndarray, right: np.ndarray, reject_rate: float) -> None:
        """Fit the rejection bounds and the score's scale to the cross-entropies of labelled texts with ``n`` letters."""
        ok = n > 0
        ce, n, right = ce[ok], n[ok], right[ok]
        L = len(self.langs)
        self.mean, self.spread, self.z = np.zeros(L), np.tile([0.05, 10.0], (L, 1)), np.full(L, np.inf)
        mine = ce[np.arange(len(right)), right]
        for k in range(L):
            own = right == k
            if own.sum() < 20:
                own[:] = True  # too few of this language: the bound of all of them together
            if own.sum() < 20:
                continue  # too few to tell: nothing is rejected
            x, m = mine[own], n[own]
            self.mean[k] = np.average(x, weights=m)
            short = m < np.median(m)
            v_long, v_short = np.mean((x[~short] - self.mean[k]) ** 2), np.mean((x[short] - self.mean[k]) ** 2)
            i_long, i_short = np.mean(1 / m[~short]), np.mean(1 / m[short]) if short.any() else np.mean(1 / m)
            b = max(0.5, (v_short - v_long) / max(1e-9, i_short - i_long))
            self.spread[k] = [max(1e-4, v_long - b * i_long), b]
            self.z[k] = _tail_bound((x - self.mean[k]) / np.sqrt(self.spread[k][0] + self.spread[k][1] / m), reject_rate)
        known = np.isfinite(self.z)[right]
        if known.any():
            k, m = right[known], n[known]
            pooled = _tail_bound((mine[known] - self.mean[k]) / np.sqrt(self.spread[k, 0] + self.spread[k, 1] / m), reject_rate)
            self.z = np.maximum(self.z, pooled)
        if len(right):
            scales = 2.0 ** np.arange(-2, 8)
            self.scale = float(min(scales, key=lambda s: -np.mean(
                np.log(_softmax(-ce * s)[np.arange(len(right)), right] + 1e-12))))

    def predict(self, texts: list[np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is accepted."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        ce, n = self.cross_entropies(texts), np.array([len(t) for t in texts])
        best = ce.argmin(axis=1)
        own = ce[np.arange(len(texts)), best]
        some = n > 0
        score = np.zeros(len(texts))
        score[some] = _softmax(-ce[some] * self.scale)[np.arange(some.sum()), best[some]]
        bound = self.mean[best] + self.z[best] * np.sqrt(self.spread[best, 0] + self.spread[best, 1] / np.maximum(n, 1))
        return [self.langs[b] if s else "und" for b, s in zip(best, some)], score, some & (own <= bound)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _tail_bound(zs: np.ndarray, rate: float) -> float:
    """The value that a share ``rate`` exceeds: a quantile of ``zs``, beyond the largest tenth's start an exponential tail."""
    if rate <= 0:
        return np.inf
    if rate >= 0.1:
        return float(np.quantile(zs, 1 - rate))
    start = float(np.quantile(zs, 0.9))
    excess = zs[zs > start] - start
    return start + float(np.mean(excess) if len(excess) else 0.0) * float(np.log(0.1 / rate))


def _tail_hash(rows: np.ndarray) -> np.ndarray:
    """Hash of each row of code points, as _hash_orders gives it."""
    if not rows.shape[1]:
        return np.zeros(len(rows), np.uint64)
    flat = _hash_orders(np.ascontiguousarray(rows).ravel(), rows.shape[1])[rows.shape[1]]
    return flat[rows.shape[1] - 1::rows.shape[1]]


def fit_language(grams: np.ndarray, counts: np.ndarray, order: int, floor: float) -> LangModel:
    """One language's model from its distinct n-grams (rows of code points) and their counts."""
    rows, numbers = {order: grams}, {order: np.asarray(counts, np.float64)}
    for n in range(order - 1, 0, -1):  # continuation counts: distinct characters to the left
        rows[n], c = np.unique(np.unique(rows[n + 1][:, -n - 1:], axis=0)[:, 1:], axis=0, return_counts=True)
        numbers[n] = c.astype(np.float64)
    m, lower = LangModel([], [], [], []), None  # lower: probabilities of the next shorter order, by row
    for n in range(1, order + 1):
        key = _tail_hash(rows[n])
        by = np.argsort(key)
        key, c, g = key[by], numbers[n][by], rows[n][by]
        ctx, ctx_of = np.unique(_tail_hash(g[:, :-1]), return_inverse=True)
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total, kinds = np.bincount(ctx_of, c, len(ctx)), np.bincount(ctx_of, minlength=len(ctx))
        weight = d * kinds / total
        base = np.exp(floor) if n == 1 else lower[np.searchsorted(m.grams[-1].keys, _tail_hash(g[:, 1:]))]
        lower = (c - d) / total[ctx_of] + weight[ctx_of] * base
        m.grams.append(SortedHashes(key))
        m.logp.append(np.log(lower).astype(np.float32))
        m.contexts.append(SortedHashes(ctx))
        m.logw.append(np.log(weight).astype(np.float32))
    return m


def floor_of(characters: int) -> float:
    """Log-probability of any character below the shortest context, for an alphabet of that size and one unknown."""
    return -float(np.log(characters + 1))


def _alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct code points of a task's texts."""
    seen = np.zeros(0, np.uint32)
    for b in batches:
        for x in b.column("text"):
            seen = np.union1d(seen, letters_of(x.as_py()))
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64))], names=["code"])


def _fit_task(order: int, floor: float):
    """Per language: count the n-grams of the sample's texts, fit, and give the arrays of each order."""
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.full(order - 1, 32, np.uint32)
        keys, grams, n = np.zeros(0, np.uint64), np.zeros((0, order), np.uint32), np.zeros(0, np.int64)

        def add(parts: list[np.ndarray]) -> None:
            nonlocal keys, grams, n
            h = np.concatenate([_hash_orders(p, order)[order][order - 1:] for p in parts])
            w = np.concatenate([np.lib.stride_tricks.sliding_window_view(p, order) for p in parts])
            k, first, c = np.unique(h, return_index=True, return_counts=True)
            every, at, inv = np.unique(np.concatenate([keys, k]), return_index=True, return_inverse=True)
            n = np.bincount(inv, np.concatenate([n, c]), len(every)).astype(np.int64)
            keys, grams = every, np.concatenate([grams, w[first]])[at]

        parts, held = [], 0
        for b in batches:
            for x in b.column("text"):
                t = letters_of(x.as_py())
                for at in range(0, len(t), _BLOCK):  # blocks overlap by the context
                    lead = pad if at == 0 else t[at - order + 1:at]
                    parts.append(np.concatenate([lead, t[at:at + _BLOCK]]))
                    held += len(parts[-1])
                    if held >= _BLOCK:
                        add(parts)
                        parts, held = [], 0
        if parts:
            add(parts)
        if not len(grams):
            return
        m = fit_language(grams, n, order, floor)
        for i in range(order):
            arrays = (m.grams[i].keys, m.logp[i], m.contexts[i].keys, m.logw[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0].as_py()]), pa.array([i], pa.int32())] + [pa.array([a.tobytes()], pa.binary()) for a in arrays],
                names=_ARRAYS)
    return run


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int,
            max_docs: int) -> DataFrame:
    """(lang, text, r): the documents to learn from, ``docs_per_lang`` of each language and ``max_docs`` at most."""
    ids = (docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
           .filter(F.col("lang").isNotNull() & (id_remainder("id", 5) != 0)).distinct()
           .withColumn("r", F.xxhash64(F.lit("learn"), "id")))
    ids = smallest_by_hash(ids, ["lang"], "r", "id", docs_per_lang)
    ids = ids.orderBy("r", "lang", "id").limit(max_docs).select(F.col("id").alias("sid"), F.col("lang").alias("slang"), "r")
    ids = F.broadcast(ids)  # max_docs rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = texts.join(ids, (F.col("id") == F.col("sid")) & (F.col("lang") == F.col("slang")))
    return found.groupBy("lang", "r", "id").agg(F.min("text").alias("text")).filter(F.col("text").isNotNull())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 5,
          docs_per_lang: int = 1500, max_docs: int = 100_000, reject_rate: float = 1e-5) -> CharModels:
    """Models from labelled documents whose crc32(id) mod 5 is not 0. A quarter of the sample calibrates."""
    s = _sample(docs, id_col, text_col, lang_col, docs_per_lang, max_docs).withColumn("calibrates", F.pmod("r", F.lit(4)) == 0)
    s = written(s, "langid-sample")
    learn, held = s.filter("not calibrates").select("lang", "text"), s.filter("calibrates").select("lang", "text")
    floor = floor_of(learn.select("text").mapInArrow(_alphabet, "code long").distinct().count())
    arrays = learn.groupBy("lang").applyInArrow(
        _fit_task(order, floor), "lang string, level int, keys binary, logp binary, contexts binary, logw binary")
    found: dict[str, list] = {}
    for r in sorted(arrays.collect(), key=lambda r: (r.lang, r.level)):  # the models: bounded by the sample
        found.setdefault(r.lang, []).append(r)
    models = CharModels(list(found), order, [LangModel(
        [SortedHashes(np.frombuffer(r.keys, np.uint64)) for r in rows], [np.frombuffer(r.logp, np.float32) for r in rows],
        [SortedHashes(np.frombuffer(r.contexts, np.uint64)) for r in rows], [np.frombuffer(r.logw, np.float32) for r in rows])
        for rows in found.values()], floor)
    if found:
        scored = held.filter(F.col("lang").isin(models.langs)).select(
            "lang", cross_entropy_column(F.col("text"), models, docs.sparkSession).alias("p")).select("lang", "p.*").collect()
        models.calibrate(np.array([r.ce for r in scored]).reshape(-1, len(found)), np.array([r.n for r in scored], np.int64),
                         np.array([models.langs.index(r.lang) for r in scored], int), reject_rate)
    return models


def _in_blocks(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """The letters of a batch's texts, in lists of bounded size."""
    codes, held = [], 0
    for i, x in enumerate(texts):
        codes.append(letters_of(x.as_py() or ""))
        held += len(codes[-1])
        if held >= _BLOCK or len(codes) == 512 or i == len(texts) - 1:
            yield codes
            codes, held = [], 0


def cross_entropy_column(text: Column, models: CharModels, spark) -> Column:
    """A struct per text: its cross-entropy under every model and its number of letters."""
    shared = spark.sparkContext.broadcast(models)  # bounded by the sample that it was learned from

    @F.arrow_udf("struct<ce: array<double>, n: bigint>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            rows = [{"ce": ce.tolist(), "n": len(c)} for codes in _in_blocks(t)
                    for ce, c in zip(shared.value.cross_entropies(codes), codes)]
            yield pa.array(rows, pa.struct([("ce", pa.list_(pa.float64())), ("n", pa.int64())]))
    return run(text)


PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                         StructField("accepted", BooleanType()), StructField("n_letters", LongType())])


def predict_column(text: Column, models: CharModels, spark) -> Column:
    """A struct per text: lang_pred, score, accepted, n_letters."""
    shared = spark.sparkContext.broadcast(models)  # bounded by the sample that it was learned from

    @F.arrow_udf(PREDICTION)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for t in texts:
            langs, scores, ok, sizes = [], [], [], []
            for codes in _in_blocks(t):
                a, b, c = m.predict(codes)
                langs += a
                scores.append(b)
                ok.append(c)
                sizes += [len(y) for y in codes]
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()),
                 pa.array(np.concatenate(ok) if ok else [], pa.bool_()), pa.array(sizes, pa.int64())],
                names=PREDICTION.names)
    return run(text)


def identify(docs: DataFrame, models: CharModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, accepted."""
    p = predict_column(F.col(text_col), models, docs.sparkSession)
    held = F.coalesce(id_remainder(id_col, 5) == 0, F.lit(False))
    return docs.select(F.col(id_col), held.alias("held_out"), p.alias("__p")).select(
        id_col, "held_out", "__p.lang_pred", "__p.score", "__p.accepted")


def drop_rejected(docs: DataFrame, models: CharModels, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that no model accepts (those without a letter included)."""
    cols = docs.columns
    p = predict_column(F.col(text_col), models, docs.sparkSession)
    return docs.withColumn("__p", p).filter("__p.accepted").select(*cols)
