"""Cross-tokenizer alignment over exactly deduplicated texts.

The texts are shuffled by their full text, and each distinct one is tokenised
and aligned once, with the number of its copies as weight. Both token sequences
cover the same bytes (a space and the text), so the places where tokens of A or
of B end cut the bytes into pieces that lie in one token of each: these are the
links. Places where both end cut the tokens into groups.

Both tokenizers settle at a single space between two characters that aren't
white space (A's pattern splits there; no piece of B holds a space after another
character, which is checked when the model is read). So a text is aligned
stretch by stretch between such spaces, in bounded memory for a text of any
length, and the alignment of short stretches is remembered per Python process.

Counting: the texts of one Arrow batch are a block. A block hands over its
distinct id pairs with their weighted counts, and each of its texts refers to
them by position. Pair counts are summed over the blocks, the best of each B id
is taken from the sums, and both go back to the blocks that asked, so what
shuffles is pairs per block, not links. Blocks are bounded by the batch size
(or by one text), and no pair, text or copy gathers more than one row a block.
The measures join the ids by the SHA-256 of the text, one row per distinct text.

Defined cases: a text that is NULL, empty, or that a tokenizer doesn't give back
byte for byte has no tokens: zeros and an empty string. Repeated rows and NULL ids
stay, extra columns are ignored, an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintage.llm.bpe import byte_alphabet
from vintage.llm.common import written

#: A pair of ids in one number: A id << SHIFT | B id.
SHIFT = 20

_CUT = re.compile(r"(?<=\S) (?=\S)")
_SUFFIXES = ",|;\n"

ALIGNED = ("block string, key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "at array<int>, times array<int>, pairs array<long>, weights array<long>")


class Aligner:
    """Two tokenizers and the alignment of texts under them."""

    def __init__(self, path_a: str, path_b: str, remember: int = 400_000, remember_links: int = 6_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in byte_alphabet().items()}
        vocab = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        size = max(max(vocab, default=0) + 1, self.b.vocab_size())
        names = [vocab.get(i, "") for i in range(size)]
        self.bytes_a = [bytes(byte_of[c] for c in t) if set(t) <= byte_of.keys() else t.encode() for t in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of B spans two words")
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.named = [f"{i}{s}" for i in range(size) for s in _SUFFIXES]
        self.remember, self.remember_links = remember, remember_links
        self.forget()

    def forget(self) -> None:
        """Start again without remembered stretches."""
        self.known: dict[str, int] = {}
        self.groups: list[str] = []  # per stretch: its groups as text
        self.good = np.zeros(1024, bool)
        self.counts = np.zeros((1024, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.start = np.zeros(1024, np.int64)
        self.links = np.zeros(4096, np.int64)
        self.used = 0

    def learn(self, stretches: list[str]) -> None:
        """Tokenise and align stretches, and number them."""
        odd = [s for s in stretches if not s or s[0].isspace() or s[-1].isspace()]
        for s in odd:
            self._learn_halves([s])
        self._learn_halves([s for s in stretches if s and not (s[0].isspace() or s[-1].isspace())] if odd else stretches)

    def _learn_halves(self, stretches: list[str]) -> None:
        """Learn stretches together; where some don't come back, by halves, to find which."""
        if self._learn(stretches, " ".join(stretches)):
            return
        if len(stretches) == 1:
            self._number(stretches, np.zeros((1, 4), np.int64), [""], np.empty(0, np.int64), False)
        else:
            self._learn_halves(stretches[:len(stretches) // 2])
            self._learn_halves(stretches[len(stretches) // 2:])

    def _learn(self, stretches: list[str], text: str) -> bool:
        """Learn stretches from their text, in which single spaces part them; False if it doesn't come back byte for byte."""
        if not stretches:
            return True
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        raw = f" {text}".encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw:
            return False
        stop = np.cumsum(np.fromiter(map(len, map(str.encode, stretches)), np.int64, len(stretches)) + 1)
        counts, pairs, lines = self._aligned(np.array(ids_a, np.int64), np.array(ids_b, np.int64), stop)
        self._number(stretches, counts, lines.split("\n")[:-1], pairs, True)
        return True

    def _number(self, stretches: list[str], counts: np.ndarray, groups: list[str], pairs: np.ndarray, good: bool) -> None:
        first, n = len(self.groups), len(stretches)
        self.known.update(zip(stretches, range(first, first + n)))
        self.groups += groups
        while first + n > len(self.start):
            self.counts, self.start, self.good = (np.concatenate([x, np.zeros_like(x)]) for x in (self.counts, self.start, self.good))
        self.good[first:first + n] = good
        self.counts[first:first + n] = counts
        self.start[first:first + n] = self.used + np.cumsum(counts[:, 3]) - counts[:, 3]
        while self.used + len(pairs) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[self.used:self.used + len(pairs)] = pairs
        self.used += len(pairs)

    def _aligned(self, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
        """Of stretches that end at the bytes ``stop``: counts of each, links of all, and the groups as text, a line each."""
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        in_a, in_b = np.zeros(stop[-1] + 1, bool), np.zeros(stop[-1] + 1, bool)
        in_a[ends_a] = in_b[ends_b] = True
        cuts, both = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
        pairs = a[np.searchsorted(ends_a, cuts)] << SHIFT | b[np.searchsorted(ends_b, cuts)]
        counts = np.stack([np.diff(np.searchsorted(x, stop, "right"), prepend=0) for x in (ends_a, ends_b, both, cuts)], axis=1)
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a * 4 + in_b[ends_a]
        last = np.zeros(stop[-1] + 1, bool)
        last[stop] = True
        codes[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b * 4 + np.where(in_a[ends_b], 2 + last[ends_b], 0)
        return counts, pairs, "".join(map(self.named.__getitem__, codes.tolist()))

    def _numbers(self, stretches: list[str]) -> np.ndarray:
        if len(self.known) > self.remember or self.used > self.remember_links:
            self.forget()
        found = list(map(self.known.get, stretches))
        if None in found:
            self.learn(list(dict.fromkeys(s for s, i in zip(stretches, found) if i is None)))
            found = list(map(self.known.__getitem__, stretches))
        return np.array(found, np.int64)

    def segments(self, text: str, size: int = 1 << 20) -> Iterator[list[str]]:
        """The stretches of a text, about ``size`` characters at a time."""
        at = 0
        while len(text) - at > size and (m := _CUT.search(text, at + size)):
            yield _CUT.split(text[at:m.start()])
            at = m.end()
        yield _CUT.split(text[at:] if at else text)

    def lossless(self, text: str) -> bool:
        """Whether both tokenizers give the bytes of the whole text back."""
        want, at, made = f" {text}".encode(), [0, 0], [b"", b""]
        for part in self.segments(text):
            for side, (ids, table) in enumerate(((self.a.encode_batch([" " + s for s in part], add_special_tokens=False), self.bytes_a),
                                                 (self.b.encode(part, num_threads=1), self.bytes_b))):
                made[side] = b"".join(table[i] for e in ids for i in (e if side else e.ids))
                if want[at[side]:at[side] + len(made[side])] != made[side]:
                    return False
                at[side] += len(made[side])
        return at == [len(want)] * 2

    def text(self, text: str) -> tuple[np.ndarray, str, np.ndarray] | None:
        """Counts (n_a, n_b, n_groups, n_links), SHA-256 of the groups, and the links of a text; None if it has no tokens."""
        total, digest, links = np.zeros(4, np.int64), hashlib.sha256(), []
        for i, stretches in enumerate(self.segments(text)):
            n = self._numbers(stretches)
            if not self.good[n].all():
                if not self.lossless(text):
                    return None
                self.forget()  # stretches that only together give the bytes back: the text is one stretch
                self.learn([text])
                return self.counts[0].copy(), hashlib.sha256(self.groups[0].encode()).hexdigest(), self.links[:self.used].copy()
            total += self.counts[n].sum(axis=0)
            digest.update((";" if i else "").encode() + ";".join(map(self.groups.__getitem__, n.tolist())).encode())
            links.append(self._links(n))
        return total, digest.hexdigest(), np.concatenate(links)

    def _links(self, n: np.ndarray) -> np.ndarray:
        m = self.counts[n, 3]
        return self.links[np.repeat(self.start[n] - (np.cumsum(m) - m), m) + np.arange(m.sum())]

    def texts(self, texts: list[str], size: int = 1 << 20) -> Iterator[tuple[np.ndarray, str, np.ndarray] | None]:
        """:meth:`text` of each text; short ones together, about ``size`` characters at a time."""
        group: list[str] = []
        chars = 0
        for t in texts:
            if chars + len(t) > size and group:
                yield from self._group(group)
                group, chars = [], 0
            if len(t) > size:
                yield self.text(t)
            else:
                group.append(t)
                chars += len(t)
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray] | None]:
        parts = [_CUT.split(t) for t in texts]
        n = self._numbers([s for p in parts for s in p])
        good, counts, links = self.good[n], self.counts[n], self._links(n)
        ends = np.cumsum([len(p) for p in parts])
        link_ends = np.cumsum(counts[:, 3])[ends - 1]
        numbers, groups, at, link_at, odd = n.tolist(), self.groups, 0, 0, []
        out: list = []
        for t, end, link_end in zip(texts, ends.tolist(), link_ends.tolist()):
            if good[at:end].all():
                sha = hashlib.sha256(";".join(map(groups.__getitem__, numbers[at:end])).encode()).hexdigest()
                out.append((counts[at:end].sum(axis=0), sha, links[link_at:link_end]))
            else:
                odd.append(len(out))
                out.append(t)
            at, link_at = end, link_end
        for i in odd:
            out[i] = self.text(out[i])
        yield from out

    def block(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of :data:`ALIGNED` for the texts of one batch: a row per text, and one with the block's pairs."""
        keys, copies = batch["key"].to_pylist(), batch["copies"].to_pylist()
        counts, shas, links = [], [], []
        for got in self.texts(batch["text"].to_pylist()):
            counts.append(got[0] if got else np.zeros(4, np.int64))
            shas.append(got[1] if got else "")
            links.append(got[2] if got else np.empty(0, np.int64))
        n = len(keys)
        of = np.repeat(np.arange(n), [len(x) for x in links])
        pairs, where = np.unique(np.concatenate(links), return_inverse=True)
        # distinct pairs of each text, with their occurrences
        own, times = np.unique(of * max(len(pairs), 1) + where, return_counts=True)
        of, where = np.divmod(own, max(len(pairs), 1))
        weights = np.bincount(where, times * np.array(copies, np.float64)[of], len(pairs)).astype(np.int64)
        ends = np.searchsorted(of, [*range(n + 1), n]).astype(np.int32)
        c = np.array([*counts, np.zeros(4, np.int64)])
        lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
        block_list = lambda x: pa.ListArray.from_arrays(pa.array(np.array([0] * (n + 1) + [len(x)], np.int32)), pa.array(x))
        name = keys[0].hex()
        cols = [pa.array([name] * (n + 1)), pa.array([*keys, None], pa.binary()), pa.array([*copies, None], pa.int64()),
                *[pa.array(c[:, i]) for i in range(4)], pa.array([*shas, None], pa.string()), lists(where), lists(times),
                block_list(pairs), block_list(weights)]
        return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in ALIGNED.split(", ")])


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The tokenizers of two files, read once per Python process."""
    return Aligner(path_a, path_b)


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key (SHA-256), text, copies: one row per distinct text that isn't empty; shuffles by the full text."""
    d = docs.select(F.col(text_col).alias("text")).filter(F.length("text") > 0)
    d = d.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return d.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), "text", "copies")


def aligned_blocks(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """:data:`ALIGNED` rows of distinct texts; A ids and B ids as the two files give them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = aligner(path_a, path_b)
        for b in batches:
            if b.num_rows:
                yield a.block(b)
    return texts.mapInArrow(run, ALIGNED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n (links over all documents that hold it linked), best (whether no A id is linked more often to its B id)."""
    p = blocks.filter("key IS NULL").select(F.explode(F.arrays_zip("pairs", "weights")).alias("p"))
    p = p.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.weights").alias("n"))
    p = written(p, "pair-counts")
    b = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    top = p.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    return p.withColumn("b", b).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def links_by_id(blocks: DataFrame) -> DataFrame:
    """a_id, b_id, n, best: the linked ids of the corpus, e.g. to carry embeddings from one vocabulary to the other."""
    return pair_counts(blocks).select(F.shiftright("pair", SHIFT).alias("a_id"),
                                      F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b_id"), "n", "best")


def measured(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """key and the measures of each distinct text."""
    asked = blocks.filter("key IS NULL").select(F.col("block").alias("of"), F.posexplode("pairs").alias("i", "pair"))
    asked = asked.join(counts, "pair").select("of", "i", "n", "best")
    texts = blocks.filter("key IS NOT NULL").drop("pairs", "weights")

    def run(t: pa.Table, c: pa.Table) -> pa.Table:
        order = np.empty(c.num_rows, np.int64)
        order[c["i"].to_numpy()] = np.arange(c.num_rows)
        n, best = c["n"].to_numpy()[order], c["best"].to_numpy()[order]
        at, times = (t[k].combine_chunks() for k in ("at", "times"))
        of = np.repeat(np.arange(t.num_rows), at.value_lengths().to_numpy())
        at, times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        n_best, total = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64)
        np.add.at(n_best, of, times * best[at])
        np.add.at(total, of, times * n[at])
        keep = t.select(["key", "n_a", "n_b", "n_groups", "n_links"])
        return (keep.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(total))
                .append_column("groups_sha256", t["groups_sha256"]))
    return texts.groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(
        run, "key binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    blocks = written(aligned_blocks(distinct_texts(docs, text_col), path_a, path_b), "aligned")
    m = written(measured(blocks, pair_counts(blocks)), "alignment")
    ids = docs.select(F.col(id_col), F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)).alias("__key"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return ids.join(m, F.col("__key") == F.col("key"), "left").select(
        F.col(id_col).cast("long").alias(id_col), *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
