"""Document operators: cleaning, page text, noise refilter, length profiles,
token chunking and a deterministic train/validation split.

Everything runs per document (a row); nothing groups documents, so a large
source or corpus never concentrates in one task. Where a step needs what
Spark lacks (HTML entities, ``html.parser``, the O(n) sliding-window count), the
whole step is one Arrow UDF from text to text, so no token array crosses over.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintage.functions import text as TX
from vintage.functions.core import col, md5_number

# Fixed values of the refilter (G6/G7) and the chunkers.
WINDOW_TOKENS = 100
CONTENT_THRESHOLD = 0.40
LOCAL_RADIUS = 5
MIN_OUTPUT_LENGTH = 500
CHUNK_LEN = 512
STRIDE = 64
MIN_CHUNK_TOKENS = 128
MIN_EMBED_CHARS = 100


# --------------------------------------------------------------------------- #
# small Python helpers used inside Arrow UDFs
# --------------------------------------------------------------------------- #
_TAG = re.compile(TX.TAG)
_HTML_LIKE = re.compile(TX.HTML_LIKE)


@lru_cache(maxsize=16)
def _body_pattern(tag: str) -> re.Pattern:
    return re.compile(TX.TEXT_BLOCK if tag == "TEXT" else rf"(?is)<{tag}[^>]*>(.*?)</{tag}>")


def _clean(doc: str, tag: str) -> str:
    """G3 on one document: bodies (or all of it), tags to space, entities, white space."""
    parts = _body_pattern(tag).findall(doc) or [doc]
    cleaned = (" ".join(html.unescape(_TAG.sub(" ", x)).split()) for x in parts)
    return "\n".join(x for x in cleaned if x)


def _clean_column(c, tag: str) -> Column:
    @F.arrow_udf(T.StringType())
    def run(docs: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for d in docs:
            yield pa.array([None if (x := v.as_py()) is None else _clean(x, tag) for v in d], pa.string())
    return run(col(c))


#: What a page's head may hold; any other start tag ends an unclosed head.
_HEAD_CONTENT = frozenset({"title", "meta", "link", "base", "style", "script", "noscript", "template", "html", "head", "bgsound"})


class _TextCollector(HTMLParser):
    """Text nodes of a page; skips the subtrees named in ``skip`` and comments.

    The end tag of the head may be left out: the head then ends at the body or
    at the first tag that a head can't hold. A ``<`` that begins no tag is text,
    and text up to the next tag or comment is one node.
    """

    def __init__(self, skip: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.skip, self.depth, self.in_head = skip - {"head", "meta"}, 0, False
        self.nodes: list[list[str]] = []
        self.ended = True  # whether markup came since the last text
        self.skip_head = "head" in skip

    @property
    def parts(self) -> list[str]:
        """The text of each node."""
        return ["".join(n) for n in self.nodes]

    def handle_comment(self, data):
        self.ended = True

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_starttag(self, tag, attrs):
        self.ended = True
        if tag == "head":
            self.in_head = self.skip_head
        elif self.in_head and tag not in _HEAD_CONTENT:
            self.in_head = False
        if tag in self.skip:
            self.depth += 1

    def handle_startendtag(self, tag, attrs):
        self.ended = True

    def handle_endtag(self, tag):
        self.ended = True
        if tag in ("head", "html"):
            self.in_head = False
        if tag in self.skip and self.depth > 0:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth == 0 and not self.in_head:
            if self.ended:
                self.nodes.append([])
            self.nodes[-1].append(data)
            self.ended = False


def _page_text(doc: str | None, skip: frozenset[str], sep: str) -> str | None:
    if doc is None:
        return None
    p = _TextCollector(skip)
    try:
        p.feed(doc)
        p.close()
    except Exception:  # noqa: BLE001 - malformed markup: keep what was parsed
        pass
    return sep.join(p.parts)


_PARSER_SKIP = frozenset({"script", "style", "head", "meta"})


@F.pandas_udf(T.StringType())
def _html_lines_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda d: _page_text(d, _PARSER_SKIP, "\n"))


def keep_mask(flags: np.ndarray, window: int = WINDOW_TOKENS, threshold: float = CONTENT_THRESHOLD,
              radius: int = LOCAL_RADIUS) -> np.ndarray:
    """G6/G7 on one document's content flags, O(n) with prefix sums."""
    f = np.asarray(flags, dtype=np.int64)
    n = f.size
    if n == 0:
        return np.zeros(0, dtype=bool)
    if n <= window:
        return np.full(n, f.sum() / n >= threshold)
    cum = np.concatenate(([0], np.cumsum(f)))
    i = np.arange(n)
    half = window // 2
    lo, hi = np.maximum(0, i - half), np.minimum(n, i + half)
    keep = (cum[hi] - cum[lo]) / (hi - lo) >= threshold
    back = cum[i] - cum[np.maximum(0, i - radius)] > 0
    fwd = cum[np.minimum(n, i + radius + 1)] - cum[np.minimum(n, i + 1)] > 0
    return keep & (f.astype(bool) | (back & fwd))


# --------------------------------------------------------------------------- #
# G1-G3 cleaning, G4 page text
# --------------------------------------------------------------------------- #
def clean_text(c, tag: str = "TEXT", entities: str = "full") -> Column:
    """Envelope bodies (or the whole input) -> tags to space -> entity decode
    -> whitespace collapse -> strip; empty bodies dropped; joined by newline.

    ``entities="full"`` decodes like ``html.unescape`` (one Arrow UDF from
    text to text); ``"basic"`` is the SQL-expressible named-entity subset.
    """
    if entities == "basic":
        return TX.clean_text_basic(c, tag)
    return _clean_column(c, tag)


def clean_documents(df: DataFrame, text: str, out: str = "clean_text", tag: str = "TEXT",
                    entities: str = "full", min_length: int | None = MIN_OUTPUT_LENGTH) -> DataFrame:
    """G3 + B5: cleaned text and its length; rows shorter than ``min_length`` dropped."""
    r = df.withColumn(out, clean_text(text, tag, entities)).withColumn("n_chars", F.length(out))
    return r.filter(F.col("n_chars") >= min_length) if min_length else r


def page_text(c, method: str = "parser") -> Column:
    """Visible text of a page, one line per text block, blank lines dropped.

    ``parser`` uses stdlib ``html.parser`` (script/style/head subtrees and
    comments skipped, entities decoded); ``regex`` is the SQL-expressible form.
    """
    if method == "parser":
        raw = _html_lines_udf(col(c))
    else:
        x = col(c)
        for pat in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>",
                    r"(?is)<head\b.*?</head>", r"(?s)<!--.*?-->", r"(?is)<meta\b[^>]*>", r"(?is)<!doctype[^>]*>"):
            x = F.regexp_replace(x, pat, "")
        raw = TX.decode_basic_entities(F.regexp_replace(x, TX.TAG, "\n"))
    lines = F.filter(F.transform(F.split(raw, "\n"), TX.strip_ws), lambda s: s != "")
    return F.array_join(lines, "\n")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _html_lines_all(arrs: pd.Series) -> pd.Series:
    def one(a):
        if a is None:
            return None
        out = []
        for body in a:
            lines = (ln.strip() for ln in (_page_text(body, _PARSER_SKIP, "\n") or "").split("\n"))
            out.append("\n".join(ln for ln in lines if ln))
        return out
    return arrs.map(one)


def sgml_text(c, tag: str = "TEXT", method: str = "parser") -> Column:
    """G4 for envelopes: the page text of every ``<TAG>`` body, non-empty bodies
    joined by a blank line; input without an envelope is read as one page."""
    bodies = TX.extract_bodies(c, tag)
    parts = F.when(F.size(bodies) == 0, F.array(col(c))).otherwise(bodies)
    if method == "parser":
        texts = _html_lines_all(parts)
    else:
        texts = F.transform(parts, lambda b: page_text(b, "regex"))
    return F.array_join(F.filter(texts, lambda s: s != ""), "\n\n")


# --------------------------------------------------------------------------- #
# G5-G7 refilter
# --------------------------------------------------------------------------- #
_WORDS_SKIP = frozenset({"script", "style", "template"})


def html_words(doc: str) -> str:
    """Text of HTML-like input for the refilter: a parser drops script, style and
    template contents and comments, turns tags into spaces and decodes entities."""
    return _page_text(doc, _WORDS_SKIP, " ") or ""


def content_token(t: str) -> bool:
    """G5 on one token; the column form is ``functions.text.is_content_token``."""
    n = len(t)
    return (2 <= n <= 40 and t[0].isalpha() and not any(x in t for x in ':="/')
            and sum(map(str.isalpha, t)) / n >= 0.6)


class _Refilter:
    """G6/G7 on one document; flags of tokens are remembered up to a fixed number."""

    def __init__(self, remember: int = 200_000):
        self.flags: dict[str, bool] = {}
        self.remember = remember

    def __call__(self, doc: str) -> tuple[str, list[str], np.ndarray, np.ndarray]:
        """(kept text, tokens, flags, keep mask)."""
        tok = (html_words(doc) if _HTML_LIKE.search(doc) else doc).split()
        get = self.flags.get
        flags = [get(t) for t in tok]
        if None in flags:
            if len(self.flags) > self.remember:
                self.flags.clear()
            for i, f in enumerate(flags):
                if f is None:
                    flags[i] = self.flags[tok[i]] = content_token(tok[i])
        f = np.array(flags, bool)
        keep = keep_mask(f)
        return " ".join(compress(tok, keep.tolist())), tok, f, keep


_REFILTERED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType()),
                            T.StructField("c", T.IntegerType()), T.StructField("k", T.IntegerType()),
                            T.StructField("flags", T.ArrayType(T.BooleanType()))])


def _refilter_column(c, with_flags: bool) -> Column:
    """The refiltered text, its counts and (if asked) the flags."""
    @F.arrow_udf(_REFILTERED)
    def run(docs: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = _Refilter()
        for d in docs:
            out = []
            for v in d:
                if (x := v.as_py()) is None:
                    out.append((None, -1, -1, -1, None))
                    continue
                t, tok, f, keep = one(x)
                out.append((t, len(tok), int(f.sum()), int(keep.sum()), f.tolist() if with_flags else None))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.bool_()))
            yield pa.StructArray.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                                             names=_REFILTERED.names)
    return run(col(c))


def refilter(df: DataFrame, text: str, out: str = "refiltered", keep_flags: bool = False) -> DataFrame:
    """Drop noise tokens by content density.

    One Arrow UDF from text to text: HTML-like input is first reduced to its
    text by a parser; then the tokens are flagged, and the sliding window and
    radius pass use prefix sums (O(n)). A NULL text stays NULL, its counts -1.
    """
    x = df.withColumn("_r", _refilter_column(text, keep_flags))
    x = x.withColumns({out: F.col("_r.text"), "n_tokens": F.col("_r.n"), "n_content": F.col("_r.c"), "n_kept": F.col("_r.k")})
    return (x.withColumn("_flag", F.col("_r.flags")) if keep_flags else x).drop("_r")


# --------------------------------------------------------------------------- #
# G8 length profile
# --------------------------------------------------------------------------- #
def length_percentiles(df: DataFrame, by: str, size: str,
                       qs: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), exact: bool = True) -> DataFrame:
    """Count, percentiles and max of ``size`` per group. ``exact`` uses linear
    interpolation like pandas (the group's values are counted in one buffer);
    ``exact=False`` uses a mergeable sketch with bounded memory per group."""
    arr = F.array(*[F.lit(q) for q in qs])
    p = F.percentile(F.col(size), arr) if exact else F.percentile_approx(F.col(size), arr, 10000)
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), p.alias("_p"), F.max(size).alias("max"))
    return g.select(by, "n", *[F.col("_p")[i].alias(f"p{int(round(q * 100))}") for i, q in enumerate(qs)], "max")


def log_histogram(df: DataFrame, by: str, size: str, bins: int = 80) -> DataFrame:
    """Counts in ``bins`` equal-width bins of ``log10(size)`` between the global
    min and max (last bin closed). The bounds are one two-number aggregate,
    fetched first and used as literals."""
    pos = df.filter(F.col(size) > 0)
    lx = F.log10(F.col(size).cast("double"))
    lo, hi = pos.agg(F.min(lx), F.max(lx)).first()
    if lo is None:
        return pos.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn("bin", F.lit(0)).select(by, "bin", "n")
    idx = F.lit(0) if hi == lo else F.least(F.floor((lx - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1))
    return pos.groupBy(by, idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- #
# G9 / G10 chunking, G11 split
# --------------------------------------------------------------------------- #
def chunk_starts(n: Column, mode: str = "train", body_len: int = CHUNK_LEN - 2, stride: int = STRIDE,
                 min_tokens: int = MIN_CHUNK_TOKENS) -> Column:
    """Token offsets of the chunks of a document with ``n`` tokens.

    ``train`` (G9): step ``body_len - stride``, stop at the first window
    shorter than ``min_tokens`` (only tail windows can be short, so a filter
    equals the break). ``inference`` (G10): start 0, and later starts while
    more than ``stride`` tokens remain.
    """
    step = body_len - stride
    seq = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    if mode == "train":
        return F.filter(seq, lambda s: n - s >= min_tokens)
    if mode == "inference":
        return F.filter(seq, lambda s: (s == 0) | (n - s > stride))
    raise ValueError("mode must be 'train' or 'inference'")


def chunk_documents(df: DataFrame, key: str, tok: str, mode: str = "train",
                    body_len: int = CHUNK_LEN - 2, stride: int = STRIDE,
                    min_tokens: int = MIN_CHUNK_TOKENS) -> DataFrame:
    """One row per chunk ``(key, chunk_no, start, n_body, body)``.

    Works on the whole token array of each document (no head cap)."""
    starts = chunk_starts(F.size(tok), mode, body_len, stride, min_tokens)
    # cut before the rows multiply: a chunk row holds its own tokens only
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(F.col(tok), s + 1, body_len).alias("body")))
    x = df.select(key, F.posexplode(cut).alias("chunk_no", "c"))
    return x.select(key, "chunk_no", "c.start", "c.body").withColumn("n_body", F.size("body"))


def tokenizer_udf(tokenize, dtype: str = "array<int>"):
    """M3/M4: wrap a user tokenizer ``str -> list[int]`` (e.g. a subword model
    loaded once per worker) as an Arrow UDF over whole texts."""
    @F.pandas_udf(dtype)
    def _tok(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else list(tokenize(t)))
    return _tok


def hashed_ids(tok: Column, vocab_size: int = 30000, offset: int = 1000) -> Column:
    """Built-in token ids: hashed vocabulary (a user tokenizer can replace it)."""
    return F.transform(tok, lambda t: (F.pmod(F.xxhash64(t), F.lit(vocab_size - offset)) + offset).cast("int"))


def model_inputs(body_ids: Column, length: int = CHUNK_LEN, cls: int = 101, sep: int = 102,
                 pad: int = 0) -> tuple[Column, Column]:
    """CLS + body + SEP, padded to ``length`` with an attention mask."""
    ids = F.concat(F.array(F.lit(cls)), body_ids, F.array(F.lit(sep)))
    n_pad = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    full = F.concat(ids, F.array_repeat(F.lit(pad), n_pad))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), n_pad))
    return full, mask


def doc_split(key: str, seed: int = 42, train_share: float = 0.95) -> Column:
    """Deterministic, re-runnable split by document hash ("train"/"val"); the
    first 32 bits of an MD5, which other engines can state as well. A NULL key is "val"."""
    b = md5_number(key, seed) % 10000
    return F.when(b < int(round(train_share * 10000)), F.lit("train")).otherwise(F.lit("val"))
