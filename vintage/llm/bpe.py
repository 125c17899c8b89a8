"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

The lookahead follows from the merge list alone. Compare the tokens of a piece
with those of the same piece continued. Going through the merges by rank, the
two agree up to some boundary, at first the end of the shorter one. A merge
(u, v) moves the boundary back over u only if v is the first token after it in
one of the two and u the last one before it; afterwards u or uv comes first
after the boundary, perhaps grown by later merges to its right. So with
``reach[t]`` as the furthest the boundary can lie before the end when t follows
it, one pass over the merges in rank order gives

    moved          = len(u) + reach[v]
    reach[u], [uv] = max(itself, moved)     (uv also at least reach[u])

and the largest value is a lookahead that suffices: a token that ends further
than that before the end of what was read never changes. The pass needs a merge
list where a token is used only after every merge that makes it; for a list
that isn't, pieces are read whole.

Every piece is fed to the window symbol by symbol; once the window is full, stable
tokens are emitted and their symbols forgotten, so memory doesn't grow with the
piece (a piece no longer than the lookahead is settled by its end). The last
symbol is held back, since it carries the end-of-word mark. Texts are read in
blocks between white space, and ids, digests and decoded text leave block by
block, so besides the text itself only a block is held.

Decoding is a state machine over ids. Where the tokenizer file names no decoder,
tokens are joined by a space (the state is whether one was emitted); a
byte-level decoder keeps the bytes of an unfinished character.

The ids of words that come again are remembered per Python process, in two
generations of a fixed number.

Defined cases: NULL counts as empty; an empty text has no token and decodes to
the empty text; special tokens inside a text are recognised, as the tokenizer
file says. Repeated rows stay repeated, ids may be NULL, an empty table gives an
empty result, other columns pass through :func:`encode_column`.
"""
from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int | None:
    """Symbols after a token that settle it; None if the list uses a token before it is complete."""
    last_made: dict[str, int] = {}
    for rank, (u, v) in enumerate(merges):
        last_made[u + v] = rank
    reach: dict[str, int] = {}
    for rank, (u, v) in enumerate(merges):
        if last_made.get(u, -1) > rank or last_made.get(v, -1) > rank:
            return None
        moved = length[u] + reach.get(v, 0)
        reach[u + v] = max(reach.get(u + v, 0), reach.get(u, 0), moved)
        reach[u] = max(reach.get(u, 0), moved)
    return max(reach.values(), default=0)


_CONTROLS = regex.compile(r"[\x1c-\x1f]")
_BREAK = regex.compile(r"[ \n]")


_NONE = 1 << 62
#: Slots that note which words came once.
_SEEN = 1 << 22


class Merger:
    """Applies a merge list to the symbols of one piece, lowest rank first, leftmost first.

    Works on token ids; ``pair`` maps two neighbours to rank and result in one integer.
    """

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], end_mark: str, short: int = 48):
        self.vocab, self.end_mark, self.short = vocab, end_mark, short
        self.name = {i: t for t, i in vocab.items()}
        self.pair = {vocab[u] << 20 | vocab[v]: rank << 20 | vocab[u + v] for rank, (u, v) in reversed(list(enumerate(merges)))}

        def symbols(t: str) -> int:
            return len(t) - len(end_mark) if end_mark and t.endswith(end_mark) and len(t) > len(end_mark) else len(t)

        self.length = [0] * (max(vocab.values(), default=0) + 1)
        for t, i in vocab.items():
            self.length[i] = symbols(t)
        self.lookahead = lookahead(merges, {t: symbols(t) for t in vocab})

    def merge(self, ids: list[int]) -> list[int]:
        """The tokens of some symbols; ``ids`` is used up."""
        if len(ids) > self.short:
            return self._merge_long(ids)
        get = self.pair.get
        found = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while found:
            low = min(found)
            if low == _NONE:
                break
            at = found.index(low)
            ids[at] = new = low & 0xFFFFF
            del ids[at + 1], found[at]
            if at:
                found[at - 1] = get(ids[at - 1] << 20 | new, _NONE)
            if at < len(found):
                found[at] = get(new << 20 | ids[at + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.pair.get
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), list(ids)
        heap = [(m >> 20, i, a, b, m) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if live[i] != a or j >= n or live[j] != b:
                continue
            live[i], live[j] = m & 0xFFFFF, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (m := get(live[i] << 20 | live[k])) is not None:
                    heapq.heappush(heap, (m >> 20, i, live[i], live[k], m))
            h = prv[i]
            if h >= 0 and (m := get(live[h] << 20 | live[i])) is not None:
                heapq.heappush(heap, (m >> 20, h, live[h], live[i], m))
        return [t for t in live if t >= 0]

    def stream(self, symbols: Iterable[int], step: int = 48) -> Iterator[int]:
        """The tokens of one piece, each as soon as it is stable; the last symbol carries the end mark.

        The window takes ``step`` symbols at a time; it never holds more than
        these, the lookahead and one unfinished token.
        """
        if self.lookahead is None:
            yield from self.merge(list(symbols))
            return
        window: list[int] = []
        due = self.lookahead + step
        for s in symbols:
            if len(window) > due:  # the newest symbol is held back, since it may be the last
                settled = len(window) - 1 - self.lookahead
                done = 0
                for t in self.merge(window[:-1]):
                    if done + self.length[t] > settled:
                        break
                    done += self.length[t]
                    yield t
                del window[:done]
                due = max(self.lookahead, len(window)) + step
            window.append(s)
        yield from self.merge(window)


class Decoder:
    """Ids to text as they come; between calls only an unfinished character is kept."""

    def __init__(self, tokens: dict[int, str], byte_level: bool):
        self.byte_level = byte_level
        byte_of = {c: b for b, c in byte_alphabet().items()}
        self.tokens = tokens
        self.bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
                      for i, t in tokens.items()} if byte_level else {}
        self.pending = codecs.getincrementaldecoder("utf-8")("replace")
        self.reset()

    def reset(self) -> None:
        self.begun = False
        self.pending.reset()

    def feed(self, ids: list[int]) -> str:
        """The text that these ids settle; ids outside the vocabulary give none."""
        if self.byte_level:
            return self.pending.decode(b"".join([self.bytes.get(i, b"") for i in ids]))
        get = self.tokens.get
        out = " ".join([t for t in map(get, ids) if t is not None])
        if self.begun and out:
            out = " " + out
        self.begun = self.begun or bool(out)
        return out

    def finish(self) -> str:
        """What an unfinished character at the end gives."""
        return self.pending.decode(b"", True) if self.byte_level else ""


class Codec:
    """One tokenizer file: normalisation, pieces, merges and the way back.

    Covers byte-level BPE files whose normaliser is made of NFC, white-space
    replacement and lower case and whose pieces come from one pattern.
    """

    def __init__(self, path: str, remember: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("only plain BPE files are covered")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.end_mark = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.merger = Merger(merges, self.vocab, self.end_mark)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with stripping or word rules are not covered")
        parts = spec.get("normalizer") or {}
        kinds = [p["type"] for p in parts.get("normalizers", [parts] if parts else [])]
        if set(kinds) - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normaliser not covered: {kinds}")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pre = spec["pre_tokenizer"]
        split = [p for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split"]
        if len(split) != 1 or not (split[0]["behavior"] == "Removed" and split[0]["invert"]):
            raise ValueError("pre-tokenizer not covered")
        # Unicode data of the installed tokenizers library, for characters that Python's tables don't know yet
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(split[0]["pattern"]["Regex"])
        if any(_BREAK.search(t) for t in self.special):
            raise ValueError("special tokens with white space are not covered")
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        letters = byte_alphabet()
        self.byte_id = [self.vocab[letters[b]] for b in range(256)]
        self.last_id = [self.vocab[letters[b] + self.end_mark] for b in range(256)]
        self.letter_byte = {c: b for b, c in letters.items()}
        tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.decoder = Decoder(tokens, self.byte_level)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known: dict[str, bool] = {}  # characters, and whether Python's Unicode tables have them
        self.remember = remember
        self.seen, self.fresh = bytearray(_SEEN), 0

    def _word(self, word: str) -> bytes:
        """The ids of one normalised word; recent words and pieces are remembered in two generations."""
        ids = self.older.get(word)
        if ids is None:
            pieces = [word] if word.isalpha() else self.pattern.findall(word)
            if len(pieces) == 1 and pieces[0] == word:
                ids = self._merged(word.encode())
            else:
                get, of = self.pieces.get, self._word
                ids = b"".join([get(p) or of(p) for p in pieces])
        if len(word) <= 64:
            at = hash(word) & (_SEEN - 1)
            if not self.seen[at]:  # most new words never come back: remembered from the second time on
                self.seen[at] = 1
                self.fresh += 1
                if self.fresh > _SEEN // 2:
                    self.seen, self.fresh = bytearray(_SEEN), 0
                return ids
            if len(self.pieces) >= self.remember:
                self.older, self.pieces = self.pieces, {}
            self.pieces[word] = ids
        return ids

    def _merged(self, piece: bytes) -> bytes:
        """The ids of one piece, merged."""
        table = self.byte_id
        ids = [table[b] for b in piece]
        ids[-1] = self.last_id[piece[-1]]
        ids = list(self.merger.stream(ids))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _assigned(self, text: str) -> bool:
        for c in set(text):
            ok = self.known.get(c)
            if ok is None:
                ok = self.known[c] = unicodedata.category(c) != "Cn"
            if not ok:
                return False
        return True

    def _plain(self, text: str) -> list[bytes]:
        """Ids of the pieces of a text without special tokens."""
        if not text.isascii():
            if not self._assigned(text):
                text = self.library.normalizer.normalize_str(text)
                back = self.letter_byte
                return [self._merged(bytes([back[c] for c in mapped]))
                        for mapped, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
            if self.nfc:
                text = unicodedata.normalize("NFC", text)
            if self.lower:  # character by character: no final sigma
                text = text.replace("Σ", "σ")
        if self.lower:
            text = text.lower()
        # white space ends a piece; four control characters end a word for Python only
        words = [text] if _CONTROLS.search(text) else text.split()
        get, out = self.pieces.get, []
        for w in words:
            ids = get(w)
            if ids is None:
                ids = self._word(w)
                get = self.pieces.get
            out.append(ids)
        return out

    def blocks(self, text: str, size: int = 1 << 16) -> Iterator[str]:
        """A text in blocks that end at a space or line feed, which end every piece and special token."""
        at = 0
        while len(text) - at > size and (m := _BREAK.search(text, at + size)):
            yield text[at:m.end()]
            at = m.end()
        yield text[at:] if at else text

    def encode_blocks(self, text: str) -> Iterator[np.ndarray]:
        """The ids of one text, block by block."""
        for block in self.blocks(text):
            out, at = [], 0
            for m in self.cut.finditer(block) if self.cut else ():
                out += self._plain(block[at:m.start()])
                out.append(struct.pack("<I", self.special[m.group()]))
                at = m.end()
            out += self._plain(block[at:] if at else block)
            yield np.frombuffer(b"".join(out), "<u4")

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        parts = list(self.encode_blocks(text))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode_blocks(self, blocks: Iterable[np.ndarray]) -> Iterator[str]:
        """The text of some ids, by the state machine, as far as each block settles it."""
        self.decoder.reset()
        for ids in blocks:
            yield self.decoder.feed(ids.tolist())
        yield self.decoder.finish()

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids."""
        return "".join(self.decode_blocks(ids[at:at + 65_536] for at in range(0, len(ids), 65_536)))

    def run(self, text: str, want: set[str]) -> dict:
        """The ``want``-ed fields of :data:`RESULT`; without ids and decoded no more than a block is held."""
        out: dict = {"n_tokens": 0}
        ids_sha, text_sha, ids, texts = hashlib.sha256(), hashlib.sha256(), [], []

        def counted() -> Iterator[np.ndarray]:
            for block in self.encode_blocks(text):
                out["n_tokens"] += len(block)
                ids_sha.update(block.tobytes())
                if "ids" in want:
                    ids.append(block)
                yield block
        if {"decoded", "decoded_sha256"} & want:
            for part in self.decode_blocks(counted()):
                text_sha.update(part.encode())
                if "decoded" in want:
                    texts.append(part)
        else:
            for _ in counted():
                pass
        return out | {"ids_sha256": ids_sha.hexdigest(), "decoded_sha256": text_sha.hexdigest(), "ids": ids, "decoded": "".join(texts)}


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The codec of one file, read once per Python process."""
    return Codec(path)


def _texts(t: pa.Array) -> Iterator[str | None]:
    """Texts one at a time, so that a batch is not held twice."""
    return (x.as_py() for x in t)


RESULT = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                     StructField("decoded_sha256", StringType()), StructField("ids", ArrayType(IntegerType())),
                     StructField("decoded", StringType())])


def encode_column(text: Column, path: str, fields: tuple[str, ...] = ("n_tokens", "ids")) -> Column:
    """A struct per text with the asked ``fields`` of :data:`RESULT`.

    ``path``: the tokenizer file's place, the same on every machine.
    """
    want = StructType([f for f in RESULT.fields if f.name in fields])

    @F.arrow_udf(want)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path)
        for t in texts:
            got = [c.run(x or "", set(fields)) for x in _texts(t)]
            cols = {n: pa.array([g[n] for g in got], pa.int64() if n == "n_tokens" else pa.string())
                    for n in ("n_tokens", "ids_sha256", "decoded_sha256") if n in fields}
            if "ids" in fields:
                blocks = [b for g in got for b in g["ids"]]
                ends = np.cumsum([0, *(sum(map(len, g["ids"])) for g in got)]).astype(np.int32)
                cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*blocks, ends[:0]]).astype(np.int32)))
            if "decoded" in fields:
                cols["decoded"] = pa.array([g["decoded"] for g in got], pa.large_string()).cast(pa.string())
            yield pa.StructArray.from_arrays([cols[f.name] for f in want.fields], names=want.names)
    return run(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of each array of ids (NULL: empty), by the state machine."""
    @F.arrow_udf(StringType())
    def run(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        d = codec(path).decoder
        for t in rows:
            out = []
            for x in t:
                d.reset()
                out.append(d.feed(x.as_py() or []) + d.finish())
            yield pa.array(out, pa.string())
    return run(ids)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    r = encode_column(F.col(text_col), path, ("n_tokens", "ids_sha256", "decoded_sha256"))
    return docs.select(F.col(id_col), r.alias("__r")).select(
        id_col, "__r.n_tokens", "__r.ids_sha256", "__r.decoded_sha256")
