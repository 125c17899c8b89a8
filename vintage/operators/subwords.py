"""Subword ids of texts by greedy longest match over a vocabulary table.

The vocabulary is a table (token, id): pieces that begin a word, pieces that go
on (with the prefix ``##``), and the four special tokens. A word is cut from the
left, each time at the longest piece that a trie of the vocabulary holds; a word
that can't be cut, or is longer than ``max_word``, is one unknown token. Texts
are lower-cased; words are runs of letters and digits, and every other
character that isn't white space is a word.

The table goes to the workers as one bounded list (``max_size`` is checked), and
each text is one row, so nothing shuffles. NULL texts have no ids (NULL), empty
ones an empty list.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The special tokens of the vocabulary, and the mark of a piece that goes on.
PAD, UNKNOWN, BEGIN, END = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
GOES_ON = "##"

_WORDS = re.compile(r"[^\W_]+|[^\w\s]|_")


class Trie:
    """Pieces by their characters; the longest one at the front of a string."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, piece: str, value: int) -> None:
        node = self.root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = value  # no character is empty: the place of the value

    def longest(self, text: str, at: int) -> tuple[int, int] | None:
        """(end, value) of the longest piece of ``text`` from ``at`` on."""
        node, found = self.root, None
        for end in range(at, len(text)):
            node = node.get(text[end])
            if node is None:
                break
            if "" in node:
                found = end + 1, node[""]
        return found


class Subwords:
    """A vocabulary, and the ids of words and texts."""

    def __init__(self, vocabulary: dict[str, int], max_word: int = 100, remember: int = 200_000):
        self.first, self.later, self.ids = Trie(), Trie(), vocabulary
        for token, i in vocabulary.items():
            if token in (PAD, UNKNOWN, BEGIN, END):
                continue
            if token.startswith(GOES_ON) and len(token) > len(GOES_ON):
                self.later.add(token[len(GOES_ON):], i)
            else:
                self.first.add(token, i)
        self.unknown, self.max_word = vocabulary[UNKNOWN], max_word
        self.known: dict[str, list[int]] = {}
        self.remember = remember

    def word(self, w: str) -> list[int]:
        """Ids of one word."""
        out, at = [], 0
        while at < len(w) <= self.max_word:
            found = (self.later if at else self.first).longest(w, at)
            if found is None:
                return [self.unknown]
            at, i = found
            out.append(i)
        return out or [self.unknown]

    def text(self, text: str) -> list[int]:
        """Ids of a text."""
        out: list[int] = []
        for w in _WORDS.findall(text):
            ids = self.known.get(w)
            if ids is None:
                if len(self.known) >= self.remember:
                    self.known.clear()
                ids = self.known[w] = self.word(w)
            out += ids
        return out


def read_vocabulary(table: DataFrame, token: str = "token", id_col: str = "id", max_size: int = 200_000) -> dict[str, int]:
    """The vocabulary of a table of at most ``max_size`` rows; it must hold the special tokens, and each token once."""
    rows = table.select(token, id_col).limit(max_size + 1).collect()
    if len(rows) > max_size:
        raise ValueError(f"the vocabulary has more than {max_size} rows")
    out = {r[0]: int(r[1]) for r in rows}
    if len(out) != len(rows) or not {PAD, UNKNOWN, BEGIN, END} <= out.keys():
        raise ValueError("tokens must be distinct and include the special ones")
    return out


def subword_ids(text: Column, vocabulary: dict[str, int], max_word: int = 100) -> Column:
    """Ids of each text, without special tokens."""
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = Subwords(vocabulary, max_word)
        for a in batches:
            yield pa.array([None if (x := v.as_py()) is None else s.text(x) for v in a], pa.list_(pa.int32()))
    return run(F.lower(text))
