"""Text column expressions (JVM-side regex and higher-order functions).

Patterns are written so that Java regex and RE2 (DuckDB) read them the same
way; Python's whitespace set is spelled out because Java's ``\\s`` is ASCII
only while Python's is Unicode-aware.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage.functions.core import col

# The characters Python's str.isspace() / re "\s" accept.
PY_WS = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

# Envelope body, tag and HTML-like patterns of the cleaners.
TEXT_BLOCK = r"(?is)<TEXT[^>]*>(.*?)</TEXT>"
TAG = r"<[^>]+>"
HTML_LIKE = r"<\s*/?\s*[a-zA-Z]"

# Named entities decoded by the SQL-expressible "basic" mode,
# in the order applied; '&amp;' (and bare '&amp') is decoded last, in one pass.
BASIC_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"),
]


def collapse_ws(c) -> Column:
    """Runs of (Python) whitespace -> one space, then strip both ends."""
    x = F.regexp_replace(col(c), PY_WS + "+", " ")
    return F.regexp_replace(x, r"^ | $", "")


def strip_ws(c) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(col(c), "^" + PY_WS + "+|" + PY_WS + "+$", "")


def decode_basic_entities(c) -> Column:
    """SQL-expressible entity decode (the common named entities and ``&amp``)."""
    x = col(c)
    for k, v in BASIC_ENTITIES:
        x = F.replace(x, F.lit(k), F.lit(v))
    return F.regexp_replace(x, "&amp;?", "&")


def extract_bodies(c, tag: str = "TEXT") -> Column:
    """G1: every ``<TAG ...>body</TAG>`` body (case-insensitive, dot matches newline)."""
    pat = TEXT_BLOCK if tag == "TEXT" else rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"
    return F.regexp_extract_all(col(c), F.lit(pat), 1)


def tags_to_space(c) -> Column:
    return F.regexp_replace(col(c), TAG, " ")


def strip_html_basic(c) -> Column:
    """G2 with the basic entity set: tags -> space, decode, collapse, strip."""
    return collapse_ws(decode_basic_entities(tags_to_space(c)))


def clean_text_basic(c, tag: str = "TEXT") -> Column:
    """G3 (basic entities): bodies stripped and joined by newline, or the whole
    input stripped when there is no envelope."""
    bodies = extract_bodies(c, tag)
    cleaned = F.filter(F.transform(bodies, strip_html_basic), lambda s: s != "")
    return F.when(F.size(bodies) == 0, strip_html_basic(c)).otherwise(F.array_join(cleaned, "\n"))


def tokens(c) -> Column:
    """Python ``str.split()``: whitespace-separated tokens, no empty strings."""
    s = strip_ws(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, PY_WS + "+"))


def is_content_token(t: Column) -> Column:
    """2..40 characters, none of ``: = " /``, first character a letter, at
    least 60% letters (letters = Unicode ``\\p{L}``, as Python ``isalpha``)."""
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return ((n >= 2) & (n <= 40) & ~t.rlike('[:="/]') & F.substring(t, 1, 1).rlike(r"^\p{L}")
            & (F.try_divide(letters, n) >= F.lit(0.6)))


def content_flags(tok: Column) -> Column:
    return F.transform(tok, is_content_token)


def content_counts(df: DataFrame, text: str, n_tokens: str = "n_tokens", n_content: str = "n_content") -> DataFrame:
    """``df`` with the numbers of tokens and of content tokens (:func:`is_content_token`).

    The text is collapsed once and split at the single spaces left; the letters of
    all tokens come from one replacement over the text, which keeps these spaces.
    """
    x = df.withColumn("_c", collapse_ws(text)).withColumn("_l", F.regexp_replace("_c", r"[^\p{L} ]", ""))
    none = F.array().cast("array<string>")
    x = x.withColumn("_tok", F.when(F.col("_c") == "", none).otherwise(F.split("_c", " ")))
    x = x.withColumn("_let", F.when(F.col("_c") == "", none).otherwise(F.split("_l", " ")))

    def content(t: Column, letters: Column) -> Column:
        n = F.length(t)
        plain = ~(t.contains(":") | t.contains("=") | t.contains('"') | t.contains("/"))
        return ((n >= 2) & (n <= 40) & plain & (F.substring(t, 1, 1) == F.substring(letters, 1, 1))
                & (F.try_divide(F.length(letters), n) >= F.lit(0.6)))

    flags = F.zip_with("_tok", "_let", content)
    return (x.withColumn(n_tokens, F.size("_tok")).withColumn(n_content, F.size(F.filter(flags, lambda b: b)))
            .drop("_c", "_l", "_tok", "_let"))


def html_like(c) -> Column:
    return col(c).rlike(HTML_LIKE)
