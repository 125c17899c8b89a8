"""Identifier normalisation and extraction (C1-C5) as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vintage.functions.core import col

# Accession number forms (dashed 10-2-6, or an 18-digit run).
ACCESSION_DASHED = r"(\d{10}-\d{2}-\d{6})"
ACCESSION_DIGITS = r"(\d{18})"


def normalize_ticker(c) -> Column:
    """Upper-case, ``.`` -> ``-``, literal ``NAN`` (and an empty cell) -> NULL."""
    t = F.regexp_replace(F.upper(F.trim(col(c))), r"\.", "-")
    return F.when((t == "NAN") | (t == ""), F.lit(None).cast("string")).otherwise(t)


def normalize_cik(c) -> Column:
    """10-digit zero-padded cik from a string, float or integer.

    Goes through double then bigint so ``320193.0`` and ``'0000320193'`` agree;
    unparseable -> NULL (``try_cast``; ANSI casts would throw). Longer values are
    kept whole (``lpad`` would truncate them).
    """
    n = F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double")
    s = n.cast("bigint").cast("string")
    return F.when(F.length(s) >= 10, s).otherwise(F.lpad(s, 10, "0"))


def accession_from_path(c) -> Column:
    """Dashed accession first; else the first 18-digit run re-dashed 10-2-6;
    else NULL (callers drop such rows)."""
    dashed = F.nullif(F.regexp_extract(col(c), ACCESSION_DASHED, 1), F.lit(""))
    digits = F.nullif(F.regexp_extract(col(c), ACCESSION_DIGITS, 1), F.lit(""))
    redashed = F.concat_ws("-", F.substring(digits, 1, 10), F.substring(digits, 11, 2), F.substring(digits, 13, 6))
    return F.coalesce(dashed, F.when(digits.isNotNull(), redashed))


def number_from_url(c, key: str = "CIK") -> Column:
    """C4: ``KEY=(digits)`` from a URL as bigint, NULL when absent."""
    return F.regexp_extract(col(c), rf"{key}=(\d+)", 1).try_cast("bigint")


def text_path(root: str, cik: Column, accession: Column, ext: str = ".txt") -> Column:
    """``root/cik/accession.ext`` path builder."""
    return F.concat(F.lit(root.rstrip("/") + "/"), cik, F.lit("/"), accession, F.lit(ext))


def suffix(c) -> Column:
    """File extension of a path (lower-case, with the dot), '' when none."""
    return F.lower(F.regexp_extract(col(c), r"(\.[A-Za-z0-9]+)$", 1))
