"""The text keys (P01 to P08). They are not interchangeable: each join states its own.

Marks are dropped with a ``translate`` table that is built by rule: every letter
below U+2100 whose canonical decomposition is one base and marks of U+0300 to
U+036F. Only `script_key` needs full decomposition, in an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@lru_cache(maxsize=1)
def _marks_table() -> tuple[str, str]:
    src, dst = [], []
    for cp in range(0xC0, 0x2100):
        whole = unicodedata.normalize("NFD", chr(cp))
        base = "".join(c for c in whole if not 0x300 <= ord(c) <= 0x36F)
        if len(whole) > 1 and len(base) == 1:
            src.append(chr(cp))
            dst.append(base)
    marks = "".join(map(chr, range(0x300, 0x370)))  # beyond the end of the second string: deleted
    return "".join(src) + marks, "".join(dst)


def unaccent(c: Column) -> Column:
    """Letters without their marks."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, *_marks_table()))


def search_key(c: Column) -> Column:
    """Lower case without marks; punctuation stays."""
    return unaccent(F.lower(c))


def fresh_key(c: Column) -> Column:
    """`search_key` with every run of other than a-z and 0-9 one space. Ligatures split words."""
    return F.trim(F.regexp_replace(search_key(c), "[^a-z0-9]+", " "))


def match_key(c: Column) -> Column:
    """As `fresh_key`, but œ and æ are spelt out first."""
    spelt = F.replace(F.replace(F.lower(unaccent(c)), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.trim(F.regexp_replace(spelt, "[^a-z0-9]+", " "))


def compact_key(c: Column) -> Column:
    """`match_key` without spaces."""
    return F.replace(match_key(c), F.lit(" "), F.lit(""))


def exact_key(c: Column) -> Column:
    """White space collapsed, lower case; accents and punctuation stay."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


@F.pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    strip = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c)[0] != "M")
    return s.map(strip, na_action="ignore")


def script_key(c: Column) -> Column:
    """For every script: marks dropped, lower case, other than letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(_decomposed(c)), r"[^\p{L}\p{N}]+", " "))


def library_key(c: Column) -> Column:
    """`fresh_key` with mr, mrs and dr written out as words."""
    out = fresh_key(c)
    for short, word in (("mr", "mister"), ("mrs", "missus"), ("dr", "doctor")):
        out = F.regexp_replace(out, rf"\b{short}\b", word)
    return out


def slug(c: Column) -> Column:
    """`match_key` with hyphens."""
    return F.replace(match_key(c), F.lit(" "), F.lit("-"))


def work_id(title: Column, year: Column) -> Column:
    """The id of a new work: slug and year, the slug alone without a year."""
    return F.concat_ws("-", slug(title), year.cast("string"))
