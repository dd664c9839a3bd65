"""Text cleaning as native Column expressions (Column -> Column)."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill import constants as K

ASCII_SPACES = r"[\t-\r\x1c-\x20]+"


@functools.cache
def _accent_table() -> tuple[str, str]:
    """Characters whose canonical decomposition keeps exactly one ASCII letter."""
    source, target = [], []
    for code in range(0x80, min(0xFFFF, sys.maxunicode) + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        kept = unicodedata.normalize("NFD", chr(code)).encode("ascii", "ignore").decode()
        if kept:
            source.append(chr(code))
            target.append(kept)
    return "".join(source), "".join(target)


def sql_literal(value: str) -> str:
    """A string as Spark SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of every Unicode kind."""
    return F.btrim(c, F.lit(K.WHITESPACE))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def exploded(df: DataFrame, keep: Sequence[str], items: Column | str, out: str) -> DataFrame:
    """One row per array element.

    A plain explode makes the optimizer filter on the size of the array first, which computes a
    costly array twice; the outer form does not, and its rows for empty arrays are dropped here.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias("_at", out))
    return rows.filter(F.col("_at").isNotNull()).drop("_at")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_accents(c: Column) -> Column:
    """Drop accents, then every character that is still not ASCII."""
    source, target = _accent_table()
    return F.regexp_replace(F.translate(c, source, target), r"[^\x00-\x7F]", "")


def clean_hard(c: Column) -> Column:
    """Lower case without accents, ". -" deleted, "y"/"mas" as " + ", "/ ( ) +" set apart."""
    c = F.lower(strip_accents(c))
    for old, new in ((".", ""), ("-", ""), (",", " "), (" mas ", " + "), (" y ", " + ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, r"[/()+]", " $0 ")
    return F.trim(F.regexp_replace(c, ASCII_SPACES, " "))


def spanish_stopwords() -> list[str]:
    """Spark ML's default Spanish list, a fixed value kept as a data file (a test compares them)."""
    return resources.files("casemill.data").joinpath("stopwords_es.txt").read_text("utf-8").split()


def clean_model(c: Column, stopwords: Sequence[str] | None = None) -> Column:
    """`clean_hard`, punctuation to spaces, Spanish stopwords removed.

    The cleaned text has no accents, so stopwords with accents never match; that is kept.
    """
    words = spanish_stopwords() if stopwords is None else stopwords
    reachable = sorted({w for w in words if w.isascii()})
    punctuation = "[" + "".join("\\" + ch for ch in K.MODEL_SPACE_CHARS) + "]"
    c = F.regexp_replace(clean_hard(c), punctuation, " ")
    # isin over a long literal list becomes a hash-set lookup
    kept = F.filter(F.split(c, " "), lambda w: (w != "") & ~w.isin(reachable))
    return F.array_join(kept, " ")


def tokens(c: Column) -> Column:
    """Words between whitespace, no empty strings."""
    return F.array_remove(F.split(strip(c), K.SPACE + "+"), "")


def clean_tokens(c: Column) -> Column:
    """Words of a text that `clean_hard` or `clean_model` produced (single blanks only)."""
    return F.array_remove(F.split(c, " "), "")


def word_ngrams(words: Column, sizes: int | Iterable[int]) -> Column:
    """All word n-grams, size after size, each in text order."""
    sizes = [sizes] if isinstance(sizes, int) else list(sizes)
    if any(m <= 0 for m in sizes):
        raise ValueError(f"n-gram sizes must be positive: {sizes}")
    return F.flatten(F.array(*[_ngrams_of(words, m) for m in sizes]))


def _ngrams_of(words: Column, m: int) -> Column:
    if m == 1:
        return words
    starts = F.sequence(F.lit(1), F.size(words) - (m - 1))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(words, i, m), " "))
    return F.when(F.size(words) >= m, grams).otherwise(F.array().cast("array<string>"))


def join_sections(columns: Sequence[str]) -> Column:
    """`\\n<column>: <text>` of every non-null column, joined by one blank."""
    parts = [F.concat(F.lit(f"\n{name}: "), F.col(f"`{name}`")) for name in columns]
    return F.concat_ws(" ", *parts)


def strip_markers(c: Column) -> Column:
    """Remove entry markers and all numbers."""
    c = F.regexp_replace(c, "(?i)" + K.ENTRY_MARKER, "")
    return F.regexp_replace(c, "(?U)" + K.NUMBER_TO_STRIP, "")


def display_clean(c: Column) -> Column:
    """Remove entry markers and newlines (no blank inserted), strip."""
    c = F.regexp_replace(c, K.DISPLAY_MARKER, "")
    return strip(F.replace(c, F.lit("\n"), F.lit("")))


def model_input(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("\n"), F.lit(" "))
