"""Cleaning and Unicode normalisation.  Each rewrite has a ``*_stats`` twin so unused counts are pruned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col, nfc, py_strip

# Patterns that decide the result.
TAG = r"<[^>]+>"
ZERO_WIDTH = "[\u200b\u200c\u200d\ufeff]"
BLANK_RUN = r"\n{4,}"
COMBINING = "[\u0300-\u036f]"


def unstripped(text: str | Column) -> Column:
    """Zero-width characters deleted, tags turned into a space, long blank runs cut to three."""
    c = F.regexp_replace(col(text), ZERO_WIDTH, "")
    return F.regexp_replace(F.regexp_replace(c, TAG, " "), BLANK_RUN, "\n\n\n")


def clean(text: str | Column) -> Column:
    return py_strip(unstripped(text))


def clean_stats(text: str | Column) -> Column:
    """Lengths in code points; the cleaned length is taken before the final strip."""
    before, after = F.length(col(text)), F.length(unstripped(text))
    return F.struct(
        before.cast("bigint").alias("original_len"),
        after.cast("bigint").alias("cleaned_len"),
        (before - after).cast("bigint").alias("removed_chars"),
    )


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def normalize(text: str | Column) -> Column:
    """NFC without NUL characters."""
    return F.replace(nfc(text), F.lit("\x00"), F.lit(""))


def normalize_stats(text: str | Column, normal: Column | None = None) -> Column:
    c = col(text)
    n = nfc(c) if normal is None else normal
    return F.struct(
        F.length(c).cast("bigint").alias("original_len"),
        F.length(n).cast("bigint").alias("normalized_len"),
        (~c.eqNullSafe(n)).alias("changed"),
        occurrences(n, "\ufffd").cast("bigint").alias("replacement_chars"),
        occurrences(n, "\x00").cast("bigint").alias("nul_chars"),
    )


def diacritics_composed(text: str | Column) -> Column:
    """True when no combining mark is left after NFC."""
    return ~nfc(text).rlike(COMBINING)
