"""Scalar text expressions shared by the operators.  All but NFC stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space plus the four information separators, i.e. what ``str.split()`` splits on.
BLANK = r"(?U)[\s\x1c-\x1f]+"
EDGE_BLANK = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: str | Column) -> Column:
    """White-space separated words, none empty; NULL stays NULL."""
    return F.filter(F.split(col(text), BLANK), lambda w: w != "")


def py_strip(text: str | Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.regexp_replace(col(text), EDGE_BLANK, "")


@F.pandas_udf(StringType())
def _nfc_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc(text: str | Column) -> Column:
    """Unicode NFC.  Spark has no builtin; pure ASCII text is its own normal form and never needs it."""
    c = col(text)
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfc_udf(c)).otherwise(c)


def shingles(text: str | Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` words; texts with fewer words give their distinct words."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        at = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))
        joined = F.transform(at, lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        return F.array_distinct(F.when(n >= size, joined).otherwise(w))

    return let(words(text), runs)


def canonical_name(value: str | Column) -> Column:
    """One spelling for identifiers that differ in case, padding or separator."""
    return F.regexp_replace(F.lower(F.regexp_replace(col(value), r"(?U)[\s\p{Cf}]+", "")), "[-. ]", "_")


def hashed_unit(*parts: str | Column) -> Column:
    """Uniform number in [0, 1) from the first 8 hex digits of md5 of the joined parts."""
    joined = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
