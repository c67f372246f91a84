"""Tokenizer operators: byte-level counts in the JVM and BPE through Arrow batches.

No tokenizer is trained here; vocabularies are public files whose folder is a parameter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

from ..functions.text import words
from .hashing import canonical_hash

VOCABULARY_DIR = "/opt/tokenizers"


def _load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def encoder(path: str = f"{VOCABULARY_DIR}/byte_bpe_50k.json"):
    """Column function text -> token ids.  The vocabulary is loaded once a worker."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _load(path)
        for texts in batches:
            ids = t.encode_batch(["" if v is None else v for v in texts], add_special_tokens=False)
            yield pd.Series([None if v is None else e.ids for v, e in zip(texts, ids)], index=texts.index)

    return encode


def round_trip(path: str = f"{VOCABULARY_DIR}/byte_bpe_50k.json"):
    """Column function text -> whether decoding its ids gives the text back, but for outer blanks and NFC."""

    @F.pandas_udf(BooleanType())
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        t = _load(path)
        same = lambda a, b: unicodedata.normalize("NFC", a).strip() == unicodedata.normalize("NFC", b).strip()
        for texts in batches:
            back = [t.decode(e.ids, skip_special_tokens=False) for e in t.encode_batch(["" if v is None else v for v in texts], add_special_tokens=False)]
            yield pd.Series([None if v is None else same(v, b) for v, b in zip(texts, back)], index=texts.index)

    return check


def efficiency(df: DataFrame, by: str, text: str = "text", tokens: str | None = None) -> DataFrame:
    """Words, characters, bytes and tokens of each group and their ratios; byte tokens unless a count column is named."""
    n = F.col(tokens) if tokens else F.octet_length(text)
    sums = df.where(F.col(text).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.size(words(text))).alias("n_words"), F.sum(F.length(text)).alias("n_chars"),
        F.sum(F.octet_length(text)).alias("n_bytes"), F.sum(n).alias("n_tokens"),
    )
    ratio = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    return sums.select("*", ratio("n_tokens", "n_words").alias("tokens_per_word"), ratio("n_bytes", "n_tokens").alias("bytes_per_token"), ratio("n_chars", "n_tokens").alias("chars_per_token"))


def tokenizer_hash(path: str) -> str:
    """Hash of the canonical value of a tokenizer file, or of its bytes where it is not JSON."""
    with open(path, "rb") as f:
        raw = f.read()
    try:
        return canonical_hash(json.loads(raw))
    except ValueError:
        return hashlib.sha256(raw).hexdigest()


def guard(path: str, expected: str, status: str | None = "FROZEN") -> None:
    """Stop unless the file is the one frozen under ``expected``."""
    if status != "FROZEN":
        raise ValueError(f"{path} is not frozen")
    if (found := tokenizer_hash(path)) != expected:
        raise ValueError(f"{path} has hash {found}, not {expected}")


def freeze(path: str, version: str) -> dict[str, str]:
    """What a manifest keeps of a tokenizer from now on: version, hash and status."""
    return {"tokenizer_version": version, "tokenizer_hash": tokenizer_hash(path), "status": "FROZEN"}
