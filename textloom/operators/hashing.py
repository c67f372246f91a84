"""Content and identity hashes."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import col


def content_hash(text: str | Column) -> Column:
    return F.sha2(col(text), 256)


def document_id(source: str | Column, version: str | Column, record: str | Column, text: str | Column) -> Column:
    """Hash of source, version, record and the first 16 digits of the content hash; NULL if any is NULL."""
    parts = [col(source), col(version), col(record).cast("string"), F.substring(content_hash(text), 1, 16)]
    return F.sha2(F.concat(parts[0], F.lit(":"), parts[1], F.lit(":"), parts[2], F.lit(":"), parts[3]), 256)


def canonical(value: Any) -> Any:
    """Plain JSON value with sorted keys, tuples as lists and floats rounded to eight significant digits."""
    if isinstance(value, dict):
        return {k: canonical(value[k]) for k in sorted(value)}
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    if isinstance(value, float):
        return float(f"{value:.8g}")
    return value if value is None or isinstance(value, (int, str)) else str(value)


def canonical_hash(value: Any) -> str:
    text = json.dumps(canonical(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return hashlib.sha256(text.encode()).hexdigest()


def dataset_hash(manifest: dict[str, Any]) -> str:
    """Hash of the fields of a manifest that describe its data, whatever the order of its shards."""
    fields = ("shard_name", "num_tokens", "sha256")
    return canonical_hash({
        "dataset_version": manifest.get("dataset_version", ""),
        "sequence_length": manifest.get("sequence_length", 0),
        "total_tokens": manifest.get("total_tokens", 0),
        "shards": sorted(({f: s[f] for f in fields} for s in manifest.get("shards", [])), key=lambda s: s["shard_name"]),
    })


# The identity columns, and below the values that stand for none.
IDENTITY_FIELDS = (
    "git_commit", "config_hash", "dataset_version", "dataset_hash",
    "tokenizer_version", "tokenizer_hash", "model_architecture",
)


@F.pandas_udf(StringType())
def _object_hash(keys: pd.Series, values: pd.Series) -> pd.Series:
    """Hash of the JSON object with these keys and values, row by row."""
    return pd.Series([canonical_hash(dict(zip(k, map(float, v)))) for k, v in zip(keys, values)], index=keys.index)


def grouped_hash(key: str, value: str) -> Column:
    """Aggregate: canonical hash of the object key -> number that a group makes; as many entries as the group has keys."""
    entries = F.array_sort(F.collect_set(F.struct(F.col(key).alias("k"), F.coalesce(F.col(value), F.lit(0.0)).cast("double").alias("v"))))
    return _object_hash(F.transform(entries, lambda e: e["k"]), F.transform(entries, lambda e: e["v"]))


@F.pandas_udf(StringType())
def _identity_udf(rows: pd.DataFrame) -> pd.Series:
    seeds = [None if v != v or v is None else int(v) for v in rows["random_seed"]]
    return pd.Series([canonical_hash({**r, "random_seed": s}) for r, s in zip(rows.to_dict("records"), seeds)], index=rows.index)


def identity_hash(seed: str = "random_seed") -> Column:
    """Hash over the identity columns of a row and its seed."""
    return _identity_udf(F.struct(*IDENTITY_FIELDS, F.col(seed).alias("random_seed")))


def identity_violations() -> Column:
    """Names of identity columns that are empty or hold a stand-in value."""
    checks = []
    for name in IDENTITY_FIELDS:
        bad = F.coalesce(F.col(name), F.lit("")) == ""
        if name == "git_commit":
            bad = bad | F.col(name).isin("unknown", "placeholder", "latest")
        if name.endswith("_hash"):
            bad = bad | F.col(name).contains("placeholder")
        checks.append(F.when(bad, F.lit(name)))
    checks.append(F.when(F.coalesce(F.col("random_seed"), F.lit(-1)) < 0, F.lit("random_seed")))
    return F.filter(F.array(*checks), lambda v: v.isNotNull())
