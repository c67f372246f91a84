"""Source registry: lookup joins, upserts and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_name


def with_registry_key(rows: DataFrame, source: str = "source_id") -> DataFrame:
    return rows.withColumn("source_key", canonical_name(source))


def registered(rows: DataFrame, registry: DataFrame, source: str = "source_id") -> DataFrame:
    """Rows whose source is in the registry, whatever its spelling."""
    keys = registry.select(canonical_name("source_id").alias("source_key")).distinct()
    return with_registry_key(rows, source).join(keys, "source_key", "left_semi")


def unregistered(rows: DataFrame, registry: DataFrame, source: str = "source_id") -> DataFrame:
    keys = registry.select(canonical_name("source_id").alias("source_key")).distinct()
    return with_registry_key(rows, source).join(keys, "source_key", "left_anti")


def permitted(rows: DataFrame, registry: DataFrame, source: str = "source_id") -> DataFrame:
    """Rows whose source the registry allows for training."""
    return registered(rows, registry.where(F.coalesce("allowed_for_training", F.lit(False))), source)


def require_permitted(rows: DataFrame, registry: DataFrame, source: str = "source_id") -> DataFrame:
    """``rows``, or an error that names a source that is not allowed for training."""
    allowed = registry.where(F.coalesce("allowed_for_training", F.lit(False)))
    if bad := unregistered(rows, allowed, source).select(source).first():
        raise ValueError(f"source {bad[0]} is not allowed for training")
    return rows


def upsert(current: DataFrame, changes: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows of ``changes`` replace rows of ``current`` with the same key."""
    return current.join(changes.select(key), key, "left_anti").select(changes.columns).unionByName(changes)


def save_json(registry: DataFrame, path: str) -> None:
    registry.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def raw_artifact(rows: DataFrame, path: str) -> str:
    """Write JSON lines and give a content hash that does not depend on row order or file layout."""
    rows.write.mode("overwrite").json(path)
    line = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)]).cast("decimal(38,0)")
    total, n = rows.agg(F.coalesce(F.sum(line), F.lit(0)), F.count(F.lit(1))).first()
    return f"{n}:{total}"
