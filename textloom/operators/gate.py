"""Whether a dataset is ready for use: relations that name every reason against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import damaged

LEAST_SOURCES = 6  # fixed value


def dataset_reasons(manifest: DataFrame, found: DataFrame, registry: DataFrame, tokenizer: DataFrame, least_sources: int = LEAST_SOURCES) -> DataFrame:
    """(reason) rows, none if the dataset is ready.

    ``manifest(shard_name, sha256)`` lists the shards, ``found(shard_name, sha256)`` the files there are,
    ``registry(source_id, license)`` the sources and ``tokenizer(status, tokenizer_hash, expected_hash)`` has
    one row or none.  Every input may be empty; repeated rows fold.
    """
    def when_few(df: DataFrame, least: int, reason: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least).select(F.lit(reason).alias("reason"))

    reasons = when_few(manifest, 1, "ZERO_SHARDS_IN_MANIFEST").unionByName(damaged(manifest, found.dropDuplicates(["shard_name"])).select("reason"))
    reasons = reasons.unionByName(when_few(registry.select("source_id").distinct(), least_sources, "INSUFFICIENT_APPROVED_SOURCES"))
    unresolved = registry.where(F.coalesce("license", F.lit("")).isin("", "UNKNOWN"))
    reasons = reasons.unionByName(unresolved.select(F.concat(F.lit("UNRESOLVED_LICENSE_"), "source_id").alias("reason")))
    reasons = reasons.unionByName(when_few(tokenizer, 1, "MISSING_TOKENIZER_FILE"))
    wrong = F.when(F.col("status").isNull(), "MISSING_TOKENIZER_METADATA").when(F.col("status") != "FROZEN", "TOKENIZER_NOT_FROZEN")
    differs = F.when(~F.col("tokenizer_hash").eqNullSafe(F.col("expected_hash")), "TOKENIZER_HASH_MISMATCH")
    bad = tokenizer.select(F.explode(F.filter(F.array(wrong, differs), lambda r: r.isNotNull())).alias("reason"))
    return reasons.unionByName(bad).distinct()


def dataset_status(reasons: DataFrame) -> DataFrame:
    """One row: status READY or DATASET_NOT_READY and the number of reasons."""
    return reasons.agg(F.count(F.lit(1)).alias("n_reasons")).select(F.when(F.col("n_reasons") == 0, "READY").otherwise("DATASET_NOT_READY").alias("status"), "n_reasons")
