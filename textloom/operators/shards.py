"""Shards of packed rows: parquet or raw uint32 files, checksums and manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_SHARD = 12500


def shard_totals(packed: DataFrame, length: int, per_shard: int = PER_SHARD) -> DataFrame:
    """Sequences and tokens of every shard; padding counts as tokens."""
    return packed.groupBy(F.floor(F.col("seq_idx") / per_shard).cast("bigint").alias("shard_idx")).agg(
        F.count(F.lit(1)).alias("num_samples"), (F.count(F.lit(1)) * length).alias("num_tokens")
    ).withColumn("shard_name", F.format_string("shard-%06d", "shard_idx"))


def manifest(totals: DataFrame, length: int, version: str) -> DataFrame:
    """One row with the JSON manifest; shards are in name order.  One element per shard."""
    shard = F.struct("shard_name", "num_samples", "num_tokens")
    return totals.agg(
        F.count(F.lit(1)).alias("num_shards"), F.sum("num_tokens").alias("total_tokens"), F.array_sort(F.collect_list(shard)).alias("shards")
    ).select(
        "num_shards", "total_tokens",
        F.to_json(F.struct(F.lit(version).alias("dataset_version"), F.lit(length).alias("sequence_length"), "num_shards", "total_tokens", F.lit("uint32").alias("dtype"), "shards")).alias("manifest"),
    )


def manifest_rows(totals: DataFrame, length: int, version: str) -> DataFrame:
    """The manifest as one row a shard, for any number of shards."""
    return totals.select(F.lit(version).alias("dataset_version"), F.lit(length).alias("sequence_length"), "shard_name", "num_samples", "num_tokens")


def located(seqs: DataFrame, per_shard: int = PER_SHARD, index: str = "seq_idx") -> DataFrame:
    """Shard and place in it of sequence numbers."""
    i = F.col(index)
    return seqs.select(index, F.format_string("shard-%06d", F.floor(i / per_shard)).alias("shard_name"), F.pmod(i, F.lit(per_shard)).alias("place"))


def write_blocks(packed: DataFrame, folder: str, per_shard: int = PER_SHARD) -> None:
    """Write packed rows through Spark to any file system, a folder a shard, rows in sequence order."""
    rows = packed.withColumn("shard", F.format_string("shard-%06d", F.floor(F.col("seq_idx") / per_shard)))
    rows.repartition("shard").sortWithinPartitions("shard", "seq_idx").write.mode("overwrite").partitionBy("shard").parquet(folder)


def read_blocks(spark, folder: str, shard: str | None = None) -> DataFrame:
    """Packed rows of all shards or of one; other shards' folders are not read."""
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(folder)
    return rows.where(F.col("shard") == shard) if shard else rows


def write_binary(packed: DataFrame, folder: str, per_shard: int = PER_SHARD) -> DataFrame:
    """Write ``[n, 3, T]`` uint32 blocks, a file a shard, and give name, samples and SHA-256 of each.

    Rows stream into the file in sequence order, so a task holds one batch and never a whole shard.
    ``folder`` must be a path all executors mount; ``write_blocks`` writes to any file system.
    """
    name = "shard_idx"
    rows = packed.withColumn(name, F.floor(F.col("seq_idx") / per_shard).cast("bigint")).repartition(name).sortWithinPartitions(name, "seq_idx")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, digest, current, n = None, None, None, 0
        for batch in batches:
            for shard, ids, docs, pos in zip(batch[name], batch["input_ids"], batch["doc_ids"], batch["position_ids"]):
                if shard != current:
                    if out is not None:
                        out.close()
                        yield pd.DataFrame([(f"shard-{current:06d}", n, digest.hexdigest())], columns=["shard_name", "num_samples", "sha256"])
                    current, n, digest = shard, 0, hashlib.sha256()
                    out = open(f"{folder}/shard-{shard:06d}.bin", "wb")
                block = np.stack([ids, docs, pos]).astype("<u4").tobytes()
                out.write(block)
                digest.update(block)
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame([(f"shard-{current:06d}", n, digest.hexdigest())], columns=["shard_name", "num_samples", "sha256"])

    return rows.select(name, "input_ids", "doc_ids", "position_ids").mapInPandas(write, "shard_name string, num_samples bigint, sha256 string")


def file_hashes(spark, folder: str) -> DataFrame:
    """SHA-256 of every shard file; compare with a manifest to find missing or damaged shards."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.bin")
    return files.select(F.regexp_extract("path", r"(shard-\d+)\.bin$", 1).alias("shard_name"), F.sha2("content", 256).alias("sha256"))


def damaged(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Shards of a manifest whose file is missing or has another hash."""
    return expected.select("shard_name", "sha256").join(found.withColumnRenamed("sha256", "found"), "shard_name", "left").where(
        F.col("found").isNull() | (F.col("found") != F.col("sha256"))
    ).select("shard_name", F.when(F.col("found").isNull(), F.concat(F.lit("MISSING_SHARD_"), "shard_name")).otherwise(F.concat(F.lit("CORRUPTED_SHARD_"), "shard_name")).alias("reason"))


def read_binary(path: str, length: int) -> np.ndarray:
    """Memory-mapped ``[n, 3, length]`` view of one shard file."""
    return np.memmap(path, dtype="<u4", mode="r").reshape(-1, 3, length)
