"""Stage accounting, reconciliation, mixture accounting and corpus health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stages that turn documents into sequences; their counts do not compare with the stage before.
EXEMPT = ("packed", "shards")


def last_write(stages: DataFrame) -> DataFrame:
    """The latest row of every run and stage.  Repeated rows fold; ties go to the larger counts."""
    best = F.struct(
        F.coalesce(F.col("recorded_at"), F.lit("1970-01-01").cast("timestamp")).alias("at"),
        F.coalesce("num_documents", F.lit(-1)).alias("d"), F.coalesce("num_tokens", F.lit(-1)).alias("t"),
        F.coalesce("num_characters", F.lit(-1)).alias("c"), F.coalesce("rejected_count", F.lit(-1)).alias("r"),
    )
    picked = stages.where(F.col("run_id").isNotNull() & F.col("stage_ord").isNotNull()).groupBy("run_id", "stage_ord", "stage_name").agg(F.max(best).alias("b"))
    known = lambda f: F.when(F.col(f"b.{f}") >= 0, F.col(f"b.{f}"))
    return picked.select(
        "run_id", "stage_ord", "stage_name", known("d").alias("num_documents"), known("t").alias("num_tokens"),
        known("c").alias("num_characters"), known("r").alias("rejected_count"),
    )


def reconcile(stages: DataFrame, exempt: tuple[str, ...] = EXEMPT) -> DataFrame:
    """Adjacent stages of a run in which the later one has more documents.  A run is one group of stages."""
    w = Window.partitionBy("run_id").orderBy("stage_ord", "stage_name")
    paired = stages.withColumn("prev_stage", F.lag("stage_name").over(w)).withColumn("prev_documents", F.lag("num_documents").over(w))
    return paired.where((F.col("num_documents") > F.col("prev_documents")) & ~F.coalesce(F.col("stage_name").isin(*exempt), F.lit(False))).select(
        "run_id", "stage_ord", "stage_name", "prev_stage", "num_documents", "prev_documents",
        F.format_string(
            "Anomaly: Stage '%s' has more docs (%d) than '%s' (%d)",
            "stage_name", "num_documents", "prev_stage", "prev_documents",
        ).alias("discrepancy"),
    )


def contribution(raw: DataFrame, final: DataFrame, key: str, tokens: str) -> DataFrame:
    """Documents and tokens of each source before and after, with the share of tokens kept."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{name}_docs"), F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias(f"{name}_tokens"))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    joined = side(raw, "raw").join(side(final, "final"), key, "left")
    return joined.select(key, "raw_docs", "raw_tokens", zero("final_docs"), zero("final_tokens")).withColumn(
        "retention_rate", F.round(F.col("final_tokens") / F.greatest(F.col("raw_tokens"), F.lit(1)), 4)
    )


def mixture_accounting(rows: DataFrame, policy: DataFrame, tokens: str, domain: str = "category") -> DataFrame:
    """Target and actual token share of every policy domain, in per cent, unrounded."""
    sums = rows.groupBy(F.col(domain).alias("domain")).agg(F.sum(tokens).cast("bigint").alias("tokens"))
    per = policy.join(sums, "domain", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("bigint")))
    total = F.greatest(F.sum("tokens").over(Window.partitionBy()), F.lit(1))  # one row per policy domain
    return per.withColumn("target_pct", 100 * F.col("weight")).withColumn("actual_pct", 100.0 * F.col("tokens") / total).select(
        "domain", "tokens", "target_pct", "actual_pct", (F.col("actual_pct") - F.col("target_pct")).alias("deviation_pp")
    )


def state_memory(rows: DataFrame) -> DataFrame:
    """Bytes of a recurrent state: heads x head_dim squared x layers x batch at 4 and 2 bytes."""
    elements = F.col("num_heads") * F.col("head_dim") * F.col("head_dim") * F.col("num_layers")
    return rows.select(
        "*", elements.cast("bigint").alias("elements_per_sample"),
        (elements * F.col("batch") * 4 / 1048576.0).alias("fp32_mb"), (elements * F.col("batch") * 2 / 1048576.0).alias("bf16_mb"),
    )
