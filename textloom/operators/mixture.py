"""Mixture policies and seeded, order-independent sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hashed_unit
from .prefix import with_running_total
from .ranking import ranked

# Shares of the default policy.
POLICY = {"web": 0.45, "educational": 0.15, "code": 0.15, "math": 0.10, "vietnamese": 0.10, "dialogue": 0.05}
TOLERANCE = 1e-4


def policy_frame(spark: SparkSession, policy: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(list((policy or POLICY).items()), "domain string, weight double")


def check_policy(policy: dict[str, float]) -> None:
    total = sum(policy.values())
    if abs(total - 1.0) > TOLERANCE:
        raise ValueError(f"shares add up to {total}, not 1")


def policy_sums(targets: DataFrame, policy: str = "policy_id", share: str = "target_share") -> DataFrame:
    """Sum of the shares of every policy and whether it is 1 within ``TOLERANCE``."""
    sums = targets.groupBy(policy).agg(F.round(F.sum(share), 9).alias("total"), F.count(F.lit(1)).alias("n_sources"))
    return sums.withColumn("adds_up", F.abs(F.col("total") - 1.0) <= TOLERANCE)


def estimated_documents(target_tokens: int, length: int = 4096, per_sequence: int = 120) -> int:
    """Documents to draw for a number of tokens: whole sequences times documents in one."""
    return -(-target_tokens // length) * per_sequence


def active_shares(policy: DataFrame, rows: DataFrame, domain: str = "category") -> DataFrame:
    """Shares renormalised over the domains that have rows, with the cumulative upper bound of each."""
    counts = rows.where(F.col(domain).isNotNull()).groupBy(F.col(domain).alias("domain")).agg(F.count(F.lit(1)).alias("n_docs"))
    live = policy.join(counts, "domain")
    # one row per domain of the policy
    whole, upto = Window.partitionBy(), Window.orderBy("domain").rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("weight") / F.sum("weight").over(whole)
    return live.withColumn("share", share).withColumn("upper", F.sum("share").over(upto))


def numpy_draws(spark: SparkSession, domains: list[str], shares: list[float], n: int, seed: int) -> DataFrame:
    """Draws equal to ``RandomState(seed).choice(domains, p=shares)`` repeated ``n`` times.

    For runs that must repeat a sequential generator: its draws are made on the driver, so ``n`` is what one
    machine holds.  ``hashed_draws`` makes any number where the data is.
    """
    edges = np.cumsum(shares)
    at = np.searchsorted(edges / edges[-1], np.random.RandomState(seed).random_sample(n), "right")
    return spark.createDataFrame(pd.DataFrame({"step": np.arange(n), "domain": [domains[i] for i in at]}))


def hashed_draws(spark: SparkSession, shares: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` draws of a domain by hashed uniforms: any partitioning gives the same steps."""
    steps = spark.range(n).select(F.col("id").alias("step"), hashed_unit(F.lit(seed), F.col("id")).alias("u"))
    ranges = shares.select("domain", "upper", (F.col("upper") - F.col("share")).alias("lower"))
    last = Window.partitionBy()
    ranges = ranges.withColumn("upper", F.when(F.col("upper") == F.max("upper").over(last), 1.0).otherwise(F.col("upper")))
    # one row per policy domain: the broadcast cannot grow with the data
    return steps.join(F.broadcast(ranges), (F.col("u") >= F.col("lower")) & (F.col("u") < F.col("upper"))).select("step", "domain")


def round_robin(draws: DataFrame, rows: DataFrame, shares: DataFrame, order_by: str, domain: str = "category") -> DataFrame:
    """The k-th draw of a domain takes its row (k - 1) modulo its size, in ``order_by`` order.

    Ranks are made in two levels (domain and hash bucket), so no domain is ranked in one task.
    """
    drawn = ranked(draws, ["domain"], "step", "k").join(F.broadcast(shares.select("domain", "n_docs")), "domain")
    drawn = drawn.withColumn("pos", F.pmod(F.col("k") - 1, F.col("n_docs")))
    pool = ranked(rows.where(F.col(domain).isNotNull()).withColumnRenamed(domain, "domain"), ["domain"], order_by, "r")
    return drawn.join(pool.withColumn("pos", F.col("r") - 1), ["domain", "pos"]).drop("pos", "k", "r", "n_docs")


def attempts(draws: DataFrame, rows: DataFrame, shares: DataFrame, order_by: str, accepted: Column, tokens: Column, target: int, domain: str = "category") -> DataFrame:
    """Draws whose row is accepted, up to ``target`` tokens: a rejected row uses its turn but adds nothing.

    The last row taken is the one with which the running total reaches the target.
    """
    drawn = round_robin(draws, rows, shares, order_by, domain).where(accepted).withColumn("n_tokens", tokens.cast("bigint"))
    return with_running_total(drawn, "step", {"before": F.col("n_tokens")}).where(F.col("before") < target)
