"""Parent-pointer lineage: validation and ancestry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def lineage_errors(records: DataFrame) -> DataFrame:
    """One row per broken rule: duplicate_id, missing_parent, step_before_parent or bad_field."""
    dup = records.groupBy("checkpoint_id").count().where("count > 1").select("checkpoint_id", F.lit("duplicate_id").alias("error"))
    bad = records.where(
        (F.coalesce("checkpoint_id", F.lit("")) == "") | (F.coalesce("experiment_id", F.lit("")) == "") | (F.coalesce("step", F.lit(-1)) < 0)
    ).select("checkpoint_id", F.lit("bad_field").alias("error"))
    parents = records.select(F.col("checkpoint_id").alias("parent_id"), F.col("step").alias("parent_step")).groupBy("parent_id").agg(F.max("parent_step").alias("parent_step"), F.lit(True).alias("there"))
    linked = records.where(F.col("parent_id").isNotNull()).join(parents, "parent_id", "left")
    lost = linked.where(F.col("there").isNull()).select("checkpoint_id", F.lit("missing_parent").alias("error"))
    early = linked.where(F.col("step") < F.col("parent_step")).select("checkpoint_id", F.lit("step_before_parent").alias("error"))
    return dup.union(bad).union(lost).union(early)


def ancestry(records: DataFrame) -> DataFrame:
    """Every (checkpoint, ancestor, distance), a round for each generation; every round is written.

    Records without a parent end a line and a parent nobody knows is the last ancestor.  A cycle is an error.
    """
    known = stored(records.where(F.col("parent_id").isNotNull()).select("checkpoint_id", "parent_id").distinct(), "parents")
    step = F.lit(1).cast("bigint")
    out = front = known.select("checkpoint_id", F.col("parent_id").alias("ancestor_id"), step.alias("distance"))
    up = known.select(F.col("checkpoint_id").alias("ancestor_id"), F.col("parent_id").alias("next_id"))
    while True:
        front = stored(front.join(up, "ancestor_id").select("checkpoint_id", F.col("next_id").alias("ancestor_id"), (F.col("distance") + 1).alias("distance")).distinct(), "ancestors")
        if front.isEmpty():
            return out
        if not front.where("checkpoint_id = ancestor_id").isEmpty():
            raise ValueError("a checkpoint is its own ancestor")
        out = out.unionByName(front)
