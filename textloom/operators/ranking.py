"""Row numbers inside groups without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import placed


def ranked(df: DataFrame, keys: list[str], order_by: str, name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... in ``order_by`` order inside ``keys``; ties in any order.

    Rows are range-partitioned by the order key and counted per (keys, part); a row's number is its number
    in the part plus the counts of the parts before.  The count table has one row a group and part.
    """
    rows = placed(df, [order_by])
    counts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_part").orderBy(order_by, "_row")
    return (
        rows.withColumn("_r", F.row_number().over(inside))
        .join(offsets, [*keys, "_part"]).withColumn(name, F.col("_off") + F.col("_r")).drop("_part", "_row", "_r", "_off")
    )
