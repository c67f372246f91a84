"""Running totals and numbers over a whole table without a single-task window.

Keys and values are range-partitioned by the order key into as many parts as ``spark.sql.shuffle.partitions``
says and written once; the write keeps every row in its part, whatever is computed again later.  Windows then
run over them alone, one part a task, and part totals (one row a part) give each part its offset.  Wide columns
are joined back by row number only where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def parts_of(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def placed(df: DataFrame, order_by: list[str]) -> DataFrame:
    """``df`` with ``_part`` and, if it has none, ``_row``: rows in parts that follow each other in ``order_by`` order, and a number of their own."""
    ranged = df.repartitionByRange(parts_of(df), *order_by).withColumn("_part", F.spark_partition_id())
    if "_row" not in df.columns:
        ranged = ranged.withColumn("_row", F.monotonically_increasing_id())
    return stored(ranged, "placed")


def with_running_total(df: DataFrame, order_by: str, values: dict[str, Column], tie: list[str] | None = None) -> DataFrame:
    """Add for each name the sum of its value over the rows before this one in ``order_by`` order.

    Rows that tie in ``order_by`` and ``tie`` follow each other in any order; NULL values count as 0 and NULL
    keys come first.  Columns besides the key are written as they come, without a shuffle, and joined back by
    row number.
    """
    order = [order_by, *(tie or [])]
    sums = [f"_v_{k}" for k in values]
    rows = df.withColumns({f"_v_{k}": F.coalesce(v.cast("bigint"), F.lit(0)) for k, v in values.items()})
    wide = bool(set(df.columns) - set(order))
    if wide:
        rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    lean = placed(rows.select(*(["_row"] if wide else []), *order, *sums), order)
    totals = lean.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    # one row a part
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in values])
    inside = Window.partitionBy("_part").orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, -1)
    summed = lean.join(F.broadcast(offsets), "_part").select(
        *(["_row"] if wide else order), *[(F.col(f"_o_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0))).alias(k) for k in values]
    )
    others = [c for c in df.columns if c not in values]
    if not wide:
        return summed.select(*others, *values)
    return rows.select("_row", *others).join(summed, "_row").select(*others, *values)
