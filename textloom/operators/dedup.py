"""Exact and near-duplicate removal.

Near duplicates are found with a lossless band join: two signatures of P slots with at least m equal
slots differ in at most P - m, so of P - m + 1 bands at least one is equal.  Exact copies are folded
first, so a text that holds a third of all rows is one row in the join.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.text import col
from ..session import cut, stored

PERMUTATIONS, THRESHOLD, SHINGLE = 64, 0.8, 5


def exact_first(df: DataFrame, text: str = "text", order_by: str = "doc_id") -> DataFrame:
    """The row with the lowest ``order_by`` of every distinct text; NULL texts are kept apart and dropped.

    The aggregate combines on the map side, so a hot text sends one row per task.
    """
    firsts = (
        df.where(F.col(text).isNotNull())
        .groupBy(F.sha2(F.col(text), 256).alias("content_hash"))
        .agg(F.min(order_by).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    )
    return firsts


HOT, MOST_HOT = 100_000, 10_000  # copies from which on a text is hot, and hot texts sent to the tasks at most


def membership(df: DataFrame, text: str = "text", order_by: str = "doc_id", hot: int = HOT) -> DataFrame:
    """One row per document with the lowest id of its exact copies as class id; NULL texts give none.

    Classes of more than ``hot`` copies go to the tasks, so their rows are never gathered by content; there
    are at most rows / ``hot`` of them, and beyond ``MOST_HOT`` all classes are joined with a salt instead.
    """
    firsts = stored(exact_first(df, text, order_by), "firsts")
    rows = df.where(F.col(text).isNotNull()).select(F.col(order_by), F.sha2(F.col(text), 256).alias("content_hash"))
    large = firsts.where(F.col("copies") > hot).select("content_hash", F.col("first_id").alias("hot_id"))
    n = large.count()
    if n > MOST_HOT:
        salted = firsts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15))))
        joined = rows.withColumn("_s", F.pmod(F.xxhash64(order_by), F.lit(16)).cast("int")).join(salted, ["content_hash", "_s"])
    elif n:
        marked = rows.join(F.broadcast(large), "content_hash", "left")
        cold = marked.where(F.col("hot_id").isNull()).join(firsts.where(F.col("copies") <= hot), "content_hash").select(order_by, "first_id")
        joined = marked.where(F.col("hot_id").isNotNull()).select(order_by, F.col("hot_id").alias("first_id")).unionByName(cold)
    else:
        joined = rows.join(firsts, "content_hash")
    return joined.select(order_by, F.col("first_id").alias("class_id"), (F.col(order_by) != F.col("first_id")).alias("is_copy"))


def minhash(text: str | Column, permutations: int = PERMUTATIONS, size: int = SHINGLE) -> Column:
    """Slot i is the least 32-bit md5 prefix of ``i_shingle``; empty texts have zeros, NULL stays NULL.

    Runs in Arrow batches: a digest costs a seventh there of what it does inside a nested lambda of a
    Spark expression.  ``str.split`` cuts words where ``functions.words`` does.
    """
    @F.pandas_udf(ArrayType(LongType()))
    def signature(batch: pd.Series) -> pd.Series:
        prefixes = [f"{i}_".encode() for i in range(permutations)]
        md5 = hashlib.md5
        out = []
        for text in batch:
            if text is None:
                out.append(None)
                continue
            w = text.split()
            runs = {" ".join(w[i: i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else set(w)
            parts = [s.encode() for s in runs]
            out.append([int.from_bytes(min([md5(p + s).digest()[:4] for s in parts]), "big") for p in prefixes] if parts else [0] * permutations)
        return pd.Series(out, index=batch.index)

    return signature(col(text))


def signatures(df: DataFrame, reps: DataFrame, text: str = "text", order_by: str = "doc_id", permutations: int = PERMUTATIONS) -> DataFrame:
    """(order_by, sig) of the representatives, computed once.

    Representatives are joined by key before the digests.  Partitions are fixed, as those the optimizer
    would make by bytes are too few for a step that is all computing.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(order_by, text).repartition(parts, order_by).join(reps, order_by)
    return cut(rows.select(order_by, minhash(text, permutations).alias("sig")))


def equal_slots(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x)


def band_ranges(permutations: int, threshold: float) -> list[tuple[int, int]]:
    """(1-based start, length) of the bands; together they cover every slot once."""
    need = math.ceil(threshold * permutations - 1e-9)
    n = permutations - need + 1
    edges = [round(i * permutations / n) for i in range(n + 1)]
    return [(a + 1, b - a) for a, b in zip(edges, edges[1:])]


def near_pairs(signed: DataFrame, key: str, permutations: int = PERMUTATIONS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (id_a < id_b) of ``signed(key, sig)`` with at least the threshold of equal slots.

    Only (band, id) goes through the band join; signatures are joined to the distinct pairs that come out.
    """
    need = math.ceil(threshold * permutations - 1e-9)
    bands = F.array(*[
        F.xxhash64(F.lit(i), F.slice(F.col("sig"), start, length))
        for i, (start, length) in enumerate(band_ranges(permutations, threshold))
    ])
    keyed = signed.select(F.col(key).alias("id"), F.explode(bands).alias("band"))
    a, b = keyed.select(F.col("id").alias("id_a"), "band"), keyed.select(F.col("id").alias("id_b"), "band")
    pairs = a.join(b, "band").where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b").distinct()
    side = lambda x: signed.select(F.col(key).alias(f"id_{x}"), F.col("sig").alias(f"sig_{x}"))
    checked = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    return checked.select("id_a", "id_b", equal_slots(F.col("sig_a"), F.col("sig_b")).cast("bigint").alias("equal_slots")).where(F.col("equal_slots") >= need)


def greedy_keep(pairs: DataFrame) -> DataFrame:
    """Ids dropped when rows are taken in id order and a row goes if an earlier kept row is near.

    Rounds decide all rows whose earlier neighbours are decided; the number of rounds is the longest
    chain of near texts, not the number of rows.  Nothing but a count reaches the driver.
    """
    edges = cut(pairs.select(F.col("id_a").alias("early"), F.col("id_b").alias("late")))
    state = cut(
        edges.select(F.col("early").alias("id")).union(edges.select(F.col("late").alias("id"))).distinct()
        .withColumn("kept", F.lit(None).cast("boolean"))
    )
    while True:
        seen = edges.join(state.select(F.col("id").alias("early"), F.col("kept").alias("early_kept")), "early")
        verdict = seen.groupBy(F.col("late").alias("id")).agg(
            F.max(F.coalesce(F.col("early_kept"), F.lit(False))).alias("any_kept"),
            F.max(F.col("early_kept").isNull()).alias("open"),
        )
        state = cut(
            state.join(verdict, "id", "left").select(
                "id",
                F.when(F.col("kept").isNotNull(), F.col("kept"))
                .when(F.col("any_kept"), False)
                .when(~F.coalesce(F.col("open"), F.lit(False)), True)
                .alias("kept"),
            )
        )
        if state.where(F.col("kept").isNull()).isEmpty():
            return state.where(~F.col("kept")).select("id")


def near_dedup(df: DataFrame, text: str = "text", order_by: str = "doc_id",
               permutations: int = PERMUTATIONS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with text: its reason, unique, exact_duplicate or near_duplicate."""
    classes = membership(df, text, order_by)
    signed = signatures(df, classes.where(~F.col("is_copy")).select(order_by), text, order_by, permutations)
    dropped = greedy_keep(near_pairs(signed, order_by, permutations, threshold))
    return classes.join(dropped.withColumnRenamed("id", order_by).withColumn("near", F.lit(True)), order_by, "left").select(
        order_by, "class_id",
        F.when(F.col("is_copy"), "exact_duplicate").when(F.col("near"), "near_duplicate").otherwise("unique").alias("reason"),
    )
