"""Problem 3: filling containers of fixed capacity with token arrays, best fit, in bulk-synchronous rounds.

Sorted by length, documents form runs of equal length, and sorted by free space, containers form runs of
equal gaps; there are at most ``capacity`` runs of either kind, whatever the number of documents.  A round
sweeps over both sorted sequences: every document run, longest first, is matched with its successor, the
smallest gap that holds it.  Each container takes one document a round; documents that want the same gap
are served by rank.  Then gaps are updated and the next round starts.  When the longest document left fits
no gap, containers are opened for its run.

A sweep handles whole runs and so needs only their lengths and counts.  Which document gets which place
follows from its rank in its run: ranks are made in two levels (length and hash bucket), so a length that
holds a third of all rows is not ranked in one task, and places are looked up where the rows are.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

CAPACITY, BUCKETS = 1024, 1024


def items(df: DataFrame, key: str = "doc_id", tokens: str = "token_ids", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: (key, array_hash, part_no, first_token, length).

    NULL and empty arrays give none; rows repeated with the same array fold; the same key with different
    arrays stays apart.  Only arrays longer than the capacity are cut, into full pieces and one rest.
    """
    rows = df.where(F.col(tokens).isNotNull() & (F.size(tokens) > 0)).select(
        F.col(key), F.xxhash64(tokens).alias("array_hash"), F.size(tokens).alias("n")
    ).distinct()
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("part_no")
    cut = rows.select(key, "array_hash", "n", part)
    first = F.col("part_no") * capacity
    return cut.select(key, "array_hash", "part_no", first.alias("first_token"), F.least(F.col("n") - first, F.lit(capacity)).cast("int").alias("length"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int]]], int, int]:
    """Best-fit plan for ``counts`` documents of every length.

    Gives for every length a list of (first rank, first container, offset in the container), sorted by
    rank, then the number of containers and of rounds.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    done = dict.fromkeys(left, 0)
    placed: dict[int, list[tuple[int, int, int]]] = {n: [] for n in left}
    gaps: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first container, number)
    opened = rounds = 0
    while left:
        rounds += 1
        matched = False
        updated: list[tuple[int, int, int]] = []
        sizes = sorted(gaps)
        for n in sorted(left, reverse=True):
            at = bisect.bisect_left(sizes, n)
            while at < len(sizes) and left[n]:
                runs = gaps[sizes[at]]
                while runs and left[n]:
                    first, number = runs.pop()
                    take = min(number, left[n])
                    placed[n].append((done[n], first, capacity - sizes[at]))
                    done[n] += take
                    left[n] -= take
                    updated.append((sizes[at] - n, first, take))
                    if take < number:
                        runs.append((first + take, number - take))
                    matched = True
                at += 1
        left = {n: c for n, c in left.items() if c}
        gaps = {g: r for g, r in gaps.items() if r}
        for gap, first, number in updated:
            if gap:
                gaps.setdefault(gap, []).append((first, number))
        if not matched and left:
            n = max(left)
            number = -(-left[n] // (capacity // n))
            gaps.setdefault(capacity, []).append((opened, number))
            opened += number
    return placed, opened, rounds


def assignment(df: DataFrame, key: str = "doc_id", tokens: str = "token_ids", capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its container and place: (key, array_hash, part_no, first_token, length, container, offset).

    An empty table gives an empty result.  Ties are settled by hash bucket, key and part, so the result
    does not depend on partitioning.
    """
    pieces = stored(items(df, key, tokens, capacity).withColumn("bucket", F.pmod(F.xxhash64(key, "array_hash", "part_no"), F.lit(BUCKETS)).cast("int")), "pieces")
    counts = stored(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    # at most ``capacity`` rows
    places, _, _ = plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    table = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*p)) for n, p in places.items()}

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy(key, "array_hash", "part_no")
    ranked = pieces.withColumn("r", F.row_number().over(inside)).join(offsets, ["length", "bucket"])
    ranked = ranked.select(key, "array_hash", "part_no", "first_token", "length", (F.col("base") + F.col("r") - 1).alias("rank"))

    def look_up(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            container, offset = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int32)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                first_rank, first_container, at = table[int(n)]
                k = np.searchsorted(first_rank, ranks[rows], side="right") - 1
                container[rows] = first_container[k] + ranks[rows] - first_rank[k]
                offset[rows] = at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(container), pa.array(offset)], names=[*batch.schema.names[:-1], "container", "offset"])

    kind = dict(df.dtypes)[key]
    return ranked.mapInArrow(look_up, f"{key} {kind}, array_hash bigint, part_no int, first_token int, length int, container bigint, offset int")


def cut_documents(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of arrays that went into more than one container."""
    return assigned.where(F.col("part_no") == 1).select(key).distinct()


def fill(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens and share of padding of an assignment."""
    per = assigned.groupBy("container").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("used").alias("fullest"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("padding_share"),
    )
