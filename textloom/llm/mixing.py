"""Problem 8: drawing records so that every source has its target share of the tokens.

Records of one content are one record, found in every source that holds a copy.  Contents with the same
set of sources form a pattern.  Patterns supply tokens, sources demand their quota of the total, and a
min-cost flow routes them: the k-th use of a pattern's tokens costs more than the (k-1)-th, so nothing is
repeated while unused tokens could serve, and no record is used more often than the policy allows.  What
flows from a pattern to a source is then cut from the pattern's records in seeded order.

The flow works on patterns and sources.  Records never reach the driver.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .budget import VOCABULARY, token_counter

BUCKETS, SEED = 256, 42
#: Distinct sets of sources that the driver takes: a parameter of ``draws``, about 300 MB.
MOST_PATTERNS = 1_000_000


def records(docs: DataFrame, path: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(content, n_tokens, sources, ids): one row per distinct text with tokens; ``ids`` maps a source to its lowest key.

    NULL and empty texts have no tokens and NULL sources serve nobody; both are left out.
    """
    rows = docs.where(F.col("text").isNotNull() & (F.col("text") != "") & F.col("source").isNotNull())
    sized = rows.select(key, "source", F.md5("text").alias("content"), token_counter(path)("text").alias("n_tokens")).where("n_tokens > 0")
    per_source = sized.groupBy("content", "source").agg(F.min(key).alias("id"), F.max("n_tokens").alias("n_tokens"))
    # at most one entry a source
    return per_source.groupBy("content").agg(
        F.max("n_tokens").alias("n_tokens"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "id")))).alias("ids"),
    )


def route(supply: dict[tuple, int], limit: dict[tuple, int], quota: dict[str, int]) -> dict[tuple[tuple, str], int]:
    """Min-cost flow from patterns (tuples of sources) to sources.

    Only the number of uses has a cost and that cost is convex, so the cheapest augmenting paths are those
    of the lowest open use: capacity is opened use by use, and each time the flow is raised to a maximum.
    Paths are searched over sources: one leads on to another if a pattern that serves it could serve the
    other.  A step costs the square of the sources at most and fills a pattern, a source or an edge.
    """
    flow: dict[tuple[tuple, str], int] = {}
    serves = {p: [s for s in p if s in quota] for p in supply}
    sent = dict.fromkeys(supply, 0)
    need = dict(quota)
    # insertion-ordered sets: patterns with tokens left by source, and patterns whose tokens at one source could go to another
    free: dict[str, dict] = {s: {} for s in quota}
    moves: dict[str, dict[str, dict]] = {s: {} for s in quota}

    def change(p: tuple, s: str, amount: int) -> None:
        now = flow.get((p, s), 0) + amount
        flow[p, s] = now
        for t in serves[p]:
            if t != s:
                if now:
                    moves[s].setdefault(t, {})[p] = None
                else:
                    moves[s][t].pop(p, None)

    for use in range(1, max(limit.values(), default=0) + 1):
        room = {p: min(use, limit[p]) * n - sent[p] for p, n in supply.items()}
        for p, r in room.items():
            if r > 0:
                for s in serves[p]:
                    free[s][p] = None
        while True:
            before: dict[str, str | None] = {s: None for s in quota if free[s]}
            queue = deque(before)
            target = next((s for s in queue if need[s] > 0), None)
            while queue and target is None:
                s = queue.popleft()
                for t, ps in moves[s].items():
                    if ps and t not in before:
                        before[t] = s
                        if need[t] > 0:
                            target = t
                            break
                        queue.append(t)
            if target is None:
                break
            path = [target]
            while (s := before[path[-1]]) is not None:
                path.append(s)
            path.reverse()  # from a source with tokens left for it to the one below its quota
            first = next(iter(free[path[0]]))
            via = [next(iter(moves[s][t])) for s, t in zip(path, path[1:])]
            amount = min(room[first], need[target], *(flow[p, s] for p, s in zip(via, path)))
            change(first, path[0], amount)
            for p, s, t in zip(via, path, path[1:]):
                change(p, s, -amount)
                change(p, t, amount)
            room[first] -= amount
            sent[first] += amount
            need[target] -= amount
            if not room[first]:
                for s in serves[first]:
                    free[s].pop(first, None)
        for s in free:
            free[s].clear()
    return {k: v for k, v in flow.items() if v}


def plans(recs: DataFrame, targets: DataFrame, total_tokens: int | None = None, most_patterns: int = MOST_PATTERNS) -> tuple[list[tuple], list[tuple]]:
    """Stretches (policy, pattern, source, from, to, supply) of each pattern's line of uses, and quotas (policy, source, tokens).

    ``total_tokens`` is the size of a mixture; by default what the policy's sources hold once.
    """
    grouped = recs.groupBy(F.map_keys("ids").alias("pattern")).agg(F.sum("n_tokens").alias("n"))
    rows = grouped.limit(most_patterns + 1).collect()
    if len(rows) > most_patterns:
        raise ValueError(f"more than {most_patterns} sets of sources: raise most_patterns and the driver's memory")
    patterns = {tuple(r[0]): int(r[1]) for r in rows}
    policies: dict[str, dict[str, tuple[float, int]]] = {}
    for r in targets.select("policy_id", "source", "target_share", "max_repeats").collect():
        if r[0] is not None and r[1] is not None:
            policies.setdefault(r[0], {})[r[1]] = (r[2] or 0.0, max(1, r[3] or 1))
    out, quotas = [], []
    for policy, sources in sorted(policies.items()):
        usable = {p: n for p, n in sorted(patterns.items()) if any(s in sources for s in p)}
        total = total_tokens or sum(usable.values())
        quota = {s: round(share * total) for s, (share, _) in sources.items()}
        quotas += [(policy, s, q) for s, q in quota.items()]
        limit = {p: min(sources[s][1] for s in p if s in sources) for p in usable}
        flow = route(usable, limit, quota)
        for p, n in usable.items():
            at = 0
            for s in p:
                f = flow.get((p, s), 0)
                if f:
                    out.append((policy, list(p), s, at, at + f, n))
                    at += f
    return out, quotas


def draws(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, path: str = VOCABULARY, key: str = "doc_id", most_patterns: int = MOST_PATTERNS) -> tuple[DataFrame, DataFrame]:
    """(policy_id, source, key, n_tokens, uses): the records drawn for each policy; and (policy_id, source, quota).

    A pattern's records stand in seeded order on a line that is run through once a use; a record counts for
    the source in whose stretch its start lies, so a source misses its quota by less than one record a
    pattern.  Repeated target rows fold; an empty table of documents or targets gives no rows.
    """
    recs = stored(records(docs, path, key), "records")
    rows, quotas = plans(recs, targets, total_tokens, most_patterns)
    spark = docs.sparkSession
    schema = "policy_id string, pattern array<string>, source string, low bigint, high bigint, supply bigint"
    plan = spark.createDataFrame(rows, schema)
    # one row a policy, pattern and source: bounded by the patterns above
    per_pattern = plan.groupBy("policy_id", "pattern").agg(
        F.max("high").alias("total"), F.first("supply").alias("supply"), F.array_sort(F.collect_list(F.struct("low", "high", "source"))).alias("parts"),
    )
    lined = recs.select("content", "n_tokens", "ids", F.map_keys("ids").alias("pattern")).join(F.broadcast(per_pattern), "pattern")
    order = F.xxhash64(F.lit(seed), "policy_id", "content")
    lined = lined.withColumn("o", order).withColumn("b", F.pmod(F.col("o"), F.lit(BUCKETS)))
    line = Window.partitionBy("policy_id", "pattern", "b").orderBy("o", "content").rowsBetween(Window.unboundedPreceding, -1)
    sums = lined.groupBy("policy_id", "pattern", "b").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("policy_id", "pattern").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("policy_id", "pattern", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = lined.withColumn("inside", F.coalesce(F.sum("n_tokens").over(line), F.lit(0))).join(offsets, ["policy_id", "pattern", "b"])
    start = F.col("base") + F.col("inside")
    last_use = F.floor((F.col("total") - start - 1) / F.col("supply"))
    used = placed.where(start < F.col("total")).withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), last_use), lambda k: k * F.col("supply") + start)))
    part = F.filter("parts", lambda x: (x["low"] <= F.col("at")) & (F.col("at") < x["high"]))[0]
    drawn = used.select("policy_id", part["source"].alias("source"), "ids", "n_tokens").withColumn(
        key, F.try_element_at("ids", F.col("source"))
    ).groupBy("policy_id", "source", key).agg(F.max("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("uses"))
    return drawn, spark.createDataFrame(quotas, "policy_id string, source string, quota bigint")


def shares(drawn: DataFrame, quotas: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of every source of every policy, and how often its records were used.

    ``reached_share`` is the share of what was drawn, ``filled`` the part of the quota.  Where a source
    cannot meet its quota (``met`` false), the shares of the others of that policy rise in proportion.
    """
    sums = drawn.groupBy("policy_id", "source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("uses").alias("most_uses"),
        F.max("n_tokens").alias("largest"),
    )
    rows = targets.where("policy_id is not null and source is not null").dropDuplicates(["policy_id", "source"])
    rows = rows.join(quotas, ["policy_id", "source"], "left").join(sums, ["policy_id", "source"], "left")
    rows = rows.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("quota", F.coalesce("quota", F.lit(0)))
    whole = F.sum("tokens").over(Window.partitionBy("policy_id"))  # one row a source
    return rows.select(
        "policy_id", "source", "target_share", "max_repeats", "quota", "tokens", F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("reached_share"),
        F.when(F.col("quota") > 0, F.col("tokens") / F.col("quota")).otherwise(1.0).alias("filled"),
        (F.col("tokens") + F.coalesce("largest", F.lit(0)) >= F.col("quota")).alias("met"),
    )
