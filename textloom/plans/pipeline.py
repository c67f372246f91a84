"""The chain: clean, normalise, screen, redact, score and fold copies as one plan; ``complete`` goes on to near copies, packing and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.cleaning import clean, normalize
from ..operators.dedup import near_dedup
from ..operators.filters import PII, QUALITY_CUT, is_safe, pii_counts, pii_redact, quality_score
from ..operators.hashing import content_hash
from ..operators.packing import LENGTH, byte_tokens, pack, sequences
from ..operators.shards import PER_SHARD, shard_totals
from ..session import stored


def judged(clean_text: Column) -> Column:
    """Struct of final text, score and rejecting stage of a cleaned, normalised text.

    One expression that binds each intermediate text once: written as columns that build on each other,
    the optimizer would repeat the rewrites wherever a later column uses them.
    """
    def chain(c: Column) -> Column:
        def scored(final: Column, score: Column) -> Column:
            rejected = F.when(~is_safe(c), "safety").when(score < QUALITY_CUT, "quality")
            return F.struct(final.alias("final_text"), score.alias("score"), rejected.alias("rejected_by"))

        return let(pii_redact(c), lambda final: let(quality_score(final), lambda score: scored(final, score)))

    return let(clean_text, chain)


def annotated(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row with its final text, score and the stage that rejects it (NULL if none, not counting copies)."""
    staged = df.withColumn("_j", judged(normalize(clean(text))))
    return staged.select(
        "*", "_j.final_text", "_j.score", F.when(F.col(text).isNull(), "null_text").otherwise(F.col("_j.rejected_by")).alias("rejected_by"),
    ).drop("_j")


def run(df: DataFrame, text: str = "text", order_by: str = "doc_id") -> DataFrame:
    """Rows that pass every stage, first of each distinct final text.

    Rejected rows leave inside a generator, which the optimizer does not turn into a filter that would
    compute the chain again.  What passes is written once: the choice of the first copy and the result
    both read it.
    """
    rows = df.where(F.col(text).isNotNull()).withColumn("_c", normalize(clean(text)))
    kept = F.filter(F.array(judged(F.col("_c"))), lambda x: x["rejected_by"].isNull())
    passed = rows.select(*df.columns, F.inline(kept)).drop("rejected_by")
    passed = stored(passed.withColumn("content_hash", content_hash("final_text")), "passed")
    firsts = passed.groupBy("content_hash").agg(F.min(order_by).alias(order_by))
    return passed.join(firsts, ["content_hash", order_by], "left_semi").dropDuplicates([order_by])


def stage_table(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents and byte tokens after each stage in one pass over the rows."""
    a = annotated(df, text).withColumn("content_hash", content_hash("final_text"))
    n = F.octet_length("final_text")
    safe = F.col("rejected_by").isNull() | (F.col("rejected_by") == "quality")
    good = F.col("rejected_by").isNull()
    by_text = a.groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("raw"), F.sum(F.octet_length(text)).alias("raw_t"),
        F.count_if(safe).alias("safe"), F.sum(F.when(safe, n)).alias("safe_t"),
        F.count_if(good).alias("good"), F.sum(F.when(good, n)).alias("good_t"), F.max(F.when(good, n)).alias("one"),
    )
    sums = by_text.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("raw", "raw_t", "safe", "safe_t", "good", "good_t")],
                       F.count("one").alias("uniq"), F.coalesce(F.sum("one"), F.lit(0)).cast("bigint").alias("uniq_t"))
    stages = [("raw", "raw", "raw_t"), ("safe", "safe", "safe_t"), ("quality", "good", "good_t"), ("dedup", "uniq", "uniq_t")]
    rows = F.array(*[F.struct(F.lit(i).alias("stage_ord"), F.lit(name).alias("stage_name"), F.col(d).alias("num_documents"), F.col(t).alias("num_tokens")) for i, (name, d, t) in enumerate(stages)])
    return sums.select(F.explode(rows).alias("s")).select("s.*")


def complete(df: DataFrame, text: str = "text", order_by: str = "doc_id", length: int = LENGTH, per_shard: int = PER_SHARD) -> dict[str, DataFrame]:
    """The whole chain: ``kept`` documents after exact and near copies, their ``packed`` byte tokens and ``shards``.

    Every stage of the chain that feeds several others is written once.
    """
    passed = stored(run(df, text, order_by), "exact")
    unique = near_dedup(passed, "final_text", order_by).where("reason = 'unique'").select(order_by)
    kept = stored(passed.join(unique, order_by, "left_semi"), "kept")
    tokens = kept.select(order_by, byte_tokens("final_text").alias("tokens"))
    seqs = sequences(kept.select(order_by, (F.octet_length("final_text") + 1).alias("n")), order_by, F.col("n"), length)
    return {"passed": passed, "kept": kept, "packed": pack(tokens, order_by, length=length), "shards": shard_totals(seqs, length, per_shard)}


def complete_stages(df: DataFrame, text: str = "text", order_by: str = "doc_id", length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Documents and tokens after every stage from raw texts to shards; the last two count sequences and shards."""
    parts = complete(df, text, order_by, length, per_shard)

    def stage(i: int, name: str, rows: DataFrame, n: Column, t: Column) -> DataFrame:
        return rows.agg(n.alias("num_documents"), F.coalesce(t, F.lit(0)).cast("bigint").alias("num_tokens")).select(F.lit(i).alias("stage_ord"), F.lit(name).alias("stage_name"), "num_documents", "num_tokens")

    n, size = F.count(F.lit(1)), F.sum(F.octet_length("final_text"))
    out = stage_table(df, text).where("stage_ord < 4")
    for x in (
        stage(4, "near", parts["kept"], n, size), stage(5, "tokenized", parts["kept"], n, F.sum(F.octet_length("final_text") + 1)),
        stage(6, "packed", parts["shards"], F.coalesce(F.sum("num_samples"), F.lit(0)), F.sum("num_tokens")), stage(7, "shards", parts["shards"], n, F.sum("num_tokens")),
    ):
        out = out.unionByName(x)
    return out


def rejection_rates(df: DataFrame, text: str = "text", order_by: str = "doc_id") -> DataFrame:
    """One row: documents seen and accepted, and the share of those seen that every stage takes out.

    Near copies are looked for among the documents that pass the other stages.
    """
    a = stored(annotated(df.where(F.col(text).isNotNull()), text).select(order_by, "final_text", "rejected_by"), "annotated")
    passed = a.where(F.col("rejected_by").isNull()).select(order_by, "final_text")
    reasons = near_dedup(passed, "final_text", order_by).agg(F.count_if(F.col("reason") == "exact_duplicate").alias("exact"), F.count_if(F.col("reason") == "near_duplicate").alias("near"), F.count_if(F.col("reason") == "unique").alias("kept"))
    seen = a.agg(F.count(F.lit(1)).alias("n_seen"), F.count_if(F.col("rejected_by") == "safety").alias("unsafe"), F.count_if(F.col("rejected_by") == "quality").alias("poor"))
    rate = lambda c: F.round(F.col(c) / F.greatest("n_seen", F.lit(1)), 4)
    both = seen.unionByName(reasons, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("n_seen", "unsafe", "poor", "exact", "near", "kept")])
    return both.select("n_seen", F.col("kept").alias("n_accepted"), rate("unsafe").alias("safety_rejection_rate"), rate("poor").alias("quality_rejection_rate"), rate("exact").alias("exact_duplicate_rate"), rate("near").alias("near_duplicate_rate"))


def redaction_totals(df: DataFrame, by: str = "category", text: str = "text") -> DataFrame:
    """Redactions of every kind in the documents of each group that pass the safety stage."""
    rows = df.where(F.col(text).isNotNull()).select(by, normalize(clean(text)).alias("_c"))
    safe = stored(rows.where(is_safe("_c")), "safe")
    counts = safe.select(by, pii_counts("_c").alias("n"))
    sums = counts.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(f"n.{k}").alias(k) for k in PII])
    return sums.withColumn("n_redactions", sum((F.col(k) for k in PII), F.lit(0)))
