"""Named queries over the test tables.  Each reads its whole tables; ``oracle`` holds the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_name, nfc, shingles, words
from ..operators import accounting, cleaning, dedup, filters, gate, hashing, lineage, mixture, packing, shards, tokenization
from ..operators.prefix import with_running_total
from ..sources import adapters, registry
from ..session import shared_dir, spread, table
from ..streaming import stateful
from . import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

PACK_LENGTH, PER_SHARD, TARGET = 1024, 100, 500000


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _raw(spark, d):
    """All deliveries; queries over them end in ``distinct`` because repeated ones carry the same text."""
    return table(spark, d, "raw_documents")


def _experiments(spark, d):
    """One made-up experiment for every run and stage of the accounting table; hash digits decide what is wrong with it."""
    rows = table(spark, d, "stage_stats").where("run_id is not null and stage_ord is not null").select("run_id", "stage_ord").distinct()
    k = F.md5(F.concat_ws("-", "run_id", "stage_ord"))
    digit = lambda i: F.substring(F.col("k"), i, 1)
    rows = rows.withColumn("k", k)
    return rows.select(
        F.concat_ws("-", "run_id", "stage_ord").alias("id"),
        F.when(digit(1) == "0", "unknown").when(digit(1) == "1", "").otherwise(F.concat("k", F.substring("k", 1, 8))).alias("git_commit"),
        F.when(digit(2) == "0", "sha256_placeholder").when(digit(2) != "1", F.md5(F.concat(F.lit("c"), "k"))).alias("config_hash"),
        F.when(digit(3) == "0", "").otherwise(F.concat(F.lit("v"), F.col("stage_ord").cast("string"))).alias("dataset_version"),
        F.md5(F.concat(F.lit("d"), "k")).alias("dataset_hash"), F.lit("t1").alias("tokenizer_version"), F.md5(F.concat(F.lit("t"), "k")).alias("tokenizer_hash"),
        F.lit("arch").alias("model_architecture"), F.when(digit(4) == "0", -1).otherwise(F.col("stage_ord")).cast("bigint").alias("random_seed"),
    )


def _checkpoints(spark, d):
    """Stages as checkpoints whose parent is the stage before; the table's repeated and missing rows are the errors."""
    rows = table(spark, d, "stage_stats").where("run_id is not null and stage_ord is not null")
    name = lambda o: F.concat_ws("-", F.col("run_id"), o.cast("string"))
    return rows.select(name(F.col("stage_ord")).alias("checkpoint_id"), F.col("run_id").alias("experiment_id"),
                       F.when(F.col("stage_ord") > 0, name(F.col("stage_ord") - 1)).alias("parent_id"), F.col("num_tokens").alias("step"))


@query
def clean_boilerplate(spark, d):
    s = cleaning.clean_stats("text")
    return _raw(spark, d).where("text is not null").select("doc_id", F.md5(cleaning.clean("text")).alias("clean_md5"), s["original_len"].alias("original_len"), s["cleaned_len"].alias("cleaned_len"), s["removed_chars"].alias("removed_chars")).distinct()


@query
def nfc_normalize(spark, d):
    rows = _raw(spark, d).where("text is not null").withColumn("n", nfc("text"))
    s = cleaning.normalize_stats("text", F.col("n"))
    return rows.select("doc_id", F.md5(F.replace("n", F.lit("\x00"), F.lit(""))).alias("text_md5"), *[s[c].alias(c) for c in ("original_len", "normalized_len", "changed", "replacement_chars", "nul_chars")]).distinct()


@query
def diacritics_check(spark, d):
    return _raw(spark, d).where("text is not null").groupBy("category").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(cleaning.diacritics_composed("text")).alias("n_composed"))


@query
def safety_raw(spark, d):
    return _raw(spark, d).where("text is not null").select("doc_id", F.array_join(filters.violations("text"), ";").alias("violations")).distinct()


@query
def safety_after_clean(spark, d):
    return spread(_raw(spark, d)).where("text is not null").select("doc_id", filters.is_safe(cleaning.clean("text")).alias("is_safe")).distinct()


@query
def pii_counts(spark, d):
    c = filters.pii_counts("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", *[c[k].alias(k) for k in filters.PII])


@query
def pii_redact(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(filters.pii_redact("text")).alias("redacted_md5"))


@query
def quality_score(spark, d):
    t = filters.quality_terms("text")
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", F.round(filters.quality_score("text"), 9).alias("score"), t["n_words"].alias("n_words"),
        *[F.round(t[c], 9).alias(c) for c in ("q_struct", "q_spam", "q_quality", "q_edu")])


@query
def quality_breakdown_by_lang(spark, d):
    scored = table(spark, d, "documents").where("text is not null").withColumn("s", filters.quality_score("text"))
    return scored.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("s"), 6).alias("mean_score"), F.round(F.min("s"), 6).alias("min_score"), F.count_if(F.col("s") < filters.QUALITY_CUT).alias("n_low"))


@query
def quality_filter(spark, d):
    return table(spark, d, "documents").where(filters.quality_score("text") >= filters.QUALITY_CUT).select("doc_id", "source", "n_chars")


@query
def content_hash_ids(spark, d):
    return _raw(spark, d).select(
        F.col("doc_id").alias("given_id"), hashing.content_hash("text").alias("content_sha"),
        hashing.document_id("source_id", "source_version", "source_record_id", "text").alias("made_id")).distinct()


@query
def exact_dedup(spark, d):
    return dedup.membership(table(spark, d, "documents"))


@query
def exact_dup_groups(spark, d):
    return dedup.exact_first(table(spark, d, "documents")).where("copies > 1")


@query
def shingle_counts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(words("text")).cast("bigint").alias("n_words"), F.size(shingles("text")).cast("bigint").alias("n_shingles"))


@query
def minhash_signature(spark, d):
    sig = dedup.minhash("text")
    return spread(table(spark, d, "documents")).where("text is not null").select("doc_id", F.md5(F.array_join(F.transform(sig, lambda v: v.cast("string")), ",")).alias("sig_md5"))


@query
def near_dup_pairs(spark, d):
    docs = table(spark, d, "documents")
    reps = dedup.exact_first(docs).select(F.col("first_id").alias("doc_id"))
    return dedup.near_pairs(dedup.signatures(docs, reps), "doc_id")


@query
def near_dedup_keep(spark, d):
    return dedup.near_dedup(table(spark, d, "documents"))


@query
def registry_semi_join(spark, d):
    approved = table(spark, d, "source_registry").where("status = 'APPROVED' and allowed_for_training")
    return registry.registered(_raw(spark, d), approved).select("doc_id", "source_key").distinct()


@query
def unregistered_anti_join(spark, d):
    return registry.unregistered(_raw(spark, d), table(spark, d, "source_registry")).select("doc_id", "source_key").distinct()


@query
def source_contribution(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    rows = docs.select("source", F.octet_length("text").cast("bigint").alias("tokens"), filters.quality_score("text").alias("s"))
    return accounting.contribution(rows, rows.where(F.col("s") >= 0.8), "source", "tokens")


@query
def stage_accounting(spark, d):
    return accounting.last_write(table(spark, d, "stage_stats"))


@query
def reconcile(spark, d):
    return accounting.reconcile(accounting.last_write(table(spark, d, "stage_stats")))


@query
def stage_table(spark, d):
    return pipeline.stage_table(spread(table(spark, d, "documents")))


@query
def mixture_accounting(spark, d):
    rows = table(spark, d, "documents").select("category", F.octet_length("text").alias("tokens"))
    return accounting.mixture_accounting(rows, mixture.policy_frame(spark), "tokens").select(
        "domain", "tokens", *[F.round(c, 9).alias(c) for c in ("target_pct", "actual_pct", "deviation_pp")])


@query
def mixture_renormalize(spark, d):
    s = mixture.active_shares(mixture.policy_frame(spark), table(spark, d, "documents").where("category <> 'dialogue'"))
    return s.select("domain", "n_docs", F.round("share", 9).alias("share"), F.round("upper", 9).alias("upper"))


def _sample(spark, d, draws):
    docs = table(spark, d, "documents")
    s = mixture.active_shares(mixture.policy_frame(spark), docs)
    return mixture.round_robin(draws(s), docs.select("doc_id", "category"), s, "doc_id").select("step", "domain", "doc_id")


@query
def mixture_sample_hash(spark, d):
    return _sample(spark, d, lambda s: mixture.hashed_draws(spark, s, 2000, 42))


@query
def mixture_sample_numpy(spark, d):
    names = sorted(mixture.POLICY)
    return _sample(spark, d, lambda s: mixture.numpy_draws(spark, names, [mixture.POLICY[n] for n in names], 2000, 42))


@query
def byte_token_stats(spark, d):
    return tokenization.efficiency(table(spark, d, "documents"), "lang")


@query
def bpe_token_counts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(tokenization.encoder()("text")).cast("bigint").alias("n_tokens"))


@query
def tokenizer_roundtrip(spark, d):
    return table(spark, d, "documents").where("text is not null").select("lang", tokenization.round_trip()("text").alias("same")).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("same").alias("n_same"))


def _tokens(spark, d):
    return spread(table(spark, d, "documents")).where("text is not null").select("doc_id", packing.byte_tokens("text").alias("tokens"))


def _lengths(spark, d):
    """Byte tokens of every document; no text leaves the scan."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.octet_length("text").cast("bigint").alias("n"))


@query
def pack_sequences(spark, d):
    p = packing.pack(_tokens(spark, d), "doc_id", length=PACK_LENGTH)
    joined = lambda c: F.md5(F.array_join(F.transform(c, lambda v: v.cast("string")), ",")).alias(f"{c}_md5")
    return p.select("seq_idx", *[joined(c) for c in ("input_ids", "doc_ids", "position_ids")])


@query
def pack_fragment_stats(spark, d):
    return packing.fragments(_tokens(spark, d), "doc_id", length=PACK_LENGTH).groupBy("seq_idx").agg(
        F.count(F.lit(1)).alias("n_fragments"), F.sum("n_tokens").alias("n_tokens"), F.min("doc_counter").alias("first_doc"), F.max("doc_counter").alias("last_doc"))


def _mask(spark, d, by):
    p = packing.pack(_tokens(spark, d), "doc_id", length=PACK_LENGTH)
    return p.select("seq_idx", packing.valid_count(packing.label_mask("doc_ids", by)).alias("n_valid"),
                    packing.valid_count(packing.label_mask("doc_ids", by, True)).alias("n_valid_no_pad"),
                    F.aggregate(packing.shift(F.col("input_ids"), by), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("label_sum"))


@query
def ar_label_mask(spark, d):
    return _mask(spark, d, 1)


@query
def mtp2_label_mask(spark, d):
    return _mask(spark, d, 2)


@query
def masked_loss(spark, d):
    """Masked means over the byte tokens of a document, the loss of a token being a fixed function of its id."""
    rows = _tokens(spark, d).where(F.size("tokens") > 1)
    loss = F.transform(F.slice("tokens", 1, F.size("tokens") - 1), lambda t: t / 256.0)
    ones = F.array_repeat(F.lit(1), F.size("tokens") - 1)
    return rows.select("doc_id", F.round(packing.masked_mean(loss, ones), 9).alias("loss"))


@query
def shard_manifest(spark, d):
    seqs = packing.sequences(_lengths(spark, d), "doc_id", F.col("n") + 1, PACK_LENGTH)
    return shards.manifest(shards.shard_totals(seqs, PACK_LENGTH, PER_SHARD), PACK_LENGTH, "v1")


@query
def batch_slices(spark, d):
    """Fixed-size batches of packed rows, first 512 columns."""
    p = packing.pack(_tokens(spark, d), "doc_id", length=PACK_LENGTH)
    total = F.aggregate(F.slice("input_ids", 1, 512), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return p.groupBy(F.floor(F.col("seq_idx") / 8).cast("bigint").alias("batch_idx")).agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("token_sum"))


@query
def target_token_cut(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n"))
    return with_running_total(rows, "doc_id", {"before": F.col("n")}).where(F.col("before") < TARGET).select("doc_id", "n", "before")


@query
def diversity_audit(spark, d):
    n = F.octet_length("text")
    return table(spark, d, "documents").where("text is not null").groupBy("category").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("n_tokens"), F.round(F.avg(n), 6).alias("mean_len"), F.percentile(n, F.lit(0.5)).alias("median_len"))


@query
def dataset_health(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    per = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.countDistinct(F.md5("text")).alias("n_distinct"))
    p = F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy())  # one row per language
    return per.select("lang", "n_docs", "mean_chars", F.round(1 - F.col("n_distinct") / F.col("n_docs"), 6).alias("duplicate_rate"), F.round(-p * F.log2(p), 6).alias("entropy_part"))


@query
def byte_entropy(spark, d):
    """Entropy of the byte tokens of each category."""
    counts = table(spark, d, "documents").where("text <> ''").select("category", F.explode(packing.byte_tokens("text")).alias("t")).groupBy("category", "t").agg(F.count(F.lit(1)).alias("n"))
    # at most 256 rows a category
    p = F.col("n") / F.sum("n").over(Window.partitionBy("category"))
    return counts.select("category", (-p * F.log2(p)).alias("h")).groupBy("category").agg(F.round(F.sum("h"), 6).alias("entropy"))


@query
def dialogue_fold(spark, d):
    """Turns of dialogues taken apart and folded again."""
    docs = table(spark, d, "documents").where("category = 'dialogue' and text <> ''")
    turns = docs.select("doc_id", F.posexplode(adapters.messages("text"))).select("doc_id", F.col("pos").alias("turn"), "col.role", F.col("col.content").alias("text"))
    return adapters.fold_dialogue(turns, "doc_id", "turn", "role", "text").select("doc_id", F.md5("text").alias("text_md5"))


@query
def adapter_template_scan(spark, d):
    scans = [adapters.template_scan(spark, kind, 50, resume=7) for kind in adapters.TEMPLATES]
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out.select("pos", "category", "source_record_id", "text", "content_hash", "doc_id")


@query
def replicate_documents(spark, d):
    return adapters.replicate(table(spark, d, "documents").select("doc_id"), 60).groupBy("copy_no").agg(F.count(F.lit(1)).alias("n_docs"))


@query
def registry_upsert(spark, d):
    reg = table(spark, d, "source_registry").select("source_id", "status", "license")
    changed = reg.where("license is null or status = 'CANDIDATE'").withColumn("status", F.lit("QUARANTINED"))
    return registry.upsert(reg, changed)


@query
def license_audit(spark, d):
    """Sources whose licence is missing or unknown."""
    return table(spark, d, "source_registry").where("coalesce(license, '') = '' or upper(license) = 'UNKNOWN'").select(F.concat(F.lit("UNRESOLVED_LICENSE_"), "source_id").alias("reason"))


@query
def registry_documents(spark, d):
    """Left outer join with defaults: rows that came in for every registered source."""
    came = registry.with_registry_key(_raw(spark, d)).groupBy("source_key").agg(F.count_distinct("doc_id").alias("n"))
    reg = table(spark, d, "source_registry").select("source_id", canonical_name("source_id").alias("source_key"), "document_count")
    return reg.join(came, "source_key", "left").select("source_id", "document_count", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_docs"))


@query
def checkpoint_lineage_check(spark, d):
    return lineage.lineage_errors(_checkpoints(spark, d))


@query
def lineage_ancestry(spark, d):
    return lineage.ancestry(_checkpoints(spark, d))


@query
def identity_validation(spark, d):
    return _experiments(spark, d).select("id", F.array_join(hashing.identity_violations(), ",").alias("violations"))


@query
def identity_hashes(spark, d):
    return _experiments(spark, d).select("id", hashing.identity_hash().alias("identity_hash"))


@query
def config_hashes(spark, d):
    """Hashes of the mixing policies as settings, shares being floats that are rounded to eight digits first."""
    spec = table(spark, d, "mixture_targets").where("policy_id is not null and source is not null")
    return spec.groupBy("policy_id").agg(hashing.grouped_hash("source", "target_share").alias("config_hash"))


@query
def state_memory(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("batch"), *[F.lit(v).cast("bigint").alias(k) for k, v in (("num_heads", 16), ("head_dim", 96), ("num_layers", 18))])
    return accounting.state_memory(rows)


@query
def redaction_totals(spark, d):
    return pipeline.redaction_totals(spread(table(spark, d, "documents")))


@query
def rejection_rates(spark, d):
    return pipeline.rejection_rates(spread(table(spark, d, "documents")))


@query
def mixture_attempts(spark, d):
    """Draws whose document scores high enough, up to a number of byte tokens."""
    docs = table(spark, d, "documents")
    s = mixture.active_shares(mixture.policy_frame(spark), docs)
    pool = docs.select("doc_id", "category", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n"), filters.quality_score("text").alias("score"))
    rows = mixture.attempts(mixture.hashed_draws(spark, s, 2000, 42), pool, s, "doc_id", F.col("score") >= 0.8, F.col("n"), 400000)
    return rows.select("step", "domain", "doc_id", "n", "before")


@query
def policy_check(spark, d):
    return mixture.policy_sums(table(spark, d, "mixture_targets"))


@query
def training_permitted(spark, d):
    return registry.permitted(_raw(spark, d), table(spark, d, "source_registry")).select("doc_id", "source_key").distinct()


@query
def dataset_gate(spark, d):
    """Reasons against the sources as shards: their artifact's hash against the one their name and version give."""
    reg = table(spark, d, "source_registry")
    manifest = reg.select(F.col("source_id").alias("shard_name"), F.sha2(F.concat_ws(":", "source_id", "version"), 256).alias("sha256"))
    found = reg.where("raw_sha256 is not null").select(F.col("source_id").alias("shard_name"), F.col("raw_sha256").alias("sha256"))
    tokenizer = spark.createDataFrame([("TRAINED", "a", "b")], "status string, tokenizer_hash string, expected_hash string")
    return gate.dataset_reasons(manifest, found, reg, tokenizer)


@query
def registry_json(spark, d):
    """The registry written as JSON lines and read again."""
    reg = table(spark, d, "source_registry")
    folder = f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}"
    registry.save_json(reg, folder)
    return registry.load_json(spark, folder, reg.schema)


@query
def shard_blocks(spark, d):
    """Packed rows written a folder a shard and read again: sequences and token sums of every shard."""
    folder = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    shards.write_blocks(packing.pack(_tokens(spark, d), "doc_id", length=PACK_LENGTH), folder, PER_SHARD)
    total = F.sum(F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda x, y: x + y))
    return shards.read_blocks(spark, folder).groupBy(F.col("shard").alias("shard_name")).agg(F.count(F.lit(1)).alias("num_samples"), total.alias("token_sum"))


@query
def shard_locate(spark, d):
    seqs = packing.sequences(_lengths(spark, d), "doc_id", F.col("n") + 1, PACK_LENGTH)
    return shards.located(seqs, PER_SHARD)


@query
def packing_health(spark, d):
    """Tokens, end tokens, padding and changes of document inside the packed rows."""
    p = packing.pack(_tokens(spark, d), "doc_id", length=PACK_LENGTH)
    count = lambda c, v: F.sum(F.size(F.filter(c, lambda t: t == v))).alias(f"n_{v}")
    turns = F.sum(F.size(F.filter(F.zip_with(F.slice("doc_ids", 1, PACK_LENGTH - 1), packing.shift(F.col("doc_ids"), 1), lambda a, b: (a != b) & (b != 0)), lambda t: t)))
    return p.agg(F.count(F.lit(1)).alias("n_sequences"), count(F.col("input_ids"), packing.EOS), count(F.col("input_ids"), packing.PAD), turns.alias("n_boundaries"))


def _deliveries(spark, d):
    """Distinct (doc_id, category, text) of the raw table."""
    return _raw(spark, d).where("text is not null").select("doc_id", "category", "text").distinct()


@query
def raw_quality(spark, d):
    t = filters.quality_terms("text")
    return spread(_deliveries(spark, d)).select("doc_id", "category", F.round(filters.quality_score("text"), 9).alias("score"), t["n_words"].alias("n_words"))


@query
def raw_exact_dedup(spark, d):
    """Classes of equal texts over all records; a record delivered again is one record."""
    return dedup.membership(_raw(spark, d).select("doc_id", "text").distinct())


@query
def raw_shingle_counts(spark, d):
    return spread(_deliveries(spark, d)).select("doc_id", "category", F.size(words("text")).cast("bigint").alias("n_words"), F.size(shingles("text")).cast("bigint").alias("n_shingles"))


@query
def pack_records(spark, d):
    """Token arrays as delivered, empty ones left out, arrays that end in the end token as they are."""
    rows = table(spark, d, "tokenized_records").select("doc_id", F.col("token_ids").alias("tokens")).distinct()
    return packing.fragments(rows, "doc_id", length=PACK_LENGTH, skip_empty=True).groupBy("seq_idx").agg(
        F.count(F.lit(1)).alias("n_fragments"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.aggregate("piece", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("token_sum"))


@query
def pipeline_stages(spark, d):
    """Accounting of the whole chain, near copies, packing and shards included."""
    return pipeline.complete_stages(spread(table(spark, d, "documents")), length=PACK_LENGTH, per_shard=PER_SHARD)


@query
def stream_counters(spark, d):
    docs = _document_stream(spark, d).where("text is not null")
    return stateful.drain_complete(stateful.running_counters(docs, "lang"), "counters")


@query
def stream_pack_offsets(spark, d):
    """Places of documents in the packed stream, found batch by batch with a carried offset."""
    folder = f"{shared_dir(spark)}/pack-{uuid.uuid4().hex}"

    def place(frame, offset):
        rows = frame.select("doc_id", (F.octet_length("text") + 1).cast("bigint").alias("n"))
        with_running_total(rows, "doc_id", {"off": F.col("n")}).select("doc_id", (F.col("off") + offset).alias("off"), "n").write.mode("append").parquet(f"{folder}/out")
        return offset + (rows.agg(F.sum("n")).first()[0] or 0)

    stateful.packed_stream(_document_stream(spark, d).where("text is not null"), place, folder).awaitTermination()
    return spark.read.schema("doc_id bigint, off bigint, n bigint").parquet(f"{folder}/out")


@query
def stream_near_dedup(spark, d):
    """Near copies among the last 500 kept texts of each category, in the order of the stream."""
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        return stateful.drain(stateful.near_dedup_window(_document_stream(spark, d).where("category is not null"), "category"), "near")
    finally:
        spark.conf.set(name, before)


def _document_stream(spark, d):
    return spark.readStream.schema(table(spark, d, "documents").schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/documents.parquet*")


@query
def stream_exact_dedup(spark, d):
    return stateful.drain(stateful.exact_dedup(_document_stream(spark, d).select("text")), "stream_dedup").select("content_hash")


@query
def stream_source_resume(spark, d):
    adapters.register(spark)
    rows = spark.readStream.format("templates").option("kind", "web").option("resume", 10).option("n", 60).load()
    return stateful.drain_all(rows, "stream_source")


@query
def stream_event_windows(spark, d):
    schema = table(spark, d, "events").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    counts = ev.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return stateful.drain_complete(counts.select(F.col("w.start").alias("start"), "event_type", "n"), "events")


@query
def full_pipeline(spark, d):
    return pipeline.run(spread(table(spark, d, "documents"))).select("doc_id", "source", F.md5("final_text").alias("final_md5"), F.round("score", 9).alias("score"))
