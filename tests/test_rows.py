"""Dedup, packing, sampling, accounting, shards and streaming against plain Python."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import session
from textloom.operators import accounting, dedup, gate, lineage, mixture, packing, shards
from textloom.operators.prefix import with_running_total
from textloom.operators.ranking import ranked
from textloom.sources import adapters, config, registry
from textloom.streaming import stateful


def minhash(text, p=64):
    import hashlib

    w = text.split()
    sh = {" ".join(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else set(w)
    return [min((int(hashlib.md5(f"{i}_{s}".encode()).hexdigest()[:8], 16) for s in sh), default=0) for i in range(p)]


def texts(seed, n=40):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(60)) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 8])):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(9))
        out.append(" ".join(w))
    return out + ["", "one two", "one two"]


def test_near_dedup_is_greedy(spark):
    docs = texts(3)
    got = {r.doc_id: r.reason for r in dedup.near_dedup(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")).collect()}
    seen, kept, want = set(), [], {}
    for i, t in enumerate(docs):
        if t in seen:
            want[i] = "exact_duplicate"
            continue
        seen.add(t)
        s = minhash(t)
        near = any(sum(a == b for a, b in zip(s, k)) >= 52 for k in kept)
        want[i] = "near_duplicate" if near else "unique"
        if not near:
            kept.append(s)
    assert got == want and "near_duplicate" in want.values()


def test_bands_cover_all_slots():
    for p, t in ((64, 0.8), (32, 0.7)):
        bands = dedup.band_ranges(p, t)
        assert sorted(i for a, n in bands for i in range(a, a + n)) == list(range(1, p + 1))
        assert len(bands) == p - int(np.ceil(t * p - 1e-9)) + 1


def pack(docs, length, eos=2, pad=3):
    ids, owner, pos = [], [], []
    for d, toks in enumerate(docs, 1):
        toks = list(toks) if toks and toks[-1] == eos else [*toks, eos]
        ids += toks
        owner += [d] * len(toks)
        pos += range(len(toks))
    while len(ids) % length:
        ids.append(pad)
        owner.append(0)
        pos.append(0)
    cut = lambda x: [x[i: i + length] for i in range(0, len(x), length)]
    return cut(ids), cut(owner), cut(pos)


@pytest.mark.parametrize("length", [6, 16])
def test_pack(spark, length):
    rng = random.Random(length)
    docs = [[10, 11, 12], [20, 21], [30, 31, 32, 33]] + [[rng.randrange(10, 99) for _ in range(rng.choice([0, 1, 5, 40]))] for _ in range(50)] + [[7, 2]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, tokens array<int>").repartition(5)
    got = packing.pack(df, "doc_id", length=length).orderBy("seq_idx").collect()
    ids, owner, pos = pack(docs, length)
    assert [r.input_ids for r in got] == ids and [r.doc_ids for r in got] == owner and [r.position_ids for r in got] == pos


def test_masks(spark):
    df = spark.createDataFrame([([1, 1, 1, 1, 2, 2, 2, 2],)], "d array<int>")
    row = df.select(packing.valid_count(packing.label_mask("d", 1)).alias("a"), packing.valid_count(packing.label_mask("d", 2)).alias("b")).first()
    assert (row.a, row.b) == (6, 4)


def test_running_total_and_rank(spark):
    rng = random.Random(1)
    vals = [(i, rng.randrange(5), f"{rng.randrange(16**12):012x}") for i in range(500)]
    df = spark.createDataFrame(vals, "id bigint, v int, k string").repartition(7)
    got = {r.id: r.t for r in with_running_total(df, "id", {"t": F.col("v")}).collect()}
    total = 0
    for i, v, _ in vals:
        assert got[i] == total
        total += v
    ranks = {r.id: r.r for r in ranked(df, ["v"], "k", "r").collect()}
    for v in range(5):
        assert [ranks[i] for i, x, _ in sorted(vals, key=lambda r: r[2]) if x == v] == list(range(1, sum(x == v for _, x, _ in vals) + 1))


def test_running_total_with_ties_nulls_and_wide_columns(spark):
    rows = [(k, i, "x" * i) for i, k in enumerate(["b", "a", None, "b", "b", None, "prefix-of-many-keys-1", "prefix-of-many-keys-2"])]
    df = spark.createDataFrame(rows, "k string, v int, wide string").repartition(3)
    got = with_running_total(df, "k", {"t": F.col("v"), "n": F.lit(1)}, tie=["v"]).collect()
    total = 0
    for n, (k, v, w) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))):
        (r,) = [r for r in got if r.v == v]
        assert (r.k, r.wide, r.t, r.n) == (k, w, total, n)
        total += v
    assert with_running_total(df.limit(0), "k", {"t": F.col("v")}).count() == 0
    # rows that tie in everything stay as many as they are
    assert with_running_total(spark.createDataFrame([(1, 2)] * 5, "k int, v int"), "k", {"t": F.col("v")}).agg(F.sum("t")).first()[0] == 20


def test_hot_copies(spark):
    rows = spark.createDataFrame([(i, "same" if i % 3 else f"t{i % 4}") for i in range(60)] + [(99, None)], "doc_id bigint, text string")
    want = sorted(map(tuple, dedup.membership(rows).collect()))
    assert sorted(map(tuple, dedup.membership(rows, hot=10).collect())) == want and len(want) == 60
    most, dedup.MOST_HOT = dedup.MOST_HOT, 0
    try:
        assert sorted(map(tuple, dedup.membership(rows, hot=10).collect())) == want
    finally:
        dedup.MOST_HOT = most


def test_dataset_gate(spark):
    shards_of = lambda rows: spark.createDataFrame(rows, "shard_name string, sha256 string")
    reg = spark.createDataFrame([(f"s{i}", "MIT") for i in range(6)], "source_id string, license string")
    tok = spark.createDataFrame([("FROZEN", "h", "h")], "status string, tokenizer_hash string, expected_hash string")
    good = shards_of([("shard-0", "a"), ("shard-1", "b")])
    assert gate.dataset_reasons(good, good, reg, tok).count() == 0
    assert gate.dataset_status(gate.dataset_reasons(good, good, reg, tok)).first().status == "READY"
    bad_reg = spark.createDataFrame([("s0", None), ("s1", "UNKNOWN"), ("s2", "MIT")], "source_id string, license string")
    bad_tok = spark.createDataFrame([("TRAINED", "h", "g")], tok.schema)
    got = {r.reason for r in gate.dataset_reasons(good, shards_of([("shard-1", "x")]), bad_reg, bad_tok).collect()}
    assert got == {"MISSING_SHARD_shard-0", "CORRUPTED_SHARD_shard-1", "UNRESOLVED_LICENSE_s0", "UNRESOLVED_LICENSE_s1", "INSUFFICIENT_APPROVED_SOURCES", "TOKENIZER_NOT_FROZEN", "TOKENIZER_HASH_MISMATCH"}
    empty = {r.reason for r in gate.dataset_reasons(shards_of([]), shards_of([]), reg, tok.limit(0)).collect()}
    assert empty == {"ZERO_SHARDS_IN_MANIFEST", "MISSING_TOKENIZER_FILE"}


def test_blocks_and_fallback(spark, tmp_path):
    packed = packing.pack(spark.createDataFrame([(i, list(range(i))) for i in range(9)], "doc_id bigint, tokens array<int>"), "doc_id", length=6)
    shards.write_blocks(packed, str(tmp_path / "b"), 2)
    assert sorted(map(tuple, shards.read_blocks(spark, str(tmp_path / "b")).drop("shard").collect())) == sorted(map(tuple, packed.collect()))
    assert [r.seq_idx for r in shards.read_blocks(spark, str(tmp_path / "b"), "shard-000001").orderBy("seq_idx").collect()] == [2, 3]
    live = spark.range(3)
    assert adapters.with_fallback(lambda: live, spark.range(9)).count() == 3
    assert adapters.with_fallback(lambda: spark.read.parquet(str(tmp_path / "none")), live).count() == 3
    assert adapters.with_fallback(lambda: spark.range(0), live).count() == 3


def test_permissions(spark):
    reg = spark.createDataFrame([("s_1", True), ("s_2", False), ("s_3", None)], "source_id string, allowed_for_training boolean")
    rows = spark.createDataFrame([(1, "S-1"), (2, "s_2"), (3, "s_3"), (4, None)], "id int, source_id string")
    assert [r.id for r in registry.permitted(rows, reg).collect()] == [1]
    with pytest.raises(ValueError):
        registry.require_permitted(rows, reg)
    assert registry.require_permitted(rows.where("id = 1"), reg).count() == 1


def test_lineage_cycles(spark):
    rows = spark.createDataFrame([("a", "e", "b", 1), ("b", "e", "a", 2)], "checkpoint_id string, experiment_id string, parent_id string, step bigint")
    with pytest.raises(ValueError):
        lineage.ancestry(rows)


def test_written_tables_are_released(spark):
    kept = session.stored(spark.range(3))
    path = kept.inputFiles()[0]
    assert kept.count() == 3 and session.release(spark) >= 1 and session.release(spark) == 0
    assert not Path(path.removeprefix("file://")).exists()


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: Elsewhere)

        @staticmethod
        def getCheckpointDir():
            return Elsewhere

        isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError):
        session.shared_dir(Elsewhere)


def test_sampling(spark):
    with pytest.raises(ValueError):
        mixture.check_policy({"web": 0.9, "math": 0.9})
    mixture.check_policy(mixture.POLICY)
    rows = spark.createDataFrame([(i, "web" if i % 3 else "math") for i in range(9)], "doc_id bigint, category string")
    s = mixture.active_shares(mixture.policy_frame(spark), rows)
    runs = [sorted(map(tuple, mixture.round_robin(mixture.hashed_draws(spark, s, 50, 7).repartition(p), rows, s, "doc_id").select("step", "domain", "doc_id").collect())) for p in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 50
    web = [i for i in range(9) if i % 3]
    k = 0
    for _, domain, doc in runs[0]:
        if domain == "web":
            assert doc == web[k % len(web)]
            k += 1
    draws = [r.domain for r in mixture.numpy_draws(spark, ["a", "b"], [0.3, 0.7], 200, 42).orderBy("step").collect()]
    rng = np.random.RandomState(42)
    assert draws == [str(rng.choice(["a", "b"], p=[0.3, 0.7])) for _ in range(200)]


def test_reconcile(spark):
    rows = spark.createDataFrame([("r", 0, "raw", 100), ("r", 1, "cleaned", 95), ("r", 2, "dedup", 96), ("r", 3, "packed", 500), ("q", 0, "raw", 5), ("q", 1, "cleaned", 5)], "run_id string, stage_ord int, stage_name string, num_documents bigint")
    got = accounting.reconcile(rows).collect()
    assert [r.discrepancy for r in got] == ["Anomaly: Stage 'dedup' has more docs (96) than 'cleaned' (95)"]


def test_lineage(spark):
    rows = spark.createDataFrame([("a", "e", None, 1), ("b", "e", "a", 2), ("c", "e", "b", 1), ("d", "e", "z", 3)], "checkpoint_id string, experiment_id string, parent_id string, step bigint")
    assert {(r.checkpoint_id, r.error) for r in lineage.lineage_errors(rows).collect()} == {("c", "step_before_parent"), ("d", "missing_parent")}
    assert {(r.checkpoint_id, r.ancestor_id, r.distance) for r in lineage.ancestry(rows).collect()} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2), ("d", "z", 1)}


def test_shards_round_trip(spark, tmp_path):
    docs = [[10, 11, 12], [20, 21], [30, 31, 32, 33], list(range(40, 60))]
    packed = packing.pack(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, tokens array<int>"), "doc_id", length=6)
    written = shards.write_binary(packed, str(tmp_path), 2).cache()
    n = packed.count()
    assert written.agg(F.sum("num_samples")).first()[0] == n
    back = np.concatenate([shards.read_binary(p, 6) for p in sorted(tmp_path.glob("*.bin"))])
    assert [list(x[0]) for x in back] == [r.input_ids for r in packed.orderBy("seq_idx").collect()]
    assert shards.damaged(written, shards.file_hashes(spark, str(tmp_path))).isEmpty()
    first = sorted(tmp_path.glob("*.bin"))[0]
    first.write_bytes(b"\0" + first.read_bytes()[1:])
    sorted(tmp_path.glob("*.bin"))[-1].unlink()
    reasons = {r.reason[:7] for r in shards.damaged(written, shards.file_hashes(spark, str(tmp_path))).collect()}
    assert reasons == {"CORRUPT", "MISSING"}


def test_registry(spark, tmp_path):
    reg = spark.createDataFrame([("s_1", "A"), ("s_2", "B")], "source_id string, status string")
    rows = spark.createDataFrame([(1, "S-1"), (2, "s_9"), (3, None)], "id int, source_id string")
    assert [r.id for r in registry.registered(rows, reg).collect()] == [1]
    assert sorted(r.id for r in registry.unregistered(rows, reg).collect()) == [2, 3]
    up = registry.upsert(reg, spark.createDataFrame([("s_2", "C"), ("s_3", "D")], "source_id string, status string"))
    assert {tuple(r) for r in up.collect()} == {("s_1", "A"), ("s_2", "C"), ("s_3", "D")}
    path = str(tmp_path / "reg")
    registry.save_json(up, path)
    assert {tuple(r) for r in registry.load_json(spark, path, up.schema).collect()} == {tuple(r) for r in up.collect()}
    assert registry.raw_artifact(up, str(tmp_path / "a")) == registry.raw_artifact(up.repartition(3), str(tmp_path / "b"))


def test_settings(tmp_path):
    s = config.Settings(seed=5)
    s.save(str(tmp_path / "s.json"))
    assert config.Settings.load(str(tmp_path / "s.json")) == s
    with pytest.raises(ValueError):
        config.Settings(sequence_length=0)
    (tmp_path / "s.yaml").write_text("seed: 7  # a note\npolicy:\n  web: 1.0\n")
    assert config.Settings.load(str(tmp_path / "s.yaml")) == config.Settings(seed=7, policy={"web": 1.0})
    assert mixture.estimated_documents(100_000_000) == 24415 * 120


def test_adapters(spark):
    adapters.register(spark)
    a = [tuple(r) for r in spark.read.format("templates").option("kind", "math").option("resume", 3).option("n", 7).load().orderBy("pos").collect()]
    b = [(r.pos, r.source_record_id, r.text) for r in adapters.template_scan(spark, "math", 7, 3).orderBy("pos").collect()]
    assert a == b and a[0][0] == 3
    turns = spark.createDataFrame([(1, 1, "USER", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", None)], "c int, t int, r string, x string")
    assert adapters.fold_dialogue(turns, "c", "t", "r", "x").first().text == "User: hi\n\nAssistant: yo"


def test_streams_equal_batch(spark, tmp_path):
    docs = [(i, "g", t) for i, t in enumerate(texts(5, 24))]
    df = spark.createDataFrame(docs, "doc_id bigint, g string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    once = stateful.drain(stateful.exact_dedup(stream).select("text"), "t")
    assert sorted(r[0] for r in once.collect()) == sorted({t for _, _, t in docs})


def test_stream_source_resumes(spark):
    adapters.register(spark)
    rows = spark.readStream.format("templates").option("kind", "web").option("resume", 4).option("n", 30).option("batch", 8).load()
    assert sorted(r.pos for r in stateful.drain_all(rows, "src").collect()) == list(range(4, 34))


def test_stream_near_window(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    docs = texts(11, 20)
    df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(docs)], "doc_id bigint, g string, text string")
    for k, (a, b) in enumerate([(0, 9), (9, 30)]):
        df.where(f"doc_id >= {a} and doc_id < {b}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.doc_id: r.reason for r in stateful.drain(stateful.near_dedup_window(stream, "g", window=4), "near").collect()}
    kept, want = [], {}
    for i, t in enumerate(docs):
        s = minhash(t)
        near = any(sum(a == b for a, b in zip(s, k)) >= 52 for k in kept[-4:])
        want[i] = "near_duplicate" if near else "unique"
        if not near:
            kept.append(s)
    assert got == want


def test_packing_stream_equals_batch(spark, tmp_path):
    rng = random.Random(0)
    docs = [(i, [rng.randrange(10, 99) for _ in range(rng.randrange(1, 20))]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, tokens array<int>")
    for k in range(3):
        df.where(f"doc_id div 14 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def place(frame, offset):
        placed = with_running_total(frame.withColumn("n", F.size(packing.with_eos("tokens"))), "doc_id", {"off": F.col("n")})
        placed.select("doc_id", (F.col("off") + offset).alias("off"), "n").write.mode("append").parquet(str(tmp_path / "out"))
        return offset + (frame.agg(F.sum(F.size(packing.with_eos("tokens")))).first()[0] or 0)

    stateful.packed_stream(stream, place, str(tmp_path / "state")).awaitTermination()
    got = {r.doc_id: r.off for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    off, want = 0, {}
    for i, t in docs:
        want[i] = off
        off += len(t) + 1
    assert got == want
