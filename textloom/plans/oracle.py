"""The catalog's queries in SQL, written apart from the plans they check."""

from __future__ import annotations

from ..operators import filters, mixture
from ..sources.adapters import TEMPLATES
from .catalog import PACK_LENGTH, PER_SHARD, TARGET

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lit(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{WS}+'), lambda w: w <> '')"


UNSTRIPPED = "regexp_replace(regexp_replace(regexp_replace(text, '[\\x{200b}\\x{200c}\\x{200d}\\x{feff}]', '', 'g'), '<[^>]+>', ' ', 'g'), '\\n{4,}', chr(10)||chr(10)||chr(10), 'g')"
CLEAN = strip(UNSTRIPPED)


def violations(e: str) -> str:
    found = ", ".join(f"CASE WHEN contains(lower({e}), {lit(p)}) THEN {lit('malicious_pattern:' + p)} END" for p in filters.BLOCKED)
    return f"list_filter([{found}, CASE WHEN {strip(e)} = '' THEN 'empty_document' END], lambda v: v IS NOT NULL)"


QUALITY = f"""
  w AS (SELECT *, {words('text')} AS ws FROM documents WHERE text IS NOT NULL),
  t AS (SELECT *, len(ws) AS n, len(list_distinct(ws)) AS k FROM w),
  q AS (SELECT *, CASE WHEN n < 10 THEN 0.2::DOUBLE WHEN n BETWEEN 50 AND 2000 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS q_struct,
    greatest(0::DOUBLE, least(1::DOUBLE, 1.5::DOUBLE * (1 - k::DOUBLE / greatest(n, 1)))) AS q_spam,
    (CASE WHEN regexp_matches(text, '[.!?]{WS}*$') THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END) - (CASE WHEN contains(text, chr(65533)) THEN 0.5::DOUBLE ELSE 0::DOUBLE END) AS q_quality,
    CASE WHEN length(text)::DOUBLE / greatest(n, 1) BETWEEN 4 AND 10 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS q_edu FROM t),
  s AS (SELECT *, 0.2::DOUBLE + 0.3::DOUBLE * q_quality + 0.2::DOUBLE * q_struct + 0.3::DOUBLE * q_edu - 0.4::DOUBLE * q_spam AS score FROM q)"""

SHINGLES = f"""
  w AS (SELECT doc_id, {words('text')} AS ws FROM @SRC@),
  sh AS (SELECT doc_id, len(ws) AS n, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(0, len(ws) - 4), lambda i: array_to_string(ws[i+1:i+5], ' ')) ELSE ws END) AS s FROM w)"""

SIGNED = SHINGLES + """,
  e AS (SELECT doc_id, unnest(s) AS x FROM sh),
  m AS (SELECT doc_id, i, min(('0x' || substr(md5(i || '_' || x), 1, 8))::BIGINT) AS v FROM e, range(0, 64) r(i) GROUP BY 1, 2),
  sig AS (SELECT sh.doc_id, coalesce(any_value(z.v), list_transform(range(0, 64), lambda q: 0::BIGINT)) AS sig
    FROM sh LEFT JOIN (SELECT doc_id, list(v ORDER BY i) AS v FROM m GROUP BY 1) z USING (doc_id) GROUP BY 1)"""

POLICY = values(mixture.POLICY.items()) + " p(domain, weight)"
HASHED = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
SHARES = f"""
  counts AS (SELECT category AS domain, count(*) AS n_docs FROM documents WHERE category IS NOT NULL {{cond}} GROUP BY 1),
  live AS (SELECT domain, n_docs, weight::DOUBLE / sum(weight::DOUBLE) OVER () AS share FROM {POLICY} JOIN counts USING (domain)),
  shares AS (SELECT *, sum(share) OVER (ORDER BY domain) AS upper FROM live)"""

# the byte stream: four is added to every byte, every document ends in token 2
PACKED = f"""
  b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS doc, list_append(list_transform(range(1, strlen(text) + 1), lambda i: ('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::INT + 4), 2) AS tok FROM documents WHERE text IS NOT NULL),
  o AS (SELECT *, coalesce(sum(len(tok)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM b),
  x AS (SELECT doc, off, unnest(range(0, len(tok)))::BIGINT AS pos, unnest(tok)::BIGINT AS t FROM o),
  g AS (SELECT (off + pos) // {PACK_LENGTH} AS seq_idx, (off + pos) % {PACK_LENGTH} AS slot, doc::BIGINT AS doc, pos, t FROM x),
  top AS (SELECT max(seq_idx) AS s, arg_max(slot, seq_idx * {PACK_LENGTH} + slot) AS l FROM g),
  f AS (SELECT * FROM g UNION ALL SELECT s, unnest(range(l + 1, {PACK_LENGTH})), 0, 0, 3 FROM top)"""

NAME = "replace(replace(replace(lower(regexp_replace({}, '[\\s\\p{{Z}}\\p{{Cf}}]+', '', 'g')), '-', '_'), '.', '_'), ' ', '_')"
LAST = """
  last AS (SELECT run_id, stage_ord, stage_name, max((coalesce(recorded_at, '1970-01-01 00:00:00+00'::TIMESTAMPTZ), coalesce(num_documents, -1), coalesce(num_tokens, -1), coalesce(num_characters, -1), coalesce(rejected_count, -1))) AS b
    FROM stage_stats WHERE run_id IS NOT NULL AND stage_ord IS NOT NULL GROUP BY 1, 2, 3),
  st AS (SELECT run_id, stage_ord, stage_name, nullif(b[2], -1) AS num_documents, nullif(b[3], -1) AS num_tokens, nullif(b[4], -1) AS num_characters, nullif(b[5], -1) AS rejected_count FROM last)"""


def mask(by: int) -> str:
    return f"""WITH {PACKED},
      n AS (SELECT a.seq_idx, count(*) FILTER (a.doc = b.doc) AS v, count(*) FILTER (a.doc = b.doc AND a.doc <> 0) AS w, sum(b.t) AS label_sum
        FROM f a JOIN f b ON a.seq_idx = b.seq_idx AND b.slot = a.slot + {by} GROUP BY 1)
      SELECT seq_idx, greatest(v, 1)::BIGINT AS n_valid, greatest(w, 1)::BIGINT AS n_valid_no_pad, label_sum::BIGINT AS label_sum FROM n"""


def scan_sql() -> str:
    parts = []
    for kind, (texts, form) in TEMPLATES.items():
        lang = {"code": "code", "vietnamese": "vi"}.get(kind, "en")
        array = "[" + ", ".join(lit(t) for t in texts) + "]"
        text = f"printf({lit(form)}, {array}[pos % {len(texts)} + 1], pos)"
        parts.append(f"SELECT pos, '{kind}' AS category, '{lang}' AS language, {text} AS text, printf('rec_%08d', pos) AS source_record_id FROM range(7, 57) r(pos)")
    return f"""SELECT pos, category, source_record_id, text, sha256(text) AS content_hash,
      sha256(category || '_templates:v1:' || source_record_id || ':' || substr(sha256(text), 1, 16)) AS doc_id FROM ({' UNION ALL '.join(parts)})"""


EXPERIMENTS = """
  e0 AS (SELECT DISTINCT run_id, stage_ord, md5(run_id || '-' || stage_ord) AS k FROM stage_stats WHERE run_id IS NOT NULL AND stage_ord IS NOT NULL),
  x AS (SELECT run_id || '-' || stage_ord AS id, CASE k[1] WHEN '0' THEN 'unknown' WHEN '1' THEN '' ELSE k || k[1:8] END AS git_commit,
    CASE k[2] WHEN '0' THEN 'sha256_placeholder' WHEN '1' THEN NULL ELSE md5('c' || k) END AS config_hash, CASE k[3] WHEN '0' THEN '' ELSE 'v' || stage_ord END AS dataset_version,
    md5('d' || k) AS dataset_hash, 't1' AS tokenizer_version, md5('t' || k) AS tokenizer_hash, 'arch' AS model_architecture, CASE k[4] WHEN '0' THEN -1 ELSE stage_ord END AS random_seed FROM e0)"""


def quoted(c: str) -> str:
    return f"coalesce('\"' || {c} || '\"', 'null')"


IDENTITY_SQL = f"""WITH {EXPERIMENTS} SELECT id, concat_ws(',', CASE WHEN git_commit IN ('', 'unknown', 'placeholder', 'latest') THEN 'git_commit' END,
    CASE WHEN coalesce(config_hash, '') = '' OR config_hash LIKE '%placeholder%' THEN 'config_hash' END, CASE WHEN dataset_version = '' THEN 'dataset_version' END,
    CASE WHEN random_seed < 0 THEN 'random_seed' END) AS violations FROM x"""
IDENTITY_HASH_SQL = f"""WITH {EXPERIMENTS} SELECT id, sha256('{{"config_hash":' || {quoted('config_hash')} || ',"dataset_hash":' || {quoted('dataset_hash')} || ',"dataset_version":' || {quoted('dataset_version')}
    || ',"git_commit":' || {quoted('git_commit')} || ',"model_architecture":"arch","random_seed":' || random_seed || ',"tokenizer_hash":' || {quoted('tokenizer_hash')} || ',"tokenizer_version":"t1"}}') AS identity_hash FROM x"""
LINES = """ l AS (SELECT run_id || '-' || stage_ord AS checkpoint_id, run_id AS experiment_id, CASE WHEN stage_ord > 0 THEN run_id || '-' || (stage_ord - 1) END AS parent_id, num_tokens AS step
    FROM stage_stats WHERE run_id IS NOT NULL AND stage_ord IS NOT NULL)"""

# what the redaction step looks for, in this dialect and apart from the operator's own patterns
EMAILS = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
ADDRESSES = r"\b\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\b"
NUMBERS = r"\b(?:\+?\p{Nd}{1,3}[-.S]?)?\(?\p{Nd}{2,4}\)?[-.S]?\p{Nd}{3,4}[-.S]?\p{Nd}{3,4}\b".replace("S", r"\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
SECRETS = r"\b(?:ghp_[A-Za-z0-9]{36}|AKIA[0-9A-Z]{16}|sk-[a-zA-Z0-9]{32,})\b"


def counted(pattern: str) -> str:
    return f"sum(len(regexp_extract_all(plain, '{pattern}')))::BIGINT"


# near copies in document order: a document goes if an earlier one that stays is near
GREEDY = """
  pr AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b FROM sig a JOIN sig b ON a.doc_id < b.doc_id AND list_sum(list_transform(list_zip(a.sig, b.sig), lambda z: (z[1] = z[2])::INT)) >= 52),
  late AS (SELECT id_b AS id, list(id_a) AS early, row_number() OVER (ORDER BY id_b) AS k FROM pr GROUP BY id_b),
  gr(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
    SELECT late.k, CASE WHEN len(list_filter(early, lambda e: NOT list_contains(gone, e))) > 0 THEN list_append(gone, id) ELSE gone END FROM gr JOIN late ON late.k = gr.k + 1),
  near AS (SELECT unnest(gone) AS doc_id FROM gr WHERE k = (SELECT max(k) FROM gr))"""


def re2(pattern: str) -> str:
    """A pattern for DuckDB: digits and blanks of all scripts spelled out.  Its word bounds stay ASCII."""
    blanks = r"\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    return pattern.replace("(?U)", "").replace(r"\d", r"\p{Nd}").replace(r"\s", blanks)


def found(kind: str) -> str:
    return f"len(regexp_extract_all(text, {lit(re2(filters.PII[kind]))}))"


def redacted(e: str = "text") -> str:
    for kind, pattern in filters.PII.items():
        e = f"regexp_replace({e}, {lit(re2(pattern))}, {lit(filters.MARK[kind])}, 'g')"
    return e


CHAIN = f"""
  c AS (SELECT doc_id, source, text AS given, replace(nfc_normalize({CLEAN}), chr(0), '') AS plain FROM documents WHERE text IS NOT NULL),
  piped AS (SELECT doc_id, source, given, len({violations('plain')}) = 0 AS safe, {redacted('plain')} AS text FROM c),
  {QUALITY.strip().replace('FROM documents', 'FROM piped')}"""

SQL = {
    "clean_boilerplate": f"SELECT DISTINCT doc_id, md5({CLEAN}) AS clean_md5, length(text) AS original_len, length({UNSTRIPPED}) AS cleaned_len, length(text) - length({UNSTRIPPED}) AS removed_chars FROM raw_documents WHERE text IS NOT NULL",
    "nfc_normalize": """SELECT DISTINCT doc_id, md5(replace(n, chr(0), '')) AS text_md5, length(text) AS original_len, length(n) AS normalized_len, text <> n AS changed,
        length(n) - length(replace(n, chr(65533), '')) AS replacement_chars, length(n) - length(replace(n, chr(0), '')) AS nul_chars FROM (SELECT doc_id, text, nfc_normalize(text) AS n FROM raw_documents WHERE text IS NOT NULL)""",
    "diacritics_check": "SELECT category, count(*) AS n_docs, count(*) FILTER (NOT regexp_matches(nfc_normalize(text), '[\\x{300}-\\x{36f}]')) AS n_composed FROM raw_documents WHERE text IS NOT NULL GROUP BY 1",
    "safety_raw": f"SELECT DISTINCT doc_id, array_to_string({violations('text')}, ';') AS violations FROM raw_documents WHERE text IS NOT NULL",
    "safety_after_clean": f"SELECT DISTINCT doc_id, len({violations('c')}) = 0 AS is_safe FROM (SELECT doc_id, {CLEAN} AS c FROM raw_documents WHERE text IS NOT NULL)",
    "pii_counts": "SELECT doc_id, " + ", ".join(f"{found(k)} AS {k}" for k in filters.PII) + " FROM documents WHERE text IS NOT NULL",
    "pii_redact": f"SELECT doc_id, md5({redacted()}) AS redacted_md5 FROM documents WHERE text IS NOT NULL",
    "diversity_audit": f"""SELECT category, count(*) AS n_docs, sum(strlen(text))::BIGINT AS n_tokens, round(avg(strlen(text)), 6) AS mean_len, quantile_cont(strlen(text)::DOUBLE, 0.5) AS median_len FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "quality_score": f"WITH {QUALITY} SELECT doc_id, round(score, 9) AS score, n AS n_words, round(q_struct, 9) AS q_struct, round(q_spam, 9) AS q_spam, round(q_quality, 9) AS q_quality, round(q_edu, 9) AS q_edu FROM s",
    "quality_breakdown_by_lang": f"WITH {QUALITY} SELECT lang, count(*) AS n_docs, round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score, count(*) FILTER (score < 0.4::DOUBLE) AS n_low FROM s GROUP BY 1",
    "quality_filter": f"WITH {QUALITY} SELECT doc_id, source, n_chars FROM s WHERE score >= 0.4::DOUBLE",
    "content_hash_ids": "SELECT DISTINCT doc_id AS given_id, sha256(text) AS content_sha, sha256(source_id || ':' || source_version || ':' || source_record_id || ':' || substr(sha256(text), 1, 16)) AS made_id FROM raw_documents",
    "exact_dedup": "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS class_id, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS is_copy FROM documents WHERE text IS NOT NULL",
    "exact_dup_groups": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "shingle_counts": f"WITH {SHINGLES.replace('@SRC@', 'documents')} SELECT doc_id, n AS n_words, len(s) AS n_shingles FROM sh",
    "minhash_signature": f"WITH {SIGNED.replace('@SRC@', 'documents')} SELECT doc_id, md5(array_to_string(sig, ',')) AS sig_md5 FROM sig",
    "near_dup_pairs": f"""WITH reps AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text), {SIGNED.replace('@SRC@', 'reps')},
      pr AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, list_sum(list_transform(list_zip(a.sig, b.sig), lambda z: (z[1] = z[2])::INT))::BIGINT AS equal_slots FROM sig a JOIN sig b ON a.doc_id < b.doc_id)
      SELECT * FROM pr WHERE equal_slots >= 52""",
    "registry_semi_join": f"SELECT DISTINCT doc_id, {NAME.format('source_id')} AS source_key FROM raw_documents WHERE {NAME.format('source_id')} IN (SELECT {NAME.format('source_id')} FROM source_registry WHERE status = 'APPROVED' AND allowed_for_training)",
    "unregistered_anti_join": f"SELECT DISTINCT doc_id, {NAME.format('source_id')} AS source_key FROM raw_documents WHERE source_id IS NULL OR {NAME.format('source_id')} NOT IN (SELECT {NAME.format('source_id')} FROM source_registry)",
    "source_contribution": f"""WITH {QUALITY}, a AS (SELECT source, count(*) AS raw_docs, sum(strlen(text))::BIGINT AS raw_tokens, count(*) FILTER (score >= 0.8::DOUBLE) AS final_docs, coalesce(sum(strlen(text)) FILTER (score >= 0.8::DOUBLE), 0)::BIGINT AS final_tokens FROM s GROUP BY 1)
      SELECT *, round(final_tokens / greatest(raw_tokens, 1), 4) AS retention_rate FROM a""",
    "stage_accounting": f"WITH {LAST} SELECT * FROM st",
    "reconcile": f"""WITH {LAST}, p AS (SELECT *, lag(stage_name) OVER w AS prev_stage, lag(num_documents) OVER w AS prev_documents FROM st WINDOW w AS (PARTITION BY run_id ORDER BY stage_ord, stage_name NULLS FIRST))
      SELECT run_id, stage_ord, stage_name, prev_stage, num_documents, prev_documents, 'Anomaly: Stage ''' || coalesce(stage_name, 'null') || ''' has more docs (' || num_documents || ') than ''' || coalesce(prev_stage, 'null') || ''' (' || prev_documents || ')' AS discrepancy
      FROM p WHERE num_documents > prev_documents AND coalesce(stage_name NOT IN ('packed', 'shards'), true)""",
    "full_pipeline": f"""WITH {CHAIN} SELECT doc_id, source, md5(text) AS final_md5, round(score, 9) AS score FROM s WHERE safe AND score >= 0.4::DOUBLE
      QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "stage_table": f"""WITH {CHAIN}, u AS (SELECT DISTINCT text FROM s WHERE safe AND score >= 0.4::DOUBLE)
      SELECT 0::INT AS stage_ord, 'raw' AS stage_name, count(*) AS num_documents, sum(strlen(given))::BIGINT AS num_tokens FROM s
      UNION ALL SELECT 1, 'safe', count(*), coalesce(sum(strlen(text)), 0)::BIGINT FROM s WHERE safe
      UNION ALL SELECT 2, 'quality', count(*), coalesce(sum(strlen(text)), 0)::BIGINT FROM s WHERE safe AND score >= 0.4::DOUBLE
      UNION ALL SELECT 3, 'dedup', count(*), coalesce(sum(strlen(text)), 0)::BIGINT FROM u""",
    "mixture_accounting": f"""WITH sums AS (SELECT category AS domain, sum(strlen(text))::BIGINT AS tokens FROM documents GROUP BY 1),
      per AS (SELECT domain, coalesce(tokens, 0) AS tokens, 100 * weight::DOUBLE AS target_pct FROM {POLICY} LEFT JOIN sums USING (domain)),
      a AS (SELECT *, 100.0::DOUBLE * tokens / greatest(sum(tokens) OVER (), 1) AS actual_pct FROM per)
      SELECT domain, tokens, round(target_pct, 9) AS target_pct, round(actual_pct, 9) AS actual_pct, round(actual_pct - target_pct, 9) AS deviation_pp FROM a""",
    "mixture_renormalize": f"WITH {SHARES.format(cond=chr(65) + 'ND category <> ' + lit('dialogue'))} SELECT domain, n_docs, round(share, 9) AS share, round(upper, 9) AS upper FROM shares",
    "mixture_sample_hash": f"""WITH {SHARES.format(cond='')},
      u AS (SELECT step, {HASHED.format("'42:' || step")} AS u FROM range(0, 2000) r(step)),
      dr AS (SELECT step, domain, n_docs FROM u JOIN shares ON u >= upper - share AND (u < upper OR upper = (SELECT max(upper) FROM shares))),
      k AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY step) - 1) % n_docs AS pos FROM dr),
      pool AS (SELECT doc_id, category AS domain, row_number() OVER (PARTITION BY category ORDER BY doc_id) - 1 AS pos FROM documents)
      SELECT step, domain, doc_id FROM k JOIN pool USING (domain, pos)""",
    "byte_token_stats": f"""WITH a AS (SELECT lang, count(*) AS n_docs, sum(len({words('text')}))::BIGINT AS n_words, sum(length(text))::BIGINT AS n_chars, sum(strlen(text))::BIGINT AS n_bytes, sum(strlen(text))::BIGINT AS n_tokens FROM documents WHERE text IS NOT NULL GROUP BY 1)
      SELECT *, round(n_tokens / greatest(n_words, 1), 6) AS tokens_per_word, round(n_bytes / greatest(n_tokens, 1), 6) AS bytes_per_token, round(n_chars / greatest(n_tokens, 1), 6) AS chars_per_token FROM a""",
    "pack_sequences": f"""WITH {PACKED} SELECT seq_idx, md5(string_agg(t::VARCHAR, ',' ORDER BY slot)) AS input_ids_md5, md5(string_agg(doc::VARCHAR, ',' ORDER BY slot)) AS doc_ids_md5, md5(string_agg(pos::VARCHAR, ',' ORDER BY slot)) AS position_ids_md5 FROM f GROUP BY 1""",
    "pack_fragment_stats": f"WITH {PACKED} SELECT seq_idx, count(DISTINCT doc) AS n_fragments, count(*) AS n_tokens, min(doc) AS first_doc, max(doc) AS last_doc FROM g GROUP BY 1",
    "ar_label_mask": mask(1),
    "mtp2_label_mask": mask(2),
    "masked_loss": "SELECT doc_id, round(list_sum(list_transform(range(1, strlen(text)), lambda i: (('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::INT + 4) / 256.0::DOUBLE)) / (strlen(text) - 1), 9) AS loss FROM documents WHERE strlen(text) > 1",
    "shard_manifest": f"""WITH n AS (SELECT ceil(sum(strlen(text) + 1) / {PACK_LENGTH})::BIGINT AS seqs FROM documents WHERE text IS NOT NULL),
      sh AS (SELECT i, least({PER_SHARD}, seqs - i * {PER_SHARD})::BIGINT AS num_samples FROM n, range(0, 1000000) r(i) WHERE i * {PER_SHARD} < seqs)
      SELECT count(*) AS num_shards, (sum(num_samples) * {PACK_LENGTH})::BIGINT AS total_tokens,
        '{{"dataset_version":"v1","sequence_length":{PACK_LENGTH},"num_shards":' || count(*) || ',"total_tokens":' || (sum(num_samples) * {PACK_LENGTH})::BIGINT || ',"dtype":"uint32","shards":[' ||
        string_agg('{{"shard_name":"' || printf('shard-%06d', i) || '","num_samples":' || num_samples || ',"num_tokens":' || num_samples * {PACK_LENGTH} || '}}', ',' ORDER BY i) || ']}}' AS manifest FROM sh""",
    "batch_slices": f"WITH {PACKED} SELECT seq_idx // 8 AS batch_idx, count(DISTINCT seq_idx) AS n, sum(t) FILTER (slot < 512)::BIGINT AS token_sum FROM f GROUP BY 1",
    "target_token_cut": f"SELECT * FROM (SELECT doc_id, strlen(text)::BIGINT AS n, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents) WHERE before < {TARGET}",
    "dataset_health": """WITH per AS (SELECT lang, count(*) AS n_docs, round(avg(length(text)), 6) AS mean_chars, count(DISTINCT md5(text)) AS k FROM documents WHERE text IS NOT NULL GROUP BY 1),
      p AS (SELECT *, n_docs / sum(n_docs) OVER () AS p FROM per) SELECT lang, n_docs, mean_chars, round(1 - k / n_docs, 6) AS duplicate_rate, round(-p * log2(p), 6) AS entropy_part FROM p""",
    "byte_entropy": """WITH x AS (SELECT category, substr(hex(encode(text)), 2 * i - 1, 2) AS t FROM documents, LATERAL (SELECT unnest(range(1, strlen(text) + 1)) AS i) WHERE text <> ''),
      c AS (SELECT category, t, count(*) AS n FROM x GROUP BY 1, 2), p AS (SELECT category, n / sum(n) OVER (PARTITION BY category) AS p FROM c)
      SELECT category, round(sum(-p * log2(p)), 6) AS entropy FROM p GROUP BY 1""",
    "adapter_template_scan": scan_sql(),
    "replicate_documents": "SELECT copy_no::INT AS copy_no, count(*) AS n_docs FROM documents, range(0, 60) r(copy_no) GROUP BY 1",
    "registry_upsert": "SELECT source_id, CASE WHEN license IS NULL OR status = 'CANDIDATE' THEN 'QUARANTINED' ELSE status END AS status, license FROM source_registry",
    "license_audit": "SELECT 'UNRESOLVED_LICENSE_' || source_id AS reason FROM source_registry WHERE coalesce(license, '') = '' OR upper(license) = 'UNKNOWN'",
    "registry_documents": f"""WITH came AS (SELECT {NAME.format('source_id')} AS k, count(DISTINCT doc_id) AS n FROM raw_documents GROUP BY 1)
      SELECT source_id, document_count, coalesce(n, 0)::BIGINT AS n_docs FROM source_registry LEFT JOIN came ON k = {NAME.format('source_id')}""",
    "checkpoint_lineage_check": f"""WITH {LINES}, p AS (SELECT checkpoint_id AS pid, max(step) AS ps FROM l GROUP BY 1)
      SELECT checkpoint_id, 'duplicate_id' AS error FROM l GROUP BY 1 HAVING count(*) > 1
      UNION ALL SELECT checkpoint_id, 'bad_field' FROM l WHERE coalesce(checkpoint_id, '') = '' OR coalesce(experiment_id, '') = '' OR coalesce(step, -1) < 0
      UNION ALL SELECT checkpoint_id, 'missing_parent' FROM l LEFT JOIN p ON parent_id = pid WHERE parent_id IS NOT NULL AND pid IS NULL
      UNION ALL SELECT checkpoint_id, 'step_before_parent' FROM l JOIN p ON parent_id = pid WHERE step < ps""",
    "lineage_ancestry": f"""WITH RECURSIVE {LINES}, r AS (SELECT DISTINCT checkpoint_id, parent_id FROM l WHERE parent_id IS NOT NULL), up AS (SELECT checkpoint_id, parent_id AS ancestor_id, 1::BIGINT AS distance FROM r
      UNION ALL SELECT up.checkpoint_id, r.parent_id, distance + 1 FROM up JOIN r ON r.checkpoint_id = ancestor_id) SELECT * FROM up""",
    "identity_validation": IDENTITY_SQL,
    "identity_hashes": IDENTITY_HASH_SQL,
    "state_memory": "SELECT s_suppkey::BIGINT AS batch, 16::BIGINT AS num_heads, 96::BIGINT AS head_dim, 18::BIGINT AS num_layers, (16 * 96 * 96 * 18)::BIGINT AS elements_per_sample, (16 * 96 * 96 * 18)::BIGINT * s_suppkey * 4 / 1048576.0::DOUBLE AS fp32_mb, (16 * 96 * 96 * 18)::BIGINT * s_suppkey * 2 / 1048576.0::DOUBLE AS bf16_mb FROM supplier",
    "redaction_totals": f"""WITH c AS (SELECT category, replace(nfc_normalize({CLEAN}), chr(0), '') AS plain FROM documents WHERE text IS NOT NULL),
      n AS (SELECT category, count(*) AS n_docs, {counted(EMAILS)} AS email, {counted(ADDRESSES)} AS ipv4, {counted(NUMBERS)} AS phone, {counted(SECRETS)} AS api_key FROM c WHERE len({violations('plain')}) = 0 GROUP BY 1)
      SELECT *, email + ipv4 + phone + api_key AS n_redactions FROM n""",
    "near_dedup_keep": f"""WITH RECURSIVE cl AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS class_id FROM documents WHERE text IS NOT NULL), reps AS (SELECT doc_id, text FROM cl WHERE doc_id = class_id), {SIGNED.replace('@SRC@', 'reps')}, {GREEDY}
      SELECT doc_id, class_id, CASE WHEN doc_id <> class_id THEN 'exact_duplicate' WHEN doc_id IN (SELECT doc_id FROM near) THEN 'near_duplicate' ELSE 'unique' END AS reason FROM cl""",
    "rejection_rates": f"""WITH RECURSIVE {CHAIN}, good AS (SELECT doc_id, text FROM s WHERE safe AND score >= 0.4::DOUBLE), reps AS (SELECT min(doc_id) AS doc_id, text FROM good GROUP BY text), {SIGNED.replace('w AS (', 'w2 AS (').replace('FROM w)', 'FROM w2)').replace('@SRC@', 'reps')}, {GREEDY},
      t2 AS (SELECT count(*) AS n, count(*) FILTER (NOT safe) AS unsafe, count(*) FILTER (safe AND score < 0.4::DOUBLE) AS poor FROM s),
      k AS (SELECT (SELECT count(*) FROM good) AS good, (SELECT count(*) FROM reps) AS uniq, (SELECT count(*) FROM near) AS near)
      SELECT n AS n_seen, uniq - near AS n_accepted, round(unsafe / greatest(n, 1), 4) AS safety_rejection_rate, round(poor / greatest(n, 1), 4) AS quality_rejection_rate,
        round((good - uniq) / greatest(n, 1), 4) AS exact_duplicate_rate, round(near / greatest(n, 1), 4) AS near_duplicate_rate FROM t2, k""",
    "pipeline_stages": f"""WITH RECURSIVE {CHAIN}, good AS (SELECT doc_id, text FROM s WHERE safe AND score >= 0.4::DOUBLE), reps AS (SELECT min(doc_id) AS doc_id, text FROM good GROUP BY text), {SIGNED.replace('w AS (', 'w2 AS (').replace('FROM w)', 'FROM w2)').replace('@SRC@', 'reps')}, {GREEDY},
      kept AS (SELECT text FROM reps WHERE doc_id NOT IN (SELECT doc_id FROM near)), z AS (SELECT count(*) AS n, coalesce(sum(strlen(text)), 0)::BIGINT AS t FROM kept), nq AS (SELECT ceil((t + n) / {PACK_LENGTH})::BIGINT AS k FROM z)
      SELECT 0::INT AS stage_ord, 'raw' AS stage_name, count(*) AS num_documents, sum(strlen(given))::BIGINT AS num_tokens FROM s
      UNION ALL SELECT 1, 'safe', count(*), coalesce(sum(strlen(text)), 0)::BIGINT FROM s WHERE safe
      UNION ALL SELECT 2, 'quality', count(*), coalesce(sum(strlen(text)), 0)::BIGINT FROM good
      UNION ALL SELECT 3, 'dedup', count(*), coalesce(sum(strlen(text)), 0)::BIGINT FROM reps
      UNION ALL SELECT 4, 'near', n, t FROM z UNION ALL SELECT 5, 'tokenized', n, (t + n)::BIGINT FROM z
      UNION ALL SELECT 6, 'packed', k, k * {PACK_LENGTH} FROM nq UNION ALL SELECT 7, 'shards', ceil(k / {PER_SHARD})::BIGINT, k * {PACK_LENGTH} FROM nq""",
    "pack_records": f"""WITH r AS (SELECT DISTINCT doc_id, token_ids AS t FROM tokenized_records WHERE len(token_ids) > 0),
      e AS (SELECT doc_id, t AS raw, CASE WHEN t[len(t)] = 2 THEN t ELSE list_append(t, 2) END AS t FROM r),
      o AS (SELECT *, coalesce(sum(len(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, row_number() OVER (ORDER BY doc_id) AS doc FROM e),
      x AS (SELECT doc, off + unnest(range(0, len(t))) AS pos, unnest(t) AS v FROM o)
      SELECT pos // {PACK_LENGTH} AS seq_idx, count(DISTINCT doc) AS n_fragments, count(*) AS n_tokens, sum(v)::BIGINT AS token_sum FROM x GROUP BY 1""",
    "raw_quality": f"WITH {QUALITY.replace('FROM documents WHERE', 'FROM (SELECT DISTINCT doc_id, category, text FROM raw_documents) WHERE')} SELECT doc_id, category, round(score, 9) AS score, n AS n_words FROM s",
    "raw_exact_dedup": "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS class_id, doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS is_copy FROM (SELECT DISTINCT doc_id, text FROM raw_documents WHERE text IS NOT NULL)",
    "raw_shingle_counts": f"WITH {SHINGLES.replace('SELECT doc_id, ', 'SELECT doc_id, category, ', 1).replace('sh AS (SELECT doc_id,', 'sh AS (SELECT doc_id, category,').replace('@SRC@', '(SELECT DISTINCT doc_id, category, text FROM raw_documents WHERE text IS NOT NULL)')} SELECT doc_id, category, n AS n_words, len(s) AS n_shingles FROM sh",
    "mixture_attempts": f"""WITH {QUALITY}, {SHARES.format(cond='')},
      u AS (SELECT step, {HASHED.format("'42:' || step")} AS u FROM range(0, 2000) r(step)),
      dr AS (SELECT step, domain, n_docs FROM u JOIN shares ON u >= upper - share AND (u < upper OR upper = (SELECT max(upper) FROM shares))),
      kk AS (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY step) - 1) % n_docs AS pos FROM dr),
      pool AS (SELECT doc_id, category AS domain, strlen(text)::BIGINT AS n, row_number() OVER (PARTITION BY category ORDER BY doc_id) - 1 AS pos FROM documents),
      got AS (SELECT step, domain, doc_id, pool.n FROM kk JOIN pool USING (domain, pos) JOIN s USING (doc_id) WHERE score >= 0.8::DOUBLE),
      sums AS (SELECT *, coalesce(sum(n) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM got) SELECT * FROM sums WHERE before < 400000""",
    "config_hashes": """WITH e AS (SELECT DISTINCT policy_id, source, format('{:.8g}', coalesce(target_share, 0))::DOUBLE::VARCHAR AS v FROM mixture_targets WHERE policy_id IS NOT NULL AND source IS NOT NULL)
      SELECT policy_id, sha256('{' || string_agg('"' || source || '":' || v, ',' ORDER BY source) || '}') AS config_hash FROM e GROUP BY 1""",
    "policy_check": "SELECT policy_id, round(sum(target_share), 9) AS total, count(*) AS n_sources, abs(round(sum(target_share), 9) - 1.0::DOUBLE) <= 1e-4::DOUBLE AS adds_up FROM mixture_targets GROUP BY 1",
    "training_permitted": f"SELECT DISTINCT doc_id, {NAME.format('source_id')} AS source_key FROM raw_documents WHERE {NAME.format('source_id')} IN (SELECT {NAME.format('source_id')} FROM source_registry WHERE allowed_for_training)",
    "dataset_gate": """SELECT 'MISSING_SHARD_' || source_id AS reason FROM source_registry WHERE raw_sha256 IS NULL
      UNION ALL SELECT 'CORRUPTED_SHARD_' || source_id FROM source_registry WHERE raw_sha256 <> sha256(concat_ws(':', source_id, version))
      UNION ALL SELECT 'UNRESOLVED_LICENSE_' || source_id FROM source_registry WHERE coalesce(license, '') IN ('', 'UNKNOWN')
      UNION ALL SELECT 'INSUFFICIENT_APPROVED_SOURCES' FROM (SELECT count(DISTINCT source_id) AS n FROM source_registry) WHERE n < 6
      UNION ALL VALUES ('TOKENIZER_NOT_FROZEN'), ('TOKENIZER_HASH_MISMATCH')""",
    "registry_json": "SELECT * FROM source_registry",
    "shard_blocks": f"WITH {PACKED} SELECT printf('shard-%06d', seq_idx // {PER_SHARD}) AS shard_name, count(DISTINCT seq_idx) AS num_samples, sum(t)::BIGINT AS token_sum FROM f GROUP BY 1",
    "shard_locate": f"WITH n AS (SELECT ceil(sum(strlen(text) + 1) / {PACK_LENGTH})::BIGINT AS seqs FROM documents WHERE text IS NOT NULL) SELECT i AS seq_idx, printf('shard-%06d', i // {PER_SHARD}) AS shard_name, i % {PER_SHARD} AS place FROM n, range(0, 10000000) r(i) WHERE i < seqs",
    "packing_health": f"""WITH {PACKED}, c AS (SELECT count(*) FILTER (a.doc <> b.doc AND b.doc <> 0) AS n FROM f a JOIN f b ON a.seq_idx = b.seq_idx AND b.slot = a.slot + 1)
      SELECT count(DISTINCT seq_idx) AS n_sequences, count(*) FILTER (t = 2) AS n_2, count(*) FILTER (t = 3) AS n_3, (SELECT n FROM c) AS n_boundaries FROM f""",
    "dialogue_fold": r"""WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '\n([A-Za-z]+: )', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_matches(x, '^[A-Za-z]+: ')) AS turns FROM documents WHERE category = 'dialogue' AND text <> '')
      SELECT doc_id, md5(array_to_string(list_transform(turns, lambda x: upper(x[1]) || lower(regexp_extract(x, '^([A-Za-z]+): ', 1)[2:]) || ': ' || regexp_replace(x, '^[A-Za-z]+: ', '')), chr(10) || chr(10))) AS text_md5 FROM t WHERE len(turns) > 0""",
    "stream_counters": "SELECT lang, count(*) AS n_docs, sum(strlen(text))::BIGINT AS n_tokens FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "stream_pack_offsets": "SELECT doc_id, coalesce(sum(strlen(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, (strlen(text) + 1)::BIGINT AS n FROM documents WHERE text IS NOT NULL",
    "stream_exact_dedup": "SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL",
    "stream_event_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
