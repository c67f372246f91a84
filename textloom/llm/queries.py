"""The pN_ queries over the test tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import budget, containers, leakage, lookalikes, mixing, pii, sentences, textstats, wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark, d):
    return lookalikes.lookalike_pairs(table(spark, d, "raw_documents"))


@query
def p1_consistent(spark, d):
    """Consistent text (as a digest) and language of every delivery."""
    rows = lookalikes.consistent(table(spark, d, "raw_documents").select("doc_id", "text", "language"))
    return rows.select("doc_id", F.md5("text_form").alias("form_md5"), "language_form", (~F.col("text").eqNullSafe(F.col("text_form"))).alias("changed"))


@query
def p1_classes(spark, d):
    """Records that look like one of other characters, with their class; no pairs."""
    return lookalikes.lookalike_classes(table(spark, d, "raw_documents"))


@query
def p2_found(spark, d):
    rows = textstats.statistics(table(spark, d, "raw_documents").where("text <> ''"))
    return rows.where(~F.col("natural")).select("doc_id").distinct()


@query
def p2_statistics(spark, d):
    rows = textstats.statistics(table(spark, d, "raw_documents"))
    return rows.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in rows.dtypes])


@query
def p2_counts(spark, d):
    """Characters, words and lines of every record, from the same counts."""
    return textstats.statistics(table(spark, d, "raw_documents")).select("doc_id", "n_chars", "n_words", "n_lines").distinct()


_VISIBLE = r"""nfc_normalize(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b[^<>]*>.*?</script\s*>|<style\b[^<>]*>.*?</style\s*>|<!--.*?-->', E'\n\n', 'g'),
    '</?[a-zA-Z][^<>]*>', E'\n\n', 'g'), '[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g'))"""
_HAN = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"
SQL["p2_counts"] = rf"""WITH v AS (SELECT doc_id, {_VISIBLE} AS t FROM raw_documents WHERE text IS NOT NULL),
  w AS (SELECT doc_id, t, len(regexp_extract_all(t, '{_HAN}')) AS han, regexp_replace(t, '{_HAN}', '.', 'g') AS spaced FROM v)
  SELECT DISTINCT doc_id, length(regexp_replace(t, '[\p{{Z}}\p{{Cc}}]', '', 'g'))::BIGINT AS n_chars,
    (len(regexp_extract_all(spaced, '[\p{{L}}\p{{M}}\p{{N}}\p{{Cf}}]+')) + han)::BIGINT AS n_words, len(regexp_extract_all(t || E'\n', '[^\n]\n'))::BIGINT AS n_lines FROM w"""


@query
def p2_chunked(spark, d):
    """Verdicts with chunks of 256 characters, which most records exceed: the same as ``p2_found`` gives.  A trial of the chunk path, not of its cost."""
    rows = textstats.statistics(table(spark, d, "raw_documents").where("text <> ''"), chunk=256)
    return rows.select("doc_id", "n_words", "n_prose", "natural", "rule").distinct()


@query
def p3_found(spark, d):
    return containers.cut_documents(containers.assignment(table(spark, d, "tokenized_records")))


SQL["p3_found"] = "SELECT DISTINCT doc_id FROM tokenized_records WHERE len(token_ids) > 1024"


@query
def p3_assignment(spark, d):
    return containers.assignment(table(spark, d, "tokenized_records"))


@query
def p3_fill(spark, d):
    """Tokens and pieces agree with SQL; the number of containers depends on the method and is left out."""
    f = containers.fill(containers.assignment(table(spark, d, "tokenized_records")))
    return f.select("tokens", "pieces", (F.col("fullest") <= containers.CAPACITY).alias("none_overfull"), (F.col("padding_share") < 0.02).alias("well_filled"))


SQL["p3_fill"] = """SELECT sum(n)::BIGINT AS tokens, sum((n + 1023) // 1024)::BIGINT AS pieces, true AS none_overfull, true AS well_filled
  FROM (SELECT DISTINCT doc_id, token_ids, len(token_ids) AS n FROM tokenized_records WHERE len(token_ids) > 0)"""


@query
def p4_found(spark, d):
    return wrappers.boilerplate(table(spark, d, "raw_documents"), url=F.col("metadata")["url"])


@query
def p4_wrappers(spark, d):
    """Union-free expressions of all hosts."""
    return wrappers.expressions(table(spark, d, "raw_documents"), url=F.col("metadata")["url"])


@query
def p4_main_body(spark, d):
    rows = wrappers.main_body(table(spark, d, "raw_documents"), url=F.col("metadata")["url"])
    return rows.where("text is not null").select("doc_id", F.md5("body").alias("body_md5"), F.length("body").alias("body_chars")).distinct()


@query
def p7_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


# real markup only: comments, declarations, closing tags and tags whose attributes have a value or are known without one
_MARKUP = (r"""(?is)<!--.*?-->|<!DOCTYPE\b[^<>]*>|<!\[CDATA\[|<\?[a-z][^<>]*\?>|</[a-z][\w:.-]*\s*>|<[a-z][\w:.-]*(?:[\s/]+(?:[^\s<>"''=/]+\s*=\s*(?:"[^"<>]*"|''[^''<>]*''|[^\s<>"''=]+)|(?:"""
           + leakage._BARE + r""")))*[\s/]*>""")
_STREAM = rf"""regexp_extract_all(regexp_replace(lower(nfc_normalize(regexp_replace(regexp_replace(text, '{_MARKUP}', ' ', 'g'), '[\x{{ad}}\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}]', '', 'g'))),
    '([\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{9fff}}\x{{f900}}-\x{{faff}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"""
SQL["p7_found"] = f"""WITH i AS (SELECT item_id, lang, {_STREAM} AS w FROM eval_items),
  n AS (SELECT item_id, w, least(len(w), CASE WHEN lang = 'zh' THEN 24 ELSE 12 END) AS n FROM i WHERE len(w) > 0),
  r AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS run FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM n)),
  d AS (SELECT doc_id, {_STREAM} AS w FROM documents WHERE text <> ''),
  s AS (SELECT DISTINCT n FROM r),
  g AS (SELECT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS run FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n))
  SELECT DISTINCT doc_id, item_id FROM g JOIN r USING (n, run)"""


@query
def p7_regions(spark, d):
    """Near-verbatim regions with at most one edit."""
    return leakage.regions(table(spark, d, "documents"), table(spark, d, "eval_items")).groupBy("doc_id", "item_id").agg(F.max("matched_chars").alias("matched_chars"), F.max("exact").alias("exact"))


@query
def p9_found(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    models = sentences.learn(docs)
    marked = table(spark, d, "sentence_sample").select("doc_id").distinct()
    return sentences.units(docs.join(marked, "doc_id", "left_semi"), models)


@query
def p9_units(spark, d):
    """Units of all documents, by number and characters."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    rows = sentences.document_units(docs, sentences.learn(docs))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select("doc_id", F.size("starts").cast("bigint").alias("n_units"), (total("ends") - total("starts")).alias("unit_chars"))


@query
def p5_token_cubes(spark, d):
    return budget.State(spark).update(table(spark, d, "raw_documents"))


@query
def p5_cube_update(spark, d):
    """The same cube reached in two steps: first the older deliveries with all their slices, then everything."""
    raw = table(spark, d, "raw_documents")
    state = budget.State(spark)
    early = raw.agg(F.percentile_approx(F.col("ingested_at").cast("long"), 0.5)).first()[0] or 0
    state.update(raw.where(F.coalesce(F.col("ingested_at").cast("long"), F.lit(0)) <= early))
    return state.update(raw)


@query
def p5_documents(spark, d):
    """Documents of every category and in all, from the cube."""
    cube = budget.State(spark).update(table(spark, d, "raw_documents"))
    return cube.where("source_id = '*' and language = '*'").select("category", "n_docs")


SQL["p5_documents"] = """WITH l AS (SELECT DISTINCT ON (doc_id) doc_id, coalesce(nullif(lower(trim(category)), ''), 'unknown') AS category FROM raw_documents
    WHERE doc_id IS NOT NULL ORDER BY doc_id, ingested_at DESC NULLS LAST)
  SELECT coalesce(category, '*') AS category, count(*) AS n_docs FROM l GROUP BY ROLLUP (category)"""


@query
def p8_draws(spark, d):
    return mixing.draws(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[0]


@query
def p8_shares(spark, d):
    targets = table(spark, d, "mixture_targets")
    return mixing.shares(*mixing.draws(table(spark, d, "documents"), targets), targets)


@query
def p6_found(spark, d):
    return pii.mentions(table(spark, d, "raw_documents"))


@query
def p6_redacted(spark, d):
    rows = pii.redacted(table(spark, d, "raw_documents").select("doc_id", "text"))
    return rows.where("text is not null").select("doc_id", F.md5("redacted").alias("redacted_md5"), F.length("redacted").alias("redacted_chars")).distinct()
