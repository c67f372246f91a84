"""Safety, personal-data and quality predicates and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col, let, words

# Patterns and weights that decide the result.
BLOCKED = ["<script>", "javascript:void(0)", "data:text/html", "eval(compile("]
PII = {
    "email": r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "ipv4": r"(?U)\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "phone": r"(?U)\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b",
    "api_key": r"(?U)\b(?:ghp_[A-Za-z0-9]{36}|AKIA[0-9A-Z]{16}|sk-[a-zA-Z0-9]{32,})\b",
}
MARK = {"email": "[EMAIL]", "ipv4": "[IP_ADDR]", "phone": "[PHONE]", "api_key": "[SECRET_KEY]"}
WEIGHTS = {"lang": 0.2, "quality": 0.3, "struct": 0.2, "edu": 0.3, "spam": 0.4}
QUALITY_CUT = 0.4


def violations(text: str | Column) -> Column:
    """Names of the blocked patterns found, and ``empty_document`` for blank text."""
    def named(c: Column, lowered: Column) -> Column:
        found = [F.when(lowered.contains(p), F.lit(f"malicious_pattern:{p}")) for p in BLOCKED]
        blank = F.when(~c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit("empty_document"))
        return F.filter(F.array(*found, blank), lambda v: v.isNotNull())

    return let(col(text), lambda c: let(F.lower(c), lambda low: named(c, low)))


def is_safe(text: str | Column) -> Column:
    return F.size(violations(text)) == 0


def pii_counts(text: str | Column) -> Column:
    """Counts on the unchanged text; a stretch may count under several kinds."""
    return F.struct(*[F.regexp_count(col(text), F.lit(p)).cast("bigint").alias(k) for k, p in PII.items()])


def pii_redact(text: str | Column) -> Column:
    """Replace kind after kind, so later kinds see the marks of earlier ones."""
    c = col(text)
    for kind, pattern in PII.items():
        c = F.regexp_replace(c, F.lit(pattern), F.lit(MARK[kind]))
    return c


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _terms(c: Column, w: Column) -> dict[str, Column]:
    n, distinct = F.size(w), F.size(F.array_distinct(w))
    safe_n = F.greatest(n, F.lit(1))
    density = F.length(c) / safe_n
    ended = F.when(c.rlike(r"(?U)[.!?][\s\x1c-\x1f]*$"), 0.9).otherwise(0.6)
    return {
        "n_words": n.cast("bigint"),
        "q_lang": F.lit(1.0),
        "q_struct": F.when(n < 10, 0.2).when((n >= 50) & (n <= 2000), 1.0).otherwise(0.7),
        "q_spam": _unit(1.5 * (1.0 - distinct / safe_n)),
        "q_quality": ended - F.when(c.contains("\ufffd"), 0.5).otherwise(0.0),
        "q_edu": F.when(density.between(4.0, 10.0), 0.9).otherwise(0.5),
    }


def quality_terms(text: str | Column) -> Column:
    """Word count and the terms of the score as one struct."""
    return let(col(text), lambda c: let(words(c), lambda w: F.struct(*[v.alias(k) for k, v in _terms(c, w).items()])))


def quality_score(text: str | Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted, unrounded score; NULL for NULL.  Weights default to the fixed values above."""
    g = {**WEIGHTS, **(weights or {})}

    def score(c: Column, w: Column) -> Column:
        t = _terms(c, w)
        total = (
            g["lang"] * t["q_lang"] + g["quality"] * t["q_quality"] + g["struct"] * t["q_struct"]
            + g["edu"] * t["q_edu"] - g["spam"] * t["q_spam"]
        )
        return F.when(c.isNotNull(), total)

    return let(col(text), lambda c: let(words(c), lambda w: score(c, w)))
