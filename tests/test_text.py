"""Cleaning, filters and scores against plain Python on strings the tables do not hold."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions.text import canonical_name, nfc, py_strip, shingles, words
from textloom.operators import cleaning, filters, hashing, tokenization

STRINGS = [
    None, "", " ", "é lone ́", "a b　c\x85d\x1ce", "  edge ", "١٢٣.١.٢.٣ call 555-123-4567",
    "éa@b.co and x@y.zz.", "ends. ", "İstanbul \U0001f600 emoji", "bad � mark", "nul\x00here", "<p>Hi <b>x</b></p>​\n\n\n\n\nEnd.",
    "one two three", "one two three four", "one two three four five", "a b c d e a b c d e", "word " * 9, "word " * 50, "<script>x</script>", "ghp_" + "a" * 36 + " sk-" + "b" * 40,
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(STRINGS)), "id int, text string")


def values(df, expr):
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


def test_words_and_strip(rows):
    assert values(rows, words("text")) == [None if s is None else s.split() for s in STRINGS]
    assert values(rows, py_strip("text")) == [None if s is None else s.strip() for s in STRINGS]


def test_nfc(rows):
    assert values(rows, nfc("text")) == [None if s is None else unicodedata.normalize("NFC", s) for s in STRINGS]


def test_clean(rows):
    def plain(s):
        s = re.sub("[​‌‍﻿]", "", s)
        return re.sub(r"\n{4,}", "\n\n\n", re.sub(r"<[^>]+>", " ", s)).strip()

    assert values(rows, cleaning.clean("text")) == [None if s is None else plain(s) for s in STRINGS]


def test_normalize_stats(rows):
    got = values(rows, cleaning.normalize_stats("text"))
    for s, g in zip(STRINGS, got):
        if s is not None:
            n = unicodedata.normalize("NFC", s)
            assert (g.normalized_len, g.changed, g.replacement_chars, g.nul_chars) == (len(n), n != s, n.count("�"), n.count("\x00"))


def test_pii_matches_python(rows):
    got = values(rows, filters.pii_counts("text"))
    for s, g in zip(STRINGS, got):
        if s is not None:
            for kind, pattern in filters.PII.items():
                assert g[kind] == len(re.findall(pattern.replace("(?U)", ""), s)), (kind, s)

    def redact(s):
        for kind, pattern in filters.PII.items():
            s = re.sub(pattern.replace("(?U)", ""), filters.MARK[kind], s)
        return s

    assert values(rows, filters.pii_redact("text")) == [None if s is None else redact(s) for s in STRINGS]


def test_safety(rows):
    got = dict(zip(STRINGS, values(rows, filters.violations("text"))))
    assert got["<script>x</script>"] == ["malicious_pattern:<script>"] and got[" "] == ["empty_document"] and got["one two three"] == []


def score(text):
    w = text.split()
    n = len(w)
    struct = 0.2 if n < 10 else 1.0 if 50 <= n <= 2000 else 0.7
    spam = min(1.0, max(0.0, 1.5 * (1 - len(set(w)) / max(n, 1))))
    quality = (0.9 if re.search(r"[.!?]\s*$", text) else 0.6) - (0.5 if "�" in text else 0)
    edu = 0.9 if 4 <= len(text) / max(n, 1) <= 10 else 0.5
    return 0.2 + 0.3 * quality + 0.2 * struct + 0.3 * edu - 0.4 * spam


def test_quality(rows):
    for s, g in zip(STRINGS, values(rows, filters.quality_score("text"))):
        assert (g is None) if s is None else abs(g - score(s)) < 1e-9, s


def test_shingles(rows):
    def plain(s):
        w = s.split()
        return {" ".join(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else set(w)

    got = values(rows, shingles("text"))
    assert [None if g is None else set(g) for g in got] == [None if s is None else plain(s) for s in STRINGS]


def test_hashes(spark):
    assert hashing.canonical_hash({"b": 1, "a": (1, 2.5)}) == hashing.canonical_hash({"a": [1, 2.5], "b": 1})
    shards = [{"shard_name": f"s{i}", "num_tokens": i, "sha256": "x"} for i in range(3)]
    m = {"dataset_version": "v", "sequence_length": 4, "total_tokens": 3}
    assert hashing.dataset_hash({**m, "shards": shards}) == hashing.dataset_hash({**m, "shards": shards[::-1]})
    assert hashing.dataset_hash({**m, "shards": shards}) != hashing.dataset_hash({**m, "shards": shards[:2]})


def test_canonical_values(tmp_path):
    """Floats are numbers rounded to eight significant digits; everything JSON does not know is text."""
    assert hashing.canonical({"b": (1, 0.1 + 0.2), "a": 1 / 3, "c": None, "d": True}) == {"a": 0.33333333, "b": [1, 0.3], "c": None, "d": True}
    assert hashing.canonical_hash({"x": 0.1 + 0.2}) == hashing.canonical_hash({"x": 0.3}) != hashing.canonical_hash({"x": "0.3"})
    assert hashing.canonical_hash({"lr": 3e-4, "n": 2.0}) == hashlib.sha256(b'{"lr":0.0003,"n":2.0}').hexdigest()
    path = tmp_path / "t.json"
    path.write_text('{"model": {"p": 0.1000000001, "v": ["é"]}}')
    assert tokenization.tokenizer_hash(str(path)) == hashlib.sha256(b'{"model":{"p":0.1,"v":["\\u00e9"]}}').hexdigest()
    frozen = tokenization.freeze(str(path), "v1")
    tokenization.guard(str(path), frozen["tokenizer_hash"], frozen["status"])
    for expected, status in (("0" * 64, "FROZEN"), (frozen["tokenizer_hash"], "TRAINED")):
        with pytest.raises(ValueError):
            tokenization.guard(str(path), expected, status)


def test_names(spark):
    df = spark.createDataFrame([("Falmor_Web_V1",), (" falmor-web-v1​",), ("falmor.web.v1",), (None,)], "s string")
    assert [r[0] for r in df.select(canonical_name("s")).collect()] == ["falmor_web_v1"] * 3 + [None]
    assert df.where(F.col("s").isNull()).count() == 1
