"""Problem 1: one consistent form for text that looks the same.

Steps, in this order:

1. compatibility normalisation of forms that look like their plain form (full and half width, ligatures,
   presentation forms, all single spaces, hyphens) and NFC; raised digits, fractions and circled forms
   stay, because they are visible;
2. deletion of ignorable characters; joiners stay inside emoji and between letters of joining scripts,
   where they change what is seen;
3. every letter with look-alikes in Latin, Cyrillic and Greek becomes the representative of its class,
   which spans a lattice: one letter per script.  A Viterbi search over the lattice of each token, scored
   with character bigrams of each script counted over all texts, a cost for changing script inside a
   token and the script of the document's unambiguous letters, picks the letters that come out.

The search sees representatives only, so two texts get the same form exactly if they look the same.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .arrow import map_rows

# Letters of one shape, as Latin, Cyrillic, Greek ("" where a script has none).
SHAPES = [
    ("A", "А", "Α"), ("B", "В", "Β"), ("C", "С", ""), ("E", "Е", "Ε"), ("H", "Н", "Η"), ("I", "І", "Ι"),
    ("J", "Ј", ""), ("K", "К", "Κ"), ("M", "М", "Μ"), ("N", "", "Ν"), ("O", "О", "Ο"), ("P", "Р", "Ρ"),
    ("S", "Ѕ", ""), ("T", "Т", "Τ"), ("X", "Х", "Χ"), ("Y", "У", "Υ"), ("Z", "", "Ζ"), ("Q", "Ԛ", ""), ("W", "Ԝ", ""),
    ("a", "а", ""), ("c", "с", ""), ("d", "ԁ", ""), ("e", "е", ""), ("h", "һ", ""), ("i", "і", ""), ("j", "ј", ""),
    ("o", "о", "ο"), ("p", "р", ""), ("q", "ԛ", ""), ("s", "ѕ", ""), ("v", "ѵ", "ν"), ("w", "ԝ", ""), ("x", "х", ""), ("y", "у", ""),
]
# Single characters drawn alike inside one script.
SAME = {"‐": "-", "‑": "-", "﹣": "-", "Ð": "Đ", "Ɖ": "Đ", "ʹ": "'", "ϲ": "c", "Ϲ": "C", "µ": "μ", "Ω": "Ω", "K": "K", "Å": "Å"}
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠎​‎‏‪-‮⁠-⁯﻿\U000e0000-\U000e0fff"
SEEN_COMPAT = ("<super>", "<sub>", "<fraction>", "<circle>", "<font>", "<square>")
LATIN, CYRILLIC, GREEK = 0, 1, 2
SWITCH_COST, PRIOR_WEIGHT = 12.0, 2.0

_EMOJI = "‼-㊙️\U0001f000-\U0001faff"
_JOINING = "؀-ࣿऀ-෿ༀ-႟ក-៿᠀-᢯"
_JOINER = re.compile(f"[‌‍]")
_KEPT_JOINER = re.compile(f"(?<=[{_EMOJI}{_JOINING}])[‌‍](?=[{_EMOJI}{_JOINING}])")
_SELECTOR = re.compile(f"(?<![{_EMOJI}#*0-9©®])[︀-️]")


def _compat(ch: str) -> str | None:
    """The plain form of a character that is drawn like it, or None."""
    d = unicodedata.decomposition(ch)
    if unicodedata.category(ch) == "Zs":
        return None if ch == " " else " "
    if not d.startswith("<") or d.startswith(SEEN_COMPAT):
        return None
    plain = unicodedata.normalize("NFKC", ch)
    return None if plain.startswith(" ") else plain


@lru_cache(maxsize=1)
def tables() -> dict:
    """Folding tables, made by rule from the Unicode data of the running Python."""
    fold: dict[int, str | None] = {}
    for o in [*range(0xA0, 0x3400), *range(0xF900, 0x10000)]:
        plain = _compat(chr(o))
        if plain is not None:
            fold[o] = plain
    fold.update({ord(k): v for k, v in SAME.items()})
    for o in re.findall(f"[{IGNORABLE}]", "".join(map(chr, [*range(0xA0, 0xD800), *range(0xE000, 0x10000), *range(0xE0000, 0xE1000)]))):
        fold[ord(o)] = None
    shape: dict[str, tuple[str, int]] = {}  # letter -> representative, script
    for latin, cyrillic, greek in SHAPES:
        for script, letter in ((CYRILLIC, cyrillic), (GREEK, greek)):
            if letter:
                shape[letter] = (latin, script)
    nfc = lambda s: unicodedata.normalize("NFC", s)
    for o in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        d = unicodedata.normalize("NFD", chr(o))
        if len(d) > 1 and d[0] in shape:
            shape[chr(o)] = (nfc(shape[d[0]][0] + d[1:]), shape[d[0]][1])
    to_shape = {ord(k): v[0] for k, v in shape.items()}
    back: dict[str, dict[int, str]] = {}
    for letter, (rep, script) in sorted(shape.items()):
        back.setdefault(rep, {LATIN: rep}).setdefault(script, letter)
    return {"fold": fold, "to_shape": to_shape, "back": back}


def letter_script(ch: str) -> int:
    o = ord(ch)
    if 0x400 <= o < 0x530:
        return CYRILLIC
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return GREEK
    return LATIN if ch.isalpha() and (o < 0x250 or 0x1E00 <= o < 0x1F00) else -1


_AMBIGUOUS = "".join(sorted({s[0] for s in SHAPES}))
# letters and marks that folding leaves as they are; texts of these alone are not translated
_UNFOLDED = re.compile("[^\x00-\x7f\xa1-\xac\xae-\xb4\xb6-\xcf\xd1-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u01a0-\u01b0\u0300-\u034e\u0388-\u03ce\u0400-\u052f\u0600-\u061b\u061d-\u06ff\u0900-\u097f\u1ea0-\u1ef9\u2013-\u2016\u2018-\u2023\u203a\u20ac\u2190-\u21ff\u2200-\u222b\u2264\u2265\u25a0-\u25ff\u3001-\u3020\u3041-\u3096\u3099\u309a\u30a1-\u30fe\u4e00-\u9fff\U0001f300-\U0001faff]")
_CLEAR_LATIN = re.compile(f"(?![{_AMBIGUOUS}])[A-Za-z]")
_OTHER = re.compile("[Ͱ-ϿЀ-ԯἀ-῿]")
_TOKEN = re.compile("[A-Za-zÀ-ɏ̀-ϿЀ-ԯḀ-῿]+")


def skeleton(text: str) -> str:
    """Folded text in which every look-alike letter is its class representative."""
    if text.isascii():
        return text
    t = tables()
    if _JOINER.search(text):
        kept = {m.start() for m in _KEPT_JOINER.finditer(text)}
        text = _JOINER.sub(lambda m: m.group() if m.start() in kept else "", text)
    if _UNFOLDED.search(text):
        text = _SELECTOR.sub("", text.translate(t["fold"]))
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    if _OTHER.search(text):
        text = text.translate(t["to_shape"])
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    return text


class Resolver:
    """Viterbi search over look-alike lattices.  ``model`` maps (script, a, b) to a bigram log probability."""

    def __init__(self, model: dict[int, dict[str, float]] | None = None):
        self.model = model or {}
        self.floor = {s: min(m.values(), default=0.0) - 1.0 for s, m in self.model.items()}
        self.cache: dict[tuple[str, int], str] = {}

    def form(self, text: str) -> str:
        """The text with every token replaced by the best path through its lattice.

        The lattice of a letter is the same whichever of its look-alikes was written, so texts that look
        the same get one form, and letters of different looks share no lattice.  A token of letters that only
        Latin has, in a text without other scripts, has one path and is not searched.
        """
        sk = skeleton(text)
        other = _OTHER.findall(sk)
        if not other and _CLEAR_LATIN.search(sk):
            return sk  # nothing but Latin can be meant
        greek = sum(1 for c in other if ord(c) < 0x400 or ord(c) >= 0x1F00)
        latin = len(_CLEAR_LATIN.findall(sk))
        counts = (latin, len(other) - greek, greek)
        main = max(range(3), key=lambda s: (counts[s], -s))
        cache = self.cache

        def resolved(m: re.Match) -> str:
            key = (m.group(), main)
            out = cache.get(key)
            if out is None:
                if len(cache) > 200_000:
                    cache.clear()
                out = cache[key] = self.search(*key)
            return out

        return _TOKEN.sub(resolved, sk)

    def search(self, token: str, main: int) -> str:
        back = tables()["back"]
        best: dict[tuple[int, str], tuple[float, str]] = {}
        for i, ch in enumerate(token):
            forms = back.get(ch)
            if forms is None:
                script = letter_script(ch)
                forms = {script: ch} if script >= 0 else {s: ch for s in range(3)}
            step: dict[tuple[int, str], tuple[float, str]] = {}
            for script, letter in forms.items():
                if i == 0:
                    start = self.score(script, "^", letter) + (PRIOR_WEIGHT if script == main else 0.0)
                    step[script, letter] = (start, letter)
                    continue
                step[script, letter] = max(
                    (s + self.score(script, last, letter) - (SWITCH_COST if before != script else 0.0) + (PRIOR_WEIGHT if script == main else 0.0), path + letter)
                    for (before, last), (s, path) in best.items()
                )
            best = step
        return max(best.values(), key=lambda x: (x[0], [-ord(c) for c in x[1]]))[1] if best else token

    def score(self, script: int, a: str, b: str) -> float:
        return self.model.get(script, {}).get(a + b, self.floor.get(script, 0.0))


# --- bigram counts over all texts ------------------------------------------------------------------

_IDS = 1024  # letters of the three scripts


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, list[str]]:
    letters = [chr(o) for o in [*range(0x41, 0x250), *range(0x370, 0x530)] if letter_script(chr(o)) >= 0 and chr(o).isalpha()]
    ids = np.zeros(65536, dtype=np.int32)
    for i, ch in enumerate(letters[: _IDS - 1], 1):
        ids[ord(ch)] = i
    return ids, ["^", *letters[: _IDS - 1]]


def _count_bigrams():
    ids, _ = _alphabet()
    total = np.zeros(_IDS * _IDS, dtype=np.int64)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            joined = "\n".join(v for v in batch.column(0).to_pylist() if v)
            # parts of bounded size, so one long text cannot need much memory
            for at in range(0, len(joined), 1 << 20):
                units = np.frombuffer(joined[max(0, at - 1): at + (1 << 20)].encode("utf-16-le", "surrogatepass"), dtype="<u2")
                k = ids[units]
                pairs = k[:-1] * _IDS + k[1:]
                np.add(total, np.bincount(pairs, minlength=_IDS * _IDS), out=total)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at // _IDS, pa.int32()), pa.array(at % _IDS, pa.int32()), pa.array(total[at], pa.int64())], names=["a", "b", "n"])

    return run


def bigram_model(df: DataFrame, text: str = "text") -> dict[int, dict[str, float]]:
    """Log probabilities of letter pairs inside each script, from all texts.

    What reaches the driver is bounded by the alphabets (at most ``_IDS`` squared counts), not by the data.
    """
    _, names = _alphabet()
    counted = df.where(F.col(text).isNotNull()).select(text).mapInArrow(lambda b: _count_bigrams()(b), "a int, b int, n bigint")
    pairs = counted.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    sums: dict[tuple[int, str], int] = {}
    counts: dict[tuple[int, str], int] = {}
    for a, b, n in pairs:
        if b == 0:
            continue
        script = letter_script(names[b])
        if a and letter_script(names[a]) != script:
            continue
        counts[script, names[a] + names[b]] = n
        sums[script, names[a]] = sums.get((script, names[a]), 0) + n
    model: dict[int, dict[str, float]] = {LATIN: {}, CYRILLIC: {}, GREEK: {}}
    for (script, pair), n in counts.items():
        model[script][pair] = math.log((n + 0.1) / (sums[script, pair[0]] + 0.1 * _IDS))
    return model


# --- operators -------------------------------------------------------------------------------------


def consistent(df: DataFrame, text: str = "text", language: str = "language", model: dict | None = None) -> DataFrame:
    """All columns of ``df`` with ``text_form`` and ``language_form`` added.

    NULL stays NULL and an empty text stays empty; other columns pass through untouched, but columns
    already called like the two new ones are replaced.  Repeated rows stay repeated; the form depends on the text alone and the
    counts over all texts, so ties and row order do not matter.
    """
    model = bigram_model(df, text) if model is None else model

    @F.pandas_udf("text_form string, language_form string")
    def forms(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:


        r = Resolver(model)
        one = lambda v: None if v is None else r.form(v)
        for t, lang in batches:
            yield pd.DataFrame({"text_form": t.map(one, na_action="ignore"), "language_form": lang.map(one, na_action="ignore")})

    made = "forms"
    while made in df.columns:
        made += "_"
    others = [c for c in df.columns if c not in ("text_form", "language_form")]
    return df.withColumn(made, forms(text, language)).select(*others, f"{made}.text_form", f"{made}.language_form")


def _digest(*parts: str | None) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(b"\x00" if p is None else b"\x01" + p.encode("utf-8", "surrogatepass"))
        h.update(b"\x02")
    return h.digest()


def form_keys(df: DataFrame, key: str = "doc_id", text: str = "text", language: str = "language", model: dict | None = None) -> DataFrame:
    """(key, form, raw): 16-byte digests of the consistent form and of the fields as delivered, distinct."""
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(key).isNotNull()).select(key, text, language)
    model = bigram_model(rows, text) if model is None else model

    def make():
        r = Resolver(model)

        def one(ident, t, lang):
            yield ident, _digest(r.form(t), None if lang is None else r.form(lang)), _digest(t, lang)

        return one

    kind = dict(df.dtypes)[key]
    return map_rows(rows, make, f"{key} {kind}, form binary, raw binary").distinct()


GROUP = 4096  # records of a form that one task pairs with the others


def mixed_forms(keys: DataFrame) -> DataFrame:
    """(form, n, n_spellings) of the forms that stand for more than one spelling; ``keys`` is of ``form_keys``."""
    per_raw = keys.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"))
    return per_raw.groupBy("form").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_spellings")).where("n_spellings > 1")


def lookalike_classes(df: DataFrame, key: str = "doc_id", text: str = "text", language: str = "language") -> DataFrame:
    """(key, class_id, n_spellings, n_others): one row per record that looks like one of other characters.

    ``class_id`` is the lowest key of the class, ``n_others`` the number of its records that are spelled
    otherwise.  Groups of any size come out in proportion to their records, never as pairs.
    """
    keys = stored(form_keys(df, key, text, language), "forms")
    per_raw = keys.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("same"), F.min(key).alias("first"))
    per_form = per_raw.groupBy("form").agg(F.sum("same").alias("n"), F.count(F.lit(1)).alias("n_spellings"), F.min("first").alias("class_id")).where("n_spellings > 1")
    known = per_raw.join(per_form, "form").select("form", "raw", "class_id", "n_spellings", (F.col("n") - F.col("same")).alias("n_others"))
    # rows of one spelling are joined with a salt, so a hot text is spread
    salt = F.pmod(F.xxhash64(key), F.lit(64)).cast("int")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return keys.withColumn("salt", salt).join(salted, ["form", "raw", "salt"]).select(key, "class_id", "n_spellings", "n_others").distinct()


def lookalike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", language: str = "language") -> DataFrame:
    """Pairs (a < b) of records that look the same and differ in characters.

    Groups in which nothing differs, however large, never reach the join; rows with the same characters
    are not paired with each other.  A form of n records is split over n / ``GROUP`` tasks.
    """
    keys = stored(form_keys(df, key, text, language), "forms")  # feeds three branches
    rows = keys.join(mixed_forms(keys), "form").withColumn("parts", F.ceil(F.col("n") / GROUP).cast("int"))
    a = rows.select("form", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"), F.col(key).alias(f"{key}_a"), F.col("raw").alias("raw_a"))
    b = rows.select("form", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col(key).alias(f"{key}_b"), F.col("raw").alias("raw_b"))
    pairs = a.join(b, ["form", "part"]).where((F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col("raw_a") != F.col("raw_b")))
    return pairs.select(f"{key}_a", f"{key}_b").distinct()
