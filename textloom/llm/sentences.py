"""Problem 9: sentence units in all languages and scripts.

What ends a sentence is learned without labels, per language, from counts over all documents:

* abbreviations: words that come with a final period far more often than without, by a log-likelihood
  ratio scaled for length, inner periods and occurrences without the period;
* sentence starters: words that follow certain sentence ends more often than chance;
* collocations: pairs around a period that belong together;
* how often a word begins with a capital away from sentence starts.

Then every mark is classified: what follows it decides unless the word before is an abbreviation, an
initial or a number, in which case starters, collocations and case statistics do.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .arrow import map_rows
from .textstats import COMMON

ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
LEAST = 3  # words and pairs seen less often teach nothing

_EDGE = re.compile(r"^[^\w]+|[^\w.\u0300-\u036f\u0900-\u0963\u064b-\u0652]+$")
_CLOSERS, _OPENING = "\"”’»)]", "\"“„«‘([¿¡'"
_ENDS = frozenset(_CLOSERS + ".!?…。।؟")
_STOPS = frozenset("!?…。।؟")
_CJK_START = re.compile(r"[。！？](?=([぀-ヿ㐀-鿿]{2}))")
# words with a capital after a word or comma and one space; the capitals are those of the Unicode data
_CAPITALS = "".join(chr(o) for o in range(0x41, 0x2000) if chr(o).isupper() and chr(o).isalpha())
_MID = re.compile(rf" (?=[{_CAPITALS}])(?<=[^\W_] |[,;] )(\S+)")
_NUMBER = re.compile(r"^[\d.,:/-]*\d[\d.,:/-]*$")
NUMBER = "#"


@lru_cache(maxsize=1 << 16)
def word_type(token: str) -> str:
    """Lower-case word without outer marks; a final period stays; numbers are one type."""
    t = _EDGE.sub("", token)
    bare = t[:-1] if t.endswith(".") else t
    if _NUMBER.match(bare):
        return NUMBER + t[len(bare):]
    return t.lower()


def likelihood(k: float, n: float, p0: float, p1: float) -> float:
    def ll(p: float) -> float:
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (n - k) * math.log(1 - p)

    return -2 * (ll(p0) - ll(p1))


def pair_likelihood(a: float, b: float, ab: float, n: float) -> float:
    """Dunning's ratio for ``b`` coming after ``a``."""
    def ll(k: float, m: float, p: float) -> float:
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (m - k) * math.log(1 - p)

    p, p1 = b / n, ab / a if a else 0.0
    p2 = (b - ab) / (n - a) if n > a else 1.0
    return -2 * (ll(ab, a, p) + ll(b - ab, n - a, p) - ll(ab, a, p1) - ll(b - ab, n - a, p2))


@dataclass
class Model:
    abbreviations: set[str] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)
    lower: set[str] = field(default_factory=set)  # seen with a small letter and never with a capital inside sentences
    ordinals: bool = False  # numbers with a period go on


def count_texts():
    """Counter over texts: (lang, kind, word, next word) -> n; kinds t type, l lower, u upper inside, p period pair, s start after a sure end,
    k capitalised word after a period that a mark parts from the rest of its token."""

    def one(langs, texts):
        by: dict[str, Counter] = defaultdict(Counter)
        pairs: Counter = Counter()
        for lang, t in zip(langs, texts):
            lang = language_of(lang, t)
            tokens = t.split()
            by[lang].update(tokens)
            period = mark = -1  # up to where tokens are taken as the word after an end
            for i in [i for i, w in enumerate(tokens) if w[-1] in _ENDS]:
                if i + 1 == len(tokens):
                    continue
                w = tokens[i].rstrip(_CLOSERS)
                nxt = tokens[i + 1].lstrip(_OPENING)
                if not w or not nxt or not (nxt[0].isalnum()):
                    continue
                if w[-1] == "." and len(w) > 1 and i > period:
                    pairs[lang, "p", w[:-1], nxt] += 1
                    period = i + 1
                elif w[-1] in _STOPS and i > mark:
                    pairs[lang, "s", "", nxt] += 1
                    mark = i + 1
            if lang in ("zh", "ja"):
                for two in _CJK_START.findall(t):
                    pairs[lang, "s", "", two] += 1
            for w in _MID.findall(t):
                pairs[lang, "u", w, ""] += 1
        out: Counter = Counter()
        for lang, c in by.items():
            for token, n in c.items():
                w = word_type(token)
                if w:
                    out[lang, "t", w, ""] += n
                    if token[:1].islower():
                        out[lang, "l", w.rstrip("."), ""] += n
        for (lang, kind, w, nxt), n in pairs.items():
            second = word_type(nxt).rstrip(".")
            if kind == "p":
                if nxt[0].isupper() and (alone := word_type(_NEXT.match(nxt).group()).rstrip(".")) != second:
                    out[lang, "k", alone, ""] += n
                out[lang, "p", word_type(w + "."), ("^" if nxt[0].isupper() else "_" if nxt[0].islower() else "") + second] += n
            elif kind == "s":
                out[lang, "s", "", second] += n
            else:
                out[lang, "u", word_type(w).rstrip("."), ""] += n
        return [(*k, n) for k, n in out.items()]

    return one


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, Model]:
    """One model a language from all texts.

    Counts of words are complete and are scored in Spark.  What is learned needs ``LEAST`` sightings, and a
    pair around a period as many, at every size of the corpus.  Only accepted entries come to the driver.
    """
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(lang).alias("g"), F.col(text).alias("t"))
    counted = map_rows(rows, count_texts, "g string, kind string, a string, b string, n bigint", whole_batch=True)
    summed = stored(counted.groupBy("g", "kind", "a", "b").agg(F.sum("n").alias("n")), "counts")
    seen = summed.where(F.col("n") >= LEAST)
    types = summed.where("kind = 't'").select("g", "a", "n")
    pairs = seen.where("kind = 'p'").select("g", "a", F.expr("left(a, length(a) - 1)").alias("bare"), "b", "n")
    period = F.col("a").endswith(".")
    small = F.col("b").startswith("_")
    # one row a language
    totals = {r.g: r for r in types.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.when(period, F.col("n")).otherwise(0)).alias("periods")).collect()}
    enders = {r[0]: r[1] for r in pairs.groupBy("g").agg(F.countDistinct("a")).collect()}
    models = {g: Model() for g in totals}

    # words that come after the periods of many different words begin sentences
    many = F.greatest(F.lit(6), 0.02 * F.col("enders"))
    per_lang = pairs.groupBy("g").agg(F.countDistinct("a").alias("enders"))
    openers = pairs.where(~small & (F.col("b") != NUMBER)).groupBy("g", "b").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(per_lang), "g").where(F.col("k") >= many).select("g", "b", F.lit(True).alias("opens"))
    after = pairs.join(openers, ["g", "b"], "left").groupBy("g", "a").agg(
        F.sum("n").alias("followed"), F.sum(F.when(small, F.col("n")).otherwise(0)).alias("small"), F.sum(F.when(F.col("b") == NUMBER, F.col("n")).otherwise(0)).alias("numbers"),
        F.sum(F.when(F.col("opens"), F.col("n")).otherwise(0)).alias("begins"), F.count(F.lit(1)).alias("kinds"),
    )
    after = stored(after, "after")
    for r in after.where(F.col("a") == NUMBER + ".").collect():  # one row a language
        models[r.g].ordinals = r.small >= max(LEAST, 0.1 * r.followed)

    dotted = types.where(period & (F.col("n") >= LEAST) & (F.col("a") != NUMBER + ".")).withColumn("bare", F.expr("left(a, length(a) - 1)"))
    bare = types.where(~period).select("g", F.col("a").alias("bare"), F.col("n").alias("without"))
    counts = ("followed", "small", "numbers", "begins", "kinds")
    candidates = dotted.join(bare, ["g", "bare"], "left").join(after, ["g", "a"], "left").select("g", "bare", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("without", *counts)])
    rates = {g: max(r.periods, 1) / max(r.n, 1) for g, r in totals.items()}

    def make_abbreviations():
        return lambda g, w, n, *k: [(g, w)] if is_abbreviation(w, n, *k, rates[g], enders.get(g, 0) >= 8) else []

    abbreviations = stored(map_rows(candidates, make_abbreviations, "g string, bare string"), "abbreviations")

    # scripts without spaces: the two characters after a full stop
    cjk = F.col("b").rlike("^[\u3040-\u30ff\u3400-\u9fff]{2}$")
    marked = seen.where("kind = 's'").select("g", "b", "n")
    sure = pairs.where((F.col("bare") != NUMBER) & (F.length("bare") >= 2) & ~small).join(abbreviations, ["g", "bare"], "left_anti")
    starts = marked.where(~cjk).unionByName(sure.select("g", F.ltrim("b", F.lit("^")).alias("b"), "n")).groupBy("g", "b").agg(F.sum("n").alias("n"))
    starts = stored(starts, "starts")
    ends_of = {r[0]: r[1] for r in starts.groupBy("g").agg(F.sum("n")).collect()}
    sums = {g: r.n for g, r in totals.items()}
    whole = types.where(~F.col("a").endswith("..")).groupBy("g", F.rtrim("a", F.lit(".")).alias("b")).agg(F.sum("n").alias("all_w"))

    def make_starters():
        return lambda g, w, n, all_w: [(g, w)] if is_starter(n, all_w, ends_of[g], sums[g]) else []

    starters = map_rows(starts.join(whole, ["g", "b"]).select("g", "b", "n", "all_w"), make_starters, "g string, a string")
    starters = starters.unionByName(openers.where(F.col("b").startswith("^")).select("g", F.expr("substring(b, 2)").alias("a"))).unionByName(marked.where(cjk).select("g", F.col("b").alias("a")))

    numbers = pairs.select("g").distinct().withColumn("bare", F.lit(NUMBER))
    first = abbreviations.unionByName(numbers)
    near = pairs.join(first, ["g", "bare"]).join(types.select("g", "a", F.col("n").alias("all_a")), ["g", "a"]).where(F.col("n") * 5 >= F.col("all_a"))
    near = near.withColumn("second", F.ltrim("b", F.lit("^_"))).join(types.select("g", F.col("a").alias("second"), F.col("n").alias("all_b")), ["g", "second"])

    def make_collocations():
        return lambda g, a, b, n, x, y: [(g, a, b)] if pair_likelihood(x, y, min(n, x, y), sums[g]) >= COLLOCATION else []

    collocations = map_rows(near.select("g", "bare", "second", "n", "all_a", "all_b"), make_collocations, "g string, a string, b string")

    # words with a small letter that never have a capital inside sentences; only those a mark or a capital precedes are asked for
    low = seen.where("kind = 'l'").select("g", "a", F.col("n").alias("low"))
    stems = types.groupBy("g", F.rtrim("a", F.lit(".")).alias("a")).agg(F.sum("n").alias("n"))
    asked = stems.join(low, ["g", "a"]).where(F.col("n") > F.col("low")).select("g", "a").unionByName(low.join(summed.where("kind = 'k'").select("g", "a"), ["g", "a"], "left_semi").select("g", "a"))
    lower = asked.join(summed.where("kind = 'u'").select("g", "a"), ["g", "a"], "left_anti")

    none = F.lit("").alias("b")
    found = abbreviations.select("g", F.lit("abbreviations").alias("what"), F.col("bare").alias("a"), none).unionByName(starters.select("g", F.lit("starters").alias("what"), "a", none))
    found = found.unionByName(lower.select("g", F.lit("lower").alias("what"), "a", none)).unionByName(collocations.select("g", F.lit("collocations").alias("what"), "a", "b"))
    for g, what, a, b in found.toLocalIterator():
        getattr(models[g], what).add((a, b) if what == "collocations" else a)
    return models


def is_abbreviation(bare: str, n: int, without: int, followed: int, small: int, numbers: int, begins: int, kinds: int, rate: float, varied: bool) -> bool:
    """``varied``: periods come after many words; else a word repeated before one period looks like an abbreviation."""
    if not any(ch.isalpha() for ch in bare) or bare.endswith("."):
        return False
    length = sum(ch != "." for ch in bare)
    score = likelihood(n, n + without, rate, 0.99) * math.exp(-length) * (1 + bare.count(".")) * max(length, 1) ** -min(without, 50)
    # words before a small letter go on, whatever their length, and so do words before numbers
    return small >= max(LEAST, 0.2 * n) or numbers >= max(LEAST, 0.5 * n) or (score >= ABBREVIATION and begins < 0.6 * max(followed, 1) and (varied or kinds >= LEAST))


def is_starter(n: int, all_w: int, ends: int, total: int) -> bool:
    return bool(all_w) and n / max(ends, 1) > all_w / max(total, 1) and n * 5 >= all_w and pair_likelihood(ends, all_w, min(n, all_w), total) >= STARTER


# --- language and blocks -----------------------------------------------------------------------------

_SCRIPTS = [("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[一-鿿]")), ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")), ("el", re.compile("[Ͱ-Ͽἀ-῿]")), ("ru", re.compile("[Ѐ-ӿ]"))]
_VIETNAMESE = re.compile("[ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]", re.I)
_SMALL_WORDS = {k: frozenset(COMMON[k]) for k in ("en", "de", "fr", "es")}


def language_of(tag: str | None, text: str) -> str:
    """The tag's language, or where it is missing the one the characters and small words point to."""
    if tag:
        return re.split("[-_]", tag.lower())[0]
    for name, pattern in _SCRIPTS:
        if len(pattern.findall(text)) * 5 >= len(text):
            return name
    if len(_VIETNAMESE.findall(text)) * 20 >= len(text):
        return "vi"
    tokens = Counter(text.lower().split())
    return max(_SMALL_WORDS, key=lambda k: sum(tokens[w] for w in _SMALL_WORDS[k]))


_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_LABEL = re.compile(r"(?m)^[^\S\n]*([^\W\d_][^\s:：]{0,14}(?: [^\s:：]{1,14})?)[:：](?=\s)")


def blocks(text: str) -> list[tuple[int, int]]:
    """Stretches between blank lines and changes of speaker."""
    cuts = {0, len(text)}
    for m in _BLANK.finditer(text):
        cuts.update((m.start(), m.end()))
    labels = list(_LABEL.finditer(text))
    names = Counter(m.group(1) for m in labels)
    if len(labels) >= 2 and len(names) <= 3 and labels[0].start() == len(text) - len(text.lstrip()):
        cuts.update(m.start() for m in labels)
    order = sorted(cuts)
    return [(a, b) for a, b in zip(order, order[1:]) if text[a:b].strip()]


# --- classifying marks -------------------------------------------------------------------------------

# what a match begins with is asked for first, which passes over all other characters at once
_END = re.compile(r"(?=[.…!?؟。！？।॥;])(?:\.{2,}|…+|[!?؟]+|[。！？।॥]+|\.|;)(?:[!?؟。！？…।.]*)")
_CLOSE = re.compile(r"(?:[^\S\n]?»|[\"”“’'»)\]」』）】〉》＂])*")
_SPAN = re.compile(r"(?=[“„«\"「『(（'‘《])(?:“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|\"[^\"]*\"|「[^「」]*」|『[^『』]*』|\([^()]*\)|（[^（）]*）|(?<!\w)'[^']*'(?!\w)|‘[^‘’]*’(?!\w)|《[^《》]*》)")
_OPENERS = "\"“„«‘(（[¿¡'「『《-–—*#•"
_NEXT = re.compile(r"[^\W_][^\s,!?…;:।॥؟\"“”«»()\[\]。！？、，]*")
_GAP = re.compile(r"[\s\"“„«‘(（\[¿¡「『]+")
_SKIP = re.compile("[" + re.escape(_OPENERS) + r"\u0020\u00a0\u202f]*")
_DASHES = re.compile(r"[-–—\u0020\u00a0\u202f]*")
_CONTENT = re.compile(r"\S")
_WIDE_STOP = set("。！？।॥؟")
_GO_ON = set(",;:，；：、–—-")


def _is_cjk(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "㐀" <= ch <= "鿿"


def sentences(text: str, lang: str | None, models: dict[str, Model]) -> list[tuple[int, int]]:
    """(start, end) of the units of one text, without white space around them."""
    lang = language_of(lang, text)
    model = models.get(lang) or Model()
    out = []
    for a, b in blocks(text):
        start = a
        for cut in ends(text, a, b, lang, model):
            out.append((start, cut))
            start = cut
        out.append((start, b))
    trimmed = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            trimmed.append((a, b))
    return trimmed


def ends(text: str, a: int, b: int, lang: str, model: Model):
    spans = [(m.start(), m.end()) for m in _SPAN.finditer(text, a, b)]
    last = a
    k = 0
    at = word_at = read = a  # the word before a mark starts at ``word_at``; ``read`` is how far that is known
    while True:
        m = _END.search(text, at, b)
        if not m:
            return
        at = m.end()
        if m.group() == ".":  # other marks do not ask for the word
            space = max(text.rfind(" ", read, m.start()), text.rfind("\n", read, m.start()))
            word_at = max(word_at, space + 1)
            for gap in _GAP.finditer(text, max(read, space + 1), m.start()):
                word_at = gap.end()
            read = m.start()
        if m.group() == ";" and lang != "el":
            continue
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        inside = k < len(spans) and spans[k][0] < m.start() < spans[k][1]
        if inside and not text[m.end(): spans[k][1] - 1].strip():
            end = spans[k][1]  # the mark is the last thing in the quotation or bracket
            outer = True
        elif inside:
            continue
        else:
            end = _CLOSE.match(text, m.end(), b).end()
            if any(s[0] < end and s[0] >= m.end() for s in spans[k: k + 1]):
                end = m.end()
            outer = False
        # a mark after the closing quotation belongs to it
        if outer and end < b and text[end] in ".。!?！？":
            continue
        at = max(at, end)
        if is_end(text, max(last, word_at), m, end, b, lang, model, outer):
            yield end
            last = end


def is_end(text: str, word_at: int, m: re.Match, end: int, stop: int, lang: str, model: Model, quoted: bool) -> bool:
    """Whether a sentence ends with the mark ``m``; the word before it starts at ``word_at``, closers go up to ``end``."""
    mark = m.group()
    follows = _CONTENT.search(text, end, stop)
    if not follows:
        return True
    gap = follows.start() - end
    head = text[follows.start()]
    if head in _GO_ON and not (head in "-–—" and _capital_after(text, follows.start(), stop)):
        return False
    b = _SKIP.match(text, follows.start(), stop).end()
    nxt = _NEXT.match(text, b, stop)
    word = nxt.group() if nxt else ""
    first = word[:1] or text[b: min(b + 1, stop)]
    two = text[b: min(b + 2, stop)]
    caseless = bool(first) and not first.isdigit() and first.lower() == first.upper()
    low = word_type(word).rstrip(".")
    dots = mark.startswith("..") or mark[0] == "…"
    if _is_cjk(first) and (quoted or dots) and not gap:
        return two in model.starters
    if mark[0] in _WIDE_STOP:
        return not quoted or low in model.starters or not caseless
    if first.islower():
        return False
    if mark != ".":
        if dots and caseless and not _is_cjk(first):
            return low in model.starters
        if quoted and caseless and not _is_cjk(first):
            return low in model.starters
        if not gap and not dots and mark[0] in "!?" and end == m.end() and not (first.isupper() or _is_cjk(first) or head in _OPENERS):
            return False
        return True
    # a single period
    prev = text[word_at: m.start()]
    if not gap and end == m.end():
        # no space: sentences run together only where a small-letter word meets a capitalised one
        return bool(first.isupper() and head == first and len(prev) > 1 and prev[-1].islower() and "." not in prev and "/" not in prev and "@" not in prev and (two[1:] != "." if len(word) == 1 else word[1:2].islower() and "." not in word)) or (_is_cjk(first) and prev[-1:].isalpha()) or (head in "“«„" and prev[-1:].islower())
    kind = word_type(prev + ".")[:-1] if prev else ""
    key = word_type(word).rstrip(".")
    if kind == NUMBER:
        if first.isdigit():
            return not model.ordinals
        if not model.ordinals:
            return True
        return key in model.starters and (kind, key) not in model.collocations
    initial = len(kind) == 1 and kind.isalpha() and (prev[-1:].isupper() or caseless)
    if kind in model.abbreviations or initial or ("." in kind and all(len(x) <= 2 for x in kind.split("."))):
        if first.isdigit() or not word:
            return False
        if (kind, key) in model.collocations:
            return False
        if key in model.starters:
            return True
        return not caseless and not initial and key in model.lower
    return True


def _capital_after(text: str, at: int, stop: int) -> bool:
    b = _DASHES.match(text, at, stop).end()
    return b < stop and text[b].isupper()


# --- operator ----------------------------------------------------------------------------------------


def document_units(df: DataFrame, models: dict[str, Model], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, starts, ends): one row for every document with units, their positions as arrays.  Repeated rows fold."""
    kind = dict(df.dtypes)[key]

    def make():
        def one(k, g, t):
            if found := sentences(t, g, models):
                yield k, *map(list, zip(*found))

        return one

    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(key).isNotNull()).select(key, lang, text)
    return map_rows(rows, make, f"{key} {kind}, starts array<int>, ends array<int>").distinct()


def units(df: DataFrame, models: dict[str, Model], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, start_pos, end_pos) of every unit.  NULL, empty and blank texts give none; repeated rows fold."""
    kind = dict(df.dtypes)[key]

    def make():
        return lambda k, g, t: [(k, a, b) for a, b in sentences(t, g, models)]

    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(key).isNotNull()).select(key, lang, text)
    return map_rows(rows, make, f"{key} {kind}, start_pos int, end_pos int").distinct()
