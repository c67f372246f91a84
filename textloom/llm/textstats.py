"""Problem 2: text statistics of every document and a verdict on whether it is natural text.

A text without its markup is cut into chunks.  A chunk is counted with ``LEFT`` characters before and
``RIGHT`` after it in sight, which settles everything that depends on neighbours: words, ends of sentences,
wrapped lines, code lines.  It gives partial counts that add up, plus the state at both ends: the stretch
before its first and after its last break, with its counts and content hash, and what closes it.  Joining two
chunks adds the counts and closes the stretch at the border, so all counts are the same wherever the text was
cut.  Chunks of one text are merged in a tree, ``FAN`` neighbours at a time; ratios and rules come last.

A *stretch* is the text between breaks: ends of sentences, blank lines, the starts of list items and
markup.  Stretches that read like a sentence or clause make a text natural; items, cells, log lines, encoded
data and symbol runs do not.  A line counts as wrapped only up to ``WIDEST`` characters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows
from .lookalikes import tables

CHUNK, WIDEST = 1 << 16, 2000
LEFT, RIGHT = WIDEST + 48, 80  # context in sight of a chunk
FAN, LEVELS = 64, 3  # 64 ** 3 chunks of 65,536 characters: more than a string can hold
BATCH = 4  # chunks counted together
REGISTERS = 64  # of the sketch that counts different stretches

# Frequent function words.
COMMON = {
    "en": "the of and to in a is that it for was on as with by at from this which be are an or not its".split(),
    "vi": "và của là các những trong được có cho với không một đã bị khi vào ra như sau trên dù mà".split(),
    "de": "der die das und ist in den von zu mit sich auf des dem ein eine nicht auch bei nach im".split(),
    "fr": "le la les de des et est un une du en que qui dans pour sur avec au ce ne pas par".split(),
    "es": "el la los las de en que un una es por con para del se no su al lo como sin".split(),
    "ru": "и в не на что с по как из к за от для это при до у же но о".split(),
    "el": "το και να τα την του με για που από σε τη των τον στο είναι οι της όλη".split(),
    "ar": "في من على أن إلى عن هذا التي مع ما هو لا قبل بعد كما كان أو دون".split(),
    "hi": "के का की है में से को और पर यह ने हैं कि तक एक नहीं करता लिए बिना".split(),
}

# Articles, prepositions and conjunctions of two letters and more that end no sentence.
OPEN_ENDS = {
    "en": "the of and to that with by from which are be or an its".split(),
    "vi": "và của các những với".split(),
    "de": "der die das und den von des dem ein eine im".split(),
    "fr": "le la les de des et un une du que dans pour sur avec au".split(),
    "es": "el la los las de en que un una por con del se al lo".split(),
    "ru": "на по из от для или".split(),
    "el": "το και να τα την του με για από σε τη των τον στο οι της".split(),
    "ar": "في من على أن إلى عن أو دون".split(),
    "hi": "के का की को और".split(),
}


SPACE, BREAK, LETTER, MARK, DIGIT, HAN, STOP, CLOSER, BULLET, DAMAGED, PUNCT, SYMBOL = range(12)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point of the first two planes, by rule from the Unicode data."""
    import unicodedata

    kind = {"L": LETTER, "M": MARK, "N": DIGIT, "P": PUNCT, "S": SYMBOL, "Z": SPACE, "C": SPACE}
    out = np.full(0x20000, SYMBOL, dtype=np.uint8)
    for o in range(0x20000):
        out[o] = MARK if unicodedata.category(chr(o)) == "Cf" else kind[unicodedata.category(chr(o))[0]]
    out[0x3040:0x3100] = HAN
    out[0x3400:0xA000] = HAN
    for chars, k in ((".!?。！？।…؟．", STOP), ("\"'”’»)]」』）＂", CLOSER), ("-•▪*–›#|◦‣", BULLET), ("�", DAMAGED), ("\n", BREAK)):
        for ch in chars:
            out[ord(ch)] = k
    out[0xE000:0xF900] = DAMAGED
    return out


@lru_cache(maxsize=2)
def _word_hashes(which: str) -> np.ndarray:
    lists = COMMON if which == "common" else OPEN_ENDS
    return np.unique(np.array([_word_hash(w) for words in lists.values() for w in words], dtype=np.uint64))


_P = 1099511628211


@lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _word_hash(word: str) -> int:
    return sum(_fold(ord(c)) * pow(_P, min(i, 63), 1 << 64) for i, c in enumerate(word)) % (1 << 64)


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Small letters, and one letter for those of one shape."""
    shapes = tables()["to_shape"]
    out = np.arange(0x20000, dtype=np.uint32)
    for o in range(0x20000):
        low = chr(o).lower()
        low = shapes.get(ord(low), low) if len(low) == 1 else chr(o)
        if len(low) == 1:
            out[o] = ord(low)
    return out


def _fold(o: int) -> int:
    return int(_fold_table()[min(o, 0x1FFFF)])


@lru_cache(maxsize=1)
def _small_table() -> np.ndarray:
    return np.array([chr(o).islower() for o in range(0x20000)], dtype=bool)


# --- cleaning and cutting ----------------------------------------------------------------------------

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_OPENS = re.compile(r"<(?:(script|style)\b[^<>]*>|!--)", re.I)
_IGNORED = re.compile("[­​-‏⁠﻿]")


def cleaned(text: str) -> str:
    """Text in composed form without ignorable characters, markup as blank lines, ending in a line break."""
    if "<" in text:
        out, at = [], 0
        closers = {k: re.compile(re.escape(k) if k == "-->" else rf"</{k}\s*>", re.I) for k in ("script", "style", "-->")}
        while m := _OPENS.search(text, at):
            kind = (m.group(1) or "-->").lower()
            end = closers[kind].search(text, m.end()) if closers[kind] else None
            if end is None:
                closers[kind] = None  # no later one is closed either
            out += [text[at: m.start()], "\n\n"] if end else [text[at: m.end()]]
            at = end.end() if end else m.end()
        text = _TAG.sub("\n\n", "".join([*out, text[at:]]))
    if not text.isascii():
        if _IGNORED.search(text):
            text = _IGNORED.sub("", text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
    return text + "\n"


def cut_text(text: str, size: int = CHUNK):
    """Ranges of at most ``size`` characters, cut after a line if one ends in the second half, else after white space.

    A token without white space is cut only where it is longer than ``size``.
    """
    size = max(size, 64)
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            found = text.rfind("\n", at + size // 2, end)
            if found < 0:
                found = next((i for i in range(end - 1, at, -1) if text[i].isspace()), -1)
            if found >= 0:
                end = found + 1
        yield at, min(end, len(text))
        at = end


# --- counting chunks -----------------------------------------------------------------------------------

FIELDS = ("chars", "words", "letters", "digits", "symbols", "han", "common", "damaged", "blanks")
NF = len(FIELDS)
COUNTS = (*(f"n_{f}" for f in FIELDS), "n_lines", "n_stop_lines", "n_code", "n_stretches", "n_stopped", "n_open", "n_prose", "prose_chars", "n_pairs")
NC = len(COUNTS)
LINES, STOP_LINES, CODE, STRETCHES, STOPPED, OPEN, PROSE, PROSE_CHARS, PAIRS = range(NF, NC)
# the stretches at both ends: counts and content hash; flags of the whole; what closes the head and how both start; the inner stretches next to them
HEAD, TAIL = NC, NC + NF + 1
WHOLE, HEAD_END, HEAD_START, TAIL_START, INNER, FIRST_PROSE, LAST_STOPPED = range(TAIL + NF + 1, TAIL + NF + 8)
SKETCH = LAST_STOPPED + 1
STATE_SIZE = SKETCH + REGISTERS
IS_STOP, IS_WIDE, IS_NUMBERED, IS_OPEN, ENDS_LINE = 1, 2, 4, 8, 16  # what closes a stretch

LEAST_WORDS, LEAST_HAN, CLAUSE_WORDS, CLAUSE_HAN, MOST_CLAUSE, LONG = 6, 9, 9, 15, 40, 30


def sentence_like(s: np.ndarray, ends: np.ndarray, starts_line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which stretches (rows of ``FIELDS``) read like running text, and which of them a sentence end closes."""
    chars, words, letters, digits, symbols, han, common, damaged, blanks = s.T
    size = np.maximum(chars, 1)
    dense = (han * 2 >= size) & (han > 0)
    # in text without spaces a full stop of the Latin script ends no sentence
    stopped = (ends & IS_STOP > 0) & (~dense | (ends & IS_WIDE > 0))
    readable = (letters + han >= 0.55 * size) & (damaged * 20 <= size) & (symbols * 5 <= size)
    spaced = readable & (digits * 4 <= size) & (words <= np.where(stopped, 120, MOST_CLAUSE)) & (letters >= 2.2 * words) & (letters <= 14 * words) & (blanks * 2 >= words - 1)
    # long sentences hold function words, and marks do not stand at every other word
    spaced &= ((words < LONG) | (common * 25 >= words)) & ((symbols < 6) | (symbols * 2 < words))
    # a line of its own needs as many words as a clause, so that questions in lists of links are none
    alone = starts_line & (ends & ENDS_LINE > 0)
    spaced &= np.where(stopped & ~alone, words >= LEAST_WORDS, words >= CLAUSE_WORDS)
    dense &= readable & (digits * 3 <= size) & np.where(stopped, han >= LEAST_HAN, han >= CLAUSE_HAN) & (han <= np.where(stopped, 400, 3 * MOST_CLAUSE)) & (blanks * 6 <= han)
    # headlines end in a year in brackets, clauses do not
    return (spaced | dense) & (stopped | (ends & IS_NUMBERED == 0)), stopped


_CODE = re.compile(r"^[^\S\n]*(?://|#include|/\*|--|(?:def|fn|func|pub|return|for|if|while|class|import|const|export|SELECT|FROM|WHERE|GROUP BY|let|var|static|int)\b)", re.M)


def _shift(x: np.ndarray, by: int, fill) -> np.ndarray:
    """``x`` seen ``by`` places later (earlier if negative)."""
    out = np.full_like(x, fill)
    if by > 0:
        out[:-by] = x[by:]
    else:
        out[-by:] = x[:by]
    return out


def partials(pieces: list[tuple[str, int, int]]) -> np.ndarray:
    """One state for every piece (text, from, to) of cleaned texts.  All pieces of a call are counted together."""
    seen = [t[max(0, a - LEFT): b + RIGHT] for t, a, b in pieces]
    joined = "\n\n".join(seen) + "\n\n"
    # what is left out of sight on the left is no line start
    size = np.array([len(t) for t in seen], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 2)[:-1]))
    start = begin + np.array([min(a, LEFT) for _, a, _ in pieces], dtype=np.int64)
    end = start + np.array([b - a for _, a, b in pieces], dtype=np.int64)
    clipped = begin[np.array([a > LEFT for _, a, _ in pieces], dtype=bool)]
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    code = np.minimum(raw, 0x1FFFF)
    n = len(code)
    k = classes()[code]
    after, second, before = _shift(k, 1, BREAK), _shift(k, 2, BREAK), _shift(k, -1, BREAK)
    before[clipped] = SPACE
    code_1, code_2, code_3, code_before = _shift(code, 1, 10), _shift(code, 2, 10), _shift(code, 3, 10), _shift(code, -1, 10)
    is_break = k == BREAK
    blank = (k == SPACE) | is_break
    wordy = (k == LETTER) | (k == MARK) | (k == DIGIT)
    word_start = wordy & ~((before == LETTER) | (before == MARK) | (before == DIGIT))
    han = k == HAN
    gap_after = (after == SPACE) | (after == BREAK)
    closed = (after == CLOSER) & ((second == SPACE) | (second == BREAK) | (second == HAN))
    wide_stop = np.isin(code, [ord(c) for c in "。！？।؟…．"])
    stop = (k == STOP) & (gap_after | closed | wide_stop)
    # lines
    at = np.flatnonzero(is_break)
    line_start = np.concatenate(([0], at[:-1] + 1))
    width = at - line_start
    known = (width <= WIDEST) & ~np.isin(line_start, clipped)
    per_line = lambda x: np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)[at])))
    # the next line begins with a bullet, a number or nothing; or the line so far is short
    numbered = (after == DIGIT) & ((code_2 == 46) | (code_2 == 41) | (code_3 == 46) | (code_3 == 41))
    hard = is_break & ((after == BREAK) | (after == BULLET) | numbered)
    wrapped = np.zeros(n, dtype=bool)
    wrapped[at] = known & (width >= 45) & (width <= 140)
    # a sentence goes on where a small letter, or in scripts without spaces another character, comes next
    # and the line is words with spaces, no row of cells
    gaps, cells, numerals, hans = per_line(k == SPACE), per_line(np.isin(code, [44, 59, 124, 9])), per_line(k == DIGIT), per_line(han)
    text_line = np.zeros(n, dtype=bool)
    text_line[at] = known & (((gaps >= 3) & (cells * 4 <= gaps) & (numerals * 8 <= width)) | (hans * 2 >= width))
    wide = np.zeros(n, dtype=bool)
    wide[at] = known & (width >= 16)
    small_after = _small_table()[code_1]
    wrapped |= is_break & text_line & (((before == LETTER) | (code_before == 44)) & small_after | ((before == HAN) & (after == HAN) & wide))
    hard |= is_break & ~wrapped
    # code lines: how they begin or the last mark in them
    last_mark = np.maximum.accumulate(np.where(blank, 0, np.arange(n)))[at]
    code_line = known & (last_mark >= line_start) & np.isin(code[last_mark], [59, 123, 125])
    if starts := [m.start() for m in _CODE.finditer(joined)]:
        code_line |= known & np.isin(line_start, starts)
    is_code = np.zeros(n, dtype=bool)
    is_code[at] = code_line
    # words
    ws = np.flatnonzero(word_start)
    is_common, last_open = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if len(ws):
        pos = np.arange(n) - np.maximum.accumulate(np.where(word_start, np.arange(n), 0))
        term = np.where(wordy, _fold_table()[code].astype(np.uint64) * _powers(64)[np.minimum(pos, 63)], np.uint64(0))
        h = np.add.reduceat(term, ws)
        for which, out in (("common", is_common), ("open", last_open)):
            keys = _word_hashes(which)
            out[ws] = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
    # stretches
    cut = hard | stop
    body = np.zeros(n + 1, dtype=np.int64)
    body[start] += 1
    np.add.at(body, end, -1)
    bounds = np.flatnonzero(cut & (np.cumsum(body[:-1]) > 0))
    # the word before a cut, if it is the last thing before it
    word_at = np.maximum.accumulate(np.where(word_start, np.arange(n), 0))[bounds]
    flags = (stop[bounds] * IS_STOP + wide_stop[bounds] * IS_WIDE + ((before[bounds] == CLOSER) & (_shift(k, -2, BREAK)[bounds] == DIGIT)) * IS_NUMBERED
             + (last_open[word_at] & wordy[np.maximum(bounds - 1, 0)]) * IS_OPEN + (is_break[bounds] | (stop[bounds] & (after[bounds] == BREAK))) * ENDS_LINE).astype(np.int64)
    per_char = (~blank, word_start, (k == LETTER) | (k == MARK), k == DIGIT, (k == SYMBOL) | (k == BULLET), han, is_common, k == DAMAGED, blank & ~cut)
    sums = np.stack([np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in per_char])
    # content hashes: characters weighted by their place among the visible ones
    visible = np.where(blank, np.uint64(0), code.astype(np.uint64) + np.uint64(7))
    inside = sums[0][:-1]
    out = np.zeros((len(pieces), STATE_SIZE), dtype=np.int64)
    out[:, :NF] = (sums[:, end] - sums[:, start]).T
    for j, x in ((LINES, is_break & (before != BREAK)), (STOP_LINES, is_break & (before == STOP)), (CODE, is_code)):
        c = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
        out[:, j] = c[end] - c[start]
    begins_line = np.concatenate(([True], is_break[:-1]))
    begins_line[clipped] = False
    # stretches of all pieces in order; the first and last of a piece go on in its neighbours
    many = np.searchsorted(bounds, end) - np.searchsorted(bounds, start) + 1
    heads = np.cumsum(many) - many
    tails = heads + many - 1
    owner = np.repeat(np.arange(len(pieces)), many)
    is_head, is_tail = np.zeros(len(owner), dtype=bool), np.zeros(len(owner), dtype=bool)
    is_head[heads], is_tail[tails] = True, True
    low, high, ends = np.zeros(len(owner), dtype=np.int64), np.zeros(len(owner), dtype=np.int64), np.zeros(len(owner), dtype=np.int64)
    low[is_head], low[~is_head] = start, bounds + 1
    high[is_tail], high[~is_tail], ends[~is_tail] = end, bounds + 1, flags
    counts = (sums[:, high] - sums[:, low]).T
    hashes = _hashes(visible, inside, low, high)
    line = begins_line[np.minimum(low, n - 1)]
    out[:, HEAD: HEAD + NF], out[:, HEAD + NF] = counts[heads], hashes[heads]
    out[:, TAIL: TAIL + NF], out[:, TAIL + NF] = counts[tails], hashes[tails]
    out[:, WHOLE], out[:, HEAD_END], out[:, HEAD_START], out[:, TAIL_START] = many == 1, ends[heads], line[heads], line[tails]
    inner = ~is_head & ~is_tail
    good, stopped = np.zeros(len(owner), dtype=bool), np.zeros(len(owner), dtype=bool)
    good[inner], stopped[inner] = sentence_like(counts[inner], ends[inner], line[inner])
    there = inner & (counts[:, 0] > 0)
    pair = np.concatenate((good[1:] & good[:-1] & stopped[:-1] & (owner[1:] == owner[:-1]), [False]))
    for j, x in ((STRETCHES, there), (STOPPED, there & stopped), (OPEN, there & stopped & (ends & IS_OPEN > 0)), (PROSE, good), (PROSE_CHARS, good * counts[:, 0]), (PAIRS, pair)):
        out[:, j] = np.bincount(owner, x, len(pieces)).astype(np.int64)
    some = many > 2
    out[some, INNER], out[some, FIRST_PROSE] = 1, good[heads[some] + 1]
    out[some, LAST_STOPPED] = good[tails[some] - 1] & stopped[tails[some] - 1]
    _sketch(out, owner[there], hashes[there])
    return out


def _hashes(visible: np.ndarray, inside: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Content hash of every stretch, as signed numbers.  ``inside`` is the place of a character among the visible ones."""
    size = high - low
    at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
    place = inside[at] - np.repeat(inside[np.minimum(low, len(inside) - 1)], size)
    terms = visible[at] * _powers(1 << int(place.max(initial=0) + 1).bit_length())[place]
    sums = np.concatenate(([np.uint64(0)], np.cumsum(terms, dtype=np.uint64)))
    ends = np.cumsum(size)
    return (sums[ends] - sums[ends - size]).view(np.int64)


def _sketch(out: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> None:
    """Add stretches to the registers of rows: the longest run of leading zeros among those of a register."""
    h = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    register = (h >> np.uint64(58)).astype(np.int64)
    rest = (h & np.uint64(0xFFFFFFFF)).astype(np.float64)
    rank = 33 - np.frexp(rest)[1].astype(np.int64)
    np.maximum.at(out, (rows, SKETCH + register), rank)


def different(row: np.ndarray) -> float:
    """About how many different stretches the registers saw."""
    r = row[SKETCH:]
    m = REGISTERS
    estimate = 0.709 * m * m / np.sum(2.0 ** -r.astype(np.float64))
    zeros = int((r == 0).sum())
    return m * float(np.log(m / zeros)) if estimate <= 2.5 * m and zeros else float(estimate)


def slices(texts: list[str], most: int = 4 * CHUNK):
    """Ranges of texts with about ``most`` characters, so that counting needs bounded memory."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


# --- merging -------------------------------------------------------------------------------------------


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts and content hash of two parts of one stretch."""
    out = a + b
    shift = pow(_P, int(a[0]), 1 << 64)
    out[NF] = np.uint64((int(a[NF]) + shift * int(b[NF])) % (1 << 64)).view(np.int64)
    return out


def _close(row: np.ndarray, part: np.ndarray, ends: int, starts_line: int) -> tuple[bool, bool]:
    """Count a stretch that is complete; gives whether it is prose and whether a sentence end closes it."""
    good, stopped = (bool(x[0]) for x in sentence_like(part[None, :NF], np.array([ends]), np.array([bool(starts_line)])))
    if part[0] > 0:
        row[STRETCHES] += 1
        row[STOPPED] += stopped
        row[OPEN] += stopped and bool(ends & IS_OPEN)
        _sketch(row[None, :], np.zeros(1, dtype=np.int64), part[NF: NF + 1])
    row[PROSE] += good
    row[PROSE_CHARS] += part[0] if good else 0
    return good, stopped


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """State of the text whose left part has state ``a`` and right part ``b``."""
    out = a.copy()
    out[:NC] += b[:NC]
    out[SKETCH:] = np.maximum(a[SKETCH:], b[SKETCH:])
    middle = _join(a[TAIL: TAIL + NF + 1], b[HEAD: HEAD + NF + 1])
    # a part that begins with the stretch takes over how it starts
    start = a[TAIL_START]
    if a[WHOLE] and b[WHOLE]:
        out[HEAD: HEAD + NF + 1] = out[TAIL: TAIL + NF + 1] = middle
    elif a[WHOLE]:
        out[HEAD: HEAD + NF + 1], out[HEAD_END], out[WHOLE] = middle, b[HEAD_END], 0
        out[TAIL: TAIL + NF + 1], out[TAIL_START] = b[TAIL: TAIL + NF + 1], b[TAIL_START]
        out[INNER], out[FIRST_PROSE], out[LAST_STOPPED] = b[INNER], b[FIRST_PROSE], b[LAST_STOPPED]
    elif b[WHOLE]:
        out[TAIL: TAIL + NF + 1] = middle
    else:
        good, stopped = _close(out, middle, int(b[HEAD_END]), int(start))
        out[PAIRS] += bool(a[INNER] and a[LAST_STOPPED] and good) + bool(b[INNER] and good and stopped and b[FIRST_PROSE])
        out[FIRST_PROSE] = a[FIRST_PROSE] if a[INNER] else good
        out[LAST_STOPPED] = b[LAST_STOPPED] if b[INNER] else good and stopped
        out[INNER] = 1
        out[TAIL: TAIL + NF + 1], out[TAIL_START] = b[TAIL: TAIL + NF + 1], b[TAIL_START]
    return out


def finish(state: np.ndarray) -> np.ndarray:
    """Counts of a whole text; its last stretch is empty, since it ends in a break."""
    out = state.copy()
    good, stopped = _close(out, state[HEAD: HEAD + NF + 1], int(state[HEAD_END]), int(state[HEAD_START]))
    out[PAIRS] += bool(good and stopped and state[INNER] and state[FIRST_PROSE])
    return out


def whole_counts(texts: list[str]) -> list[np.ndarray]:
    """Counts of whole texts."""
    clean = [cleaned(t) for t in texts]
    return [finish(s) for s in partials([(t, 0, len(t)) for t in clean])]


# --- verdict -------------------------------------------------------------------------------------------

RESULT = "n_chars bigint, n_words bigint, n_lines bigint, mean_word_len double, symbol_ratio double, digit_ratio double, stop_line_share double, common_share double, prose_share double, n_prose bigint, damaged_share double, different_share double, natural boolean, rule string"

#: Share of the characters in running text that is enough alone, and with two sentences side by side.
PROSE_SHARE, ARTICLE_SHARE = 0.6, 0.25
#: Share of different stretches, of function words, and of sentences that end in a word none ends in.
LEAST_DIFFERENT, LEAST_COMMON, MOST_OPEN = 0.35, 0.01, 0.12
LEAST_STRETCHES, SPACED_WORDS = 8, 20  # from which on these shares say something


def verdict(c: np.ndarray, category: str | None) -> tuple[bool, str]:
    """Rules over the counts of a whole text, first match decides."""
    chars, words, han, common, damaged = (int(c[COUNTS.index(f"n_{f}")]) for f in ("chars", "words", "han", "common", "damaged"))
    if chars == 0:
        return False, "empty"
    share = int(c[PROSE_CHARS]) / chars
    if damaged * 20 > chars:
        return False, "damaged"
    if c[CODE] >= 3 and c[CODE] * 3 >= c[LINES] and category in ("code", None):
        return True, "code"
    if c[STRETCHES] >= LEAST_STRETCHES and different(c) < LEAST_DIFFERENT * int(c[STRETCHES]):
        return False, "repeated"
    if words >= SPACED_WORDS and han * 4 < chars and common < LEAST_COMMON * words:
        return False, "no_function_words"
    if c[OPEN] >= 2 and c[OPEN] >= MOST_OPEN * int(c[STOPPED]):
        return False, "open_ends"
    if share >= PROSE_SHARE:
        return True, "prose"
    if c[PAIRS] and share >= ARTICLE_SHARE:
        return True, "article"
    return False, "no_prose"


def _row(c: np.ndarray, category: str | None) -> tuple:
    n = dict(zip(COUNTS, c[:NC].tolist()))
    words = n["n_words"] + n["n_han"]
    natural, rule = verdict(c, category)
    part = lambda a, b: float(a) / float(b) if b else 0.0
    return (
        n["n_chars"], words, n["n_lines"], part(n["n_letters"] + n["n_han"], words), part(n["n_symbols"], n["n_chars"]), part(n["n_digits"], n["n_chars"]), part(n["n_stop_lines"], n["n_lines"]),
        part(n["n_common"], n["n_words"]), part(n["prose_chars"], n["n_chars"]), n["n_prose"], part(n["n_damaged"], n["n_chars"]), min(1.0, part(different(c), n["n_stretches"])), natural, rule,
    )


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text", category: str = "category", chunk: int = CHUNK) -> DataFrame:
    """One row per (key, category, text) given, repeated rows folded, with statistics and verdict.

    NULL texts give no row; an empty text gets zeros, ``natural`` false and rule ``empty``.  A NULL
    category is read as unknown.  Texts above ``chunk`` characters go through chunks; the counts are the same.
    """
    types = dict(df.dtypes)
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(category).alias("c"), F.col(text).alias("t"))
    size = F.length("t")
    short, long = rows.where(size <= chunk), rows.where(size > chunk)
    out = f"{key} {types[key]}, {category} string, {RESULT}"

    def make_short():
        def one(keys, cats, texts):
            for a, b in slices(texts):
                for k, c, counts in zip(keys[a:b], cats[a:b], whole_counts(texts[a:b])):
                    yield k, c, *_row(counts, c)

        return one

    def make_chunks():
        def one(k, c, t, h):
            t = cleaned(t)
            parts = enumerate(cut_text(t, chunk))
            while some := list(islice(parts, BATCH)):
                for (n, _), state in zip(some, partials([(t, a, b) for _, (a, b) in some])):
                    yield k, c, h, n, state.tolist()

        return one

    chunks = long.select("k", "c", "t", F.xxhash64("t").alias("h")).dropDuplicates(["k", "c", "h"])
    states = map_rows(chunks, make_chunks, f"k {types[key]}, c string, h bigint, n int, s array<bigint>")
    for _ in range(LEVELS):
        neighbours = F.array_sort(F.collect_list(F.struct("n", "s")))  # at most FAN states
        grouped = states.withColumn("g", F.floor(F.col("n") / FAN).cast("int")).groupBy("k", "c", "h", "g").agg(neighbours.alias("p"))
        states = map_rows(grouped, _make_merge, f"k {types[key]}, c string, h bigint, n int, s array<bigint>")

    def make_last():
        return lambda k, c, h, n, s: [(k, c, *_row(finish(np.array(s, dtype=np.int64)), c))]

    done = map_rows(states, make_last, out)
    return map_rows(short, make_short, out, whole_batch=True).unionByName(done).distinct()


def _make_merge():
    def one(k, c, h, g, parts):
        total = None
        for p in parts:
            s = np.array(p["s"], dtype=np.int64)
            total = s if total is None else merge(total, s)
        yield k, c, h, g, total.tolist()

    return one
