"""Problem 7: evaluation passages inside corpus documents.

Texts become word streams: markup (tags and comments, not any "<" to the next ">") and ignorable characters deleted, NFC, case folded, words joined by one
space, a Han or kana character being a word.  The search then follows the q-gram lemma: a stretch of n
characters that matches a passage with at most k edits shares at least n - q + 1 - q k q-grams with it.

1. Every position of a document whose q-gram occurs in any item is marked; windows of the shortest passage
   length with fewer marks than the lemma's bound are dropped.
2. In what is left, shared q-grams are counted per item in overlapping bands of diagonals; bands below the
   item's bound are dropped.
3. The region of each remaining band is verified by an alignment inside the band with at most ``EDITS`` edits.
   ``p7_regions`` gives them all; ``p7_found`` asks last that the alignment needs no edit, so that the words are
   consecutive.

Items are the stated query set and are searched in blocks of bounded size; documents are read once a block
and never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows

Q, EDITS, BAND = 8, 1, 16
RUN, LONG_RUN, LONG_LANGS = 12, 24, ("zh",)
BLOCK_CHARS = 4_000_000  # characters of items broadcast at a time
_BITS = 22

# Markup only: declarations and tags whose attributes have a value or a name HTML knows without one.
# A "<" of a formula or a comparison begins none of these, so what stands behind it stays text.
_BARE = "allowfullscreen|alt|async|autofocus|autoplay|checked|contenteditable|controls|crossorigin|default|defer|disabled|download|draggable|hidden|inert|ismap|itemscope|loop|multiple|muted|nomodule|noshade|novalidate|nowrap|open|playsinline|readonly|required|reversed|selected"
_TAG = re.compile(
    r"<!DOCTYPE\b[^<>]*>|<!\[CDATA\[|<\?[a-z][^<>]*\?>|</[a-z][\w:.-]*\s*>"
    rf"""|<[a-z][\w:.-]*+(?:[\s/]++(?:[^\s<>"'=/]++\s*+=\s*+(?:"[^"<>]*"|'[^'<>]*'|[^\s<>"'=]+)|(?:{_BARE})(?=[\s/>])))*+[\s/]*+>""",
    re.I,
)
_IGNORABLE = re.compile("[­​-‏⁠﻿]")
_ONE = "぀-ヿ㐀-鿿豈-﫿"
_WORD = re.compile(f"[{_ONE}]|(?:(?![{_ONE}_])\\w)+")


def without_comments(text: str) -> str:
    out, at = [], 0
    while (a := text.find("<!--", at)) >= 0 and (b := text.find("-->", a + 4)) >= 0:
        out.append(text[at:a])
        at = b + 3
    return " ".join([*out, text[at:]])


def words(text: str) -> list[str]:
    if "<" in text:
        text = _TAG.sub(" ", without_comments(text))
    if text.isascii():
        return _WORD.findall(text.lower())
    text = _IGNORABLE.sub("", text)
    return _WORD.findall(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold()))


def run_length(lang: str | None, n_words: int) -> int:
    return min(LONG_RUN if lang in LONG_LANGS else RUN, n_words)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


_MULT = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(64)], dtype=np.uint64)


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide = codes.astype(np.uint64)
    h = wide[:n] * _MULT[q]
    for i in range(1, q):
        h += wide[i: i + n] * _MULT[q + i]
    return h ^ (h >> np.uint64(29))


@dataclass
class Item:
    ident: int
    text: str  # words joined by spaces, with one at both ends
    runs: list[str]  # every passage of consecutive words that counts as a leak
    shortest: int


class Index:
    """Q-grams of a block of items."""

    def __init__(self, rows: list[tuple], q: int = Q, edits: int = EDITS):
        self.q, self.edits, self.items = q, edits, []
        for ident, lang, text in rows:
            w = words(text or "")
            if not w:
                continue
            n = run_length(lang, len(w))
            runs = sorted({" " + " ".join(w[i: i + n]) + " " for i in range(len(w) - n + 1)})
            self.items.append(Item(ident, " " + " ".join(w) + " ", runs, min(map(len, runs))))
        hashes, owner, place = [], [], []
        for i, item in enumerate(self.items):
            h = qgrams(_codes(item.text), q)
            hashes.append(h)
            owner.append(np.full(len(h), i, dtype=np.int64))
            place.append(np.arange(len(h)))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, dtype=t)
        h = cat(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = h[order], cat(owner, np.int64)[order], cat(place, np.int64)[order]
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[(self.hash & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
        # items too short for the lemma are looked for as they are
        self.tiny = [it for it in self.items if self.bound(it.shortest) < 1]
        self.least = min((it.shortest for it in self.items if self.bound(it.shortest) >= 1), default=0)

    def bound(self, n: int) -> int:
        """Q-grams that n characters share with their source after at most ``edits`` edits."""
        return n - self.q + 1 - self.q * self.edits

    def search(self, idents: list, texts: list[str]):
        """(ident, item, longest alignment in characters, word for word) of every verified region."""
        streams = [" " + " ".join(words(t)) + " " for t in texts]
        if self.tiny:
            for ident, s in zip(idents, streams):
                for it in self.tiny:
                    if any(r in s for r in it.runs):
                        yield ident, it.ident, max(len(r) for r in it.runs if r in s), True
        if not self.least:
            return
        joined = "\x00".join(streams) + "\x00"
        start = np.concatenate(([0], np.cumsum([len(s) + 1 for s in streams])))
        h = qgrams(_codes(joined), self.q)
        if not len(h):
            return
        mark = self.seen[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
        # windows of the shortest passage with enough marks
        size = self.least - self.q + 1
        sums = np.concatenate(([0], np.cumsum(mark, dtype=np.int32)))
        if len(sums) <= size:
            return
        good = np.flatnonzero(sums[size:] - sums[:-size] >= self.bound(self.least))
        if not len(good):
            return
        cover = np.zeros(len(h) + 1, dtype=np.int32)
        np.add.at(cover, good, 1)
        np.add.at(cover, np.minimum(good + size, len(h)), -1)
        at = np.flatnonzero((np.cumsum(cover[:-1]) > 0) & mark)
        low, high = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        n = high - low
        pos = np.repeat(at, n)
        entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, diagonal = self.owner[entry], pos - self.place[entry]
        doc = np.searchsorted(start, pos, side="right") - 1
        need = np.array([self.bound(it.shortest) for it in self.items])
        found = set()
        for shift in (0, BAND // 2):  # overlapping bands
            band = (diagonal + shift) // BAND + (1 << 20)
            key = (doc * len(self.items) + item) * (1 << 40) + band
            kinds, back, count = np.unique(key, return_inverse=True, return_counts=True)
            first = np.full(len(kinds), np.iinfo(np.int64).max)
            last = np.zeros(len(kinds), dtype=np.int64)
            np.minimum.at(first, back, pos)
            np.maximum.at(last, back, pos)
            which = np.full(len(kinds), 0, dtype=np.int64)
            which[back] = item
            for k in np.flatnonzero(count >= need[which]):
                it = self.items[which[k]]
                d = int(np.searchsorted(start, first[k], side="right") - 1)
                a, b = max(int(start[d]), int(first[k]) - BAND), min(int(start[d + 1]) - 1, int(last[k]) + self.q + BAND)
                found.add((d, int(which[k]), a, b))
        done = set()
        for d, i, a, b in sorted(found):
            region = joined[a:b]
            length, exact = aligned(region, self.items[i], self.edits)
            if length and (d, i, length, exact) not in done:
                done.add((d, i, length, exact))
                yield idents[d], self.items[i].ident, length, exact


def aligned(region: str, item: Item, edits: int) -> tuple[int, bool]:
    """Length of the longest passage of the item that aligns with the region inside the band, or 0, and whether it does so without an edit."""
    exact = near = 0
    for r in item.runs:
        distance = banded(region, r, edits)
        if distance == 0:
            exact = max(exact, len(r))
        elif distance <= edits:
            near = max(near, len(r))
    return exact or near, exact > 0


def banded(region: str, run: str, edits: int) -> int:
    """Fewest edits with which the run occurs in the region, ``edits`` + 1 if it takes more.

    Pieces of the run, one more than there are edits, fix the diagonals: one piece must occur unchanged.
    The alignment then stays within ``edits`` of that diagonal; on the diagonal itself it is a comparison.
    """
    parts = edits + 1
    step = len(run) // parts
    best = edits + 1
    for p in range(parts):
        piece = run[p * step: (p + 1) * step if p < edits else len(run)]
        at = region.find(piece)
        while at >= 0:
            start = at - p * step
            if start >= 0 and region.startswith(run, start):
                return 0
            if best > 1:
                best = min(best, _band_distance(region, run, start, edits))
            at = region.find(piece, at + 1)
    return best


def _band_distance(region: str, run: str, start: int, edits: int) -> int:
    """Edit distance of the run to the best stretch of the region near ``start``, inside the band."""
    far = edits + 1
    row = {d: 0 for d in range(-edits, edits + 1) if 0 <= start + d <= len(region)}  # free start
    for i, ch in enumerate(run):
        new: dict[int, int] = {}
        for d in range(-edits, edits + 1):
            j = start + i + d  # character of the region under this diagonal
            cost = far
            if d in row and 0 <= j < len(region):
                cost = row[d] + (region[j] != ch)
            if d + 1 in row:
                cost = min(cost, row[d + 1] + 1)  # run character left out
            if d - 1 in new:
                cost = min(cost, new[d - 1] + 1)  # region character left out
            if cost <= edits:
                new[d] = cost
        if not new:
            return far
        row = new
    return min(row.values())


def _blocks(rows: list[tuple]):
    block, size = [], 0
    for r in rows:
        block.append(r)
        size += len(r[2] or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def regions(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS) -> DataFrame:
    """(key, item_id, matched_chars, exact): verified regions, distinct.

    NULL and empty documents and items without words match nothing; repeated items each report.  An item
    shorter than its run counts when all its words occur.
    """
    wanted = items.where(F.col("text").isNotNull()).select("item_id", "lang", "text").orderBy("item_id")
    kind = dict(docs.dtypes)[key]
    rows = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, text)
    schema = f"{key} {kind}, item_id bigint, matched_chars int, exact boolean"
    out = None
    for block in _blocks([tuple(r) for r in wanted.toLocalIterator()]):
        def make(block=block):
            index = Index(block, edits=edits)

            def one(idents, texts):
                size = 0
                a = 0
                for i, t in enumerate(texts):
                    size += len(t)
                    if size > 400_000 or i == len(texts) - 1:  # bounded memory a pass
                        yield from index.search(idents[a: i + 1], texts[a: i + 1])
                        a, size = i + 1, 0

            return one

        part = map_rows(rows, make, schema, whole_batch=True)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.distinct()


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id) of documents that hold a passage of an item word for word.

    The regions are those within ``EDITS`` edits; of them the ones whose alignment needs none are leaks.
    """
    near = regions(docs, items, key, text, edits=EDITS)
    return near.where("exact").select(key, "item_id").distinct()
