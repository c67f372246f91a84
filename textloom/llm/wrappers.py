"""Problem 4: main body of web pages, by wrappers inferred from pages of the same host.

A page is a stream of line tokens: a line's plain text with digits and host names masked, and for a bar of
links or a labelled line also its parts.  Pages of one host are aligned one after the other to a union-free
regular expression: tokens both sides share at the same place become one node, tokens that only some pages
have become optional nodes, what comes back within a page becomes a repeated group, and where both sides
differ a text slot remains.  Gaps between matched nodes are aligned again in the same way.  The support of a
token is that of its nodes on several pages: lines of equal text that meet at no place do not add up.
Pages that hold mostly the same running text are copies and are aligned once.

Every page is then read with the wrapper of its own host: nodes on several pages, at their place, are fixed
lines.  Nodes that wrappers of several hosts agree on, whole, by label or with a slot inside, form a shared
table; it is joined to the nodes of every page, so hosts seen once are read with it too.  What is left is
decided by place: the headline before the first prose line is the title, headlines after it lead elsewhere.

Hosts are aligned in parts of ``PART`` pages, and equal nodes of its parts add their support, so no host,
however large, is gathered in one task.  Hosts are counted by (host, salt) first, and hot tokens are joined
with a salt.  Nothing of the pages or templates reaches the driver.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import stored
from .arrow import map_rows
from .lookalikes import skeleton

PART, SALTS = 64, 64  # pages aligned in one task; parts of hot hosts and hot tokens
LEAST_HOSTS, LEAST_PAGES = 3, 3  # a shared template is on so many hosts, a host's own line on so many pages, at every size
RECURS, SURE, TITLE_SHARE, LABEL_TITLE_SHARE = 0.05, 0.3, 0.10, 0.03  # how often it comes back on its host, how often it stands where titles do
PROSE = "\x01"

_SCRIPT = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"<[^<>]*>")
_CONTENT = re.compile(r"[^\W_]|[\u2000-\U0010ffff]")
_LINK = re.compile(r"\[([^\[\]]*)\]\((?:[^()\s]*)\)")
_HOST = re.compile(r"\b(?:[\w-]+\.)+(?:example|test|invalid|com|org|net|edu|gov|info|io|[a-z]{2})(?:\.[a-z]{2,3})?\b", re.I)
_DIGITS = re.compile(r"\d+(?:[.,:]\d+)*")
_BULLET = re.compile(r"^(?:[-•▪*–—›»·+◦]|\d+[.)])\s+")
_SEPARATOR = re.compile(r"\s*(?:[|»·/›]|&gt;|(?<=\s)>(?=\s)|\t|(?<=\S)\s{2,}(?=\S))\s*")
_MAY_SEPARATE = re.compile(r"[|»·/›>\t]|  |&gt;")
_DIGIT = re.compile(r"\d")
_DOTTED = re.compile(r"\.\w")
_LABEL = re.compile(r"^([^\d:：]{2,24}[:：])\s*\S")
_TITLE_END = re.compile(r"(?: – |: ).*\(?\d+\)?$")
_LEADS = frozenset("›–»")
_ITEM = frozenset("-•▪*◦+")
_HEADLINE = re.compile(r"[–:：|»]|\d\)?$|\?$")
_HAN = re.compile(r"[぀-ヿ㐀-鿿]")
_STOP = re.compile(r"[.!?।؟。！？](?=[\s\"”»)<]|$)|[。！？]")
_NON_LINK = re.compile(r"(?i)^https?://([\w.-]+)")
_OWNER = re.compile(r"©\s*\d{4}\s+((?:[\w-]+\.)+[a-z]{2,})", re.I)


@dataclass
class Line:
    no: int
    text: str  # without markup and bullet
    bullet: str
    token: str
    masked: str | None  # None for scripts and styles
    prose: int  # 0 no, 1 one sentence or clause, 2 several sentences
    script: bool
    anchors: int
    heading: bool


def read_lines(text: str) -> list[Line]:
    """Lines that have content.  Scripts and styles count as content, bare markup does not."""
    out = []
    inside = ""
    for no, raw in enumerate(skeleton(text).split("\n")):
        script = False
        if inside:
            script, inside = True, "" if re.search(rf"</{inside}\s*>", raw, re.I) else inside
            plain = raw
        elif "<" in raw:
            plain = _SCRIPT.sub(" ", raw)
            script = plain != raw and not _TAG.sub("", plain).strip()
            if m := re.search(r"<(script|style)\b[^>]*>", plain, re.I):
                script, inside = True, m.group(1).lower()
            plain = raw if script else _TAG.sub(" \t " if plain.count("<a ") > 1 else " ", plain)
        else:
            plain = raw
        anchors = raw.count("<a ") + raw.count("](")
        if "](" in plain:
            plain = _LINK.sub(r"\1", plain)
        plain = plain.strip()
        if plain.startswith("#"):
            plain = plain.lstrip("#").strip()
        if not plain or not _CONTENT.search(plain):
            continue
        m = _BULLET.match(plain)
        bullet = m.group().strip() if m else ""
        body = plain[m.end():] if m else plain
        prose = 0 if script else prose_kind(body)
        heading = "<h1" in raw or raw.startswith("# ")
        if not prose and not script and (bullet in _ITEM or "<li" in raw) and is_clause(body):
            prose = 1
        masked = None if script else mask(body)
        out.append(Line(no, body, bullet, PROSE if prose == 2 else masked or "", masked, prose, script, anchors, heading))
    return out


def prose_kind(text: str) -> int:
    if not text.isascii() and len(han := _HAN.findall(text)) * 2 >= len(text):
        if _TITLE_END.search(text):
            return 0
        return 2 if len(han) >= 18 and len(_STOP.findall(text)) >= 2 else 1 if len(han) >= 13 or text[-1] in "。！" else 0
    words = text.count(" ") + 1
    if words >= 11 and len(_STOP.findall(text)) >= 2:
        return 2
    if text[-1] in ".!।" and words >= 3 and "©" not in text:
        return 1
    if _TITLE_END.search(text):
        return 0
    return 1 if words >= 9 or (words >= 7 and text[-1] in "?؟") else 0


def is_clause(text: str) -> bool:
    """List items that say something; headlines have a dash, a colon, a number or a question mark at the end or are shorter."""
    if _HEADLINE.search(text):
        return False
    return len(_HAN.findall(text)) >= 9 or text.count(" ") >= 6


def mask(text: str) -> str:
    if _DOTTED.search(text):
        text = _HOST.sub("§", text)
    return _DIGITS.sub("0", text) if _DIGIT.search(text) else text


def parts_of(text: str) -> list[str]:
    """The parts of a bar of links or a breadcrumb; one part if there is no separator."""
    if not _MAY_SEPARATE.search(text):
        return [text]
    return [p for p in _SEPARATOR.split(text) if p]


def label_form(token: str) -> str | None:
    """A label with a slot after it."""
    if ":" not in token and "：" not in token:
        return None
    label = _LABEL.match(token)
    return label.group(1) + " …" if label else None


def slot_form(token: str) -> str | None:
    """A fixed line with a slot between its first two words and its last."""
    words = token.split()
    return f"{words[0]} {words[1]} … {words[-1]}" if 4 <= len(words) <= 20 else None


def host_of(url: str | None, text: str) -> str | None:
    m = _NON_LINK.match(url or "")
    if m:
        return m.group(1).lower()
    m = _OWNER.search(text)
    return m.group(1).lower() if m else None


# --- page features -----------------------------------------------------------------------------------

SCRIPT, HEADING, ANCHORS, LEADS, ITEM, SHORT, ARROW, CLAUSE, SENTENCES = (1 << i for i in range(9))
WHOLE, PART_OF, LABEL, SLOT = range(4)
_LINE = np.dtype([("no", "<i4"), ("flags", "<u2")])
_TOKEN = np.dtype([("line", "<i4"), ("kind", "u1"), ("hash", "<i8")])


def token_hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 63)


def features(text: str) -> bytes:
    """Lines with content of a text, as flags and hashes of their tokens; what the later steps need of it."""
    lines, tokens = [], []
    for i, x in enumerate(read_lines(text)):
        flags = SCRIPT * x.script | HEADING * x.heading | ANCHORS * (x.anchors > 0) | LEADS * (x.bullet in _LEADS) | ITEM * (x.bullet in _ITEM)
        flags |= SHORT * (len(x.text) < 60) | (0, CLAUSE, SENTENCES)[x.prose]
        if not x.script:
            whole = x.masked
            tokens.append((i, WHOLE, token_hash(whole)))
            if x.prose < 2:
                if label := label_form(whole):
                    tokens.append((i, LABEL, token_hash(label)))
                bar = parts_of(whole)
                if len(bar) > 1:
                    tokens += [(i, PART_OF, token_hash(p)) for p in bar]
                    flags |= ARROW * ("»" in whole or ">" in whole)
                if slot := slot_form(whole):
                    tokens.append((i, SLOT, token_hash(slot)))
        lines.append((x.no, flags))
    made = np.array(lines, dtype=_LINE), np.array(tokens, dtype=_TOKEN)
    return len(lines).to_bytes(4, "little") + made[0].tobytes() + made[1].tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    end = 4 + n * _LINE.itemsize
    return np.frombuffer(data, _LINE, n, 4), np.frombuffer(data, _TOKEN, -1, end)


@dataclass
class Stream:
    """What the alignment sees of a page: its nodes' tokens in order, once each, and what it says about them."""

    tokens: list[int]
    prose: frozenset[int]
    slots: dict[int, int]  # token -> its form with a slot inside
    labels: set[int]
    titles: set[int]
    repeated: set[int]


def stream_of(data: bytes) -> Stream:
    lines, tokens = unpacked(data)
    flags = lines["flags"]
    seen = np.flatnonzero((flags & SCRIPT) == 0)
    first = next((k for k, i in enumerate(seen) if flags[i] & (CLAUSE | SENTENCES)), len(seen))
    title = int(seen[first - 1]) if first > 1 else -1
    prose = set()
    out: dict[int, int] = {}
    slots, labels, titles = {}, set(), set()
    whole = 0
    for line, kind, h in tokens.tolist():
        if kind == WHOLE:
            whole = h
            if flags[line] & SENTENCES:
                prose.add(h)
        if kind == SLOT:
            slots[whole] = h
            continue
        if kind == LABEL:
            labels.add(h)
        out[h] = out.get(h, 0) + 1
        if line == title:
            titles.add(h)
    return Stream(list(out), frozenset(prose), slots, labels, titles, {h for h, n in out.items() if n > 3})


def host_of(url: str | None, text: str) -> str | None:
    m = _NON_LINK.match(url or "")
    if m:
        return m.group(1).lower()
    m = _OWNER.search(text)
    return m.group(1).lower() if m else None


# --- wrappers --------------------------------------------------------------------------------------


@dataclass(slots=True)
class Node:
    token: object
    pages: int
    repeated: bool = False


@dataclass
class Wrapper:
    """Union-free expression: nodes in order; a node on fewer pages than the wrapper is optional, nodes of one page are text slots."""

    nodes: list[Node] = field(default_factory=list)
    pages: int = 0

    @classmethod
    def of(cls, tokens: list, pages: int = 1) -> Wrapper:
        """One page; stretches of up to four tokens that follow themselves are repeated groups."""
        nodes: list[Node] = []
        at = 0
        while at < len(tokens):
            for size in (1, 2, 3, 4):
                again = at + size
                while tokens[at: at + size] == tokens[again: again + size] and again + size <= len(tokens):
                    again += size
                if again > at + size:
                    nodes += [Node(t, pages, True) for t in tokens[at: at + size]]
                    at = again
                    break
            else:
                nodes.append(Node(tokens[at], pages))
                at += 1
        return cls(nodes, pages)

    def align(self, other: Wrapper) -> Wrapper:
        """Common nodes in common order stay, in the gaps between them too; what is left of each side becomes optional."""
        if not self.pages:
            return other
        mine, theirs = self.nodes, other.nodes
        out: list[Node] = []
        i = j = 0
        for a, b in [*matches([n.token for n in mine], [n.token for n in theirs]), (len(mine), len(theirs))]:
            out += mine[i:a]
            out += theirs[j:b]
            if a < len(mine):
                out.append(Node(mine[a].token, mine[a].pages + theirs[b].pages, mine[a].repeated or theirs[b].repeated))
            i, j = a + 1, b + 1
        return Wrapper(out, self.pages + other.pages)

    def generalised(self) -> Wrapper:
        """Nodes seen on one page only are text: neighbours of them join to one slot."""
        if self.pages < 2:
            return self
        out: list[Node] = []
        for n in self.nodes:
            if n.pages == 1 and out and out[-1].pages == 1:
                out[-1].repeated = True
            else:
                out.append(Node(n.token, n.pages, n.repeated))
        return Wrapper(out, self.pages)


def expression(w: Wrapper) -> str:
    """The wrapper as text: ``(x)?`` optional, ``(x)+`` repeated, ``#`` a slot of text."""
    out = []
    for n in w.generalised().nodes:
        token = "#" if n.token == PROSE or (n.pages == 1 and w.pages > 1) else n.token
        mark = ("+" if n.repeated else "") + ("?" if n.pages < w.pages else "")
        out.append(f"({token}){mark}" if mark else token)
    return "\n".join(out)


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Matches of ``common_order``, and in every gap between two of them those of the gap."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        found = common_order(a[i:k], b[j:m]) if i < k and j < m else []
        if not found:
            continue
        x, y = i, j
        for p, q in found:
            out.append((i + p, j + q))
            todo.append((x, i + p, y, j + q))
            x, y = i + p + 1, j + q + 1
        todo.append((x, k, y, m))
    return sorted(out)


def common_order(a: list, b: list) -> list[tuple[int, int]]:
    """Matches in the same order on both sides: the longest rising run over tokens that occur once on each side."""
    once_b: dict = {}
    for j, t in enumerate(b):
        once_b[t] = -1 if t in once_b else j
    seen = Counter(a)
    hits = [(i, once_b[t]) for i, t in enumerate(a) if seen[t] == 1 and once_b.get(t, -1) >= 0]
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(hits):
        p = bisect.bisect_left(tops, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(hits[k])
        k = back[k]
    return out[::-1]


def distinct_pages(streams: list[Stream]) -> list[Stream]:
    """Pages in a fixed order without those that hold mostly the running text of one before."""
    kept: list[Stream] = []
    owner: dict[int, list[int]] = {}
    for s in sorted(streams, key=lambda s: (s.tokens, sorted(s.prose))):
        shared = Counter(k for h in s.prose for k in owner.get(h, ()))
        if any(2 * n > min(len(s.prose), len(kept[k].prose)) for k, n in shared.items()):
            continue
        for h in s.prose:
            owner.setdefault(h, []).append(len(kept))
        kept.append(s)
    return kept


def host_nodes(feats: list[bytes]) -> tuple[int, list[tuple]]:
    """Distinct pages of a part and the nodes of its wrapper in order: (token, label or slot, pages, pages where it is the title, pages where it is repeated)."""
    streams = distinct_pages([stream_of(x) for x in feats])
    wrapper = Wrapper()
    titles: Counter = Counter()
    repeated: Counter = Counter()
    slot_of: dict[int, int] = {}
    labels: set[int] = set()
    for s in streams:
        wrapper = wrapper.align(Wrapper([Node(t, 1) for t in s.tokens], 1))
        titles.update(s.titles)
        repeated.update(s.repeated)
        slot_of |= s.slots
        labels |= s.labels
    best: dict[int, int] = {}
    for n in wrapper.nodes:
        best[n.token] = n.pages if n.token not in best else max(best[n.token], n.pages) if min(best[n.token], n.pages) < 2 else best[n.token] + n.pages
    out = [(t, t in labels, w, titles[t], repeated[t]) for t, w in best.items()]
    slots: dict[int, list[int]] = {}
    for t, w in best.items():
        if t in slot_of:
            s = slots.setdefault(slot_of[t], [1, 0])
            # what fills the slot must be the same on most pages of the host
            if w > 1 and w * 3 >= wrapper.pages:
                s[0] = max(s[0], w)
            s[1] += titles[t]
    out += [(h, True, w, t, 0) for h, (w, t) in slots.items()]
    return len(streams), out


# --- tables ------------------------------------------------------------------------------------------


def read_pages(df: DataFrame, key: str, text: str, url) -> DataFrame:
    """(key, text_hash, host, page, feat): one row per record with text; every text is read once."""
    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"), url.alias("u"))

    def make():
        def one(k, h, t, u):
            yield k, h, host_of(u, t), token_hash(f"{k}\n{h}"), features(t)

        return one

    return map_rows(rows, make, f"key {kind}, text_hash bigint, host string, page bigint, feat binary")


def with_parts(pages: DataFrame) -> DataFrame:
    """Pages of known hosts with ``part``: hosts of n pages are cut in parts of about ``PART`` pages.

    Sizes are joined by (host, salt), so the pages of a hot host are spread over ``SALTS`` keys.
    """
    hosted = pages.where(F.col("host").isNotNull()).withColumn("salt", F.pmod(F.col("page"), F.lit(SALTS)).cast("int"))
    cells = hosted.groupBy("host", "salt").agg(F.count(F.lit(1)).alias("c"))
    sizes = cells.join(cells.groupBy("host").agg(F.sum("c").alias("n")), "host").select("host", "salt", "n")
    return hosted.join(sizes, ["host", "salt"]).withColumn("part", F.pmod(F.shiftright("page", 8), F.ceil(F.col("n") / PART)))


def grouped_pages(pages: DataFrame) -> DataFrame:
    """(host, part, p): pages of a part together; a page without a host is a part of its own, with the host ``""``."""
    page = F.struct("key", "text_hash", "feat")
    parts = with_parts(pages).groupBy("host", "part").agg(F.collect_list(page).alias("p"))  # about PART pages
    alone = pages.where(F.col("host").isNull()).select(F.lit("").alias("host"), F.col("page").alias("part"), F.array(page).alias("p"))
    return parts.unionByName(alone)


def part_nodes(groups: DataFrame) -> DataFrame:
    """(host, part, place, pages, token, label, w, t, rep): nodes of every part's wrapper in order."""

    def make():
        def one(host, part, feats):
            n, nodes = host_nodes(feats)
            for i, x in enumerate(nodes):
                yield host, part, i, n, *x

        return one

    return map_rows(groups.select("host", "part", F.col("p.feat")), make, "host string, part bigint, place int, pages int, token bigint, label boolean, w int, t int, rep int")


def fixed_nodes(nodes: DataFrame) -> DataFrame:
    """(host, part, place, token, shared) of the nodes that are fixed lines, by the host's own wrapper or shared by hosts."""
    known = nodes.where(F.col("host") != "")
    # pages of a host, summed over its parts, once for each part
    sizes = known.where("place = 0").groupBy("host").agg(F.sum("pages").alias("n"))
    per_host = known.groupBy("host", "token").agg(F.sum("w").alias("w"), F.sum("t").alias("t"), F.sum("rep").alias("rep"), F.max("label").alias("label"))
    per_host = stored(per_host.join(sizes, "host"), "host-nodes")
    titled = lambda share: F.col("titles") <= F.when(F.col("label"), LABEL_TITLE_SHARE).otherwise(share) * F.col("seen")
    shared = per_host.groupBy("token").agg(
        F.count(F.lit(1)).alias("hosts"), F.count_if(F.col("w") > 1).alias("fixed_on"), F.sum(F.greatest(F.col("w") - 1, F.lit(0))).alias("again"),
        F.sum(F.col("n") - 1).alias("chances"), F.sum("w").alias("seen"), F.sum("t").alias("titles"), F.sum("rep").alias("rep"), F.max("label").alias("label"),
    ).where(
        (F.col("hosts") >= LEAST_HOSTS) & ((F.col("fixed_on") >= LEAST_HOSTS) | ((F.col("fixed_on") == 2) & (F.col("again") >= SURE * F.col("chances"))))
        & (F.col("again") >= RECURS * F.col("chances")) & titled(TITLE_SHARE) & (F.col("rep") * 2 <= F.col("seen"))
    ).select("token")
    own = per_host.where(
        (F.col("w") >= LEAST_PAGES) & (F.col("w") - 1 >= RECURS * (F.col("n") - 1)) & (F.col("rep") * 2 <= F.col("w")) & ~F.col("label") & (F.col("t") <= TITLE_SHARE * F.col("w"))
    ).select("host", "token", F.lit(True).alias("own"))
    # a token can be in most parts: its one row is repeated for every salt
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("shared", F.lit(True))
    marked = nodes.withColumn("salt", F.pmod(F.xxhash64("host", "part"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"], "left")
    marked = marked.join(own, ["host", "token"], "left").where("shared or own")
    return marked.select("host", "part", "place", "token", F.coalesce("shared", F.lit(False)).alias("shared"))


# --- reading pages ---------------------------------------------------------------------------------


def boilerplate_lines(data: bytes, wrapper: list[int], shared: set[int]) -> list[int]:
    """Numbers of the boilerplate lines of one page.

    ``wrapper`` has the fixed and optional nodes of the host's wrapper in order, ``shared`` those that
    several hosts have.  A token that only the host has must stand at its place.
    """
    lines, tokens = unpacked(data)
    flags = lines["flags"].tolist()
    no = lines["no"].tolist()
    n = len(flags)
    by_line: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    order = []
    for line, kind, h in tokens.tolist():
        by_line[line].append((kind, h))
        if kind != SLOT:
            order.append(h)
    known = set(shared)
    if len(wrapper) > len(shared):
        stream = list(dict.fromkeys(order))
        known.update(stream[i] for i, _ in matches(stream, wrapper))
    fixed = [bool(f & SCRIPT) or is_fixed(by_line[i], f, known) for i, f in enumerate(flags)]
    marks = {by_line[i][0][1] for i in range(n) if fixed[i] and not flags[i] & SCRIPT}
    out = [no[i] for i in range(n) if fixed[i]]
    if len(marks) < 2:
        return out  # too little of a page to read the rest by place
    prose = [i for i in range(n) if flags[i] & (CLAUSE | SENTENCES) and not fixed[i]]
    if not prose or (len(prose) == 1 and flags[prose[0]] & CLAUSE and flags[prose[0]] & SHORT):
        return no
    first, last = prose[0], prose[-1]
    # the headline right before the text, unless it stands in a block of headlines
    title = -1 if any(f & HEADING for f in flags[:first]) else next((i for i in range(first - 1, -1, -1) if not fixed[i] and not flags[i] & ANCHORS), -1)
    if title > 0 and flags[title - 1] & LEADS and not fixed[title - 1]:
        title = -1
    for i, f in enumerate(flags):
        if fixed[i] or f & (CLAUSE | SENTENCES | HEADING):
            continue
        # a headline between paragraphs leads elsewhere
        if i > last or (i < first and i != title) or (i > first and not f & ITEM):
            out.append(no[i])
    return sorted(out)


def is_fixed(tokens: list[tuple[int, int]], flags: int, known: set[int]) -> bool:
    if tokens[0][1] in known:
        return True
    if flags & SENTENCES:
        return False
    bar = [h in known for kind, h in tokens if kind == PART_OF]
    hits = sum(bar)
    if hits and (hits * 3 >= 2 * len(bar) or (bar[0] and flags & ARROW and len(bar) <= 4)):
        return True
    return any(h in known for kind, h in tokens if kind in (LABEL, SLOT))


def page_lines(df: DataFrame, key: str = "doc_id", text: str = "text", url=None) -> DataFrame:
    """(key, text_hash, lines): boilerplate line numbers of every record that has some."""
    url = F.lit(None).cast("string") if url is None else url
    kind = dict(df.dtypes)[key]
    pages = stored(read_pages(df, key, text, url), "pages")
    groups = stored(grouped_pages(pages), "groups")
    nodes = stored(part_nodes(groups), "nodes")
    fixed = fixed_nodes(nodes).groupBy("host", "part").agg(F.array_sort(F.collect_list(F.struct("place", "token", "shared"))).alias("f"))  # nodes of one part
    joined = groups.join(fixed, ["host", "part"], "left")

    def make():
        def one(keys, hashes, feats, tokens, in_all):
            wrapper = tokens or []
            shared = {t for t, s in zip(wrapper, in_all or []) if s}
            for k, h, data in zip(keys, hashes, feats):
                if lines := boilerplate_lines(data, wrapper, shared):
                    yield k, h, lines

        return one

    return map_rows(joined.select(F.col("p.key"), F.col("p.text_hash"), F.col("p.feat"), F.col("f.token"), F.col("f.shared")), make, f"{key} {kind}, text_hash bigint, lines array<int>")


def boilerplate(df: DataFrame, key: str = "doc_id", text: str = "text", url=None) -> DataFrame:
    """(key, line_no) of every boilerplate line, distinct.

    Lines are counted from 0 and lines without content never come out.  NULL and empty texts and texts
    that are no page give no rows; a page without an article gives all its lines.  Repeated rows fold.
    """
    rows = page_lines(df.where(F.col(key).isNotNull()), key, text, url)
    return rows.select(key, F.explode("lines").alias("line_no")).distinct()


def main_body(df: DataFrame, key: str = "doc_id", text: str = "text", url=None) -> DataFrame:
    """``df`` with ``body`` last: the text without its boilerplate lines, the others unchanged; NULL stays NULL.

    A column already called ``body`` is replaced.
    """
    found = page_lines(df, key, text, url).groupBy("text_hash", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key")).agg(F.min("lines").alias("lines"))

    def without(parts: Column, gone: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: parts[i]), "\n")

    extra = "boilerplate"
    while extra in df.columns:
        extra += "_"
    rows = df.withColumn(extra, F.struct(F.xxhash64(text).alias("h"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k")))
    found = found.select(F.struct(F.col("text_hash").alias("h"), F.col("key").alias("k")).alias(extra), F.col("lines").alias(extra + "lines"))
    gone = F.col(extra + "lines")
    body = F.when(gone.isNull(), F.col(text)).otherwise(let(F.split(text, "\n", -1), lambda parts: without(parts, gone)))
    joined = rows.join(found, extra, "left").withColumn(extra, body)
    others = [c for c in df.columns if c != "body"]
    return joined.select(*others, F.col(extra).alias("body"))


def expressions(df: DataFrame, key: str = "doc_id", text: str = "text", url=None) -> DataFrame:
    """(host, part, pages, expression): the wrapper of every part of every host as text, distinct pages only."""
    url = F.lit(None).cast("string") if url is None else url
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("k"), F.col(text).alias("t"), url.alias("u"))

    def read():
        def one(k, t, u):
            if host := host_of(u, t):
                yield host, token_hash(f"{k}\n{t}"), [x.token for x in read_lines(t) if not x.script]

        return one

    def make():
        def one(host, part, pages):
            wrapper = Wrapper()
            for tokens in sorted({tuple(x) for x in pages}):
                wrapper = wrapper.align(Wrapper.of(list(tokens)))
            yield host, part, wrapper.pages, expression(wrapper)

        return one

    pages = stored(map_rows(rows, read, "host string, page bigint, tokens array<string>"), "streams")
    parts = with_parts(pages).groupBy("host", "part").agg(F.collect_list("tokens").alias("p"))
    return map_rows(parts, make, "host string, part bigint, pages int, expression string")
