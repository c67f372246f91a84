"""Problem 6: personal data in free text, found span by span and replaced by placeholders.

High-recall generators propose overlapping spans of each kind on a folded copy of the text (forms that
look alike become one, positions are kept).  Every span gets a vector of format and context features and
a probability from boosted trees; spans at or above their kind's calibrated threshold compete for the
text, the most probable first.

The trees are trained on the labelled lines of ``pii_examples`` (a fixed number), one part of which is
held out to calibrate the thresholds.  They are the same for every corpus, so nothing grows with the data.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, pii_examples
from .arrow import map_rows
from .lookalikes import tables
from .textstats import slices

KINDS = ("email", "phone", "id_number", "address", "name")
MARKS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
SLICE_CHARS = 500_000  # texts scored together

# --- folding with positions -------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _single() -> dict[int, str]:
    """One-to-one folding: full-width forms, spaces, digits of all scripts and look-alike letters."""
    out = {o: v for o, v in tables()["fold"].items() if v is not None and len(v) == 1}
    out.update({o: v for o, v in tables()["to_shape"].items() if len(v) == 1})
    for o in range(0x100, 0x1E960):
        if unicodedata.category(chr(o)) == "Nd":
            out[o] = str(unicodedata.digit(chr(o)))
    return out


# what folding changes one to one: all but letters of Latin, Vietnamese and the larger scripts' own letters and marks
_FOLDED = re.compile("[\u00a0\u0370-\u0588\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u2000-\u200a\u2010\u2011\u202f\u205f\u3000\uff01-\uff5e]")
_MOVES = re.compile("[­͏​-‏‪-‮⁠-⁯﻿ﬀ-ﬆ̀-ͯ]")


def fold(text: str) -> tuple[str, list[int] | None]:
    """Folded text and, where positions moved, the position of each of its characters in the original."""
    if text.isascii():
        return text, None
    if not _MOVES.search(text):
        return (text.translate(_single()) if _FOLDED.search(text) else text), None
    single, multi = _single(), tables()["fold"]
    out: list[str] = []
    at: list[int] = []

    def plain(a: int, b: int) -> None:
        out.extend(text[a:b].translate(single))
        at.extend(range(a, b))

    last = 0
    for m in _MOVES.finditer(text):
        i = m.start()
        plain(last, i)
        last = i + 1
        ch = m.group()
        if unicodedata.combining(ch) and out:
            joined = unicodedata.normalize("NFC", out[-1] + ch)
            if len(joined) == 1:
                out[-1] = joined
            else:
                out.append(ch)
                at.append(i)
            continue
        for c in multi.get(ord(ch), ch) or "":
            out.append(c)
            at.append(i)
    plain(last, len(text))
    return "".join(out), at


# --- generators -------------------------------------------------------------------------------------

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9](?:[\w.+'’%-]*[A-Za-z0-9_])?"
_DOT = r"(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\bDOT\b)\s?|\.)"
_AT = r"(?:@|\s?(?:\[at\]|\(at\)|\{at\})\s?|\sAT\s)"
EMAIL = re.compile(rf"(?<![\w.+'’-])(?:{_LOCAL})(?:\s?(?:\[dot\]|\(dot\)|DOT)\s?{_LOCAL})*{_AT}{_LABEL}(?:{_DOT}{_LABEL})+")
_AT_HINT = re.compile(r"@|[\[({]at[\])}]|\sAT\s")

PHONE = re.compile(r"(?=[(+\d])(?<![\w@#.:/-])(?<!\d[ ])(?:\(\+\d{1,3}\)|\+\d{1,3}|\(\d{2,5}\)|00\d{2}|\d)(?:[ \n]?\(\d{1,4}\))?(?:[ .\-/\n]?\d){5,13}(?![\w@])")
NUMBER_ID = re.compile(r"(?=\d)(?<![\w@#./-])(?<!\d[ ])\d(?:[ \n.-]?\d){7,14}(?:[ -]?[A-Z])?(?![\w@])")
LETTER_ID = re.compile(r"(?<![\w@#./-])(?:[A-Z]{1,3}-?\d{6,9}[A-Z]?|[A-Z]\d[ \n]\d{6}|[A-Z]-\d{6,8}-[A-Z]|[A-Za-z]{2}(?:[ \n]?\d){6}[ \n]?[A-Da-d])(?![\w-])")

# capitals of the Latin script, Vietnamese included, by rule from the Unicode data
_UP = "A-ZÀ-ÖØ-Þ" + "".join(chr(o) for o in [*range(0x100, 0x250), *range(0x1E00, 0x1F00)] if chr(o).isupper())
_CAP = rf"(?:Mc|Mac|O['’]|d['’]|D['’])?[{_UP}][\w'’]*\w"
_WAY = r"(?:Street|St\.|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.|Close|Court|Ct\.|Way|Place|Square|Hill|Boulevard|Blvd\.?|Terrace|Crescent|Row|Walk|Gardens|Grove)"
_FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|No\.)[ \n]\d+[A-Za-z]?"
_WAY_FR, _WAY_ES = r"(?:rue|avenue|boulevard|bd|place|allée|chemin|impasse|quai|route|cours)", r"(?:(?:Avda\.|Av\.|Avenida|Calle|Plaza|Pza\.|Paseo|Camino|Ronda)|C/)"
_END_DE, _WAY_DE = r"(?:straße|strasse|weg|platz|allee|gasse|ring|ufer|damm|steig)", r"(?:Str\.|Straße|Weg|Platz|Allee|Gasse|Ring)"
ADDRESS = [  # strings one of which every match holds, what every match holds, pattern
    (("Street", "St.", "Road", "Rd", "Ave", "Lane", "Ln", "Dr", "Close", "C", "Way", "Pl", "Sq", "Hill", "B", "Terr", "Row", "Walk", "G"), re.compile(_WAY),
     re.compile(rf"(?:\b{_FLAT},[ \n])?\b\d{{1,5}}[A-Za-z]?[ \n](?:(?:North|South|East|West|N\.|S\.|E\.|W\.)[ \n])?(?:{_CAP}[ \n]){{1,3}}{_WAY}(?:,?[ \n]{_FLAT})?")),
    (("Am", "Im", "der", "dem"), re.compile(rf"\b[AI](?:m|n[ \n]der|uf[ \n]dem)[ \n][{_UP}]"), re.compile(rf"\b(?:Am|An[ \n]der|Im|Auf[ \n]dem|In[ \n]der)[ \n]{_CAP}[ \n]\d{{1,4}}[a-z]?\b")),
    (("stra", "weg", "latz", "llee", "asse", "ing", "ufer", "damm", "steig", "Str", "Weg"),
     re.compile(r"[ \n](?=\d)(?:(?<=straße.)|(?<=asse.)|(?<=[wW]eg.)|(?<=latz.)|(?<=llee.)|(?<=ing.)|(?<=ufer.)|(?<=damm.)|(?<=steig.)|(?<=Str\..)|(?<=Straße.))", re.S),
     re.compile(rf"\b{_CAP}(?:{_END_DE}|[ \n]{_WAY_DE})[ \n]\d{{1,4}}[a-z]?\b")),
    (("rue", "avenue", "boulevard", "bd", "place", "allée", "chemin", "impasse", "quai", "route", "cours"), re.compile(rf"[ \n](?:{_WAY_FR})[ \n]"),
     re.compile(rf"\b\d{{1,4}}(?:[ \n](?:bis|ter))?,?[ \n]{_WAY_FR}[ \n](?:(?:de[ \n]la|de|du|des|d['’]|la|le)[ \n]?)?{_CAP}(?:[ \n-]{_CAP})?")),
    (("Avda.", "Av.", "Avenida", "Calle", "Plaza", "Pza.", "Paseo", "Camino", "Ronda", "C/"), re.compile(_WAY_ES),
     re.compile(rf"(?:\b(?:Avda\.|Av\.|Avenida|Calle|Plaza|Pza\.|Paseo|Camino|Ronda)|\bC/)[ \n](?:(?:de[ \n]la|de|del|los|las)[ \n])?{_CAP}(?:[ \n]{_CAP})?,?[ \n](?:n\.º[ \n])?\d{{1,4}}(?:,[ \n]\d{{1,2}}\.?º(?:[ \n][A-Z]\b)?)?")),
    (("",), re.compile(rf"\d[A-Z]?[ \n](?:[đĐpPnh]|[{_UP}][\w'’]*[ \n][{_UP}])"),
     re.compile(rf"(?=\d)\b\d{{1,4}}(?:/\d{{1,4}})*[A-Z]?(?:[ \n]ngõ[ \n]\d{{1,4}}(?:/\d+)?|[ \n]hẻm[ \n]\d+)?[ \n](?:(?:đường|phố|Đường|Phố)[ \n]{_CAP}(?:[ \n]{_CAP}){{0,2}}|{_CAP}[ \n]{_CAP})")),
]

_INITIAL = rf"[{_UP}]\."
_PARTICLE = r"(?:de|du|da|del|della|di|van|von|zu|der|den|la|le|el|al|bin|ten|ter)"
_FAMILY = rf"(?:(?:{_PARTICLE}[ \n]){{0,2}}(?:d['’])?{_CAP}(?:-{_CAP})*)"
NAME = re.compile(  # what begins a match is asked for first, as in the patterns above
    rf"(?=['’{_UP}dD])(?<![\w@#.'’-])(?:{_CAP}(?:-{_CAP})?,[ \n]{_CAP}(?:[ \n]{_INITIAL})?|(?:{_CAP}(?:-{_CAP})?|{_INITIAL})(?:[ \n]{_INITIAL}){{0,2}}(?:[ \n]{_FAMILY}){{1,3}}|{_CAP}[ \n]{_INITIAL})(?![\w@])"
)

# --- context ----------------------------------------------------------------------------------------

# Closed-class words and forms of address, in lower case, that begin or follow no name.
FUNCTION = frozenset("""the a an of in on at for by with from to and or but if as is are was were be been do does did not no it its this that these those there here they we you he she his her their our your my
    who what when where why how which can could will would should may must all any each some after before under over between during without into about more most please thanks dear hello
    der die das ein eine einen einem einer den dem des und oder aber wenn als ist sind war nicht kein mit von zu zum zur bei nach aus auf im am in an für über unter vor wir ihr sie er es ich dieser diese dieses jeder alle was wer wie wo warum bitte laut
    le la les un une des du et ou mais si est sont dans sur sous avec sans pour par ce cette ces nous vous ils elle elles il je qui que quoi où comment chaque selon merci
    el los las una unos unas y o pero es son en con sin por para al del este esta estos nosotros usted ellos ella yo quien qué cómo cuando cada según gracias
    và của các những là có không một này đó khi với cho trong trên dưới từ theo bị được đã sẽ hay hoặc nếu mỗi
    mr mrs ms miss dr prof sir herr frau mme mlle don doña sr sra dña ông bà anh chị cô monsieur madame señor señora""".split())
# Labels and kinds of places, bodies and products, in lower case; a feature, not a gate.
THING = frozenset("""street road lane drive avenue square market hill river valley lake bridge harbor harbour port mount mountain island park garden hall house tower station airport church
    institute university college school academy museum library hospital method theorem effect media ltd inc gmbh ag sa llc cms group company corp press news journal society association club team project system version model edition
    straße platz weg gasse hochschule institut brücke markt bad schloss rue boulevard place institut université mont plaza calle avenida universidad instituto sierra đường phố trường viện hồ núi chợ khu đại học
    user author assistant human bot home contact login help search menu imprint jobs settings privacy terms id ssn tel phone email fax subject date page part advertisement
    products news blog events archive about careers shop gallery forum support register topics subscribe sign read share rights rechte datenschutz startseite suche drucken anzeige
    accueil aide boutique actualités publicité inicio tienda noticias buscar publicidad str null not select where""".split())
_TITLE = r"Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Herrn|Frau|Mme|Madame|M|Mlle|Monsieur|Don|Doña|Sr|Sra|Dña|Ông|ông|Bà|bà|Anh|anh|Chị|chị|Cô|cô"
_CUE = {
    "phone": r"phone|telephone|tel|tél|téléphone|telefon|telefonisch|teléfono|móvil|fax|cell|mobile|call|reach|hotline|on-call|contact|unter|joindre|appeler|au|llamar|llamarnos|correo|điện thoại|đt|gọi|số|·|\|",
    "id_number": r"ssn|security number|insurance (?:number|no)|passport(?: no)?|id(?: card)?|id number|ausweis|ausweisnummer|personalausweis|steuernummer|steuer-id|steueridentifikationsnummer|sécurité sociale|document|documento|dni|nie|nif|căn cước|căn cước số|cccd|cccd số|cmnd|công dân|hộ chiếu|file|dossier",
    "address": r"lives at|moved from|home|address|ship to|mail|at|left at|from|to|anschrift|adresse|wohnhaft|wohnt|wohnt in der nähe|an|in der|liegt in der|habite|demeurant|domicilio en|vive en|vive|au|à|en|a|ngụ tại|số|ở|ở số|địa chỉ",
}
CUES = {k: re.compile(rf"(?i)(?:^|[^\w])(?:{v})(?:[^\w\n]|\n(?!\n))*(?:[^\W\d]+[^\w\n]+){{0,3}}$") for k, v in _CUE.items()}
CUES["name"] = re.compile(
    r"(?:^|[^\w])(?:(?:[Aa]uthor|[Mm]aintainer|[Rr]eviewed-by|[Nn]ame(?: is)?|[Ss]igned(?: by)?|[Pp]atient|[Cc]ontact|[Uu]nterschrieben|[Gg]ezeichnet|[Ss]igné|[Ff]irmado|[Nn]gười ký|[Pp]resent|[Aa]ttendees(?: were)?|[Aa]nwesend|[Pp]résents|[Aa]sistentes|[Cc]ó mặt)[^\w\n]{1,3}"
    r"|(?:[Rr]egards|[Tt]hanks|Grüßen|[Cc]ordialement|[Ss]aludo|[Tt]rân trọng)[^\w]{1,3}"
    r"|(?:[Aa]ccording to|[Tt]o|[Nn]ames|[Nn]amed|[Cc]alled|[Gg]ave|[Ll]ent|[Ss]old|[Ss]aid|[Bb]y|[Oo]f|[Ww]ith|[Tt]hat|Laut|Name ist|heiße|[Aa]n|[Vv]on|[Gg]ehört(?:e)?(?: früher| zu)?|beantwortet|Selon|[Dd]'après|appelle|[Éé]cri(?:re|vez) à|à|nom de|contacter"
    r"|Según|llamo|a|nombre de|contacto con|con|gửi|tên(?: là)?|[Tt]heo|[Ll]iên hệ|cho)[ \n])$")
JOINED = re.compile(rf"[{_UP}][\w.'’-]*,?[ \n](?:and|und|et|y|và)[ \n]$")
NOT_CUES = re.compile(r"(?i)(?:isbn|serial|order|invoice|ticket|version|bestellnummer|rechnung|facture|pedido|đơn hàng|ref|id=|host|server|handle|page|part|©|powered by|library|error|rgb|color)\W*(?:\w{1,6}\W+)?[\w-]{0,12}\W*$")
AFTER_NAME = re.compile(r"^(?:['’]s\b|,? (?:lives|and|und|et|y|và|wohnt|wohnhaft|habite|vive|sống|ngụ|said|who|whose|ist|has|had|reviewed|signed|ont|a|at \S*@|cho biết|cùng|theo|ở)\b|[;,.<(]|[ \n][<(]|$|\n)")
AFTER_NOT = re.compile(r"^[ \n]?(?:000|m²|kg|%|km|ms|€|\$)|^[ \n](?:Prozent|por ciento|pour cent|euros?|Euro|đồng|cases|cas|Fällen|casos|trường hợp|readers|copies)")
_TITLED = re.compile(rf"\b(?:{_TITLE})\.?[ \n]$")
_CAP_BEFORE = re.compile(rf"[{_UP}][\w'’-]*\.?[ \n]$")
_CAP_AFTER = re.compile(rf"[ \n](?:{_PARTICLE}[ \n])?[{_UP}]")
_INITIALS = re.compile(rf"(?:^|\s)[{_UP}]\.")
WORD_BEFORE = re.compile(r"([\w.'’-]+)\W{0,3}$")
_SENTENCE = re.compile(r"(?:^|[.!?:]\s*|\n\s*|>)$")
_INSIDE = re.compile(r"(?:[^\W\d_A-Z][,;]?|\))[ \n]$")  # a small letter before, so a sentence goes on
_GOES_ON = re.compile(r"^,?[ \n][^\W\d_A-Z]")
_QUAD = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_NUMBER_BEFORE, _NUMBER_AFTER = re.compile(r"\d[ ,;|]{1,3}$|\d,$"), re.compile(r"^(?:[ ;|]{1,3}|,[ ]?)\d")
_PART_LEFT = re.compile(rf"(?:{_FLAT},|\b(?:Am|An[ \n]der|Im|Auf[ \n]dem|In[ \n]der|North|South|East|West|[NSEW]\.))[ \n]$")
_PART_RIGHT = re.compile(rf"^(?:,?[ \n]{_FLAT}|,[ \n]\d{{1,2}}\.?º|[ \n](?:{_WAY}|{_WAY_DE}))")
_ANY_WAY = re.compile(rf"{_WAY}|{_END_DE}|{_WAY_DE}|{_WAY_ES}|\b{_WAY_FR}\b|đường|phố|Đường|Phố|ngõ|hẻm")


@lru_cache(maxsize=1)
def given_names() -> frozenset[str]:
    return frozenset(n.lower() for names in (*pii_examples.GIVEN.values(), pii_examples.VI_FAMILY) for n in names)


_MIDDLE = frozenset(n.lower() for n in pii_examples.VI_MIDDLE)


def left_features(kind: int, t: str, a: int) -> tuple[float, ...]:
    """What stands before a span; spans of one kind and start share it."""
    left = t[max(0, a - 48): a]
    prev = left[-1:] or "\n"
    number, name = kind in (1, 2), kind == 4
    if name:
        left = left[-28:]  # what counts for a name stands right before it
        before = WORD_BEFORE.search(left)
        word_before = before.group(1).rstrip(".").lower() if before else ""
        titled = _TITLED.search(left) is not None
        return (
            0.0, 0.0, 0.0, float(CUES["name"].search(left) is not None), float(NOT_CUES.search(left) is not None), float(prev in ".-/:_=#@$€&" and prev != "="),
            float(titled), float(not titled and word_before not in FUNCTION and _CAP_BEFORE.search(left) is not None), float(JOINED.search(left) is not None), float(_SENTENCE.search(left) is not None),
            float(_INSIDE.search(left) is not None), 0.0,
        )
    return (
        float(number and CUES["phone"].search(left) is not None), float(number and CUES["id_number"].search(left) is not None), float(kind == 3 and CUES["address"].search(left) is not None), 0.0,
        float(number and NOT_CUES.search(left) is not None), float(prev in ".-/:_=#@$€&" and not (prev == "=" and kind == 1)), 0.0, 0.0, 0.0, float(_SENTENCE.search(left) is not None),
        float(kind == 3 and _INSIDE.search(left) is not None), float(number and _NUMBER_BEFORE.search(left) is not None),
    )


def features(kind: int, t: str, a: int, b: int, given: frozenset[str], lefts: dict | None = None) -> list[float]:
    s = t[a:b]
    right = t[b: b + 24]
    if lefts is None:
        before = left_features(kind, t, a)
    else:
        before = lefts.get((kind, a))
        if before is None:
            before = lefts[kind, a] = left_features(kind, t, a)
    digits = sum(map(str.isdigit, s)) if kind != 4 else 0
    letters = sum(map(str.isalpha, s))
    groups = _DIGITS.findall(s) if digits else []
    kinds = [0.0] * 5
    kinds[kind] = 1.0
    first, last = (groups[0], groups[-1]) if groups else ("", "")
    words = _WORDS.findall(s) if kind >= 3 else []
    nxt = right[:1] or "\n"
    low = [w.rstrip(".,").lower() for w in words]
    name = kind == 4
    return [
        *kinds, float(digits), float(len(groups)), float(len(first)), float(len(last)), float(max(map(len, groups), default=0)), float(letters), float(len(s)),
        float("+" in s), float("(" in s), float(s.count("-")), float(s.count(" ") + s.count("\n")), float(s.count(".")), float(s[0] == "0"), float(s[0].isalpha()), float(s[-1].isalpha()),
        *before, float(name and AFTER_NAME.match(right) is not None), float(AFTER_NOT.match(right) is not None),
        float(nxt in "-/_@=#&%$" or (nxt in ".," and right[1:2].isdigit())),
        float(len(words)), float(name and low[0] in given), float(name and "," in s and low[-1] in given), float(name and any(w in given for w in low[1:])), float(name and len(low) > 1 and low[1] in _MIDDLE),
        float(any(w in FUNCTION for w in low[1:])), float(any(w in THING for w in low)), float(bool(low) and low[-1] in THING),
        float(name and _INITIALS.search(s) is not None), float(s.isupper()), float("," in s), float("\n" in s), float(name and _CAP_AFTER.match(right) is not None), float(kind == 3 and _ANY_WAY.search(s) is not None),
        float(kind == 3 and "/" in s), float(kind == 3 and any(w in given for w in low)),
        float(kind == 3 and (_PART_RIGHT.match(right) is not None or _PART_LEFT.search(t[max(0, a - 16): a]) is not None)),
        float(name and _GOES_ON.match(right) is not None), float(kind in (1, 2) and _NUMBER_AFTER.match(right) is not None), float(kind in (1, 2) and _QUAD.fullmatch(s) is not None),
    ]


_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[\w'’.-]+")
_HEAD = re.compile(r"[^\s,]+")
_DIGIT = re.compile(r"\d")
_LONG_NUMBER = re.compile(r"(?:\d[ \n().\-/]{0,3}){5}\d")
_PART = re.compile(r"[^\s,]+")
_ONLY_PARTICLE = re.compile(_PARTICLE)


def candidates(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every proposed span of a folded text.

    Every run of two to four capitalised words or initials is proposed as a name unless its first word is
    closed-class; lists and contexts are left to the trees.
    """
    out: list[tuple[int, int, int]] = []
    if _AT_HINT.search(t):
        out += [(0, *m.span()) for m in EMAIL.finditer(t)]
    if _DIGIT.search(t):
        if _LONG_NUMBER.search(t):
            # a line may be wrapped inside a number, a column of numbers is none
            out += [(1, *m.span()) for m in PHONE.finditer(t) if m.group().count("\n") < 2]
            out += [(2, *m.span()) for m in NUMBER_ID.finditer(t) if m.group().count("\n") < 2]
            out += [(2, *m.span()) for m in LETTER_ID.finditer(t)]
        for some, needed, pattern in ADDRESS:
            if any(x in t for x in some) and needed.search(t):
                out += [(3, *m.span()) for m in pattern.finditer(t)]
        out = list(dict.fromkeys(out))
    at = 0
    while m := NAME.search(t, at):
        a, b = m.span()
        whole = m.group()
        first = _HEAD.match(whole)
        at = a + first.end()
        if first.group().lower() in FUNCTION:
            continue
        # a name may end earlier than the run of capitals does
        for x in list(_PART.finditer(whole))[1:]:
            e = a + x.end()
            if not _ONLY_PARTICLE.fullmatch(x.group()):
                out.append((4, a, e))
                if x.group().lower() in FUNCTION:
                    break
    return out


@dataclass
class Model:
    trees: boosting.Trees
    thresholds: tuple[float, ...]
    given: frozenset[str]


HELD = 5  # every fifth line is held out to calibrate the thresholds


def train(copies: int = pii_examples.COPIES, lines: list[tuple[str, str]] | None = None) -> Model:
    """Trees from the labelled lines; whole lines are held out to calibrate the thresholds."""
    known = given_names()
    # every third listed name is unknown in training, so the trees do not rest on the list alone
    some = known - set(sorted(known)[::3])
    rows, labels, kinds, held, missed = [], [], [], [], [0] * len(KINDS)
    for i, _, text, mentions in pii_examples.sample(copies, lines=lines):
        t, _ = fold(text)
        truth = {(KINDS.index(k), a, b) for k, a, b in mentions}
        found = set(candidates(t))
        for k, _, _ in truth - found:
            missed[k] += i % HELD == 0
        for c in sorted(found):
            rows.append(features(c[0], t, c[1], c[2], some))
            labels.append(c in truth)
            kinds.append(c[0])
            held.append(i % HELD == 0)
    x, y, k, h = np.array(rows), np.array(labels, dtype=float), np.array(kinds), np.array(held)
    trees = boosting.fit(x[~h], y[~h])
    p = trees.score(x[h])
    thresholds = tuple(min(0.9, max(0.1, boosting.best_threshold(p[k[h] == j], y[h][k[h] == j], missed[j]))) for j in range(len(KINDS)))
    return Model(trees, thresholds, known)


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of all labelled lines; it does not depend on the corpus."""
    return train()


def mentions_of(texts: list[str], model: Model) -> list[list[tuple[str, int, int]]]:
    """Accepted mentions of each text: the most probable spans that do not overlap, longer ones first at equal probability."""
    rows, spans, folded = [], [], []
    for i, text in enumerate(texts):
        t, at = fold(text)
        folded.append((t, at))
        lefts: dict = {}
        for kind, a, b in candidates(t):
            rows.append(features(kind, t, a, b, model.given, lefts))
            spans.append((i, kind, a, b))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not rows:
        return out
    p = model.trees.score(np.array(rows))
    order = sorted(range(len(spans)), key=lambda j: (-round(float(p[j]), 2), -(spans[j][3] - spans[j][2]), spans[j]))
    taken: list[list[tuple[int, int]]] = [[] for _ in texts]
    for j in order:
        i, kind, a, b = spans[j]
        if p[j] < model.thresholds[kind] or any(a < y and x < b for x, y in taken[i]):
            continue
        taken[i].append((a, b))
        at = folded[i][1]
        start, end = (a, b) if at is None else (at[a], _end(texts[i], at, b))
        out[i].append((KINDS[kind], start, end))
    return out


def _end(text: str, at: list[int], b: int) -> int:
    end = at[b - 1] + 1
    while end < len(text) and unicodedata.combining(text[end]):
        end += 1
    return end


def mentions(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, kind, start_pos, end_pos) of every mention, positions in code points, distinct.

    NULL and empty texts give none; repeated rows fold.
    """
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(key).isNotNull()).select(key, text)
    model = trained() if model is None else model
    kind = dict(df.dtypes)[key]

    def make():
        def one(keys, texts):
            for a, b in slices(texts, SLICE_CHARS):
                for k, found in zip(keys[a:b], mentions_of(texts[a:b], model)):
                    for m in found:
                        yield k, *m

        return one

    return map_rows(rows, make, f"{key} {kind}, kind string, start_pos int, end_pos int", whole_batch=True).distinct()


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda m: m[1]):
        out += [text[at:a], MARKS[kind]]
        at = b
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """``df`` with ``redacted``: the text with each mention replaced by the placeholder of its kind."""
    model = trained() if model is None else model

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        values = [t if isinstance(t, str) else "" for t in texts]
        done = [redact(t, m) for t, m in zip(values, mentions_of(values, model))]
        return pd.Series([None if t is None else d for t, d in zip(texts, done)], index=texts.index, dtype=object)

    return df.withColumn("redacted", run(text))
