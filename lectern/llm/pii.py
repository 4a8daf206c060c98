"""Personal information inside free text: spans proposed by patterns, confirmed by checksums, weighed by context.

Every kind has patterns that propose spans with a base score. Validators (Luhn, mod-97, mod-23 letters,
digit counts, numbering-plan rules) and cue words within a window before and after a span raise or lower
the score; overlapping spans are settled by score, then length. What reaches the threshold is replaced
by a typed placeholder and the rest of the text stays as it is, character by character.

Kinds: ``email``, ``phone``, ``id_number``, ``address``, ``name``. A name is a given name or initial with
a family name. What stands around it (titles, thanks, labels, record fields, signature blocks) finds it in any
spelling; in running prose a pair of capitalised words is proposed where the first is a common given name or an
initial, and the words before, in and behind it raise or lower its score (`_prose_names`).

Odd input: null and empty texts hold nothing and stay; texts of any length are scanned whole (no pattern
backtracks beyond a bounded window); a value is reported once per document however often it stands there.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread

THRESHOLD = 0.6
#: Characters before and behind a span in which cue words count.
BEFORE, BEHIND = 48, 24
#: Characters before a value in which the name of its record may stand: a name, its separator and a label.
LINE_BEFORE = 200

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


# --- checksums ------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return len(digits) > 1 and total % 10 == 0


def mod97_iban(value: str) -> bool:
    s = re.sub(r"\W", "", value).upper()
    s = s[4:] + s[:4]
    return s.isalnum() and int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def mod97_key(digits: str) -> bool:
    """Thirteen digits and a key of two."""
    return len(digits) == 15 and 97 - int(digits[:13]) % 97 == int(digits[13:])


def mod23_letter(digits: str, letter: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == letter.upper()


def nie_letter(first: str, digits: str, letter: str) -> bool:
    """A foreigner's number: X, Y or Z count as a digit before the seven."""
    return mod23_letter(str("XYZ".index(first.upper())) + digits, letter)


def mod11_digit(digits: str) -> bool:
    """Eight digits and a check digit."""
    rest = sum(int(d) * (9 - k) for k, d in enumerate(digits[:8])) % 11
    return len(digits) == 9 and int(digits[8]) == (0 if rest < 2 else 11 - rest)


# --- proposals ------------------------------------------------------------------------------------

# Mail addresses, plain or written out.
_EMAIL = re.compile(r"(?<![\w.+-])[^\W_][\w.+-]{0,63}(?:@|\s?[\[(]\s?at\s?[\])]\s?)[^\W_][\w-]{0,62}(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[^\W_][\w-]{0,62}){1,6}", re.I)

# What may not stand before and behind a number. The look-behind comes after the first character of a
# pattern (the dot), so that the engine can skip to characters that may begin a match.
_LEFT = r"(?<![\w:+].)(?<!\d[.,/-].)(?<![-/].)"
_RIGHT = r"(?![\w:@])(?![-/.,]\d)"
# Stretches with six digits or more, or of a card's shape: where numbers are looked for at all.
_DENSE = re.compile(r"\d(?:(?:[ ().+/-]{0,3}\d){5,}|\d[A-Za-z]\d{5})")
# Shapes of telephone numbers (with country code; North American; trunk prefix).
_PHONES = [
    (re.compile(r"(?:\+|0(?=0))" + _LEFT + r"0?[1-9]\d{0,2}[ .-]?(?:\(0\)[ .-]?)?\(?\d{1,8}\)?(?:[ ./-]?\d{2,8}){1,5}" + _RIGHT, re.S), 0.7, (9, 15)),
    (re.compile(r"(?:1(?=[ .-])|\((?=[2-9])|[2-9](?=\d{2}[ .-]))" + _LEFT + r"(?:(?<=1)[ .-](?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])|(?<=\()[2-9]\d{2}\) ?|(?<=[2-9])\d{2}[ .-])[2-9]\d{2}[ .-]?\d{4}" + _RIGHT, re.S), 0.65, (10, 11)),
    (re.compile(r"(?:\((?=0)|0(?=[1-9]))" + _LEFT + r"(?:(?<=\()0)?[1-9]\d{0,3}\)?[ ./-]\d{2,8}(?:[ .-]\d{2,6}){0,4}" + _RIGHT, re.S), 0.6, (9, 12)),
    (re.compile(r"0" + _LEFT + r"[1-9]\d{8,10}" + _RIGHT, re.S), 0.3, (10, 12)),
]
# Shapes of identity numbers.
_SSN = re.compile(r"\d" + _LEFT + r"\d{2}([- ])\d{2}\1\d{4}" + _RIGHT, re.S)
_NINO = re.compile(r"[A-Za-z]" + _LEFT + r"[A-Za-z]([ -]?)\d{2}\1\d{2}\1\d{2}\1[A-Da-d]" + _RIGHT, re.S)
_NIR = re.compile(r"[12]" + _LEFT + r"([ .-]?)\d{2}\1(?:\d{2})\1(?:\d{2}|2[AB])\1\d{3}\1\d{3}\1?\d{2}" + _RIGHT, re.S)
_DNI = re.compile(r"(\d" + _LEFT + r"\d{7})([- ]?)([A-HJ-NP-TV-Za-hj-np-tv-z])" + _RIGHT, re.S)
_NIE = re.compile(r"([XYZxyz])" + _LEFT + r"[- ]?(\d{7})[- ]?([A-HJ-NP-TV-Za-hj-np-tv-z])" + _RIGHT, re.S)
_NIF_PT = re.compile(r"[1235689]" + _LEFT + r"\d{2}([ .]?)\d{3}\1\d{3}" + _RIGHT, re.S)
_ID_GR = re.compile(r"[ABEZHIKMNOPTYXΑΒΕΖΗΙΚΜΝΟΡΤΥΧ]" + _LEFT + r"[ABEZHIKMNOPTYXΑΒΕΖΗΙΚΜΝΟΡΤΥΧ][ -]?\d{6}" + _RIGHT, re.S)
_CARD = re.compile(r"[A-Za-z]" + _LEFT + r"\d{2}[A-Za-z]\d{5}" + _RIGHT, re.S)
_LONG = re.compile(r"\d" + _LEFT + r"(?:[ -]?\d){12,18}" + _RIGHT, re.S)
_IBAN = re.compile(r"[A-Z]" + _LEFT + r"[A-Z]\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _RIGHT, re.S)

# An account number's beginning: what follows is part of it, whether it is valid or not.
_IBAN_BEFORE = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4})* ?$")
# What a mail address has in it.
_AT = re.compile(r"@|[\[(]\s?at\s?[\])]", re.I)

_CAP = r"[A-ZÀ-ÖØ-ÞŁŚŠŽÅΑ-Ω]"
_WORD = rf"{_CAP}[\w'’-]*"
# Kinds of street, by language.
_STREET_EN = r"(?:Street|St\.|Road|Rd\.|Lane|Ln\.|Avenue|Ave\.|Drive|Dr\.|Court|Ct\.|Close|Way|Place|Square|Terrace|Crescent|Gardens|Row|Hill|Walk|Grove|Park|Mews|Boulevard|Blvd\.)"
# Street words that are no other word's abbreviation: one of them behind another belongs to the name ("Green Park Road").
_STREET_WORD = "(?:Street|Road|Lane|Avenue|Drive|Court|Close)"
_STREET_FR = r"(?:rue|avenue|boulevard|impasse|allée|place|chemin|quai|cours|route|square|passage|ruelle|sentier)"
_STREET_IB = r"(?:Calle|C/|Avenida|Av\.|Plaza|Paseo|Camino|Ronda|Travesía|Rua|R\.|Travessa|Praça|Largo|Beco|Estrada|Alameda|Vía|Via)"
_ADDRESSES = [
    (re.compile(rf"\d(?<![\w.,:/-].)\d{{0,4}}(?:-\d{{1,5}})?[a-z]? (?:[NSEW]\. )?(?:(?!{_STREET_WORD.upper()} ){_WORD} ){{1,3}}?{_STREET_EN}(?!\w)(?! {_STREET_WORD}(?!\w))(?:, (?:Apt|Flat|Unit|Suite|Apartment)\.? ?\d{{1,4}}[a-z]?)?"), 0.75),
    (re.compile(rf"\d(?<![\w.,:/-].)\d{{0,4}}(?:-\d{{1,5}})? (?:[NSEW]\. )?(?:{_CAP}{{2,}} ){{1,3}}?{_STREET_EN.upper()}(?!\w)(?! {_STREET_WORD.upper()}(?!\w))(?:, (?:APT|FLAT|UNIT)\.? ?\d{{1,4}})?"), 0.75),
    (re.compile(rf"\d(?<![\w.,:/-].)\d{{0,4}}(?:-\d{{1,5}})? (?:[nsew]\. )?(?:[^\W\d_]{{2,}} ){{1,2}}{_STREET_EN.lower()}(?!\w)(?:, (?:apt|flat|unit)\.? ?\d{{1,4}})?"), 0.35),
    (re.compile(rf"\d(?<![\w.,:/-].)\d{{0,3}}(?i: ?(?:bis|ter|quater)(?!\w)| ?[a-d](?=[ ,]))?,? (?i:{_STREET_FR}) (?i:(?:de la|de l['’]|des|du|de|d['’]|aux?|la|le|les) ?)?(?i:l['’])?{_WORD}(?:[ -](?i:(?:de la|des|du|de|d['’]|et)[ -]?)?{_WORD})*"), 0.7),
    (re.compile(rf"(?<!\w)(?:{_CAP}[\w-]*(?i:weg|straße|strasse|str\.|gasse|platz|allee)|(?:{_WORD} )?(?:Weg|Straße|Gasse|Platz|Allee|Ring)) \d{{1,4}}(?: ?[a-z](?!\w))?(?![:,.]\d)"), 0.7),
    (re.compile(rf"(?<!\w){_CAP}[\w-]*(?i:ring|damm|ufer|steig|pfad|hof|markt) \d{{1,4}}(?: ?[a-z](?!\w))?(?![:,.]\d)"), 0.4),
    (re.compile(rf"(?<!\w)(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Hinter der|Hinter dem|Unter den|Vor dem) (?:{_WORD} ){{1,3}}\d{{1,4}}(?: ?[a-z](?!\w))?(?![\d:,.]\d)"), 0.4),
    (re.compile(rf"(?<!\w)(?:{_STREET_IB}|{_STREET_IB.upper()}) (?i:(?:de los|de las|de la|del|das|dos|da|do|de) )?{_WORD}(?: (?i:(?:de los|de las|de la|del|das|dos|da|do|de|y|e) )?{_WORD}){{0,3}},? (?:n\.?º ?)?\d{{1,4}}(?: ?[a-z](?!\w)(?! las\b))?(?![:,.]\d)"), 0.7),
    (re.compile(rf"(?<!\w)(?:Οδός|οδός|Λεωφόρος|λεωφόρος|Πλατεία) (?:{_WORD} ){{1,3}}\d{{1,4}}(?:[Α-Ωα-ω](?!\w))?"), 0.7),
]

# A flat before a house number.
_FLAT = re.compile(r"(?<!\w)(?:Flat|Apt\.?|Apartment|Unit|Suite) \d{1,4}[a-z]?, $", re.I)
# What a text must hold, in lower case, for a pattern of `_ADDRESSES` to be worth a try; None: a number, as most texts do.
_ADDRESS_SIGNS = [
    None, None, None, None, ("weg ", "straße ", "strasse ", "str. ", "gasse ", "platz ", "allee ", "ring "), ("ring ", "damm ", "ufer ", "steig ", "pfad ", "hof ", "markt "),
    ("am ", "an de", "auf de", "im ", "in der ", "zum ", "zur ", "hinter de", "unter den ", "vor dem "),
    ("calle ", "c/ ", "avenida ", "av. ", "plaza ", "paseo ", "camino ", "ronda ", "travesía ", "rua ", "r. ", "travessa ", "praça ", "largo ", "beco ", "estrada ", "alameda ", "vía ", "via "),
    ("οδός ", "λεωφόρος ", "πλατεία "),
]

# Particles between given and family name.
_PARTICLE = r"(?:van der|van den|van de|van|von der|von dem|von|vom|zu|zum|de la|de los|de las|de|del|della|di|da|do|dos|das|du|le|la|af|av|ter|ten)"
_G = rf"(?:{_CAP}[^\W\d_]+(?:[-'’]{_CAP}[^\W\d_]+)*|{_CAP}\.)"
_F = rf"{_CAP}[^\W\d_]+(?:[-'’]{_CAP}[^\W\d_]+)*"
_UP = rf"{_CAP}{_CAP}+(?:[-'’]{_CAP}+)*"
_LO = r"[^\W\d_A-Z]{2,}(?:-[^\W\d_A-Z]{2,})*"
_FULL = rf"{_G}(?: {_CAP}\.)?(?: {_G})?(?: {_PARTICLE})? {_F}"
_NAME_SHAPES = [rf"{_F}, {_G}(?: {_CAP}\.)?(?!\w)", rf"{_UP}(?: {_CAP}\.)?(?: (?i:{_PARTICLE}))? {_UP}(?!\w)", rf"{_G}(?: {_CAP}\.)?(?: {_PARTICLE})? {_F}(?!\w)", rf"{_LO}(?: [a-z]\.)?(?: {_PARTICLE})? {_LO}(?!\w)"]
_ANY_NAME = "(?P<name>" + "|".join(_NAME_SHAPES) + ")"
_PROPER_NAME = "(?P<name>" + "|".join(_NAME_SHAPES[:3]) + ")"

# What stands before a private person's name. Titles are no part of it.
_TITLES = (
    "Dr Prof Rev Mr Mrs Ms Miss Mme Mlle M Sr Sra Srta Dra Fr Hr Pfr".split(),
    "Sister Brother Father Pastor Pastora Deacon Pfarrerin Pfarrer Frau Herrn Herr Schwester Bruder Madame Monsieur Sœur Frère Père Doña Don Hermana Hermano Padre Irmã Irmão Dona κα κυρία κύριος".split(),
)
_TITLE = "(?:" + "|".join([rf"{t}\.?" for t in sorted(_TITLES[0], key=len, reverse=True)] + sorted(_TITLES[1], key=len, reverse=True) + [r"κ\.", r"π\."]) + ")"
_LABEL = re.compile(
    r"(?:^|[\s|;(])(?:Name|Speaker|Contact|Preacher|Host|Organi[sz]er|Author|Reader|Guest|Nom|Nombre|Nome|Orador(?:a)?|Sprecher(?:in)?|Redner(?:in)?|Orateur|Ponente|Όνομα|Ομιλητής|Μίλησε|Habla|Habló|Fala|Falou|Ansprechpartner(?:in)?)\s?$"
)
_FIELD = re.compile(r"\"(?:who|name|speaker|contact|person|author)\"\s?$")
_COLON = re.compile(r":(?=\s{0,3}(?:\"|[^\W\d_]))")
_LABELLED = re.compile(rf":\s*(?:(?!M\.? ){_TITLE} )?{_ANY_NAME}(?=\s*(?:$|[.;|,\n\"]|\s))", re.M)
_QUOTED = re.compile(rf":\s?\"{_ANY_NAME}(?=\")")
_PHRASES = [
    (re.compile(rf"(?:Thanks to|Dank an|Merci à|Gracias a|Obrigad[oa] a|Obrigad[oa] à|Thank you,?|Ευχαριστούμε (?:την|τον|τη)?) ?(?:{_TITLE} )?{_ANY_NAME}(?= (?:for|für|pour|por|pel[oa]s?|για)\b)"), 0.95),
    (re.compile(rf"(?:given by|Es sprach|Exposé de|Vortrag von|Charla de|Palestra de|Ομιλία (?:της|του)|We remember|Pray for|Wir gedenken|Habló|Falou) (?:{_TITLE} )?{_ANY_NAME}(?= (?:in|im|ce|en|em|no|na|στο|στη|this|on|at|am|esta|hoje|hoy|today)\b|\.)"), 0.9),
]
# A title, then any spelling of a name before one of these verbs, or a proper name before anything.
_TITLED = re.compile(rf"{_TITLE} (?=[^\W\d_])")
_AFTER_TITLE = re.compile(rf"(?:{_ANY_NAME}(?= (?:kept|disagreed|agreed|said|spoke|led|wrote|asked|noted|replied|prayed|read|opened|closed|im|in|ce|dijo|disse|sagte|a dit)\b))")
_PROPER_AFTER_TITLE = re.compile(_PROPER_NAME)
# A record: fields of a line, the name first; and a signature block: the name on the line before another value.
_LEAD_FIELD = r"(?:[^\W\d_][\w -]{0,24}:\s?)?"
_BEFORE_VALUE = re.compile(rf"(?:(?<![^\n])|(?<=[.!?:;>\]\"”»*] ))(?:[-*>#]\s|\[[ x]\]\s)?[ \t]*{_ANY_NAME}(?:\s?[;|]\s?|[ \t]*\n\s*){_LEAD_FIELD}[\"<(]?$")
# The same behind other words, for a name that is written as one.
_BEFORE_VALUE_LOOSE = re.compile(rf"(?<=[a-zà-ÿα-ωά-ώ0-9)] ){_PROPER_NAME}(?:\s?[;|]\s?|[ \t]*\n\s*){_LEAD_FIELD}[\"<(]?$")

# Words that begin a sentence, not a name.
_NO_GIVEN_NAME = frozenset("A An At By For From He How If In It No Of On Or See She So The They This To We What When Where Who Why You".split())
# Cue words that raise or lower a proposal of a kind.
_CUES = {
    "phone": re.compile(r"(?i)\b(?:call|ring|phone|tel|tél|telefon\w*|mobile|number|appeler|llamar|ligue|fax|whatsapp|sms|τηλέφωνο|via)\b"),
    "id_number": re.compile(r"(?i)\b(?:id|identity|identité|ident\w*|social security|sécurité sociale|ausweis\w*|documento|dni|nie|nif|contribuinte|nino|ssn|passport|ταυτότητας|insurance|visitors|sheet|via|card|iban|konto|account)\b"),
    "address": re.compile(r"(?i)\b(?:address|anschrift|adresse|dirección|endereço|morada|διεύθυνση|meets? at|come to|go to|treffpunkt|rendez-vous|vemos|encontro|lives at|συνάντηση|wohnt)\b"),
}
_AGAINST = re.compile(r"(?i)\b(?:isbn|issn|order no\.?|version|build|room|hymn|tracks?|pages?|price|seat|question|verses?|psalm|chapter|meeting on|https?:|www\.)[^\n.!?]{0,20}$")


# Digits of a number with its country code, by country; and with a trunk prefix.
_LENGTHS = {"1": 11, "33": 11, "34": 11, "44": 12, "49": 12, "39": 12, "351": 12, "30": 12}
_TRUNK_LENGTH = 11


def _trim_phone(value: str) -> str:
    """A number without groups behind a space that are too many for its country: they begin the next sentence."""

    def size(v: str) -> int:
        return len(_digits(v.replace("(0)", "")))

    international = value.startswith(("+", "00"))
    digits = _digits(value).removeprefix("00")
    most = next((n for k in (3, 2, 1) if (n := _LENGTHS.get(digits[:k]))), 15) if international else _TRUNK_LENGTH
    most += 2 if value.startswith("00") else 0
    while size(value) > most and " " in value:
        value = value.rpartition(" ")[0]
    return value


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _weigh(text: str, start: int, end: int, kind: str, score: float) -> float:
    before = text[max(0, start - BEFORE) : start]
    if kind in _CUES and (_CUES[kind].search(before) or _CUES[kind].search(text[end : end + BEHIND])):
        score += 0.25
    # A field of a record, or a value on a line of its own.
    left = text[start - 1 : start] or "\n"
    right = text[end : end + 1] or "\n"
    if re.search(r"[;|]\s?$", before) or left == "\n" and right == "\n":
        score += 0.25
    if _AGAINST.search(before):
        score -= 0.6
    return score


def _regions(text: str) -> list[tuple[int, int]]:
    """Where digits are dense, with room around, joined where they meet."""
    out: list[tuple[int, int]] = []
    for m in _DENSE.finditer(text):
        lo, hi = max(0, m.start() - 16), min(len(text), m.end() + 40)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _numbers(text: str) -> Iterator[Span]:
    for lo, hi in _regions(text):
        for pattern, base, (least, most) in _PHONES:
            for m in pattern.finditer(text, lo, hi):
                if _IBAN_BEFORE.search(text, max(0, m.start() - 30), m.start()):
                    continue
                value = _trim_phone(m[0])
                if least <= len(_digits(value)) <= most:
                    end = m.start() + len(value)
                    yield Span(m.start(), end, "phone", _weigh(text, m.start(), end, "phone", base))
        for pattern, base in ((_SSN, 0.6), (_NINO, 0.65), (_CARD, 0.6)):
            for m in pattern.finditer(text, lo, hi):
                yield Span(m.start(), m.end(), "id_number", _weigh(text, m.start(), m.end(), "id_number", base) + 0.05)
        for m in _NIR.finditer(text, lo, hi):
            # Spaced as such a number it counts; a valid key confirms one without spaces or context.
            base = (0.7 if m[1] else 0.3) + (0.4 if mod97_key(_digits(m[0])) else 0.0)
            yield Span(m.start(), m.end(), "id_number", _weigh(text, m.start(), m.end(), "id_number", base))
        for m in _DNI.finditer(text, lo, hi):
            base = 0.8 if mod23_letter(m[1], m[3]) else 0.3
            yield Span(m.start(), m.end(), "id_number", _weigh(text, m.start(), m.end(), "id_number", base))
        for m in _NIE.finditer(text, lo, hi):
            base = 0.8 if nie_letter(m[1], m[2], m[3]) else 0.3
            yield Span(m.start(), m.end(), "id_number", _weigh(text, m.start(), m.end(), "id_number", base))
        # A check digit of one in eleven, or none: a cue must stand beside these.
        for m in _NIF_PT.finditer(text, lo, hi):
            if mod11_digit(_digits(m[0])):
                yield Span(m.start(), m.end(), "id_number", _weigh(text, m.start(), m.end(), "id_number", 0.4))
        for m in _ID_GR.finditer(text, lo, hi):
            yield Span(m.start(), m.end(), "id_number", _weigh(text, m.start(), m.end(), "id_number", 0.4))
        for m in _LONG.finditer(text, lo, hi):
            if luhn(_digits(m[0])) and not _IBAN_BEFORE.search(text, max(0, m.start() - 30), m.start()):
                yield Span(m.start(), m.end(), "id_number", _weigh(text, m.start(), m.end(), "id_number", 0.55))
        for m in _IBAN.finditer(text, lo, hi):
            yield Span(m.start(), m.end(), "id_number", 0.9 if mod97_iban(m[0]) else 0.0)


def _values(text: str) -> Iterator[Span]:
    """Proposals of every kind but names, weighed."""
    if _AT.search(text):
        for m in _EMAIL.finditer(text):
            yield Span(m.start(), m.end(), "email", 1.0)
    yield from _numbers(text)
    low = text.lower()
    for k, ((pattern, base), signs) in enumerate(zip(_ADDRESSES, _ADDRESS_SIGNS, strict=True)):
        if signs is not None and not any(x in low for x in signs):
            continue
        for m in pattern.finditer(text):
            start = m.start()
            if k < 3 and (flat := _FLAT.search(text, max(0, start - 20), start)):
                start = flat.start()
            yield Span(start, m.end(), "address", _weigh(text, start, m.end(), "address", base))


def _names(text: str, values: list[Span]) -> Iterator[Span]:
    for m in _COLON.finditer(text):
        before = text[max(0, m.start() - 24) : m.start()]
        pattern, score = (_LABELLED, 0.9) if _LABEL.search(before) else (_QUOTED, 0.95) if _FIELD.search(before) else (None, 0.0)
        if pattern is not None and (n := pattern.match(text, m.start())):
            yield Span(n.start("name"), n.end("name"), "name", score)
    for pattern, score in _PHRASES:
        for m in pattern.finditer(text):
            yield Span(m.start("name"), m.end("name"), "name", score)
    for m in _TITLED.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            continue
        if n := _AFTER_TITLE.match(text, m.end()):
            yield Span(n.start("name"), n.end("name"), "name", 0.85)
        if n := _PROPER_AFTER_TITLE.match(text, m.end()):
            yield Span(n.start("name"), n.end("name"), "name", 0.7)
    for v in values:
        lo = max(0, v.start - LINE_BEFORE)
        if n := _BEFORE_VALUE.search(text[lo : v.start]):
            yield Span(lo + n.start("name"), lo + n.end("name"), "name", 0.9)
        elif n := _BEFORE_VALUE_LOOSE.search(text[lo : v.start]):
            yield Span(lo + n.start("name"), lo + n.end("name"), "name", 0.7)


# Common given names of the languages read, without those that are ordinary words. Scripture's own come second:
# they count only with a family name that scripture does not know.
_GIVEN = frozenset(
    """Adele Adrian Alan Albert Alfred Alice Alicia Aline Amelie Amélie Anders Angela Anja Anneliese Antoine António Antonio Arthur Astrid Audrey Barbara Beatriz Bernard Bernd Bettina Björn Brigitte Bruno Camille Carla Carlos Carmen
    Caroline Catherine Cécile Charles Charlotte Christine Claire Claudia Clara Colin Dagmar Denise Diana Dieter Dimitra Dimitris Dorothea Eduardo Edward Eleni Elena Elke Emily Emma Eric Erika Ernst Eugénie Fernando Florian Frank
    Franz François Françoise Frederick Friedrich Fritz Gabriela George Georg Gerald Gertrud Giorgos Gisela Greta Guillaume Günter Gustav Hanne Hans Harald Harry Heidi Heike Heinrich Heinz Helen Helena Helga Helmut Henri Henrik Henry Hélène
    Hilda Hugo Ines Inês Inge Ingrid Irene Isabel Ivo Jacques Jane Javier Jean Jennifer Jorge Julia Julie Jürgen Karen Karin Karl Katerina Katharina Katya Kevin Klaus Konstantinos Laura Laurent Lena Leonie Linda Lisa Lorenz Louis
    Louise Lucía Luis Luisa Luís Madeleine Manfred Manuel Margaret Margit Margot Marie Marta Martin Mathilde Monika Nadia Nicole Nikos Nora Odile Olga Oliver Oscar Otto Pablo Patricia Pavel Pierre Rafael Raquel Renate Richard Robert
    Roger Rosa Sabine Sandra Sofia Sophie Stefan Susan Sven Teresa Thérèse Tilda Tomas Ulrike Ursula Vera Victor Walter Werner William Wolfgang Yara Yves Yvonne Zoë""".split()
)
_SCRIPTURE_GIVEN = frozenset("Adam Andreas Andrew Anna Anne Benjamin Daniel David Elisabeth Elizabeth Eva Hannah Jakob James Johannes John Jonas Jonathan José João Joseph Juan Judith Lukas Maria María Mark Markus Martha Mary Matthew Matthias Michael Miguel Miriam Paul Paulo Pedro Peter Philip Philipp Rachel Rebecca Ruth Samuel Sara Sarah Simon Stephen Susanna Thomas Timothy Tobias".split())
# Words that make a body, a place, a day or a work of what stands before or in them, and scripture's second names.
_NO_FAMILY_NAME = frozenset(
    """Abbey Academy Apostle Archive Association Avenue Baptist Bible Bridge Bro Cathedral Centre Chapel Church Close College Committee Council Court Drive Evangelist Festschrift Foundation Fund Gardens Gemeinde Gospel Grove Hall Hill Hospital House
    Institute Iscariot Kirche Lane Library Magdalene Magdala Memorial Ministry Mission Museum Park Parish Place Press Prize Prophet River Road School Schule Seminary Society Square Stiftung Street Testament Trust University Valley Verlag Way
    Woche Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December Advent Lent Easter Christmas Gott Herr Jesus Christ Christus King Queen Saint""".split()
)
_PROSE = re.compile(rf"(?<![\w.@/-])(?P<given>{_CAP}[^\W\d_]+(?:[-'’]{_CAP}[^\W\d_]+)?|{_CAP}\.)(?: {_CAP}\.)?(?: {_PARTICLE})? (?P<family>{_F})(?![\w@]|[-'’]\w)")
_CAPITALISED = re.compile(rf"(?<![\w.@/-]){_CAP}(?:\.|[^\W\d_]+)")
_HOLY_BEFORE = re.compile(r"(?:\b(?:St|Sankt|Saint|Sainte|San|Santa|Santo|São|King|Queen|Mother|Apostle|Prophet|König|Prophet|Apostel|roi|rey|rei|apôtre|Άγιος|Αγία)\.? |\b[A-Z][a-z]+ and )$")
_PERSON_BEFORE = re.compile(r"(?i)\b(?:met|with|by|from|to|and|called|named|our|my|his|her|their|friend|neighbou?r|treasurer|member|mit|von|bei|unser|unsere|avec|par|chez|con|com|por|nuestra|nuestro|nossa|nosso|με|από)\s$")
_DOES_BEHIND = re.compile(r"^(?:,| (?:[a-zà-ÿα-ώ]+))")
_REFERENCE_BEHIND = re.compile(r"^[.,]? ?\d")


def _prose_names(text: str) -> Iterator[Span]:
    """Names in running prose: a common given name or an initial, then a family name, weighed by the words around."""
    for word in _CAPITALISED.finditer(text):
        given = word[0]
        score = 0.45 if given in _GIVEN else 0.35 if given in _SCRIPTURE_GIVEN else 0.15 if given.endswith(".") else 0.0
        if not score or not (m := _PROSE.match(text, word.start())):
            continue
        family = m["family"]
        before, behind = text[max(0, m.start() - BEFORE) : m.start()], text[m.end() : m.end() + BEHIND]
        score += 0.25 if _PERSON_BEFORE.search(before) else 0.0
        score += 0.15 if _DOES_BEHIND.match(behind) else 0.05
        # In the middle of a sentence a capital says more.
        score += 0.15 if before[-1:] == " " and before[-2:-1] not in ".!?" else 0.05
        if family in _NO_FAMILY_NAME or family in _GIVEN or family in _SCRIPTURE_GIVEN or behind[1:].partition(" ")[0].strip(".,;") in _NO_FAMILY_NAME:
            score -= 0.6
        if _HOLY_BEFORE.search(before) or _REFERENCE_BEHIND.match(behind):
            score -= 0.6
        yield Span(m.start(), m.end(), "name", min(score, 0.69))


def find_spans(text: str | None) -> list[Span]:
    """The spans that hold personal information, in order and without overlap."""
    if not text:
        return []
    values = [s for s in _values(text) if s.score >= THRESHOLD]
    names = [s for s in (*_names(text, values), *_prose_names(text)) if s.score >= THRESHOLD and text[s.start : s.end].partition(" ")[0] not in _NO_GIVEN_NAME]
    # Kept spans by start; only the neighbours can overlap a new one.
    kept: list[Span] = []
    starts: list[int] = []
    for s in sorted([*values, *names], key=lambda s: (-(s.score if s.kind != "email" else 9), s.start - s.end, s.start)):
        k = bisect.bisect_left(starts, s.start)
        if (k == 0 or kept[k - 1].end <= s.start) and (k == len(kept) or kept[k].start >= s.end):
            kept.insert(k, s)
            starts.insert(k, s.start)
    return kept


def redact(text: str | None) -> str | None:
    """The text with typed placeholders; everything else is untouched."""
    if not text:
        return text
    out, at = [], 0
    for s in find_spans(text):
        out += [text[at : s.start], PLACEHOLDER[s.kind]]
        at = s.end
    return "".join(out) + text[at:]


def found_values(documents: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``doc_id, kind, pii_text``: each distinct value of a document. Narrow: nothing is shuffled."""
    docs = documents.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(column).alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = dict.fromkeys((s.kind, text[s.start : s.end]) for s in find_spans(text))
                rows += [(doc_id, kind, value) for kind, value in seen]
            ids, kinds, found = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=["doc_id", "kind", "pii_text"])

    return spread(docs).mapInArrow(search, "doc_id bigint, kind string, pii_text string")


def redact_column(df: DataFrame, column: str, out: str = "redacted") -> DataFrame:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(redact)

    return spread(df).withColumn(out, run(F.col(column)))
