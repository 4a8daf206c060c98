"""Finding references in one text, and reading single references. Pure Python, no Spark."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from ..canon import Canon, Translations, trie_pattern
from . import grammar
from .grammar import Segment, Written

_HYPHENATION = re.compile("[-\u2010\u00ad][ \t]*\r?\n[ \t]*|\u00ad")
_CHAPTER_AHEAD = re.compile(r"\s*[0-9IVXLCivxlc]")
_DIGIT_AHEAD = re.compile(r"\s*[0-9]")
_BARE = re.compile(r"(?<![0-9A-Za-z_])[0-9]{1,3}[ \t]*:[ \t]*[0-9]")
_QUANTITY = re.compile(rf"\s*[0-9]+(?:[^\W\d_]|[{grammar.UNIT_SPACES}]*[{grammar.UNITS}])")
_ODD_CASE = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"(?:[^\S\r\n]|[,;:(\[\-–—/])*")
# What may belong to chapters and verses behind a name, and white space.
_TAIL = re.compile(rf"[\s0-9IVXLCivxlcabdf,;:.{re.escape(grammar.RANGES)}]*+")
#: Names and tails that a finder remembers; a bound on memory.
KEPT = 200_000
#: So many bytes without a space are data or code, not prose.
LONG_TOKEN = 64


def _alphabetic(c: str) -> bool:
    return c.isalpha()


class SearchText:
    """A text with words joined that a line break had split, and the way back to its own offsets."""

    __slots__ = ("original", "text", "starts", "removed")

    def __init__(self, original: str):
        self.original = original
        pieces, self.starts, self.removed = [], [], []
        copied = gone = size = 0
        for m in _HYPHENATION.finditer(original) if "-" in original or "\u00ad" in original or "\u2010" in original else ():
            if m.start() and m.end() < len(original) and _alphabetic(original[m.start() - 1]) and _alphabetic(original[m.end()]):
                pieces.append(original[copied : m.start()])
                size += m.start() - copied
                copied = m.end()
                gone += m.end() - m.start()
                self.starts.append(size)
                self.removed.append(gone)
        self.text = "".join(pieces) + original[copied:] if pieces else original

    def back(self, offset: int) -> int:
        k = bisect_right(self.starts, offset)
        return offset + (self.removed[k - 1] if k else 0)


@dataclass(slots=True)
class Found:
    """A reference in a text; offsets in characters of the original text, the end exclusive."""

    start: int
    end: int
    book: int
    segments: list[Segment]
    translation: str | None = None
    translation_span: tuple[int, int] | None = None
    parts: list[Written] = field(default_factory=list)


@dataclass(frozen=True)
class Problem:
    start: int
    end: int
    message: str
    detail: str | None


@dataclass(frozen=True)
class Options:
    """What to find besides references with a book's name.

    ``context_book`` is the book of bare references in the whole text; ``heading`` a line pattern with
    ``{book}`` that names the book for what follows; ``books_alone`` also finds names without a chapter.
    """

    context_book: int | None = None
    heading: str | None = None
    books_alone: bool = False
    translations: Translations | None = None


class Finder:
    """All searches under one canon. Building it compiles the patterns; a worker keeps one."""

    def __init__(self, canon: Canon, options: Options = Options()):
        self.canon, self.options = canon, options
        body = trie_pattern(canon.keys)
        ascii_only = all(k.isascii() for k in canon.keys)
        left = r"(?<![0-9A-Za-z_])" if ascii_only else r"(?<!\w)"
        right = r"(?![0-9A-Za-z_])" if ascii_only else r"(?!\w)"
        self._candidate = re.compile(rf"{left}(?:{trie_pattern(canon.keys, cases=True)})\.?")
        # The same, trying names only where a word begins: other words are passed over whole within the pattern.
        word = "0-9A-Za-z_" if ascii_only else r"\w"
        names = rf"(?:{trie_pattern(canon.keys, cases=True)})"
        self._by_word = re.compile(rf"(?:(?<=[{word}])[{word}]++)?+[^{word}]*+(?:(?!{names})[{word}]++[^{word}]*+)*+({names}\.?)")
        #: Names that begin with a sign, which no word does.
        self._signs = [k for k in canon.keys if not re.match(rf"[{word}]", k)]
        self._alone = re.compile(rf"{left}(?:{body}){right}\.?", re.I)
        self._single = re.compile(rf"{left}({body}){right}\.?(.*)", re.I)
        self._names: dict[str, tuple] = {}
        self._tails: dict[tuple[int, str], tuple] = {}
        self._heading = re.compile(options.heading.replace("{book}", f"(?P<book>(?i:{body}))"), re.M) if options.heading else None

    # --- search -----------------------------------------------------------------------------------

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """Names that something like a chapter follows. A name that fails later still ends the one before."""
        ahead = _CHAPTER_AHEAD.match
        if self._signs and (low := text.lower()) and any(k in low for k in self._signs):
            return [(m.start(), m.end()) for m in self._candidate.finditer(text) if ahead(text, m.end())]
        return [m.span(1) for m in self._by_word.finditer(text) if ahead(text, m.end())]

    def search(self, original: str, with_parts: bool = True) -> list[Found]:
        """Every reference in order. Without parts, the places of single segments are left out, which is faster."""
        text = SearchText(original)
        t = text.text
        spans = self.candidates(t)
        found: list[Found] = []
        for k, (start, end) in enumerate(spans):
            stop = spans[k + 1][0] if k + 1 < len(spans) else len(t)
            if (f := self._read(t, start, end, stop, with_parts)) is not None:
                found.append(f)
        if self.options.context_book is not None or self._heading:
            found += self._bare(t, found, [s for s, _ in spans])
            found.sort(key=lambda f: f.start)
        if self.options.books_alone:
            found += self._books_alone(t, found)
            found.sort(key=lambda f: f.start)
        if text.starts:
            for f in found:
                f.start, f.end = text.back(f.start), text.back(f.end)
                f.parts = [Written(text.back(p.start), text.back(p.end), None if p.range_end is None else text.back(p.range_end)) for p in f.parts]
                if f.translation_span:
                    f.translation_span = (text.back(f.translation_span[0]), text.back(f.translation_span[1]))
        return found

    def _counts(self, book: int, translation: str | None) -> tuple[int, ...] | None:
        if translation and self.options.translations and (own := self.options.translations.chapters(translation, book)):
            return own
        return self.canon.chapters(book)

    def _segments(self, t: str, start: int, stop: int):
        """The scan behind a name, and the translation that ends it."""
        if not (tr := self.options.translations) or tr.pattern is None:
            return grammar.scan(t, start, stop), None
        for m in tr.pattern.finditer(t, start, stop):
            if m.start() > start and (t[m.start() - 1].isalnum()):
                continue
            scan = grammar.scan(t, start, m.start())
            if (named := self._following(t, scan.end)) and named[1] == m.start():
                return scan, named
            break
        scan = grammar.scan(t, start, stop)
        return scan, self._following(t, scan.end)

    def _following(self, t: str, at: int) -> tuple[str, int, int] | None:
        """The translation right behind a reference, on its line; a bracket before it must close."""
        tr = self.options.translations
        gap = _GAP.match(t, at)
        m = tr.pattern.match(t, gap.end())
        if m is None:
            return None
        opener = gap[0].rstrip()[-1:]
        closer = {"(": ")", "[": "]"}.get(opener)
        if closer and not t[m.end() :].lstrip().startswith(closer):
            return None
        return tr.keys[m[0].lower()], m.start(), m.end()

    def _read(self, t: str, start: int, end: int, stop: int, with_parts: bool) -> Found | None:
        """The reference behind a name. Names and tails recur, so what they say is remembered."""
        if self.options.translations is not None:
            return self._read_anew(t, start, end, stop)
        name = t[start:end]
        about = self._names.get(name)
        if about is None:
            book = self.canon.get(name)
            about = (book if book is not None and _plausible_case(name) else None, self.canon_ambiguous(name), name.endswith("."))
            if len(self._names) < KEPT:
                self._names[name] = about
        book, ambiguous, dotted = about
        if book is None or _in_long_token(t, start):
            return None
        # All that decides is the tail and the character behind it.
        tail = t[end : min(_TAIL.match(t, end, stop).end() + 1, stop)]
        counts = self.canon.chapters(book)
        key = (book if counts else 0, tail)
        known = self._tails.get(key)
        if known is None:
            scan = grammar.scan(tail)
            got = self._resolved(tail, scan, counts, len(tail))
            known = () if got is None else (got[0].segments, got[0].written, got[0].end, got[1], scan.nodes[0].first.start == 0, scan.nodes[0].first.roman)
            if len(self._tails) >= KEPT:
                self._tails.clear()
            self._tails[key] = known
        if not known:
            return None
        segments, written, size, sign, glued, roman = known
        if ambiguous and not (sign == ":" or (sign == "." and dotted)):
            return None
        if glued and not dotted and (sign is None or roman):
            return None  # as in codes: a verse is needed, and no Roman numeral
        if not with_parts:
            return Found(start, end + size, book, segments)
        parts = [Written(start if k == 0 else end + w[0], end + w[1], None if w[2] is None else end + w[2]) for k, w in enumerate(written)]
        return Found(start, end + size, book, segments, None, None, parts)

    def _read_anew(self, t: str, start: int, end: int, stop: int) -> Found | None:
        name = t[start:end]
        book = self.canon.get(name)
        if book is None or _in_long_token(t, start) or not _plausible_case(name):
            return None
        scan, named = self._segments(t, end, stop)
        got = self._resolved(t, scan, self._counts(book, named[0] if named else None), stop)
        if got is None:
            return None
        resolved, sign = got
        if not (sign == ":" or (sign == "." and name.endswith("."))) and self.canon_ambiguous(name):
            return None
        first = scan.nodes[0].first
        if first.start == end and not name.endswith(".") and (sign is None or first.roman):
            return None  # glued, as in codes: a verse is needed, and no Roman numeral
        parts = [Written(start, *resolved.written[0][1:]), *resolved.written[1:]]
        return Found(start, resolved.end, book, resolved.segments, named[0] if named else None, named[1:] if named else None, parts)

    def canon_ambiguous(self, name: str) -> bool:
        from ..canon import name_key

        return name_key(name) in self.canon.ambiguous

    @staticmethod
    def _resolved(t: str, scan: grammar.Scan, counts, stop: int):
        """The resolution, and the sign before its explicit verse (``:`` before ``.``)."""
        if not scan.nodes or (scan.nodes[-1].dangling and _QUANTITY.match(t, scan.end, stop)):
            return None
        resolved = grammar.resolve(scan.nodes, counts)
        if not resolved.used:
            return None
        signs = [p.sign for n in scan.nodes[: resolved.used] for p in n.parts if p.slot == "v" and p.number]
        return resolved, ":" if ":" in signs else signs[-1] if signs else None

    def _bare(self, t: str, taken: list[Found], starts: list[int]) -> list[Found]:
        """References without a name, which need a written ``chapter:verse``, under the book in context."""
        if self._heading:
            regions = [(m.end(), b) for m in self._heading.finditer(t) if (b := self.canon.get(m["book"])) is not None]
        else:
            regions = [(0, self.options.context_book)]
        at = [r[0] for r in regions]
        spans = sorted((f.start, f.end) for f in taken)
        ends = [s for s, _ in spans]
        out: list[Found] = []
        free = 0
        for m in _BARE.finditer(t):
            start = m.start()
            k = bisect_right(ends, start)
            if start < free or (k and start < spans[k - 1][1]) or not (r := bisect_right(at, start)):
                continue
            book = regions[r - 1][1]
            n = bisect_right(starts, start)
            stop = starts[n] if n < len(starts) else len(t)
            scan = grammar.scan(t, start, stop)
            if not scan.nodes or not any(p.slot == "v" and p.sign == ":" for p in scan.nodes[0].parts):
                continue
            if (got := self._resolved(t, scan, self.canon.chapters(book), stop)) is None:
                continue
            resolved, _ = got
            named = self._following(t, resolved.end) if self.options.translations and self.options.translations.pattern else None
            out.append(Found(start, resolved.end, book, resolved.segments, named[0] if named else None, named[1:] if named else None, resolved.written))
            free = resolved.end
        return out

    def _books_alone(self, t: str, taken: list[Found]) -> list[Found]:
        spans = sorted((f.start, f.end) for f in taken)
        starts = [s for s, _ in spans]
        out = []
        for m in self._alone.finditer(t):
            name = m[0].rstrip(".")
            end = m.start() + len(name)
            k = bisect_right(starts, m.start())
            if (k and m.start() < spans[k - 1][1]) or (k < len(spans) and spans[k][0] < end):
                continue
            if _DIGIT_AHEAD.match(t, m.end()) or self.canon_ambiguous(name) or _in_long_token(t, m.start()) or not _plausible_case(name):
                continue
            book = self.canon.get(name)
            if book is None or (whole := self.whole_book(book)) is None:
                continue
            out.append(Found(m.start(), end, book, whole, parts=[Written(m.start(), end, None)]))
        return out

    # --- problems ---------------------------------------------------------------------------------

    def problems(self, original: str) -> list[Problem]:
        """Segments with a written verse that parse but do not exist, and what does exist."""
        text = SearchText(original)
        t = text.text
        spans = self.candidates(t)
        out = []
        for k, (start, end) in enumerate(spans):
            book = self.canon.get(t[start:end])
            if book is None:
                continue
            scan, named = self._segments(t, end, spans[k + 1][0] if k + 1 < len(spans) else len(t))
            counts = self._counts(book, named[0] if named else None)
            real, said = grammar.resolve(scan.nodes, counts), grammar.resolve(scan.nodes)
            if said.used <= real.used or real.used >= len(said.segments):
                continue
            node, segment = scan.nodes[real.used], said.segments[real.used]
            if not any(p.slot == "v" for p in node.parts):
                continue
            name = self.canon.by_id[book].name
            a, b = node.first.start, node.complete_end()
            numbers = [node.first, *(p.number for p in node.parts if p.number)]
            clamped = any(n.value == grammar.TOO_LARGE and t[n.start : n.end] != "255" for n in numbers)
            from .notation import write_segments

            written = t[a:b] if clamped else write_segments([segment])
            place = f" in the {named[0]}" if named else ""
            out.append(Problem(text.back(a), text.back(b), f"{name} {written} does not exist{place}", _what_exists(name, segment, counts)))
        return out

    # --- single references ------------------------------------------------------------------------

    def whole_book(self, book: int) -> list[Segment] | None:
        counts = self.canon.chapters(book)
        return [grammar.chapters(1, len(counts))] if counts else None

    def parse(self, text: str, validate: bool = True) -> tuple[int, list[Segment]] | None:
        """The first reference of a text, or a book alone as its chapters; no rules against false positives."""
        m = self._single.search(text)
        if m and m[2].strip():
            book = self.canon.get(m[1])
            resolved = grammar.resolve(grammar.scan(m[2]).nodes, self.canon.chapters(book) if validate else None)
            return (book, resolved.segments) if resolved.segments else None
        book = self.canon.get(text.strip()) if validate else None
        whole = self.whole_book(book) if book is not None else None
        return (book, whole) if whole else None

    def parse_translated(self, text: str) -> tuple[int, list[Segment], str | None] | None:
        m = self._single.search(text)
        if not m:
            return None
        book = self.canon.get(m[1])
        scan, named = self._segments(m[2], 0, len(m[2]))
        resolved = grammar.resolve(scan.nodes, self._counts(book, named[0] if named else None))
        return (book, resolved.segments, named[0] if named else None) if resolved.segments else None

    def read(self, text: str) -> tuple[int, list[Segment]] | None:
        """OSIS, then USFM, then plain text, then a book alone."""
        from .notation import NotationError, parse_osis, parse_usfm

        for parse in (parse_osis, parse_usfm):
            try:
                return parse(self.canon, text)
            except NotationError:
                pass
        return self.parse(text)


def parse_segments(text: str) -> list[Segment] | None:
    """Segments without a book or counts."""
    return grammar.resolve(grammar.scan(text).nodes).segments or None


def _what_exists(name: str, s: Segment, counts: tuple[int, ...] | None) -> str | None:
    if counts is None:
        return None
    for chapter, verse in ((s[1], s[2]), (s[3], s[4] or 0)):
        if chapter > len(counts):
            return f"{name} has {len(counts)} chapter{'' if len(counts) == 1 else 's'}"
        if chapter >= 1 and verse > counts[chapter - 1]:
            return f"{name} {chapter} has {counts[chapter - 1]} verses"
    return None


def _in_long_token(t: str, at: int) -> bool:
    # A space near on both sides settles it: what lies between is less than LONG_TOKEN bytes.
    near = 30 if t.isascii() else 8
    if t.rfind(" ", max(0, at - near), at) >= 0 and t.find(" ", at, at + near) >= 0:
        return False
    before = re.split(r"[ \t\n\f\r]", t[max(0, at - LONG_TOKEN) : at])[-1]
    after = re.split(r"[ \t\n\f\r]", t[at : at + LONG_TOKEN], maxsplit=1)[0]
    size = min(LONG_TOKEN, len(before.encode())) + min(LONG_TOKEN, len(after.encode()))
    return size >= LONG_TOKEN


def _plausible_case(name: str) -> bool:
    """No capital behind a small letter within a word; what stands between letters does not count."""
    for word in name.split():
        letters = "".join(c for c in word if c.isalpha())
        if any(a.islower() and b.isupper() for a, b in zip(letters, letters[1:], strict=False)):
            return False
    return True
