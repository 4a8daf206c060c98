"""Writing references, and the OSIS and USFM notations both ways. Pure Python, no Spark."""

from __future__ import annotations

from dataclasses import dataclass, fields

from ..canon import Canon
from .grammar import ACROSS, CHAPTER, CHAPTERS, CHAPTERS_TO_VERSE, VERSE, VERSES, Segment, chapters, verses


class NotationError(ValueError):
    """Text that is not in the notation."""


@dataclass(frozen=True)
class Format:
    """How references are written; the defaults parse back to the same passage."""

    book: str = "name"  # name, abbreviation, osis, usfm
    book_separator: str = " "
    chapter_verse: str = ":"
    range: str = "-"
    verse_separator: str = ","
    chapter_separator: str = "; "
    omit_first_verse_of_chapter_range: bool = False
    join_adjacent: bool = False
    chapter_in_single_chapter_books: bool = True

    @classmethod
    def from_dict(cls, values: dict) -> Format:
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise NotationError(f"unknown format option: {sorted(unknown)}")
        return cls(**values)


def _whole(s: Segment, f: Format) -> str:
    kind, sc, sv, ec, ev = s
    if kind == VERSE:
        return f"{sc}{f.chapter_verse}{sv}"
    if kind == VERSES:
        return f"{sc}{f.chapter_verse}{sv}{f.range}{ev}"
    if kind == CHAPTER:
        return str(sc)
    if kind == CHAPTERS:
        return f"{sc}{f.range}{ec}"
    if kind == CHAPTERS_TO_VERSE or (sv == 1 and f.omit_first_verse_of_chapter_range):
        return f"{sc}{f.range}{ec}{f.chapter_verse}{ev}"
    return f"{sc}{f.chapter_verse}{sv}{f.range}{ec}{f.chapter_verse}{ev}"


def _without_chapter(s: Segment, f: Format) -> str:
    kind, _, sv, ec, ev = s
    if kind == VERSE:
        return str(sv)
    if kind == VERSES:
        return f"{sv}{f.range}{ev}"
    if kind == ACROSS:
        return f"{sv}{f.range}{ec}{f.chapter_verse}{ev}"
    return _whole(s, f)


def _continues(before: Segment, s: Segment) -> bool:
    """Whether a segment reads the same without its chapter."""
    if before[4] is not None:
        return s[1] == before[3] and s[0] in (VERSE, VERSES, ACROSS)
    return s[0] in (CHAPTER, CHAPTERS)


def join_adjacent(segments: list[Segment]) -> list[Segment]:
    """Neighbours in written order that continue each other become one."""
    out: list[Segment] = []
    for s in segments:
        p = out[-1] if out else None
        if p is not None and p[4] is not None and s[4] is not None and s[1] == p[3] and s[2] == p[4] + 1 and s[0] != CHAPTERS_TO_VERSE:
            out[-1] = verses(p[1], p[2], s[3], s[4])
        elif p is not None and p[4] is None and s[4] is None and s[1] == p[3] + 1:
            out[-1] = chapters(p[1], s[3])
        else:
            out.append(s)
    return out


def write_segments(segments: list[Segment], f: Format = Format(), single_chapter: bool = False) -> str:
    if f.join_adjacent:
        segments = join_adjacent(segments)
    hide = single_chapter and not f.chapter_in_single_chapter_books
    out, before = "", None
    for s in segments:
        if hide:
            out += (f.verse_separator if before else "") + (_without_chapter(s, f) if s[0] in (VERSE, VERSES) else _whole(s, f))
        elif before is None:
            out += _whole(s, f)
        elif _continues(before, s):
            out += f.verse_separator + _without_chapter(s, f)
        else:
            out += f.chapter_separator + _whole(s, f)
        before = s
    return out


def write(canon: Canon, book: int, segments: list[Segment], f: Format = Format()) -> str | None:
    """A reference as text; a whole book is its name. None where the book or its code is unknown."""
    b = canon.by_id.get(book)
    name = {"name": b.name, "abbreviation": b.abbreviation, "osis": b.osis, "usfm": b.usfm}[f.book] if b else None
    if name is None:
        return None
    counts = canon.chapters(book)
    if counts and covers(segments, [chapters(1, len(counts))], counts):
        return name
    return f"{name}{f.book_separator}{write_segments(segments, f, counts is not None and len(counts) == 1)}"


def spans(segments: list[Segment], counts: tuple[int, ...] | None) -> list[tuple[int, int]]:
    """Positions in the book, sorted and merged where they overlap or touch."""
    from ..canon import UNKNOWN_LENGTH

    def length(c: int) -> int:
        return counts[c - 1] if counts and 1 <= c <= len(counts) else UNKNOWN_LENGTH

    def position(c: int, v: int) -> int:
        return sum(length(k) for k in range(1, c)) + v

    out: list[tuple[int, int]] = []
    for a, b in sorted((position(sc, sv), position(ec, length(ec) if ev is None else ev)) for _, sc, sv, ec, ev in segments):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def covers(outer: list[Segment], inner: list[Segment], counts) -> bool:
    o = spans(outer, counts)
    return all(any(a <= c and d <= b for a, b in o) for c, d in spans(inner, counts))


# --- OSIS and USFM --------------------------------------------------------------------------------


def osis(canon: Canon, book: int, segments: list[Segment]) -> str | None:
    code = canon.by_id[book].osis if book in canon.by_id else None
    if not code:
        return None

    def one(s: Segment) -> str:
        kind, sc, sv, ec, ev = s
        start = f"{code}.{sc}" + (f".{sv}" if kind in (VERSE, VERSES, ACROSS) else "")
        if kind in (VERSE, CHAPTER):
            return start
        return f"{start}-{code}.{ec}" + ("" if ev is None else f".{ev}")

    return " ".join(map(one, segments))


def usfm(canon: Canon, book: int, segments: list[Segment]) -> str | None:
    code = canon.by_id[book].usfm if book in canon.by_id else None
    return "; ".join(f"{code} {_whole(s, Format())}" for s in segments) if code else None


def _number(text: str) -> int:
    if not (text.isascii() and text.lstrip("+").isdigit()) or int(text) > 255:
        raise NotationError(text)
    return int(text)


def parse_osis(canon: Canon, text: str) -> tuple[int, list[Segment]]:
    """References of one book, separated by spaces, commas or semicolons."""

    def point(p: str) -> tuple[int, int, int | None]:
        parts = p.split(".")
        if len(parts) not in (2, 3) or parts[0] not in canon.by_osis:
            raise NotationError(text)
        return canon.by_osis[parts[0]], _number(parts[1]), _number(parts[2]) if len(parts) == 3 else None

    book, out = None, []
    for reference in text.replace(",", " ").replace(";", " ").split():
        first, dash, last = reference.partition("-")
        b, c, v = point(first)
        b2, c2, v2 = point(last) if dash else (b, c, v)
        if b2 != b or (book is not None and b != book) or (v is not None and v2 is None):
            raise NotationError(text)
        book = b
        out.append(chapters(c, c2) if v is None and v2 is None else verses(c, 1 if v is None else v, c2, v2))
    if book is None:
        raise NotationError(text)
    return book, out


def parse_usfm(canon: Canon, text: str) -> tuple[int, list[Segment]]:
    """References of one book, separated by ``;``; the code may be left out after the first."""

    def point(p: str) -> tuple[int, int | None]:
        c, colon, v = p.partition(":")
        return _number(c.strip()), _number(v.strip()) if colon else None

    book, out = None, []
    for part in text.split(";"):
        words = part.strip().split(None, 1)
        code = canon.by_usfm.get(words[0].upper()) if len(words) == 2 else None
        numbers = words[1].strip() if code is not None else part.strip()
        b = code if code is not None else book
        if b is None or (book is not None and b != book):
            raise NotationError(text)
        book = b
        first, dash, last = numbers.partition("-")
        c, v = point(first)
        if not dash:
            out.append(chapters(c, c) if v is None else verses(c, v, c, v))
            continue
        c2, v2 = point(last)
        if v is not None:
            out.append(verses(c, v, c, c2) if v2 is None else verses(c, v, c2, v2))
        else:
            out.append(chapters(c, c2) if v2 is None else verses(c, 1, c2, v2))
    return book, out
