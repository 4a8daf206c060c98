"""Strict parsing of one segment of a given kind, with errors that say what is wrong; and coercions between kinds."""

from __future__ import annotations

import re

from . import grammar
from .grammar import ACROSS, CHAPTER, CHAPTERS, CHAPTERS_TO_VERSE, VERSE, VERSES, Segment

NAMES = {VERSE: "verse", VERSES: "verse range", ACROSS: "chapter range", CHAPTER: "chapter", CHAPTERS: "chapters", CHAPTERS_TO_VERSE: "chapters to verse"}
_N = r"\s*(\d{1,3})\s*"
_DASH = f"[{re.escape(grammar.RANGES)}]"
_SHAPES = {
    VERSE: rf"{_N}[:.]{_N}", VERSES: rf"{_N}[:.]{_N}{_DASH}{_N}", ACROSS: rf"{_N}[:.]{_N}{_DASH}{_N}[:.]{_N}", CHAPTER: _N, CHAPTERS: rf"{_N}{_DASH}{_N}", CHAPTERS_TO_VERSE: rf"{_N}{_DASH}{_N}[:.]{_N}",
}


class UnitError(ValueError):
    """Text that is not a segment of the kind."""


def parse_unit(kind: int, text: str) -> Segment:
    """A segment of exactly this kind; numbers beyond 255 and ranges backwards are errors."""
    m = re.fullmatch(_SHAPES[kind], text)
    if m is None:
        raise UnitError(f"`{text}` is not a {NAMES[kind]}")
    n = [int(x) for x in m.groups()]
    if max(n) > 255:
        raise UnitError(f"`{text}` has a number beyond 255")
    if kind == VERSE:
        s = (VERSE, n[0], n[1], n[0], n[1])
    elif kind == VERSES:
        s = (VERSES, n[0], n[1], n[0], n[2])
    elif kind == ACROSS:
        s = (ACROSS, *n)
    elif kind == CHAPTER:
        s = (CHAPTER, n[0], 1, n[0], None)
    elif kind == CHAPTERS:
        s = (CHAPTERS, n[0], 1, n[1], None)
    else:
        s = (CHAPTERS_TO_VERSE, n[0], 1, n[1], n[2])
    if (s[1], s[2]) > (s[3], 255 if s[4] is None else s[4]):
        raise UnitError(f"`{text}` runs backwards")
    return s


def parse_segment(text: str) -> Segment:
    """Exactly one segment, with nothing behind it."""
    scan = grammar.scan(text)
    got = grammar.resolve(scan.nodes).segments
    if len(got) != 1 or len(scan.nodes) != 1 or scan.nodes[0].dangling or text[scan.nodes[0].complete_end() :].strip():
        raise UnitError(f"`{text}` is not one segment")
    return got[0]


def coerce(s: Segment, kind: int) -> Segment:
    """A segment as another kind that says the same, where there is one."""
    if s[0] == kind:
        return s
    normal = grammar.chapters(s[1], s[3]) if s[4] is None else grammar.verses(s[1], s[2], s[3], s[4])
    if normal[0] == kind:
        return normal
    if kind == VERSES and s[0] == VERSE:
        return (VERSES, *s[1:])
    if kind == ACROSS and s[0] in (VERSE, VERSES, CHAPTERS_TO_VERSE):
        return (ACROSS, *s[1:])
    if kind == CHAPTERS and s[0] == CHAPTER:
        return (CHAPTERS, *s[1:])
    if kind == CHAPTERS_TO_VERSE and s[4] is not None and s[2] == 1 and s[1] < s[3]:
        return (CHAPTERS_TO_VERSE, *s[1:])
    raise UnitError(f"a {NAMES[s[0]]} is no {NAMES[kind]}")


def to_json(s: Segment) -> dict | str:
    """The untagged human form: ``"3:16"`` for a verse or chapter, a range as its two ends."""
    from .notation import write_segments

    if s[0] in (VERSE, CHAPTER):
        return write_segments([s])
    return {"start": write_segments([grammar.chapters(s[1], s[1]) if s[4] is None else grammar.verses(s[1], s[2], s[1], s[2])]), "end": write_segments([grammar.chapters(s[3], s[3]) if s[4] is None else grammar.verses(s[3], s[4], s[3], s[4])])}
