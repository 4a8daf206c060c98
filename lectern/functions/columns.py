"""Column builders for references: positions, keys, notations, containment. All Catalyst, no Python at run time.

A reference is a ``book_id`` and an array of segment structs ``(kind, sc, sv, ec, ev)``; ``ev`` is null
where a segment ends with a whole chapter. Positions need the book's chapter lengths and the number of
verses before each chapter, as arrays (see `operators.algebra.with_positions`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..canon import UNKNOWN_LENGTH
from .grammar import ACROSS, CHAPTER, CHAPTERS, CHAPTERS_TO_VERSE, VERSE, VERSES


def length_of(chapter: Column, lengths: Column) -> Column:
    return F.coalesce(F.get(lengths, chapter - 1), F.lit(UNKNOWN_LENGTH))


def position(chapter: Column, verse: Column, lengths: Column, before: Column) -> Column:
    """Verses from the start of the book; chapters that the counts do not have take UNKNOWN_LENGTH each."""
    known = F.coalesce(F.size(lengths), F.lit(0))
    known = F.when(known < 0, 0).otherwise(known)
    total = F.when(known > 0, F.get(before, known - 1) + F.get(lengths, known - 1)).otherwise(0)
    inside = F.get(before, chapter - 1)
    return (F.when((chapter >= 1) & (chapter <= known), inside).when(chapter < 1, 0).otherwise(total + (chapter - 1 - known) * UNKNOWN_LENGTH) + verse).cast("int")


def start_position(s: Column, lengths: Column, before: Column) -> Column:
    return position(s["sc"], s["sv"], lengths, before)


def end_position(s: Column, lengths: Column, before: Column) -> Column:
    return position(s["ec"], F.coalesce(s["ev"], length_of(s["ec"], lengths)), lengths, before)


def verse_spans(segments: Column, lengths: Column, before: Column) -> Column:
    """Sorted positions of a reference, merged where they overlap or touch: array<struct<s,e>>."""
    raw = F.array_sort(F.transform(segments, lambda x: F.struct(start_position(x, lengths, before).alias("s"), end_position(x, lengths, before).alias("e"))))
    return merge_spans(raw)


def merge_spans(ordered: Column) -> Column:
    empty = F.expr("cast(array() as array<struct<s:int,e:int>>)")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], F.lit(-9)) + 1), grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(ordered, empty, add)


def spans_contain(outer: Column, inner: Column) -> Column:
    return F.forall(inner, lambda i: F.exists(outer, lambda o: (o["s"] <= i["s"]) & (i["e"] <= o["e"])))


def spans_overlap(a: Column, b: Column) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["s"] <= y["e"]) & (y["s"] <= x["e"])))


def bcv_start(book: Column, s: Column) -> Column:
    return (book * 1_000_000 + s["sc"] * 1_000 + s["sv"]).cast("int")


def bcv_end(book: Column, s: Column) -> Column:
    return (book * 1_000_000 + s["ec"] * 1_000 + F.coalesce(s["ev"], F.lit(999))).cast("int")


def canon_key(book: Column, segments: Column) -> Column:
    """Order of the canon: book, first chapter, first verse; a whole chapter comes before its verses."""
    s = F.element_at(segments, 1)
    verse = F.when(s["kind"] >= CHAPTER, 0).otherwise(s["sv"])
    return F.shiftleft(book.cast("bigint"), 16) + F.shiftleft(s["sc"], 8) + verse


def segment_key(s: Column) -> Column:
    """Sorts segments by start, then end; an open end comes last."""
    return F.struct(s["sc"].alias("sc"), s["sv"].alias("sv"), s["ec"].alias("ec"), F.coalesce(s["ev"], F.lit(65535)).alias("ev"), s["kind"].alias("kind"))


def is_range(s: Column) -> Column:
    return ~s["kind"].isin(VERSE, CHAPTER)


def first_of(s: Column) -> Column:
    """Where a segment starts, as a segment: its first verse or chapter."""
    whole = s["kind"] >= CHAPTER
    none = F.lit(None).cast("int")
    return F.struct(
        F.when(whole, CHAPTER).otherwise(VERSE).alias("kind"), s["sc"].alias("sc"), F.when(whole, 1).otherwise(s["sv"]).alias("sv"), s["sc"].alias("ec"), F.when(whole, none).otherwise(s["sv"]).alias("ev")
    )


def last_of(s: Column) -> Column:
    whole = s["ev"].isNull()
    return F.struct(F.when(whole, CHAPTER).otherwise(VERSE).alias("kind"), s["ec"].alias("sc"), F.coalesce(s["ev"], F.lit(1)).alias("sv"), s["ec"].alias("ec"), s["ev"].alias("ev"))


def make_segment(sc: Column, sv: Column, ec: Column, ev: Column) -> Column:
    """A segment of its shortest kind; a null ``ev`` makes whole chapters."""
    kind = F.when(ev.isNull(), F.when(sc == ec, CHAPTER).otherwise(CHAPTERS)).when(sc != ec, ACROSS).when(sv == ev, VERSE).otherwise(VERSES)
    return F.struct(kind.alias("kind"), sc.alias("sc"), F.when(ev.isNull(), 1).otherwise(sv).alias("sv"), ec.alias("ec"), ev.alias("ev"))


def explicit_only(segments: Column) -> Column:
    """Without whole chapters."""
    return F.filter(segments, lambda s: ~s["kind"].isin(CHAPTER, CHAPTERS))


# --- notations ------------------------------------------------------------------------------------


def _text(c: Column) -> Column:
    return c.cast("string")


def _full(s: Column, cv: str = ":", dash: str = "-", omit_first: bool = False) -> Column:
    sc, sv, ec, ev = (_text(s[n]) for n in ("sc", "sv", "ec", "ev"))
    kind = s["kind"]
    short = F.concat(sc, F.lit(dash), ec, F.lit(cv), ev)
    across = F.concat(sc, F.lit(cv), sv, F.lit(dash), ec, F.lit(cv), ev)
    return (
        F.when(kind == VERSE, F.concat(sc, F.lit(cv), sv)).when(kind == VERSES, F.concat(sc, F.lit(cv), sv, F.lit(dash), ev)).when(kind == CHAPTER, sc).when(kind == CHAPTERS, F.concat(sc, F.lit(dash), ec))
        .when(kind == CHAPTERS_TO_VERSE, short).otherwise(F.when(s["sv"] == 1, short).otherwise(across) if omit_first else across)
    )


def _short(s: Column, cv: str = ":", dash: str = "-", omit_first: bool = False) -> Column:
    sv, ec, ev = (_text(s[n]) for n in ("sv", "ec", "ev"))
    kind = s["kind"]
    return F.when(kind == VERSE, sv).when(kind == VERSES, F.concat(sv, F.lit(dash), ev)).when(kind == ACROSS, F.concat(sv, F.lit(dash), ec, F.lit(cv), ev)).otherwise(_full(s, cv, dash, omit_first))


def write_segments(segments: Column, cv: str = ":", dash: str = "-", comma: str = ",", semicolon: str = "; ", omit_first: bool = False) -> Column:
    """``3:16-18,20; 4`` : a segment that continues the one before leaves its chapter out."""

    def part(s: Column, i: Column) -> Column:
        before = F.get(segments, i - 1)
        after_verse = before["ev"].isNotNull() & (s["sc"] == before["ec"]) & s["kind"].isin(VERSE, VERSES, ACROSS)
        after_chapter = before["ev"].isNull() & s["kind"].isin(CHAPTER, CHAPTERS)
        return (
            F.when(i == 0, _full(s, cv, dash, omit_first))
            .when(after_verse | after_chapter, F.concat(F.lit(comma), _short(s, cv, dash, omit_first)))
            .otherwise(F.concat(F.lit(semicolon), _full(s, cv, dash, omit_first)))
        )

    return F.array_join(F.transform(segments, part), "")


def osis(code: Column, segments: Column) -> Column:
    """Space-separated OSIS references; null where the book has no code."""

    def one(s: Column) -> Column:
        start = F.concat(code, F.lit("."), _text(s["sc"]), F.when(s["kind"].isin(VERSE, VERSES, ACROSS), F.concat(F.lit("."), _text(s["sv"]))).otherwise(""))
        end = F.concat(F.lit("-"), code, F.lit("."), _text(s["ec"]), F.coalesce(F.concat(F.lit("."), _text(s["ev"])), F.lit("")))
        return F.when(s["kind"].isin(VERSE, CHAPTER), start).otherwise(F.concat(start, end))

    return F.when(code.isNotNull(), F.array_join(F.transform(segments, one), " "))


def usfm(code: Column, segments: Column) -> Column:
    return F.when(code.isNotNull(), F.array_join(F.transform(segments, lambda s: F.concat(code, F.lit(" "), _full(s))), "; "))


def segments_json(segments: Column) -> Column:
    """The JSON shape ``{"tag": "Verses"|"Chapters", "start", "end"}`` of each segment."""

    def one(s: Column) -> Column:
        whole = s["kind"].isin(CHAPTER, CHAPTERS)
        start = F.when(whole, _text(s["sc"])).otherwise(F.concat(F.lit('{"chapter":'), _text(s["sc"]), F.lit(',"verse":'), _text(s["sv"]), F.lit("}")))
        end = F.when(whole, _text(s["ec"])).otherwise(F.concat(F.lit('{"chapter":'), _text(s["ec"]), F.lit(',"verse":'), _text(s["ev"]), F.lit("}")))
        return F.concat(F.lit('{"tag":"'), F.when(whole, "Chapters").otherwise("Verses"), F.lit('","start":'), start, F.lit(',"end":'), end, F.lit("}"))

    return F.concat(F.lit("["), F.array_join(F.transform(segments, one), ","), F.lit("]"))


def extension(path: Column) -> Column:
    """Lower-case extension; none for dot files."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.nullif(F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1)), F.lit(""))


def parse_osis(text: Column, codes: Column) -> Column:
    """OSIS text as struct<book_id, segments>, null where it is not one book's references. ``codes`` maps code to book id."""
    points = F.filter(F.split(text, r"[\s,;]+"), lambda p: p != "")
    shape = r"^([^.\-]+)\.(\d{1,3})(?:\.(\d{1,3}))?(?:-([^.\-]+)\.(\d{1,3})(?:\.(\d{1,3}))?)?$"

    # Each point's groups are taken apart once; a point of another shape stays whole and has no sixth part.
    groups = F.transform(points, lambda p: F.when(p.contains("|"), F.array(p)).otherwise(F.split(F.regexp_replace(p, shape, "$1|$2|$3|$4|$5|$6"), r"\|")))

    def one(g: Column) -> Column:
        sc, sv, ec, ev = (F.nullif(F.get(g, F.lit(k)), F.lit("")).try_cast("int") for k in (1, 2, 4, 5))
        ranged = F.get(g, F.lit(3)) != ""
        last = F.when(ranged, ec).otherwise(sc)
        end = F.when(ranged, ev).otherwise(sv)
        good = (F.size(g) == 6) & (~ranged | (F.get(g, F.lit(3)) == F.get(g, F.lit(0)))) & ~(ranged & sv.isNotNull() & ev.isNull()) & (F.greatest(sc, sv, last, end) <= 255)
        return F.struct(F.when(good, F.try_element_at(codes, F.get(g, F.lit(0)))).alias("book"), make_segment(sc, F.coalesce(sv, F.lit(1)), last, end).alias("seg"))

    parsed = F.transform(groups, one)
    books = F.array_distinct(F.transform(parsed, lambda x: x["book"]))
    valid = (F.size(points) > 0) & (F.size(books) == 1) & F.element_at(books, 1).isNotNull()
    return F.when(valid, F.struct(F.element_at(books, 1).alias("book_id"), F.transform(parsed, lambda x: x["seg"]).alias("segments")))
