"""Extraction, parsing and notations on single texts."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.canon import CanonError, Translations, trie_pattern
from lectern.functions import grammar
from lectern.functions.complete import Completer, CompletionOptions
from lectern.functions.notation import Format, NotationError, join_adjacent, osis, parse_osis, parse_usfm, spans, usfm, write, write_segments
from lectern.functions.places import Places, fnv1a64, snippet
from lectern.functions.refs import Finder, Options, parse_segments


def found(finder, text: str) -> str:
    return " | ".join(f"{finder.canon.by_id[f.book].name} {write_segments(f.segments)}" for f in finder.search(text))


# How a segment may be written: (text of chapter, verses ...) by kind, for any numbers that exist.
_JOINTS = {"plain": (":", "-", ",", "; "), "points": (".", "\u2013", ", ", "; "), "spaced": (": ", " - ", " , ", " ;  "), "dashes": (":", "\u2014", ",\n", ";\n")}


def _written(rnd: random.Random, counts, style: str) -> tuple[str, list]:
    """A random list of segments of one book in a written style, and what they are."""
    colon, dash, comma, semicolon = _JOINTS[style]
    text, segments, inside = "", [], None
    for k in range(rnd.randint(1, 4)):
        c = rnd.randint(1, len(counts))
        n = counts[c - 1]
        first = rnd.randint(1, n)
        last = rnd.randint(first, n)
        shape = rnd.choice(["verse", "verses", "chapter", "chapters", "across", "bare"])
        if shape == "bare" and inside is None:
            shape = "verse"
        if shape == "bare":
            text += comma + str(v := rnd.randint(1, counts[inside - 1]))
            segments.append(grammar.verses(inside, v, inside, v))
            continue
        text += semicolon if k else ""
        if shape == "verse":
            text += f"{c}{colon}{first}"
            segments.append(grammar.verses(c, first, c, first))
        elif shape == "verses":
            text += f"{c}{colon}{first}{dash}{last}"
            segments.append(grammar.verses(c, first, c, last))
        elif shape == "chapter" or (shape in ("chapters", "across") and c == len(counts)):
            text += str(c)
            segments.append(grammar.chapters(c, c))
        elif shape == "chapters":
            text += f"{c}{dash}{c + 1}"
            segments.append(grammar.chapters(c, c + 1))
        else:
            text += f"{c}{colon}{first}{dash}{c + 1}{colon}{(v := rnd.randint(1, counts[c]))}"
            segments.append(grammar.verses(c, first, c + 1, v))
        inside = None if segments[-1][4] is None else segments[-1][3]
    return text, segments


@pytest.mark.parametrize("style", list(_JOINTS))
def test_every_written_form_is_found(finder, style):
    rnd = random.Random(style)
    long = [b for b in (40, 41, 43, 45, 49, 54)]
    for _ in range(120):
        book = rnd.choice(long)
        counts = finder.canon.chapters(book)
        text, segments = _written(rnd, counts, style)
        names = [k for k, i in finder.canon.keys.items() if i == book and k not in finder.canon.ambiguous]
        name = rnd.choice(names).title()
        (f,) = finder.search(f"so {name} {text}) and no more")
        assert (f.book, list(f.segments)) == (book, segments), (name, text)


ONE = {  # each rule by one text written for it
    "book of one chapter": ("Jude 9 and Jude 11-12", "Jude 1:9 | Jude 1:11-12"), "a verse that does not exist ends it": ("Romans 5:2,90,3", "Romans 5:2"), "a chapter that does not exist": ("Ephesians 7:1", ""),
    "a point may end a sentence": ("read Romans 9. 40 people came", "Romans 9"), "long numbers are no verses": ("Romans 9:5-450", "Romans 9:5"), "years": ("Romans 9:5, 1987", "Romans 9:5"), "parts of verses": ("Romans 9:5b-6a", "Romans 9:5-6"),
    "the next verse": ("Romans 9:5f", "Romans 9:5-6"), "the rest": ("Romans 9:30ff.", "Romans 9:30-33"), "no next verse": ("Romans 9:33f", "Romans 9:33"), "old style": ("Romans. ix, 12", "Romans 9:12"), "Roman chapters": ("Romans IX:3", "Romans 9:3"), "no Roman verses": ("Romans 9:x", ""),
    "one book after another": ("Romans 9:2; 1 John 3:1 or Mk 1", "Romans 9:2 | 1 John 3:1 | Mark 1"), "number of the next book": ("Romans 9:2, 3 Jn 4", "Romans 9:2 | 3 John 1:4"), "hyphen at a line's end": ("Ro-\nmans 9:2", "Romans 9:2"), "soft hyphen": ("Ro\u00admans 9:2", "Romans 9:2"),
    "blank line": ("Romans 9:2,\n\n4", "Romans 9:2"), "quantities": ("Romans 9:2, 7 % of", "Romans 9:2"), "ambiguous in small letters": ("it is 4 by now", ""), "ambiguous, written as a name": ("Is 4:2", "Isaiah 4:2"), "mixed case": ("rOMANS 9:2", ""), "glued": ("Rom9:2", "Romans 9:2"), "part of a word": ("Promans 9:2", ""), "nothing": ("none here", ""),
}


@pytest.mark.parametrize("rule", list(ONE))
def test_rules(finder, rule):
    text, want = ONE[rule]
    assert found(finder, text) == want


def test_long_tokens_are_no_text(finder):
    assert found(finder, "q" * 80 + "=Rom/Romans 9:2") == "" and found(finder, "q" * 80 + " Romans 9:2") == "Romans 9:2"


def test_offsets_lead_back_to_the_original(finder):
    text = "Deu­x see Ephe-\n  sians 2:8-9, then"
    (f,) = finder.search(text)
    assert text[f.start : f.end] == "Ephe-\n  sians 2:8-9"


def test_parts(finder):
    text = "so John 3:16; 4:5-7 is"
    (f,) = finder.search(text)
    assert [text[p.start : p.end] for p in f.parts] == ["John 3:16", "4:5-7"]
    assert text[f.parts[1].range_end] == "7" and f.parts[0].range_end is None


def test_context(canon):
    by_book = Finder(canon, Options(context_book=43))
    assert found(by_book, "In 4:6 and 9:99, at 5 or John 2:1 and 3:2") == "John 4:6 | John 2:1 | John 3:2"
    heads = Finder(canon, Options(heading=r"^# {book}$"))
    assert found(heads, "2:1\n# Romans\n8:2\n# John\n3:4") == "Romans 8:2 | John 3:4"
    assert found(Finder(canon, Options(books_alone=True)), "In Jude. and is, Romans 2:1; Mark 99 John") == "Jude 1 | Romans 2:1 | John 1-21"


def test_translations(canon):
    tr = Translations(("OXB", "MRV"), (("old", "OXB"),), {("OXB", 64): (15,)})
    f = Finder(canon, Options(translations=tr))
    got = [(write_segments(x.segments), x.translation) for x in f.search("Mark 2:5 (mrv), Mark 2:6 old; Mark 2:7 - see MRV\n3 John 15 OXB and 3 John 15")]
    assert got == [("2:5", "MRV"), ("2:6", "OXB"), ("2:7", None), ("1:15", "OXB")]
    assert f.parse_translated("mk 2:5 old") == (41, [(0, 2, 5, 2, 5)], "OXB")
    assert f.problems("3 John 1:16 OXB")[0].message == "3 John 1:16 does not exist in the OXB"


def test_problems(finder):
    text = "John 3:99, Mark 2:3; 40:1 and Jude 1:280 but Mark 25, 2025"
    got = [(p.message, p.detail) for p in finder.problems(text)]
    assert got == [("John 3:99 does not exist", "John 3 has 36 verses"), ("Mark 40:1 does not exist", "Mark has 16 chapters"), ("Jude 1:280 does not exist", "Jude 1 has 25 verses")]


def test_parse(finder):
    assert finder.parse("is 3") == (23, [(3, 3, 1, 3, None)])
    assert finder.parse("Jude") == (65, [(3, 1, 1, 1, None)])
    assert finder.parse("Jude 5", validate=False) == (65, [(3, 5, 1, 5, None)])
    assert finder.parse("John 3:99") is None and finder.parse("nothing") is None
    assert finder.read("John.3.16-John.3.18") == (43, [(1, 3, 16, 3, 18)])
    assert finder.read("jhn 3:16; 4") == (43, [(0, 3, 16, 3, 16), (3, 4, 1, 4, None)])
    assert parse_segments("3:16, 18") == [(0, 3, 16, 3, 16), (0, 3, 18, 3, 18)] and parse_segments("word") is None


@pytest.mark.parametrize("text", ["", "John", "Jn.3.16", "John.3.16-Rom.1.1", "John.3 Rom.1", "John.x", "John.3.16-John.4"])
def test_osis_rejects(canon, text):
    with pytest.raises(NotationError):
        parse_osis(canon, text)


@pytest.mark.parametrize("text", ["John.3.16", "John.3", "John.3-John.4", "John.3.16-John.3.18", "John.3.16-John.4.2 John.5"])
def test_osis_and_usfm_round_trip(canon, text):
    book, segs = parse_osis(canon, text)
    assert osis(canon, book, segs) == text
    assert parse_usfm(canon, usfm(canon, book, segs)) == (book, segs)


def test_format(canon, finder):
    def w(text, **more):
        return write(canon, *finder.parse(text), Format(**more))

    assert w("jn 3:16-18; 4") == "John 3:16-18; 4"
    assert w("Jude 1") == "Jude 1:1" and w("Jude 1-25") == "Jude" and w("John") == "John"
    assert w("Jude 5, 7-9", chapter_in_single_chapter_books=False) == "Jude 5,7-9"
    assert w("John 1-2:3", omit_first_verse_of_chapter_range=True) == "John 1-2:3" and w("John 1-2:3") == "John 1:1-2:3"
    assert w("John 3:16, 17, 18; 4, 5", join_adjacent=True) == "John 3:16-18; 4-5"
    assert w("John 3:16", book="osis", book_separator="_", chapter_verse=".") == "John_3.16"
    assert join_adjacent([(0, 3, 16, 3, 16), (0, 3, 18, 3, 18)]) == [(0, 3, 16, 3, 16), (0, 3, 18, 3, 18)]
    with pytest.raises(NotationError):
        Format.from_dict({"nope": 1})


def test_canon_patches(canon):
    with pytest.raises(CanonError):
        canon.merged({"books": [{"id": 70, "book": "Mark Two", "abbreviations": ["Mk"]}]})
    with pytest.raises(CanonError):
        canon.merged({"books": [{"book": "Unknown"}]})
    more = canon.merged({"books": [{"id": 67, "book": "Tobit", "abbreviation": "Tob"}, {"book": "John", "abbreviations": ["Johannes"]}, {"id": 45, "book": "Römer"}], "genres": [{"title": "Gospels", "books": ["Tobit"]}], "chapter_verses": {"Tobit": [22, 14]}})
    assert more.get("johannes") == 43 and more.get("Romans") == 45 and more.by_id[45].name == "Römer" and 67 in more.genre_books("New") and more.last_verse(67, 2) == 14
    less = more.removed({"books": [{"book": "Tobit"}, {"book": "John", "abbreviations": ["Johannes"]}], "genres": [{"title": "Letters"}]})
    assert less.get("Tobit") is None and less.get("johannes") is None and less.get("John") == 43
    with pytest.raises(CanonError):
        less.removed({"books": [{"book": "Tobit"}]})
    assert canon.genre_books("gos") == {40, 41, 43} and canon.genre_books("new") == {40, 41, 43, 45, 49}


def test_completion(canon):
    """Books by the word that is being typed, then what may follow, narrowed by the digits typed so far."""
    c = Completer(canon, Translations(("OXB", "MRV"), (("old", "OXB"),)))
    labels = lambda t, **o: [x.label for x in c.complete(t, None, CompletionOptions(**o))]
    assert labels("Eph")[:3] == ["Ephesians", "Ephesians 1", "Ephesians 2"] and labels("as in Ma") == ["Mark", "Matthew"] and labels("mk")[:2] == ["Mark", "Mark 1"]
    assert labels("so") == ["Song of Solomon"] and labels("Solomon") == [] and labels("of") == [] and labels("") == []
    assert labels("Romans 1") == ["Romans 1", *(f"Romans 1{k}" for k in range(7))] and labels("Romans 1", include_typed=False)[0] == "Romans 10"
    assert labels("Romans 16:2") == ["Romans 16:2", *(f"Romans 16:2{k}" for k in range(8))] and labels("Mark 16:", limit=2) == ["Mark 16:1", "Mark 16:2"]
    assert labels("Eph 2:5-")[:2] == ["Ephesians 2:5-6", "Ephesians 2:5-7"] and labels("Eph 2,")[0] == "Ephesians 2,3" and labels("Eph 2:5,")[0] == "Ephesians 2:5,6" and labels("Eph 2:5; 3-")[0] == "Ephesians 2:5; 3-4"
    assert labels("Jude 24")[0] == "Jude 1:24" and labels("Jude 23-") == ["Jude 1:23-24", "Jude 1:23-25"] and labels("Mark. ix, 4")[0] == "Mark 9:4"
    assert labels("Eph 2:5,6-", format=Format(join_adjacent=True))[0] == "Ephesians 2:5-7" and labels("Eph 2:5", format=Format(book="abbreviation"))[0] == "Eph 2:5"
    assert labels("Mark 2:5 m")[0] == "MRV" and labels("Mark 2:5 (O")[0] == "OXB"

    def applied(text):
        x = c.complete(text.replace("|", ""), text.index("|"))[0]
        return text.replace("|", "")[: x.start] + x.insert + text.replace("|", "")[x.end :]

    assert applied("Ephe| 2:5") == "Ephesians 2:5" and applied("see Ephe|") == "see Ephesians " and applied("mk 2:5|, then") == "Mark 2:5, then" and applied("Ephe|\nnext") == "Ephesians \nnext"


def test_trie_is_the_longest_first_list(canon):
    flat = "|".join(re.escape(k) for k in sorted(canon.keys, key=len, reverse=True))
    text = "1 john 3 john song of songs 2 songs jn john marks psalms ps isaiah is 1 samson"
    a, b = (re.compile(rf"(?<![0-9A-Za-z_])(?:{p})", re.I) for p in (flat, trie_pattern(canon.keys)))
    assert [m[0] for m in a.finditer(text)] == [m[0] for m in re.compile(b.pattern, re.I).finditer(text)]
    both = re.compile(rf"(?<![0-9A-Za-z_])(?:{trie_pattern(canon.keys, cases=True)})")
    for t in (text, text.upper(), text.title(), text.replace("s", "\u017f").replace("k", "\u212a")):
        assert [m.span() for m in a.finditer(t)] == [m.span() for m in both.finditer(t)]


def test_places():
    text = "é 📖 Jn 3:16\nx"
    p = Places(text)
    assert p.measure(4) == (8, 5) and p.line(13) == 2 and p.columns(4) == (9, 5, 6) and p.offset(0, 5) == 4 and p.offset(9, 0) == 12
    assert fnv1a64(b"") == -3750763034362895579 and fnv1a64(b"a") == -5808556873153909620
    assert snippet("word " * 60 + "HIT" + " word" * 60, 300, 303)[0].startswith("…word")


_ALPHABET = st.sampled_from(["John", "Jn", "1 John", "is", "Jude", "Rom.", "3", "16", "99", "280", "4025", "x", "iv", "XL", " ", " ", ",", ";", ":", ".", "-", "–", "f", "ff", "a", "\n", "\n\n", "%", "­", "é", "漢", "́", "ESV", "("])


@settings(max_examples=400, deadline=None)
@given(st.lists(_ALPHABET, max_size=22).map("".join))
def test_invariants(finder, text):
    last = -1
    for f in finder.search(text):
        assert 0 <= f.start < f.end <= len(text) and f.start > last and text[f.end - 1].isalnum()
        assert all(grammar.exists(s, finder.canon.chapters(f.book)) for s in f.segments)
        assert len(f.parts) == len(f.segments) and f.parts[-1].end == f.end
        last = f.start
    scan = grammar.scan(text)
    assert all(not n.dangling for n in scan.nodes[:-1])


_VERSE = st.tuples(st.integers(1, 21), st.integers(1, 25))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(_VERSE, _VERSE).map(lambda p: grammar.verses(*min(p), *max(p))), min_size=1, max_size=6))
def test_written_references_parse_back(finder, segments):
    book = 43
    text = write(finder.canon, book, segments)
    assert finder.parse(text) == (book, segments)
    merged = spans(segments, finder.canon.chapters(book))
    assert merged == sorted(merged) and all(a[1] + 1 < b[0] for a, b in zip(merged, merged[1:], strict=False))
