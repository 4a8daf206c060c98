"""Scopes and filters of references, as Catalyst predicates.

A filter's passages are few and stand in the plan as literals; a scope becomes ``book_id IN (...)``,
which prunes partitions and row groups of stored references. Filtering what an unfiltered extraction
found gives the same rows as a filtered search, so extractions can be stored and shared.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..canon import Canon, CanonError
from ..functions import columns as C
from ..functions.grammar import Segment, segment_order
from ..functions.notation import spans as literal_spans
from .algebra import with_spans

# Ways to write a testament, and its books.
_TESTAMENTS = {"o": (1, 39), "ot": (1, 39), "old": (1, 39), "old testament": (1, 39), "n": (40, 66), "nt": (40, 66), "new": (40, 66), "new testament": (40, 66)}


def testament(name: str) -> tuple[int, int]:
    found = _TESTAMENTS.get(name.strip().lower().replace("_", " "))
    if found is None:
        raise CanonError(f"unknown testament: {name}")
    return found


@dataclass(frozen=True)
class BookScope:
    """Books by testament, genre and name: testaments narrow, genres and books add up, exclusions take away."""

    testaments: tuple[str, ...] = ()
    genres: tuple[str, ...] = ()
    books: tuple[str, ...] = ()
    exclude_testaments: tuple[str, ...] = ()
    exclude_genres: tuple[str, ...] = ()
    exclude_books: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, values: dict) -> BookScope:
        """From snake or camel case names; an unknown field is an error."""
        snake = {re.sub(r"(?<=[a-z])([A-Z])", r"_\1", k).lower(): tuple(v or ()) for k, v in values.items()}
        if unknown := set(snake) - {f.name for f in fields(cls)}:
            raise CanonError(f"unknown scope field: {sorted(unknown)}")
        return cls(**snake)

    def resolve(self, canon: Canon) -> frozenset[int] | None:
        """The books in scope; None for all."""
        if not any(getattr(self, f.name) for f in fields(self)):
            return None
        every = set(canon.by_id)

        def of(testaments, genres, books) -> set[int]:
            out = {i for n in testaments for i in every if testament(n)[0] <= i <= testament(n)[1]}
            return out.union(*(canon.genre_books(g) for g in genres), {canon.find(b) for b in books})

        kept = of(self.testaments, (), ()) if self.testaments else every
        if self.genres or self.books:
            kept &= of((), self.genres, self.books)
        return frozenset(kept - of(self.exclude_testaments, self.exclude_genres, self.exclude_books))


Passage = tuple[int, "list[Segment]"]


@dataclass(frozen=True)
class RefFilter:
    """Which references are kept.

    The passages that include are joined by OR: inside one, sharing a verse with one, naming a verse of
    one (whole chapters of the reference do not count), or equal to one. Then what shares a verse with an
    excluded passage goes. ``verses_only`` drops references that name no verse; ``single_chapter_books``
    False also drops all of books with one chapter. ``translations`` need the column of that name.
    """

    scope: BookScope = BookScope()
    inside: tuple[Passage, ...] = ()
    any_overlap: tuple[Passage, ...] = ()
    explicit_overlap: tuple[Passage, ...] = ()
    exact: tuple[Passage, ...] = ()
    exclude_overlap: tuple[Passage, ...] = ()
    verses_only: bool = False
    single_chapter_books: bool = True
    translations: tuple[str, ...] = field(default=())

    def inclusions(self) -> tuple[Passage, ...]:
        return self.inside + self.any_overlap + self.explicit_overlap + self.exact

    def possible_books(self, canon: Canon) -> frozenset[int] | None:
        """The only books a kept reference can be in; None for any."""
        books = self.scope.resolve(canon)
        if self.inclusions():
            named = frozenset(b for b, _ in self.inclusions())
            books = named if books is None else books & named
        return books

    def contradiction(self, canon: Canon) -> str | None:
        """Why nothing can be kept, if so."""
        books = self.scope.resolve(canon)
        if books is not None and not books:
            return "no book is in scope"
        if self.possible_books(canon) == frozenset():
            return "no passage to keep is in a book in scope"
        for b, segments in self.inside:
            for eb, excluded in self.exclude_overlap:
                from ..functions.notation import covers

                if b == eb and len(self.inclusions()) == 1 and covers(excluded, segments, canon.chapters(b)):
                    return "every verse to keep is excluded"
        return None

    def predicate(self, canon: Canon, spans: Column, explicit_spans: Column) -> Column:
        keep = F.lit(True)
        books = self.possible_books(canon)
        book = F.col("book_id")
        if books is not None:
            keep &= book.isin(*sorted(books)) if books else F.lit(False)
        if self.verses_only:
            named = F.size(C.explicit_only(F.col("segments"))) > 0
            if not self.single_chapter_books:
                ones = sorted(i for i in canon.by_id if len(canon.chapters(i) or ()) == 1)
                named &= ~book.isin(*ones) if ones else F.lit(True)
            keep &= named
        if self.inclusions():
            tests = [_with(canon, p, lambda o, s=spans: C.spans_contain(o, s)) for p in self.inside]
            tests += [_with(canon, p, lambda o, s=spans: C.spans_overlap(o, s)) for p in self.any_overlap]
            tests += [_with(canon, p, lambda o, s=explicit_spans: C.spans_overlap(o, s)) for p in self.explicit_overlap]
            tests += [_with(canon, p, lambda o, s=spans: C.spans_contain(o, s) & C.spans_contain(s, o)) for p in self.exact]
            keep &= reduce(lambda a, b: a | b, tests)
        for p in self.exclude_overlap:
            keep &= ~_with(canon, p, lambda o, s=spans: C.spans_overlap(o, s))
        if self.translations:
            keep &= F.coalesce(F.lower("translation").isin(*[t.lower() for t in self.translations]), F.lit(False))
        return keep

    def apply(self, refs: DataFrame, canon: Canon) -> DataFrame:
        """``refs`` filtered; the book test comes first, so that it reaches the scan."""
        columns = refs.columns
        books = self.possible_books(canon)
        if books is not None:
            refs = refs.where(F.col("book_id").isin(*sorted(books)) if books else F.lit(False))
        spanned = with_spans(refs, canon, "_spans")
        if self.explicit_overlap:
            explicit = with_spans(spanned.withColumn("_all", F.col("segments")).withColumn("segments", C.explicit_only(F.col("segments"))), canon, "_explicit")
            spanned = explicit.withColumn("segments", F.col("_all"))
        else:
            spanned = spanned.withColumn("_explicit", F.col("_spans"))
        return spanned.where(self.predicate(canon, F.col("_spans"), F.col("_explicit"))).select(*columns)


def _with(canon: Canon, passage: Passage, test) -> Column:
    """A test against a passage's spans, which stand in the plan as literals."""
    book, segments = passage
    literal = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in literal_spans(segments, canon.chapters(book))])
    return (F.col("book_id") == book) & test(literal)


def structural_overlap(a: Column, b: Column) -> Column:
    """Whether two segments share a verse by their numbers alone, without counts."""
    def start(s: Column) -> Column:
        return s["sc"] * 1000 + s["sv"]

    def end(s: Column) -> Column:
        return s["ec"] * 1000 + F.coalesce(s["ev"], F.lit(999))

    return (start(a) <= end(b)) & (start(b) <= end(a))


def structural_contains(a: Column, b: Column) -> Column:
    """Whether one segment holds another by their numbers alone; segments are not united first."""
    return (a["sc"] * 1000 + a["sv"] <= b["sc"] * 1000 + b["sv"]) & (b["ec"] * 1000 + F.coalesce(b["ev"], F.lit(999)) <= a["ec"] * 1000 + F.coalesce(a["ev"], F.lit(999)))


def auto_verses(filters: RefFilter, chapters: bool = False) -> RefFilter:
    """A search's default: whole chapters are dropped unless asked for, or unless only chapters are filtered by."""
    wanted = filters.inclusions()
    only_chapters = bool(wanted) and all(s[0] >= 3 for _, segments in wanted for s in sorted(segments, key=segment_order))
    from dataclasses import replace

    return filters if chapters or only_chapters else replace(filters, verses_only=True)


# --- paths ----------------------------------------------------------------------------------------


def glob_regex(glob: str) -> str:
    """A gitignore-like glob as a regular expression over whole paths; one without ``/`` matches any name."""
    anchored = "/" in glob.rstrip("/")
    body, i = "", 0
    g = glob.strip("/")
    while i < len(g):
        c = g[i]
        if g.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
            continue
        if g.startswith("**", i):
            body, i = body + ".*", i + 2
            continue
        if c == "*":
            body += "[^/]*"
        elif c == "?":
            body += "[^/]"
        elif c == "[" and (j := g.find("]", i + 2)) > 0:
            inner = g[i + 1 : j]
            body += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = j
        elif c == "{" and (j := g.find("}", i)) > 0:
            body += "(?:" + "|".join(re.escape(x) for x in g[i + 1 : j].split(",")) + ")"
            i = j
        elif c == "\\" and i + 1 < len(g):
            i += 1
            body += re.escape(g[i])
        else:
            body += re.escape(c)
        i += 1
    return f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if glob.endswith('/') else '(?:/.*)?'}$"


@dataclass(frozen=True)
class PathFilter:
    """Files by folder or path, glob (``!`` excludes, ``\\!`` is a plain one), regular expression and extension."""

    paths: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    regexes: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = ()
    ignore_case: bool = False

    def predicate(self, path: Column) -> Column:
        keep = F.lit(True)
        if self.paths:
            keep &= reduce(lambda a, b: a | b, [(path == p.rstrip("/")) | path.startswith(p.rstrip("/") + "/") for p in self.paths])
        flag = "(?i)" if self.ignore_case else ""
        take = [g for g in self.globs if not g.startswith("!")]
        drop = [g[1:] for g in self.globs if g.startswith("!")]
        if take:
            keep &= reduce(lambda a, b: a | b, [path.rlike(flag + glob_regex(g)) for g in take])
        for g in drop:
            keep &= ~path.rlike(flag + glob_regex(g))
        if self.regexes:
            keep &= reduce(lambda a, b: a | b, [path.rlike(r) for r in self.regexes])
        ext = C.extension(path)
        if self.extensions:
            keep &= F.coalesce(ext.isin(*[e.lower().lstrip(".") for e in self.extensions]), F.lit(False))
        if self.exclude_extensions:
            keep &= ~F.coalesce(ext.isin(*[e.lower().lstrip(".") for e in self.exclude_extensions]), F.lit(False))
        return keep
