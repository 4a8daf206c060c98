"""Reference data: books and their spellings, genres, verse counts, translations.

All of it is input (rows of tables, JSON), none is built in. A canon is a small driver-side object that
goes to the workers once; its relational form (`dims`) joins with DataFrames.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

#: Verse that ends a chapter of unknown length; larger than any verse.
END_OF_CHAPTER = 255
#: Length that a chapter of unknown length takes among positions.
UNKNOWN_LENGTH = 999
#: Spaces that may stand between the words of a book's name.
NAME_SPACES = " \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_SPACE_CLASS = f"[{NAME_SPACES}]"


class CanonError(ValueError):
    """Reference data that contradicts itself, or names what is not there."""


@dataclass(frozen=True)
class Book:
    id: int
    name: str
    abbreviation: str
    osis: str | None = None
    usfm: str | None = None
    aliases: tuple[str, ...] = ()
    ambiguous: tuple[str, ...] = ()


@dataclass(frozen=True)
class Genre:
    title: str
    aliases: tuple[str, ...] = ()
    books: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()


def name_key(name: str) -> str:
    """A name as it is looked up: lower case, plain spaces, no dots or spaces at its end."""
    return re.sub(_SPACE_CLASS, " ", name.lower()).strip().rstrip(".").strip()


# Characters that lower-case to another letter than their capital's: as case-insensitive patterns match them.
_MORE_CASES = {"k": "\u212a", "s": "\u017f", "\u00e5": "\u212b"}


def trie_pattern(keys: Iterable[str], cases: bool = False) -> str:
    """One pattern that matches the longest of the keys at a place; shared beginnings are factored out.

    With ``cases`` both cases of a letter are written out, which is faster than an insensitive pattern.
    """
    trie: dict = {}
    for key in keys:
        node = trie
        for c in key:
            node = node.setdefault(c, {})
        node[""] = {}

    def letter(c: str) -> str:
        if c == " ":
            return _SPACE_CLASS
        if cases and c.upper() != c and len(c.upper()) == 1:
            return f"[{re.escape(c)}{re.escape(c.upper())}{_MORE_CASES.get(c, '')}]"
        return re.escape(c)

    def write(node: dict) -> str:
        branches = [letter(c) + write(child) for c, child in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return f"{body}?" if "" in node else body

    # The greedy ``?`` after a node's children makes the longest key win, as in a list ordered by length.
    return write(trie) or r"(?!)"


_FIELD_NAMES = {
    "id": ("id", "num", "number", "book_id"),
    "book": ("book", "name", "title"),
    "abbreviation": ("abbreviation", "abbr", "abbrev"),
    "abbreviations": ("abbreviations", "abbrs", "aliases", "alternates"),
    "ambiguous": ("ambiguous",),
    "osis": ("osis",),
    "usfm": ("usfm",),
}


def _get(row: Mapping, what: str):
    return next((row[n] for n in _FIELD_NAMES[what] if n in row and row[n] is not None), None)


@dataclass(frozen=True)
class Canon:
    books: tuple[Book, ...] = ()
    genres: tuple[Genre, ...] = ()
    counts: Mapping[int, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        keys: dict[str, int] = {}
        owners: dict[str, str] = {}
        ids: dict[int, str] = {}
        ambiguous: set[str] = set()
        for b in self.books:
            if b.id in ids:
                raise CanonError(f"book id {b.id} is used by both {ids[b.id]} and {b.name}")
            ids[b.id] = b.name
            for name in (b.name, b.abbreviation, *b.aliases, *b.ambiguous):
                key = name_key(name) if name else ""
                if not key:
                    continue
                if keys.setdefault(key, b.id) != b.id:
                    raise CanonError(f"`{name}` would mean both {owners[key]} and {b.name}")
                owners[key] = b.name
            ambiguous.update(name_key(a) for a in b.ambiguous)
        make = object.__setattr__
        make(self, "keys", keys)
        make(self, "ambiguous", frozenset(ambiguous))
        make(self, "by_id", {b.id: b for b in self.books})
        make(self, "by_osis", {b.osis: b.id for b in self.books if b.osis})
        make(self, "by_usfm", {b.usfm.upper(): b.id for b in self.books if b.usfm})

    # --- building ---------------------------------------------------------------------------------

    @classmethod
    def build(cls, books: Iterable[Mapping], genres: Iterable[Mapping] = (), counts: Mapping | None = None) -> Canon:
        """A canon from rows. Verse counts go by book name or id; a genre's unknown names are skipped."""
        made = tuple(
            Book(int(_get(r, "id")), _get(r, "book"), _get(r, "abbreviation") or _get(r, "book"), _get(r, "osis"), _get(r, "usfm"), tuple(_get(r, "abbreviations") or ()), tuple(_get(r, "ambiguous") or ()))
            for r in books
        )
        kinds = tuple(Genre(r.get("title") or r["genre"], tuple(r.get("abbreviations") or ()), tuple(r.get("books") or ()), tuple(r.get("subcategories") or ())) for r in genres)
        canon = cls(made, kinds)
        return replace(canon, counts={canon.find(k) if isinstance(k, str) else int(k): tuple(v) for k, v in (counts or {}).items()})

    @classmethod
    def from_json(cls, text: str) -> Canon:
        data = json.loads(text)
        return cls.build(data.get("books", ()), data.get("genres", ()), data.get("chapter_verses") or data.get("counts"))

    @classmethod
    def from_tables(cls, books: DataFrame, genres: DataFrame | None = None, counts: Mapping | None = None, check_aliases: bool = True, limit: int = 100_000) -> Canon:
        """From the reference tables (a canon is small; a larger table than ``limit`` is refused).

        Aliases collected by hand may claim another row's spelling; with ``check_aliases`` the row whose
        own name, abbreviation or code it is keeps it, then the first row.
        """
        rows = [r.asDict(recursive=True) for r in books.limit(limit + 1).collect()]
        if len(rows) > limit:
            raise CanonError(f"more than {limit} books")
        rows.sort(key=lambda r: r["id"])
        if check_aliases:
            taken = {name_key(r[c]): r["id"] for r in reversed(rows) for c in ("usfm", "osis", "abbreviation", "book") if r.get(c)}
            for r in rows:
                for c in ("abbreviations", "ambiguous"):
                    r[c] = [a for a in r[c] or () if a and name_key(a) and taken.setdefault(name_key(a), r["id"]) == r["id"]]
            for r in rows:
                extra = [r[c] for c in ("osis", "usfm") if r.get(c) and taken.get(name_key(r[c])) == r["id"]]
                r["abbreviations"] = [*r["abbreviations"], *extra]
        kinds = [r.asDict(recursive=True) for r in genres.limit(limit + 1).collect()] if genres is not None else []
        return cls.build(rows, kinds, counts)

    def merged(self, patch: Mapping) -> Canon:
        """With a patch upserted: a book by id, else by any name; an old name stays as an alias; genres gain books; counts replace."""
        books = {b.id: b for b in self.books}
        for r in patch.get("books", ()):
            id_ = _get(r, "id")
            known = books.get(int(id_)) if id_ is not None else None
            if known is None and id_ is None:
                names = [n for n in (_get(r, "book"), _get(r, "abbreviation"), *(_get(r, "abbreviations") or ())) if n]
                known = next((books[i] for n in names if (i := self.keys.get(name_key(n))) is not None), None)
                if known is None:
                    raise CanonError(f"unknown book without an id: {_get(r, 'book')}")
            aliases = tuple(_get(r, "abbreviations") or ())
            if known is None:
                new = Book(int(id_), _get(r, "book"), _get(r, "abbreviation") or _get(r, "book"), _get(r, "osis"), _get(r, "usfm"), aliases, tuple(_get(r, "ambiguous") or ()))
            else:
                name = _get(r, "book") or known.name
                kept = (known.name,) if name != known.name else ()
                new = replace(
                    known, name=name, abbreviation=_get(r, "abbreviation") or known.abbreviation, osis=_get(r, "osis") or known.osis, usfm=_get(r, "usfm") or known.usfm,
                    aliases=tuple(dict.fromkeys((*known.aliases, *kept, *aliases))), ambiguous=tuple(dict.fromkeys((*known.ambiguous, *(_get(r, "ambiguous") or ())))),
                )
            books[new.id] = new
        genres = {g.title.lower(): g for g in self.genres}
        for r in patch.get("genres", ()):
            title = r.get("title") or r["genre"]
            old = genres.get(title.lower(), Genre(title))
            genres[title.lower()] = Genre(old.title, *[tuple(dict.fromkeys((*a, *(r.get(k) or ())))) for a, k in ((old.aliases, "abbreviations"), (old.books, "books"), (old.parts, "subcategories"))])
        canon = Canon(tuple(sorted(books.values(), key=lambda b: b.id)), tuple(genres.values()))
        new_counts = {canon.find(k) if isinstance(k, str) else int(k): tuple(v) for k, v in (patch.get("chapter_verses") or patch.get("counts") or {}).items()}
        return replace(canon, counts={**self.counts, **new_counts})

    def removed(self, patch: Mapping) -> Canon:
        """Without what a patch names: a bare entry goes as a whole, else only its listed values; unknown names are errors."""
        books = {b.id: b for b in self.books}
        for r in patch.get("books", ()):
            id_ = int(_get(r, "id")) if _get(r, "id") is not None else self.find(_get(r, "book"))
            if id_ not in books:
                raise CanonError(f"unknown book: {r}")
            values = {name_key(v) for c in ("abbreviations", "ambiguous") for v in _get(r, c) or ()}
            if not values:
                del books[id_]
                continue
            b = books[id_]
            if unknown := values - {name_key(a) for a in (*b.aliases, *b.ambiguous)}:
                raise CanonError(f"{b.name} has no {sorted(unknown)}")
            books[id_] = replace(b, aliases=tuple(a for a in b.aliases if name_key(a) not in values), ambiguous=tuple(a for a in b.ambiguous if name_key(a) not in values))
        genres = {g.title.lower(): g for g in self.genres}
        for r in patch.get("genres", ()):
            title = (r.get("title") or r["genre"]).lower()
            if title not in genres:
                raise CanonError(f"unknown genre: {title}")
            gone = {c: set(r.get(c) or ()) for c in ("abbreviations", "books", "subcategories")}
            g = genres[title]
            if any(gone.values()):
                genres[title] = Genre(g.title, tuple(a for a in g.aliases if a not in gone["abbreviations"]), tuple(a for a in g.books if a not in gone["books"]), tuple(a for a in g.parts if a not in gone["subcategories"]))
            else:
                del genres[title]
        return Canon(tuple(books.values()), tuple(genres.values()), {i: c for i, c in self.counts.items() if i in books})

    # --- lookups ----------------------------------------------------------------------------------

    def get(self, name: str) -> int | None:
        return self.keys.get(name_key(name))

    def find(self, name: str) -> int:
        if (found := self.get(name)) is None:
            raise CanonError(f"unknown book: {name}")
        return found

    def chapters(self, book: int) -> tuple[int, ...] | None:
        return self.counts.get(book)

    def last_verse(self, book: int, chapter: int) -> int | None:
        c = self.counts.get(book)
        return c[chapter - 1] if c and 1 <= chapter <= len(c) else None

    def genre_books(self, name: str) -> frozenset[int]:
        """Books of a genre, by title or alias, with those of the genres it names."""
        index = {}
        for g in self.genres:
            for n in (g.title, *g.aliases):
                index.setdefault(n.strip().lower(), g)
        if name.strip().lower() not in index:
            raise CanonError(f"unknown genre: {name}")
        out, todo, seen = set(), [name.strip().lower()], set()
        while todo:
            n = todo.pop()
            if n in seen or n not in index:
                continue
            seen.add(n)
            out |= {i for b in index[n].books if (i := self.get(b)) is not None}
            todo += [p.strip().lower() for p in index[n].parts]
        return frozenset(out)

    # --- relational form --------------------------------------------------------------------------

    def dim_books(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(b.id, b.name, b.abbreviation, b.osis, b.usfm, len(self.counts.get(b.id, ())) or None) for b in self.books], "book_id int, name string, abbreviation string, osis string, usfm string, n_chapters int")

    def dim_keys(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, i, k in self.ambiguous) for k, i in self.keys.items()], "key string, book_id int, ambiguous boolean")

    def dim_chapters(self, spark: SparkSession) -> DataFrame:
        rows = []
        for id_, counts in self.counts.items():
            before = 0
            for c, n in enumerate(counts, 1):
                rows.append((id_, c, n, before))
                before += n
        return spark.createDataFrame(rows, "book_id int, chapter int, n_verses int, verses_before int")

    def dim_genres(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(g.title, i) for g in self.genres for i in sorted(self.genre_books(g.title))], "genre string, book_id int")


@dataclass(frozen=True)
class Translations:
    """Names that may follow a reference; the longest wins. Some have verse counts of their own."""

    names: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()
    counts: Mapping[tuple[str, int], tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        keys = {n.strip().lower(): n for n in self.names} | {a.strip().lower(): n for a, n in self.aliases}
        keys.pop("", None)
        object.__setattr__(self, "keys", keys)
        ordered = sorted(keys, key=lambda k: (-len(k), k))
        body = "|".join(re.escape(k) for k in ordered)
        object.__setattr__(self, "pattern", re.compile(rf"(?:{body})(?![^\W_])", re.I) if body else None)

    def get(self, name: str) -> str | None:
        return self.keys.get(name.strip().lower())

    def chapters(self, name: str, book: int) -> tuple[int, ...] | None:
        return self.counts.get((self.get(name) or name, book))

    def starting_with(self, typed: str) -> list[str]:
        t = typed.lower()
        ordered = dict.fromkeys((*self.names, *(n for _, n in self.aliases)))
        return [n for n in ordered if any(v == n and k.startswith(t) for k, v in self.keys.items())]
