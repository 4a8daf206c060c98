"""Completion of a reference that is being typed: books, then chapters and verses, then translations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..canon import Canon, Translations, name_key
from . import grammar
from .notation import Format, write
from .refs import Finder

# Where a word begins; what stands right behind a point belongs to the word before it.
_WORD_START = re.compile(r"(?<![^\W_.])(?<!\.)[^\W_]")


@dataclass(frozen=True)
class Completion:
    """``label`` replaces ``text[start:end]`` by ``insert``."""

    label: str
    kind: str  # book, reference, translation
    start: int
    end: int
    insert: str
    book: int | None = None
    segments: tuple = ()


@dataclass(frozen=True)
class CompletionOptions:
    limit: int | None = None
    format: Format = Format()
    #: Whether a reference that is already written so is offered too.
    include_typed: bool = True


class Completer:
    def __init__(self, canon: Canon, translations: Translations | None = None):
        self.canon, self.translations = canon, translations
        self.finder = Finder(canon)

    def complete(self, text: str, cursor: int | None = None, options: CompletionOptions = CompletionOptions()) -> list[Completion]:
        cursor = len(text) if cursor is None else cursor
        typed = text[:cursor]
        base = typed.rfind("\n") + 1
        line = typed[base:]
        out = self._translations(line, base) + self._books(line, base, text[cursor:], options) + self._segments(line, base, options)
        kept = [c for c in out if (options.include_typed and c.segments) or c.insert.rstrip() != typed[c.start : c.end].rstrip()]
        return list(dict.fromkeys(kept))[: options.limit]

    def _translations(self, line: str, base: int) -> list[Completion]:
        if not self.translations:
            return []
        m = re.search(r"([^\W\d_][\w ]*)$", line)
        if not m:
            return []
        for start in (k for k in range(m.start(), len(line)) if k == m.start() or line[k - 1] == " "):
            word = line[start:]
            before = line[:start].rstrip(" ,;:([-–—/")
            found = self.finder.search(before)
            names = self.translations.starting_with(word) if word else []
            if names and found and found[-1].end == len(before):
                return [Completion(n, "translation", base + start, base + len(line), n) for n in names if n.lower() != word.lower()]
        return []

    def _books(self, line: str, base: int, behind: str, o: CompletionOptions) -> list[Completion]:
        """Books that the longest of the last three endings of words starts, by their shortest fitting spelling.

        Nothing is offered unless the last word has a letter: behind a number, numbers follow. A book is offered
        where the ending is one of its spellings, or starts its name, abbreviation or OSIS code; so an ordinary
        word that merely starts some longer spelling offers none.
        """
        last = line.split()[-1] if line.split() and not line[-1].isspace() else ""
        if not any(c.isalpha() for c in last):
            return []
        separator = o.format.book_separator
        # No second separator where the text goes on with one.
        go_on = "" if separator and (behind.startswith(separator) or (separator.isspace() and behind[:1] in (" ", "\t"))) else separator
        for start in [m.start() for m in _WORD_START.finditer(line)][-3:]:
            shortest: dict[int, tuple[int, str]] = {}
            written = line[start:]
            exact, prefix = self.canon.get(written), name_key(written)
            for key, book in self.canon.keys.items():
                if key.startswith(written.lower()) and (book == exact or any(n and name_key(n).startswith(prefix) for n in self._shown(book))):
                    shortest[book] = min(shortest.get(book, (999, "")), (len(key), key))
            if shortest:
                offered = []
                for book in sorted(shortest, key=shortest.get):
                    name = write(self.canon, book, [], Format(book=o.format.book, book_separator="")) or self.canon.by_id[book].name
                    if name.lower() != written.lower():
                        offered.append(Completion(name, "book", base + start, base + len(line), name + go_on, book))
                return offered
        return []

    def _shown(self, book: int) -> tuple:
        b = self.canon.by_id[book]
        return b.name, b.abbreviation, b.osis

    def _segments(self, line: str, base: int, o: CompletionOptions) -> list[Completion]:
        """What may follow: the next number of the segment that is being typed, narrowed by its digits."""
        found = None
        for m in self.finder._alone.finditer(line):
            found = m
        if found is None or (book := self.canon.get(found[0])) is None or not (counts := self.canon.chapters(book)):
            return []
        start = found.end()
        scan = grammar.scan(line, start)
        if line[scan.end :].strip() or (not scan.nodes and line[scan.end :]) and not line[start:].isspace():
            return []
        # Nodes that are complete, and the one that is being typed.
        nodes, current = (scan.nodes, None) if scan.trailing or not scan.nodes else (scan.nodes[:-1], scan.nodes[-1])
        if current is None and scan.nodes and not scan.trailing:
            return []
        done = grammar.resolve(nodes, counts)
        if done.used != len(nodes):
            return []
        reader = grammar.Reader(counts)
        for node, segment in zip(nodes, done.segments[-len(nodes) :] if nodes else [], strict=False):
            reader.went(node, segment)
        separator = current.separator if current else scan.trailing
        context = reader.inside(separator, grammar.behind_bare_chapter(reader.before, separator))
        typed = re.search(r"[0-9]*$", line)[0]
        # A bare Roman chapter becomes the chapter of its verse.
        before = done.segments[:-1] if context is not None and grammar.behind_bare_chapter(reader.before, separator) else done.segments
        out = []
        for s in self._numbers(current, context, counts, done.segments[-1] if done.segments else None):
            label = write(self.canon, book, [*before, s], o.format)
            # The number that is being typed narrows what is offered.
            if label and (not typed or re.findall(r"[0-9]+", label)[-1].startswith(typed)):
                out.append(Completion(label, "reference", base + found.start(), base + len(line), label, book, (*before, s)))
        return out

    def _numbers(self, node, context: int | None, counts: tuple[int, ...], last):
        def starting(n: int, top: int, least: int = 1) -> list[int]:
            """Numbers up to ``top`` that begin with the digits of ``n``."""
            return [k for k in range(least, top + 1) if str(k).startswith(str(n))]

        def length(c: int) -> int:
            return counts[c - 1] if 1 <= c <= len(counts) else 0

        if node is None:
            if context is not None:
                first = last[4] + 1 if last is not None and last[4] is not None else 1
                yield from (grammar.verses(context, v, context, v) for v in range(first, length(context) + 1))
            else:
                first = last[3] + 1 if last is not None else 1
                yield from (grammar.chapters(c, c) for c in range(first, len(counts) + 1))
            return
        parts = node.parts
        v, e, w = node.number("v"), node.number("e"), node.number("w")
        n = node.first.value
        sc, sv = (n, v.value if v else None) if v or context is None else (context, n)
        if not parts:
            if context is None:
                yield from (grammar.chapters(c, c) for c in starting(n, len(counts)))
            else:
                yield from (grammar.verses(context, k, context, k) for k in starting(n, length(context)))
        elif parts[-1].slot == "v":
            yield from (grammar.verses(n, k, n, k) for k in (starting(v.value, length(n)) if v else range(1, length(n) + 1)))
        elif parts[-1].slot == "e":
            if sv is not None:
                yield from (grammar.verses(sc, sv, sc, k) for k in (starting(e.value, length(sc), sv + 1) if e else range(sv + 1, length(sc) + 1)))
            else:
                yield from (grammar.chapters(sc, k) for k in (starting(e.value, len(counts), sc + 1) if e else range(sc + 1, len(counts) + 1)))
        elif e is not None:
            yield from (grammar.verses(sc, sv or 1, e.value, k) for k in (starting(w.value, length(e.value)) if w else range(1, length(e.value) + 1)))
