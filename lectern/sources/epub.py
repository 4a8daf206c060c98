"""EPUB: content documents in reading order as searchable text, hits as canonical fragment identifiers (CFI)."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.entities import name2codepoint
from urllib.parse import quote, unquote
from xml.etree import ElementTree as ET

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.places import Places
from .adapters import Piece

#: Limits on what a container may unpack to.
FILE_BYTES, TOTAL_BYTES, ENTRIES = 256 << 20, 1 << 30, 200_000
# Elements without searched text, and those kept apart from the text around them.
SKIPPED = frozenset("script style template head title noscript".split())
BLOCKS = frozenset("address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul img".split())
_SPACE = " \n\t\r\x0c "
_APART = "\n\n"
_XML_NAMES = {"amp", "lt", "gt", "quot", "apos"}

COLUMNS = T.StructType(
    [T.StructField("cfi", T.StringType()), T.StructField("spine_index", T.IntegerType()), T.StructField("href", T.StringType()), T.StructField("chapter", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("text_utf16_start", "text_utf16_end", "line", "utf16_column")]
    + [T.StructField("line_text", T.StringType())]
)


class EpubError(ValueError):
    pass


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def parse_xml(data: bytes | str) -> ET.Element:
    """XML, with the entities of HTML that browsers know put in where the document does not declare them."""
    if isinstance(data, bytes):
        data = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", "replace")
    try:
        return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", data))
    except ET.ParseError:
        filled = re.sub(r"&([A-Za-z][A-Za-z0-9]*);", lambda m: m[0] if m[1] in _XML_NAMES or m[1] not in name2codepoint else f"&#{name2codepoint[m[1]]};", data)
        return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>|<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?[^>]*>", "", filled))


def resolve(base: str, href: str) -> str:
    """A reference from an archive path to one; what has a scheme stays, the fragment is kept."""
    href = href.strip("\x00\t\n\r ")
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", href):
        return href
    path, hash_, fragment = href.partition("#")
    path = unquote(path.partition("?")[0]).replace("\\", "/")
    joined = base if not path else posixpath.normpath(posixpath.join("/", "" if path.startswith("/") else posixpath.dirname(base), path.lstrip("/") if not path.startswith("/") else path)).lstrip("/")
    return joined + hash_ + fragment


class Container:
    """An EPUB's archive. A file that is too large, or too much altogether, is refused while it is unpacked."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        if len(self.zip.namelist()) > ENTRIES:
            raise EpubError("too many entries")
        self.left = TOTAL_BYTES
        self.names = set(self.zip.namelist())
        folded: dict[str, list[str]] = {}
        for n in self.names:
            folded.setdefault(n.lower(), []).append(n)
        self.folded = {k: v[0] for k, v in folded.items() if len(v) == 1}
        root = parse_xml(self.read("META-INF/container.xml") or b"<x/>")
        full = next((e.get("full-path") for e in root.iter() if _local(e) == "rootfile" and e.get("full-path")), None)
        if full is None:
            raise EpubError("no package document")
        self.opf_path = full
        self.opf = parse_xml(self.read(full) or b"")
        self.items = {e.get("id"): e for e in self.opf.iter() if _local(e) == "item" and e.get("id")}

    def read(self, name: str) -> bytes | None:
        found = name if name in self.names else self.folded.get(name.lower())
        if found is None:
            return None
        out = []
        size = 0
        with self.zip.open(found) as f:
            while chunk := f.read(1 << 16):
                size += len(chunk)
                self.left -= len(chunk)
                if size > FILE_BYTES or self.left < 0:
                    raise EpubError(f"{name} unpacks to too much")
                out.append(chunk)
        return b"".join(out)

    def path(self, item: ET.Element) -> str | None:
        href = resolve(self.opf_path, item.get("href") or "").partition("#")[0]
        return href if href in self.names or href.lower() in self.folded else None

    def spine(self) -> Iterator[tuple[ET.Element, list[tuple[int, str | None]]]]:
        """Items in reading order with the CFI steps of their itemref."""
        for k, e in enumerate(self.opf, 1):
            if _local(e) == "spine":
                for j, ref in enumerate(e, 1):
                    if _local(ref) == "itemref" and (item := self.items.get(ref.get("idref"))) is not None:
                        yield item, [(2 * k, e.get("id")), (2 * j, ref.get("id") or ref.get("idref"))]
                return

    def titles(self) -> dict[str, str]:
        """The first entry of the table of contents that points into each document: EPUB 3's, else EPUB 2's."""
        nav = next((i for i in self.items.values() if "nav" in (i.get("properties") or "").split()), None)
        entries = self._entries(nav, self._nav) if nav is not None else []
        if not entries:
            toc = next((e.get("toc") for e in self.opf if _local(e) == "spine"), None)
            ncx = self.items.get(toc) if toc else None
            if ncx is None:
                ncx = next((i for i in self.items.values() if i.get("media-type") == "application/x-dtbncx+xml"), None)
            entries = self._entries(ncx, self._ncx) if ncx is not None else []
        out: dict[str, str] = {}
        for href, label in entries:
            path = href.partition("#")[0]
            if path and label:
                out.setdefault(path, label)
        return out

    def _entries(self, item, read) -> list[tuple[str, str]]:
        path = self.path(item)
        try:
            data = self.read(path) if path else None
            return list(read(parse_xml(data), path)) if data else []
        except ET.ParseError:
            return []

    @staticmethod
    def _words(e: ET.Element) -> str:
        return " ".join("".join(e.itertext()).split())

    def _nav(self, root: ET.Element, base: str) -> Iterator[tuple[str, str]]:
        navs = [e for e in root.iter() if _local(e) == "nav"]
        toc = next((e for e in navs if any(k.rpartition("}")[2] == "type" and "toc" in v.split() for k, v in e.attrib.items())), navs[0] if navs else None)
        for li in toc.iter() if toc is not None else ():
            if _local(li) != "li":
                continue
            a = next((c for c in li if _local(c) in ("a", "span")), None)
            if a is not None:
                yield resolve(base, a.get("href")) if a.get("href") else "", self._words(a) or a.get("title") or ""

    def _ncx(self, root: ET.Element, base: str) -> Iterator[tuple[str, str]]:
        for point in root.iter():
            if _local(point) != "navPoint":
                continue
            label = next((self._words(t) for c in point if _local(c) == "navLabel" for t in c.iter() if _local(t) == "text"), "")
            src = next((c.get("src") for c in point if _local(c) == "content"), None)
            yield resolve(base, src) if src else "", label


@dataclass
class _Run:
    start: int  # in the text, in characters
    end: int
    steps: tuple[tuple[int, str | None], ...]  # from the body to the text between elements
    source: str  # the run's own characters, for UTF-16 offsets
    utf16: int  # of its start, within the text between elements


class ContentText:
    """A content document's text: white space collapsed, blocks a blank line apart, ``br`` a line break; and the way back."""

    def __init__(self, root: ET.Element):
        found = next(((k, e) for k, e in enumerate(root, 1) if _local(e) == "body"), None)
        self.body_step, body = ((2 * found[0], found[1].get("id")), found[1]) if found else ((4, None), root)
        self.out: list[str] = []
        self.size = 0
        self.runs: list[_Run] = []
        self._space, self._break = False, None
        self._walk(body)
        self.text = "".join(self.out)
        self.starts = [r.start for r in self.runs]
        self.ends = [r.end for r in self.runs]

    def _walk(self, body: ET.Element) -> None:
        # (element, steps) entered, tails as (text, steps, chunk, UTF-16 units before it); a stack, so that depth is no limit
        stack: list[tuple] = [("in", body, ())]
        while stack:
            job = stack.pop()
            if job[0] == "text":
                self._add(*job[1:])
            elif job[0] == "break":
                self._break = _APART
            elif job[0] == "line":
                if self._break != _APART:
                    self._break = "\n"
            else:
                _, e, steps = job
                jobs: list[tuple] = [("text", e.text, steps, 1)]
                for k, child in enumerate(e, 1):
                    name = _local(child)
                    if name == "br":
                        jobs.append(("line",))
                    elif name and name not in SKIPPED:
                        edge = [("break",)] if name in BLOCKS else []
                        jobs += [*edge, ("in", child, (*steps, (2 * k, child.get("id")))), *edge]
                    jobs.append(("text", child.tail, steps, 2 * k + 1))
                stack += reversed(jobs)

    def _add(self, text: str | None, steps: tuple, chunk: int) -> None:
        if not text:
            return
        units = 0
        open_run: _Run | None = None
        lone = False  # the white space so far is one plain space of the open run
        for c in text:
            width = 2 if ord(c) > 0xFFFF else 1
            if c in _SPACE:
                lone = not self._space and c == " " and open_run is not None
                self._space = True
                units += width
                continue
            if self.size:
                if self._break:
                    self._put(self._break)
                    open_run = None
                elif self._space:
                    self._put(" ")
                    if open_run is not None and lone:
                        open_run.source += " "
                        open_run.end = self.size
                    else:
                        open_run = None
            self._break, self._space, lone = None, False, False
            if open_run is None:
                open_run = _Run(self.size, self.size, (*steps, (chunk, None)), "", units)
                self.runs.append(open_run)
            self._put(c)
            open_run.source += c
            open_run.end = self.size
            units += width

    def _put(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def point(self, at: int, is_end: bool) -> tuple[tuple, int]:
        """Steps below the body and the UTF-16 offset of a place; white space between runs goes to the nearer one."""
        k = bisect_left(self.starts, at) - 1 if is_end else bisect_right(self.ends, at)
        if not 0 <= k < len(self.runs):
            raise EpubError(f"no text at {at}")
        r = self.runs[k]
        inside = r.source[: max(0, min(at, r.end) - r.start)]
        return r.steps, r.utf16 + len(inside.encode("utf-16-le")) // 2


def _escape(s: str) -> str:
    return re.sub(r"([\^\[\](),;=])", r"^\1", s)


def write_cfi(package: list, body: tuple, start: tuple, end: tuple, assertions: bool = False) -> str:
    """A range CFI with the shared steps in front, or a point where both ends are one."""

    def full(point: tuple) -> list[tuple[int, str | None, bool]]:
        return [*((i, n, False) for i, n in package), (*body, True), *((i, n, False) for i, n in point[0])]

    def steps(path) -> str:
        return "".join(f"{'!' if jump else ''}/{i}" + (f"[{_escape(n)}]" if assertions and n else "") for i, n, jump in path)

    a, b = full(start), full(end)
    if [x[0] for x in a] == [x[0] for x in b] and start[1] == end[1]:
        return f"epubcfi({steps(a)}:{start[1]})"
    shared = 0
    while shared < min(len(a), len(b)) - 1 and a[shared][0] == b[shared][0] and a[shared][2] == b[shared][2]:
        shared += 1
    return f"epubcfi({steps(a[:shared])},{steps(a[shared:])}:{start[1]},{steps(b[shared:])}:{end[1]})"


def documents(data: bytes) -> Iterator[tuple[int, str, str | None, list, ContentText]]:
    """``(spine_index, href, chapter, package steps, text)`` of every readable content document."""
    book = Container(data)
    titles = book.titles()
    for index, (item, steps) in enumerate(book.spine()):
        path = book.path(item)
        raw = book.read(path) if path else None
        if raw is None:
            continue
        try:
            text = ContentText(parse_xml(raw.decode("utf-8", "replace") if raw[:2] not in (b"\xff\xfe", b"\xfe\xff") else raw))
        except ET.ParseError:
            continue
        yield index, path, titles.get(path), steps, text


def book_text(data: bytes) -> str:
    """The whole book as its hits' lines and offsets count it: a blank line after each document."""
    return "".join(t.text + _APART for *_, t in documents(data))


def pieces(data: bytes, assertions: bool = False) -> Iterable[Piece]:
    units = lines = 0
    for index, href, chapter, steps, content in documents(data):
        places = Places(content.text)

        def locate(a: int, b: int, index=index, href=href, chapter=chapter, steps=steps, content=content, places=places, units=units, lines=lines) -> tuple:
            cfi = write_cfi(steps, content.body_step, content.point(a, False), content.point(b, True) if b > a else content.point(a, False), assertions)
            return cfi, index, href, chapter, units + places.measure(a)[1], units + places.measure(b)[1], lines + places.line(a), places.columns(a)[2] - 1, places.line_text(a)

        yield content.text, locate
        units += places.measure(len(content.text))[1] + len(_APART)
        lines += content.text.count("\n") + 2


def wiki_link(path: Column, locator: Column, label: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(label, r"[|\[\]#^]", " "), r"\s+", " "))
    return F.concat(F.lit("[["), path, F.lit("#"), locator, F.when(clean != "", F.concat(F.lit("|"), clean)).otherwise(""), F.lit("]]"))


def markdown_link(path: Column, locator: Column, label: Column) -> Column:
    """Destinations are encoded as by `encodeURI`, and brackets and colons too."""

    def code(c: Column) -> Column:
        s = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
        for hex_, char in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%3B", ";"), ("%2F", "/"), ("%3F", "?"), ("%40", "@"), ("%26", "&"), ("%3D", "="), ("%2B", "+"), ("%24", "$"), ("%2C", ","), ("%23", "#")):
            s = F.replace(s, F.lit(hex_), F.lit(char))
        return s

    clean = F.replace(F.replace(F.trim(F.regexp_replace(label, r"\s+", " ")), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    return F.concat(F.lit("["), F.when(clean == "", path).otherwise(clean), F.lit("]("), code(path), F.lit("#"), code(locator), F.lit(")"))


def encode_destination(text: str) -> str:
    return quote(text, safe="-_.!~*';/?@&=+$,#")
