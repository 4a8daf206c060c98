"""HTML: the text a browser shows with a way back to the source, and text fragments."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.places import Places
from .adapters import Piece

# Elements that start a line.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_PIECE = re.compile(r"<(?P<close>/?)(?P<tag>[^\s>/]*)[^>]*>|<[^>]*$|&(?P<ref>[^;]{1,11});", re.S)
_EXACT_BYTES, _CONTEXT_WORDS = 300, 3


def _decode(name: str) -> str | None:
    if name in _NAMED:
        return _NAMED[name]
    m = re.fullmatch(r"#(?:[xX]([0-9a-fA-F]+)|([0-9]+))", name)
    if not m:
        return None
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


class Visible:
    """The visible text of a page. ``source`` and ``source_end`` lead from its characters to the page's."""

    def __init__(self, html: str):
        self.html = html
        out: list[str] = []
        # Runs of text: where each starts in the text, in the source, and its length in the source.
        self.starts: list[int] = []
        self.runs: list[tuple[int, int]] = []
        self.size = 0
        self._last = ""

        def put(text: str, at: int, length: int) -> None:
            if text:
                self.starts.append(self.size)
                self.runs.append((at, length))
                out.append(text)
                self.size += len(text)
                self._last = text[-1]

        i, n = 0, len(html)
        while i < n:
            m = _PIECE.search(html, i)
            if m is None:
                put(html[i:], i, n - i)
                break
            put(html[i : m.start()], i, m.start() - i)
            i = m.end()
            if m["ref"] is not None:
                c = _decode(m["ref"])
                if c is None:
                    put("&", m.start(), 1)
                    i = m.start() + 1
                else:
                    put(c, m.start(), m.end() - m.start())
                continue
            tag = (m["tag"] or "").lower()
            if tag in BLOCKS and self.size and not self._last.isspace():
                put("\n", m.start(), 0)
            if tag in ("script", "style") and not m["close"] and not m[0].endswith("/>"):
                end = re.compile(f"</{tag}", re.I).search(html, i)
                i = end.start() if end else n
        self.text = "".join(out)

    def source(self, at: int) -> int:
        """The page's character that a character of the text comes from."""
        if not self.starts:
            return 0
        k = bisect_right(self.starts, at) - 1
        start, length = self.runs[k]
        nxt = self.starts[k + 1] if k + 1 < len(self.starts) else self.size
        plain = nxt - self.starts[k] == length
        return start + (at - self.starts[k] if plain else 0)

    def source_end(self, end: int) -> int:
        """Behind the last character of a stretch, before tags that follow."""
        if end <= 0:
            return 0
        k = bisect_right(self.starts, end - 1) - 1
        start, length = self.runs[k]
        nxt = self.starts[k + 1] if k + 1 < len(self.starts) else self.size
        plain = nxt - self.starts[k] == length
        return start + (end - self.starts[k] if plain else length)


def visible_text(html: Column) -> Column:
    """The visible text alone, in Catalyst: for searches that need no way back."""
    blocks = "|".join(sorted(BLOCKS, key=len, reverse=True))
    s = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*(?<!/)>.*?(?=</\1|$)", "")
    s = F.regexp_replace(s, rf"(?i)(?<=[^\s>])((?:<[^>]*>)*)</?(?:{blocks})(?=[\s>/])[^>]*>", "$1\n")
    s = F.regexp_replace(s, r"(?s)<[^>]*(>|$)", "")
    s = F.regexp_replace(s, r"^\n+", "")
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        s = F.replace(s, F.lit(f"&{name};"), F.lit(c))
    return s


@dataclass(frozen=True)
class TextFragment:
    """``#:~:text=prefix-,start,end,-suffix``."""

    start: str
    end: str | None = None
    prefix: str | None = None
    suffix: str | None = None

    def encode(self) -> str:
        def code(s: str) -> str:
            return quote(s, safe="!'()*~._").replace("-", "%2D").replace(",", "%2C")

        parts = [f"{code(self.prefix)}-" if self.prefix else None, code(self.start), code(self.end) if self.end else None, f"-{code(self.suffix)}" if self.suffix else None]
        return "#:~:text=" + ",".join(p for p in parts if p)

    @classmethod
    def decode(cls, text: str) -> TextFragment | None:
        m = re.search(r":~:text=([^&]*)", text)
        if not m:
            return None
        parts = m[1].split(",")
        prefix = unquote(parts.pop(0)[:-1]) if len(parts) > 1 and parts[0].endswith("-") else None
        suffix = unquote(parts.pop()[1:]) if len(parts) > 1 and parts[-1].startswith("-") else None
        if not 1 <= len(parts) <= 2:
            return None
        return cls(unquote(parts[0]), unquote(parts[1]) if len(parts) == 2 else None, prefix, suffix)


def make_fragment(text: str, start: int, end: int, least_prefix: int = 0, least_suffix: int = 0) -> TextFragment | None:
    """A fragment for a stretch: its text, or its first and last words if long, with as much context as makes it unique."""
    words = text[start:end].split()
    if not words:
        return None
    body = " ".join(words)
    long = len(body.encode()) > _EXACT_BYTES
    first = " ".join(words[:_CONTEXT_WORDS]) if long else body
    last = " ".join(words[-_CONTEXT_WORDS:]) if long else None
    flat = " ".join(text.split())
    left, right = text[:start].split(), text[end:].split()
    p = s = 0

    def unique() -> bool:
        return flat.count(" ".join([*left[len(left) - p :], first]).strip()) == 1 if p or s else False

    known = False
    while (not known or p < least_prefix or s < least_suffix) and (p < len(left) or s < len(right)):
        before = p + s
        if p < len(left) and (p < least_prefix or (not known and p <= s)):
            p += 1
        if s < len(right) and (s < least_suffix or (not known and s < p)):
            s += 1
        if p + s == before:
            p, s = (p + 1, s) if p < len(left) else (p, s + 1)
        known = known or unique()
    return TextFragment(first, last, " ".join(left[len(left) - p :]) or None if p else None, " ".join(right[:s]) or None)


def find_fragment(text: str, f: TextFragment) -> tuple[int, int] | None:
    """The stretch that a fragment names, whatever the white space."""

    def folded(s: str) -> str:
        return r"\s+".join(map(re.escape, s.split()))

    core = folded(f.start) + (rf"(?s:.*?){folded(f.end)}" if f.end else "")
    pattern = (rf"{folded(f.prefix)}\s*" if f.prefix else "") + f"(?P<core>{core})" + (rf"\s*{folded(f.suffix)}" if f.suffix else "")
    m = re.search(pattern, text)
    return m.span("core") if m else None


COLUMNS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("source_start", "source_end", "line", "col")] + [T.StructField("fragment", T.StringType())])


def pieces(html: str) -> Iterable[Piece]:
    page = Visible(html)
    places = Places(html)

    def locate(start: int, end: int) -> tuple | None:
        a, b = page.source(start), page.source_end(end)
        fragment = make_fragment(page.text, start, end)
        if fragment is None:
            raise ValueError("no text fragment")
        return a, b, places.line(a), places.columns(a)[1], fragment.encode()

    yield page.text, locate
