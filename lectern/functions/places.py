"""Offsets of a text in bytes, characters and UTF-16 units, lines and columns. Pure Python."""

from __future__ import annotations

from bisect import bisect_right


class Places:
    """Positions of character offsets, asked for in any order; the text is measured once."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [0]
        at = text.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = text.find("\n", at + 1)
        self.ascii = text.isascii()
        if not self.ascii:
            # Bytes and UTF-16 units before every 256th character.
            self.marks = [(0, 0)]
            for i in range(0, len(text), 256):
                piece = text[i : i + 256]
                b, u = self.marks[-1]
                self.marks.append((b + len(piece.encode("utf-8", "surrogatepass")), u + len(piece.encode("utf-16-le", "surrogatepass")) // 2))

    def measure(self, at: int) -> tuple[int, int]:
        """Bytes and UTF-16 units before a character."""
        if self.ascii:
            return at, at
        k = at // 256
        piece = self.text[k * 256 : at]
        b, u = self.marks[k]
        return b + len(piece.encode("utf-8", "surrogatepass")), u + len(piece.encode("utf-16-le", "surrogatepass")) // 2

    def line(self, at: int) -> int:
        """Line from 1."""
        return bisect_right(self.lines, at)

    def columns(self, at: int) -> tuple[int, int, int]:
        """Columns from 1 in bytes, characters and UTF-16 units."""
        start = self.lines[self.line(at) - 1]
        b0, u0 = self.measure(start)
        b, u = self.measure(at)
        return b - b0 + 1, at - start + 1, u - u0 + 1

    def line_text(self, at: int) -> str:
        n = self.line(at)
        start = self.lines[n - 1]
        end = self.lines[n] - 1 if n < len(self.lines) else len(self.text)
        return self.text[start:end].rstrip("\r")

    def offset(self, line: int, utf16_column: int) -> int:
        """The character at a line and UTF-16 column from 0, as editors send them; both are clamped."""
        n = min(max(line, 0), len(self.lines) - 1)
        start = self.lines[n]
        end = self.lines[n + 1] - 1 if n + 1 < len(self.lines) else len(self.text)
        units = 0
        for i in range(start, end):
            if units >= utf16_column:
                return i
            units += 2 if ord(self.text[i]) > 0xFFFF else 1
        return end


def snippet(text: str, start: int, end: int, around: int = 100, slack: int = 20) -> tuple[str, int]:
    """Text around a hit, cut at word ends where one is near, with ``…``; and the hit's offset in it in UTF-16 units."""
    lo, hi = max(0, start - around), min(len(text), end + around)
    if lo:
        near = next((i for i in range(lo, min(lo + slack, start)) if text[i].isspace()), None)
        lo = near + 1 if near is not None else lo
    if hi < len(text):
        near = next((i for i in range(hi - 1, max(hi - slack, end) - 1, -1) if text[i].isspace()), None)
        hi = near if near is not None else hi
    head = "…" if lo else ""
    body = text[lo:hi].replace("\n", " ")
    before = head + body[: start - lo]
    return head + body + ("…" if hi < len(text) else ""), len(before.encode("utf-16-le", "surrogatepass")) // 2


def fnv1a64(data: bytes) -> int:
    """FNV-1a, 64 bits, as a signed number as Spark stores it."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h
