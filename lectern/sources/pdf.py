"""PDF pages: the schema of hits, and the text by whatever reader is installed (none is required)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import types as T

from ..functions.places import Places
from .adapters import Piece

COLUMNS = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("locator", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("line_text", T.StringType())])

#: A reader gives, for a file's bytes, each page as lines ``(text, (left, bottom, right, top))``; an empty text parts blocks.
Reader = Callable[[bytes], Iterable[list[tuple[str, tuple[float, float, float, float]]]]]


class NoReader(RuntimeError):
    """No PDF reader is installed."""


def pieces_with(reader: Reader | None):
    """An adapter over a reader. Hits are placed by page and by the rectangle of their first line."""

    def pieces(data: bytes) -> Iterable[Piece]:
        if reader is None:
            raise NoReader("install a PDF reader and pass it")
        for number, page in enumerate(reader(data), 1):
            text = "\n".join(t for t, _ in page)
            boxes = [b for _, b in page]
            places = Places(text)

            def locate(a: int, b: int, number=number, boxes=boxes, places=places) -> tuple:
                line = places.line(a)
                box = boxes[line - 1] if line <= len(boxes) else None
                rect = "&rect=" + ",".join(str(round(x)) for x in box) if box else ""
                return number, f"page={number}{rect}", line, places.line_text(a)

            yield text, locate

    return pieces
