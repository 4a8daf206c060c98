"""JSON and XML: strings of a document searched each by itself, hits located by pointer or path."""

from __future__ import annotations

import json
from collections.abc import Iterable
from xml.etree import ElementTree

from pyspark.sql import types as T

from .adapters import Piece

JSON_COLUMNS = T.StructType([T.StructField("pointer", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
XML_COLUMNS = T.StructType([T.StructField("path", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def json_pieces(text: str) -> Iterable[Piece]:
    """Every string value (no keys), in order of the document, with its RFC 6901 pointer."""
    todo: list[tuple[str, object]] = [("", json.loads(text))]
    while todo:
        pointer, value = todo.pop()
        if isinstance(value, str):
            yield value, lambda a, b, p=pointer: (p, a, b)
        elif isinstance(value, dict):
            todo += reversed([(f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}", v) for k, v in value.items()])
        elif isinstance(value, list):
            todo += reversed([(f"{pointer}/{i}", v) for i, v in enumerate(value)])


def xml_pieces(text: str) -> Iterable[Piece]:
    """All text nodes joined by line breaks; a hit is placed in the deepest element that holds it."""
    # Comments and instructions part text nodes, though their own text is not searched.
    root = ElementTree.fromstring(text, ElementTree.XMLParser(target=ElementTree.TreeBuilder(insert_comments=True, insert_pis=True)))
    nodes: list[tuple[int, tuple]] = []  # where each text node starts, and its chain of elements
    out: list[str] = []
    size = 0

    def name(e) -> str:
        return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    # Elements are entered and left from a stack, so depth is no limit.
    stack: list[tuple] = [("enter", root, (root,), (name(root),))]
    paths = {root: f"/{name(root)}"}

    def put(s: str | None, chain: tuple) -> None:
        nonlocal size
        if s:
            if size:
                out.append("\n")
                size += 1
            nodes.append((size, chain))
            out.append(s)
            size += len(s)

    while stack:
        what, e, chain, _ = stack.pop()
        if what == "tail":
            put(e.tail, chain)
            continue
        put(e.text if isinstance(e.tag, str) else None, chain)
        totals: dict[str, int] = {}
        for child in e:
            totals[name(child)] = totals.get(name(child), 0) + 1
        seen: dict[str, int] = {}
        later = []
        for child in e:
            n = name(child)
            seen[n] = seen.get(n, 0) + 1
            paths[child] = f"{paths[e]}/{n}" + (f"[{seen[n]}]" if totals[n] > 1 else "")
            later += [("enter", child, (*chain, child), ()), ("tail", child, chain, ())]
        stack += reversed(later)
    starts = [s for s, _ in nodes]

    def locate(a: int, b: int) -> tuple:
        from bisect import bisect_right

        first = nodes[max(0, bisect_right(starts, a) - 1)][1]
        last = nodes[max(0, bisect_right(starts, b - 1) - 1)][1]
        element = next(x for x in reversed(first) if any(x is y for y in last))
        start = next(s for s, chain in nodes if any(x is element for x in chain))
        return paths[element], a - start, b - start

    yield "".join(out), locate
