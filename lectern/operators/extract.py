"""References of a documents DataFrame: one row per reference, segment, part or problem.

The unit of work is a document, so extraction is narrow: a canon and options go to the workers once
(their size is bounded by the number of book names), batches stream through `mapInArrow`, nothing is
shuffled. Everything behind it is Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..canon import Canon
from ..functions.places import Places
from ..functions.refs import Finder, Options
from ..tables import spread

SEGMENT = T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "sc", "sv", "ec", "ev")])
_PA_SEGMENT = pa.struct([(n, pa.int32()) for n in ("kind", "sc", "sv", "ec", "ev")])
_PA_SEGMENTS = pa.list_(_PA_SEGMENT)
_PLACES = ("start_char", "end_char", "start_byte", "end_byte", "start_utf16", "end_utf16", "line", "col_byte", "col_char", "col_utf16", "end_line", "end_col")


def _refs_schema(df: DataFrame, keys: list[str], located: bool) -> T.StructType:
    fields = [df.schema[k] for k in keys] + [T.StructField("ref_no", T.IntegerType()), T.StructField("book_id", T.IntegerType()), T.StructField("segments", T.ArrayType(SEGMENT))]
    if located:
        fields += [T.StructField(n, T.IntegerType()) for n in _PLACES] + [T.StructField("written", T.StringType()), T.StructField("translation", T.StringType())]
    return T.StructType(fields)


def segments_array(rows: list[list[tuple]]) -> pa.Array:
    """Lists of segment tuples as an Arrow array of structs."""
    offsets, flat = [0], []
    for r in rows:
        flat += r
        offsets.append(len(flat))
    columns = list(zip(*flat, strict=True)) if flat else [()] * 5
    structs = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], fields=list(_PA_SEGMENT))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def _finder(shared, state: dict) -> Finder:
    if "f" not in state:
        state["f"] = Finder(*shared.value)
    return state["f"]


def _documents(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    docs = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).cast("string").alias("_text"))
    return docs if docs.isStreaming else spread(docs)


def extract_refs(df: DataFrame, canon: Canon, text: str = "text", keys: list[str] | None = None, options: Options = Options(), located: bool = True) -> DataFrame:
    """``keys, ref_no, book_id, segments`` and, if ``located``, every offset, the written text and the translation.

    ``keys`` defaults to all other columns. Null texts have no references. References keep the order of
    the text; ``ref_no`` counts from 1 within a document.
    """
    keys = [c for c in df.columns if c != text] if keys is None else keys
    shared = df.sparkSession.sparkContext.broadcast((canon, options))
    state: dict = {}
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _finder(shared, state).search
        for batch in batches:
            source, numbers, books, segments, spots, written, named = [], [], [], [], [], [], []
            for i, t in enumerate(batch.column(n).to_pylist()):
                found = search(t, False)
                if not found:
                    continue
                places = Places(t) if located else None
                for k, f in enumerate(found, 1):
                    source.append(i)
                    numbers.append(k)
                    books.append(f.book)
                    segments.append(f.segments)
                    if located:
                        b0, u0 = places.measure(f.start)
                        b1, u1 = places.measure(f.end)
                        cb, cc, cu = places.columns(f.start)
                        spots.append((f.start, f.end, b0, b1, u0, u1, places.line(f.start), cb, cc, cu, places.line(f.end), places.columns(f.end)[1]))
                        written.append(t[f.start : f.end])
                        named.append(f.translation)
            at = pa.array(source, pa.int32())
            columns = [batch.column(c).take(at) for c in range(n)] + [pa.array(numbers, pa.int32()), pa.array(books, pa.int32()), segments_array(segments)]
            names = [*keys, "ref_no", "book_id", "segments"]
            if located:
                columns += [pa.array(c, pa.int32()) for c in (zip(*spots, strict=True) if spots else [()] * len(_PLACES))] + [pa.array(written, pa.string()), pa.array(named, pa.string())]
                names += [*_PLACES, "written", "translation"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return _documents(df, text, keys).mapInArrow(run, _refs_schema(df, keys, located))


def first_ref(df: DataFrame, canon: Canon, **more) -> DataFrame:
    """The first reference of every document."""
    return extract_refs(df, canon, **more).where("ref_no = 1")


def extract_parts(df: DataFrame, canon: Canon, text: str = "text", keys: list[str] | None = None, options: Options = Options()) -> DataFrame:
    """One row per written segment: where it stands, and where the end of its range does."""
    keys = [c for c in df.columns if c != text] if keys is None else keys
    shared = df.sparkSession.sparkContext.broadcast((canon, options))
    state: dict = {}
    n = len(keys)
    own = ("ref_no", "part_no", "book_id", "kind", "sc", "sv", "ec", "ev", "start_char", "end_char", "range_end_char")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _finder(shared, state).search
        for batch in batches:
            source, rows, written = [], [], []
            for i, t in enumerate(batch.column(n).to_pylist()):
                for k, f in enumerate(search(t), 1):
                    for j, (s, w) in enumerate(zip(f.segments, f.parts, strict=True), 1):
                        source.append(i)
                        rows.append((k, j, f.book, *s, *w))
                        written.append(t[w.start : w.end])
            columns = [pa.array(c, pa.int32()) for c in (zip(*rows, strict=True) if rows else [()] * len(own))]
            at = pa.array(source, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in range(n)] + columns + [pa.array(written, pa.string())], names=[*keys, *own, "written"])

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in own] + [T.StructField("written", T.StringType())])
    return _documents(df, text, keys).mapInArrow(run, schema)


def find_problems(df: DataFrame, canon: Canon, text: str = "text", keys: list[str] | None = None, options: Options = Options()) -> DataFrame:
    """References that are written like one but do not exist, with what does."""
    keys = [c for c in df.columns if c != text] if keys is None else keys
    shared = df.sparkSession.sparkContext.broadcast((canon, options))
    state: dict = {}
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        problems = _finder(shared, state).problems
        for batch in batches:
            rows = [(i, p.start, p.end, p.message, p.detail) for i, t in enumerate(batch.column(n).to_pylist()) for p in problems(t)]
            at, start, end, message, detail = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(at, pa.int32())) for c in range(n)] + [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(message, pa.string()), pa.array(detail, pa.string())],
                names=[*keys, "start_char", "end_char", "message", "detail"],
            )

    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("start_char", "end_char")] + [T.StructField(c, T.StringType()) for c in ("message", "detail")])
    return _documents(df, text, keys).mapInArrow(run, schema)


def explode_segments(refs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, seg_no, book_id, kind, sc, sv, ec, ev``, in written order."""
    return refs.select(*keys, "book_id", F.posexplode("segments").alias("p", "s")).select(*keys, (F.col("p") + 1).alias("seg_no"), "book_id", *[F.col(f"s.{n}").alias(n) for n in ("kind", "sc", "sv", "ec", "ev")])
