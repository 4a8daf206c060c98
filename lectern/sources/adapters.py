"""One shape for all formats: an adapter turns a document into searchable pieces and locates hits in them.

`extract_with` runs an adapter over a DataFrame. A document that cannot be read gives one row with an
``error`` and does not stop the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..canon import Canon
from ..functions.refs import Finder, Options
from ..operators.extract import SEGMENT, segments_array
from ..tables import spread

#: A piece: its text, and a function from a hit's (start, end) to the values of the adapter's columns (None drops the hit).
Piece = tuple[str, Callable[[int, int], tuple | None]]
Adapter = Callable[[Any], Iterable[Piece]]


def extract_with(df: DataFrame, canon: Canon, adapter: Adapter, columns: T.StructType, content: str = "content", keys: list[str] | None = None, options: Options = Options()) -> DataFrame:
    """``keys, ref_no, book_id, segments, written``, the adapter's columns, and ``error`` (null for hits)."""
    keys = [c for c in df.columns if c != content] if keys is None else keys
    shared = df.sparkSession.sparkContext.broadcast((canon, options))
    state: dict = {}
    n = len(keys)
    arrow = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64()}
    kinds = [arrow[f.dataType] for f in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "f" not in state:
            state["f"] = Finder(*shared.value)
        search = state["f"].search
        for batch in batches:
            at, numbers, books, segments, written, values, errors = [], [], [], [], [], [], []

            def add(i, k, book, segs, text, value, error):
                at.append(i), numbers.append(k), books.append(book), segments.append(segs), written.append(text), values.append(value), errors.append(error)  # noqa: B023

            for i, c in enumerate(batch.column(n).to_pylist()):
                k = 0
                try:
                    for text, locate in adapter(c):
                        for f in search(text):
                            value = locate(f.start, f.end)
                            if value is not None:
                                k += 1
                                add(i, k, f.book, f.segments, text[f.start : f.end], value, None)
                except Exception as e:  # noqa: BLE001 - a broken document is a row, not a failure
                    add(i, None, None, [], None, (None,) * len(kinds), f"{type(e).__name__}: {e}"[:500])
            picked = pa.array(at, pa.int32())
            located = list(zip(*values, strict=True)) if values else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(picked) for c in range(n)]
                + [pa.array(numbers, pa.int32()), pa.array(books, pa.int32()), segments_array(segments), pa.array(written, pa.string())]
                + [pa.array(v, kind) for v, kind in zip(located, kinds, strict=True)]
                + [pa.array(errors, pa.string())],
                names=[*keys, "ref_no", "book_id", "segments", "written", *columns.names, "error"],
            )

    own = [T.StructField("ref_no", T.IntegerType()), T.StructField("book_id", T.IntegerType()), T.StructField("segments", T.ArrayType(SEGMENT)), T.StructField("written", T.StringType())]
    schema = T.StructType([df.schema[k] for k in keys] + own + list(columns) + [T.StructField("error", T.StringType())])
    return spread(df.where(F.col(content).isNotNull()).select(*keys, content)).mapInArrow(run, schema)
