"""Functions for Spark SQL: parsing and writing single references, registered under their names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..canon import Canon
from ..operators.extract import SEGMENT
from .notation import Format, NotationError, osis, parse_osis, parse_usfm, usfm, write
from .refs import Finder, Options

REF = T.StructType([T.StructField("book_id", T.IntegerType()), T.StructField("segments", T.ArrayType(SEGMENT))])


_SPANS = "ARRAY<STRUCT<s: INT, e: INT>>"
#: Functions in SQL itself, which Catalyst puts into the plan: over positions (see `algebra.with_spans`).
SQL_FUNCTIONS = [
    f"CREATE OR REPLACE TEMPORARY FUNCTION refs_overlap(a {_SPANS}, b {_SPANS}) RETURNS BOOLEAN RETURN exists(a, x -> exists(b, y -> x.s <= y.e AND y.s <= x.e))",
    f"CREATE OR REPLACE TEMPORARY FUNCTION refs_contain(a {_SPANS}, b {_SPANS}) RETURNS BOOLEAN RETURN forall(b, y -> exists(a, x -> x.s <= y.s AND y.e <= x.e))",
    f"CREATE OR REPLACE TEMPORARY FUNCTION merge_refs(a {_SPANS}) RETURNS {_SPANS} RETURN aggregate(array_sort(a), CAST(array() AS {_SPANS}), (acc, x) -> "
    f"CASE WHEN size(acc) > 0 AND x.s <= coalesce(try_element_at(acc, -1).e, -9) + 1 THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', try_element_at(acc, -1).s, 'e', greatest(try_element_at(acc, -1).e, x.e)))) "
    f"ELSE concat(acc, array(x)) END)",
    "CREATE OR REPLACE TEMPORARY FUNCTION verse_pos(chapter INT, verse INT, lengths ARRAY<INT>) RETURNS INT RETURN "
    "aggregate(slice(lengths, 1, least(chapter - 1, size(lengths))), 0, (n, x) -> n + x) + greatest(chapter - 1 - size(lengths), 0) * 999 + verse",
    "CREATE OR REPLACE TEMPORARY FUNCTION bcv(book INT, chapter INT, verse INT) RETURNS INT RETURN book * 1000000 + chapter * 1000 + coalesce(verse, 999)",
]


def _finder(shared, state: dict) -> Finder:
    if "f" not in state:
        state["f"] = Finder(shared.value)
    return state["f"]


def _parser(spark: SparkSession, canon: Canon, read):
    shared = spark.sparkContext.broadcast(canon)
    state: dict = {}

    @F.pandas_udf(REF)
    def parse(texts: pd.Series) -> pd.DataFrame:
        f = _finder(shared, state)
        rows = []
        for t in texts:
            try:
                got = read(f, t) if t is not None else None
            except NotationError:
                got = None
            rows.append((None, None) if got is None else (got[0], [dict(zip(("kind", "sc", "sv", "ec", "ev"), s, strict=True)) for s in got[1]]))
        return pd.DataFrame(rows, columns=["book_id", "segments"])

    def call(c):
        got = parse(c)
        return F.when(got["book_id"].isNotNull(), got)

    call.udf = parse
    return call


def parse_ref(spark: SparkSession, canon: Canon, validate: bool = True):
    """Text to struct<book_id, segments>, null where there is no reference."""
    return _parser(spark, canon, lambda f, t: f.parse(t, validate))


def read_ref(spark: SparkSession, canon: Canon):
    """OSIS, USFM or plain text, or a book alone."""
    return _parser(spark, canon, lambda f, t: f.read(t))


def register(spark: SparkSession, canon: Canon) -> None:
    """`parse_ref`, `read_ref`, `parse_osis`, `parse_usfm`, `format_ref`, `to_osis`, `to_usfm`, the functions of SQL_FUNCTIONS, and the table function `extract_refs`."""
    shared = spark.sparkContext.broadcast(canon)
    for name, call in (
        ("parse_ref", parse_ref(spark, canon)), ("read_ref", read_ref(spark, canon)),
        ("parse_osis", _parser(spark, canon, lambda f, t: parse_osis(f.canon, t))), ("parse_usfm", _parser(spark, canon, lambda f, t: parse_usfm(f.canon, t))),
    ):
        spark.udf.register(name, call.udf)

    def writer(make):
        @F.pandas_udf("string")
        def run(refs: pd.DataFrame) -> pd.Series:
            c = shared.value
            out = []
            for b, segs in zip(refs["book_id"], refs["segments"], strict=True):
                out.append(None if segs is None or b is None or pd.isna(b) else make(c, int(b), [tuple(None if s[n] is None or pd.isna(s[n]) else int(s[n]) for n in ("kind", "sc", "sv", "ec", "ev")) for s in segs]))
            return pd.Series(out, dtype=object)

        return run

    spark.udf.register("format_ref", writer(lambda c, b, s: write(c, b, s, Format())))
    spark.udf.register("to_osis", writer(osis))
    spark.udf.register("to_usfm", writer(usfm))

    for statement in SQL_FUNCTIONS:
        spark.sql(statement)

    @F.udtf(returnType="ref_no int, book_id int, segments array<struct<kind:int,sc:int,sv:int,ec:int,ev:int>>, start_char int, end_char int, written string")
    class ExtractRefs:
        def __init__(self):
            self.finder = Finder(shared.value, Options())

        def eval(self, text: str):
            for k, f in enumerate(self.finder.search(text) if text else (), 1):
                yield k, f.book, list(f.segments), f.start, f.end, text[f.start : f.end]

    spark.udtf.register("extract_refs", ExtractRefs)
