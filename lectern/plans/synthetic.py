"""Texts with references made from integer keys, and the SQL that computes the same references by arithmetic.

Verse counts come from a rule, so that both sides can compute them; names come from the books table.
A key is written in one of eight styles; the style says what must be found in it. ``style`` is an expression
in ``{key}``: with another one every key is written in the forms that a query tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..canon import Canon
from ..functions.grammar import roman_text
from ..tables import spread, table

N_BOOKS = 74


def n_chapters(b):
    """Chapters of a book: one in every thirteenth book, else 4 to 33."""
    return 1 if b % 13 == 0 else 4 + (b * 7) % 30


def n_verses(b, c):
    return 12 + (b * 3 + c * 5) % 28


def counts() -> dict[int, tuple[int, ...]]:
    return {b: tuple(n_verses(b, c) for c in range(1, n_chapters(b) + 1)) for b in range(1, N_BOOKS + 1)}


def canon(spark: SparkSession, sf_dir: str) -> Canon:
    return Canon.from_tables(table(spark, sf_dir, "default_books"), table(spark, sf_dir, "default_genres"), counts())


def canon_without_counts(spark: SparkSession, sf_dir: str) -> Canon:
    """For the documents, whose references follow no verse counts."""
    return Canon.from_tables(table(spark, sf_dir, "default_books"), table(spark, sf_dir, "default_genres"))


# The rule and the keys as expressions that Spark and DuckDB both read.
NCH = "(CASE WHEN {b} % 13 = 0 THEN 1 ELSE 4 + ({b} * 7) % 30 END)"
NV = "(12 + ({b} * 3 + {c} * 5) % 28)"


def _int(expression: str) -> str:
    return f"CAST(floor({expression}) AS INT)"


STYLE = "{key} % 8"


def key_columns(key: str, style: str | None = None) -> dict[str, str]:
    """``b, c, v, w, d, u, style`` of a key, as nested selects; each may use those before it."""
    return {
        "b": f"CAST(1 + {key} % {N_BOOKS} AS INT)",
        "style": f"CAST({(style or STYLE).format(key=key)} AS INT)",
        "c": f"CAST(1 + {_int(f'{key} / 7')} % {NCH.format(b='b')} AS INT)",
        "v": f"CAST(1 + {_int(f'{key} / 11')} % {NV.format(b='b', c='c')} AS INT)",
        "w": f"CAST(least({NV.format(b='b', c='c')}, v + 1 + {key} % 5) AS INT)",
        "d": f"CAST(1 + c % {NCH.format(b='b')} AS INT)",
        "u": f"CAST(1 + {_int(f'{key} / 3')} % {NV.format(b='b', c='d')} AS INT)",
    }


def _roman(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(roman_text(n)) for n in range(1, 34)]), c)


def ref_texts(spark: SparkSession, sf_dir: str, source: str = "orders", key: str = "o_orderkey", extra: tuple[str, ...] = (), style: str | None = None) -> DataFrame:
    """``k`` (the key), ``extra`` columns, ``style`` and ``ref``, the reference as text."""
    df = spread(table(spark, sf_dir, source).select(F.col(key).cast("bigint").alias("k"), *extra))
    for name, expression in key_columns("k", style).items():
        df = df.withColumn(name, F.expr(expression))
    books = table(spark, sf_dir, "default_books").select(F.col("id").alias("b"), "book", "abbreviation")
    df = df.join(books, "b")
    cv = F.concat(F.col("c").cast("string"), F.lit(":"), F.col("v").cast("string"))
    s = {n: F.col(n).cast("string") for n in ("c", "v", "w", "d", "u")}
    name = F.col("book")
    style = F.col("style")
    text = (
        F.when(style == 0, F.concat(name, F.lit(" "), cv)).when(style == 1, F.concat("abbreviation", F.lit(". "), cv, F.lit("-"), s["w"])).when(style == 2, F.concat(name, F.lit(" "), s["c"]))
        .when(style == 3, F.concat(name, F.lit(" "), cv, F.lit("ff"))).when(style == 4, F.concat(name, F.lit(" "), cv, F.lit("; "), s["d"])).when(style == 5, F.concat(name, F.lit(" "), s["c"], F.lit(":999")))
        .when(style == 6, F.concat(name, F.lit(" "), _roman(F.col("c")), F.lit(", "), s["v"])).otherwise(F.concat(name, F.lit(" "), cv, F.lit(" – "), s["d"], F.lit(":"), s["u"]))
    )
    return df.select("k", *extra, "style", text.alias("ref"))


def register_all(queries: dict, sql: dict, query, style: str) -> None:
    """Register ``query`` over the whole table: every key is written in the forms that the query tests, by ``style``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir, style=style)

    name = query.__name__
    run.__name__, run.__doc__ = name, query.__doc__ or name
    queries[name] = run
    old, new = (f"{key_columns('k', s)['style']} AS style" for s in (None, style))
    if old not in sql[name]:
        raise ValueError(f"{name} has no style in its SQL")
    sql[name] = sql[name].replace(old, new)


def documents_of(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """``k, style, text``: each reference in a sentence."""
    r = ref_texts(spark, sf_dir, **more)
    return r.select(*[c for c in r.columns if c != "ref"], F.concat(F.lit("They say, see "), "ref", F.lit(" today, and so on.")).alias("text"))


def segments_sql(source: str = "orders", key: str = "o_orderkey", extra: str = "") -> str:
    """CTEs ``keys`` and ``segs`` (``k, style, seg_no, book_id, kind, sc, sv, ec, ev``), by arithmetic alone."""
    more = f", {extra}" if extra else ""
    inner = f"SELECT CAST({key} AS BIGINT) AS k{more} FROM {source}"
    for name, expression in key_columns("k").items():
        inner = f"SELECT *, {expression} AS {name} FROM ({inner})"
    one = NCH.format(b="b") + " = 1"
    last = NV.format(b="b", c="c")
    null = "CAST(NULL AS INT)"
    # A number alone is a verse in a book of one chapter. A range backwards does not exist.
    parts = [
        f"SELECT k, style, 1 AS seg_no, b AS book_id, 0 AS kind, c AS sc, v AS sv, c AS ec, v AS ev FROM keys WHERE style = 0",
        f"SELECT k, style, 1, b, CASE WHEN v = w THEN 0 ELSE 1 END, c, v, c, w FROM keys WHERE style = 1",
        f"SELECT k, style, 1, b, CASE WHEN {one} THEN 0 ELSE 3 END, c, 1, c, CASE WHEN {one} THEN 1 ELSE {null} END FROM keys WHERE style = 2",
        f"SELECT k, style, 1, b, CASE WHEN v = {last} THEN 0 ELSE 1 END, c, v, c, {last} FROM keys WHERE style = 3",
        f"SELECT k, style, 1, b, 0, c, v, c, v FROM keys WHERE style = 4",
        f"SELECT k, style, 2, b, CASE WHEN {one} THEN 0 ELSE 3 END, d, 1, d, CASE WHEN {one} THEN 1 ELSE {null} END FROM keys WHERE style = 4",
        f"SELECT k, style, 1, b, 0, c, v, c, v FROM keys WHERE style = 6 AND NOT {one}",
        f"SELECT k, style, 1, b, CASE WHEN c <> d THEN 2 WHEN v = u THEN 0 ELSE 1 END, c, v, d, u FROM keys WHERE style = 7 AND (c < d OR (c = d AND v <= u))",
    ]
    return f"keys AS ({inner}),\nsegs AS ({' UNION ALL '.join(parts)})"


def position_sql(b: str, c: str, v: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform(range(1, {c}), lambda i: 12 + ({b} * 3 + i * 5) % 28)), 0) + {v} AS INT)"


def positions_sql(**more) -> str:
    """`segments_sql` and ``pos`` with ``pos_start, pos_end``."""
    end = f"coalesce(ev, {NV.format(b='book_id', c='ec')})"
    return segments_sql(**more) + f",\npos AS (SELECT *, {position_sql('book_id', 'sc', 'sv')} AS pos_start, {position_sql('book_id', 'ec', end)} AS pos_end FROM segs)"


def write_sql(source: str = "segs", keys: str = "k") -> str:
    """Segments of a reference as text, a continued chapter left out (``segs`` of at most two segments)."""
    full = "CASE kind WHEN 0 THEN sc || ':' || sv WHEN 1 THEN sc || ':' || sv || '-' || ev WHEN 2 THEN sc || ':' || sv || '-' || ec || ':' || ev ELSE CAST(sc AS VARCHAR) END"
    short = "CASE kind WHEN 0 THEN CAST(sv AS VARCHAR) ELSE sc || '' END"
    return (
        f"SELECT {keys}, book_id, string_agg(CASE WHEN seg_no = 1 THEN {full} WHEN p_ev IS NOT NULL AND sc = p_ec AND kind = 0 THEN ',' || {short} ELSE '; ' || {full} END, '' ORDER BY seg_no) AS written "
        f"FROM (SELECT *, lag(ev) OVER w AS p_ev, lag(ec) OVER w AS p_ec FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY seg_no)) GROUP BY {keys}, book_id"
    )
