"""Queries of extraction, interval algebra, filters, notations and orders over references made from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..canon import Translations
from ..functions import columns as C
from ..functions.grammar import chapters, verses
from ..functions.refs import Options
from ..operators import algebra, extract, filters, ordering
from ..tables import table
from . import synthetic as S

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, style: str | None = None):
    """``style``: every key is written in the forms that the query tests (`synthetic.register_all`)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        if style:
            S.register_all(QUERIES, ORACLE_SQL, f, style)
        return f

    return add


def _refs(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """``k, style, ref_no, book_id, segments`` of the texts made from orders."""
    return extract.extract_refs(S.documents_of(spark, sf_dir, **more), S.canon(spark, sf_dir), located=False)


def _segments(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return extract.explode_segments(_refs(spark, sf_dir, **more), ["k", "style"])


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.with_positions(_segments(spark, sf_dir), S.canon(spark, sf_dir))


# --- documents ------------------------------------------------------------------------------------


def document_refs(spark: SparkSession, sf_dir: str, located: bool = True) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extract.extract_refs(docs, S.canon_without_counts(spark, sf_dir), located=located)


# References as one pattern: a name, a number on the same or the next line, a colon after a name that is also a word.
_KEY = "trim(rtrim(trim(lower({})), '.'))"
_NAME_OF_HIT = _KEY.format(r"regexp_extract(hit, '^(.*?)\.?\s*[0-9]{1,3}(?:[:.]\s*[0-9])?$', 1)")
_DOCUMENT_HITS = rf"""
own AS (
  SELECT id, book AS name, 0 AS rank FROM default_books UNION ALL SELECT id, abbreviation, 0 FROM default_books UNION ALL SELECT id, osis, 0 FROM default_books UNION ALL SELECT id, usfm, 0 FROM default_books
  UNION ALL SELECT id, unnest(abbreviations), 1 FROM default_books),
keys AS (SELECT {_KEY.format('name')} AS key, id FROM own WHERE {_KEY.format('name')} <> '' QUALIFY row_number() OVER (PARTITION BY {_KEY.format('name')} ORDER BY rank, id) = 1),
amb AS (SELECT DISTINCT {_KEY.format('unnest(ambiguous)')} AS key FROM default_books),
pat AS (SELECT '(?i)(?:^|[^0-9A-Za-z_])((?:' || string_agg(regexp_escape(key), '|' ORDER BY length(key) DESC, key) || ')\.?[^\S\n]*\n?[^\S\n]*[0-9]{{1,3}}(?:[:.]\s*[0-9])?)' AS p FROM keys),
hits AS (SELECT doc_id, unnest(regexp_extract_all(text, (SELECT p FROM pat), 1)) AS hit FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, {_NAME_OF_HIT} AS key, hit LIKE '%:%' AS verse FROM hits),
found AS (SELECT doc_id, k.id AS book_id FROM parts JOIN keys k USING (key) WHERE verse OR key NOT IN (SELECT key FROM amb))
"""


@query(f"WITH {_DOCUMENT_HITS} SELECT book_id, any_value(b.book) AS book, count(*) AS refs, count(DISTINCT doc_id) AS documents FROM found JOIN default_books b ON b.id = book_id GROUP BY book_id")
def documents_book_counts(spark, sf_dir):
    """References and documents per book, over all documents."""
    refs = document_refs(spark, sf_dir, located=False)
    per_doc = refs.groupBy("book_id", "doc_id").agg(F.count("*").alias("n"))
    books = table(spark, sf_dir, "default_books").select(F.col("id").alias("book_id"), "book")
    return per_doc.groupBy("book_id").agg(F.sum("n").alias("refs"), F.count("*").alias("documents")).join(books, "book_id").select("book_id", "book", "refs", "documents")


@query()
def documents_refs(spark, sf_dir):
    """Every reference of every document with its places."""
    r = document_refs(spark, sf_dir)
    return r.select("doc_id", "ref_no", "book_id", C.write_segments(F.col("segments")).alias("segments"), "start_char", "end_char", "start_byte", "end_byte", "start_utf16", "end_utf16", "line", "col_utf16", "written")


@query(f"WITH {_DOCUMENT_HITS} SELECT doc_id, count(*) AS refs, count(DISTINCT book_id) AS books FROM found GROUP BY doc_id")
def documents_ref_counts(spark, sf_dir):
    """References and books of each document that has any."""
    refs = document_refs(spark, sf_dir, located=False)
    return refs.groupBy("doc_id").agg(F.count("*").alias("refs"), F.count_distinct("book_id").alias("books"))


@query("SELECT doc_id FROM documents WHERE text IS NULL OR trim(text) = ''")
def empty_documents_without_refs(spark, sf_dir):
    """Null and blank texts give no references (an anti-join keeps them all)."""
    docs = table(spark, sf_dir, "documents")
    blank = docs.where("text IS NULL OR trim(text) = ''").select("doc_id", "text")
    return ordering.files_without(blank, document_refs(spark, sf_dir, located=False), "doc_id").select("doc_id")


# --- extraction -----------------------------------------------------------------------------------


@query(f"WITH {S.segments_sql()} SELECT book_id, count(*) AS refs FROM segs WHERE seg_no = 1 GROUP BY book_id")
def extract_book_counts(spark, sf_dir):
    return _refs(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("refs"))


@query(f"WITH {S.segments_sql()} SELECT k, seg_no, book_id, kind, sc, sv, ec, ev FROM segs")
def extract_segments(spark, sf_dir):
    return _segments(spark, sf_dir).drop("style")


@query(f"WITH {S.segments_sql()} SELECT style, kind, count(*) AS n, count(DISTINCT k) AS docs FROM segs GROUP BY style, kind")
def extract_styles(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("style", "kind").agg(F.count("*").alias("n"), F.count_distinct("k").alias("docs"))


_SENTENCE = "'They say, see '"


@query(
    f"""WITH {S.segments_sql()}
SELECT k, 1 AS ref_no, length({_SENTENCE}) AS start_char, length({_SENTENCE}) AS start_byte, 1 AS line, length({_SENTENCE}) + 1 AS col_char,
  length({_SENTENCE}) + length(b.book || ' ' || sc || ':' || sv) AS end_char, b.book || ' ' || sc || ':' || sv AS written
FROM segs JOIN default_books b ON b.id = book_id WHERE style = 0""",
    style="0",
)
def extract_places(spark, sf_dir, style=None):
    """Offsets, lines and columns of references."""
    docs = S.documents_of(spark, sf_dir, style=style).where("style = 0")
    r = extract.extract_refs(docs, S.canon(spark, sf_dir), keys=["k"])
    return r.select("k", "ref_no", "start_char", "start_byte", "line", "col_char", "end_char", "written")


@query(
    f"""WITH {S.segments_sql()}
SELECT k, 2 AS line, 3 + 1 + 4 AS start_char, (1 + 4 + 1 + 1) + (2 + 2 + 1 + 1) AS start_byte, 3 + 1 + 4 + 1 AS start_utf16, 4 + 1 AS col_char, 4 + 2 + 1 AS col_byte, 4 + 1 AS col_utf16
FROM segs WHERE style = 0""",
    style="0",
)
def extract_utf16(spark, sf_dir, style=None):
    """Offsets in the three units behind characters of one to four bytes."""
    docs = S.ref_texts(spark, sf_dir, style=style).where("style = 0").select("k", F.concat(F.lit("a\U0001f4d6b\néé  "), "ref").alias("text"))
    r = extract.extract_refs(docs, S.canon(spark, sf_dir), keys=["k"])
    return r.select("k", "line", "start_char", "start_byte", "start_utf16", "col_char", "col_byte", "col_utf16")


@query(
    f"""WITH {S.segments_sql()}
SELECT k, 1 AS part_no, sc, sv, length({_SENTENCE}) AS start_char, b.book || ' ' || sc || ':' || sv AS written FROM segs JOIN default_books b ON b.id = book_id WHERE style = 4 AND seg_no = 1
UNION ALL SELECT k, 2, sc, sv, length({_SENTENCE}) + length(b.book || ' ' || (SELECT f.sc || ':' || f.sv FROM segs f WHERE f.k = s.k AND f.seg_no = 1) || '; '),
  CAST(CASE WHEN kind = 0 THEN sv ELSE sc END AS VARCHAR) FROM segs s JOIN default_books b ON b.id = book_id WHERE style = 4 AND seg_no = 2""",
    style="4",
)
def extract_parts(spark, sf_dir, style=None):
    """Where each segment of a reference is written."""
    docs = S.documents_of(spark, sf_dir, style=style).where("style = 4")
    return extract.extract_parts(docs, S.canon(spark, sf_dir), keys=["k"]).select("k", "part_no", "sc", "sv", "start_char", "written")


@query(
    f"""WITH {S.segments_sql()}
SELECT k, b.book || ' ' || c || ':999 does not exist' AS message, CASE WHEN true THEN b.book || ' ' || c || ' has ' || {S.NV.format(b="b", c="c").replace("b *", "keys.b *")} || ' verses' END AS detail
FROM keys JOIN default_books b ON b.id = keys.b WHERE style = 5""",
    style="5",
)
def problems(spark, sf_dir, style=None):
    """References that do not exist, with what does."""
    docs = S.documents_of(spark, sf_dir, style=style).where("style = 5")
    return extract.find_problems(docs, S.canon(spark, sf_dir), keys=["k"]).select("k", "message", "detail")


_NAMES = "CASE k % 3 WHEN 0 THEN 'ESV' WHEN 1 THEN 'KJV' END"


@query(f"WITH {S.segments_sql()} SELECT {_NAMES} AS translation, count(*) AS refs FROM segs WHERE style IN (0, 1) GROUP BY 1", style="{key} % 2")
def translation_counts(spark, sf_dir, style=None):
    """Translations named behind references, by an alias in every other case."""
    name = F.when(F.col("k") % 3 == 0, " (ESV)").when(F.col("k") % 3 == 1, F.when(F.col("k") % 2 == 0, ", av").otherwise(" KJV")).otherwise(" and more")
    docs = S.ref_texts(spark, sf_dir, style=style).where("style IN (0, 1)").select("k", F.concat(F.lit("see "), "ref", name).alias("text"))
    tr = Translations(("ESV", "KJV"), (("AV", "KJV"),))
    r = extract.extract_refs(docs, S.canon(spark, sf_dir), options=Options(translations=tr))
    return r.groupBy("translation").agg(F.count("*").alias("refs"))


@query(
    f"""WITH {S.segments_sql()}
SELECT k, book_id, sc, sv FROM segs WHERE style = 0
UNION ALL SELECT k, 1 + book_id % {S.N_BOOKS}, 1, 2 FROM segs WHERE style = 0""",
    style="0",
)
def heading_context(spark, sf_dir, style=None):
    """References without a book's name belong to the heading before them."""
    books = table(spark, sf_dir, "default_books").select((F.col("id")).alias("b2"), F.col("book").alias("next"))
    d = S.ref_texts(spark, sf_dir, style=style).where("style = 0")
    cv = F.regexp_extract("ref", r"(\d+:\d+)$", 1)
    name = F.regexp_replace("ref", r" \d+:\d+$", "")
    d = d.withColumn("b2", F.expr(f"CAST(1 + (1 + k % {S.N_BOOKS}) % {S.N_BOOKS} AS INT)")).join(books, "b2")
    docs = d.select("k", F.concat(F.lit("# "), name, F.lit("\n\nas in "), cv, F.lit(" here.\n\n# "), "next", F.lit("\n\nand 1:2 there.")).alias("text"))
    r = extract.extract_refs(docs, S.canon(spark, sf_dir), options=Options(heading=r"^#+ {book}$"), located=False)
    return extract.explode_segments(r, ["k"]).select("k", "book_id", "sc", "sv")


@query(f"WITH {S.segments_sql()} SELECT k, 43 AS book_id, 1 AS sc, CAST(1 + k % 12 AS INT) AS sv FROM keys WHERE style = 1", style="1")
def context_book(spark, sf_dir, style=None):
    """References without a name in a text about one book."""
    docs = S.ref_texts(spark, sf_dir, style=style).where("style = 1").select("k", F.concat(F.lit("At 7 he read 1:"), (1 + F.col("k") % 12).cast("string"), F.lit(" aloud.")).alias("text"))
    r = extract.extract_refs(docs, S.canon(spark, sf_dir), options=Options(context_book=43), located=False)
    return extract.explode_segments(r, ["k"]).select("k", "book_id", "sc", "sv")


@query(f"WITH {S.segments_sql()} SELECT k, b AS book_id, CASE WHEN {S.NCH.format(b='b')} = 1 THEN 3 ELSE 4 END AS kind, {S.NCH.format(b='b')} AS ec FROM keys WHERE style = 2", style="2")
def books_alone(spark, sf_dir, style=None):
    """Books named without a chapter, as whole books."""
    docs = S.ref_texts(spark, sf_dir, style=style).where("style = 2").select("k", F.concat(F.lit("All of "), F.regexp_replace("ref", r" \d+$", ""), F.lit(" is short.")).alias("text"))
    r = extract.extract_refs(docs, S.canon(spark, sf_dir), options=Options(books_alone=True), located=False)
    return extract.explode_segments(r, ["k"]).select("k", "book_id", "kind", "ec")


# --- positions, algebra ---------------------------------------------------------------------------


@query(f"WITH {S.positions_sql()} SELECT k, seg_no, pos_start, pos_end, book_id * 1000000 + sc * 1000 + sv AS bcv_start, book_id * 1000000 + ec * 1000 + coalesce(ev, 999) AS bcv_end FROM pos")
def positions(spark, sf_dir):
    return _positions(spark, sf_dir).select("k", "seg_no", "pos_start", "pos_end", "bcv_start", "bcv_end")


_ISLANDS = """
, m AS (SELECT book_id, pos_start, pos_end, max(pos_end) OVER (PARTITION BY book_id ORDER BY pos_start, pos_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pos),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR pos_start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY pos_start, pos_end ROWS UNBOUNDED PRECEDING) AS island FROM m)
"""


@query(f"WITH {S.positions_sql()}{_ISLANDS} SELECT book_id, min(pos_start) AS pos_start, max(pos_end) AS pos_end FROM g GROUP BY book_id, island")
def union_per_book(spark, sf_dir):
    """All references of a book united, as gaps and islands."""
    return algebra.islands(_positions(spark, sf_dir), ["book_id"])


@query(f"WITH {S.positions_sql()}{_ISLANDS}, i AS (SELECT book_id, min(pos_start) AS s, max(pos_end) AS e FROM g GROUP BY book_id, island) SELECT book_id, CAST(sum(e - s + 1) AS BIGINT) AS verses FROM i GROUP BY book_id")
def merged_verses(spark, sf_dir):
    """The canonical union per book, written as segments and counted in verses."""
    canon = S.canon(spark, sf_dir)
    merged = algebra.merge_refs(_segments(spark, sf_dir).select("book_id", "kind", "sc", "sv", "ec", "ev"), canon, [])
    return algebra.with_positions(merged, canon).groupBy("book_id").agg(F.sum(F.col("pos_end") - F.col("pos_start") + 1).cast("bigint").alias("verses"))


@query(f"WITH {S.positions_sql()}, v AS (SELECT book_id, unnest(generate_series(pos_start, pos_end)) AS pos FROM pos) SELECT book_id, CAST(pos AS INT) AS pos, count(*) AS n FROM v GROUP BY ALL")
def verse_heatmap(spark, sf_dir):
    """How many segments hold each verse."""
    return algebra.verse_counts(_positions(spark, sf_dir))


@query(
    f"""WITH {S.positions_sql()}, v AS (SELECT k, seg_no, book_id, unnest(generate_series(pos_start, pos_end)) AS pos FROM pos WHERE style IN (1, 7))
SELECT book_id, k, seg_no, count(*) AS verses FROM v GROUP BY ALL""",
    style="1 + 6 * ({key} % 2)",
)
def verse_list(spark, sf_dir, style=None):
    """Verses listed one by one, counted per segment."""
    v = algebra.verses(_segments(spark, sf_dir, style=style).where("style IN (1, 7)"), S.canon(spark, sf_dir), ["k"])
    return v.groupBy("book_id", "k", "seg_no").agg(F.count("*").alias("verses"))


@query(f"WITH {S.positions_sql()} SELECT a.book_id, count(*) AS pairs, CAST(sum(a.k) AS BIGINT) AS ks FROM pos a JOIN pos b ON a.book_id = b.book_id AND a.pos_start <= b.pos_end AND b.pos_start <= a.pos_end GROUP BY a.book_id")
def overlap_join(spark, sf_dir):
    """Pairs of segments that share a verse: all segments against all."""
    p = _positions(spark, sf_dir).select("k", "book_id", "pos_start", "pos_end")
    return algebra.interval_join(p, p).groupBy(F.col("l_book_id").alias("book_id")).agg(F.count("*").alias("pairs"), F.sum("l_k").alias("ks"))


_PASSAGES = "(43, 2, 5, 3, 4), (66, 1, 1, 2, 9), (10, 4, 3, 4, 20)"
_FILTER_SQL = f"WITH {S.positions_sql()}, f(book_id, sc, sv, ec, ev) AS (VALUES {_PASSAGES}), fp AS (SELECT book_id, {S.position_sql('book_id', 'sc', 'sv')} AS s, {S.position_sql('book_id', 'ec', 'ev')} AS e FROM f)"
_PASSAGE_LIST = ((43, [verses(2, 5, 3, 4)]), (66, [verses(1, 1, 2, 9)]), (10, [verses(4, 3, 4, 20)]))


@query(f"{_FILTER_SQL} SELECT k, seg_no FROM pos p WHERE EXISTS (SELECT 1 FROM fp WHERE fp.book_id = p.book_id AND s <= pos_end AND pos_start <= e)")
def overlap_semi_join(spark, sf_dir):
    p = _positions(spark, sf_dir)
    wanted = _passages_frame(spark, sf_dir)
    return algebra.interval_join(p, wanted, "left_semi", ["k", "seg_no"]).select("k", "seg_no")


@query(f"{_FILTER_SQL} SELECT k, seg_no FROM pos p WHERE NOT EXISTS (SELECT 1 FROM fp WHERE fp.book_id = p.book_id AND s <= pos_end AND pos_start <= e)")
def overlap_anti_join(spark, sf_dir):
    p = _positions(spark, sf_dir)
    return algebra.interval_join(p, _passages_frame(spark, sf_dir), "left_anti", ["k", "seg_no"]).select("k", "seg_no")


def _passages_frame(spark, sf_dir):
    rows = [(b, i, *s) for b, segs in _PASSAGE_LIST for i, s in enumerate(segs)]
    df = spark.createDataFrame(rows, "book_id int, seg_no int, kind int, sc int, sv int, ec int, ev int")
    return algebra.with_positions(df, S.canon(spark, sf_dir))


@query(
    f"""WITH {S.positions_sql()}, x AS (SELECT k % 7 AS g, * FROM pos WHERE style = 0),
m AS (SELECT g, book_id, pos_start, pos_end, max(pos_end) OVER (PARTITION BY g, book_id ORDER BY pos_start, pos_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x)
SELECT g, book_id, CAST(count(*) FILTER (WHERE reach IS NULL OR pos_start > reach + 1) AS BIGINT) AS segments FROM m GROUP BY g, book_id""",
    style="0",
)
def passages_from_verses(spark, sf_dir, style=None):
    """Single verses as passages: how many segments are left when neighbours join, also across chapters."""
    seg = _segments(spark, sf_dir, style=style).where("style = 0").withColumn("g", F.col("k") % 7)
    merged = algebra.merge_refs(seg.select("g", "book_id", "kind", "sc", "sv", "ec", "ev"), S.canon(spark, sf_dir), ["g"])
    return merged.groupBy("g", "book_id").agg(F.count("*").alias("segments"))


@query(f"WITH {S.segments_sql()} SELECT k, seg_no, sc * 1000 + sv <= 6030 AND 3005 <= ec * 1000 + coalesce(ev, 999) AS overlaps, 3005 <= sc * 1000 + sv AND ec * 1000 + coalesce(ev, 999) <= 6030 AS contained FROM segs")
def structural_tests(spark, sf_dir):
    """Overlap and containment by the numbers alone, against 3:5-6:30."""
    d = _segments(spark, sf_dir).withColumn("s", F.struct("kind", "sc", "sv", "ec", "ev"))
    wanted = F.struct(F.lit(2).alias("kind"), F.lit(3).alias("sc"), F.lit(5).alias("sv"), F.lit(6).alias("ec"), F.lit(30).alias("ev"))
    return d.select("k", "seg_no", filters.structural_overlap(F.col("s"), wanted).alias("overlaps"), filters.structural_contains(wanted, F.col("s")).alias("contained"))


# --- filters --------------------------------------------------------------------------------------


def _filtered(spark, sf_dir, f: filters.RefFilter) -> DataFrame:
    return f.apply(_refs(spark, sf_dir), S.canon(spark, sf_dir)).select("k", "book_id")


_ALL_IN = "SELECT k, any_value(book_id) AS book_id FROM pos p GROUP BY k HAVING bool_and(EXISTS (SELECT 1 FROM fp WHERE fp.book_id = p.book_id AND s <= pos_start AND pos_end <= e))"


@query(f"{_FILTER_SQL}, x AS (SELECT p.*, EXISTS (SELECT 1 FROM fp WHERE fp.book_id = p.book_id AND s <= pos_start AND pos_end <= e) AS inside FROM pos p) SELECT k, any_value(book_id) AS book_id FROM x GROUP BY k HAVING bool_and(inside)")
def inside_filter(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.RefFilter(inside=_PASSAGE_LIST))


@query(f"{_FILTER_SQL} SELECT DISTINCT k, book_id FROM pos p WHERE EXISTS (SELECT 1 FROM fp WHERE fp.book_id = p.book_id AND s <= pos_end AND pos_start <= e)")
def any_overlap_filter(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.RefFilter(any_overlap=_PASSAGE_LIST))


@query(f"{_FILTER_SQL} SELECT DISTINCT k, book_id FROM pos p WHERE kind < 3 AND EXISTS (SELECT 1 FROM fp WHERE fp.book_id = p.book_id AND s <= pos_end AND pos_start <= e)")
def explicit_overlap_filter(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.RefFilter(explicit_overlap=_PASSAGE_LIST))


@query(f"WITH {S.positions_sql()} SELECT k, any_value(book_id) AS book_id FROM pos GROUP BY k HAVING count(*) = 1 AND any_value(book_id) = 43 AND min(pos_start) = {S.position_sql('43', '2', '1')} AND max(pos_end) = {S.position_sql('43', '2', '(12 + (43 * 3 + 2 * 5) % 28)')}")
def exact_filter(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.RefFilter(exact=((43, [chapters(2, 2)]),)))


@query(f"{_FILTER_SQL} SELECT k, any_value(book_id) AS book_id FROM (SELECT p.*, EXISTS (SELECT 1 FROM fp WHERE fp.book_id = p.book_id AND s <= pos_end AND pos_start <= e) AS hit FROM pos p) GROUP BY k HAVING NOT bool_or(hit)")
def exclude_filter(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.RefFilter(exclude_overlap=_PASSAGE_LIST))


@query(f"WITH {S.segments_sql()} SELECT k, any_value(book_id) AS book_id FROM segs GROUP BY k HAVING bool_or(kind < 3)")
def verses_only_filter(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.RefFilter(verses_only=True))


@query(f"WITH {S.segments_sql()} SELECT k, any_value(book_id) AS book_id FROM segs WHERE {S.NCH.format(b='book_id')} > 1 GROUP BY k HAVING bool_or(kind < 3)")
def verses_only_no_single_chapters(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.RefFilter(verses_only=True, single_chapter_books=False))


@query(f"WITH {S.segments_sql()} SELECT k, book_id FROM segs WHERE style = 0 AND k % 3 = 1", style="0")
def translation_filter(spark, sf_dir, style=None):
    """References followed by one translation, under any of its names."""
    name = F.when(F.col("k") % 3 == 0, " (ESV)").when(F.col("k") % 3 == 1, F.when(F.col("k") % 2 == 0, ", av").otherwise(" KJV")).otherwise(" and more")
    docs = S.ref_texts(spark, sf_dir, style=style).where("style = 0").select("k", F.concat(F.lit("see "), "ref", name).alias("text"))
    r = extract.extract_refs(docs, S.canon(spark, sf_dir), options=Options(translations=Translations(("ESV", "KJV"), (("AV", "KJV"),))))
    return filters.RefFilter(translations=("kjv",)).apply(r, S.canon(spark, sf_dir)).select("k", "book_id")


@query(f"WITH {S.segments_sql()} SELECT DISTINCT k, book_id FROM segs WHERE book_id BETWEEN 40 AND 66 AND (book_id BETWEEN 45 AND 57 OR book_id = 43) AND book_id <> 45")
def scope_filter(spark, sf_dir):
    """The New Testament's letters of Paul and John, without Romans."""
    scope = filters.BookScope(testaments=("nt",), genres=("lop",), books=("John", "Genesis"), exclude_books=("Romans",))
    return _filtered(spark, sf_dir, filters.RefFilter(scope=scope))


# --- notations ------------------------------------------------------------------------------------


@query(
    f"""WITH {S.segments_sql()}
SELECT k, string_agg(CASE kind WHEN 0 THEN b.osis || '.' || sc || '.' || sv WHEN 3 THEN b.osis || '.' || sc ELSE b.osis || '.' || sc || '.' || sv || '-' || b.osis || '.' || ec || '.' || ev END, ' ' ORDER BY seg_no) AS osis,
  string_agg(CASE kind WHEN 0 THEN b.usfm || ' ' || sc || ':' || sv WHEN 1 THEN b.usfm || ' ' || sc || ':' || sv || '-' || ev WHEN 3 THEN b.usfm || ' ' || sc ELSE b.usfm || ' ' || sc || ':' || sv || '-' || ec || ':' || ev END, '; ' ORDER BY seg_no) AS usfm
FROM segs JOIN default_books b ON b.id = book_id GROUP BY k"""
)
def osis_and_usfm(spark, sf_dir):
    books = table(spark, sf_dir, "default_books").select(F.col("id").alias("book_id"), "osis", "usfm")
    r = _refs(spark, sf_dir).join(books, "book_id")
    return r.select("k", C.osis(F.col("osis"), F.col("segments")).alias("osis"), C.usfm(F.col("usfm"), F.col("segments")).alias("usfm"))


@query(f"WITH {S.segments_sql()}, t AS ({S.write_sql()}) SELECT k, b.book || ' ' || written AS reference FROM t JOIN default_books b ON b.id = book_id")
def formatted(spark, sf_dir):
    """References written with the book's name, in Catalyst."""
    books = table(spark, sf_dir, "default_books").select(F.col("id").alias("book_id"), "book")
    return _refs(spark, sf_dir).join(books, "book_id").select("k", F.concat_ws(" ", "book", C.write_segments(F.col("segments"))).alias("reference"))


@query(f"WITH {S.segments_sql()} SELECT k, seg_no, book_id, kind, sc, sv, ec, ev FROM segs")
def parse_osis(spark, sf_dir):
    """References written as OSIS and parsed back, in Catalyst."""
    books = table(spark, sf_dir, "default_books").select(F.col("id").alias("book_id"), "osis")
    codes = F.create_map(*[x for b, i in S.canon(spark, sf_dir).by_osis.items() for x in (F.lit(b), F.lit(i))])
    r = _refs(spark, sf_dir).join(books, "book_id").select("k", C.osis(F.col("osis"), F.col("segments")).alias("text"))
    p = r.select("k", C.parse_osis(F.col("text"), codes).alias("p")).select("k", "p.book_id", "p.segments")
    return extract.explode_segments(p, ["k"])


@query(f"WITH {S.segments_sql()} SELECT k, seg_no, book_id, kind, sc, sv, ec, ev FROM segs")
def parse_refs(spark, sf_dir):
    """One reference per row parsed by the SQL function."""
    from ..functions import sql

    parse = sql.parse_ref(spark, S.canon(spark, sf_dir))
    r = S.ref_texts(spark, sf_dir).select("k", parse(F.col("ref")).alias("p")).where("p IS NOT NULL").select("k", "p.book_id", "p.segments")
    return extract.explode_segments(r, ["k"])


@query(f"WITH {S.segments_sql()} SELECT k, seg_no, book_id, kind, sc, sv, ec, ev FROM segs")
def read_usfm(spark, sf_dir):
    """References written as USFM and read back by the function that takes OSIS, USFM and plain text."""
    from ..functions import sql

    books = table(spark, sf_dir, "default_books").select(F.col("id").alias("book_id"), "usfm")
    read = sql.read_ref(spark, S.canon(spark, sf_dir))
    r = _refs(spark, sf_dir).join(books, "book_id").select("k", read(C.usfm(F.col("usfm"), F.col("segments"))).alias("p"))
    return extract.explode_segments(r.select("k", "p.book_id", "p.segments"), ["k"])


@query(f"WITH {S.segments_sql()} SELECT k, seg_no, CASE WHEN kind IN (0, 3) THEN false ELSE true END AS is_range, sc || ':' || sv AS first, coalesce(ec || ':' || ev, CAST(ec AS VARCHAR)) AS last FROM segs WHERE kind < 3")
def segment_ends(spark, sf_dir):
    s = F.struct("kind", "sc", "sv", "ec", "ev")
    d = _segments(spark, sf_dir).where("kind < 3").withColumn("s", s)
    one = lambda c: C.write_segments(F.array(c))
    return d.select("k", "seg_no", C.is_range(F.col("s")).alias("is_range"), one(C.first_of(F.col("s"))).alias("first"), one(C.last_of(F.col("s"))).alias("last"))


@query(
    f"""WITH {S.segments_sql()} SELECT k, '[' || string_agg(CASE WHEN kind < 3 THEN '{{"tag":"Verses","start":{{"chapter":' || sc || ',"verse":' || sv || '}},"end":{{"chapter":' || ec || ',"verse":' || ev || '}}}}'
  ELSE '{{"tag":"Chapters","start":' || sc || ',"end":' || ec || '}}' END, ',' ORDER BY seg_no) || ']' AS segments FROM segs GROUP BY k"""
)
def segments_json(spark, sf_dir):
    return _refs(spark, sf_dir).select("k", C.segments_json(F.col("segments")).alias("segments"))


# --- orders ---------------------------------------------------------------------------------------

_PATH = "'notes/' || (k % 50) || CASE WHEN k % 2 = 0 THEN '/A' ELSE '/a' END || k || CASE k % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.SRT' ELSE '' END"


def _with_paths(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.expr(_PATH))


_KEY = "(CAST(book_id AS BIGINT) * 65536 + sc * 256 + CASE WHEN kind >= 3 THEN 0 ELSE sv END)"


@query(f"WITH {S.segments_sql()} SELECT k, {_PATH} AS path, {_KEY} AS key FROM segs WHERE seg_no = 1 ORDER BY key, lower(path), path LIMIT 40 OFFSET 100")
def bible_order_page(spark, sf_dir):
    r = _with_paths(_refs(spark, sf_dir))
    return ordering.page(r, ordering.bible_order(), 100, 40).select("k", "path", C.canon_key(F.col("book_id"), F.col("segments")).alias("key"))


@query(f"WITH {S.segments_sql()} SELECT k, {_PATH} AS path FROM segs WHERE seg_no = 1 ORDER BY lower(path), path LIMIT 25 OFFSET 10")
def file_order_page(spark, sf_dir):
    return ordering.page(_with_paths(_refs(spark, sf_dir)), ordering.file_order(), 10, 25).select("k", "path")


@query(f"WITH {S.segments_sql()} SELECT CASE k % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'srt' END AS extension, count(*) AS refs, count(DISTINCT {_PATH}) AS files FROM segs WHERE seg_no = 1 GROUP BY 1")
def extension_counts(spark, sf_dir):
    return ordering.extension_counts(_with_paths(_refs(spark, sf_dir)))


@query(f"WITH {S.segments_sql()} SELECT {_PATH} AS path FROM keys WHERE k NOT IN (SELECT k FROM segs)")
def files_without_match(spark, sf_dir):
    docs = _with_paths(S.documents_of(spark, sf_dir))
    return ordering.files_without(docs, _with_paths(_refs(spark, sf_dir))).select("path")


@query(f"WITH {S.segments_sql()} SELECT {_PATH} AS path, count(*) AS refs FROM segs WHERE seg_no = 1 GROUP BY 1")
def counts_per_file(spark, sf_dir):
    return ordering.counts_per_file(_with_paths(_refs(spark, sf_dir)))


_SUGGEST = """
WITH names AS (
  SELECT id, lower(book) AS key FROM default_books UNION SELECT id, lower(abbreviation) FROM default_books UNION SELECT id, lower(osis) FROM default_books UNION SELECT id, lower(usfm) FROM default_books
  UNION SELECT id, rtrim(lower(unnest(abbreviations)), '.') FROM default_books),
r AS (SELECT id, min(CASE WHEN key = '1' THEN 0 WHEN starts_with(key, '1') THEN 1 WHEN starts_with(replace(key, ' ', ''), '1') THEN 2 END) AS rank FROM names GROUP BY id)
SELECT id AS book_id, book AS name, CAST(rank AS INT) AS rank FROM r JOIN default_books USING (id) WHERE rank IS NOT NULL ORDER BY rank, id LIMIT 12
"""


@query(_SUGGEST)
def suggest_books(spark, sf_dir):
    """Books for "1", in the canon's order."""
    canon = S.canon(spark, sf_dir)
    return ordering.suggest_books(canon.dim_keys(spark), canon.dim_books(spark), "1", 12)


# --- dimensions -----------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE g AS (SELECT title, unnest(coalesce(books, [])) AS book, 0 AS part FROM default_genres),
p AS (SELECT title, unnest(coalesce(subcategories, [])) AS part FROM default_genres),
c AS (SELECT title, title AS inner_title FROM default_genres UNION SELECT c.title, p.part FROM c JOIN p ON p.title = c.inner_title)
SELECT DISTINCT c.title AS genre, b.id AS book_id FROM c JOIN g ON g.title = c.inner_title JOIN default_books b ON b.book = g.book"""
)
def genre_books(spark, sf_dir):
    """Genres with the books of the genres they name."""
    return S.canon(spark, sf_dir).dim_genres(spark)


@query(f"SELECT id AS book_id, {S.NCH.format(b='id')} AS chapters, CAST(list_sum(list_transform(range(1, {S.NCH.format(b='id')} + 1), lambda i: 12 + (id * 3 + i * 5) % 28)) AS BIGINT) AS verses FROM default_books")
def verse_totals(spark, sf_dir):
    dim = S.canon(spark, sf_dir).dim_chapters(spark)
    return dim.groupBy("book_id").agg(F.count("*").cast("int").alias("chapters"), F.sum("n_verses").alias("verses"))
