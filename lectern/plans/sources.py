"""Queries of the sources: subtitles, HTML, JSON, XML, paths, and of what is printed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions import places
from ..operators import extract, filters
from ..sources import adapters, html, structured, subtitles
from ..sources import files as files_
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


def _refs(spark: SparkSession, sf_dir: str, style: str | None = None) -> DataFrame:
    """``k, ref`` of events written in style 0: ``Name c:v``."""
    return S.ref_texts(spark, sf_dir, source="events", key="event_id", style=style).where("style = 0")


_SEGS = S.segments_sql(source="events", key="event_id")

# --- subtitles ------------------------------------------------------------------------------------


def _transcripts(spark, sf_dir, style=None) -> DataFrame:
    """Three cues; the reference stands in the second one, and a second one in the third."""
    s = lambda n: subtitles.stamp(n)
    t = F.col("k") * 1000
    return _refs(spark, sf_dir, style).select(
        "k",
        F.concat(
            F.lit("1\n"), s(t), F.lit(" --> "), s(t + 900), F.lit("\nNothing here.\n\n2\n"), s(t + 1000), F.lit(" --> "), s(t + 1900), F.lit("\nwe read "), "ref", F.lit(" today\n\nthird\n"),
            s(t + 2000), F.lit(" --> "), s(t + 2900), F.lit(" align:start\nand "), "ref", F.lit("\n"),
        ).alias("text"),
    )


def _stamp_sql(ms: str) -> str:
    return f"printf('%02d:%02d:%02d.%03d', CAST({ms} AS BIGINT) // 3600000, (CAST({ms} AS BIGINT) // 60000) % 60, (CAST({ms} AS BIGINT) // 1000) % 60, CAST({ms} AS BIGINT) % 1000)"


@query(
    f"""WITH {_SEGS}
SELECT k, 1 AS ref_no, book_id, CAST(2 AS BIGINT) AS cue_id, k * 1000 + 1000 AS cue_start_ms, k * 1000 + 1900 AS cue_end_ms, {_stamp_sql('k * 1000 + 1000')} AS label FROM segs WHERE style = 0
UNION ALL SELECT k, 2, book_id, CAST(0 AS BIGINT), k * 1000 + 2000, k * 1000 + 2900, {_stamp_sql('k * 1000 + 2000')} FROM segs WHERE style = 0""",
    style="0",
)
def cue_range_join(spark, sf_dir, style=None):
    """References of transcripts in their cues."""
    docs = _transcripts(spark, sf_dir, style=style)
    refs = extract.extract_refs(docs, S.canon(spark, sf_dir))
    return subtitles.place_in_cues(refs, subtitles.cue_rows(docs), ["k"]).select("k", "ref_no", "book_id", "cue_id", "cue_start_ms", "cue_end_ms", "label")


@query(f"WITH {_SEGS} SELECT count(*) * 3 AS cues, count(*) AS files, CAST(sum(k * 3000 + 3000) AS BIGINT) AS starts FROM keys WHERE style = 0", style="0")
def cue_counts(spark, sf_dir, style=None):
    cues = subtitles.cue_rows(_transcripts(spark, sf_dir, style=style))
    return cues.agg(F.count("*").alias("cues"), F.count_distinct("k").alias("files"), F.sum("start_ms").alias("starts"))


@query()
def transcript_labels(spark, sf_dir):
    """References of all transcripts among the documents, labelled by the cue that they start in."""
    docs = table(spark, sf_dir, "documents").where("kind = 'transcript'").select("doc_id", "text")
    refs = extract.extract_refs(docs, S.canon_without_counts(spark, sf_dir))
    return subtitles.place_in_cues(refs, subtitles.cue_rows(docs), ["doc_id"]).select("doc_id", "ref_no", "book_id", "label")


# --- HTML, JSON, XML ------------------------------------------------------------------------------

_HEAD = "<html><style>John 1:1</style><p class=\"a\">See&nbsp;<b>"


@query(f"WITH {_SEGS} SELECT k, 1 AS ref_no, book_id, sc, sv, length('{_HEAD}') AS source_start, length('{_HEAD}') + length(b.book || ' ' || sc || ':' || sv) AS source_end FROM segs JOIN default_books b ON b.id = book_id WHERE style = 0", style="0")
def html_refs(spark, sf_dir, style=None):
    """References of pages, placed in the source."""
    pages = _refs(spark, sf_dir, style=style).select("k", F.concat(F.lit(_HEAD), "ref", F.lit("</b> &amp; more</p><p>16 other</p></html>")).alias("html"))
    r = adapters.extract_with(pages, S.canon(spark, sf_dir), html.pieces, html.COLUMNS, content="html")
    s = F.element_at("segments", 1)
    return r.select("k", "ref_no", "book_id", s["sc"].alias("sc"), s["sv"].alias("sv"), "source_start", "source_end")


@query(f"WITH {_SEGS} SELECT k, 'See' || chr(160) || b.book || ' ' || sc || ':' || sv || ' & more' || chr(10) || '16 other' || chr(10) AS text FROM segs JOIN default_books b ON b.id = book_id WHERE style = 0", style="0")
def html_text(spark, sf_dir, style=None):
    """The visible text of pages, in Catalyst."""
    pages = _refs(spark, sf_dir, style=style).select("k", F.concat(F.lit(_HEAD), "ref", F.lit("</b> &amp; more</p><p>16 other</p></html>")).alias("html"))
    return pages.select("k", html.visible_text(F.col("html")).alias("text"))


@query(f"WITH {_SEGS} SELECT k, '#:~:text=See-,' || replace(replace(b.book || ' ' || sc || ':' || sv, ' ', '%20'), ':', '%3A') || ',-%26' AS fragment FROM segs JOIN default_books b ON b.id = book_id WHERE style = 0", style="0")
def text_fragments(spark, sf_dir, style=None):
    """Links to the words on the page, with as much context as makes them unique."""
    pages = _refs(spark, sf_dir, style=style).select("k", F.concat(F.lit(_HEAD), "ref", F.lit("</b> &amp; more</p><p>16 other</p></html>")).alias("html"))
    r = adapters.extract_with(pages, S.canon(spark, sf_dir), html.pieces, html.COLUMNS, content="html")
    return r.select("k", "fragment")


@query(
    f"""WITH {_SEGS}
SELECT k, 1 AS ref_no, '/a~1b/1/m~0n' AS pointer, 4 AS start, book_id, sc, sv FROM segs WHERE style = 0""",
    style="0",
)
def json_refs(spark, sf_dir, style=None):
    """References of the strings of JSON documents, by pointer; keys are not searched."""
    docs = _refs(spark, sf_dir, style=style).select("k", F.concat(F.lit('{"John 3:16": 1, "a/b": [2, {"m~n": "see '), "ref", F.lit('"}], "z": null}')).alias("json"))
    r = adapters.extract_with(docs, S.canon(spark, sf_dir), structured.json_pieces, structured.JSON_COLUMNS, content="json")
    s = F.element_at("segments", 1)
    return r.select("k", "ref_no", "pointer", "start", "book_id", s["sc"].alias("sc"), s["sv"].alias("sv"))


@query(
    f"""WITH {_SEGS}
SELECT k, 1 AS ref_no, '/r/p[2]/b' AS path, 0 AS start, book_id FROM segs WHERE style = 0
UNION ALL SELECT k, 2, '/r/q', 6, book_id FROM segs WHERE style = 0""",
    style="0",
)
def xml_refs(spark, sf_dir, style=None):
    """References of XML documents, by the deepest element that holds them."""
    name = F.regexp_replace("ref", r" \d+:\d+$", "")
    cv = F.regexp_extract("ref", r"(\d+:\d+)$", 1)
    docs = _refs(spark, sf_dir, style=style).select("k", F.concat(F.lit("<r><p>one</p><p>two <b>"), "ref", F.lit("</b> end</p><q>again "), name, F.lit(" <i>"), cv, F.lit("</i></q></r>")).alias("xml"))
    r = adapters.extract_with(docs, S.canon(spark, sf_dir), structured.xml_pieces, structured.XML_COLUMNS, content="xml")
    return r.select("k", "ref_no", "path", "start", "book_id")


@query(f"WITH {_SEGS} SELECT k, k % 4 = 1 AS failed FROM keys WHERE style IN (0, 1)", style="{key} % 2")
def broken_documents(spark, sf_dir, style=None):
    """A document that cannot be read gives an error row and does not stop the others."""
    docs = S.ref_texts(spark, sf_dir, source="events", key="event_id", style=style).where("style IN (0, 1)")
    docs = docs.select("k", F.when(F.col("k") % 4 == 1, F.concat(F.lit('{"a": '), "ref")).otherwise(F.concat(F.lit('["'), "ref", F.lit('"]'))).alias("json"))
    r = adapters.extract_with(docs, S.canon(spark, sf_dir), structured.json_pieces, structured.JSON_COLUMNS, content="json")
    return r.select("k", F.col("error").isNotNull().alias("failed"))


# --- paths ----------------------------------------------------------------------------------------

_PATHS = "SELECT DISTINCT path FROM listing"


@query(f"SELECT path FROM ({_PATHS}) WHERE (path LIKE 'Notes/%' OR path LIKE 'Talks/%') AND NOT regexp_matches(path, '^Notes/Sermons/') AND regexp_matches(path, '^(.*/)?[^/]*1[^/]*\\.md$')")
def path_filter(spark, sf_dir):
    """Files in folders, by globs and extension."""
    f = filters.PathFilter(paths=("Notes", "Talks"), globs=("*1*.md", "!Notes/Sermons/"), extensions=("md",))
    return table(spark, sf_dir, "listing").select("path").distinct().where(f.predicate(F.col("path")))


@query("SELECT CASE WHEN regexp_matches(lower(path), '\\.(epub|pdf)$') THEN regexp_extract(lower(path), '\\.(epub|pdf)$', 1) WHEN regexp_matches(lower(path), '\\.(srt|vtt|sbv)$') THEN 'subtitles' ELSE 'text' END AS kind, count(*) AS n FROM listing GROUP BY 1")
def kinds(spark, sf_dir):
    """Formats by extension."""
    return table(spark, sf_dir, "listing").groupBy(files_.kind_of(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_id AS k, event_id % 3 = 0 AS is_binary, CASE event_id % 3 WHEN 1 THEN 'x' || chr(65533) || event_type ELSE 'x' || event_type END AS text FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, true, 'x' || chr(0) || event_type FROM events WHERE event_id % 3 = 0")
def binary_sniff(spark, sf_dir):
    """Contents with a zero byte are binary; bytes that are no UTF-8 become replacement characters."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), "event_type")
    middle = F.when(F.col("k") % 3 == 0, F.unhex(F.lit("00"))).when(F.col("k") % 3 == 1, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.encode(F.lit("x"), "UTF-8"), middle, F.encode("event_type", "UTF-8"))
    return e.select("k", files_.is_binary(content).alias("is_binary"), files_.decode_lossy(content).alias("text"))


# --- printing -------------------------------------------------------------------------------------


@query(f"WITH {_SEGS} SELECT 'f' || k || '.md:1:5: ' || b.book || ' ' || sc || ':' || sv AS line FROM segs JOIN default_books b ON b.id = book_id WHERE style = 0", style="0")
def quickfix_lines(spark, sf_dir, style=None):
    """``path:line:column: reference``."""
    docs = _refs(spark, sf_dir, style=style).select(F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("see "), "ref").alias("text"))
    return sinks.quickfix(extract.extract_refs(docs, S.canon(spark, sf_dir)), S.canon(spark, sf_dir)).select("line")


@query(
    f"""WITH {_SEGS}
SELECT 'f' || k AS path, unnest([1, 2, 3]) AS line_no, unnest(['before', 'see ' || b.book || ' ' || sc || ':' || sv, 'after']) AS line, unnest([false, true, false]) AS hit FROM segs JOIN default_books b ON b.id = book_id WHERE style = 0""",
    style="0",
)
def context_lines(spark, sf_dir, style=None):
    """Lines around each hit."""
    docs = _refs(spark, sf_dir, style=style).select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("path"), F.concat(F.lit("far\nbefore\nsee "), "ref", F.lit("\nafter\nfar")).alias("text"))
    shifted = docs.select("path", F.regexp_replace("text", "^far\n", "").alias("text"))
    return sinks.context_lines(shifted, extract.extract_refs(shifted, S.canon(spark, sf_dir)), before=1, after=1).select("path", "line_no", "line", "hit")


@query(
    f"""WITH {_SEGS}
SELECT k, '{{"path":"f' || k || '","reference":"' || b.book || ' ' || sc || ':' || sv || '","osis":"' || b.osis || '.' || sc || '.' || sv || '","book_id":' || book_id || ',"line":1,"start_byte":4}}' AS json
FROM segs JOIN default_books b ON b.id = book_id WHERE style = 0""",
    style="0",
)
def json_rows(spark, sf_dir, style=None):
    """One JSON object per reference."""
    docs = _refs(spark, sf_dir, style=style).select("k", F.concat(F.lit("f"), F.col("k").cast("string")).alias("path"), F.concat(F.lit("see "), "ref").alias("text"))
    r = extract.extract_refs(docs, S.canon(spark, sf_dir))
    return sinks.named(r, S.canon(spark, sf_dir)).select("k", F.to_json(F.struct("path", "reference", "osis", "book_id", "line", "start_byte")).alias("json"))


@query(f"WITH {_SEGS} SELECT k, 'see ' || b.book || ' ' || sc || ':' || sv || ' today' AS snippet FROM segs JOIN default_books b ON b.id = book_id WHERE style = 0", style="0")
def snippets(spark, sf_dir, style=None):
    """Text around a hit."""
    docs = _refs(spark, sf_dir, style=style).select("k", F.concat(F.lit("see "), "ref", F.lit(" today")).alias("text"))
    r = extract.extract_refs(docs, S.canon(spark, sf_dir), keys=["k"]).join(docs, "k")
    cut = F.udf(lambda t, a, b: places.snippet(t, a, b)[0], "string", useArrow=True)
    return r.select("k", cut("text", "start_char", "end_char").alias("snippet"))

