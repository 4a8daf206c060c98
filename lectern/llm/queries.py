"""Queries over the test tables for the training-data operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import bpe, canonical, garbled, leakage, lookalike, pii, survivor

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_found(table(spark, sf_dir, "book_scopes"), table(spark, sf_dir, "default_books"), table(spark, sf_dir, "default_genres"))


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each typed value that means no entry was typed."""
    scopes, books, genres = (table(spark, sf_dir, t) for t in ("book_scopes", "default_books", "default_genres"))
    found = canonical.canonical_found(scopes, books, genres).where("target = '' AND field <> 'abbreviations'")
    typed = scopes.select(F.col("scope_id").alias("row_id"), F.lit("books").alias("field"), F.posexplode("books").alias("pos", "value")).unionByName(
        scopes.select(F.col("scope_id").alias("row_id"), F.lit("genres").alias("field"), F.posexplode("genres").alias("pos", "value"))
    )
    return typed.join(found.select("field", "row_id", "pos"), ["field", "row_id", "pos"], "left_semi").groupBy("field", "value").agg(F.count("*").alias("times"))


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_records([("file_hits", table(spark, sf_dir, "file_hits"), "file_id", "text"), ("epub_places", table(spark, sf_dir, "epub_places"), "place_id", "line_text")])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).where("repair.garbled").select("table_name", "row_id")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("table_name", "row_id", F.col("repair.restored").alias("restored"), F.col("repair.layers").alias("layers"))


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only a wrong encoding put into a text is undone first."""
    rows = garbled.garbled_records([("file_hits", table(spark, sf_dir, "file_hits"), "file_id", "text"), ("pdf_places", table(spark, sf_dir, "pdf_places"), "place_id", "line_text")])
    return lookalike.normalise_column(rows.select("table_name", "row_id", F.col("repair.restored").alias("text")), "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir).where("normal.changed").select("table_name", "row_id")


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir).select("table_name", "row_id", F.col("normal.text").alias("text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor.survivors(table(spark, sf_dir, "pack_entries"), table(spark, sf_dir, "confirmations"))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = survivor.survivor_records(table(spark, sf_dir, "pack_entries"), table(spark, sf_dir, "confirmations"))
    return records.select("group_id", "entry_id", "pack_device", "kind", "path", "size", "mtime", "written", "engine", "hash", F.array_join("chapters", "|").alias("chapters"), "n_refs", "detail")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_values(table(spark, sf_dir, "documents"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_column(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "redacted")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_unmatched, p3_found, p3_restored, p4_found, p4_text, p5_found, p5_records, p6_ids, p7_found, p8_found, p8_redacted)}

_KEY = "array_to_string(list_filter(string_split(replace(nfc_normalize(lower(nfc_normalize(path))), '\\', '/'), '/'), lambda s: s <> '' AND s <> '.'), '/')"

_SURVIVORS = f"""
WITH c AS (
  SELECT {_KEY} AS key, device AS pack_device, written, count(DISTINCT pack_device) AS confirmers
  FROM confirmations WHERE pack_device <> device GROUP BY ALL),
e AS (
  SELECT e.*, {_KEY.replace("(path)", "(e.path)")} AS key FROM pack_entries e WHERE path IS NOT NULL),
r AS (
  SELECT e.*, coalesce(c.confirmers, 0) AS confirmers FROM e LEFT JOIN c ON c.key = e.key AND c.pack_device = e.pack_device AND c.written = e.written),
g AS (SELECT key, min(entry_id) AS group_id FROM r GROUP BY key HAVING count(*) > 1),
top AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY confirmers DESC, written DESC NULLS LAST, entry_id) = 1),
f AS (
  SELECT key, size, confirmers, written, entry_id, 'record' AS field FROM r
  UNION ALL SELECT key, size, confirmers, written, entry_id, 'hash' FROM r WHERE hash IS NOT NULL
  UNION ALL SELECT key, size, confirmers, written, entry_id, 'chapters' FROM r WHERE len(chapters) > 0
  UNION ALL SELECT key, size, confirmers, written, entry_id, 'n_refs' FROM r WHERE n_refs IS NOT NULL
  UNION ALL SELECT key, size, confirmers, written, entry_id, 'detail' FROM r WHERE detail <> ''),
picks AS (
  SELECT g.group_id, f.field, f.entry_id FROM f JOIN top ON top.key = f.key AND top.size IS NOT DISTINCT FROM f.size JOIN g ON g.key = f.key
  QUALIFY row_number() OVER (PARTITION BY f.key, f.field ORDER BY f.confirmers DESC, f.written DESC NULLS LAST, f.entry_id) = 1)
"""

ORACLE_SQL: dict[str, str] = {
    "p5_found": _SURVIVORS + "SELECT group_id, field, entry_id FROM picks",
    "p5_records": _SURVIVORS
    + """
SELECT p.group_id, e.entry_id, e.pack_device, e.kind, e.path, e.size, e.mtime, e.written, e.engine,
  h.hash AS hash, array_to_string(c.chapters, '|') AS chapters, n.n_refs AS n_refs, d.detail AS detail
FROM picks p JOIN pack_entries e ON e.entry_id = p.entry_id
LEFT JOIN picks ph ON ph.group_id = p.group_id AND ph.field = 'hash' LEFT JOIN pack_entries h ON h.entry_id = ph.entry_id
LEFT JOIN picks pc ON pc.group_id = p.group_id AND pc.field = 'chapters' LEFT JOIN pack_entries c ON c.entry_id = pc.entry_id
LEFT JOIN picks pn ON pn.group_id = p.group_id AND pn.field = 'n_refs' LEFT JOIN pack_entries n ON n.entry_id = pn.entry_id
LEFT JOIN picks pd ON pd.group_id = p.group_id AND pd.field = 'detail' LEFT JOIN pack_entries d ON d.entry_id = pd.entry_id
WHERE p.field = 'record'""",
}
