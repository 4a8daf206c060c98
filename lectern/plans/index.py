"""Queries of the index tables: freshness, confirmations, packs, cached books, and the streaming twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract, index
from ..streaming import refs as streaming
from ..tables import scratch_path, table
from . import synthetic as S

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(
    """
WITH l AS (SELECT DISTINCT pack_device AS device, path, size, mtime FROM confirmations UNION SELECT DISTINCT device, path, size, mtime FROM listing),
x AS (
  SELECT l.*, e.entry_id, e.pack_device AS entry_device, e.written,
    CASE WHEN e.mtime = l.mtime AND e.pack_device = l.device THEN 0
      WHEN EXISTS (SELECT 1 FROM confirmations c WHERE c.pack_device = l.device AND c.path = l.path AND c.size = l.size AND c.mtime = l.mtime AND c.device = e.pack_device AND c.written = e.written) THEN 1
      WHEN e.mtime = l.mtime THEN 2 WHEN e.entry_id IS NOT NULL THEN 3 ELSE 4 END AS rank
  FROM l LEFT JOIN pack_entries e ON e.path = l.path AND e.size = l.size)
SELECT device, path, size, mtime, CASE WHEN rank <= 2 THEN 'fresh' WHEN rank = 3 THEN 'unconfirmed' ELSE 'missing' END AS status, entry_id, entry_device
FROM x QUALIFY row_number() OVER (PARTITION BY device, path, size, mtime ORDER BY rank, written DESC NULLS LAST, entry_id) = 1
"""
)
def index_check(spark, sf_dir):
    """Each listed or confirmed file version against the entries of all devices."""
    confirmations = table(spark, sf_dir, "confirmations")
    listed = confirmations.select(F.col("pack_device").alias("device"), "path", "size", "mtime").unionByName(table(spark, sf_dir, "listing").select("device", "path", "size", "mtime"))
    return index.check(listed, table(spark, sf_dir, "pack_entries"), confirmations)


_LISTED = "SELECT DISTINCT pack_device AS device, path, size, mtime, CAST(NULL AS BIGINT) AS hash FROM confirmations"


@query(
    f"""WITH l AS ({_LISTED})
SELECT device, path, entry_id FROM (SELECT l.device, l.path, l.mtime, l.size, e.entry_id, row_number() OVER (PARTITION BY l.device, l.path, l.size, l.mtime ORDER BY e.written DESC NULLS LAST, e.entry_id) AS n, e.pack_device
FROM l JOIN pack_entries e ON e.path = l.path AND e.size = l.size) WHERE n = 1 AND pack_device = device"""
)
def index_confirm_own(spark, sf_dir):
    """Own entries that a confirmed file version updates."""
    c = table(spark, sf_dir, "confirmations")
    listed = c.select(F.col("pack_device").alias("device"), "path", "size", "mtime", F.lit(None).cast("bigint").alias("hash")).distinct()
    own, _ = index.confirm(listed, table(spark, sf_dir, "pack_entries"))
    e = table(spark, sf_dir, "pack_entries").select("entry_id", F.col("pack_device").alias("device"), "path")
    return own.select("entry_id").join(e, "entry_id").select("device", "path", "entry_id")


@query("SELECT pack_device, path FROM pack_entries WHERE NOT (pack_device = 'dev-dunbas' AND path NOT IN (SELECT path FROM listing WHERE device = 'dev-dunbas'))")
def index_retain(spark, sf_dir):
    """Entries without one device's that are not listed any more."""
    listed = table(spark, sf_dir, "listing").where("device = 'dev-dunbas'")
    return index.retain(table(spark, sf_dir, "pack_entries"), "dev-dunbas", listed).select("pack_device", "path")


@query("SELECT kind, pack_number, count(*) AS entries, CAST(coalesce(sum(n_refs), 0) AS BIGINT) AS refs FROM pack_entries WHERE path LIKE 'Notes/%' GROUP BY kind, pack_number")
def index_scope(spark, sf_dir):
    """References per pack of one folder."""
    e = index.scope(table(spark, sf_dir, "pack_entries"), folder="Notes")
    return e.groupBy("kind", "pack_number").agg(F.count("*").alias("entries"), F.coalesce(F.sum("n_refs"), F.lit(0)).cast("bigint").alias("refs"))


@query("SELECT run_no, device, path FROM cache_headers WHERE (books[1] & (1::BIGINT << 43)) <> 0 OR (books[1] & (1::BIGINT << 45)) <> 0 OR (books[2] & 4) <> 0")
def cached_books(spark, sf_dir):
    """Cached files that hold any of three books, told by their bitmaps alone."""
    return table(spark, sf_dir, "cache_headers").where(index.bitmap_has(F.col("books"), [43, 45, 66])).select("run_no", "device", "path")


@query(
    f"""WITH {S.segments_sql()}, p AS (SELECT k % 50 AS file, book_id FROM segs WHERE seg_no = 1)
SELECT file, coalesce(bit_or(CASE WHEN book_id = 63 THEN -9223372036854775808 WHEN book_id // 64 = 0 THEN 1::BIGINT << (book_id % 64) END), 0) AS w0, coalesce(bit_or(CASE WHEN book_id // 64 = 1 THEN 1::BIGINT << (book_id % 64) END), 0) AS w1 FROM p GROUP BY file"""
)
def book_bitmaps(spark, sf_dir):
    """The books of each file as a bitmap; book 63 is the sign bit."""
    refs = extract.extract_refs(S.documents_of(spark, sf_dir), S.canon(spark, sf_dir), located=False).withColumn("file", F.col("k") % 50)
    return index.book_bitmap(refs, "file").select("file", F.get("books", F.lit(0)).alias("w0"), F.get("books", F.lit(1)).alias("w1"))


@query(f"WITH {S.segments_sql()} SELECT 'f' || keys.k || '.md' AS path, CAST(count(segs.k) AS INT) AS n_refs, length('They say, see  today, and so on.') > 0 AS hashed FROM keys LEFT JOIN segs ON segs.k = keys.k AND seg_no = 1 GROUP BY keys.k")
def index_entries(spark, sf_dir):
    """Entries of searched files."""
    docs = S.documents_of(spark, sf_dir).select(F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(".md")).alias("path"), F.lit("text").alias("kind"), F.lit(1).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime"), "text")
    entries, _, _ = index.build_entries(docs, S.canon(spark, sf_dir), "dev-new")
    return entries.select("path", "n_refs", F.col("hash").isNotNull().alias("hashed"))


@query(f"WITH {S.segments_sql()} SELECT 'f' || k AS path, book_id FROM segs WHERE seg_no = 1 AND k % 4 <> 0 UNION ALL SELECT 'f' || k, 65 FROM keys WHERE k % 4 = 0")
def index_cached_search(spark, sf_dir):
    """A second search of files of which a quarter has changed: the others come from the cache."""
    cache = scratch_path(spark, "cache")
    canon = S.canon(spark, sf_dir)
    docs = S.documents_of(spark, sf_dir).select("k", F.concat(F.lit("f"), F.col("k").cast("string")).alias("path"), F.lit(1).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("mtime"), "text")
    index.cached_refs(docs.drop("k"), canon, cache)
    new = F.col("k") % 4 == 0
    # The unchanged files' texts are not looked at: they are replaced here, and the results stay.
    later = docs.select("path", "size", F.when(new, 2).otherwise(F.col("mtime")).cast("bigint").alias("mtime"), F.when(new, "only Jude 1:2").otherwise("unread").alias("text"))
    refs, _ = index.cached_refs(later, canon, cache)
    return refs.select("path", "book_id")


_EVENTS = S.segments_sql(source="events", key="event_id", extra="ts")


@query(f"WITH {_EVENTS} SELECT date_trunc('hour', keys.ts) AS window_start, segs.book_id, count(*) AS refs FROM segs JOIN keys ON keys.k = segs.k WHERE seg_no = 1 GROUP BY 1, 2")
def event_window_refs(spark, sf_dir):
    """References per hour and book, by the plan that the stream runs."""
    docs = S.documents_of(spark, sf_dir, source="events", key="event_id", extra=("ts",))
    counted = streaming.windowed_counts(docs, S.canon(spark, sf_dir), "ts", "1 hour", keys=["k", "ts"])
    return counted.select("window_start", "book_id", "refs")


@query("SELECT device, kind, count(*) AS files, count(DISTINCT path) AS paths FROM file_hits GROUP BY device, kind")
def files_per_device(spark, sf_dir):
    return table(spark, sf_dir, "file_hits").groupBy("device", "kind").agg(F.count("*").alias("files"), F.count_distinct("path").alias("paths"))


@query()
def file_hits_refs(spark, sf_dir):
    """References of the searched files' texts, counted per file and book."""
    docs = table(spark, sf_dir, "file_hits").select("file_id", "text")
    refs = extract.extract_refs(docs, S.canon_without_counts(spark, sf_dir), located=False)
    return refs.groupBy("file_id", "book_id").agg(F.count("*").alias("refs"))
