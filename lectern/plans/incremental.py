"""Queries of the incremental operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental
from ..tables import scratch_path, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committed output of one step from the start to the newest run, in a store of its own."""
    store = incremental.CommitStore(spark, scratch_path(spark, "p2"))
    incremental.advance(store, table(spark, sf_dir, "listing"), table(spark, sf_dir, "index_runs"), table(spark, sf_dir, "cache_headers"))
    return store.read().where("NOT first").select("run_no", "device", "path")


def p2_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in three steps, of which the second dies before its commit and is done again; what is read is what was committed."""
    listing, runs, headers = (table(spark, sf_dir, t) for t in ("listing", "index_runs", "cache_headers"))
    store = incremental.CommitStore(spark, scratch_path(spark, "p2"))
    least, most = runs.agg(F.min("run_no"), F.max("run_no")).first()

    def die() -> None:
        raise RuntimeError("killed before the commit")

    incremental.advance(store, listing, runs, headers, least + (most - least) // 3)
    try:
        incremental.advance(store, listing, runs, headers, least + 2 * (most - least) // 3, die)
    except RuntimeError as e:
        if "killed" not in str(e):
            raise
    incremental.advance(store, listing, runs, headers, least + 2 * (most - least) // 3)
    incremental.advance(store, listing, runs, headers)
    return store.read().where("NOT first").select("run_no", "device", "path")


QUERIES = {"p2_found": p2_found, "p2_steps": p2_steps}

_CHANGED = """
WITH seen AS (
  SELECT * FROM listing QUALIFY row_number() OVER (PARTITION BY run_no, device, path ORDER BY seen_at DESC, list_id DESC) = 1),
p AS (
  SELECT s.*, r.status = 'ok' AS ok FROM seen s JOIN index_runs r ON r.run_no = s.run_no
  WHERE r.status = 'ok' OR EXISTS (SELECT 1 FROM cache_headers h WHERE h.run_no = s.run_no AND h.device = s.device AND h.path = s.path AND h.size = s.size AND h.modified_ns = s.modified_ns)),
l AS (
  SELECT *, row_number() OVER w AS n, lag(size) OVER w AS size0, lag(mtime) OVER w AS mtime0, lag(hash) OVER w AS hash0, lag(modified_ns) OVER w AS ns0
  FROM p WINDOW w AS (PARTITION BY device, path ORDER BY run_no))
SELECT run_no, device, path FROM l
WHERE ok AND run_no > 1 AND (n = 1 OR NOT (size = size0 AND
  CASE WHEN hash IS NOT NULL AND hash0 IS NOT NULL THEN hash = hash0
       ELSE mtime = mtime0 AND (modified_ns IS NULL OR ns0 IS NULL OR modified_ns = ns0) END))"""

ORACLE_SQL = {"p2_found": _CHANGED, "p2_steps": _CHANGED}
