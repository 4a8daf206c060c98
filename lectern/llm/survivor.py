"""Best representative of each duplicate group, field by field.

Entries whose paths name one file form a group. Within it entries are ranked by trust (how many other
devices confirm them), recency and the smallest id; the first is the record, and each field comes from
the first entry of the record's size in which it is neither null nor empty.

Every ranking is a ``row_number`` window that keeps one row, which Spark evaluates with a partial limit
before the shuffle (WindowGroupLimit), so a group with a third of all rows never meets in one task. The
group's id and count are partial aggregates.

Odd input: an entry with a null path belongs to no group; null sizes are one size; a null written comes
last; entries alone in their group give no rows; repeated confirmations and self-confirmations count
once and not at all; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("hash", "chapters", "n_refs", "detail")


@F.pandas_udf(T.StringType())
def _compose(paths: pd.Series) -> pd.Series:
    """Lower case and canonical composition; only rows beyond ASCII come here."""
    return paths.map(lambda p: None if p is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", p).lower()))


# So that Spark does not put the call into a filter and a projection and run it twice.
_compose = _compose.asNondeterministic()


def file_key(path: Column) -> Column:
    """What a path names, whatever its case, separators, empty or ``.`` segments, or composition."""
    plain = ~path.rlike(r"[^\x00-\x7F]")
    folded = F.when(plain, F.lower(path)).otherwise(_compose(F.when(~plain, path)))
    return F.array_join(F.filter(F.split(F.replace(folded, F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", ".")), "/")


def confirmation_counts(confirmations: DataFrame) -> DataFrame:
    """``key, pack_device, written, confirmers``: distinct other devices that confirm an entry."""
    other = confirmations.where("pack_device IS NOT NULL AND device IS NOT NULL AND pack_device <> device AND path IS NOT NULL AND written IS NOT NULL")
    by = other.select(file_key(F.col("path")).alias("key"), F.col("device").alias("pack_device"), "written", F.col("pack_device").alias("by")).distinct()
    return by.groupBy("key", "pack_device", "written").agg(F.count("*").alias("confirmers"))


def ranked_entries(entries: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Entries with ``key`` and ``confirmers``."""
    keyed = entries.where("path IS NOT NULL").select("entry_id", "pack_device", "size", "written", *FIELDS, file_key(F.col("path")).alias("key"))
    return keyed.join(confirmation_counts(confirmations), ["key", "pack_device", "written"], "left").withColumn("confirmers", F.coalesce("confirmers", F.lit(0)))


def _order() -> list[Column]:
    return [F.desc("confirmers"), F.desc_nulls_last("written"), F.asc("entry_id")]


def survivors(entries: DataFrame, confirmations: DataFrame) -> DataFrame:
    """``group_id, field, entry_id``: the chosen entry for the record and for each field."""
    ranked = ranked_entries(entries, confirmations)
    filled = [F.lit("record"), *[F.when(_filled(f), F.lit(f)) for f in FIELDS]]
    votes = ranked.select("key", "size", "confirmers", "written", "entry_id", F.explode(F.array_compact(F.array(*filled))).alias("field"))
    # Of each size the first entry for the record and for each field.
    first = votes.withColumn("n", F.row_number().over(Window.partitionBy("key", "size", "field").orderBy(*_order()))).where("n = 1").drop("n")
    # The best of these over all sizes names the record's size.
    top = first.where("field = 'record'").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*_order()))).where("n = 1").select("key", F.col("size").alias("top_size"))
    groups = ranked.groupBy("key").agg(F.min("entry_id").alias("group_id"), F.count("*").alias("members")).where("members > 1")
    chosen = top.join(groups, "key")
    return first.join(chosen, (first["key"] == chosen["key"]) & first["size"].eqNullSafe(chosen["top_size"])).select("group_id", "field", "entry_id")


def _filled(field: str) -> Column:
    c = F.col(field)
    if field == "chapters":
        return c.isNotNull() & (F.size(c) > 0)
    if field == "detail":
        return c.isNotNull() & (c != "")
    return c.isNotNull()


def survivor_records(entries: DataFrame, confirmations: DataFrame) -> DataFrame:
    """One built record per group: the record's own columns, with the chosen value of each field."""
    picks = survivors(entries, confirmations)
    e = entries.select(F.col("entry_id"), "pack_device", "kind", "path", "size", "mtime", "written", "engine", *FIELDS)
    joined = picks.join(e, "entry_id")
    fields = [F.max(F.when(F.col("field") == f, F.struct(f))).getField(f).alias(f) for f in FIELDS]
    own = [F.max(F.when(F.col("field") == "record", F.struct(c))).getField(c).alias(c) for c in ("entry_id", "pack_device", "kind", "path", "size", "mtime", "written", "engine")]
    return joined.groupBy("group_id").agg(*own, *fields)
