"""A multi-device index of references as tables: freshness checks, confirmations, upserts, queries.

Each device writes only its own partitions (device, kind, pack), so devices never conflict. A file's
entry may be another device's, if that device searched the same version.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..canon import Canon
from ..functions.places import fnv1a64, snippet
from ..functions.refs import Options
from .extract import extract_refs

PACKS = 32


def pack_number(h: Column) -> Column:
    """The pack of a file's hash: its unsigned value modulo the packs."""
    return F.pmod(h, F.lit(PACKS)).cast("int")


@F.pandas_udf(T.LongType())
def text_hash(texts: pd.Series) -> pd.Series:
    """FNV-1a of a text's UTF-8 bytes, where files must agree with other programs; else use `xxhash64`."""
    return texts.map(lambda t: None if t is None else fnv1a64(t.encode("utf-8"))).astype("Int64")


def check(listing: DataFrame, entries: DataFrame, confirmations: DataFrame) -> DataFrame:
    """``device, path, size, mtime, status, entry_id, entry_device`` for each listed file of a device.

    ``fresh``: an entry of the same size and mtime, best the device's own, else one it has confirmed for
    this version, else the newest. ``unconfirmed``: only an entry of the same size; the newest is used
    until it is confirmed. ``missing``: none.

    Each of the four is a lookup in entries that an aggregation has made unique by their key, so a file
    with very many entries or sightings never pairs them all.
    """
    files = listing.select("device", "path", "size", "mtime").distinct()
    e = entries.select("entry_id", "pack_device", "path", "size", "mtime", "written")
    newest = F.max_by(F.struct("entry_id", "pack_device"), F.struct(F.coalesce("written", F.lit(-(2**63))), -F.col("entry_id")))

    def best(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.groupBy(*keys).agg(newest.alias(name))

    own = best(e, ["pack_device", "path", "size", "mtime"], "own").withColumnRenamed("pack_device", "device")
    exact = best(e, ["path", "size", "mtime"], "exact")
    same = best(e, ["path", "size"], "same")
    said = confirmations.select(F.col("pack_device").alias("by"), "path", "size", F.col("mtime").alias("seen"), F.col("device").alias("pack_device"), "written").distinct()
    confirmed = best(said.join(e, ["path", "size", "pack_device", "written"]).withColumn("mtime", F.col("seen")).withColumn("device", F.col("by")), ["device", "path", "size", "mtime"], "confirmed")
    joined = files.join(own, ["device", "path", "size", "mtime"], "left").join(confirmed, ["device", "path", "size", "mtime"], "left").join(exact, ["path", "size", "mtime"], "left").join(same, ["path", "size"], "left")
    entry = F.coalesce("own", "confirmed", "exact", "same")
    fresh = F.coalesce("own", "confirmed", "exact").isNotNull()
    status = F.when(fresh, "fresh").when(F.col("same").isNotNull(), "unconfirmed").otherwise("missing")
    return joined.select("device", "path", "size", "mtime", status.alias("status"), entry["entry_id"].alias("entry_id"), entry["pack_device"].alias("entry_device"))


def confirm(listing: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Own entries whose mtime is to be set, and confirmations of other devices' entries.

    For each listed file (``device, path, size, mtime, hash``) the newest entry of its size with its hash,
    or of its size alone where the file's hash is unknown.
    """
    e = entries.select("path", "size", F.col("hash").alias("e_hash"), "pack_device", "written", "entry_id")
    newest = F.max_by(F.struct("entry_id", "pack_device", "written"), F.struct(F.coalesce("written", F.lit(-(2**63))), -F.col("entry_id")))
    by_hash = e.where("e_hash IS NOT NULL").groupBy("path", "size", F.col("e_hash").alias("hash")).agg(newest.alias("e"))
    by_size = e.groupBy("path", "size").agg(newest.alias("e"))
    files = listing.select("device", "path", "size", "mtime", "hash").distinct()
    found = files.where("hash IS NOT NULL").join(by_hash, ["path", "size", "hash"]).select("device", "path", "size", "mtime", "e")
    found = found.unionByName(files.where("hash IS NULL").join(by_size, ["path", "size"]).select("device", "path", "size", "mtime", "e"))
    own = found.where("e.pack_device = device").select("e.entry_id", "mtime")
    other = found.where("e.pack_device <> device").select(F.col("device").alias("pack_device"), "path", "size", "mtime", F.col("e.pack_device").alias("device"), "e.written")
    return own, other


def insert(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with a device's new ones in place of its old ones of the same path."""
    kept = entries.join(new.select("pack_device", "path").distinct(), ["pack_device", "path"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def remove(entries: DataFrame, device: str, paths: DataFrame) -> DataFrame:
    gone = paths.select("path").distinct().withColumn("pack_device", F.lit(device))
    return entries.join(gone, ["pack_device", "path"], "left_anti")


def rename(entries: DataFrame, device: str, old: str, new: str) -> DataFrame:
    """A renamed file, or all of a renamed folder."""
    own = F.col("pack_device") == device
    inside = F.col("path").startswith(old.rstrip("/") + "/")
    return entries.withColumn("path", F.when(own & (F.col("path") == old), F.lit(new)).when(own & inside, F.concat(F.lit(new.rstrip("/")), F.expr(f"substring(path, {len(old.rstrip('/')) + 1})"))).otherwise(F.col("path")))


def retain(entries: DataFrame, device: str, listed: DataFrame) -> DataFrame:
    """Without a device's entries of files that are not listed any more."""
    alive = listed.select("path").distinct()
    own, others = entries.where(F.col("pack_device") == device), entries.where(F.col("pack_device") != device)
    return others.unionByName(own.join(alive, "path", "left_semi").select(*entries.columns))


def load_pack(entries: DataFrame, pack: DataFrame, device: str, kind: str, number: int) -> DataFrame:
    """With one pack of a device replaced as a whole."""
    same = (F.col("pack_device") == device) & (F.col("kind") == kind) & (F.col("pack_number") == number)
    return entries.where(~F.coalesce(same, F.lit(False))).unionByName(pack, allowMissingColumns=True)


def dirty_packs(before: DataFrame, after: DataFrame, device: str) -> DataFrame:
    """Packs of a device whose content differs, by counts and order-free checksums."""

    def digest(df: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(*[c for c in sorted(df.columns)])
        return df.where(F.col("pack_device") == device).groupBy("kind", "pack_number").agg(F.struct(F.count("*"), F.expr("bit_xor(h)"), F.sum(F.col("h").cast("decimal(38,0)"))).alias(name)) if "h" in df.columns else digest(df.withColumn("h", h), name)

    a, b = digest(before, "a"), digest(after.select(*before.columns), "b")
    return a.join(b, ["kind", "pack_number"], "full").where("NOT (a <=> b)").select("kind", "pack_number")


def save(entries: DataFrame, path: str) -> None:
    """Only the partitions that are written are replaced (`spark.sql.sources.partitionOverwriteMode=dynamic`)."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pack_device", "kind", "pack_number").parquet(path)


def build_entries(docs: DataFrame, canon: Canon, device: str, engine: str = "", options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, references and details of searched files (``path, kind, size, mtime, text``).

    The details (snippets) are a table of their own, joined only where they are shown.
    """
    files = docs.withColumn("hash", F.when(F.col("kind") == "text", text_hash("text")))
    refs = extract_refs(files.select("path", "text"), canon, keys=["path"], options=options)
    counts = refs.groupBy("path").agg(F.count("*").cast("int").alias("n_refs"))
    entries = files.join(counts, "path", "left").select(
        F.lit(device).alias("pack_device"), "kind", pack_number(F.coalesce("hash", F.xxhash64("path"))).alias("pack_number"), "path", "size", "mtime", "hash", F.coalesce("n_refs", F.lit(0)).alias("n_refs"), F.lit(engine).alias("engine")
    )

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("at", T.IntegerType())]))
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([snippet(t, int(a), int(b)) for t, a, b in zip(texts, starts, ends, strict=True)], columns=["text", "at"])

    details = refs.select("path", "ref_no", "start_char", "end_char").join(files.select("path", "text"), "path").select("path", "ref_no", cut("text", "start_char", "end_char").alias("s")).select("path", "ref_no", F.col("s.text").alias("snippet"), F.col("s.at").alias("snippet_at"))
    return entries, refs, details


def fingerprint(canon: Canon, options: Options = Options()) -> str:
    """What a stored result depends on besides its file: the canon and the options, not the filters."""
    state = (canon.books, canon.genres, sorted(canon.counts.items()), options.context_book, options.heading, options.books_alone, options.translations)
    return hashlib.sha256(repr(state).encode()).hexdigest()[:16]


def cached_refs(docs: DataFrame, canon: Canon, cache: str, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """References of files (``path, size, mtime, text``) and the stamps that were read from the cache.

    Unfiltered results are stored under the canon's fingerprint; only files whose stamp is not stored are
    searched, and their results are added. A file without references keeps its stamp. Stale stamps stay
    until `prune_cache`.
    """
    spark = docs.sparkSession
    place = f"{cache}/fingerprint={fingerprint(canon, options)}"
    stamp = ["path", "size", "mtime"]
    try:
        stamps, known = spark.read.parquet(f"{place}/stamps"), spark.read.parquet(f"{place}/refs")
    except AnalysisException:
        stamps = known = None
    wanted = docs if stamps is None else docs.join(stamps.select(*stamp), stamp, "left_anti")
    hits = docs.select(*stamp).limit(0) if stamps is None else docs.select(*stamp).join(stamps.select(*stamp), stamp, "left_semi")
    fresh = extract_refs(wanted.select(*stamp, "text"), canon, keys=stamp, options=options)
    # Where the reading and the writing meet, the new results are written first and read back.
    fresh.write.mode("append").parquet(f"{place}/refs")
    wanted.select(*stamp).write.mode("append").parquet(f"{place}/stamps")
    every = spark.read.parquet(f"{place}/refs").dropDuplicates([*stamp, "ref_no"])
    return every.join(docs.select(*stamp), stamp, "left_semi"), hits


def prune_cache(docs: DataFrame, canon: Canon, cache: str, options: Options = Options()) -> None:
    """Rewrite the cache without files that are gone or have changed."""
    spark = docs.sparkSession
    place = f"{cache}/fingerprint={fingerprint(canon, options)}"
    stamp = ["path", "size", "mtime"]
    for name in ("refs", "stamps"):
        kept = spark.read.parquet(f"{place}/{name}").join(docs.select(*stamp), stamp, "left_semi")
        kept.write.mode("overwrite").parquet(f"{place}/{name}_new")
        spark.read.parquet(f"{place}/{name}_new").write.mode("overwrite").parquet(f"{place}/{name}")


def scope(entries: DataFrame, file: str | None = None, folder: str | None = None) -> DataFrame:
    if file is not None:
        return entries.where(F.col("path") == file)
    if folder:
        return entries.where(F.col("path").startswith(folder.rstrip("/") + "/"))
    return entries


def book_bitmap(refs: DataFrame, key: str = "path") -> DataFrame:
    """Books of each file as four 64-bit words, so that files without a book are skipped unread."""
    words = [F.expr(f"bit_or(CASE WHEN book_id DIV 64 = {w} THEN shiftleft(1L, CAST(book_id % 64 AS INT)) ELSE 0L END)").alias(f"w{w}") for w in range(4)]
    return refs.groupBy(key).agg(*words).select(key, F.array("w0", "w1", "w2", "w3").alias("books"))


def bitmap_has(books: Column, wanted: list[int]) -> Column:
    """Whether a bitmap holds any of the books."""
    masks = [0, 0, 0, 0]
    for b in wanted:
        masks[b // 64] |= 1 << (b % 64)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tests = [F.get(books, w).bitwiseAND(F.lit(m).cast("bigint")) != 0 for w, m in enumerate(signed) if m]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
