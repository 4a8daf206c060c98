"""Orders of references, pages, counts, and book suggestions as a ranking over the dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def file_order() -> list[Column]:
    """By path without case, then path, then place in the file."""
    return [F.lower("path"), F.col("path"), F.col("ref_no")]


def bible_order() -> list[Column]:
    """By the canon (a whole chapter before its verses), then as files."""
    return [C.canon_key(F.col("book_id"), F.col("segments")), *file_order()]


def page(refs: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of an order; a small limit is a top-k, which never sorts everything."""
    return refs.orderBy(*order).offset(offset).limit(limit)


def counts_per_file(refs: DataFrame) -> DataFrame:
    return refs.groupBy("path").agg(F.count("*").alias("refs"))


def extension_counts(refs: DataFrame) -> DataFrame:
    """References and files per extension, files counted once."""
    per_file = refs.groupBy("path").agg(F.count("*").alias("n"))
    return per_file.groupBy(C.extension(F.col("path")).alias("extension")).agg(F.sum("n").alias("refs"), F.count("*").alias("files"))


def files_without(files: DataFrame, refs: DataFrame, key: str = "path") -> DataFrame:
    return files.join(refs.select(key), key, "left_anti")


def files_with(files: DataFrame, refs: DataFrame, key: str = "path") -> DataFrame:
    return files.join(refs.select(key), key, "left_semi")


def suggest_books(keys: DataFrame, books: DataFrame, typed: str, limit: int = 10) -> DataFrame:
    """Books for what is typed (``book_id, name, rank``): exact, prefix, prefix without spaces, a later word; then the canon's order.

    ``keys`` has ``key, book_id``, ``books`` has ``book_id, name, osis``.
    """
    text = " ".join(typed.lower().strip().rstrip(".").split())
    every = keys.select("key", "book_id").unionByName(books.where("osis IS NOT NULL").select(F.lower("osis").alias("key"), "book_id"))
    if not text:
        return books.select("book_id", "name", F.lit(0).alias("rank")).limit(0)
    key, tight = F.col("key"), text.replace(" ", "")
    later = F.exists(F.slice(F.split(key, " "), 2, 99), lambda w: w.startswith(text)) if " " not in text else F.lit(False)
    exact = key == text
    rank = F.when(exact, 0).when(key.startswith(text), 1).when(F.replace(key, F.lit(" "), F.lit("")).startswith(tight), 2).when(later, 3)
    ranked = every.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("book_id").agg(F.min("rank").alias("rank"))
    return ranked.join(books.select("book_id", "name"), "book_id").orderBy("rank", "book_id").limit(limit)
