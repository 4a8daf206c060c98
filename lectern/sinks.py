"""What a search prints: references by name, quickfix lines, JSON rows, tables, lines of context, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canon import Canon
from .functions import columns as C
from .sources.files import lines


def named(refs: DataFrame, canon: Canon) -> DataFrame:
    """References with ``reference`` (name and segments), ``osis`` and ``usfm``."""
    books = F.broadcast(canon.dim_books(refs.sparkSession).select("book_id", F.col("name").alias("_name"), F.col("osis").alias("_osis"), F.col("usfm").alias("_usfm"), "n_chapters"))
    r = refs.join(books, "book_id", "left")
    s = F.col("segments")
    whole = (F.size(s) == 1) & F.element_at(s, 1)["kind"].isin(3, 4) & (F.element_at(s, 1)["sc"] == 1) & (F.element_at(s, 1)["ec"] == F.col("n_chapters"))
    text = F.when(F.coalesce(whole, F.lit(False)), F.col("_name")).otherwise(F.concat_ws(" ", "_name", C.write_segments(s)))
    return r.withColumn("reference", text).withColumn("osis", C.osis(F.col("_osis"), s)).withColumn("usfm", C.usfm(F.col("_usfm"), s)).drop("_name", "_osis", "_usfm", "n_chapters")


def quickfix(refs: DataFrame, canon: Canon, label: str | None = None) -> DataFrame:
    """``path:line:column: reference (label)``."""
    r = named(refs, canon)
    tail = F.when(F.col(label).isNotNull(), F.concat(F.lit(" ("), F.col(label), F.lit(")"))).otherwise("") if label else F.lit("")
    return r.withColumn("line", F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("col_char").cast("string"), F.lit(": "), F.col("reference"), tail))


def context_lines(docs: DataFrame, refs: DataFrame, before: int = 0, after: int = 0, key: str = "path", text: str = "text") -> DataFrame:
    """``key, line_no, line, hit``: the lines of hits and those around them, each once.

    The lines wanted are listed from the hits, so only an equi-join by file and line is needed.
    """
    wanted = refs.select(key, F.explode(F.sequence(F.col("line") - before, F.col("end_line") + after)).alias("line_no"), F.col("line").alias("_a"), F.col("end_line").alias("_b"))
    wanted = wanted.groupBy(key, "line_no").agg(F.max((F.col("line_no") >= F.col("_a")) & (F.col("line_no") <= F.col("_b"))).alias("hit"))
    return lines(docs.select(key, text), text).join(wanted, [key, "line_no"]).select(key, "line_no", "line", "hit")


def json_rows(refs: DataFrame, canon: Canon) -> DataFrame:
    """One JSON text per reference, with every offset."""
    r = named(refs, canon).withColumn("segments_json", C.segments_json(F.col("segments")))
    keep = [c for c in ("path", "reference", "osis", "book_id", "segments_json", "line", "col_char", "col_utf16", "start_byte", "end_byte", "start_utf16", "end_utf16", "written", "translation") if c in r.columns]
    return r.select(F.to_json(F.struct(*keep)).alias("json"))


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """An aligned table of a few rows; a column without any value is left out."""
    shown = [c for c in columns if any(r.get(c) not in (None, "") for r in rows)] or columns[:1]
    cells = [[str(r.get(c) if r.get(c) is not None else "") for c in shown] for r in rows]
    widths = [max(len(c), *(len(r[i]) for r in cells)) if cells else len(c) for i, c in enumerate(shown)]
    row = lambda values: "| " + " | ".join(v.ljust(w) for v, w in zip(values, widths, strict=True)) + " |"
    return "\n".join([row(shown), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(row, cells)])


def write_refs(refs: DataFrame, path: str) -> None:
    """Stored by book and sorted by place, so that scopes prune partitions and ranges prune row groups."""
    first = F.element_at("segments", 1)
    refs.withColumn("bcv_start", C.bcv_start(F.col("book_id"), first)).repartition("book_id").sortWithinPartitions("bcv_start").write.mode("overwrite").partitionBy("book_id").parquet(path)
