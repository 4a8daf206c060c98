"""Files as rows: listing with ignore rules, binary sniff, lossy decoding, formats by extension."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.filters import PathFilter, glob_regex

#: Bytes that are looked at to tell text from binary files.
SNIFF = 8192


@dataclass(frozen=True)
class Walk:
    """How a folder is listed. Files that are named themselves are always taken."""

    hidden: bool = False
    no_ignore: bool = False
    ignore_files: tuple[str, ...] = (".gitignore", ".ignore")
    follow: bool = False
    max_depth: int | None = None
    max_filesize: int | None = None
    filter: PathFilter = PathFilter()


def _rules(folder: str, names: tuple[str, ...]) -> list[tuple[re.Pattern, bool, bool]]:
    """``(pattern, keep, folders only)`` of a folder's ignore files, in order."""
    out = []
    for n in names:
        try:
            lines = open(os.path.join(folder, n), encoding="utf-8", errors="replace").read().splitlines()
        except OSError:
            continue
        for line in lines:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            body = line[1:] if keep else line.removeprefix("\\")
            out.append((re.compile(glob_regex(body.rstrip("/")).replace("(?:/.*)?$", "$")), keep, body.endswith("/")))
    return out


def list_files(paths: list[str], walk: Walk = Walk()) -> list[str]:
    """Local files under ``paths``; a listing for the driver, as a scan's own listing is."""
    out: list[str] = []

    def visit(folder: str, depth: int, rules: list) -> None:
        rules = rules + ([] if walk.no_ignore else [(folder, _rules(folder, walk.ignore_files))])
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            if entry.name.startswith(".") and not walk.hidden:
                continue
            is_dir = entry.is_dir(follow_symlinks=walk.follow)
            ignored = False
            for base, own in rules:
                rel = os.path.relpath(entry.path, base).replace(os.sep, "/")
                for pattern, keep, dirs in own:
                    if (is_dir or not dirs) and pattern.match(rel):
                        ignored = not keep
            if ignored:
                continue
            if is_dir:
                if walk.max_depth is None or depth < walk.max_depth:
                    visit(entry.path, depth + 1, rules)
            elif entry.is_file(follow_symlinks=walk.follow) and (walk.max_filesize is None or entry.stat().st_size <= walk.max_filesize):
                out.append(entry.path)

    for p in paths:
        if os.path.isdir(p):
            visit(p, 1, [])
        else:
            out.append(p)
    return out


def read_binary(spark: SparkSession, path: str, walk: Walk = Walk()) -> DataFrame:
    """``path, size, mtime (ms), content`` of files of any file system, read by tasks; sizes and names are filtered in the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if walk.max_filesize is not None:
        files = files.where(F.col("length") <= walk.max_filesize)
    plain = F.regexp_replace("path", r"^file:/+", "/")
    files = files.withColumn("path", plain).where(walk.filter.predicate(F.col("path")))
    if not walk.hidden:
        files = files.where(~F.col("path").rlike(r"/\.[^/]+"))
    return files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), "content")


def is_binary(content: Column) -> Column:
    """A zero byte among the first bytes."""
    return F.hex(F.substring(content, 1, SNIFF)).rlike("^(?:..)*?00")


@F.pandas_udf(T.StringType())
def decode_lossy(content: pd.Series) -> pd.Series:
    """UTF-8, with a replacement character for what is none."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def kind_of(path: Column) -> Column:
    """``epub``, ``pdf``, ``subtitles`` or ``text``, by extension."""
    ext = F.coalesce(C.extension(path), F.lit(""))
    return F.when(ext == "epub", "epub").when(ext == "pdf", "pdf").when(ext.isin("srt", "vtt", "sbv"), "subtitles").otherwise("text")


def text_files(files: DataFrame, binary: bool = False) -> DataFrame:
    """Text and subtitle files decoded (``path, size, mtime, kind, text``); binary ones are left out."""
    kinds = files.withColumn("kind", kind_of(F.col("path"))).where("kind IN ('text', 'subtitles')")
    kept = kinds if binary else kinds.where(~is_binary(F.col("content")))
    return kept.select("path", "size", "mtime", "kind", decode_lossy("content").alias("text"))


def parse_size(text: str) -> int:
    """``500K``, ``10M``, ``1G`` as bytes."""
    m = re.fullmatch(r"\s*(\d+)\s*([kKmMgG]?)[bB]?\s*", text)
    if not m:
        raise ValueError(f"not a size: {text}")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """``line_no, line`` of each text."""
    cols = [c for c in df.columns if c != text]
    exploded = df.select(*cols, F.posexplode(F.split(text, "\n")).alias("_p", "line"))
    return exploded.select(*cols, (F.col("_p") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))
