"""Subtitles (SRT, WebVTT, SBV): cues as rows, and references placed in them by a range join."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = re.compile(r"(?:^|(?<=\n))(?:[^\n]*[^\s﻿][^\n]*(?:\n|$))+")
_TIME = r"\s*(?:(\d+)\s*:)?\s*(\d+)\s*:\s*(\d+)[.,]\s*(\d+)\s*"
_ARROW = re.compile(rf"^{_TIME}-->\s*{_TIME}(?:\s.*)?$")
_COMMA = re.compile(r"^\s*(?:(\d+):)?(\d+):(\d+)\.(\d+)\s*,\s*(?:(\d+):)?(\d+):(\d+)\.(\d+)\s*$")
#: Characters per bucket of the range join: about the length of a cue and more.
BUCKET = 512


class Cue(NamedTuple):
    number: int
    id: int
    start_ms: int
    end_ms: int
    text: str
    start: int  # characters, of the whole block
    end: int


def _ms(h: str | None, m: str, s: str, f: str) -> int:
    return ((int(h or 0) * 60 + int(m)) * 60 + int(s)) * 1000 + int(f)


def _times(line: str) -> tuple[int, int] | None:
    line = line.strip("\r\n").lstrip("﻿")
    m = _ARROW.match(line) or _COMMA.match(line)
    return (_ms(*m.groups()[:4]), _ms(*m.groups()[4:8])) if m else None


def cues(text: str) -> list[Cue]:
    """Blocks between blank lines that have a time line, first or behind an id; other blocks are skipped."""
    out: list[Cue] = []
    for m in _BLOCK.finditer(text):
        lines = m[0].splitlines(keepends=True)
        times, head = _times(lines[0]), 1
        id_ = 0
        if times is None and len(lines) > 1:
            times, head = _times(lines[1]), 2
            label = lines[0].strip().lstrip("﻿")
            id_ = int(label) if label.isascii() and label.isdigit() else 0
        if times is None:
            continue
        out.append(Cue(len(out) + 1, id_, *times, "".join(lines[head:]).rstrip(), m.start(), m.end()))
    return out


def cue_rows(df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """``keys, cue_no, cue_id, start_ms, end_ms, cue_text, cue_start, cue_end``; null texts have no cues."""
    keys = [c for c in df.columns if c != text] if keys is None else keys
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *c) for i, t in enumerate(batch.column(n).to_pylist()) if t for c in cues(t)]
            at, number, id_, a, b, body, start, end = zip(*rows, strict=True) if rows else [()] * 8
            ints = [pa.array(number, pa.int32()), pa.array(id_, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(body, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at, pa.int32())) for c in range(n)] + ints, names=[*keys, "cue_no", "cue_id", "start_ms", "end_ms", "cue_text", "cue_start", "cue_end"])

    own = [("cue_no", T.IntegerType()), ("cue_id", T.LongType()), ("start_ms", T.LongType()), ("end_ms", T.LongType()), ("cue_text", T.StringType()), ("cue_start", T.IntegerType()), ("cue_end", T.IntegerType())]
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(a, b) for a, b in own])
    return df.select(*keys, text).mapInArrow(run, schema)


def stamp(ms) -> F.Column:
    """Milliseconds as ``HH:MM:SS.mmm``."""
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def place_in_cues(refs: DataFrame, cue_df: DataFrame, keys: list[str], start: str = "start_char", end: str = "end_char") -> DataFrame:
    """References with ``cue_id, cue_start_ms, cue_end_ms, label``: from their first cue to their last; null outside cues.

    A range join in buckets of the text: a cue is in every bucket that it covers, so both joins are
    equi-joins on document and bucket, and a long transcript spreads over its buckets.
    """
    c = cue_df.select(*keys, "cue_id", "start_ms", "end_ms", "cue_start", "cue_end").withColumn("_b", F.explode(F.expr(f"sequence(cue_start DIV {BUCKET}, (cue_end - 1) DIV {BUCKET})"))).where("cue_end > cue_start")

    def at(df: DataFrame, where: F.Column, name: str, columns: dict[str, str]) -> DataFrame:
        right = c.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.col("_b").alias(f"_{name}_b"), F.col("cue_start").alias(f"_{name}_s"), F.col("cue_end").alias(f"_{name}_e"), *[F.col(a).alias(b) for a, b in columns.items()])
        on = [F.col(k) == F.col(f"_{name}_{k}") for k in keys] + [F.floor(where / BUCKET) == F.col(f"_{name}_b"), where >= F.col(f"_{name}_s"), where < F.col(f"_{name}_e")]
        joined = df.join(right, on, "left")
        return joined.drop(*[x for x in joined.columns if x.startswith(f"_{name}_")])

    first = at(refs, F.col(start), "f", {"cue_id": "cue_id", "start_ms": "cue_start_ms", "end_ms": "_first_end"})
    last = at(first, F.col(end) - 1, "l", {"end_ms": "_last_end"})
    return last.withColumn("cue_end_ms", F.when(F.col("cue_id").isNotNull(), F.coalesce("_last_end", "_first_end"))).withColumn("label", F.when(F.col("cue_start_ms").isNotNull(), stamp(F.col("cue_start_ms")))).drop("_first_end", "_last_end")
