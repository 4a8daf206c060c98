"""Encoding of whole texts with a public byte-level BPE vocabulary, by corpus-level merge replay.

`encode_corpus`, in three steps:

1. Texts are cut into words by the vocabulary's pattern; the distinct words of the whole corpus are counted, combined on
   the map side, so that what is shuffled is the vocabulary of the corpus and not its tokens.
2. The words are sharded by hash. Over the words of a shard an inverted index from token pair to positions tells where
   each merge applies; the merges run in rank order and each touches only its neighbours. Words are independent
   of each other, so every shard is exact. Words and ids are written to the shared folder.
3. Texts look their words up: the `FREQUENT_WORDS` most frequent of them in a broadcast table, whose size is
   bounded by that and by `LONG_WORD`. Only words beyond these are joined to the texts that hold them, by the hash of the text.

`encode_column` replays the new words of each batch on the worker that meets them and shuffles nothing: for streams,
where there is no corpus to go through first. The ids are the same.

Defined ids: an empty and a null text give an empty list. Strings of special tokens are ordinary text.
Every byte is a token, so any text of any length can be encoded; a lone surrogate cannot occur in Spark.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import scratch_path, spread

#: Where the vocabulary files of public tokenizers lie; a parameter of every function that needs it.
VOCABULARIES = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the public pattern that cuts a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker keeps; beyond that it starts anew. Bounds its memory, not the results.
KEPT_WORDS = 400_000
#: Characters of a word beyond which it is not kept: such words hardly recur.
LONG_WORD = 200
#: Words of the table that goes to every worker, at most LONG_WORD characters each.
FREQUENT_WORDS = 200_000
#: Words that one index is built over, and distinct words that a task counts before it hands them on.
REPLAY_WORDS, COUNTED_WORDS = 100_000, 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Replays the merges of a vocabulary over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.known: dict[int, int] = {}

    def _merged(self, a: int, b: int) -> int:
        """The id of two tokens joined, -1 where there is none."""
        key = a << 32 | b
        got = self.known.get(key)
        if got is None:
            got = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
            if len(self.known) < 1_000_000:
                self.known[key] = got
        return got

    def encode(self, words: Iterable[bytes]) -> list[list[int]]:
        single, merged = self.single, self._merged
        ids: list[int] = []
        following: list[int] = []
        preceding: list[int] = []
        starts: list[int] = []
        for word in words:
            at = len(ids)
            starts.append(at)
            if not word:
                continue
            n = len(word)
            ids.extend(single[b] for b in word)
            following.extend(range(at + 1, at + n))
            following.append(-1)
            preceding.append(-1)
            preceding.extend(range(at, at + n - 1))
        # Inverted index: rank of a pair's merge to the positions of its left tokens.
        index: dict[int, list[int]] = {}
        for i, j in enumerate(following):
            if j >= 0 and (r := merged(ids[i], ids[j])) >= 0:
                index.setdefault(r, []).append(i)
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank, None)
            if places is None:
                continue
            for i in sorted(places):
                if ids[i] < 0 or (j := following[i]) < 0 or merged(ids[i], ids[j]) != rank:
                    continue
                ids[i], ids[j] = rank, -1
                after, before = following[j], preceding[i]
                following[i] = after
                if after >= 0:
                    preceding[after] = i
                    if (r := merged(rank, ids[after])) >= 0:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(queue, r)
                        index[r].append(i)
                if before >= 0 and (r := merged(ids[before], rank)) >= 0:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(queue, r)
                    index[r].append(before)
        starts.append(len(ids))
        return [[x for x in ids[a:b] if x >= 0] for a, b in zip(starts, starts[1:], strict=False)]


class Encoder:
    """Texts to ids, with the words met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, kept: int = KEPT_WORDS):
        import regex

        self.split = regex.compile(pattern).findall
        self.replay, self.kept = MergeReplay(ranks), kept
        self.words: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of the texts."""
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.words) > self.kept:
            self.words.clear()
        words = self.words
        fresh = list({w: None for c in cut for w in c if w not in words})
        words.update(zip(fresh, self.replay.encode(w.encode("utf-8") for w in fresh), strict=True))
        flat: list[int] = []
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, c in enumerate(cut):
            for w in c:
                flat += words[w]
            offsets[i + 1] = len(flat)
        for w in fresh:
            if len(w) > LONG_WORD:
                del words[w]
        return np.array(flat, dtype=np.int32), offsets


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = VOCABULARIES):
    """A vocabulary for the workers; its size is that of one small file."""
    return spark.sparkContext.broadcast(read_ranks(f"{folder}/{name}.tiktoken"))


def encode_column(df: DataFrame, column: str, out: str = "ids", name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``df`` with the ids of ``column`` as an array<int>, never null."""
    shared = vocabulary(df.sparkSession, name, folder)
    state: dict[str, Encoder] = {}

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = state.setdefault("e", Encoder(shared.value))
        for batch in batches:
            parts = []
            for lo in range(0, max(1, len(batch)), 1000):  # small pieces: the ids of a batch of long texts are large
                flat, offsets = e.encode_batch(batch.slice(lo, 1000).to_pylist())
                parts.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)))
            yield pa.concat_arrays(parts)

    return spread(df).withColumn(out, encode(F.col(column)))


def count_words(texts: DataFrame, column: str, pattern: str = PATTERN) -> DataFrame:
    """``word, n``: how often each word occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        counts: Counter[str] = Counter()

        def drain() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                counts.update(split(text.as_py()))
                if len(counts) > COUNTED_WORDS:
                    yield drain()
        yield drain()

    rows = texts.select(F.col(column).alias("text")).where("text <> ''")
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def replay_words(words: DataFrame, ranks) -> DataFrame:
    """``word, n, ids``: the words of each shard replayed together; ``ranks`` is a broadcast vocabulary."""

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = MergeReplay(ranks.value)

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            ids = engine.encode(w.as_py().encode("utf-8") for w in table.column("word"))
            return pa.RecordBatch.from_arrays([*(pa.concat_arrays(table.column(c).chunks) for c in ("word", "n")), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= REPLAY_WORDS:
                yield done(held)
                held = []
        if held and sum(b.num_rows for b in held):
            yield done(held)

    return words.mapInArrow(replay, "word string, n bigint, ids array<int>")


def encode_corpus(df: DataFrame, column: str, out: str = "ids", name: str = "byte_bpe_50k", folder: str = VOCABULARIES, frequent: int = FREQUENT_WORDS) -> DataFrame:
    """``df`` with the ids of ``column`` as an array<int>, never null; every distinct word of the corpus is replayed once."""
    spark = df.sparkSession
    rows = spread(df)
    at = scratch_path(spark, "bpe-words")
    replay_words(count_words(rows, column), vocabulary(spark, name, folder)).write.parquet(at)
    words = spark.read.schema("word string, n bigint, ids array<int>").parquet(at)
    short = words.where(F.length("word") <= LONG_WORD)
    # At most `frequent` words come to the driver; ties are settled by the word, so that every attempt takes the same.
    top = short.orderBy(F.desc("n"), "word").limit(frequent).select("word", "ids").toArrow()
    table = spark.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), top.column("ids").to_pylist(), strict=True)))
    if words.count() == top.num_rows:
        return rows.withColumn(out, _looked_up(table)(F.col(column), F.lit(None).cast("array<struct<word:string,ids:array<int>>>")))
    # Words beyond the table, joined to the texts that hold them. Equal hashes of different texts share a longer list, no more.
    key = F.xxhash64(F.col(column)).alias("_text")
    rare = rows.select(key, F.col(column).alias("text")).where("text <> ''").mapInArrow(_rare_words(table), "_text bigint, word string").distinct()
    own = rare.join(words.select("word", "ids"), "word").groupBy("_text").agg(F.collect_list(F.struct("word", "ids")).alias("_own"))
    joined = rows.withColumn("_text", key).join(own, "_text", "left")
    return joined.withColumn(out, _looked_up(table)(F.col(column), F.col("_own"))).drop("_text", "_own")


def _rare_words(table, pattern: str = PATTERN):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, known = regex.compile(pattern).findall, table.value
        for batch in batches:
            pairs = [(k, w) for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for w in set(split(text.as_py())) if w not in known]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.string())], names=["_text", "word"])

    return find


def _looked_up(table, pattern: str = PATTERN):
    @F.arrow_udf("array<int>")
    def look_up(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import regex

        split, known = regex.compile(pattern).findall, table.value
        for texts, owns in batches:
            parts = []
            for lo in range(0, max(1, len(texts)), 1000):  # small pieces: the ids of a batch of long texts are large
                flat: list[int] = []
                ends = [0]
                for text, own in zip(texts.slice(lo, 1000), owns.slice(lo, 1000), strict=True):
                    if value := text.as_py():
                        if own.is_valid:
                            mine = {x["word"]: x["ids"] for x in own.as_py()}
                            for w in split(value):
                                flat += known[w] if w in known else mine[w]
                        else:
                            for w in split(value):
                                flat += known[w]
                    ends.append(len(flat))
                parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.int32))))
            yield pa.concat_arrays(parts)

    return look_up
