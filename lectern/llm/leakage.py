"""Evaluation texts leaking into training text: rare n-gram seeds, then Smith-Waterman alignment.

Everything is joined on the cluster; no item and no document comes to the driver.

1. Items become hashes of words, without their stock lines. Every five words are a seed. Seeds of few
   items (rare) are join keys. Where a seed is common, the fifteen words around it become keys instead, one
   for each way in which one or two of them may be changed: a common seed never multiplies pairs, and none is lost.
2. All documents pass once by a filter of fixed size over those keys (`FILTER_BITS`, however many items
   there are). What passes (the hits, and the words around them in blocks) is written to the shared folder.
3. Hits meet the keys in an equi-join; what is left are pairs of a block and an item with the diagonals to look at.
4. Each pair is aligned by Smith-Waterman in its sparse form: the stretches of five matching words or more on
   those diagonals are chained, an edit (a word replaced, inserted or left out) costs a link, and between two
   edits five words must match, so that changes lie six words apart. The score is the number of the item's consecutive
   words that the best chain covers; from `RUN` on it is a leak. The band is what edits can shift: one diagonal each.
5. Where another item's alignment covers the same stretch of the document with fewer edits, the text was
   taken from that one: items written after one template do not count for each other. Equal scores all count.

Words are compared without case, punctuation, markup, line breaks, hyphenation and numbers (inserted
numbering); an item's own numerals count in the length of its runs. A stock line is an item's first sentence
that stands nowhere else than first, before at least `STOCK_CONTINUATIONS` different second sentences with
`RUN` words or more behind it; it is taken off once. Questions on one passage share its second sentence,
so their passage is none. ``stock_lines`` names them outright instead.

Odd input: null and empty texts and null ids on either side share nothing; items shorter than the run length cannot
leak; repeated documents and items are reported once per pair of ids; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import scratch_path, spread

SEED = 5
RUN = 15
#: Changed words within a run lie at least so many words apart.
APART = 6
#: A seed of at most so many items is a join key by itself. It moves work between the two kinds of keys, never a result.
RARE_ITEMS = 32
#: Different second sentences that make a first sentence a stock line.
STOCK_CONTINUATIONS = 3
#: Bits of the filter over all keys, 16 MB on each worker, whatever the number of items.
FILTER_BITS = 1 << 27
#: Words of a document that are aligned together, besides the longest item's length on both sides.
BLOCK = 512
#: Distinct words whose hash a worker remembers. Bounds its memory, not the results.
KEPT_WORDS = 500_000

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_HYPHEN = re.compile(r"(?<=\w)[-‐­][ \t]*\r?\n[ \t>]*(?=\w)")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+")

_M = np.uint64(0x9E3779B97F4A7C15)


def _plain(text: str) -> str:
    """The text without markup, hyphenation and invisible characters, in compatibility form."""
    s = _TAG.sub("", text) if "<" in text else text
    if "\n" in s:
        s = _HYPHEN.sub("", s)
    if not s.isascii():
        s = s.replace("­", "").replace("​", "")
        if not unicodedata.is_normalized("NFKC", s):
            s = unicodedata.normalize("NFKC", s)
    return s


class Coder:
    """Words to 64-bit hashes that are the same on every worker; numbers are 0."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _miss(self, word: str) -> int:
        w = word.casefold().replace("'", "").replace("’", "")
        h = 0 if w.isdigit() else int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1
        if len(word) <= 64:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            self.known[word] = h
        return h

    def codes(self, text: str | None) -> list[int]:
        """A hash per word, numbers included as 0."""
        if not text:
            return []
        words = _WORD.findall(_plain(text))
        got = list(map(self.known.get, words))
        if None in got:
            got = [self._miss(w) if g is None else g for w, g in zip(words, got, strict=True)]
        return got


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M
    return h ^ (h >> np.uint64(29))


def seeds_of(codes: np.ndarray) -> np.ndarray:
    """A 64-bit key of every `SEED` words in a row."""
    n = codes.size - SEED + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(SEED):
        key = (key + codes[k : k + n]) * _M
    return _mixed(key)


def _patterns() -> np.ndarray:
    """Every way in which at most two words within a run may be changed, as rows of 0 (changed) and 1."""
    inner = range(1, RUN - 1)
    ways = [(), *((a,) for a in inner), *((a, b) for a in inner for b in inner if b - a >= APART)]
    out = np.ones((len(ways), RUN), dtype=np.uint64)
    for row, changed in enumerate(ways):
        out[row, list(changed)] = 0
    return out


_PATTERNS = _patterns()
_WEIGHTS = np.random.default_rng(15).integers(1, 1 << 63, size=RUN, dtype=np.uint64) | np.uint64(1)


def pattern_keys(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each start, a key of its `RUN` words under each pattern of changes: starts x patterns."""
    window = codes[starts[:, None] + np.arange(RUN)] * _WEIGHTS
    return _mixed((window[:, None, :] * _PATTERNS[None, :, :]).sum(axis=2, dtype=np.uint64) + np.arange(1, len(_PATTERNS) + 1, dtype=np.uint64))


def _around(places: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of `RUN` words that hold the seeds at ``places``."""
    starts = np.unique((places[:, None] - np.arange(RUN - SEED + 1)).ravel())
    return starts[(starts >= 0) & (starts <= n - RUN)]


# --- alignment --------------------------------------------------------------------------------------


def alignments(doc: np.ndarray, item: np.ndarray, diagonals: Iterable[int], ordinals: np.ndarray | None = None) -> list[tuple[int, int, int, list[int]]]:
    """Best chains of matching stretches, as ``(score, first, last word in doc, places of edits in doc)``.

    ``ordinals`` are the places of the item's words among all its words, numerals included; scores count in them.
    """
    n, m = item.size, doc.size
    at = ordinals if ordinals is not None else np.arange(n)
    stretches: list[tuple[int, int, int]] = []
    near = sorted({e for d in diagonals for e in (d - 1, d, d + 1)})
    for d in near:
        lo, hi = max(0, -d), min(n, m - d)
        if hi - lo < SEED:
            continue
        same = np.flatnonzero(np.diff(np.concatenate(([False], doc[lo + d : hi + d] == item[lo:hi], [False])).astype(np.int8)))
        for a, b in zip((same[::2] + lo).tolist(), (same[1::2] + lo - 1).tolist(), strict=True):
            if b - a + 1 >= SEED:
                stretches.append((a, b, d))
    stretches.sort()

    def equal(i: int, d: int) -> bool:
        return 0 <= i < n and 0 <= i + d < m and item[i] == doc[i + d]

    def head(i: int, d: int) -> tuple[int, int] | None:
        """The first matching word when going back from ``i``, and the diagonal."""
        k = i
        while equal(k, d):
            k -= 1
        return (k + 1, d) if k < i else None

    # Of each stretch: the chain behind it as (first item word, its diagonal, places of edits).
    chains: list[tuple[int, int, list[int]]] = []
    out = []
    for k, (a, b, d) in enumerate(stretches):
        options: list[tuple[int, int, list[int]]] = [(a, d, [])]
        # Fewer than five words before an edit may begin a run: replaced, inserted, left out.
        for i, e, place in ((a - 2, d, a - 1 + d), (a - 1, d - 1, a - 1 + d), (a - 2, d + 1, a + d)):
            if got := head(i, e):
                options.append((*got, [place]))
        for j in range(k):
            a2, b2, d2 = stretches[j]
            if d2 == d and a == b2 + 2:
                options.append((*chains[j][:2], [*chains[j][2], b2 + 1 + d]))
            elif d2 == d - 1 and a <= b2 + 1 <= b - SEED + 1 and a2 < a:  # a word inserted into the document
                options.append((*chains[j][:2], [*chains[j][2], b2 + 1 + d2]))
            elif d2 == d + 1 and a <= b2 + 2 <= b - SEED + 1 and a2 < a:  # a word of the item left out
                options.append((*chains[j][:2], [*chains[j][2], b2 + 2 + d]))
        first = min(options, key=lambda o: (int(at[o[0]]), len(o[2])))
        chains.append(first)
        # The end: the stretch, and up to four words behind one more edit.
        best = (int(at[b]) - int(at[first[0]]) + 1, b + d, first[2])
        for i, e, place in ((b + 2, d, b + 1 + d), (b + 1, d + 1, b + 1 + d), (b + 2, d - 1, b + 1 + d)):
            if b - a + 1 < SEED or not equal(i, e):
                continue
            t = i
            while equal(t + 1, e):
                t += 1
            score = int(at[t]) - int(at[first[0]]) + 1
            if score > best[0]:
                best = (score, t + e, [*first[2], place])
        out.append((best[0], first[0] + first[1], best[1], best[2]))
    return out


# --- the pipeline -----------------------------------------------------------------------------------


def _coded_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of an item, where its first sentence ends, and hashes of its sentences."""
    coder = Coder()

    def sentence(codes: list[int]) -> int:
        return int.from_bytes(hashlib.blake2b(np.array(codes, dtype=np.uint64).tobytes(), digest_size=8).digest(), "little", signed=True)

    for batch in batches:
        rows = []
        for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts = [c for s in _SENTENCE.split(text.strip()) if (c := coder.codes(s))]
            whole = coder.codes(text)
            if sum(map(len, parts)) != len(whole):  # markup or hyphenation across sentences
                parts = [whole]
            rows.append((item_id, np.array(whole, dtype=np.uint64).astype(np.int64).tolist(), len(parts[0]) if parts else 0, [sentence(c) for c in parts]))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(pa.int64()))], names=["item_id", "codes", "head", "sentences"]
        )


def coded_items(items: DataFrame, stock_lines: list[str] | None = None) -> DataFrame:
    """``item_id, codes`` (hashes of words, 0 for numbers) without the stock lines."""
    rows = items.where("item_id IS NOT NULL AND trim(text) <> ''").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    coded = rows.mapInArrow(_coded_items, "item_id bigint, codes array<bigint>, head int, sentences array<bigint>")
    first = F.col("sentences")[0]
    if stock_lines is not None:
        lines = items.sparkSession.createDataFrame([(0, s) for s in stock_lines], "item_id bigint, text string")
        stock = lines.mapInArrow(_coded_items, "item_id bigint, codes array<bigint>, head int, sentences array<bigint>").select(first.alias("line"))
    else:
        opened = coded.where((F.size("sentences") > 1) & (F.size("codes") - F.col("head") >= RUN))
        stock = opened.groupBy(first.alias("line")).agg(F.count_distinct(F.col("sentences")[1]).alias("n")).where(F.col("n") >= STOCK_CONTINUATIONS)
        inside = coded.select(F.explode(F.slice("sentences", 2, 1 << 30)).alias("line"))
        stock = stock.select("line").join(inside, "line", "left_anti")
    marked = coded.join(stock.distinct().withColumn("stock", F.lit(True)), first == F.col("line"), "left")
    kept = F.when(F.col("stock"), F.slice("codes", F.col("head") + 1, 1 << 30)).otherwise(F.col("codes"))
    return marked.select("item_id", kept.alias("codes")).where(F.size("codes") >= RUN)


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes without numbers, and their places among all words."""
    at = np.flatnonzero(codes)
    return codes[at].view(np.uint64), at


_ITEMS = "item_id bigint, words array<bigint>, ordinals array<int>, seeds array<bigint>"


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their words but numbers, the places of these among all, and the seeds."""
    for batch in batches:
        columns: tuple[list, ...] = ([], [], [], [])
        for item_id, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, at = _words(np.array(codes, dtype=np.int64))
            for column, value in zip(columns, (item_id, words.view(np.int64), at, seeds_of(words).view(np.int64)), strict=True):
                column.append(value)
        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item_id", "words", "ordinals", "seeds"])


def _item_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the runs around an item's common seeds."""
    for batch in batches:
        for item_id, codes, common in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = np.array(codes, dtype=np.int64).view(np.uint64)
            starts = _around(np.array(common, dtype=np.int64), words.size)
            if starts.size:
                keys = pattern_keys(words, starts)
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.full(keys.size, item_id, dtype=np.int64)), pa.array(np.repeat(starts, n).astype(np.int32))], names=["key", "item_id", "place"])


def _filters(keys: DataFrame, common: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bit sets over the keys and over the common seeds. At most FILTER_BITS / 64 words of each come to the driver."""
    bit = F.col("key").bitwiseAND(FILTER_BITS - 1)
    both = keys.select("key", F.lit(0).alias("kind")).unionByName(common.select("key", F.lit(1).alias("kind")))
    words = both.groupBy("kind", F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(63).cast("int"))).alias("bits"))
    out = (np.zeros(FILTER_BITS // 64, dtype=np.uint64), np.zeros(FILTER_BITS // 64, dtype=np.uint64))
    got = words.toPandas()
    for kind in (0, 1):
        mine = got["kind"].to_numpy() == kind
        out[kind][got["word"].to_numpy()[mine]] = got["bits"].to_numpy()[mine].view(np.uint64)
    return out


def _in(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


_BLOCKS = "doc_id bigint, copy bigint, block int, base int, words binary, hits array<struct<key:bigint,pos:int>>"


def _screen(shared, reach: int):
    """Documents to the blocks of their words in which the filter lets something pass."""
    state: dict[str, Coder] = {}

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = state.setdefault("c", Coder())
        keys, common = shared.value
        any_common = bool(common.any())
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                texts = [np.array(coder.codes(t), dtype=np.uint64) for t in piece.column(2).to_pylist()]
                texts = [t[t != 0] for t in texts]
                sizes = np.array([t.size for t in texts], dtype=np.int64)
                flat = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint64)
                starts = np.cumsum(sizes) - sizes
                owner = np.repeat(np.arange(sizes.size), sizes)
                seeds = seeds_of(flat)
                # A seed lies in one document.
                whole = owner[: seeds.size] == owner[SEED - 1 :] if seeds.size else np.zeros(0, dtype=bool)
                hit = np.flatnonzero(_in(seeds, keys) & whole)
                pos, found = [hit], [seeds[hit]]
                if any_common:
                    often = np.flatnonzero(_in(seeds, common) & whole)
                    runs = _around(often, flat.size)
                    runs = runs[owner[runs] == owner[runs + RUN - 1]] if runs.size else runs
                    for at in range(0, runs.size, 4096):
                        part = runs[at : at + 4096]
                        k = pattern_keys(flat, part)
                        r, c = np.nonzero(_in(k, keys))
                        pos.append(part[r])
                        found.append(k[r, c])
                p, k = np.concatenate(pos), np.concatenate(found)
                if not p.size:
                    continue
                doc = owner[p]
                local = p - starts[doc]
                block = local // BLOCK
                order = np.lexsort((local, block, doc))
                rows = []
                edges = np.flatnonzero(np.concatenate(([True], (np.diff(doc[order]) != 0) | (np.diff(block[order]) != 0))))
                ids, copies = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), order.size], strict=True):
                    mine = order[a:b]
                    d, n = int(doc[mine[0]]), int(block[mine[0]])
                    base = max(0, n * BLOCK - reach)
                    rows.append((ids[d], copies[d], n, base, texts[d][base : (n + 1) * BLOCK + reach].tobytes(), [{"key": int(x), "pos": int(y)} for x, y in zip(k[mine].view(np.int64), local[mine], strict=True)]))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "copy", "block", "base", "words", "hits"])

    return screen


_RUNS = "doc_id bigint, copy bigint, item_id bigint, first int, last int, edits array<int>"


#: Cells that are compared at once.
_CELLS = 1 << 22


def _offsets(column: pa.Array) -> np.ndarray:
    at = column.offsets.to_numpy().astype(np.int64)
    return at - at[0]


def worth_aligning(doc: np.ndarray, doc_at: np.ndarray, item: np.ndarray, item_at: np.ndarray, row: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Which pairs can reach `RUN` at all, over all pairs at once: ``doc[doc_at[r]:doc_at[r + 1]]`` with the item of the same row.

    A pair with one stretch reaches its length and what lies behind an edit on either side; any with more is worth it.
    """
    pairs = doc_at.size - 1
    worth = np.zeros(pairs, dtype=bool)
    # Each diagonal and its neighbours, once per pair.
    reach = int(doc.size + item.size) + 2
    keys = np.unique((np.repeat(row, 3) * (2 * reach) + np.repeat(diagonal, 3) + np.tile([-1, 0, 1], row.size) + reach).astype(np.int64))
    r, d = keys // (2 * reach), keys % (2 * reach) - reach
    n, m = np.diff(item_at)[r], np.diff(doc_at)[r]
    lo = np.maximum(0, -d)
    size = np.maximum(np.minimum(n, m - d) - lo, 0)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // _CELLS)) + 1).tolist(), keys.size]
    # A pair's diagonals stay together.
    cuts = sorted({int(np.searchsorted(r, r[c])) if c < keys.size else c for c in cuts})
    for c0, c1 in zip(cuts, cuts[1:], strict=False):
        rr, dd, ll, ss, kk = r[c0:c1], d[c0:c1], lo[c0:c1], size[c0:c1], keys[c0:c1]
        begin = np.cumsum(ss) - ss
        total = int(ss.sum())
        if not total:
            continue
        owner = np.repeat(np.arange(ss.size), ss)
        cell = np.arange(total)
        i = cell - begin[owner] + ll[owner]
        same = doc[doc_at[rr[owner]] + i + dd[owner]] == item[item_at[rr[owner]] + i]
        first = cell == begin[owner]
        last = np.concatenate((first[1:], [True]))
        back = cell - np.maximum.accumulate(np.where(~same, cell, np.where(first, cell - 1, -1)))
        turned = np.minimum.accumulate(np.where(~same, cell, np.where(last, cell + 1, total + 1))[::-1])[::-1]
        ahead = np.where(same, turned - cell, 0)
        back = np.where(same, back, 0)
        ends = np.flatnonzero(same & (back >= SEED) & (ahead == 1))
        if not ends.size:
            continue
        many = np.bincount(rr[owner[ends]], minlength=pairs) > 1
        length = back[ends]
        b, own = i[ends], owner[ends]
        a = b - length + 1

        def gain(at: np.ndarray, shift: int, runs: np.ndarray) -> np.ndarray:
            """Words behind one edit, with the edit; all that there can be where the diagonal was not compared."""
            want = kk[own] + shift
            k = np.minimum(np.searchsorted(kk, want), kk.size - 1)
            known, inside = kk[k] == want, (at >= ll[k]) & (at < ll[k] + ss[k])
            got = runs[np.where(known & inside, begin[k] + at - ll[k], 0)]
            return np.where(~known, SEED, np.where(inside & (got > 0), np.minimum(got, SEED) + 1, 0))

        head = np.maximum.reduce([gain(a - 2, 0, back), gain(a - 1, -1, back), gain(a - 2, 1, back)])
        tail = np.maximum.reduce([gain(b + 2, 0, ahead), gain(b + 1, 1, ahead), gain(b + 2, -1, ahead)])
        worth |= many
        worth[rr[own[length + head + tail >= RUN]]] = True
    return worth


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block and an item to the runs whose score reaches `RUN`."""
    for whole in batches:
        for at in range(0, whole.num_rows, 5000):
            # A copy without offsets into larger buffers.
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in whole.slice(at, 5000).columns], names=whole.schema.names)
            get = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            items, item_at = get["item_words"].flatten().to_numpy().view(np.uint64), _offsets(get["item_words"])
            ordinals = get["ordinals"].flatten().to_numpy()
            _, starts, data = get["words"].buffers()
            doc_at = np.frombuffer(starts, dtype=np.int32)[get["words"].offset :][: batch.num_rows + 1].astype(np.int64) // 8
            docs = np.frombuffer(data, dtype=np.uint64, count=int(doc_at[-1]))
            base = get["base"].to_numpy().astype(np.int64)
            pointed, pointed_at = get["diagonals"].flatten().to_numpy().astype(np.int64), _offsets(get["diagonals"])
            row = np.repeat(np.arange(batch.num_rows), np.diff(pointed_at))
            pointed = pointed - base[row]
            worth = worth_aligning(docs, doc_at, items, item_at, row, pointed)
            # Numerals lengthen what a run covers.
            worth |= ordinals[item_at[1:] - 1] != np.diff(item_at) - 1
            rows = []
            for i in np.flatnonzero(worth).tolist():
                part = slice(item_at[i], item_at[i + 1])
                for score, first, last, edits in alignments(docs[doc_at[i] : doc_at[i + 1]], items[part], pointed[pointed_at[i] : pointed_at[i + 1]].tolist(), ordinals[part]):
                    if score >= RUN:
                        b = int(base[i])
                        rows.append((get["doc_id"][i].as_py(), get["copy"][i].as_py(), get["item_id"][i].as_py(), first + b, last + b, [e + b for e in edits]))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "copy", "item_id", "first", "last", "edits"])


def leaked_runs(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", stock_lines: list[str] | None = None, rare_items: int = RARE_ITEMS) -> DataFrame:
    """``doc_id, copy, item_id, first, last, edits``: aligned runs, by the words of the document; ``copy`` tells texts of one id apart."""
    spark = documents.sparkSession
    # The item side, written once: it is read by several joins.
    coded_at, keys_at, blocks_at = (scratch_path(spark, f"leak-{x}") for x in ("items", "keys", "blocks"))
    coded_items(items, stock_lines).mapInArrow(_item_seeds, _ITEMS).write.parquet(coded_at)
    coded = spark.read.schema(_ITEMS).parquet(coded_at)
    seeds = coded.select("item_id", F.posexplode("seeds").alias("place", "key"))
    common = seeds.groupBy("key").agg(F.count_distinct("item_id").alias("n")).where(F.col("n") > rare_items).select("key")
    rare = seeds.join(common, "key", "left_anti").select("key", "item_id", "place")
    places = seeds.join(common, "key", "left_semi").groupBy("item_id").agg(F.collect_set("place").alias("common"))
    patterns = coded.join(places, "item_id").select("item_id", "words", "common").mapInArrow(_item_patterns, "key bigint, item_id bigint, place int")
    rare.unionByName(patterns).distinct().write.parquet(keys_at)
    keys = spark.read.schema("key bigint, item_id bigint, place int").parquet(keys_at)
    reach = int(coded.agg(F.max(F.size("words"))).first()[0] or 0) + RUN
    shared = spark.sparkContext.broadcast(_filters(keys, common))
    docs = documents.where(F.col(text).isNotNull() & F.col(doc_key).isNotNull()).select(F.col(doc_key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    spread(docs).mapInArrow(_screen(shared, reach), _BLOCKS).write.parquet(blocks_at)
    blocks = spark.read.schema(_BLOCKS).parquet(blocks_at)
    hits = blocks.select("doc_id", "copy", "block", F.explode("hits").alias("h")).select("doc_id", "copy", "block", F.col("h.key").alias("key"), F.col("h.pos").alias("pos"))
    pairs = hits.join(keys, "key").groupBy("doc_id", "copy", "block", "item_id").agg(F.collect_set(F.col("pos") - F.col("place")).alias("diagonals"))
    full = pairs.join(blocks.select("doc_id", "copy", "block", "base", "words").dropDuplicates(["doc_id", "copy", "block"]), ["doc_id", "copy", "block"]).join(coded.select("item_id", F.col("words").alias("item_words"), "ordinals"), "item_id")
    return full.select("doc_id", "copy", "item_id", "base", "words", "diagonals", "item_words", "ordinals").mapInArrow(_align, _RUNS)


def leaked_pairs(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", stock_lines: list[str] | None = None, rare_items: int = RARE_ITEMS) -> DataFrame:
    """``doc_id, item_id`` of every document and every item of which it holds a run of `RUN` words that no other item explains better."""
    spark = documents.sparkSession
    runs_at = scratch_path(spark, "leak-runs")
    leaked_runs(documents, items, doc_key, text, stock_lines, rare_items).distinct().write.parquet(runs_at)
    runs = spark.read.schema(_RUNS).parquet(runs_at)
    block = lambda c: F.floor(F.col(c) / BLOCK)
    # Another run of the same stretch, but for less than a seed at either end; both meet in the block where the worse one's middle lies.
    better = runs.select("doc_id", "copy", F.col("item_id").alias("b_item"), F.col("first").alias("b_first"), F.col("last").alias("b_last"), F.col("edits").alias("b_edits"), F.explode(F.sequence(block("first"), block("last"))).alias("block"))
    edited = runs.where(F.size("edits") > 0).withColumn("block", F.floor((F.col("first") + F.col("last")) / 2 / BLOCK))
    covered = edited.join(better, ["doc_id", "copy", "block"]).where(
        (F.col("b_item") != F.col("item_id"))
        & (F.col("b_first") < F.col("first") + SEED)
        & (F.col("b_last") > F.col("last") - SEED)
        & (F.size(F.filter("b_edits", lambda p: (p >= F.col("first")) & (p <= F.col("last")))) < F.size("edits"))
    )
    worse = covered.select("doc_id", "copy", "item_id", "first", "last").distinct()
    return runs.join(worse, ["doc_id", "copy", "item_id", "first", "last"], "left_anti").select("doc_id", "item_id").distinct()
