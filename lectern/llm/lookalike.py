"""Visually identical text brought to one form, in numpy over whole Arrow batches.

The UTF-8 bytes of a batch become one array of code points. Lookup tables map, delete and expand single
code points (full-width forms, ligatures, odd spaces, invisible characters, hyphens, canonical
singletons); words that mix scripts have their look-alike letters mapped to the word's main script;
combining marks are ordered and composed by sorted-pair searches. No row is handled by a string call.

What is ordinary and stays: words wholly in their own script, superscripts, dashes, curly quotes,
variation selectors, joiners between emoji or letters of joining scripts.

Odd input: null stays null, empty stays empty; texts of any length are read whole; the result is
idempotent.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 0x110000

# Letters that look like ASCII letters, by script, in step.
_LATIN_OF = {
    "CYRILLIC": ("АВЕЅІЈКМНОРСТУХЗаеѕіјорсухԁһԛԝӏ", "ABESIJKMHOPCTYX3aesijopcyxdhqwl"),
    "GREEK": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχγωη", "ABEZHIKMNOPTYXaikvopuxywn"),
    "ARMENIAN": ("հոսօցզԼՍՕԱՈ", "hnuogqLUOUN"),
}
_SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN")
#: Number of a letter of any further script that a table of look-alikes names.
_OTHER = len(_SCRIPTS) + 1
_SPACES = (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
_INVISIBLE = (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF)
_HYPHENS = (0x2010, 0x2011)


class Tables:
    """Lookup tables over all code points, built from the Unicode data of the standard library.

    ``more`` are further look-alikes as pairs of a letter and the ASCII letter that it looks like (`read_confusables`).
    """

    def __init__(self, more: tuple[tuple[str, str], ...] = ()) -> None:
        self.map = np.arange(TOP, dtype=np.int32)
        self.map[list(_SPACES)] = 0x20
        self.deleted = np.zeros(TOP, dtype=bool)
        self.deleted[list(_INVISIBLE)] = True
        self.map[list(_HYPHENS)] = 0x2D
        self.expand: dict[int, list[int]] = {}
        self.ccc = np.zeros(TOP, dtype=np.uint8)
        self.script = np.zeros(TOP, dtype=np.uint8)
        self.decomposed: dict[int, list[int]] = {}
        pairs = {}
        ranges = [range(0x80, 0x3400), range(0xA000, 0xAC00), range(0xF900, 0x10000), range(0x10000, 0x14700), range(0x16000, 0x17000), range(0x1B000, 0x1F000), range(0x2F800, 0x2FA20)]
        for r in ranges:
            for cp in r:
                c = chr(cp)
                d = unicodedata.decomposition(c)
                if k := unicodedata.combining(c):
                    self.ccc[cp] = k
                if not d:
                    continue
                if d.startswith("<"):
                    if d.startswith("<wide>") or d.startswith("<font>") or (0xFB00 <= cp <= 0xFB4F and d.startswith("<compat>")):
                        to = [int(x, 16) for x in d.split()[1:]]
                        if d.startswith("<wide>") and cp == 0x3000:
                            continue
                        if len(to) == 1:
                            self.map[cp] = to[0]
                        else:
                            self.expand[cp] = to
                    continue
                full = [ord(x) for x in unicodedata.normalize("NFD", c)]
                if unicodedata.normalize("NFC", c) != c:  # a singleton, or a composition that is excluded
                    to = [ord(x) for x in unicodedata.normalize("NFC", c)]
                    if len(to) == 1:
                        self.map[cp] = to[0]
                    else:
                        self.expand[cp] = to
                    continue
                self.decomposed[cp] = full
                a, b = (int(x, 16) for x in d.split())
                pairs[a << 21 | b] = cp
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys, self.pair_values = keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int32)
        self.has_decomposition = np.zeros(TOP, dtype=bool)
        self.has_decomposition[list(self.decomposed)] = True
        self.expands = np.zeros(TOP, dtype=bool)
        self.expands[list(self.expand)] = True
        for cp in [*range(0x41, 0x5B), *range(0x61, 0x7B)]:
            self.script[cp] = 1
        for lo, hi in ((0xAA, 0x250), (0x370, 0x400), (0x400, 0x530), (0x531, 0x590), (0x1E00, 0x2000), (0x1C80, 0x1C90), (0x2C60, 0x2C80), (0x2DE0, 0x2E00), (0xA640, 0xA6A0), (0xA720, 0xA800), (0xAB30, 0xAB70)):
            for cp in range(lo, hi):
                c = chr(cp)
                if c.isalpha() and unicodedata.category(c) != "Lm" and cp not in (0xAA, 0xB5, 0xBA):
                    name = unicodedata.name(c, "").split(" ", 1)[0]
                    if name in _SCRIPTS:
                        self.script[cp] = _SCRIPTS.index(name) + 1
        self.script[0xB5] = 0
        self.mark = self.ccc > 0
        # to_main[k]: look-alikes mapped to script k+1; 0 where a letter has none.
        to_latin = np.zeros(TOP, dtype=np.int32)
        back = {s: np.zeros(TOP, dtype=np.int32) for s in _SCRIPTS[1:]}
        for s, (odd, plain) in _LATIN_OF.items():
            for a, b in zip(odd, plain, strict=True):
                to_latin[ord(a)] = ord(b)
                if not back[s][ord(b)]:
                    back[s][ord(b)] = ord(a)
        for s, other in (("GREEK", "CYRILLIC"), ("CYRILLIC", "GREEK"), ("GREEK", "ARMENIAN"), ("CYRILLIC", "ARMENIAN")):
            for a in _LATIN_OF[other][0]:
                if back[s][to_latin[ord(a)]]:
                    back[s][ord(a)] = back[s][to_latin[ord(a)]]
        for a, b in more:
            if not to_latin[ord(a)]:
                to_latin[ord(a)] = ord(b)
                if not self.script[ord(a)]:
                    self.script[ord(a)] = _OTHER
        self.to_main = [to_latin, back["GREEK"], back["CYRILLIC"], back["ARMENIAN"], np.zeros(TOP, dtype=np.int32)]
        # Joiners are ordinary between these: emoji, and scripts that join letters.
        self.joins = np.zeros(TOP, dtype=bool)
        for lo, hi in ((0x600, 0x1100), (0x1780, 0x1880), (0x2190, 0x2400), (0x2600, 0x27C0), (0x2B00, 0x2C00), (0xFB50, 0xFE00), (0xFE00, 0xFE10), (0x1F000, 0x1FB00)):
            self.joins[lo:hi] = True


@lru_cache(maxsize=4)
def tables(more: tuple[tuple[str, str], ...] = ()) -> Tables:
    return Tables(more)


def read_confusables(path: str) -> tuple[tuple[str, str], ...]:
    """Pairs of a letter and the ASCII letter that it looks like, from a file in the format of Unicode's public list of
    confusables: ``0430 ; 0061 ; MA # ...``. Lines for anything but one letter for one ASCII letter are passed over."""
    pairs = []
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            fields = [x.strip() for x in line.partition("#")[0].split(";")]
            if len(fields) < 2 or " " in fields[0] or " " in fields[1] or not fields[1]:
                continue
            a, b = (chr(int(x, 16)) for x in fields[:2])
            if not a.isascii() and a.isalpha() and b.isascii() and b.isalpha():
                pairs.append((a, b))
    return tuple(pairs)


def _replace(points: np.ndarray, rows: np.ndarray, where: np.ndarray, into: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Expand the code points at ``where`` (sorted positions); offsets of the pieces come from one cumulative sum."""
    lengths = np.ones(points.size, dtype=np.int64)
    kinds, inverse = np.unique(points[where], return_inverse=True)
    sizes = np.array([len(into[int(k)]) for k in kinds], dtype=np.int64)
    lengths[where] = sizes[inverse]
    out = np.repeat(points, lengths)
    at = (np.cumsum(lengths) - lengths)[where]
    for k, kind in enumerate(kinds.tolist()):
        mine = at[inverse == k]
        for j, cp in enumerate(into[kind]):
            out[mine + j] = cp
    return out, np.repeat(rows, lengths)


def _order_marks(points: np.ndarray, rows: np.ndarray, t: Tables) -> np.ndarray:
    """Marks after their starter in canonical order, by one stable sort."""
    ccc = t.ccc[points]
    wrong = (ccc[1:] > 0) & (ccc[:-1] > ccc[1:])
    if not wrong.any():
        return points
    start = (ccc == 0) | np.concatenate(([True], rows[1:] != rows[:-1]))
    order = np.lexsort((ccc, np.cumsum(start)))
    return points[order]


def _compose(points: np.ndarray, rows: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Marks joined to their starters. Starters before a mark are taken apart first, as the standard asks."""
    ccc = t.ccc[points]
    marks = np.flatnonzero(ccc)
    if not marks.size:
        return points, rows
    before = np.flatnonzero((t.ccc[points[:-1]] == 0) & (ccc[1:] > 0) & (rows[1:] == rows[:-1]))
    split = before[t.has_decomposition[points[before]]]
    if split.size:
        points, rows = _replace(points, rows, split, t.decomposed)
    points = _order_marks(points, rows, t)
    ccc = t.ccc[points].astype(np.int16)
    starter = ccc == 0
    # The starter that each mark belongs to; a mark at the start of a row has none.
    last = np.maximum.accumulate(np.where(starter, np.arange(points.size), -1))
    own = (last >= 0) & ~starter
    own &= rows[np.maximum(last, 0)] == rows
    at = np.flatnonzero(own)
    keep = np.ones(points.size, dtype=bool)
    blocked = np.zeros(points.size, dtype=np.int16)  # at a starter: class of its last mark that stayed
    # The marks of each depth behind their starters, found by one sort.
    depth = at - last[at]
    order = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        now = at[order[a:b]]
        s = last[now]
        free = blocked[s] < ccc[now]
        key = points[s].astype(np.int64) << 21 | points[now]
        k = np.minimum(np.searchsorted(t.pair_keys, key), t.pair_keys.size - 1)
        hit = free & (t.pair_keys[k] == key)
        points[s[hit]] = t.pair_values[k[hit]]
        keep[now[hit]] = False
        blocked[s[~hit]] = np.maximum(blocked[s[~hit]], ccc[now[~hit]])
    return points[keep], rows[keep]


def _main_script(points: np.ndarray, rows: np.ndarray, t: Tables) -> np.ndarray:
    """Look-alike letters of words that mix scripts, mapped to the script of most of the word's letters."""
    script = t.script[points]
    word = (script > 0) | t.mark[points]
    start = word & ~(np.concatenate(([False], word[:-1])) & np.concatenate(([False], rows[1:] == rows[:-1])))
    ids = np.cumsum(start) - 1
    letters = np.flatnonzero(script > 0)
    if not letters.size:
        return points
    n = int(ids[-1]) + 1
    kinds = _OTHER + 1
    counts = np.bincount(ids[letters] * kinds + script[letters], minlength=n * kinds).reshape(n, kinds)[:, 1:]
    # A look-alike may belong to either script: letters that are in one script only weigh most.
    alike = np.zeros(points.size, dtype=bool)
    alike[letters] = (t.to_main[0][points[letters]] > 0) | (t.to_main[1][points[letters]] > 0) | (t.to_main[2][points[letters]] > 0)
    firm = letters[~alike[letters]]
    weight = counts + 1000 * np.bincount(ids[firm] * kinds + script[firm], minlength=n * kinds).reshape(n, kinds)[:, 1:]
    mixed = (counts > 0).sum(axis=1) > 1
    if not mixed.any():
        return points
    main = weight.argmax(axis=1)
    at = letters[mixed[ids[letters]]]
    at = at[script[at] != main[ids[at]] + 1]
    out = points.copy()
    for k, to in enumerate(t.to_main):
        mine = at[main[ids[at]] == k]
        out[mine] = np.where(to[points[mine]] > 0, to[points[mine]], points[mine])
    return out


def normalise_points(points: np.ndarray, rows: np.ndarray, more: tuple[tuple[str, str], ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Code points and the row of each, normalised."""
    t = tables(more)
    mapped, keep = t.map[points], ~t.deleted[points]
    joiner = np.flatnonzero((points == 0x200D) | (points == 0x200C))
    if joiner.size:
        left, right = points[np.maximum(joiner - 1, 0)], points[np.minimum(joiner + 1, points.size - 1)]
        ordinary = joiner[t.joins[left] & t.joins[right]]
        keep[ordinary] = True
    mapped, rows = mapped[keep], rows[keep]
    where = np.flatnonzero(t.expands[mapped])
    if where.size:
        mapped, rows = _replace(mapped, rows, where, t.expand)
    mapped, rows = _compose(mapped, rows, t)
    return _main_script(mapped, rows, t), rows


def normalise_arrow(texts: pa.Array, more: tuple[tuple[str, str], ...] = ()) -> tuple[pa.Array, np.ndarray]:
    """The normalised texts, and which of them changed; null stays null and is no change."""
    large = pa.concat_arrays([texts.cast(pa.large_string())]) if texts.offset else texts.cast(pa.large_string())
    n = len(large)
    _, offset_buffer, data_buffer = large.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64, count=n + 1) if n else np.zeros(1, dtype=np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data_buffer, dtype=np.uint8)[lo:hi] if hi > lo else np.zeros(0, dtype=np.uint8)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.int32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    lengths = np.diff(heads[offsets - lo])
    rows = np.repeat(np.arange(n), lengths)
    high = points > 126
    out_points, out_rows = points.copy(), rows
    changed = np.zeros(n, dtype=bool)
    if high.any():
        out_points, out_rows = normalise_points(points, rows, more)
        out_lengths = np.bincount(out_rows, minlength=n)
        same_size = out_lengths == lengths
        changed = ~same_size
        kept_in, kept_out = same_size[rows], same_size[out_rows]
        differ = points[kept_in] != out_points[kept_out]
        changed[np.unique(rows[kept_in][differ])] = True
        lengths = out_lengths
    width = 1 + (out_points > 0x7F) + (out_points > 0x7FF) + (out_points > 0xFFFF)
    ends = np.concatenate(([0], np.cumsum(np.bincount(out_rows, weights=width, minlength=n)))).astype(np.int64)
    raw = out_points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    null = texts.is_null()
    result = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw))
    result = pa.array(result).cast(pa.string()) if ends[-1] < 2**31 else result
    if texts.null_count:
        import pyarrow.compute as pc

        result = pc.if_else(null, pa.scalar(None, result.type), result)
    return result, changed


def normalise_column(df: DataFrame, column: str, out: str = "normal", more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """``df`` with a struct ``out`` (text, changed). Pure ASCII rows never leave the JVM. ``more``: further look-alikes."""

    @F.arrow_udf("struct<text:string,changed:boolean>")
    def normal(texts: pa.Array) -> pa.Array:
        result, changed = normalise_arrow(texts, more)
        return pa.StructArray.from_arrays([result.cast(pa.string()), pa.array(changed)], names=["text", "changed"])

    text = F.col(column)
    high = F.coalesce(text.rlike(r"[^\x00-\x7F]"), F.lit(False))
    return df.withColumn(out, F.when(high, normal.asNondeterministic()(F.when(high, text))).otherwise(F.struct(text.alias("text"), F.lit(False).alias("changed"))))
