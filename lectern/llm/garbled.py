"""Text decoded with the wrong encoding: found, and restored by round trips.

A garbled text is re-encoded under the legacy encoding it was wrongly read in and strictly decoded as
the intended one; the result is taken where a garbling cost drops, and the step is repeated for nested
layers. The cost of a text is the surprise of its character pairs outside ASCII under pair counts of
the corpus' distinct texts, words with an anomaly left out, plus fixed charges for characters that correct text does not hold (C1 controls,
replacement characters). Two kinds of round trip are tried:

* UTF-8 read as a legacy encoding: every run of characters beyond ASCII is tried by itself, so a text
  that is garbled in part is repaired in part. Strict UTF-8 decoding hardly ever succeeds by chance.
* one legacy encoding read as another: a line at a time, since any byte decodes; here the cost decides.

Odd input: null and empty texts are no cases and stay as they are; texts of any length are read whole;
what cannot be restored (replacement characters, lead bytes whose trail bytes are lost) is reported and left.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import spread

#: Pairs are counted in so many buckets: the size of the table that goes to the workers, whatever the corpus.
BUCKETS = 1 << 17
#: Share of all pairs below which pairs are equally rare, and what every pair costs besides.
RAREST, OFFSET = 1.3e-6, 0.29
#: Wrong readings of UTF-8.
READ_LATIN = ("cp1252", "latin-1", "cp1250", "cp1254", "iso8859-15")
READ_AS = ("cp1252", "latin-1", "cp1253", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "cp1254", "iso8859-15", "cp866", "koi8-r")
#: Intended single-byte encodings and what they were read as.
SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1253", "cp1251", "cp1250")
READ_SINGLE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1253", "cp1251", "koi8-r", "cp1250")
#: Surprise by which a line must improve for a single-byte repair: per changed character, and at all.
GAIN_EACH, GAIN_LEAST = 1.6, 5.0
#: The least gain where every changed character is one that correct text hardly has.
GAIN_ODD = 3.0
#: What a repair of a part of a line must gain besides, and the cost of a character that makes a line worth trying.
SPLIT_COST, ODD_CHARACTER = 2.0, 14.0
#: Cost that a repaired character may have at most, on average: the result must be common, not only less odd.
SETTLED = 17.0
#: The same for a line in which no character is odd in itself, and what each of its changes must gain.
COMMON, PLAIN_GAIN_EACH = 14.0, 4.0
#: Cost of a character on average at which a result is not yet trusted and the other order is tried.
UNSETTLED = 10.0
#: What a rarer encoding must gain over one that is tried before it.
TIE = 3.0

_HIGH = re.compile(r"[^\x00-\x7f]+")
_HIGH_RUN = re.compile(r"[^\x00-\x7f]{2,}")  # a character in UTF-8 beyond ASCII has two bytes or more
# A lead whose last trail byte was a no-break space that has become a plain one.
_LOST_SPACE = re.compile(r"(?:[\u00c2\u00c3]|\u00e2\u20ac|\u00e2\u0080) ")
_C1 = re.compile("[\x80-\x84\x86-\x9f]")
# What is left of UTF-8 read as a legacy encoding where trail bytes were dropped or became '?'.
_LOST_TRAIL = re.compile(
    "(?<=[a-z\u00df-\u00f6\u00f8-\u00ff])[\u00c2\u00c3\u00c4\u00c5\u00ce\u00cf\u00d0\u00d1](?![A-Z])"  # a capital lead behind a small letter
    "|(?<=[A-Za-z])[\u251c\u252c]|(?<=[a-z])\u221a(?=[a-z?]|$)"  # C3 and C2 in cp437, cp850, and C3 in mac_roman
    "|(?<=[a-z])[\u0393\u0413\u0446](?![\u0370-\u052f])"  # C3 in cp1253, cp1251, koi8-r
    "|(?<![^\\W_])[\u00c2\u00c3]\\?"  # a lead without a word before it; 'AMANHÃ?' is one
    "|\u00e2\\?+(?=[a-z])|\u00e2\\?{2}"
    "|\u00e2\u20ac|\u201a\u00c4|\u0393\u00c7|\u00d4\u00c7|\u0432\u0402|\u03b2\u20ac"  # E2 80 in cp1252, mac_roman, cp437, cp850, cp1251, cp1253
)
# A word with a character beyond ASCII; it starts where no word goes on, so long ASCII is passed once.
_HIGH_WORD = re.compile(r"(?<![\x21-\x7f])[\x21-\x7f]*+[^\x00-\x7f][^\x00-\x20]*+")
_FIELDS = [T.StructField("garbled", T.BooleanType()), T.StructField("restored", T.StringType()), T.StructField("layers", T.IntegerType())]


def _encode_table(codec: str) -> dict[str, int]:
    """Characters to bytes under a reading that lets undefined bytes through as C1 controls, as browsers do."""
    table = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    return table


_TABLES = {codec: _encode_table(codec) for codec in {*READ_AS, *READ_SINGLE}}


_MEANT = {codec: [None if (c := bytes([b]).decode(codec, "ignore")) == "" else c for b in range(256)] for codec in SINGLE}


_SINGLE_PAIRS = [(read, meant) for read in READ_SINGLE for meant in SINGLE if read != meant]

# Letters of other scripts that look like ASCII letters. In a word of Latin letters they
# are disguise (another operator's case), not the trace of an encoding.
LOOK_ALIKES = frozenset("АВЕЅІЈКМНОРСТХЗаеѕіјорсухԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχγηωհոսօցզԼ")


@lru_cache(maxsize=65536)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").partition(" ")[0]


def is_anomaly(text: str, i: int) -> bool:
    """Whether the character stands where correct text of any language hardly has it.

    Controls and replacement characters anywhere; lines, blocks and mathematical signs beside a letter or
    digit; fractions and signs within a word; a capital behind a small letter, or another script's letter,
    within a word; a letter between digits or right behind a closing mark.
    """
    c = text[i]
    if c == "\ufffd" or _C1.match(c):
        return True
    before, behind = text[i - 1 : i] or " ", text[i + 1 : i + 2] or " "
    kind = unicodedata.category(c)
    if c in "ªº" and behind.isdigit() and not before.isdigit():
        return True
    if kind[0] == "L" and c not in "ªºµ":
        alone = behind == " " and (i == 0 or before in "\n ")
        if alone and (c in "ÂÃÄÅÆÊËÎÏÐÑÕØÙÛÝÞ" or (c.islower() and (i == 0 or before == "\n"))):
            return True  # no word of one letter, or no beginning of a line
        if before.isdigit() and (behind.isdigit() or behind == " ") or before in "?!":
            return True
        if before.isalpha() and before not in "ªºµ":
            return (c.isupper() and (before.islower() or behind.islower())) or (_script(before) != _script(c) and c not in LOOK_ALIKES and before not in LOOK_ALIKES)
        if behind.isupper() and (c.islower() or c.isupper() and text[i + 2 : i + 3].islower()):
            return True
        return behind.isalpha() and behind not in "ªºµ" and _script(behind) != _script(c) and c not in LOOK_ALIKES and behind not in LOOK_ALIKES
    if c in "¤¦¬¨¯¸´":
        return True
    if kind in ("So", "Sm") and c not in "°±×÷":
        return before.isalnum() or behind.isalnum()
    if c in "¼½¾":
        return before.isalpha() or behind.isalpha()
    if kind[0] in "SN" or c in "ªºµ÷":
        return before.isalpha() and behind.isalpha() or (kind == "Sc" and before.isalpha())
    if kind in ("Po", "Pi", "Pf", "Ps", "Pd") and c not in "’'·-–—\u2010\u2011":
        return before.isalpha() and behind.isalpha()
    return False


@lru_cache(maxsize=65536)
def _anomaly_between(before: str, rest: str) -> bool:
    return is_anomaly(before + rest, len(before))


def _is_anomaly(text: str, i: int) -> bool:
    """`is_anomaly`, remembered by the characters that it looks at."""
    return _anomaly_between(text[i - 1 : i] if i else "", text[i : i + 3])


def without_anomalies(text: str) -> str:
    """The text without the words in which a character is an anomaly: what may count as correct."""
    return _HIGH_WORD.sub(lambda m: "" if any(c > "\x7f" and _is_anomaly(text, i) for i, c in enumerate(m[0], m.start())) else m[0], text)


def _is_evidence(c: str) -> bool:
    """Whether a character speaks for a wrong encoding: no space, no invisible one, no mark, no look-alike."""
    return _C1.match(c) is not None or (c.isprintable() and not c.isspace() and c not in LOOK_ALIKES and not unicodedata.combining(c) and not "\uff00" <= c <= "\uffef" and not "\ufb00" <= c <= "\ufb06")


def _best_stretch(gains: list[float]) -> tuple[int, int]:
    """The stretch with the largest sum."""
    best, at, total, start = -math.inf, (0, len(gains)), 0.0, 0
    for k, g in enumerate(gains):
        if total <= 0:
            total, start = 0.0, k
        total += g
        if total > best:
            best, at = total, (start, k + 1)
    return at


def _whole_words(line: str, places: list[int], lo: int, hi: int) -> tuple[int, int]:
    """A stretch widened to the ends of its words: no encoding changes within a word."""

    def joined(k: int) -> bool:
        return all(c.isalnum() or c > "\x7f" for c in line[places[k] : places[k + 1] + 1]) and not any(c.isspace() for c in line[places[k] : places[k + 1] + 1])

    while lo > 0 and joined(lo - 1):
        lo -= 1
    while hi < len(places) and joined(hi - 1):
        hi += 1
    return lo, hi


def _meant_as(read: str, meant: str) -> dict[str, str | None]:
    """Characters of a reading as they were meant; None where the byte means nothing."""
    return {c: _MEANT[meant][b] for c, b in _TABLES[read].items() if b >= 0x80}


_MEANT_AS = {pair: _meant_as(*pair) for pair in _SINGLE_PAIRS}


def _transcode(chars: Iterable[str], read: str, meant: str) -> list[str | None]:
    """Each character as it was meant; None where it is not in either encoding."""
    return list(map(_MEANT_AS[read, meant].get, chars))


def pair_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B1) + b.astype(np.uint64) * np.uint64(0x85EBCA6B)) >> np.uint64(7)) & np.uint64(BUCKETS - 1)


def _classes(points: np.ndarray) -> np.ndarray:
    """Code points with ASCII letters, digits and the rest folded: what stands beside an odd character matters roughly."""
    p = points.copy()
    p[(p >= 48) & (p <= 57)] = 48
    upper, lower = (points >= 65) & (points <= 90), (points >= 97) & (points <= 122)
    p[upper] = 65
    vowel = np.isin(points, np.frombuffer("aeiou".encode("utf-32-le"), dtype="<u4"))
    p[lower & ~vowel] = 98
    p[vowel] = 97
    p[(points < 48) | ((points > 57) & (points < 65))] = 32
    return p


def _class(c: str) -> int:
    """`_classes` of one character."""
    n = ord(c)
    if n > 127:
        return n
    if 48 <= n <= 57:
        return 48
    if 65 <= n <= 90:
        return 65
    if 97 <= n <= 122:
        return 97 if c in "aeiou" else 98
    return 32 if n < 65 else n


def _bucket(a: str, b: str) -> int:
    """`pair_bucket` of one pair."""
    return ((_class(a) * 0x9E3779B1 + _class(b) * 0x85EBCA6B) >> 7) & (BUCKETS - 1)


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def pair_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """``bucket, n`` over the distinct texts without words that hold an anomaly; each task sends one partial count for at most BUCKETS buckets.

    So neither copies nor a garbling that many texts share make its pairs common.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        screen = Screen(np.zeros(BUCKETS, dtype=np.float32))
        for batch in batches:
            total += screen.counts(batch.column(0))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    high = texts.select(F.col(column).cast("string").alias("t")).where(F.col("t").rlike(r"[^\x00-\x7F]"))
    return high.distinct().mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _buckets(s: str) -> np.ndarray:
    """Buckets of the pairs in which a character is beyond ASCII."""
    raw = _points(f"\n{s}\n")
    p = _classes(raw)
    at = np.flatnonzero((raw[:-1] > 127) | (raw[1:] > 127))
    return pair_bucket(p[at], p[at + 1]).astype(np.int64)


def surprise_of(counts: np.ndarray) -> np.ndarray:
    """Surprise in nats by the share that a bucket has of all pairs: it does not depend on the size of the corpus."""
    share = counts / max(float(counts.sum()), 1.0)
    return (OFFSET - np.log(share + RAREST)).astype(np.float32)


def surprise_table(counts: DataFrame) -> np.ndarray:
    """Surprise of each bucket; at most BUCKETS rows come to the driver, half a megabyte."""
    table = np.zeros(BUCKETS)
    got = counts.toPandas()
    table[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return surprise_of(table)


class Repairer:
    """Undoes wrong readings of one text, given the corpus' surprise table."""

    def __init__(self, surprise: np.ndarray):
        self.surprise = surprise
        self.memo: dict[str, str] = {}
        self.pairs: dict[str, float] = {}

    def cost(self, s: str) -> float:
        """Surprise of the pairs beyond ASCII, and the charges for controls and lost characters."""
        pair, known, total = self._pair, self.pairs, 0.0
        before = "\n"
        for c in f"{s}\n":
            if c > "\x7f" or before > "\x7f":
                got = known.get(before + c)
                total += pair(before, c) if got is None else got
            before = c
        return total

    def _runs(self, text: str) -> str:
        """One layer of UTF-8 read as a legacy encoding undone, run by run.

        Runs that correct text hardly has come first; they establish the encodings under which runs that
        could be words of another script are tried at all.
        """
        established: set[str] = set()

        def fix(m: re.Match, strict: bool) -> str:
            run = m[0]
            if not any(_might_be_utf8(run, codec) for codec in READ_AS):
                return run
            odd = any(_is_anomaly(text, i) for i in range(m.start(), m.end()))
            words = not odd and all(c.isalpha() and c not in "ªºµ" or unicodedata.category(c) in ("Cf", "Zs", "Mn") for c in run)
            latin = all(c <= "\u024f" for c in run)
            if strict and words and not latin:
                return run
            codecs = READ_AS if not words else (*(READ_LATIN if latin else ()), *sorted(established))
            tries: dict[str, str] = {}
            for codec in codecs:
                for lo, hi, fixed in _decoded_parts(run, codec):
                    if not odd and any(unicodedata.category(c) in ("Mn", "Cn", "Co", "Cc", "Sk", "Lm") for c in fixed):
                        continue
                    tries.setdefault(run[:lo] + fixed + run[hi:], codec)
            if not tries:
                return run
            before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
            best, least = run, self.cost(before + run + after) - 2.0
            for candidate in tries:  # in order of the encodings; a rarer one must be clearly better
                marks = sum(unicodedata.category(x) == "Mn" for x in candidate)
                if (c := self.cost(before + candidate + after) + 4 * TIE * marks) < least - (TIE if best != run else 0.0):
                    best, least = candidate, c
            if best != run:
                established.add(tries[best])
            return best

        if _LOST_SPACE.search(text):
            text = _LOST_SPACE.sub(lambda m: self._with_space(text, m), text)
        out = _HIGH_RUN.sub(lambda m: fix(m, True), text)
        if established and out != text:
            text = out
            out = _HIGH_RUN.sub(lambda m: fix(m, False), text)
        return out

    def _with_space(self, text: str, m: re.Match) -> str:
        """The lead and its lost trail byte, if what they make is likelier than the lead and a space."""
        lead = m[0][:-1]
        raw = lead.encode("cp1252", "ignore") if "\u0080" not in lead else lead.encode("latin-1")
        try:
            made = (raw + b"\xa0").decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        # The space before the next word may have been the lost one.
        for candidate in (made, made + " "):
            if not made.isspace() and self.cost(before + candidate + after) < self.cost(before + m[0] + after) - 2.0:
                return candidate
        return m[0]

    def _pair(self, a: str, b: str) -> float:
        """Surprise of one pair, none within ASCII; a character's own charge is added where it stands second."""
        known = self.pairs.get(a + b)
        if known is None:
            own = 6.0 if b == "\ufffd" or _C1.match(b) else 0.0
            odd = a > "\x7f" or b > "\x7f"
            known = own + (float(self.surprise[_bucket(a, b)]) if odd else 0.0)
            if len(self.pairs) < 500_000:
                self.pairs[a + b] = known
        return known

    def _locals(self, line: str, chars: list[str], places: list[int]) -> list[float]:
        """The part of the cost that each character beyond ASCII answers for."""
        pair, end = self._pair, len(line) - 1
        out, last = [], -2
        for k, i in enumerate(places):
            c = chars[k]
            left = chars[k - 1] if last == i - 1 else line[i - 1] if i else "\n"
            cost = pair(left, c)
            if i == end or line[i + 1] <= "\x7f":
                cost += pair(c, line[i + 1] if i < end else "\n")
            out.append(cost)
            last = i
        return out

    def _single(self, line: str) -> str:
        """A line, or the stretch of it that gains most, of one single-byte encoding read as another."""
        places = [i for i, c in enumerate(line) if c > "\x7f"]
        chars = [line[i] for i in places]
        if not chars:
            return line
        now = self._locals(line, chars, places)
        evidence = [_is_evidence(c) for c in chars]
        anomaly = [e and _is_anomaly(line, i) for e, i in zip(evidence, places, strict=True)]
        # An anomaly is tried however common it is.
        if not any(anomaly) and max(now) <= ODD_CHARACTER:
            return line
        if not any(anomaly) and sum(e and n > COMMON for e, n in zip(evidence, now, strict=True)) < 2:
            return line
        best, gain = line, 0.0
        tried = set()
        for pair in _SINGLE_PAIRS:
            fixed = _transcode(chars, *pair)
            # Pairs that make the same of the line are tried once.
            if (made := tuple(fixed)) in tried:
                continue
            tried.add(made)
            if not any(e and y is not None and x != y for x, y, e in zip(chars, fixed, evidence, strict=True)):
                continue
            after = self._locals(line, [x if y is None else y for x, y in zip(chars, fixed, strict=True)], places)
            gains = [-1e6 if y is None else a - b for a, b, y in zip(now, after, fixed, strict=True)]
            for lo, hi in {(0, len(chars)), _whole_words(line, places, *_best_stretch(gains))}:
                changed = [k for k in range(lo, hi) if chars[k] != fixed[k]]
                odd = bool(changed) and all(anomaly[k] for k in changed)
                g = sum(gains[lo:hi]) - (SPLIT_COST if hi - lo < len(chars) and not odd else 0.0)
                if g <= gain or not any(evidence[k] for k in changed):
                    continue
                settled = sum(after[k] for k in changed) / len(changed)
                # Where nothing is odd in itself, the whole line must turn into what is common in the corpus.
                if any(anomaly[k] for k in changed):
                    good = settled <= SETTLED and g >= max(GAIN_ODD if odd else GAIN_LEAST, GAIN_EACH * len(changed))
                else:
                    good = len(changed) > (1 if hi - lo == len(chars) else 2) and settled <= COMMON and g >= PLAIN_GAIN_EACH * len(changed)
                if good:
                    out = list(line)
                    for k in changed:
                        out[places[k]] = fixed[k]
                    best, gain = "".join(out), g
        return best

    def _memo_single(self, line: str) -> str:
        if len(line) > 1000:  # long lines hardly recur
            return self._single(line)
        known = self.memo.get(line)
        if known is None:
            if len(self.memo) >= 20_000:  # bounds the worker's memory only
                self.memo.clear()
            known = self.memo[line] = self._single(line)
        return known

    def _layers(self, text: str, single_first: bool) -> tuple[str, int]:
        s, layers = text, 0
        if single_first:
            s = "\n".join(self._memo_single(x) for x in s.split("\n"))
            layers += s != text
        # It ends: a layer makes of every sequence that it undoes one character, or of a lead and a space another letter.
        while (fixed := self._runs(s)) != s:
            s, layers = fixed, layers + 1
        fixed = "\n".join(self._memo_single(x) for x in s.split("\n"))
        return (fixed, layers + 1) if fixed != s else (s, layers)

    def repair(self, text: str) -> tuple[bool, str, int]:
        """``(garbled, restored, layers undone)``."""
        if not _HIGH.search(text):
            return False, text, 0
        # Layers of UTF-8 first, then single bytes; or the other way round, where that costs less.
        s, layers = self._layers(text, False)
        if s != text and self.cost(s) > UNSETTLED * sum(map(len, _HIGH.findall(s))):
            other, more = self._layers(text, True)
            if other != s and self.cost(other) < self.cost(s):
                s, layers = other, more
        return s != text or "�" in text or bool(_C1.search(text)) or bool(_LOST_TRAIL.search(text)), s, layers


_LEADS = {codec: frozenset(c for c, b in _TABLES[codec].items() if 0xC2 <= b <= 0xF4) for codec in READ_AS}
_TRAILS = {codec: frozenset(c for c, b in _TABLES[codec].items() if 0x80 <= b <= 0xBF) for codec in READ_AS}


def _might_be_utf8(run: str, codec: str) -> bool:
    """Whether a lead byte is followed by a trail byte anywhere in the run."""
    leads, trails = _LEADS[codec], _TRAILS[codec]
    return any(a in leads and b in trails for a, b in zip(run, run[1:], strict=False))


def _decoded_parts(run: str, codec: str) -> Iterator[tuple[int, int, str]]:
    """Stretches of a run that are whole UTF-8 under a reading: the run itself, else its longest valid stretches."""
    table = _TABLES[codec]
    raw = [table.get(c) for c in run]
    i, n, parts = 0, len(run), []
    while i < n:
        b = raw[i]
        size = 0 if b is None else 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        if size and i + size <= n and all(x is not None and 0x80 <= x <= 0xBF for x in raw[i + 1 : i + size]):
            try:
                parts.append((i, i + size, bytes(raw[i : i + size]).decode("utf-8")))
                i += size
                continue
            except UnicodeDecodeError:
                pass
        i += 1
    if not parts:
        return
    out, at = [], parts[0][0]
    for a, b, c in parts:
        out.append(run[at:a] + c)
        at = b
    yield parts[0][0], at, "".join(out)


#: Stands behind each text among the code points of a batch.
_END = 0x110000  # the first value that is no code point; 21 bits hold it
# Characters without which neither `_LOST_SPACE` nor `_LOST_TRAIL` matches.
_LEFT_OVER = "\u00c2\u00c3\u00c4\u00c5\u00ce\u00cf\u00d0\u00d1\u00e2\u251c\u252c\u221a\u0393\u0413\u0446\u201a\u00d4\u0432\u03b2"


def _points_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with `_END` behind each, and the row of each; a null text is empty."""
    large = pa.concat_arrays([texts]).cast(pa.large_string())
    n = len(large)
    offsets = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset :][: n + 1] if n else np.zeros(1, dtype=np.int64)
    raw = large.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4").astype(np.int64)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    lengths = np.diff(heads[offsets - offsets[0]])
    rows = np.repeat(np.arange(n), lengths + 1)
    out = np.full(rows.size, _END, dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(rows.size, dtype=bool)
    inside[ends] = False
    out[inside] = points
    return out, rows


class Screen:
    """Which texts of a batch a `Repairer` may change or report, found over all code points at once.

    It asks what the repairer asks first: whether a lead and a trail byte of some reading stand side by side, whether a line
    holds an anomaly, or an odd character and other surprising ones. A text that it clears comes out of the repair unchanged.
    """

    def __init__(self, surprise: np.ndarray):
        self.surprise = surprise
        self.leads, self.trails = (np.zeros(_END + 1, dtype=np.uint16) for _ in range(2))
        for k, codec in enumerate(READ_AS):
            for table, chars in ((self.leads, _LEADS[codec]), (self.trails, _TRAILS[codec])):
                at = [ord(c) for c in chars if c > "\x7f"]
                table[at] |= np.uint16(1 << k)
        self.folded = _classes(np.arange(_END + 1, dtype=np.int64))
        self.folded[_END] = 32
        self.lost = np.zeros(_END + 1, dtype=bool)
        self.lost[[0xFFFD, *range(0x80, 0x85), *range(0x86, 0xA0)]] = True
        self.left_over = np.zeros(_END + 1, dtype=bool)
        self.left_over[[ord(c) for c in _LEFT_OVER]] = True
        self.lower = np.zeros(_END + 1, dtype=bool)
        self.lower[[c for c in range(0x30000) if chr(c).islower()]] = True

    def _anomalies(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """`is_anomaly` at the places ``at`` of ``p``, in which `_END` parts the texts: each context is judged once."""
        before = np.where(at > 0, p[np.maximum(at - 1, 0)], _END)
        behind = p[at + 1]
        after = self.lower[p[np.minimum(at + 2, p.size - 1)]] & (behind != _END)
        key = (before.astype(np.uint64) << np.uint64(43)) | (p[at].astype(np.uint64) << np.uint64(22)) | (behind.astype(np.uint64) << np.uint64(1)) | after.astype(np.uint64)
        kinds, inverse = np.unique(key, return_inverse=True)
        first = np.zeros(len(kinds), dtype=np.int64)
        first[inverse] = np.arange(at.size)
        answers = np.fromiter((self._context(int(before[i]), int(p[at[i]]), int(behind[i]), bool(after[i])) for i in first.tolist()), dtype=bool, count=len(kinds))
        return answers[inverse]

    @staticmethod
    def _context(before: int, c: int, behind: int, lower: bool) -> bool:
        rest = chr(c) + ("" if behind == _END else chr(behind) + ("a" if lower else "A"))
        return _anomaly_between("" if before == _END else chr(before), rest)

    def _evidence(self, p: np.ndarray) -> np.ndarray:
        kinds, inverse = np.unique(p, return_inverse=True)
        return np.fromiter((_evident(c) for c in kinds.tolist()), dtype=bool, count=kinds.size)[inverse]

    def suspects(self, texts: pa.Array) -> np.ndarray:
        """Rows that must go through `Repairer.repair`."""
        n = len(texts)
        p, rows = _points_of(texts)
        high = np.flatnonzero((p > 0x7F) & (p != _END))
        out = np.zeros(n, dtype=bool)
        if not high.size:
            return out
        out[rows[high[self.lost[p[high]]]]] = True
        out[rows[high[(self.leads[p[high]] & self.trails[p[high + 1]]) != 0]]] = True
        for r in np.unique(rows[high[self.left_over[p[high]]]]).tolist():
            if not out[r]:
                text = texts[r].as_py()
                out[r] = bool(_LOST_SPACE.search(text) or _LOST_TRAIL.search(text))
        # Single bytes, line by line, in the rows that are not found yet.
        high = high[~out[rows[high]]]
        if not high.size:
            return out
        lines = np.where(p == 10, _END, p)
        line = np.cumsum(lines == _END)[high]
        cost = self._pair(lines, high - 1, high) + np.where((lines[high + 1] <= 0x7F) | (lines[high + 1] == _END), self._pair(lines, high, high + 1), 0)
        evidence = self._evidence(p[high])
        odd = np.zeros(high.size, dtype=bool)
        where = np.flatnonzero(evidence)
        if where.size:
            odd[where] = self._anomalies(lines, high[where])
        start = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        most = np.maximum.reduceat(cost, start)
        surprising = np.add.reduceat((evidence & (cost > COMMON)).astype(np.int64), start)
        found = np.logical_or.reduceat(odd, start) | ((most > ODD_CHARACTER) & (surprising >= 2))
        out[rows[high[start[found]]]] = True
        return out

    def _pair(self, p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        left = np.where(a < 0, 32, self.folded[p[np.maximum(a, 0)]])
        return self.surprise[pair_bucket(left, self.folded[p[b]]).astype(np.int64)].astype(np.float64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How often each bucket of pairs occurs outside words that hold an anomaly."""
        p, _ = _points_of(texts)
        high = np.flatnonzero((p > 0x7F) & (p != _END))
        if not high.size:
            return np.zeros(BUCKETS, dtype=np.int64)
        token = np.cumsum((p <= 0x20) | (p == _END))
        bad = np.zeros(int(token[-1]) + 2, dtype=bool)
        bad[token[high[self._anomalies(p, high)]]] = True
        inside = (p > 0x20) & (p != _END)
        dropped = inside & bad[token]
        first = np.concatenate(([_END], p[:-1]))
        either = ((first > 0x7F) & (first != _END)) | ((p > 0x7F) & (p != _END))
        either &= ~dropped & ~np.concatenate(([False], dropped[:-1]))
        at = np.flatnonzero(either)
        return np.bincount(pair_bucket(self.folded[first[at]], self.folded[p[at]]).astype(np.int64), minlength=BUCKETS)


@lru_cache(maxsize=65536)
def _evident(c: int) -> bool:
    return _is_evidence(chr(c))


def repair_texts(df: DataFrame, column: str, surprise: np.ndarray, out: str = "repair") -> DataFrame:
    """``df`` with a struct ``out`` (garbled, restored, layers); pure ASCII rows never leave the JVM, what the screen clears costs no call.

    ``surprise`` is a table of `surprise_table`, of this corpus or one that was stored: with a stored one a record's result does
    not depend on the records beside it.
    """
    shared = df.sparkSession.sparkContext.broadcast(surprise)
    state: dict[str, tuple[Repairer, Screen]] = {}

    @F.arrow_udf(T.StructType(_FIELDS))
    def fix(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if "r" not in state:
            state["r"] = Repairer(shared.value), Screen(shared.value)
        repairer, screen = state["r"]
        for batch in batches:
            parts = [batch.slice(lo, 2000) for lo in range(0, len(batch), 2000)] or [batch]
            done = []
            for texts in parts:  # small pieces: a batch of long texts is large as code points
                suspects = np.flatnonzero(screen.suspects(texts))
                garbled, layers, restored = np.zeros(len(texts), dtype=bool), np.zeros(len(texts), dtype=np.int32), texts
                if suspects.size:
                    fixed = [repairer.repair(t) for t in texts.take(pa.array(suspects)).to_pylist()]
                    garbled[suspects], layers[suspects] = [f[0] for f in fixed], [f[2] for f in fixed]
                    mask = np.zeros(len(texts), dtype=bool)
                    mask[suspects] = True
                    restored = pc.replace_with_mask(texts, pa.array(mask), pa.array([f[1] for f in fixed], texts.type))
                done.append(pa.StructArray.from_arrays([pa.array(garbled), restored, pa.array(layers)], names=["garbled", "restored", "layers"]))
            yield pa.concat_arrays(done)

    text = F.col(column)
    high = F.coalesce(text.rlike(r"[^\x00-\x7F]"), F.lit(False))
    # The tuple goes through one call for the rows beyond ASCII and is read off twice.
    # Not deterministic for Spark: else a later filter would take the call below the union and run it again.
    fixed = fix.asNondeterministic()(F.when(high, text))
    return df.withColumn(out, F.when(high, fixed).otherwise(F.struct(F.lit(False).alias("garbled"), text.alias("restored"), F.lit(0).alias("layers"))))


def garbled_records(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """``table_name, row_id, text, repair`` of every record of ``(name, frame, id column, text column)``."""
    parts = [df.select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text")) for name, df, key, text in tables]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = spread(rows)
    return repair_texts(rows, "text", surprise_table(pair_counts(rows)))
