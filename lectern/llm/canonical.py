"""Mapping of freely typed values to a canonical list (BK-tree over a true edit metric).

Every reference entry has one or more spellings (name, abbreviation, codes, aliases). A spelling is
reduced to a key ``(number, letters)``; the distance of two keys is the unrestricted
Damerau-Levenshtein distance of the letters plus a discrete metric on the number ("1 Samuel" is not a
misspelt "2 Samuel"). A sum of metrics is a metric, so the triangle inequality prunes the tree.

Results for odd input: null and blank values are not looked up and give a null target; a value that
is near nothing, or equally near to two different targets, gives the empty string; an empty value or
reference table gives empty results / no match; very long values are compared as any other (a length
difference alone prunes them).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import spread

#: Weight of differing numbers: beyond any threshold.
NUMBER_WEIGHT = 1000
#: Ranks of abbreviations and codes: so short that an edit makes another one, hence only exact matches count.
EXACT_RANKS = (1, 2, 3)
#: Most spellings that one broadcast tree may hold; a longer list is sharded. About 200 bytes each.
MAX_BROADCAST_SPELLINGS = 200_000
#: Spellings of a shard and distinct values of a block: what one task holds of a list beyond that.
SHARD_SPELLINGS, BLOCK_VALUES = 20_000, 20_000

# Words that number a book, and wrappings that are typed around a name.
_NUMBERS = {"i": "1", "ii": "2", "iii": "3", "1st": "1", "2nd": "2", "3rd": "3", "first": "1", "second": "2", "third": "3"}
_PREFIX = re.compile(r"^(?:the book of|book of|bk of|bk|the|st|saint)\s+(?=\S)")
_SUFFIX = re.compile(r"\s*(?:\((?:all|genre|book|books)\)|\s[–—-]\s*notes)\s*$")
_INVISIBLE = dict.fromkeys([0x00AD, 0x034F, 0x061C, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF])


def key_of(value: str) -> tuple[str, str]:
    """``(number, letters)`` of a typed value; number is empty where there is none."""
    s = unicodedata.normalize("NFKC", value).translate(_INVISIBLE).lower().strip()
    s = _SUFFIX.sub("", s)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    s = s.replace("ß", "ss")
    s = " ".join("".join(c if c.isalnum() or c == "&" else " " for c in s.replace("'", "").replace("’", "")).split())
    while (t := _PREFIX.sub("", s)) != s:
        s = t
    words = s.split()
    number = ""
    if words:
        if m := re.fullmatch(r"([1-9])([^\W\d].*)", words[0]):
            words[:1] = ["".join(m[1]), m[2]] if m[2] not in ("st", "nd", "rd") else words[:1]
        first = _NUMBERS.get(words[0], words[0])
        if len(words) > 1 and re.fullmatch(r"[1-9]", first):
            number, words = first, words[1:]
        elif len(words) > 1 and re.fullmatch(r"[1-9]", last := _NUMBERS.get(words[-1], words[-1])):
            number, words = last, words[:-1]
    return number, "".join(words)


def letters_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance, a true metric (unlike the restricted one)."""
    if a == b:
        return 0
    # Common ends cost nothing.
    k, n, m = 0, len(a), len(b)
    while k < n and k < m and a[k] == b[k]:
        k += 1
    while n > k and m > k and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[k:n], b[k:m]
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    first = list(range(m + 1))
    rows = [first]
    last_row: dict[str, int] = {}
    get = last_row.get
    for i, x in enumerate(a, 1):
        above, left, last_col = rows[-1], i, 0
        row = [i]
        add = row.append
        for j, y in enumerate(b, 1):
            if x == y:
                left = above[j - 1]
                last_col = j
            else:
                up, corner = above[j], above[j - 1]
                if corner < up:
                    up = corner
                left = 1 + (up if up < left else left)
                # A swap with what stands between taken out and put in.
                if last_col and (i1 := get(y, 0)):
                    swapped = rows[i1 - 1][last_col - 1] + i - i1 + j - last_col - 1
                    if swapped < left:
                        left = swapped
            add(left)
        rows.append(row)
        last_row[x] = i
    return rows[n][m]


def key_distance(a: tuple[str, str], b: tuple[str, str]) -> int:
    return letters_distance(a[1], b[1]) + (NUMBER_WEIGHT if a[0] != b[0] else 0)


def threshold(key: tuple[str, str]) -> int:
    """Edits allowed for a key: none up to two letters, one up to seven, two beyond, three from fourteen on."""
    n = len(key[1])
    return 0 if n < 3 else 1 if n < 8 else 2 if n < 14 else 3


class BKTree:
    """A BK-tree; ``within`` returns every entry within a radius, pruned by the triangle inequality."""

    def __init__(self, keys: Iterable[tuple[str, str]]):
        self.root: list | None = None
        self.visited = 0
        for key in keys:
            self.add(key)

    def add(self, key: tuple[str, str]) -> None:
        if self.root is None:
            self.root = [key, {}]
            return
        node = self.root
        while True:
            d = key_distance(key, node[0])
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = [key, {}]
                return
            node = node[1][d]

    def within(self, key: tuple[str, str], radius: int) -> list[tuple[int, tuple[str, str]]]:
        out, stack = [], [self.root] if self.root else []
        length = len(key[1])
        while stack:
            other, children = stack.pop()
            # At least the difference in length: where that is beyond every child, neither it nor a child can be within.
            if key[0] == other[0] and abs(length - len(other[1])) > radius + max(children, default=0):
                continue
            d = key_distance(key, other)
            self.visited += 1
            if d <= radius:
                out.append((d, other))
            for e, child in children.items():
                if d - radius <= e <= d + radius:
                    stack.append(child)
        return sorted(out)


class Matcher:
    """Nearest target of a typed value among ``(spelling, target, rank)``; lower ranks win ties."""

    def __init__(self, spellings: Iterable[tuple[str, str, int]]):
        self.targets: dict[tuple[str, str], dict[str, int]] = {}
        for spelling, target, rank in spellings:
            if spelling is None or target is None or not (key := key_of(spelling))[1]:
                continue
            own = self.targets.setdefault(key, {})
            own[target] = min(rank, own.get(target, rank))
        self.tree = BKTree(self.targets)
        self.memo: dict[str, list[tuple[int, int, str]]] = {}

    def candidates(self, value: str) -> list[tuple[int, int, str]]:
        """Every ``(distance, rank, target)`` within the value's threshold, nearest first."""
        if (known := self.memo.get(value)) is not None:
            return known
        key = key_of(value)
        near = self.tree.within(key, threshold(key)) if key[1] else []
        found = sorted({(d, rank, target) for d, k in near for target, rank in self.targets[k].items() if d == 0 or rank not in EXACT_RANKS})
        if len(self.memo) >= 200_000:  # a bound on the worker's memory, not on the results
            self.memo.clear()
        if len(value) <= 200:
            self.memo[value] = found
        return found


def decide(found: list[tuple[int, int, str]]) -> str:
    """The winner of all shards' candidates: least distance, then rank; empty where two targets tie."""
    if not found:
        return ""
    best = min(found)[:2]
    winners = {t for d, r, t in found if (d, r) == best}
    return winners.pop() if len(winners) == 1 else ""


CANDIDATES = T.ArrayType(T.StructType([T.StructField("d", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("target", T.StringType())]))


def _rows(reference: DataFrame, limit: int) -> list[tuple[str, str, int]] | None:
    """The reference spellings, or None where there are more than ``limit``: the size is checked before anything is sent."""
    got = reference.limit(limit + 1).collect()
    return None if len(got) > limit else [(r["spelling"], r["target"], r["rank"]) for r in got]


def match_values(values: DataFrame, column: str, reference: DataFrame, out: str = "target", max_broadcast: int = MAX_BROADCAST_SPELLINGS, shard: int = SHARD_SPELLINGS, block: int = BLOCK_VALUES) -> DataFrame:
    """``values`` with the canonical target of ``column`` in ``out`` ('' for none, null for null or blank).

    ``reference`` has ``spelling, target, rank``. A list of at most ``max_broadcast`` spellings goes to
    every worker as one tree and nothing is shuffled, whatever the skew of the values; each worker looks
    a distinct value up once. A longer list is cut into shards by hash, the distinct values into blocks:
    each shard meets each block in one task (`sharded_candidates`), its tree returns all entries within
    the threshold, and the shards' winners are merged by an aggregation.
    """
    rows = _rows(reference, max_broadcast)
    typed = F.col(column)
    blank = typed.isNull() | (F.trim(typed) == "")
    if rows is not None:
        return values.withColumn(out, F.when(~blank, _broadcast_lookup(values, rows)(typed)))
    near = sharded_candidates(values.where(~blank).select(typed.alias("_value")).distinct(), reference, shard, block)
    # Both aggregations run where the values were sent once.
    tied = near.repartition("_value").groupBy("_value", "d", "rank").agg(F.min("target").alias("least"), F.max("target").alias("most"))
    best = tied.groupBy("_value").agg(F.min(F.struct("d", "rank", "least", "most")).alias("_best"))
    winners = best.select("_value", F.when(F.col("_best.least") == F.col("_best.most"), F.col("_best.least")).otherwise(F.lit("")).alias("_target"))
    return values.join(winners, typed.eqNullSafe(F.col("_value")), "left").withColumn(out, F.when(~blank, F.coalesce("_target", F.lit("")))).drop("_value", "_target")


def sharded_candidates(distinct: DataFrame, reference: DataFrame, shard: int = SHARD_SPELLINGS, block: int = BLOCK_VALUES) -> DataFrame:
    """``_value, d, rank, target``: every entry within the threshold of each value, from every shard.

    A task holds one shard of about ``shard`` spellings and one block of about ``block`` values, however long either side is.
    """
    shards, blocks = (max(1, -(-n // size)) for n, size in ((reference.count(), shard), (distinct.count(), block)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = distinct.withColumn("_block", part("_value", blocks)).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = reference.select("spelling", "target", "rank").where("spelling IS NOT NULL").withColumn("_shard", part("spelling", shards)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(typed: pd.DataFrame, spellings: pd.DataFrame) -> pd.DataFrame:
        m = Matcher(spellings[["spelling", "target", "rank"]].itertuples(index=False, name=None))
        return pd.DataFrame([(v, d, r, t) for v in typed["_value"] for d, r, t in m.candidates(v)], columns=["_value", "d", "rank", "target"])

    return left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInPandas(search, "_value string, d int, rank int, target string")


def _broadcast_lookup(values: DataFrame, rows: list[tuple[str, str, int]]):
    shared = values.sparkSession.sparkContext.broadcast(rows)
    state: dict[str, Matcher] = {}

    @F.pandas_udf(T.StringType())
    def lookup(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = state.setdefault("m", Matcher(shared.value))
        for batch in batches:
            codes, distinct = pd.factorize(batch)
            answer = pd.Series([decide(m.candidates(v)) for v in distinct] + [None], dtype=object)
            yield pd.Series(answer.to_numpy()[codes])

    return lookup


def book_spellings(books: DataFrame) -> DataFrame:
    """Trusted spellings of the books: names first, then abbreviation and codes."""
    return books.select(
        F.col("book").alias("target"),
        F.explode(F.array(*[F.struct(F.col(c).alias("spelling"), F.lit(r).alias("rank")) for r, c in enumerate(("book", "abbreviation", "osis", "usfm"))])).alias("s"),
    ).select("s.spelling", "target", "s.rank").where("spelling IS NOT NULL AND target IS NOT NULL")


def looks_like_name(c: Column) -> Column:
    """A proper name, in any script: it starts with a capital, a letter without case, or a number before a capital."""
    return c.rlike(r"^\s*(?:\d+(?:st|nd|rd)?[ ._-]*)?[\p{Lu}\p{Lt}\p{Lo}]")


def check_aliases(books: DataFrame, max_broadcast: int = MAX_BROADCAST_SPELLINGS) -> DataFrame:
    """Every hand-collected alias ``(id, pos, alias, book, target)``; target is the book it names, '' for none.

    An alias near a trusted spelling names that book. One near nothing is a name of its own row's book
    (another language's, say) if it looks like a name, and a stray note otherwise.
    """
    exploded = books.select("id", "book", F.posexplode("abbreviations").alias("pos", "alias")).where("alias IS NOT NULL AND trim(alias) <> ''")
    named = match_values(exploded, "alias", book_spellings(books), "near", max_broadcast)
    return named.select("id", "pos", "alias", "book", F.when(F.col("near") != "", F.col("near")).when(looks_like_name(F.col("alias")), F.col("book")).otherwise(F.lit("")).alias("target"))


def genre_spellings(genres: DataFrame) -> DataFrame:
    names = genres.select(F.col("title").alias("spelling"), F.col("title").alias("target"), F.lit(0).alias("rank"))
    short = genres.select(F.explode("abbreviations").alias("spelling"), F.col("title").alias("target"), F.lit(4).alias("rank"))
    return names.unionByName(short).where("spelling IS NOT NULL AND target IS NOT NULL")


def canonical_found(scopes: DataFrame, books: DataFrame, genres: DataFrame, max_broadcast: int = MAX_BROADCAST_SPELLINGS) -> DataFrame:
    """``field, row_id, pos, target`` of every typed value that is not canonical already.

    One job reads both reference lists and checks their size; up to ``max_broadcast`` spellings all values pass once by
    the two trees. Longer lists go through `match_values`, list by list.
    """
    aliases = books.select(F.lit("alias").alias("field"), F.col("id").cast("bigint").alias("id"), F.posexplode("abbreviations").alias("pos", "spelling"), F.col("book").alias("target")).where("spelling IS NOT NULL AND trim(spelling) <> ''")
    columns = ("field", "id", "pos", "spelling", "target", "rank")
    plain = lambda field, df: df.select(F.lit(field).alias("field"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("int").alias("pos"), "spelling", "target", "rank")
    reference = plain("books", book_spellings(books)).unionByName(plain("genres", genre_spellings(genres))).unionByName(aliases.withColumn("rank", F.lit(4)).select(*columns))
    rows = reference.withColumn("named", looks_like_name(F.col("spelling"))).limit(max_broadcast + 1).collect()
    if len(rows) > max_broadcast:
        return _canonical_found_sharded(scopes, books, genres, max_broadcast)
    spellings = {f: [(r["spelling"], r["target"], r["rank"]) for r in rows if r["field"] == f] for f in ("books", "genres")}
    trusted, odd = Matcher(spellings["books"]), []
    for r in rows:
        if r["field"] == "alias":
            means = decide(trusted.candidates(r["spelling"])) or (r["target"] if r["named"] else "")
            if means == r["target"]:
                spellings["books"].append((r["spelling"], means, 4))
            elif r["target"] is not None:
                odd.append(("abbreviations", r["id"], r["pos"], means))
    # The names themselves: a value that is one is no case.
    names = {f: frozenset(t for s, t, r in spellings[f] if r == 0 and s == t) for f in spellings}
    spark = scopes.sparkSession
    shared = spark.sparkContext.broadcast((spellings, names))
    state: dict[str, Matcher] = {}

    @F.arrow_udf("string")
    def lookup(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        spelled, canonical = shared.value
        for f in spelled:
            state.setdefault(f, Matcher(spelled[f]))
        for fields, values in batches:
            coded = pc.binary_join_element_wise(fields, values, "\x1f").dictionary_encode()
            answers = []
            for key in coded.dictionary.to_pylist():
                f, _, value = key.partition("\x1f")
                answers.append(None if value in canonical[f] else decide(state[f].candidates(value)))
            yield pa.array(answers, pa.string()).take(coded.indices)

    typed = spread(scopes.select("scope_id", "books", "genres")).select(
        F.col("scope_id").cast("bigint").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("typed")) for f in ("books", "genres")])).alias("list")
    )
    items = typed.select("row_id", F.col("list.field").alias("field"), F.posexplode("list.typed").alias("pos", "value")).where(_NOT_BLANK)
    found = items.select("field", "row_id", F.col("pos").cast("int").alias("pos"), lookup.asNondeterministic()(F.col("field"), F.col("value")).alias("target")).where("target IS NOT NULL")
    return found.unionByName(spark.createDataFrame(odd, "field string, row_id bigint, pos int, target string"))


_NOT_BLANK = "value IS NOT NULL AND trim(translate(value, '\t\n\r ', '    ')) <> ''"


def _canonical_found_sharded(scopes: DataFrame, books: DataFrame, genres: DataFrame, max_broadcast: int) -> DataFrame:
    """The same where the lists are longer than what is sent to every worker."""

    def typed(field: str, canonical: DataFrame, name: str, reference: DataFrame) -> DataFrame:
        names = canonical.select(F.col(name).alias("_n")).where("_n IS NOT NULL").distinct()
        items = scopes.select(F.col("scope_id").cast("bigint").alias("row_id"), F.posexplode(field).alias("pos", "value")).where(_NOT_BLANK)
        items = items.join(names, F.col("value") == F.col("_n"), "left_anti")
        return match_values(items, "value", reference, max_broadcast=max_broadcast).select(F.lit(field).alias("field"), "row_id", F.col("pos").cast("int").alias("pos"), "target")

    aliases = check_aliases(books, max_broadcast)
    odd = aliases.where("target <> book").select(F.lit("abbreviations").alias("field"), F.col("id").cast("bigint").alias("row_id"), F.col("pos").cast("int").alias("pos"), "target")
    own = aliases.where("target = book").select(F.col("alias").alias("spelling"), "target", F.lit(4).alias("rank"))
    return typed("books", books, "book", book_spellings(books).unionByName(own)).unionByName(typed("genres", genres, "title", genre_spellings(genres))).unionByName(odd)
