"""Interval algebra over references: positions, unions, joins, counts per verse.

All of it is relational. Aggregations dedupe or combine on the map side before a shuffle, so a book with
a third of all references does not meet in one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..canon import END_OF_CHAPTER, Canon
from ..functions import columns as C

#: Rows of book dimensions that may be broadcast. A canon has at most 255 books.
_DIM_ROWS = 10_000
#: Verses of a book per bucket of an interval join: more than most references hold, so that most are in one or two.
BUCKET = 16


def dim_positions(spark: SparkSession, canon: Canon) -> DataFrame:
    """``book_id, lengths, before``: verses of each chapter, and verses before it."""
    rows = []
    for id_ in canon.by_id:
        lengths = list(canon.chapters(id_) or ())
        before, total = [], 0
        for n in lengths:
            before.append(total)
            total += n
        rows.append((id_, lengths, before))
    if len(rows) > _DIM_ROWS:
        raise ValueError("a canon of that size cannot be broadcast")
    return spark.createDataFrame(rows, "book_id int, lengths array<int>, before array<int>")


def _with_dim(df: DataFrame, canon: Canon) -> DataFrame:
    return df.join(F.broadcast(dim_positions(df.sparkSession, canon)), "book_id", "left")


def with_positions(segments: DataFrame, canon: Canon) -> DataFrame:
    """Exploded segments with ``pos_start, pos_end, bcv_start, bcv_end``."""
    s = {n: F.col(n) for n in ("kind", "sc", "sv", "ec", "ev")}
    joined = _with_dim(segments, canon)
    return joined.select(
        *segments.columns,
        C.start_position(s, F.col("lengths"), F.col("before")).alias("pos_start"),
        C.end_position(s, F.col("lengths"), F.col("before")).alias("pos_end"),
        C.bcv_start(F.col("book_id"), s).alias("bcv_start"),
        C.bcv_end(F.col("book_id"), s).alias("bcv_end"),
    )


def with_spans(refs: DataFrame, canon: Canon, out: str = "spans") -> DataFrame:
    """References with their merged positions as an array (row-wise, nothing is shuffled)."""
    joined = _with_dim(refs, canon)
    return joined.withColumn(out, C.verse_spans(F.col("segments"), F.col("lengths"), F.col("before"))).drop("lengths", "before")


def ranges(segments: DataFrame, canon: Canon) -> DataFrame:
    """Exploded segments with both ends as verses; a chapter of unknown length ends at END_OF_CHAPTER."""
    joined = _with_dim(segments, canon)
    return joined.withColumn("end_verse", F.coalesce("ev", F.get("lengths", F.col("ec") - 1), F.lit(END_OF_CHAPTER))).drop("lengths", "before")


def verses(segments: DataFrame, canon: Canon, keys: list[str]) -> DataFrame:
    """Every verse of every segment, in written order, repeats kept; chapters of unknown length give none.

    Verse 0 (introductions) only where it is named: chapter 0 has only verse 0.
    """
    joined = _with_dim(segments, canon).withColumn("chapter", F.explode(F.expr("sequence(sc, greatest(sc, ec))"))).where("ec >= sc")
    length = F.get("lengths", F.col("chapter") - 1)
    first = F.when(F.col("chapter") == F.col("sc"), F.col("sv")).otherwise(1)
    last = F.when((F.col("chapter") == F.col("ec")) & F.col("ev").isNotNull() & (F.col("ev") != END_OF_CHAPTER), F.col("ev")).when(F.col("chapter") == 0, 0).otherwise(length)
    ends = joined.withColumn("_a", first).withColumn("_b", last).where("_b IS NOT NULL AND _a <= _b")
    return ends.select(*keys, "seg_no", "book_id", "chapter", F.explode(F.sequence("_a", "_b")).alias("verse"))


def islands(spans: DataFrame, keys: list[str], start: str = "pos_start", end: str = "pos_end") -> DataFrame:
    """Spans per key merged where they overlap or touch.

    Equal spans are combined before the shuffle and only the farthest end of each start is kept: what a
    window has to sort is bounded by the number of distinct starts, not of rows.
    """
    far = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*keys, start).agg(F.max(end).alias(end))
    order = Window.partitionBy(*keys).orderBy(start)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = far.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + 1), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def merge_refs(segments: DataFrame, canon: Canon, keys: list[str]) -> DataFrame:
    """The union of each key's and book's segments as segments in order (``keys, book_id, seg_no, kind, sc, sv, ec, ev``).

    Segments that overlap or follow each other join, across a chapter's end where its length is known;
    whole chapters stay whole.
    """
    group = [*keys, "book_id"]
    open_end = F.coalesce("ev", F.lit(END_OF_CHAPTER))
    s = _with_dim(segments, canon).withColumn("_s", F.col("sc") * 1000 + F.col("sv")).withColumn("_e", F.col("ec") * 1000 + open_end)
    # What follows an end: the next verse, or the next chapter's first behind a chapter's end.
    chapter, verse = F.floor(F.col("_e") / 1000).cast("int"), F.col("_e") % 1000
    at_end = (verse == END_OF_CHAPTER) | (verse == F.coalesce(F.get("lengths", chapter - 1), F.lit(-1)))
    s = s.groupBy(*group, "_s").agg(F.max("_e").alias("_e"), F.first("lengths").alias("lengths"))
    s = s.withColumn("_next", F.when(at_end, (chapter + 1) * 1000 + 1).otherwise(F.col("_e") + 1))
    order = Window.partitionBy(*group).orderBy("_s")
    # The farthest end so far decides, with the verse that follows it.
    reach = F.max(F.struct("_e", "_next")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = s.withColumn("_reach", reach["_next"]).withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("_s") > F.col("_reach")), 1).otherwise(0))
    numbered = marked.withColumn("seg_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    merged = numbered.groupBy(*group, "seg_no").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.first("lengths").alias("lengths"))
    sc, sv = F.floor(F.col("_s") / 1000).cast("int"), (F.col("_s") % 1000).cast("int")
    ec, ev = F.floor(F.col("_e") / 1000).cast("int"), (F.col("_e") % 1000).cast("int")
    whole = (ev == END_OF_CHAPTER) & (sv <= 1)
    end = F.when(whole, F.lit(None).cast("int")).when(ev == END_OF_CHAPTER, F.coalesce(F.get("lengths", ec - 1), F.lit(END_OF_CHAPTER))).otherwise(ev)
    seg = C.make_segment(sc, sv, ec, end)
    return merged.select(*group, "seg_no", seg.alias("s")).select(*group, "seg_no", *[F.col(f"s.{n}").alias(n) for n in ("kind", "sc", "sv", "ec", "ev")])


def collect_segments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Exploded segments back as arrays, in order of ``seg_no``. The groups are references or merged passages, which are short."""
    packed = F.array_sort(F.collect_list(F.struct("seg_no", "kind", "sc", "sv", "ec", "ev")))
    array = F.transform(packed, lambda x: F.struct(*[x[n].alias(n) for n in ("kind", "sc", "sv", "ec", "ev")]))
    return segments.groupBy(*keys, "book_id").agg(array.alias("segments"))


def interval_join(left: DataFrame, right: DataFrame, how: str = "inner", keys: list[str] | None = None) -> DataFrame:
    """Pairs of segments that share a verse, each pair once: ``left`` columns as ``l_*``, ``right`` as ``r_*``.

    Both sides are put into buckets of BUCKET positions of a book, so the join is an equi-join that
    spreads and that AQE can split where a bucket is hot, and few rows meet that share no verse; a pair is
    reported in the bucket where the later one starts. With ``left_semi`` or ``left_anti`` the rows of ``left`` are kept or dropped by ``keys``: all
    rows of a key go together (a reference's segments, or one segment if the keys are that fine).
    """
    ln = {c: f"l_{c}" for c in left.columns}
    rn = {c: f"r_{c}" for c in right.columns}
    one = left.select(*[F.col(c).alias(n) for c, n in ln.items()])
    two = right.select(*[F.col(c).alias(n) for c, n in rn.items()])
    overlap = (F.col("l_pos_start") <= F.col("r_pos_end")) & (F.col("r_pos_start") <= F.col("l_pos_end"))
    if how in ("left_semi", "left_anti"):
        if not keys:
            raise ValueError("a semi or anti join of intervals needs the keys of a row")
        same = (F.col("l_book_id") == F.col("r_book_id")) & (F.col("l__bucket") == F.col("r__bucket"))
        hits = _buckets(one, "l_").join(_buckets(two, "r_"), same & overlap, "left_semi").select(*[F.col(f"l_{k}").alias(f"_h_{k}") for k in keys]).distinct()
        match = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
        return left.join(hits, match, how)
    a, b = _buckets(one, "l_"), _buckets(two, "r_")
    owner = F.col("l__bucket") == F.expr(f"greatest(l_pos_start, r_pos_start) DIV {BUCKET}")
    return a.join(b, (F.col("l_book_id") == F.col("r_book_id")) & (F.col("l__bucket") == F.col("r__bucket")) & overlap & owner).drop("l__bucket", "r__bucket")


def _buckets(df: DataFrame, prefix: str) -> DataFrame:
    first, last = f"{prefix}pos_start", f"{prefix}pos_end"
    return df.withColumn(f"{prefix}_bucket", F.explode(F.expr(f"sequence({first} DIV {BUCKET}, greatest({first}, {last}) DIV {BUCKET})")))


def verse_counts(positions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """How many segments hold each verse: ``keys, book_id, pos, n``.

    Only the ends of a segment are counted (+1 where it starts, -1 behind its end) and summed up along
    the book, so a reference to a whole book costs two rows, not thousands; ends combine before the shuffle.
    """
    group = [*(keys or []), "book_id"]
    ends = positions.select(*group, F.explode(F.array(F.struct(F.col("pos_start").alias("p"), F.lit(1).alias("d")), F.struct((F.col("pos_end") + 1).alias("p"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.groupBy(*group, F.col("x.p").alias("p")).agg(F.sum("x.d").alias("d"))
    order = Window.partitionBy(*group).orderBy("p")
    runs = steps.withColumn("n", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("to", F.lead("p").over(order) - 1)
    return runs.where("n > 0").select(*group, F.explode(F.sequence("p", "to")).alias("pos"), F.col("n").cast("bigint").alias("n"))


def contains(a: Column, b: Column) -> Column:
    return C.spans_contain(a, b)


def overlaps(a: Column, b: Column) -> Column:
    return C.spans_overlap(a, b)
