"""DataFrame operators against brute force, sources, index, streaming, the incremental store, the contract."""

from __future__ import annotations

import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import columns as C
from lectern.functions import grammar, notation
from lectern.functions.refs import Finder
from lectern.operators import algebra, extract, filters, incremental, index, ordering
from lectern.sources import adapters, epub, files, html, structured, subtitles
from lectern.streaming import refs as streaming

from .conftest import DATA, ROOT


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_extract_handles_empty_null_and_long_texts(spark, canon):
    long = "word " * 20000 + "John 3:16"
    got = extract.extract_refs(docs(spark, [None, "", "  ", "see John 3:16", long, "é📖 Jn 4:1;\nJude 5"]), canon)
    assert [(r["id"], r["ref_no"], r["book_id"]) for r in got.orderBy("id", "ref_no").collect()] == [(3, 1, 43), (4, 1, 43), (5, 1, 43), (5, 2, 65)]
    r = got.where("id = 5 AND ref_no = 1").first()
    assert (r["start_char"], r["start_byte"], r["start_utf16"], r["written"]) == (3, 7, 4, "Jn 4:1")
    assert extract.extract_refs(docs(spark, ["x"]).limit(0), canon).count() == 0
    assert extract.first_ref(docs(spark, ["Jn 4:1, Jude 5"]), canon).count() == 1


def test_extra_columns_may_clash(spark, canon):
    df = docs(spark, ["John 3:16"]).withColumn("book", F.lit("x")).withColumn("start", F.lit(1)).withColumn("_s", F.lit(2))
    assert extract.extract_refs(df, canon).first()["book"] == "x"


def _random_segments(seed, n=300):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        book = rnd.choice([43, 45, 65, 22])
        counts = {43: 21, 45: 16, 65: 1, 22: 8}[book]
        a, b = sorted([rnd.randint(1, counts), rnd.randint(1, counts)])
        if rnd.random() < 0.3:
            s = grammar.chapters(a, min(b, a + 2))
        else:
            s = grammar.verses(*min((a, rnd.randint(1, 20)), (min(b, a + 1), rnd.randint(1, 20))), *max((a, 20), (min(b, a + 1), rnd.randint(1, 20))))
        out.append((k, k % 7, book, 1, *s))
    return out


SCHEMA = "k int, g int, book_id int, seg_no int, kind int, sc int, sv int, ec int, ev int"


def test_positions_merge_and_counts_against_brute_force(spark, canon):
    data = _random_segments(1)
    seg = spark.createDataFrame(data, SCHEMA)
    pos = algebra.with_positions(seg, canon)
    want = {(d[0], *notation.spans([d[4:]], canon.chapters(d[2]))[0]) for d in data}
    assert {(r["k"], r["pos_start"], r["pos_end"]) for r in pos.collect()} == want
    by = {}
    for d in data:
        by.setdefault((d[1], d[2]), []).append(d[4:])
    isl = {(r["g"], r["book_id"], r["pos_start"], r["pos_end"]) for r in algebra.islands(pos, ["g", "book_id"]).collect()}
    assert isl == {(*key, a, b) for key, segs in by.items() for a, b in notation.spans(segs, canon.chapters(key[1]))}
    counts = {}
    for d in data:
        for a, b in notation.spans([d[4:]], canon.chapters(d[2])):
            for p in range(a, b + 1):
                counts[d[2], p] = counts.get((d[2], p), 0) + 1
    assert {(r["book_id"], r["pos"]): r["n"] for r in algebra.verse_counts(pos).collect()} == counts
    merged = algebra.collect_segments(algebra.merge_refs(seg, canon, ["g"]), ["g"])
    for r in merged.collect():
        segs = [tuple(s) for s in r["segments"]]
        if r["book_id"] == 22:
            continue  # without counts, a range that ends with a chapter keeps its open end
        # The union covers the same verses, in order, with nothing left to join.
        assert notation.spans(segs, canon.chapters(r["book_id"])) == notation.spans(by[r["g"], r["book_id"]], canon.chapters(r["book_id"]))


@pytest.mark.parametrize(
    ("text", "want"),
    [("3:16-18, 17-20; 3", "3"), ("5; 4", "4-5"), ("3:36; 4:1", "3:36-4:1"), ("3:1-36; 4", "3-4"), ("3:16-4:2; 4", "3:16-4:54"), ("1-2:3; 2:4-10", "1:1-2:10"), ("3:16; 3:18", "3:16,18")],
)
def test_merge_keeps_whole_chapters(spark, canon, finder, text, want):
    book, segs = finder.parse(f"John {text}", validate=False)
    df = spark.createDataFrame([(1, 1, book, i, *s) for i, s in enumerate(segs)], SCHEMA)
    got = algebra.collect_segments(algebra.merge_refs(df, canon, ["k"]), ["k"]).first()["segments"]
    # A chapter that is listed verse by verse is written as its verses.
    written = notation.write_segments([tuple(s) for s in got])
    assert written == want or (text == "3:1-36; 4" and written in ("3-4", "3:1-4:54"))


def test_interval_join_reports_each_pair_once(spark, canon):
    data = _random_segments(2, 120)
    pos = algebra.with_positions(spark.createDataFrame(data, SCHEMA), canon)
    got = sorted((r["l_k"], r["r_k"]) for r in algebra.interval_join(pos, pos).collect())
    s = {r["k"]: (r["book_id"], r["pos_start"], r["pos_end"]) for r in pos.collect()}
    want = sorted((a, b) for a in s for b in s if s[a][0] == s[b][0] and s[a][1] <= s[b][2] and s[b][1] <= s[a][2])
    assert got == want
    few = pos.where("k < 5")
    semi = {r["k"] for r in algebra.interval_join(pos, few, "left_semi", ["k"]).collect()}
    anti = {r["k"] for r in algebra.interval_join(pos, few, "left_anti", ["k"]).collect()}
    assert semi == {a for a, b in want if b < 5} and anti == set(s) - semi


def test_verses_and_ranges(spark, canon):
    df = spark.createDataFrame([(1, 1, 43, 1, *grammar.verses(3, 35, 4, 2)), (2, 1, 22, 1, *grammar.chapters(3, 3)), (3, 1, 43, 1, 0, 3, 0, 3, 0)], SCHEMA)
    v = [(r["k"], r["chapter"], r["verse"]) for r in algebra.verses(df, canon, ["k"]).collect()]
    assert sorted(v) == [(1, 3, 35), (1, 3, 36), (1, 4, 1), (1, 4, 2), (3, 3, 0)]
    assert {r["k"]: r["end_verse"] for r in algebra.ranges(df, canon).collect()} == {1: 2, 2: 255, 3: 0}


def test_columns_write_like_python(spark, canon):
    rnd = random.Random(5)
    passages = []
    for k in range(200):
        segs = [tuple(s[4:]) for s in _random_segments(rnd.random(), rnd.randint(1, 5))]
        if rnd.random() < 0.2:
            segs.append((5, 2, 1, 3, 4))
        passages.append((k, 43, segs))
    df = spark.createDataFrame(passages, "k int, book_id int, segments array<struct<kind:int,sc:int,sv:int,ec:int,ev:int>>")
    got = df.select("k", C.write_segments(F.col("segments")).alias("w"), C.osis(F.lit("John"), F.col("segments")).alias("o"), C.usfm(F.lit("JHN"), F.col("segments")).alias("u")).collect()
    for r in got:
        segs = passages[r["k"]][2]
        assert (r["w"], r["o"], r["u"]) == (notation.write_segments(segs), notation.osis(canon, 43, segs), notation.usfm(canon, 43, segs))
    codes = F.create_map(F.lit("John"), F.lit(43), F.lit("Jude"), F.lit(65))
    texts = ["John.3.16-John.4.2 John.5", "Jude.1.3,Jude.1.5", "John", "", None, "John.3.16-Jude.1.1", "John.3 Jude.1", "John.x", "John|3|16|||", "John.3.16-John.4", "John.300", "Nope.1"]
    p = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", C.parse_osis(F.col("t"), codes).alias("p")).collect()
    assert [r["id"] for r in p if r["p"] is not None] == [0, 1] and [tuple(s) for s in p[0]["p"]["segments"]] == notation.parse_osis(canon, texts[0])[1]
    spans = {r["k"]: [tuple(s) for s in r["spans"]] for r in algebra.with_spans(df, canon).collect()}
    assert spans == {k: notation.spans(s, canon.chapters(43)) for k, _, s in passages}


def test_filters_commute_with_extraction(spark, canon, finder):
    texts = ["Romans 8:28", "Romans 8:38-9:1", "Romans 9:2", "John 8:1", "John 3", "John 2; 3:16", "Jude 4", "Romans 8", "Romans 8:1-5,6-10"]
    refs = extract.extract_refs(docs(spark, texts), canon)
    p = lambda *t: tuple(finder.read(x) for x in t)

    def kept(**more):
        return [texts[r["id"]] for r in filters.RefFilter(**more).apply(refs, canon).orderBy("id").collect()]

    assert kept(inside=p("Romans 8")) == ["Romans 8:28", "Romans 8", "Romans 8:1-5,6-10"]
    assert kept(any_overlap=p("Romans 9")) == ["Romans 8:38-9:1", "Romans 9:2"]
    assert kept(any_overlap=p("Romans 8"), exclude_overlap=p("Romans 9:1")) == ["Romans 8:28", "Romans 8", "Romans 8:1-5,6-10"]
    assert kept(inside=p("Romans 8:1-10")) == ["Romans 8:1-5,6-10"]
    assert kept(exact=p("Romans 8:1-39")) == ["Romans 8"] and kept(explicit_overlap=p("John 2-3")) == ["John 2; 3:16"]
    assert kept(verses_only=True, scope=filters.BookScope(books=("John", "Jude"))) == ["John 8:1", "John 2; 3:16", "Jude 4"]
    assert kept(verses_only=True, single_chapter_books=False, scope=filters.BookScope(books=("Jude",))) == []
    assert filters.BookScope.from_dict({"testaments": ["NT"], "excludeBooks": ["Jude"], "genres": ["New"]}).resolve(canon) == {40, 41, 43, 45, 49}
    assert filters.RefFilter(inside=p("John 3"), exclude_overlap=p("John 3")).contradiction(canon)
    assert filters.RefFilter(scope=filters.BookScope(books=("Mark",)), inside=p("John 3")).contradiction(canon)
    assert filters.auto_verses(filters.RefFilter()).verses_only and not filters.auto_verses(filters.RefFilter(inside=p("John 3"))).verses_only


@pytest.mark.parametrize(("glob", "path", "match"), [("*.md", "a/b.md", True), ("a/*.md", "a/b.md", True), ("a/*.md", "x/a/b.md", False), ("**/b.*", "a/c/b.md", True), ("[ab].md", "b.md", True), ("x?.md", "x/.md", False), ("{a,b}.md", "b.md", True), ("dir/", "x/dir/y.md", True)])
def test_globs(glob, path, match):
    import re

    assert bool(re.match(filters.glob_regex(glob), path)) is match


def test_orders_and_pages(spark, canon):
    df = spark.createDataFrame([("Notes/b.md", "John 3:16, Rom 8"), ("Notes/A.md", "Rom 8:1; see John 3"), ("other.md", "nothing"), ("Talk.SRT", "Jude 5")], "path string, text string")
    refs = extract.extract_refs(df, canon)
    assert [r["path"] for r in refs.orderBy(*ordering.file_order()).collect()] == ["Notes/A.md", "Notes/A.md", "Notes/b.md", "Notes/b.md", "Talk.SRT"]
    by_bible = [(r["book_id"], r["path"]) for r in refs.orderBy(*ordering.bible_order()).collect()]
    assert by_bible == [(43, "Notes/A.md"), (43, "Notes/b.md"), (45, "Notes/b.md"), (45, "Notes/A.md"), (65, "Talk.SRT")]
    assert ordering.page(refs, ordering.bible_order(), 1, 2).count() == 2
    assert rows(ordering.extension_counts(refs)) == [("md", 4, 2), ("srt", 1, 1)]
    assert [r[0] for r in ordering.files_without(df, refs).select("path").collect()] == ["other.md"]


SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nRead John 3:16\r\nand Rom 8:28.\r\n\r\nWEBVTT note\r\n\r\n2\r\n01:00.000 --> 01:03.000 align:start\r\nJude 5\r\n\r\n0:02:00.000,0:02:01.000\r\nsbv"


def test_subtitles(spark, canon):
    got = subtitles.cues(SRT)
    assert [(c.id, c.start_ms, c.end_ms, c.text) for c in got] == [(1, 1000, 2500, "Read John 3:16\r\nand Rom 8:28."), (2, 60000, 63000, "Jude 5"), (0, 120000, 121000, "sbv")]
    df = docs(spark, [SRT, "Jude 6 before\n\n" + SRT, None])
    placed = subtitles.place_in_cues(extract.extract_refs(df, canon), subtitles.cue_rows(df), ["id"])
    assert [(r["id"], r["cue_id"], r["label"], r["cue_end_ms"]) for r in placed.orderBy("id", "ref_no").collect()] == [
        (0, 1, "00:00:01.000", 2500), (0, 1, "00:00:01.000", 2500), (0, 2, "00:01:00.000", 63000),
        (1, None, None, None), (1, 1, "00:00:01.000", 2500), (1, 1, "00:00:01.000", 2500), (1, 2, "00:01:00.000", 63000),
    ]


PAGE = "<p>John&nbsp;3:16</p><script>Jude 5</script><div>a &lt; b <b>Rom</b> 8:<i>28</i> x&bogus; Jude 4</div>"


def test_html(spark, canon):
    v = html.Visible(PAGE)
    assert v.text == "John\xa03:16\na < b Rom 8:28 x&bogus; Jude 4\n"
    for f in Finder(canon).search(v.text):
        a, b = v.source(f.start), v.source_end(f.end)
        assert PAGE[a:b].startswith(("John", "Rom", "Jude")) and PAGE[a:b].endswith(("16", "28", "4"))
    r = adapters.extract_with(docs(spark, [PAGE]).withColumnRenamed("text", "html"), canon, html.pieces, html.COLUMNS, content="html")
    assert r.where("error IS NULL").count() == 3
    text = spark.createDataFrame([(PAGE,)], "h string").select(html.visible_text(F.col("h"))).first()[0]
    assert text == v.text
    words = "one two John 3:16 three John 3:16 four"
    f = html.make_fragment(words, 8, 17)
    assert html.find_fragment(words, f) == (8, 17) and html.TextFragment.decode(f.encode()) == f
    g = html.make_fragment(words, 24, 33)
    assert html.find_fragment(words, g) == (24, 33)
    long = "w " * 400
    assert html.make_fragment(long + "end", 0, len(long)).end == "w w w"


def test_json_and_xml(spark, canon):
    j = json.dumps({"John 1:1": "x", "a/b": ["Jude 5", {"~": "see Rom 8:28"}]})
    r = adapters.extract_with(docs(spark, [j, "{"]), canon, structured.json_pieces, structured.JSON_COLUMNS, content="text")
    assert [(x["pointer"], x["start"]) for x in r.where("error IS NULL").orderBy("ref_no").collect()] == [("/a~1b/0", 0), ("/a~1b/1/~0", 4)]
    assert r.where("error IS NOT NULL").count() == 1
    x = "<a><b>Jude 5</b><b>see <i>Rom</i> 8:28 <!-- c --> end</b>tail John 3:16</a>"
    got = [(p[0], p[1]) for text, loc in structured.xml_pieces(x) for f in Finder(canon).search(text) for p in [loc(f.start, f.end)]]
    assert got == [("/a/b[1]", 0), ("/a/b[2]", 5), ("/a", 33)]


def _epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="c1" href="c%201.xhtml"/><item id="c2" href="C2.XHTML"/><item id="bad" href="bad.xhtml"/></manifest><spine><itemref idref="gone"/><itemref idref="c1"/><itemref idref="bad"/><itemref idref="c2" id="two"/></spine></package>')
        z.writestr("OPS/nav.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="c%201.xhtml#x">One <b>here</b></a></li></ol></nav></body></html>')
        z.writestr("OPS/c 1.xhtml", "<html><head><title>Jude 1</title></head><body><p>📖 see  <b>John</b> 3:16</p><p>and&nbsp;Rom 8:28<br/>f</p></body></html>")
        z.writestr("OPS/bad.xhtml", "<html><body><p>Jude 5</body>")
        z.writestr("OPS/c2.xhtml", "<html><body><div id='d;1'>Jude 5</div></body></html>")
    return out.getvalue()


def test_epub(spark, canon):
    data = _epub()
    df = spark.createDataFrame([("b.epub", bytearray(data)), ("x.epub", bytearray(b"no zip"))], "path string, content binary")
    r = adapters.extract_with(df, canon, lambda c: epub.pieces(bytes(c), True), epub.COLUMNS)
    got = [(x["written"], x["cfi"], x["spine_index"], x["chapter"], x["line"]) for x in r.where("error IS NULL").orderBy("ref_no").collect()]
    assert got == [
        ("John 3:16", "epubcfi(/6/4[c1]!/4/2,/2/1:0,/3:5)", 0, "One here", 1),
        ("Rom 8:28", "epubcfi(/6/4[c1]!/4/4,/1:4,/1:12)", 0, "One here", 3),
        ("Jude 5", "epubcfi(/6/8[two]!/2/2[d^;1],/1:0,/1:6)", 2, None, 6),
    ]
    assert r.where("error IS NOT NULL").select("path").first()[0] == "x.epub"
    assert epub.book_text(data).split("\n\n")[0] == "📖 see John 3:16"
    link = spark.range(1).select(epub.wiki_link(F.lit("M D.epub"), F.lit("epubcfi(/6/14!/4)"), F.lit("J [3]|x")), epub.markdown_link(F.lit("M D.epub"), F.lit("epubcfi(/6/14!/4/2,/1:0)"), F.lit("J 3"))).first()
    assert link[0] == "[[M D.epub#epubcfi(/6/14!/4)|J 3 x]]" and link[1] == "[J 3](M%20D.epub#epubcfi%28/6/14!/4/2,/1%3A0%29)"


def test_files(spark, canon, tmp_path):
    for name, data in {"a.md": b"John 3:16", "sub/b.txt": b"Jude 5 \xff", "sub/skip.log": b"Jude 6", ".hid/x.md": b"Jude 7", "bin.dat": b"Jude\x00 8", "t.srt": SRT.encode(), ".gitignore": b"*.log\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    listed = [p.rpartition(str(tmp_path))[2] for p in files.list_files([str(tmp_path)])]
    assert listed == ["/a.md", "/bin.dat", "/sub/b.txt", "/t.srt"]
    assert len(files.list_files([str(tmp_path)], files.Walk(no_ignore=True, hidden=True, max_depth=1))) == 4
    got = files.text_files(files.read_binary(spark, str(tmp_path)))
    assert sorted(r["path"].rpartition("/")[2] for r in got.collect()) == ["a.md", "b.txt", "skip.log", "t.srt"]
    assert got.where("path LIKE '%b.txt'").first()["text"] == "Jude 5 �"
    assert files.parse_size("10M") == 10 << 20


def test_cli(canon, spark, tmp_path, capsys):
    from lectern import cli

    data = tmp_path / "canon.json"
    data.write_text(json.dumps({"books": [{"id": b.id, "book": b.name, "abbreviation": b.abbreviation, "osis": b.osis, "usfm": b.usfm, "abbreviations": b.aliases, "ambiguous": b.ambiguous} for b in canon.books], "chapter_verses": {b.name: canon.counts[b.id] for b in canon.books if b.id in canon.counts}}))
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.md").write_text("one\nsee John 3:16 here\nJohn 4\n")
    (tmp_path / "n/b.srt").write_text(SRT)
    (tmp_path / "n/c.epub").write_bytes(_epub())
    base = ["--canon", str(data)]

    def run(*argv):
        code = cli.main([*base, *argv])
        return code, capsys.readouterr().out.strip().splitlines()

    assert run("--text", "John 3:16, Jude 5", "-b", "Jude", "-m", "quickfix") == (0, ["1:12: Jude 1:5"])
    assert run("--text", "nothing")[0] == 1 and cli.main([*base, "-b", "Nope", "--text", "x"]) == 2
    capsys.readouterr()
    code, out = run(str(tmp_path / "n"), "-m", "total-count")
    assert (code, out) == (0, ["7"])
    code, out = run(str(tmp_path / "n"), "-m", "quickfix", "-i", "Jude")
    assert [x.rpartition("/")[2] for x in out] == ["b.srt:10:1: Jude 1:5 (00:01:00.000)", "c.epub:6:1: Jude 1:5"]
    assert len(run(str(tmp_path / "n"), "-l", "-b", "Romans")[1]) == 1
    assert run("--text", "x John 4 y", "--chapters", "-m", "count") == (0, [":1"])
    config = tmp_path / "c.toml"
    config.write_text('mode = "total-count"\n[queries]\ngos = "-b John --chapters"\n')
    assert run("--config", str(config), "-q", "gos", "--text", "John 3:16, Jude 5, John 2") == (0, ["2"])
    assert run("--complete", "Jude 2")[1][:2] == ["Jude 1:2", "Jude 1:20"] and len(run("--list-books")[1]) == len(canon.books)
    code, out = run("--text", "see John 3:16", "-m", "table")
    assert out[0].startswith("| Reference")


def test_index_tables(spark, tmp_path):
    e = spark.createDataFrame([(1, "d1", "text", 3, "a.md", 10, 100, 7, 5), (2, "d2", "text", 3, "a.md", 10, 101, 7, 9), (3, "d2", "text", 4, "x/b.md", 11, 50, None, 2)], "entry_id int, pack_device string, kind string, pack_number int, path string, size bigint, mtime bigint, hash bigint, written bigint")
    c = spark.createDataFrame([("d3", "a.md", 10, 200, "d1", 5)], "pack_device string, path string, size bigint, mtime bigint, device string, written bigint")
    l = spark.createDataFrame([("d1", "a.md", 10, 100), ("d3", "a.md", 10, 200), ("d3", "a.md", 10, 101), ("d3", "a.md", 10, 999), ("d3", "new.md", 1, 1), ("d3", None, 1, 1)], "device string, path string, size bigint, mtime bigint")
    got = {(r["device"], r["mtime"]): (r["status"], r["entry_id"]) for r in index.check(l, e, c).collect() if r["path"] == "a.md"}
    assert got == {("d1", 100): ("fresh", 1), ("d3", 200): ("fresh", 1), ("d3", 101): ("fresh", 2), ("d3", 999): ("unconfirmed", 2)}
    own, other = index.confirm(l.withColumn("hash", F.lit(7).cast("bigint")), e)
    assert rows(own) == [] and {r["device"] for r in other.collect()} == {"d2"}
    assert [r[0] for r in index.rename(e, "d2", "x", "y/z").where("entry_id = 3").select("path").collect()] == ["y/z/b.md"]
    assert index.remove(e, "d2", spark.createDataFrame([("a.md",)], "path string")).count() == 2
    assert rows(index.dirty_packs(e, index.rename(e, "d2", "x", "y"), "d2").select("kind", "pack_number")) == [("text", 4)]
    new = e.where("entry_id = 1").withColumn("written", F.lit(77).cast("bigint"))
    assert index.insert(e, new).where("pack_device = 'd1'").first()["written"] == 77
    assert index.load_pack(e, new.limit(0), "d2", "text", 4).count() == 2
    index.save(e, str(tmp_path / "i"))
    index.save(new, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 3
    h = spark.createDataFrame([("é",), (None,)], "t string").select(index.text_hash("t")).collect()
    assert h[1][0] is None and isinstance(h[0][0], int)
    assert spark.range(3).select(index.pack_number(F.col("id") - 2)).collect()[0][0] == 30


def test_index_entries_and_cache(spark, canon, tmp_path):
    d = spark.createDataFrame([("a.md", "text", 9, 1, "see John 3:16 é"), ("b.md", "text", 9, 1, "none"), ("c.epub", "epub", 9, 1, "Jude 5, Rom 8")], "path string, kind string, size bigint, mtime bigint, text string")
    entries, refs, details = index.build_entries(d, canon, "d1", "0.1")
    got = {r["path"]: (r["n_refs"], r["hash"] is None, 0 <= r["pack_number"] < 32) for r in entries.collect()}
    assert got == {"a.md": (1, False, True), "b.md": (0, False, True), "c.epub": (2, True, True)} and refs.count() == 3
    assert {r["path"]: r["snippet"] for r in details.where("ref_no = 1").collect()} == {"a.md": "see John 3:16 é", "c.epub": "Jude 5, Rom 8"}
    cache = str(tmp_path / "cache")
    first, hits = index.cached_refs(d, canon, cache)
    assert first.count() == 3 and hits.count() == 0
    changed = d.where("path <> 'b.md'").withColumn("mtime", F.when(F.col("path") == "a.md", 2).otherwise(F.col("mtime"))).withColumn("text", F.when(F.col("path") == "a.md", "Jude 6").otherwise("not searched again"))
    second, hits = index.cached_refs(changed, canon, cache)
    assert sorted((r["path"], r["written"]) for r in second.collect()) == [("a.md", "Jude 6"), ("c.epub", "Jude 5"), ("c.epub", "Rom 8")] and [r[0] for r in hits.collect()] == ["c.epub"]
    index.prune_cache(changed, canon, cache)
    assert spark.read.parquet(f"{cache}/fingerprint={index.fingerprint(canon)}/stamps").count() == 2
    assert index.fingerprint(canon) != index.fingerprint(canon.removed({"books": [{"book": "Jude"}]}))


def test_units():
    from lectern.functions import units

    g = grammar
    assert units.parse_unit(g.VERSE, "3:16") == (0, 3, 16, 3, 16) and units.parse_unit(g.ACROSS, "3:16-4:2") == (2, 3, 16, 4, 2) and units.parse_unit(g.CHAPTERS_TO_VERSE, "1-2:3") == (5, 1, 1, 2, 3)
    for kind, text in ((g.VERSE, "3"), (g.VERSE, "3:999"), (g.VERSES, "3:18-16"), (g.CHAPTER, "x"), (g.CHAPTERS, "4-3")):
        with pytest.raises(units.UnitError):
            units.parse_unit(kind, text)
    assert units.parse_segment("3:16-18") == (1, 3, 16, 3, 18)
    for text in ("3:16, 18", "3:", "", "3 x"):
        with pytest.raises(units.UnitError):
            units.parse_segment(text)
    assert units.coerce((0, 3, 16, 3, 16), g.VERSES) == (1, 3, 16, 3, 16) and units.coerce((5, 1, 1, 2, 3), g.ACROSS) == (2, 1, 1, 2, 3) and units.to_json((1, 3, 16, 3, 18)) == {"start": "3:16", "end": "3:18"}
    with pytest.raises(units.UnitError):
        units.coerce((3, 3, 1, 3, None), g.VERSE)


def test_incremental_steps_survive_failures(spark, tmp_path):
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "ok"), (4, "ok")], "run_no int, status string")
    cols = "list_id bigint, run_no int, device string, path string, size bigint, mtime bigint, hash bigint, modified_ns bigint, seen_at timestamp"
    from datetime import datetime

    def at(n):
        return datetime(2025, 1, 1, 0, n)

    listing = spark.createDataFrame(
        [
            (1, 1, "d", "a", 10, 1, 5, 1, at(1)), (2, 2, "d", "a", 11, 2, 6, 2, at(2)), (3, 3, "d", "a", 11, 2, 6, 2, at(3)), (4, 3, "d", "b", 1, 1, None, None, at(3)), (5, 3, "d", "b", 1, 1, None, None, at(3)),
            (6, 4, "d", "b", 1, 1, None, 7, at(4)), (7, 4, "d", "a", 11, 9, 6, None, at(4)), (8, 2, "d", "c", 4, 4, None, 4, at(2)), (9, 3, "d", "c", 4, 4, None, 4, at(3)), (10, 4, "d", "c", 4, 5, None, 4, at(4)),
            (11, 3, "d", "c", 9, 9, None, 9, at(1)), (12, 4, None, "x", 1, 1, 1, 1, at(4)),
        ],
        cols,
    )
    headers = spark.createDataFrame([(2, "d", "a", 11, 2), (2, "d", "c", 5, 4)], "run_no int, device string, path string, size bigint, modified_ns bigint")
    whole = incremental.CommitStore(spark, str(tmp_path / "whole"))
    incremental.advance(whole, listing, runs, headers)
    want = [(3, "d", "b"), (3, "d", "c"), (4, "d", "c")]
    assert rows(whole.read().where("NOT first").select("run_no", "device", "path")) == want
    steps = incremental.CommitStore(spark, str(tmp_path / "steps"))

    def die():
        raise RuntimeError("killed")

    for upto in (1, 2, 3, 4):
        with pytest.raises(RuntimeError):
            incremental.advance(steps, listing, runs, headers, upto, before_publish=die)
        before = len(steps.commits())
        assert incremental.advance(steps, listing, runs, headers, upto).high == upto
        assert len(steps.commits()) == before + 1
        assert incremental.advance(steps, listing, runs, headers, upto) is None
    assert rows(steps.read().where("NOT first").select("run_no", "device", "path")) == want
    with pytest.raises(RuntimeError):
        steps.publish(steps.commits()[-1])
    # Nothing is left of the attempts that died, nor of replaced buckets and working tables.
    last = steps.last()
    left = {p.parent.name + "/" + p.name for p in (tmp_path / "steps" / "data").glob("*/*")}
    assert {x.partition("/")[2] for x in left} <= {"output", "state"} and sum(x.endswith("/output") for x in left) == 4
    assert {str(p) for p in (tmp_path / "steps" / "data").glob("*/state/bucket=*")} == set(last.state.values())
    assert rows(steps.state().groupBy("device", "path").count()) == [("d", "a", 1), ("d", "b", 1), ("d", "c", 1)]
    # Rows for runs that are committed are refused; a run that goes on holds back those behind it.
    late = listing.unionByName(spark.createDataFrame([(13, 3, "d", "late", 1, 1, 1, 1, at(9)), (14, 5, "d", "a", 1, 1, 1, 1, at(9)), (15, 6, "d", "a", 2, 1, 1, 1, at(9)), (16, 7, "d", "b", 2, 1, 1, 1, at(9))], cols))
    more = runs.unionByName(spark.createDataFrame([(5, "ok"), (6, None), (7, "ok")], "run_no int, status string"))
    with pytest.raises(incremental.LateRows):
        incremental.advance(steps, late, more, headers)
    assert incremental.advance(steps, late.where("list_id <> 13"), more, headers).high == 5
    assert incremental.advance(steps, late.where("list_id <> 13"), more, headers) is None
    assert rows(steps.read().where("run_no > 4").select("run_no", "device", "path")) == [(5, "d", "a")]
    empty = incremental.CommitStore(spark, str(tmp_path / "empty"))
    assert incremental.advance(empty, listing, runs.limit(0), headers) is None and empty.read() is None


def test_streaming_equals_batch(spark, canon, tmp_path):
    from datetime import datetime

    data = [(k, datetime(2025, 1, 1, k % 5, 10 * (k % 6)), f"see John {1 + k % 20}:1 and Jude 5") for k in range(60)]
    df = spark.createDataFrame(data, "id int, ts timestamp, text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.read_documents(spark, str(tmp_path / "in"), df.schema, 1)
    q = streaming.windowed_counts(stream, canon, "ts", "1 hour", late="10 hours").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("counts")) == rows(streaming.windowed_counts(df, canon, "ts", "1 hour"))
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    streaming.upsert_index(stream.select("id", "text"), canon, str(tmp_path / "idx"), str(tmp_path / "c2"), ["id"]).awaitTermination(120)
    changed = spark.createDataFrame([(3, datetime(2025, 1, 2), "only Jude 7")], df.schema)
    changed.write.mode("append").parquet(str(tmp_path / "in"))
    streaming.upsert_index(stream.select("id", "text"), canon, str(tmp_path / "idx"), str(tmp_path / "c2"), ["id"]).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "idx"))
    assert got.where("ref_no > 0").count() == 119 and got.where("id = 3").count() == 1
    gone = spark.createDataFrame([(k, datetime(2025, 1, 3), "nothing") for k in range(60)], df.schema)
    gone.write.mode("append").parquet(str(tmp_path / "in"))
    streaming.upsert_index(stream.select("id", "text"), canon, str(tmp_path / "idx"), str(tmp_path / "c2"), ["id"]).awaitTermination(120)
    spark.catalog.refreshByPath(str(tmp_path / "idx"))
    again = spark.read.parquet(str(tmp_path / "idx"))
    assert again.count() == 60 and again.where("ref_no > 0").count() == 0


def test_sql_functions(spark, canon):
    from lectern.functions import sql

    sql.register(spark, canon)
    r = spark.sql("SELECT format_ref(parse_ref('jn 3:16')) a, to_osis(parse_usfm('JHN 3:16-18')) b, to_usfm(parse_osis('John.3')) c, parse_ref('none').book_id d, format_ref(read_ref('Jude')) e").first()
    assert tuple(r) == ("John 3:16", "John.3.16-John.3.18", "JHN 3", None, "Jude")
    q = "SELECT refs_overlap(a, b) o, refs_contain(a, b) c, merge_refs(concat(a, b)) m, verse_pos(3, 4, array(10, 20)) p, bcv(43, 3, NULL) k FROM VALUES (array(named_struct('s', 1, 'e', 5)), array(named_struct('s', 6, 'e', 9))) t(a, b)"
    r = spark.sql(q).first()
    assert (r["o"], r["c"], [tuple(x) for x in r["m"]], r["p"], r["k"]) == (False, False, [(1, 9)], 34, 43003999)
    assert spark.sql("SELECT written FROM VALUES ('see Jn 4:1, Jude 5') t(x), LATERAL extract_refs(x)").count() == 2


def test_contract_queries_match_sql(spark):
    """Every core query with SQL, over the smallest tables."""
    import os

    import duckdb

    from lectern.plans import registry

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    queries, sql = registry.queries(), registry.oracle_sql()
    assert set(sql) <= set(queries)
    for name, text in sql.items():
        df = queries[name](spark, str(DATA))
        cur = con.execute(text)
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns), name
        want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in cur.fetchall())
        got = sorted(repr(tuple(r[c] for c in sorted(names))) for r in df.collect())
        assert got == want, name


def test_overlap_join_over_all_keys(spark):
    """Against brute force over every segment, no key left out."""
    from collections import Counter

    from lectern.plans import registry

    q = registry.queries()
    seg = q["positions"](spark, str(DATA)).selectExpr("k", "pos_start s", "pos_end e", "bcv_start DIV 1000000 b").collect()
    want, ks = Counter(), Counter()
    for x in seg:
        n = sum(x["b"] == y["b"] and x["s"] <= y["e"] and y["s"] <= x["e"] for y in seg)
        want[x["b"]] += n
        ks[x["b"]] += n * x["k"]
    assert {r["book_id"]: (r["pairs"], r["ks"]) for r in q["overlap_join"](spark, str(DATA)).collect()} == {b: (n, ks[b]) for b, n in want.items()}


def test_queries_of_one_style_run_over_every_key(spark):
    from lectern.plans import registry

    q = registry.queries()
    for name, source in (("html_refs", "events"), ("broken_documents", "events"), ("problems", "orders"), ("books_alone", "orders")):
        assert q[name](spark, str(DATA)).select("k").distinct().count() == spark.read.parquet(f"{DATA}/{source}.parquet").count(), name


def test_nothing_outside_imports_the_training_data_package():
    for p in (ROOT / "lectern").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import[^\n]*\bllm\b|from[^\n]*\bllm\b", p.read_text()), p
