"""The training-data operators: against brute force, round trips, the standard library and small cases."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import bpe, canonical, garbled, leakage, lookalike, pii, queries, survivor

from ..conftest import DATA


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- 1: canonical list ----------------------------------------------------------------------------

_WORDS = st.text("abcde", max_size=7)


@settings(max_examples=300, deadline=None)
@given(_WORDS, _WORDS, _WORDS)
def test_distance_is_a_metric(a, b, c):
    d = canonical.letters_distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


def test_distance_counts_swaps():
    assert canonical.letters_distance("genesis", "geensis") == 1 and canonical.letters_distance("ca", "abc") == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(_WORDS.filter(bool), min_size=1, max_size=40), _WORDS, st.integers(0, 3))
def test_tree_returns_every_entry_within(words, typed, radius):
    keys = [("", w) for w in words]
    got = canonical.BKTree(keys).within(("", typed), radius)
    want = sorted({(canonical.key_distance(("", typed), k), k) for k in keys if canonical.key_distance(("", typed), k) <= radius})
    assert got == want


@pytest.mark.parametrize(
    ("typed", "key"),
    [
        ("The Book of 1 Samuel", ("1", "samuel")), ("II  Kings,", ("2", "kings")), ("2Samue", ("2", "samue")), ("Samuel 2", ("2", "samuel")), ("2_chronicles", ("2", "chronicles")), ("First Kings.", ("1", "kings")), ("Ｇｅｎ​ｅｓｉｓ", ("", "genesis")),
        ("Genèse (all)", ("", "genese")), ("Jonah – notes", ("", "jonah")), ("“Psalm”", ("", "psalm")), ("paul's letters", ("", "paulsletters")), ("?!", ("", "")), ("1", ("", "1")), ("2nd Timothy", ("2", "timothy")),
    ],
)
def test_keys(typed, key):
    assert canonical.key_of(typed) == key


def _reference(spark):
    return spark.createDataFrame([("Genesis", "Genesis", 0), ("1 Samuel", "1 Samuel", 0), ("2 Samuel", "2 Samuel", 0), ("Jude", "Jude", 0), ("Judges", "Judges", 0), ("Judg", "Judges", 1), ("Numeri", "Numbers", 4)], "spelling string, target string, rank int")


@pytest.mark.parametrize("limit", [100, 2])
def test_match_values(spark, limit):
    typed = ["gensis", "1 Samuell", "Samuel 2", "judg", "judgx", "Jdue", None, "", "  ", "qqq", "x" * 5000, "numeeri", "gensis", "Genesis"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(typed)], "id int, v string, rank string")
    got = dict((r["id"], r["target"]) for r in canonical.match_values(df, "v", _reference(spark), max_broadcast=limit, shard=2, block=3).collect())
    want = ["Genesis", "1 Samuel", "2 Samuel", "Judges", "", "Jude", None, None, None, "", "", "Numbers", "Genesis", "Genesis"]
    assert [got[i] for i in range(len(typed))] == want
    assert canonical.match_values(df.limit(0), "v", _reference(spark), max_broadcast=limit).count() == 0
    assert {r["target"] for r in canonical.match_values(df, "v", _reference(spark).limit(0)).collect()} == {None, ""}


def test_sharded_lists_give_the_same(spark):
    scopes, books, genres = (spark.read.parquet(str(DATA / f"{t}.parquet")) for t in ("book_scopes", "default_books", "default_genres"))
    assert rows(canonical.canonical_found(scopes, books, genres, max_broadcast=50)) == rows(canonical.canonical_found(scopes, books, genres))


def test_a_list_of_300000_spellings(spark):
    """Against every spelling that shares a letters-less-one form; no task holds more than a shard and a block."""
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(5, 7))) for _ in range(301_000)})[:300_000]
    typed = [w[:3] + rnd.choice("xyzq") + w[4:] for w in rnd.sample(words, 12)] + [w[:2] + w[3] + w[2] + w[4:] for w in rnd.sample(words, 6)] + ["zz"]
    less = lambda w: {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}
    asked = {x for t in typed for x in less(t)}
    near = [w for w in words if asked & less(w)]
    want = sorted((t, d, 0, w) for t in set(typed) for w in near if (d := canonical.letters_distance(t, w)) <= canonical.threshold(("", t)))
    reference = spark.createDataFrame([(w,) for w in words], "spelling string").select("spelling", F.col("spelling").alias("target"), F.lit(0).alias("rank"))
    got = canonical.sharded_candidates(spark.createDataFrame([(t,) for t in set(typed)], "_value string"), reference)
    assert rows(got) == want and len(want) >= 12
    part = F.pmod(F.xxhash64("spelling"), F.lit(15))
    assert reference.groupBy(part).count().agg(F.max("count")).first()[0] < 1.05 * canonical.SHARD_SPELLINGS


def test_ties_name_nothing():
    assert canonical.decide([(1, 0, "A"), (1, 0, "B")]) == "" and canonical.decide([(1, 0, "A"), (2, 0, "B")]) == "A" and canonical.decide([]) == ""


def test_canonical_on_the_tables(spark):
    got = queries.p1_found(spark, str(DATA))
    a = {(r["row_id"], r["pos"]): r["target"] for r in got.where("field = 'abbreviations'").collect()}
    assert a[(1, 1)] == "" and a[(2, 1)] == "Deuteronomy" and len(a) == 21
    assert got.groupBy("field", "row_id", "pos").count().where("count > 1").count() == 0


# --- 3: wrong encodings ---------------------------------------------------------------------------

CLEAN = [
    "Le été brisé de Job achève les fêtes déjà lues, où là.", "Für Sandholm heißt das: die Städte gehören über den Töpfer hinaus.", "Así abrió Baresomi las raíces, ¿por qué?", "O pão não é simpático; São 14 bênçãos.", "It was déjà vu: 5° colder – see §7 “again”.",
    "Ο κρυφός λόγος στο Ezra", "A Russian gloss gives хлеб и слово.", "SÃO and NÃO are capitals here. Âge and Ânimo.", "Ørsk, Łomza, Dvořec: three towns.", "The Hebrew שלום stands.", "¹⁶ ✓ read † ¶ 12 € m³ …",
]


@pytest.fixture(scope="module")
def repairer():
    text = "\n".join(CLEAN * 200)
    table = np.bincount(garbled._buckets(text), minlength=garbled.BUCKETS).astype(float)
    return garbled.Repairer(garbled.surprise_of(table))


def _wrong(text: str, codec: str, layers: int = 1) -> str:
    for _ in range(layers):
        text = "".join(bytes([b]).decode(codec, "replace") if bytes([b]).decode(codec, "ignore") else chr(b) for b in text.encode("utf-8"))
    return text


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=20))
def test_costs_agree(repairer, text):
    """Pair by pair and over arrays."""
    padded = f"\n{text}\n"
    own = [garbled._bucket(a, b) for a, b in zip(padded, padded[1:], strict=False) if a > "\x7f" or b > "\x7f"]
    assert own == garbled._buckets(text).tolist()


def test_clean_text_stays(repairer):
    for t in [*CLEAN, "", "plain", "a" * 100000, "é" * 20000]:
        assert repairer.repair(t) == (False, t, 0)


# Correct text that the corpus does not have.
OTHERS = [
    "Українська мова, її слова і речення.", "Zażółć gęślą jaźń, mój świat", "Příliš žluťoučký kůň úpěl", "Árvíztűrő tükörfúrógép", "日本語の文章です。", "العربية لغة", "Çok güzel şeyler, İstanbul ığdır", "đường phố Việt Nam ở đây",
    "Ἐν ἀρχῇ ἦν ὁ λόγος", "Größe Maß Fuß", "“Why?” «oui» naïve œuvre cœur", "½ cup, ¾ inch, ±5 µm × 3, 20 ¢, ¥300, ®, ©", "Þórður ætlaði að öðlast", "ÚLTIMO AÑO, ÀÉÎ; AQUÍ”", "x² + y³ ≤ z, 5 ≠ 6", "— “¿Qué?” —",
]


@pytest.mark.parametrize("text", OTHERS)
def test_other_languages_stay(repairer, text):
    assert repairer.repair(text) == (False, text, 0)


@pytest.mark.parametrize("text", OTHERS[:9])
def test_other_languages_are_restored(repairer, text):
    assert repairer.repair(_wrong(text, "cp1252"))[:2] == (True, text)


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1253"])
@pytest.mark.parametrize("text", CLEAN[:7])
def test_round_trips_of_utf8(repairer, codec, text):
    got = repairer.repair(_wrong(text, codec))
    assert got[:2] == (True, text)


@pytest.mark.parametrize("text", CLEAN[:5])
def test_nested_and_partial(repairer, text):
    assert repairer.repair(_wrong(text, "cp1252", 2))[:2] == (True, text)
    assert repairer.repair(text + " " + _wrong(text, "cp1252"))[:2] == (True, text + " " + text)


@pytest.mark.parametrize(("meant", "read"), [("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman")])
@pytest.mark.parametrize("text", CLEAN[:3])
def test_single_byte_confusion(repairer, meant, read, text):
    wrong = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in text.encode(meant, "ignore"))
    text = text.encode(meant, "ignore").decode(meant)
    assert repairer.repair(wrong)[:2] == (True, text)


def test_lost_characters_are_reported(repairer):
    assert repairer.repair("Le pr�f�r�")[0] and not repairer.repair("Leνit and Вaresodan and in Kingѕ")[0]


def test_costs_do_not_depend_on_the_size():
    one = np.bincount(garbled._buckets("\n".join(CLEAN)), minlength=garbled.BUCKETS).astype(float)
    assert np.allclose(garbled.surprise_of(one), garbled.surprise_of(one * 1000))
    assert np.isfinite(garbled.surprise_of(one * 0)).all()


def test_garbled_frames(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*CLEAN * 20, None, "", _wrong(CLEAN[0], "cp1252")])], "id int, text string")
    got = garbled.garbled_records([("t", df, "id", "text")])
    bad = got.where("repair.garbled").collect()
    assert [r["row_id"] for r in bad] == [len(CLEAN) * 20 + 2] and bad[0]["repair"]["restored"] == CLEAN[0]
    assert got.count() == df.count() and got.where("text IS NULL AND repair.restored IS NULL").count() == 1
    assert garbled.garbled_records([("t", df.limit(0), "id", "text")]).count() == 0


@pytest.mark.parametrize("codec", ["mac_roman", "cp850"])
def test_frequent_garbling_is_found(spark, codec):
    """A third of all rows garbled by one reading, and copies of them, do not become correct."""
    wrong = [t.encode("cp1252").decode(codec) for t in CLEAN[:2] + CLEAN[3:4]]
    texts = CLEAN * 20 + wrong * 37
    got = garbled.garbled_records([("t", spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text")])
    found = {r["row_id"]: r["repair"]["restored"] for r in got.where("repair.garbled").collect()}
    assert found == {i: CLEAN[(0, 1, 3)[(i - len(CLEAN) * 20) % 3]] for i in range(len(CLEAN) * 20, len(texts))}


@pytest.mark.parametrize(("text", "read", "meant"), [("a board of 3×4 ells", "mac_roman", "cp1252"), ("about 10\u00a0000 men", "cp437", "cp1252"), ("about 10\u00a0000 men", "cp850", "cp1252")])
def test_signs_and_spaces_are_restored(text, read, meant):
    """Lines whose only odd character meant a sign or a no-break space."""
    table = np.bincount(garbled._buckets("\n".join([*CLEAN * 200, *[text] * 100])), minlength=garbled.BUCKETS).astype(float)
    r = garbled.Repairer(garbled.surprise_of(table))
    assert r.repair(text.encode(meant).decode(read)) == (True, text, 1) and r.repair(text) == (False, text, 0)


@pytest.mark.parametrize("text", ["LuÃs went home", "the cafÃ? is open", "donâ€?t", "he said â€", "an Ã?tre", "donâ?t go", "donâ??t go", "Lu├s went", "caf√? then", "LuΓs went", "LuГs went", "the â€\nnext"])
def test_lost_trail_bytes_are_reported(repairer, text):
    assert repairer.repair(text)[0]


@pytest.mark.parametrize("text", ["AMANHÃ? NÃO", "Olá? Âge? São?", "√2 and x = √y", "пять? âge", "Ñandú, Ångström, Äpfel", "10 Γ and Δ", "What â?"])
def test_leads_in_correct_text_stay(repairer, text):
    assert repairer.repair(text) == (False, text, 0)


# --- 4: look-alikes -------------------------------------------------------------------------------


def normal(*texts):
    out, changed = lookalike.normalise_arrow(pa.array(list(texts), pa.string()))
    return out.to_pylist(), changed.tolist()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ｇｅｎ ２４：１", "Gen 24:1"), ("cafe\u0301", "caf\u00e9"), ("a​b­c﻿", "abc"), ("a b c　d", "a b c d"), ("Lеviticus", "Leviticus"), ("Γiατί φέpνει", "Γιατί φέρνει"), ("ﬁt eﬀort ﬆ", "fit effort st"), ("Lower‐Brae", "Lower-Brae"),
        ("x\u037ey \u212a \u1f71", "x;y K \u03ac"), ("uոfinisհed", "unfinished"), ("ậ", "ậ"), ("слoво", "слово"),
    ],
)
def test_forms(text, want):
    assert normal(text) == ([want], [True]) and normal(want) == ([want], [False])


def test_ordinary_text_stays():
    texts = [*CLEAN, "👨‍👩‍👧 🙏🏽", "x² 10³ – — “q” …", "нет", "λόγος", "\x00a", "", None, "ascii only"]
    assert normal(*texts) == (texts, [False] * len(texts))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aAeuo\u00c5\u00e2\u00ea\u1ea1\u0301\u0323\u0300\u0302\u0308\u0327\u0345\u00b8 c\n", max_size=10), max_size=5))
def test_composition_is_the_standards(texts):
    got, _ = normal(*texts)
    assert got == [unicodedata.normalize("NFC", t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12)), max_size=6))
def test_idempotent_and_slices(texts):
    got, _ = normal(*texts)
    assert normal(*got)[0] == got
    sliced, _ = lookalike.normalise_arrow(pa.array(["x", *texts], pa.string()).slice(1))
    assert sliced.to_pylist() == got


def test_normalise_column(spark):
    df = spark.createDataFrame([(1, "Ｇｅｎ"), (2, None), (3, "plain"), (4, "")], "id int, text string")
    assert rows(lookalike.normalise_column(df, "text").select("id", "normal.text", "normal.changed")) == [(1, "Gen", True), (2, None, False), (3, "plain", False), (4, "", False)]


def test_look_alikes_keep_every_code_point():
    texts = ["\U0010ffff é\x00x", "\x00\u200b", "a" + "\u0301\u0300" * 3000]
    got, changed = lookalike.normalise_arrow(pa.array(texts))
    assert got.to_pylist() == ["\U0010ffff é\x00x", "\x00", unicodedata.normalize("NFC", texts[2])] and changed.tolist() == [False, True, True]


def test_further_look_alikes(tmp_path):
    path = tmp_path / "confusables.txt"
    path.write_text("\ufeff# a comment\n13A0 ;\t0044 ;\tMA\t# look\n2160 ; 0049 ; MA\n0430 ;0061; MA\n00E6 ; 0061 0065 ; MA\n0030 ; 004F ; MA\n", encoding="utf-8")
    more = lookalike.read_confusables(str(path))
    assert more == (("\u13a0", "D"), ("\u0430", "a"))
    got, changed = lookalike.normalise_arrow(pa.array(["\u13a0aniel", "\u13a0\u13a1", "plain é"]), more)
    assert got.to_pylist() == ["Daniel", "\u13a0\u13a1", "plain é"] and changed.tolist() == [True, False, False]


def test_the_screen_clears_only_what_the_repair_leaves(spark):
    import pyarrow.parquet as pq

    texts = [t for f, c in (("file_hits", "text"), ("epub_places", "line_text"), ("pdf_places", "line_text")) for t in pq.read_table(DATA / f"{f}.parquet", columns=[c]).column(0).to_pylist()]
    texts += ["", "a\n\né", "é", "È?", "Ωstä\nÃ©", "10á000", "\U0010ffff\x85", "naïve “x” — ½ cup", "Ш", "é\n \nÎ\n", *[t.encode("utf-8").decode(c, "replace") for t in CLEAN for c in ("cp1252", "cp437", "cp1253")]]
    own = sum((np.bincount(garbled._buckets(garbled.without_anomalies(t)), minlength=garbled.BUCKETS) for t in texts if t), np.zeros(garbled.BUCKETS, dtype=np.int64))
    assert (garbled.Screen(np.zeros(garbled.BUCKETS)).counts(pa.array(texts)) == own).all()
    surprise = garbled.surprise_of(own)
    screen, repairer = garbled.Screen(surprise), garbled.Repairer(surprise)
    found = screen.suspects(pa.array([None, *texts])[1:])
    for text, suspect in zip(texts, found, strict=True):
        if text is None or not suspect:
            assert text is None or repairer.repair(text) == (False, text, 0)
    assert 0.02 < found.mean() < 0.5
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: (r.repair.garbled, r.repair.restored, r.repair.layers) for r in garbled.repair_texts(frame, "text", surprise).collect()}
    assert got == {i: (False, None, 0) if t is None else repairer.repair(t) for i, t in enumerate(texts)}


# --- 5: survivors ---------------------------------------------------------------------------------

_E = "entry_id bigint, pack_device string, kind string, path string, size bigint, mtime bigint, written bigint, engine string, hash bigint, chapters array<string>, n_refs int, detail string"
_C = "pack_device string, path string, device string, written bigint"


def test_survivors(spark):
    e = spark.createDataFrame(
        [
            (5, "a", "t", "Dir/Fé.md", 10, 1, 100, "x", None, ["c"], None, ""), (3, "b", "t", "./dir//FÉ.MD", 10, 1, 300, "x", 7, [], 4, None), (9, "c", "t", "dir\\Fé.md", 11, 1, 900, "x", 8, ["d"], 5, "z"),
            (1, "d", "t", "alone.md", 1, 1, 1, "x", 1, None, 1, "q"), (2, "e", "t", None, 1, 1, 1, "x", 1, None, 1, "q"), (7, "a", "t", "Dir/Fé.md", 10, 1, None, "x", 9, None, 1, "late"),
        ],
        _E,
    )
    c = spark.createDataFrame([("x", "DIR/fé.md", "a", 100), ("y", "dir/./Fé.md", "a", 100), ("y", "dir/Fé.md", "a", 100), ("a", "dir/fé.md", "a", 100), ("z", "dir/fé.md", "c", 900), ("x", None, "b", 300)], _C)
    # Entry 5 has two confirmers, 9 one; fields come from size 10, in the order 5, 3, 7.
    assert rows(survivor.survivors(e, c)) == [(3, "chapters", 5), (3, "detail", 7), (3, "hash", 3), (3, "n_refs", 3), (3, "record", 5)]
    r = survivor.survivor_records(e, c).collect()
    assert len(r) == 1 and (r[0]["entry_id"], r[0]["hash"], r[0]["n_refs"], r[0]["detail"]) == (5, 7, 4, "late")
    assert survivor.survivors(e.limit(0), c).count() == 0 and survivor.survivors(e.withColumn("key", F.lit(1)), c.limit(0)).where("field = 'record'").first()[2] == 9


def test_hot_group_of_copies(spark):
    """A third of all rows in one group: windows keep one row before they shuffle."""
    e = spark.range(3000).selectExpr(
        "id AS entry_id", "concat('d', id % 50) AS pack_device", "'t' AS kind", "CASE WHEN id % 3 = 0 THEN 'hot.md' ELSE concat(id div 2, '.md') END AS path", "10L AS size", "1L AS mtime", "id * 7 % 1000 AS written", "'x' AS engine",
        "CASE WHEN id % 5 = 0 THEN id END AS hash", "array('c') AS chapters", "1 AS n_refs", "CAST(NULL AS STRING) AS detail",
    )
    c = spark.createDataFrame([], _C)
    df = survivor.survivors(e, c)
    hot = {r["field"]: r["entry_id"] for r in df.where("group_id = 0").collect()}
    best = max((i * 7 % 1000, -i) for i in range(0, 3000, 3))
    assert hot["record"] == -best[1] and "detail" not in hot
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()


# --- 6: tokens ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoders():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(f"{bpe.VOCABULARIES}/byte_bpe_50k.tiktoken")
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(max_size=40), max_size=5))
def test_ids_are_the_librarys(encoders, texts):
    ours, theirs = encoders
    flat, offsets = ours.encode_batch(texts)
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [theirs.encode_ordinary(t) for t in texts]


def test_ids_of_hard_words(encoders):
    ours, theirs = encoders
    for t in ["aaab" * 3000, "<|endoftext|> don't", "   \n\n  x", "漢字仮名" * 50, "é" * 999]:
        flat, _ = ours.encode_batch([t])
        assert flat.tolist() == theirs.encode_ordinary(t)
    small = bpe.Encoder(ours.replay.ranks, kept=2)
    for t in ("one two three", "four one", "two two"):
        assert small.encode_batch([t])[0].tolist() == theirs.encode_ordinary(t)


def test_encode_column(spark, encoders):
    df = spark.createDataFrame([(1, "Hello, world"), (2, None), (3, ""), (4, "Hello, world")], "id int, text string")
    got = dict(rows(bpe.encode_column(df, "text").select("id", F.concat_ws(",", F.col("ids").cast("array<string>")))))
    assert got == {1: "15496,11,995", 2: "", 3: "", 4: "15496,11,995"}
    assert bpe.encode_column(df, "text").where("ids IS NULL").count() == 0 and bpe.encode_column(df.limit(0), "text").count() == 0


@pytest.mark.parametrize("frequent", [200_000, 4, 0])
def test_the_corpus_at_once(spark, encoders, frequent):
    """Words in the broadcast table, beyond it, or none in it: the library's ids."""
    texts = ["In the beginning was the word", None, "", " ", "x" * 1000 + " the the", "λόγος 12,5 <|endoftext|>\n\n the", "In the beginning was the word", "naïve\u0301 🜁"] * 3
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id int, text string, n int")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df, "text", frequent=frequent).collect()}
    assert got == {i: encoders[1].encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert bpe.encode_corpus(df.limit(0), "text", frequent=frequent).count() == 0
    counts = dict(bpe.count_words(df, "text").collect())
    assert counts[" the"] == 3 * (2 + 2 + 2 + 1) and counts["x" * 1000] == 3


# --- 7: leakage -----------------------------------------------------------------------------------

_ITEM = "The lonely {0} carried nine silver lanterns across the frozen marsh while every clerk of Orvenhall counted seven broken wheels beside the granary door until {0} came at last"


def _items(n=6):
    return [(i, "Answer in one word. " + _ITEM.format(f"quorl{i}") + f" and quorl{i} wept. Then quorl{i} slept.") for i in range(n)]


def _brute(doc, item):
    """Most consecutive words of the item that a full table of alignments covers, edits six words apart."""
    best = 0
    # state[i][j]: (matches since the last edit, up to five; 9 where there was none) to the first item word of the run.
    state = [[{} for _ in range(len(doc) + 1)] for _ in range(len(item) + 1)]

    def put(i, j, key, first):
        if first < state[i][j].get(key, 1 << 30):
            state[i][j][key] = first

    for i in range(len(item) + 1):
        for j in range(len(doc) + 1):
            for key, first in state[i][j].items():
                if i < len(item) and j < len(doc) and item[i] == doc[j]:
                    put(i + 1, j + 1, key if key == 9 else min(5, key + 1), first)
                if key >= 5:
                    for a, b in ((1, 1), (0, 1), (1, 0)):
                        if i + a <= len(item) and j + b <= len(doc):
                            put(i + a, j + b, 0, first)
            if i < len(item) and j < len(doc) and item[i] == doc[j]:
                put(i + 1, j + 1, 9, i)
            if i and j and item[i - 1] == doc[j - 1]:
                best = max([best, *(i - first for key, first in state[i][j].items() if key)])
    return best


def test_alignments_against_a_full_table():
    rnd = random.Random(5)
    seen, pairs = set(), []
    for _ in range(400):
        item = [rnd.randrange(1, 60) for _ in range(rnd.randint(15, 26))]
        a = rnd.randrange(4)
        doc = item[a : a + rnd.randint(10, 24)]
        k = rnd.randint(1, 8)
        while k < len(doc):
            kind = rnd.randrange(4)
            doc[k : k + 1] = {0: [99], 1: [doc[k], 98], 2: [], 3: [97, 96]}[kind if kind < 3 or rnd.random() < 0.3 else 0]
            k += rnd.randint(4, 9)
        doc = [0] * rnd.randrange(4) + doc + [0] * rnd.randrange(4)
        d, w = np.array(doc, dtype=np.uint64), np.array(item, dtype=np.uint64)
        got = max((x[0] for x in leakage.alignments(d, w, range(-len(w), len(d)))), default=0)
        want = _brute(doc, item)
        assert (got >= leakage.RUN) == (want >= leakage.RUN), (doc, item, got, want)
        # The screen over many pairs drops none that reaches it.
        seeds = [j - i for i in range(len(w) - 4) for j in range(len(d) - 4) if (w[i : i + 5] == d[j : j + 5]).all()]
        pairs.append((d, w, seeds, got))
        seen.add(want >= leakage.RUN)
    assert seen == {True, False}
    docs, items = [np.concatenate([p[k] for p in pairs]) for k in (0, 1)]
    doc_at, item_at = [np.cumsum([0, *(p[k].size for p in pairs)]) for k in (0, 1)]
    row = np.repeat(np.arange(len(pairs)), [len(p[2]) for p in pairs])
    worth = leakage.worth_aligning(docs, doc_at, items, item_at, row, np.array([x for p in pairs for x in p[2]], dtype=np.int64))
    assert all(w or p[3] < leakage.RUN for w, p in zip(worth, pairs, strict=True)) and not worth.all()


@pytest.mark.parametrize(
    ("same", "run"),
    [("1" * 15, 15), ("1" * 14, 14), ("11111011111", 11), ("111101111011111", 10), ("1111101111101111", 16), ("111110011111", 5), ("1" * 7 + "0" + "1" * 7, 15), ("1111111" + "0" + "1111" + "0" + "111111", 12)],
)
def test_runs_on_one_diagonal(same, run):
    item = np.arange(1, len(same) + 1, dtype=np.uint64)
    doc = np.where([c == "1" for c in same], item, np.uint64(10**6)).astype(np.uint64)
    assert max(x[0] for x in leakage.alignments(doc, item, [0])) == run


def test_pattern_keys_name_every_allowed_change():
    item = np.arange(1, 16, dtype=np.uint64)
    own = set(leakage.pattern_keys(item, np.array([0]))[0].tolist())
    for changed in ((), (7,), (4, 10), (1, 13), (3, 8)):
        doc = item.copy()
        doc[list(changed)] = 77
        shared = own & set(leakage.pattern_keys(doc, np.array([0]))[0].tolist())
        assert bool(shared) == (len(changed) < 2 or changed[1] - changed[0] >= leakage.APART)


def test_codes():
    c = leakage.Coder()
    got = c.codes("They “don’t” <i>sell</i> **cou-\n> nted** [2] FULL　Ｗidth_x")
    assert got == [*c.codes("they dont sell counted"), 0, *c.codes("full width x")] and 0 not in c.codes("x2 two")
    assert c.codes(None) == c.codes("") == c.codes(" ?! ") == []


def test_leaked_pairs(spark):
    items = spark.createDataFrame([*_items(), (7, None), (8, ""), (9, "short item"), (None, _ITEM)], "item_id bigint, text string")
    text = _ITEM.format("quorl2")
    long = "noise " * 30000 + text.upper() + " noise" * 2000
    edited = text.replace("frozen", "muddy").replace("wheels", "carts")
    inserted = text.replace("frozen", "frozen 12a").replace("wheels beside", "wheels 3 beside")
    d = spark.createDataFrame(
        [(1, text.replace(" ", "\n")), (2, None), (3, ""), (4, long), (5, "Answer in one word."), (5, text), (5, text), (6, "word list: " + " ".join(sorted(text.split()))), (7, edited), (8, inserted), (9, " ".join(text.split()[4:18])), (None, text)], "doc_id bigint, text string"
    ).withColumn("item_id", F.lit("clash")).withColumn("codes", F.lit(1))
    got = rows(leakage.leaked_pairs(d, items))
    # Of the items of one template only that whose own words stand in the document counts.
    assert got == [(1, 2), (4, 2), (5, 2), (7, 2), (8, 2)]
    # All seeds common, or all rare: the same pairs.
    assert rows(leakage.leaked_pairs(d, items, rare_items=0)) == got == rows(leakage.leaked_pairs(d, items, rare_items=99))
    assert leakage.leaked_pairs(d.limit(0), items).count() == 0 and leakage.leaked_pairs(d, items.limit(0)).count() == 0


def test_no_passage_is_taken_for_a_stock_line(spark):
    passage = "Old Merrowin measured the copper gate. It was found plain by the watch. Nine carts of salt stood behind it in the rain until noon."
    items = [(k, f"{passage} {q}") for k, q in enumerate(("Who measured the gate?", "What stood in the rain?", "When did the carts leave the gate behind?"))]
    one = [(10 + k, f"Whoever slept in the mill heard the grinding of lamps until the door was shut for good. {q}") for k, q in enumerate(("Who slept?", "What was heard?", "What was shut?"))]
    stock = [(20 + k, "Read this and answer. " + _ITEM.format(f"quorl{k}") + f" near the wall{k}. Why?") for k in range(4)]
    frame = spark.createDataFrame([*items, *one, *stock], "item_id bigint, text string")
    kept = {r[0]: sum(1 for c in r[1] if c) for r in leakage.coded_items(frame).collect()}
    coder = leakage.Coder()
    assert all(kept[k] == len(coder.codes(t)) for k, t in [*items, *one]) and all(kept[k] == len(coder.codes(t)) - 4 for k, t in stock)
    named = {r[0]: len(r[1]) for r in leakage.coded_items(frame, ["Old Merrowin measured the copper gate."]).collect()}
    assert named[0] == kept[0] - 6 and named[20] == kept[20] + 4
    docs = spark.createDataFrame([(1, "note: " + passage), (2, one[0][1])], "doc_id bigint, text string")
    assert rows(leakage.leaked_pairs(docs, frame)) == [(1, 0), (1, 1), (1, 2), (2, 10), (2, 11), (2, 12)]


# --- 8: personal data -----------------------------------------------------------------------------


def spans(text):
    return [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Sent from <ivo.marl+x@mail.example.org>.", [("email", "ivo.marl+x@mail.example.org")]), ("Mail: ivo (at) example (dot) org now", [("email", "ivo (at) example (dot) org")]), ("Handle: @verse5 (no mail).", []),
        ("Call +1 202 555 0139 before Friday.", [("phone", "+1 202 555 0139")]), ("ring (202) 555-0102.", [("phone", "(202) 555-0102")]), ("Tel. +49 30 23125 990 49 Mal", [("phone", "+49 30 23125 990")]), ("Tél. 01.99.00.84.59 le soir.", [("phone", "01.99.00.84.59")]),
        ("+44 (0)7700 900 826 works", [("phone", "+44 (0)7700 900 826")]), ("ISBN 978-0-00-56722-9. Order no. 2024-76633. 1234567890 000 3.14159", []), ("build 70423704. Meeting on 12/05/2024 at 19:13.", []), ("00:00:01,000 --> 00:00:05,457", []),
        ("The form lists 999-00-2241 as the identity number.", [("id_number", "999-00-2241")]), ("DNI 99999231-S en", [("id_number", "99999231-S")]), ("ID no. qq 60 17 48 b", [("id_number", "qq 60 17 48 b")]), ("card 4111 1111 1111 1111 ok", [("id_number", "4111 1111 1111 1111")]),
        ("IBAN DE89 3704 0044 0532 0130 00 is", [("id_number", "DE89 3704 0044 0532 0130 00")]), ("IBAN DE89 3704 0044 0532 0130 01 is", []),
        ("Come to Flat 10, 903 Heron Close after", [("address", "Flat 10, 903 Heron Close")]), ("at 1382 N. Harrow Avenue.", [("address", "1382 N. Harrow Avenue")]), ("au 13 bis rue des Tilleuls à dix", [("address", "13 bis rue des Tilleuls")]), ("ist Lindenweg 26 um acht", [("address", "Lindenweg 26")]),
        ("en Avenida de la Fuente, 18 a a las ocho", [("address", "Avenida de la Fuente, 18 a")]), ("en Avenida de la Fuente, 83 a las ocho", [("address", "Avenida de la Fuente, 83")]), ("Mill Lane was closed; we walked by Orchard Road instead.", []),
        ("Thanks to Zora van der Marl for the flowers.", [("name", "Zora van der Marl")]), ("Speaker: MARL, ZORA", [("name", "MARL, ZORA")]) if False else ("Speaker: Marl, Zora", [("name", "Marl, Zora")]), ("Dr. Zora Marl disagreed.", [("name", "Zora Marl")]), ('{"who": "z. marl", "via": "x"}', []),
        ("Zora Marl; 1280 Orchard Road, Apt 29; 202.555.0155", [("name", "Zora Marl"), ("address", "1280 Orchard Road, Apt 29"), ("phone", "202.555.0155")]), ("Marl Chapel and the Zora Trust share the roof.", []), ("Marta and Jonas read the parts.", []), ("Saint Orvan and Mother Kedra are named.", []),
        ("read it slowly. Z. Marl\n999-00-2241 It is", [("name", "Z. Marl"), ("id_number", "999-00-2241")]), ("John 3:16-18; 4:5 and 1 Samuel 2:3", []),
    ],
)
def test_spans(text, want):
    assert spans(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("su NIE X1234567L consta", ["X1234567L"]), ("Here Y-1234567-X stands", ["Y-1234567-X"]), ("item X1234567A", []), ("NIF 123 456 789 de", ["123 456 789"]), ("o contribuinte 123456789 pagou", ["123456789"]), ("NIF 123 456 788 de", []),
        ("we counted 123456789 grains", []), ("αριθμός ταυτότητας ΑΒ 123456 εδώ", ["ΑΒ 123456"]), ("ID AK-654321 on file", ["AK-654321"]), ("lot AB 123456 sold", []),
    ],
)
def test_further_identity_numbers(text, want):
    assert [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "id_number"] == want


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97_iban("GB82 WEST 1234 5698 7654 32") and not pii.mod97_iban("GB82WEST12345698765431")
    assert pii.mod97_key("255081416802538") and not pii.mod97_key("255081416802539") and pii.mod23_letter("12345678", "Z")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["Call ", "+1 202 555 0139", " Thanks to ", "Zora Marl", " for x. ", "a@b.org", "\n", "13 rue des Tilleuls", ", ", "Dr. ", "99999231-S", "é", "12", ";"]), max_size=10).map("".join))
def test_redaction_keeps_the_rest(text):
    s = pii.find_spans(text)
    assert all(a.end <= b.start for a, b in zip(s, s[1:], strict=False))
    out = pii.redact(text)
    left = text
    for x in reversed(s):
        left = left[: x.start] + pii.PLACEHOLDER[x.kind] + left[x.end :]
    assert out == left


def test_personal_data_frames(spark):
    text = "Mail a@b.org and A@b.org and a@b.org"
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x " * 50000 + "a@b.org")], "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    assert rows(pii.found_values(d)) == [(1, "email", "A@b.org"), (1, "email", "a@b.org"), (4, "email", "a@b.org")]
    got = dict(rows(pii.redact_column(d, "text").select("doc_id", "redacted").where("doc_id < 4")))
    assert got == {1: "Mail [EMAIL] and [EMAIL] and [EMAIL]", 2: None, 3: ""}
    assert pii.found_values(d.limit(0)).count() == 0


_HELD_OUT = [
    "I met {} yesterday.", "Our treasurer {} resigned.", "Yesterday {} visited us.", "Kontakt: {}", "We sat with {} for an hour", "{} brought soup to the sick.", "ask {}, who has the key", "Gestern kam {} vorbei.", "ein Brief von {} an uns",
    "avec {} et les autres", "hablamos con {} ayer", "foi com {} que falei", "the keys (held by {}) are lost", "then {} and others sang", "her friend {} wrote to us", "nobody but {} knew",
]
_PEOPLE = ["Ulrike Becker", "Margaret Holloway", "Pierre Lavigne", "Carmen Ortega", "Luís Carvalho", "Sophie von Arnim", "Edward B. Thistlewood", "Helga Müller-Brandt", "Nikos Pappas", "Ingrid Aaltonen"]


def test_names_in_sentences_of_other_shapes():
    """Held-out sentences; and what is no person's name in the same ones."""

    def share(people):
        return sum(p in {t.format(p)[s.start : s.end] for s in pii.find_spans(t.format(p)) if s.kind == "name"} for t in _HELD_OUT for p in people) / len(_HELD_OUT) / len(people)

    assert share(_PEOPLE) > 0.95
    assert share(["Sarah Connor", "Peter Müller", "Anna Schmidt"]) > 0.5
    assert share(["Mary Magdalene", "Simon Peter", "Robert Street", "Charlotte Chapel", "St Helena Church", "Nächste Woche", "Mill Lane", "On Monday"]) == 0


def test_many_values_in_one_text():
    text = " ".join(f"a{k}.b@mail{k}.org, 12 Hill{k % 7} Road;" for k in range(4000))
    found = pii.find_spans(text)
    assert sum(s.kind == "email" for s in found) == 4000 and all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))


# --- the queries ----------------------------------------------------------------------------------


def test_queries_over_the_smallest_tables(spark):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    for name, q in queries.QUERIES.items():
        df = q(spark, str(DATA))
        if name not in queries.ORACLE_SQL:
            assert df.count() > 0, name
            continue
        cur = con.execute(queries.ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in cur.fetchall())
        assert sorted(repr(tuple(r[c] for c in sorted(names))) for r in df.collect()) == want, name


def test_found_columns(spark):
    want = {
        "p1_found": "field:string,row_id:bigint,pos:int,target:string", "p3_found": "table_name:string,row_id:bigint", "p4_found": "table_name:string,row_id:bigint", "p5_found": "group_id:bigint,field:string,entry_id:bigint",
        "p6_ids": "doc_id:bigint,ids:array<int>", "p7_found": "doc_id:bigint,item_id:bigint", "p8_found": "doc_id:bigint,kind:string,pii_text:string",
    }
    for name, columns in want.items():
        assert ",".join(f"{a}:{b}" for a, b in queries.QUERIES[name](spark, str(DATA)).dtypes) == columns
