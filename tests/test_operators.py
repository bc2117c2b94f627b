"""Sync, catalogue, order and chunking operators."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import catalogue as C
from lectern.operators import chunking as K
from lectern.operators import ordered as O
from lectern.operators import quality as Q
from lectern.operators import sync as S
from lectern.tables import conform, instant


def test_upsert_delete_update(spark):
    t = spark.createDataFrame([("a", 1, "b1"), ("b", 1, "b1"), (None, 1, "b2")], "id string, v int, book_id string")
    n = spark.createDataFrame([("b", 2, "b1"), ("b", 3, "b1"), ("c", 1, "b3")], "id string, v int, book_id string")
    assert sorted((r[0] or "", r[1]) for r in S.upsert(t, n, newest="v").select("id", "v").collect()) == [("", 1), ("a", 1), ("b", 3), ("c", 1)]
    assert S.delete_where(t, F.col("id") == "a").count() == 2
    assert S.update_where(t, F.col("id") == "a", {"v": F.lit(9), "zz": F.lit(1)}).filter("v = 9").count() == 1
    assert S.orphans(t, t.limit(0)).count() == 0


def test_snapshot_diff(spark):
    s = spark.createDataFrame([("a", "1", "x", 0), ("b", "", "x", 0), ("c", "1", "", 0), ("d", "1", "x", 1), ("e", "1", "x", 0)], "item string, hash string, annotation_hash string, pending int")
    c = spark.createDataFrame([("a", "2", "x"), ("b", "2", "x"), ("c", "1", "y"), ("d", "1", "x"), ("f", "1", "x")], "item string, hash string, annotation_hash string")
    got = {r["item"]: r["change"] for r in S.snapshot_diff(s, c).collect()}
    assert got == {"a": "metadata_changed", "b": "unchanged", "c": "annotations_changed", "d": "fulltext_pending", "e": "orphan", "f": "new"}


def test_metadata_hash_is_that_of_the_json(spark):
    d = spark.createDataFrame([('T "q"', "A\\B", None, "x\ny", ["b", "a"])], "t string, a string, p string, c string, g array<string>")
    got = d.select(tx.metadata_hash(F.col("t"), F.col("a"), F.col("p"), F.col("c"), F.col("g"))).first()[0]
    want = json.dumps({"comments": "x\ny", "tags": ["a", "b"], "title": 'T "q"', "author": "A\\B", "publisher": ""}, sort_keys=True, ensure_ascii=False)
    assert got == hashlib.md5(want.encode()).hexdigest()


def test_roman_and_sections(spark):
    d = spark.createDataFrame([("xiv",), ("IX",), ("iiii",), ("12",), ("",), (None,), ("mcmxc",)], "t string")
    assert [r[0] for r in d.select(tx.roman(F.col("t"))).collect()] == [14, 9, None, None, None, None, 1990]
    s = spark.createDataFrame([("Preface and Notes",), ("Banknotes",), ("References",)], "t string")
    assert [r[0] for r in s.select(tx.section_type(F.col("t"))).collect()] == ["back_matter", "main_content", "back_matter"]
    assert [r[0] for r in s.select(tx.section_type(F.col("t"), True)).collect()][0] == "front_matter"


def test_instants(spark):
    rows = [("2024-01-01T02:00:00+02:00",), ("2024-01-01 00:00:00",), ("2024-01-01T00:00:00.5Z",), ("2024-13-01T00:00:00",), ("yesterday",), ("",), (None,), ("2023-12-31T19:00:00-05:00",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(F.date_format(instant(F.col("t")), "yyyy-MM-dd HH:mm:ss.S")).collect()]
    assert got == ["2024-01-01 00:00:00.0", "2024-01-01 00:00:00.0", "2024-01-01 00:00:00.5", None, None, None, None, "2024-01-01 00:00:00.0"]


def test_conform_fills_defaults(spark):
    r = conform(spark.createDataFrame([("a", None)], "id string, text string")).first()
    assert r["text"] == "" and r["year"] == 0 and r["chunk_type"] == "content"


def test_gap_sessions_match_a_plain_pass(spark):
    t0 = datetime(2024, 1, 1, 23, 50)
    at = [0, 30, 61, 61, 200, 2000, None]  # minutes; 30 exactly does not split
    d = spark.createDataFrame([("k", i, None if m is None else t0 + timedelta(minutes=m)) for i, m in enumerate(at)], "k string, i int, ts timestamp")
    got = [r["session"] for r in O.gap_sessions(d, "k", "ts", "i", 1800).orderBy("i").collect()]
    assert got == [0, 0, 1, 1, 2, 3, 3]


def test_range_map_and_fill(spark):
    p = spark.createDataFrame([("b", 1, "x"), ("b", 5, "y"), ("b", 9, "z")], "book_id string, page int, id string")
    s = spark.createDataFrame([("b", 2, "one"), ("b", 9, "two")], "book_id string, page int, entry string")
    assert {r["id"]: r["entry"] for r in O.range_map(p, s, "book_id", "page", "entry").collect()} == {"x": None, "y": "one", "z": "two"}


def test_labels_are_repaired(spark):
    d = spark.createDataFrame([("b", i, l) for i, l in enumerate(["1", "2", "99", "4", None, "6", "x"], 1)], "b string, p int, l string")
    assert [r["repaired"] for r in O.repaired_labels(d, "b", "p", "l").orderBy("p").collect()] == [1, 2, 3, 4, 5, 6, 7]


TEXTS = ["", "one", "A first one. " * 300, "word" * 2000, "para one.\n\n" * 80 + "end", "# H\n\ntext\n\n## B\n\n" + "long text here. " * 200 + "\n\n### C\nrest", "User: hi\n\nAI: yes\n\nUser: go\n\nAI: no"]


@pytest.mark.parametrize("how", ["paragraph", "markdown", "dialogue"])
def test_chunkers_lose_no_text(spark, how):
    for t in TEXTS:
        spans = K.CHUNKERS[how](t) if t else []
        assert "".join(t[a:b] for a, b in spans) == t
        limit = 3200 if how == "dialogue" else 1700
        assert all(b - a <= limit for a, b in spans)


@pytest.mark.parametrize("how", ["paragraph", "markdown", "dialogue"])
def test_words_over_the_size_are_cut_anywhere(spark, how):
    texts = ["a " + "x" * 9000 + " b", "One. " + "y" * 4000, "甲。" + "乙" * 5000 + "。丙", "\n\n".join("z" * 4000 for _ in range(3))]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = K.chunk(d, "k", "t", how).orderBy("k", "chunk_index").collect()
    assert ["".join(r["chunk"] for r in rows if r["k"] == k) for k in range(len(texts))] == texts
    assert all(0 < len(r["chunk"]) <= 3300 for r in rows)


def test_word_chunks_overlap(spark):
    t = " ".join(f"w{i}" for i in range(2000))
    s = K.word_spans(t)
    assert s[0][0] == 0 and s[-1][1] == len(t) and all(a[1] > b[0] for a, b in zip(s, s[1:]))


def test_fixed_matches_slices(spark):
    d = spark.createDataFrame([(1, "x" * 1234), (2, ""), (3, None), (4, "short")], "k int, t string")
    got = {(r["k"], r["chunk_index"]): (r["start"], len(r["chunk"])) for r in K.fixed(d, "k", "t", 500, 50).collect()}
    assert got == {(1, 0): (0, 500), (1, 1): (450, 500), (1, 2): (900, 334), (4, 0): (0, 5)}


def test_parents_keep_the_budget(spark):
    rows = [(f"c{i}", "b", i, "main", "1" if i < 6 else "2", "", "w " * 40) for i in range(10)]
    d = spark.createDataFrame(rows, "id string, book_id string, chunk_index int, section_type string, chapter string, section_title string, text string")
    g = K.parents(d, 120).groupBy("run", "parent").agg(F.count("*").alias("n"), F.sum(F.lit(52)).alias("t")).collect()
    assert sum(r["n"] for r in g) == 10 and all(r["t"] <= 120 for r in g)


def test_matching_stages(spark):
    b = spark.createDataFrame([("b1", "Kritik der reinen Vernunft", ["Kant"], {"asin": "b00x"}), ("b2", "Être et temps", ["Heidegger"], None)], "source_id string, title string, authors array<string>, identifiers map<string,string>")
    i = spark.createDataFrame([("i1", "B00X", "anything", "x"), ("i2", None, "Etre et Temps", "Heidegger"), ("i3", "", "Kritik der reine Vernunft", "Kant"), ("i4", None, "Nothing alike", "Z")], "item string, code string, title string, author string")
    got = {r["item"]: (r["book"], r["how"]) for r in C.match(i, b).collect()}
    assert got == {"i1": ("b1", "code"), "i2": ("b2", "exact"), "i3": ("b1", "fuzzy")}


def test_scores_of_empty_and_bad_books(spark):
    c = conform(spark.createDataFrame([("1", "b", "parent", "x"), ("2", "d", "content", "w " * 60)], "id string, book_id string, chunk_type string, text string"))
    got = {r["book_id"]: r["score"] for r in Q.chunk_scores(c).collect()}
    assert got["b"] == 90.0 and 0 <= got["d"] <= 100
    assert Q.chunk_scores(c.limit(0)).count() == 0
