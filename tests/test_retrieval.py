"""Search operators on tiny tables."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import retrieval as R


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("1", "Kant wrote on reason and the limits of reason", [1.0, 0.0], "b1", "en", "content", "main_content", "philosophy, kant", "", 1, "b1"),
        ("2", "Die Kantine ist geöffnet und das Essen gut", [0.9, 0.1], "b1", "de", "content", "", "essen", "", 1, "b1"),
        ("3", None, None, "b2", "en", "calibre_comment", "front_matter", None, "", 2, "17"),
        ("4", "banknotes and notes", [0.0, 1.0], "b2", "en", "child", "main_content", "money", "5", 17, "x"),
        ("5", "the whole text of the parent", [0.0, 0.0], "b2", "en", "parent", "main_content", "money", "", 17, "x"),
        ("6", "Kant wrote on reason and the limits of reason", [1.0, 0.0], "b3", "en", "annotation", "back_matter", "kant", "", 3, "b3"),
    ]
    return spark.createDataFrame(rows, "id string, text string, vector array<float>, book_id string, language string, chunk_type string, section_type string, tags string, parent_id string, calibre_id bigint, source_id string")


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_filter_acts_before_the_cut(chunks):
    got = R.vector_search(chunks, [1.0, 0.0], 1, R.conditions(R.SearchSpec(language="de")))
    assert ids(got) == ["2"]


def test_ties_go_by_id_and_unusable_vectors_never_match(chunks):
    assert ids(R.vector_search(chunks, [1.0, 0.0], 10)) == ["1", "6", "2", "4"]


def test_empty_table(chunks):
    none = chunks.limit(0)
    assert R.vector_search(none, [1.0, 0.0], 3).count() == 0
    assert R.keyword_search(none, "reason", 3).count() == 0
    assert R.hybrid_search(none, "reason", [1.0, 0.0], 3).count() == 0


def test_bm25_and_hybrid(chunks):
    assert ids(R.keyword_search(chunks, "reason", 5)) == ["1", "6"]
    top = R.hybrid_search(chunks, "reason", [1.0, 0.0], 5).orderBy("rank").first()
    assert top["id"] == "1" and top["score"] == pytest.approx(2 / 61, abs=1e-8)


def test_exact_phrase_ignores_case_and_space(chunks):
    assert ids(R.exact_phrase(chunks, "Limits  OF reason", 5)) == ["1", "6"]


def test_word_boundaries(spark):
    d = spark.createDataFrame([("Kantine",), ("Kant!",), ("banknotes",), ("notes",), ("bücher",), ("cher",), (None,)], "t string")
    got = [r[0] for r in d.select(tx.has_keyword(F.col("t"), ["kant", "notes", "cher"])).collect()]
    assert got == [False, True, False, True, False, True, False]


def test_aliases_and_sources(chunks):
    c = lambda **k: sorted(r["id"] for r in chunks.filter(R.conditions(R.SearchSpec(**k))).collect())
    assert c(section="main") == ["1", "2", "4", "5"]
    assert c(chunk_type="content") == ["1", "2", "4"]
    assert c(chunk_type="annotations_and_comments") == ["3", "6"]
    assert c(source_id="17") == ["3", "4", "5"]


def test_boosts_scale(chunks):
    r = R.keyword_search(chunks, "reason", 5)
    b = {x["id"]: x["score"] for x in R.boost(r, "kant reason").collect()}
    a = {x["id"]: x["score"] for x in r.collect()}
    assert b["6"] == pytest.approx(a["6"] * 1.15, rel=1e-6)
    i = {x["id"]: x["score"] for x in R.interest_boost(r, ["kant", "limits"], 0.1).collect()}
    assert i["1"] == pytest.approx(a["1"] * 1.2, rel=1e-6)


def test_diversify_and_merge(spark):
    r = spark.createDataFrame([(str(i), f"b{i % 2}", i) for i in range(1, 9)], "id string, book_id string, rank int")
    assert [(x["id"], x["rank"]) for x in R.diversify(r, 1, 5).orderBy("rank").collect()] == [("1", 1), ("2", 2)]
    assert R.diversify(r, 999, 3).count() == 3
    two = spark.createDataFrame([("a", 1, "x", None, 9.0), ("b", 2, "x", None, 8.0), ("c", 1, "y", None, 0.1)], "id string, rank int, source string, rerank_score double, score double")
    assert ids(R.merge_sources(two, 3)) == ["a", "c", "b"]
    assert ids(R.merge_sources(two.withColumn("rerank_score", F.when(F.col("id") == "c", 0.9).otherwise(0.2)), 3))[0] == "c"
    assert R.above(two, 0.5).count() == 3


def test_stop_words():
    assert tx.drop_stop_words("the order of the books", ["en"]) == "order books"
    assert tx.drop_stop_words("the of", ["en"]) == "the of"


def test_context_and_snippet(chunks, spark):
    r = chunks.filter("id = '4'").withColumn("rank", F.lit(1))
    assert R.with_context(r, chunks).first()["context"] == "the whole text of the parent"
    s = spark.createDataFrame([("x" * 400 + " needle " + "y" * 400,), ("short",)], "t string").select(R.snippet(F.col("t"), "needle")).collect()
    assert s[0][0].startswith("...") and "needle" in s[0][0] and s[1][0] == "short"
