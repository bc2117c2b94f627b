"""Queries that run on every row of their tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern import plans
from lectern.tables import book_view, chunk_view, load

DATA = "/root/testdata/sf0.001"
if not Path(DATA).exists():
    pytest.skip("no test tables here", allow_module_level=True)
Q = plans.queries()


def test_every_document_is_matched_or_not(spark):
    books = {r[0] for r in book_view(spark, DATA).select("source_id").collect()}
    found, lost = ({r["item"] for r in Q[n](spark, DATA).collect()} for n in ("lk6_match_all", "lk7_unmatched_all"))
    assert found | lost == books and not found & lost
    assert Q["ex28_import"](spark, DATA).count() == len(found)
    assert {r["item"] for r in Q["jo10_fuzzy"](spark, DATA).collect()} == {f"i{b}" for b in books}
    assert Q["ex29_instruction_all"](spark, DATA).count() == len(books)


def test_every_clipping_is_read(spark):
    whole = load(spark, DATA, "documents").filter("doc_kind = 'clipping' and text is not null")
    assert Q["sc25_file"](spark, DATA).count() >= whole.count() > 0


def test_whole_texts_are_cleaned(spark):
    cleaned = Q["re5_stop_words"](spark, DATA).filter(F.length("cleaned") > 60).count()
    assert cleaned > 0.3 * chunk_view(spark, DATA).filter("length(text) > 120").count() > 0


def test_every_description_is_extracted(spark):
    texts = {r["source_id"]: r["comments_html"] for r in book_view(spark, DATA).filter("comments_html is not null").collect()}
    html = {r["source_id"]: r["text"] for r in Q["sc16_html"](spark, DATA).collect()}
    marked = {r["source_id"]: r["markdown"] for r in Q["sc18_markdown"](spark, DATA).collect()}
    assert html.keys() == marked.keys() == texts.keys()
    plain = {k for k, t in texts.items() if t.strip() and not set(t) & set("<&")}
    assert plain and all(html[k].split() == marked[k].split() == texts[k].split() for k in plain)
