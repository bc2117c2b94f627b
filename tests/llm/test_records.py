"""A language and a confidence for every record of chunks and catalogue."""

from lectern.llm import queries as Q

EN = "The water of the river rises in the winter and the road along the bank is closed until the spring."
DE = "Das Wasser des Flusses steigt im Winter, und die Straße am Ufer bleibt bis zum Frühling geschlossen."


def test_books_and_records_without_sentences(spark, tmp_path):
    chunks = [("c1", "2025-01-01T00:00:00", EN, "en"), ("c1", "2024-01-01T00:00:00", DE, "de"), ("c2", "2025-01-01T00:00:00", None, None), ("c3", "2025-01-01T00:00:00", "12 - 7", None), (None, "2025-01-01T00:00:00", EN, "en")]
    books = [("b1", f"<p>{DE}</p>", "de", "2025-01-01T00:00:00"), ("b1", f"<p>{EN}</p>", "en", "2024-01-01T00:00:00"), ("c1", f"<p>{DE}</p>", None, "2025-01-01T00:00:00"), ("b2", None, None, None)]
    spark.createDataFrame(chunks, "id string, indexed_at string, text string, language string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame(books, "source_id string, comments_html string, language string, modified_at string").write.parquet(f"{tmp_path}/catalogue.parquet")
    s = {(r["record_kind"], r["id"]): r for r in Q.p6_stretches(spark, str(tmp_path)).collect()}
    assert {k: r["lang"] for k, r in s.items()} == {("chunk", "c1"): "en", ("book", "b1"): "de", ("book", "c1"): "de"}
    got = Q.p6_records(spark, str(tmp_path)).collect()
    assert len(got) == 6
    assert {(r["record_kind"], r["id"]): r["lang"] for r in got} == {("chunk", "c1"): "en", ("chunk", "c2"): None, ("chunk", "c3"): None, ("book", "b1"): "de", ("book", "c1"): "de", ("book", "b2"): None}
    assert all((r["confidence"] > 0) == (r["lang"] is not None) for r in got)
