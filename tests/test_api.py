"""The verbs over a tiny library."""

import pytest

from lectern import api


@pytest.fixture(scope="module")
def lib(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("library")
    ch = "id string, text string, vector array<float>, book_id string, book_title string, chunk_type string, indexed_at string, tags string, author string, language string, section_type string, calibre_id bigint, source_id string, year int, page_label string, page_number int, parent_id string, chunk_index int, metadata_hash string, annotation_hash string, format string, section_title string, chapter string, pending_external int, annotation_type string, source_file string, char_start int, char_end int"
    rows = [(f"c{i}", f"winter storms came {'and harbour' if i % 2 else ''} number {i}", [1.0, float(i)], f"b{i % 2}", "Storms", "annotation" if i == 3 else "content", "2024-01-01T00:00:00.0", "sea", "Lee", "en", "main_content", i, f"b{i % 2}", 1999, "", 3, "", i, "", "", "txt", "", "", 0, "", "", 0, 0) for i in range(6)]
    spark.createDataFrame(rows, ch).write.parquet(f"{at}/chunks.parquet")
    cat = "source_id string, calibre_id bigint, title string, authors array<string>, publisher string, series string, tags array<string>, language string, year int, comments_html string, file_format string, identifiers map<string,string>, created_at string, modified_at string, imported_at string, annotation_hash string"
    spark.createDataFrame([("b0", 1, "Storms at Sea", ["Lee, A."], "P", None, ["sea"], "en", 1999, None, "pdf", None, None, "2024-01-01T00:00:00Z", None, None), ("b1", 2, "Storms at Sea", ["Lee, A."], None, None, None, None, None, None, "epub", None, None, None, None, None)], cat).write.parquet(f"{at}/catalogue.parquet")
    return api.Library(spark, str(at))


def test_search_verbs(lib):
    assert api.search_books(lib, "winter storms", min_length=0, max_per_book=1).count() == 2
    assert api.search_books(lib, "harbour", min_length=0, rerank=True).first()["rerank_score"] == 1.0
    assert api.search_annotations(lib, "storms").first()["id"] == "c3"
    assert api.exact_phrase(lib, "STORMS came").count() == 6


def test_catalogue_verbs(lib):
    assert api.duplicates(lib).count() == 1 and api.list_tags(lib).first()["tag"] == "sea"
    assert api.bibliography(lib, "plain").count() == 2 and api.missing_metadata(lib).count() == 2
    assert api.list_books(lib, "lee").count() == 2 and api.book_details(lib, "b0").count() == 1
    assert api.statistics(lib).count() > 5 and api.chunk_quality(lib).count() == 2 and api.list_annotated(lib).count() == 1


def test_index_a_folder(lib, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "note.txt").write_text("A first paragraph.\n\nA second one.")
    out = api.index(lib, str(tmp_path / "in"), str(tmp_path / "out"))
    assert out.count() == 7 and out.filter("book_title = 'note'").count() == 1
    (tmp_path / "c.txt").write_text("Storms at Sea (Lee, A.)\n- Your Highlight on Location 2-4 | Added on Monday, March 16, 2026 10:23:45 AM\n\nx\n==========\n")
    assert api.import_clippings(lib, str(tmp_path / "c.txt")).first()["how"] == "exact"
