"""The snapshot of the catalogue against its SQL and expected values."""

import pytest

import __spark_entry__ as entry

COLUMNS = "source_id string, title string, authors array<string>, tags array<string>, modified_at string, annotation_hash string"
BOOKS = [
    ("b1", "Letters", ["Zimmer, Ute", "Adams, J.", "Li"], ["law", "Art"], "2024-01-02T00:00:00Z", "h1"),
    ("b1", "Old letters", ["Adams, J."], None, "2024-01-02T00:30:00+01:00", "h0"),
    ("b2", "Songs", ["Ann; Bo", "Cy & Co"], ["x,y", None], None, None),
    ("b3", None, None, None, "", ""),
    ("b4", "Plain", ["One, A."], [], "soon", "h4"),
    ("b5", "Gap", [None, "Two, B.", ""], ["b", "a", "b"], "2024-01-02", "h5"),
    (None, "Nobody's", ["A", "B"], [], "2024-01-02T00:00:00Z", ""),
]
WANT = {
    ("b1", "Letters", "Zimmer, Ute & Adams, J. & Li", "Art,law", "h1"),
    ("b2", "Songs", "Ann; Bo & Cy & Co", "x,y", ""),
    ("b3", None, "", "", ""),
    ("b4", "Plain", "One, A.", "", "h4"),
    ("b5", "Gap", "Two, B. & ", "a,b,b", "h5"),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("snapshot")
    spark.createDataFrame(BOOKS, COLUMNS).coalesce(1).write.parquet(f"{d}/catalogue.parquet")
    return str(d)


def _rows(spark, tables):
    return {(r["source_id"], r["title"], r["authors"], r["tags"], r["annotation_hash"]) for r in entry.queries()["lk15_snapshot"](spark, tables).collect()}


def test_authors_are_joined_as_the_catalogue_joins_them(spark, tables):
    assert _rows(spark, tables) == WANT


def test_snapshot_equals_its_sql(spark, tables):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"create view catalogue as select * from read_parquet('{tables}/catalogue.parquet/*.parquet')")
    assert set(c.execute(f"select source_id, title, authors, tags, annotation_hash from ({entry.oracle_sql()['lk15_snapshot']})").fetchall()) == _rows(spark, tables)
