"""Every registered query over empty tables, and the found forms over small ones."""

from pathlib import Path

import pytest

from lectern.llm import queries as Q

DATA = Path("/root/testdata/sf0.001")
TABLES = ["catalogue", "chunks", "documents", "chat_messages", "speaker_alias", "search_hits", "mix_targets"]
if not DATA.exists():
    pytest.skip("no test tables here", allow_module_level=True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return str(at)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_empty_tables(spark, empty, name):
    assert Q.QUERIES[name](spark, empty).count() == 0


COLUMNS = {
    "p1_found": {"id": "string"}, "p2_found": {"conv_id": "bigint"}, "p3_found": {"id_a": "string", "id_b": "string"}, "p4_found": {"source_id": "string", "kind": "string"}, "p6_found": {"record_kind": "string", "record_id": "string", "lang": "string"},
    "p7_found": {"query_id": "bigint", "id": "string"}, "p8_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p9_found": {"source": "string"}, "p10_found": {"doc_id": "bigint", "sent_start": "bigint", "sent_end": "bigint"},
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, name):
    df = Q.QUERIES[name](spark, str(DATA))
    assert dict(df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert rows and (name == "p8_ids" or len({tuple(r) for r in rows}) == len(rows))
