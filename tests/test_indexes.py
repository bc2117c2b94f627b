"""Stored indexes against the whole scans."""

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import retrieval as R
from lectern.operators.indexes import KeywordIndex, VectorIndex

SCHEMA = "id string, text string, rank string"
TEXTS = [("a", "the storm over the harbour", "x"), ("b", "Storm, storm and storm!", "x"), ("c", "quiet harbour", "x"), ("d", None, "x"), ("e", "", "x"), ("a", "the storm over the harbour", "x"), (None, "storm", "x")]


def found(df):
    return [(r["id"], round(r["score"], 6), r["rank"]) for r in df.orderBy("rank").collect()]


def test_keyword_index_equals_the_scan(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, SCHEMA)
    index = KeywordIndex(spark, str(tmp_path / "k")).add(df, buckets=4)
    scan = R.keyword_search(df.filter("id is not null").dropDuplicates(["id"]).drop("rank").withColumn("vector", F.lit(None)), "storm harbour", 9)
    assert found(index.search("storm harbour", 9)) == found(scan)
    assert found(index.search("storm harbour", 9, within=df.filter("id = 'c'").select("id")))[0][0] == "c"  # filtered before the cut
    assert index.search("nothing", 5).count() == 0 and index.search("", 5).count() == 0


def test_a_row_added_again_counts_once(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "k")).add(spark.createDataFrame(TEXTS, SCHEMA), buckets=4)
    index.add(spark.createDataFrame([("b", "calm sea", "x"), ("f", "storm", "x")], SCHEMA), buckets=4)
    assert {r[0] for r in found(index.search("storm", 9))} == {"a", "f"} and [r[0] for r in found(index.search("calm", 9))] == ["b"]


def test_only_the_terms_buckets_are_read(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "k")).add(spark.createDataFrame(TEXTS, SCHEMA), buckets=8)
    plan = index.postings(["storm"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [", 1)[1][:200]


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 64))
    x = centres[rng.integers(0, 20, 900)] + 0.5 * rng.normal(size=(900, 64))
    rows = [(f"v{i:04}", [float(c) for c in r]) for i, r in enumerate(x)] + [("zero", [0.0] * 64), ("short", [1.0]), ("null", None), (None, [1.0] * 64)]
    index = VectorIndex(spark, str(tmp_path / "v")).add(spark.createDataFrame(rows, "id string, vector array<double>"), lists=30)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 900, 90):
        want = {f"v{i:04}" for i in np.argsort(-(u @ u[q]), kind="stable")[:5]}
        hit += len(want & {r["id"] for r in index.search(x[q], 5, probes=6).collect()})
        assert {r["id"] for r in index.search(x[q], 5, probes=30).collect()} == want
        if q >= 270:
            break
    assert hit / 20 >= 0.9
    index.add(spark.createDataFrame([("v0000", [float(c) for c in -x[0]])], "id string, vector array<double>"))
    assert index.search(x[0], 1, probes=30).first()["id"] != "v0000"


def test_empty_indexes(spark, tmp_path):
    k = KeywordIndex(spark, str(tmp_path / "k")).add(spark.createDataFrame([], SCHEMA))
    assert k.search("storm", 5).count() == 0
    v = VectorIndex(spark, str(tmp_path / "v")).add(spark.createDataFrame([], "id string, vector array<float>"))
    assert v.search([1.0] * 64, 5).count() == 0
