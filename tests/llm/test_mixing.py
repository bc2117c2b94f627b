import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing as X
from lectern.llm import tokens as K

TARGETS = "source string, target_share double, max_repeats int"


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(0)
    p, t = rng.random(500), rng.integers(1, 900, 500).astype(float)
    q = X.flight(p, t, np.random.default_rng(1))
    left = (q > 0) & (q < 1)
    assert left.sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * t).sum() - (p * t).sum()) < 1e-3
    r = X.land(q, np.random.default_rng(2))
    assert set(np.unique(r)) <= {0.0, 1.0} and abs((r * t).sum() - (p * t).sum()) <= 1800


def test_flight_is_unbiased():
    p, t = np.array([0.2, 0.5, 0.7, 0.4, 0.9]), np.array([3.0, 1.0, 4.0, 1.0, 5.0])
    mean = np.mean([X.land(X.flight(p, t, r := np.random.default_rng(s)), r) for s in range(3000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def test_equal_and_single_sizes():
    r = np.random.default_rng(0)
    assert X.land(X.flight(np.full(9, 1 / 3), np.full(9, 5.0), r), r).sum() == 3
    assert set(X.land(X.flight(np.array([0.4]), np.array([5.0]), r), r).tolist()) <= {0.0, 1.0}
    assert len(X.flight(np.zeros(0), np.zeros(0), np.random.default_rng(0))) == 0


@pytest.fixture(scope="module")
def sized(spark):
    rows = [(i, "big", 50 + i % 90) for i in range(4000)] + [(10_000 + i, "small", 100) for i in range(20)] + [(20_000, None, 70), (20_001, "other", 500), (20_002, "big", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, _key string, n_tokens bigint")


def test_shares_and_caps(spark, sized, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 300)
    t = spark.createDataFrame([(" Big ", 0.5, 1), ("small", 0.02, 8), ("none", 0.1, 3), ("zero", 0.0, 1), (None, None, None)], TARGETS)
    totals = X.source_totals(sized, t)
    mix = X.choose(sized, totals)
    rep = {r["source"]: r for r in X.shares(mix, totals).collect()}
    total = sized.agg(F.sum("n_tokens")).first()[0]
    assert abs(rep[" Big "]["chosen_tokens"] - 0.5 * total) < 200
    assert rep["small"]["most_copies"] <= 8 and abs(rep["small"]["chosen_tokens"] - 0.02 * total) < 200
    assert not rep["none"]["reachable"] and rep["none"]["chosen_tokens"] == 0 and rep["zero"]["reachable"]
    assert mix.filter("n_tokens = 0").count() == 0
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9


def test_repeats_stop_at_the_cap(spark, sized):
    t = spark.createDataFrame([("small", 0.9, 2)], TARGETS)
    totals = X.source_totals(sized, t)
    mix = X.choose(sized, totals)
    assert {r["copies"] for r in mix.collect()} == {2} and mix.count() == 20
    assert totals.first()["reachable"] is False


def test_empty_tables(spark, sized):
    t = spark.createDataFrame([("small", 0.9, 2)], TARGETS)
    totals = X.source_totals(sized.limit(0), t)
    assert X.choose(sized.limit(0), totals).count() == 0
    assert X.shares(X.choose(sized.limit(0), totals), totals).first()["actual_share"] == 0.0
    assert X.source_totals(sized, t.limit(0)).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world", " A\t", "x"), (2, None, "a", "x"), (3, "", None, "x")], "doc_id bigint, text string, source string, n_tokens string")
    assert sorted((r["doc_id"], r["_key"], r["n_tokens"]) for r in X.sizes(df, K.VOCABULARY).collect()) == [(1, "a", 2), (2, "a", 0), (3, None, 0)]
