import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import neighbours as N


def table(spark, x, extra=()):
    rows = [(f"v{i:05d}", [float(c) for c in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id string, vector array<double>")


def exact(x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 64))
    x = centres[rng.integers(0, 40, 1500)] + 0.7 * rng.normal(size=(1500, 64))
    s, want = exact(x, 5)
    got = N.Index(table(spark, x), n_pivots=64, posted=6, prefix=8).neighbours(5, probes=6).collect()
    kth = np.sort(s, axis=1)[:, -5]
    hit = sum(s[int(r["id"][1:]), int(r["other"][1:])] >= kth[int(r["id"][1:])] - 1e-6 for r in got)
    assert len(got) == 5 * len(x) and hit / (5 * len(x)) >= 0.9


def test_parts_of_a_list_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64))
    df = table(spark, x)
    one = {(r["id"], r["other"]) for r in N.Index(df, n_pivots=4, posted=4, prefix=4).neighbours(3).collect()}
    monkeypatch.setattr(N, "LIST", 20)
    many = {(r["id"], r["other"]) for r in N.Index(df, n_pivots=4, posted=4, prefix=4).neighbours(3).collect()}
    s, want = exact(x, 3)
    assert one == many == {(f"v{i:05d}", f"v{j:05d}") for i in range(300) for j in want[i]}


def test_copies_unusable_and_small(spark):
    v = [1.0] * 64
    rows = [(f"c{i}", v) for i in range(9)] + [("scaled", [3.0] * 64), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("inf", [float("inf")] * 64), ("short", [1.0]), ("null", None), (None, v), ("far", [1.0] + [-1.0] * 63)]
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    got = N.Index(df).neighbours(5).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r["other"])
    assert set(by) == {f"c{i}" for i in range(9)} | {"scaled", "far"}
    assert all(len(o) == 5 and i not in o for i, o in by.items())
    assert sorted(by["c7"]) == [f"c{i}" for i in range(5)]
    assert N.Index(df.limit(0)).neighbours(5).count() == 0
    assert N.Index(df.filter("id = 'c1'")).neighbours(5).count() == 0


def test_footrule():
    a, b = np.array([[3, 1, 2]]), np.array([[3, 1, 2], [1, 3, 9], [7, 8, 9]])
    got = N.footrule_overlap(a, b, 3)[0].tolist()
    dist = [3 * 4 - 2 * g for g in got]

    def plain(p, q):
        place = lambda r, x: r.index(x) if x in r else 3
        return sum(abs(place(p, x) - place(q, x)) for x in set(p) | set(q))

    assert dist == [plain([3, 1, 2], r.tolist()) for r in b]


def test_second_pivots_divide_the_lists_and_keep_the_similar_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2400, 64))
    x[1200:] = x[:1200] + 0.25 * rng.normal(size=(1200, 64))  # each with a partner of cosine 0.9 and more
    s, _ = exact(x, 5)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.9)))}
    plain = N.Index(table(spark, x), n_pivots=16, posted=5)
    split = N.Index(table(spark, x), n_pivots=16, posted=5, second=8)
    longest = [i.entries.select(F.explode(F.slice("near", 1, 5)).alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] for i in (plain, split)]
    assert longest[1] * 2 < longest[0] and (plain.m2, split.m2, split.posted) == (1, 8, 8)
    got = {tuple(sorted((int(r["id"][1:]), int(r["other"][1:])))) for r in split.neighbours(5, 0.9, least_overlap=4).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) > 900


def test_lists_keep_their_length():
    for n in (10**4, 10**6, 10**7, 10**8, 3 * 10**8):
        m = int(min(N.PIVOTS, max(16, 2 * np.sqrt(n))))
        m2 = N._second(n * 5, m)
        m2 = N._second(n * 8, m) if m2 > 1 else m2
        assert n * (8 if m2 > 1 else 5) / (m * m2) <= N.LENGTH
