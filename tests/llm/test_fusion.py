import random

from lectern.llm import fusion as U

SCORES = {"_distance": False, "_score": True}
NAN, INF = float("nan"), float("inf")


def brute(rows, k=U.RRF_K):
    items = {}
    for q, i, *v in rows:
        if q is None or i is None:
            continue
        for (s, up), x in zip(SCORES.items(), v):
            if x is not None and x == x:
                old = items.setdefault((q, i), {}).get(s)
                items[q, i][s] = x if old is None else (max(old, x) if up else min(old, x))
            else:
                items.setdefault((q, i), {})
    out = {}
    for (q, i), v in items.items():
        total, ranks = 0.0, {}
        for s, up in SCORES.items():
            if s in v:
                better = sum(1 for (p, _), w in items.items() if p == q and s in w and (w[s] > v[s] if up else w[s] < v[s]))
                ranks[s] = better + 1
                total += 1 / (k + better + 1)
        out[q, i] = (round(total, 12), ranks)
    return out


def rows():
    rng = random.Random(5)
    out = [(1, "a", 0.1, 5.0), (1, "a", None, 7.0), (1, "b", 0.1, NAN), (1, "c", None, None), (None, "z", 1.0, 1.0), (1, None, 1.0, 1.0), (2, "only", -0.0, INF), (2, "zero", 0.0, -INF), (2, "tiny", 5e-324, 1e308)]
    for i in range(300):
        out.append((3, f"i{i % 120}", rng.choice([None, NAN, rng.gauss(0, 1), 0.5, -2.0 ** rng.randint(-30, 30)]), rng.choice([None, rng.expovariate(1) * 10 ** rng.randint(-3, 5), 1.0])))
    return out


def test_ranks_match_brute_force(spark):
    df = spark.createDataFrame([(*r, "clash") for r in rows()], "q bigint, id string, _distance double, _score double, total string")
    want = brute(rows())
    got = {(r["q"], r["id"]): r for r in U.fuse(df, "q", "id", SCORES).collect()}
    assert set(got) == set(want)
    for k, (total, ranks) in want.items():
        assert abs(got[k]["total"] - total) < 1e-9 and got[k]["rank_distance"] == ranks.get("_distance") and got[k]["rank_score"] == ranks.get("_score"), k


def test_places_and_tops(spark):
    df = spark.createDataFrame(rows(), "q bigint, id string, _distance double, _score double")
    placed = U.ranking(U.fuse(df, "q", "id", SCORES), "q", "id").filter("q = 3").orderBy("place").collect()
    assert [r["place"] for r in placed] == list(range(1, len(placed) + 1))
    assert placed == sorted(placed, key=lambda r: (-r["total"], r["id"]))
    want = {k for k, (_, r) in brute(rows()).items() if len(r) == 2 and max(r.values()) <= 10}
    assert {(r["q"], r["id"]) for r in U.in_every_top(U.fuse(df, "q", "id", SCORES), SCORES).collect()} == want
    assert U.fuse(df.limit(0), "q", "id", SCORES).count() == 0
