from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.llm import conversations as C

T0 = datetime(2025, 1, 1)
SCHEMA = "msg_id bigint, conv_id bigint, platform string, speaker string, content string, seq int, parent_msg_id bigint, sent_at timestamp, loaded_at timestamp, role string, pos string"


def row(m, c, p, s, t, seq=None, parent=None, at=None):
    return (m, c, p, s, t, seq, parent, None if at is None else T0 + timedelta(minutes=at), T0, "clash", "clash")


@pytest.fixture(scope="module")
def alias(spark):
    return spark.createDataFrame([("user", "human"), ("you said", "human"), ("ai", "assistant"), ("system", "system")], "alias_form string, speaker_role string")


CASES = [
    # good: counter from 1, decorated labels, a message delivered twice
    row(1, 1, "lesechat", "**[USER]**", "q", 1), row(1, 1, "lesechat", "**[USER]**", "q", 1), row(2, 1, "lesechat", "Ai: ", "a", 2),
    # gap
    row(3, 2, "lesechat", "user", "q", 0), row(4, 2, "lesechat", "ai", "a", 2),
    # starts at 2
    row(5, 3, "lesechat", "user", "q", 2), row(6, 3, "lesechat", "ai", "a", 3),
    # repeated place
    row(7, 4, "lesechat", "user", "q", 0), row(8, 4, "lesechat", "ai", "a", 0),
    # lacks a reply before the next question; blank answer
    row(9, 5, "lesechat", "user", "q", 0), row(10, 5, "lesechat", "ai", " \u00a0\n", 1), row(11, 5, "lesechat", "user", "q", 2), row(12, 5, "lesechat", "ai", "a", 3),
    # empty: the human says nothing
    row(13, 6, "lesechat", "user", None, 0), row(14, 6, "lesechat", "ai", "a", 1),
    # good chain in no order
    row(17, 7, "treetalk", "ai", "a", None, 16), row(16, 7, "treetalk", "you said", "q", None, 15), row(15, 7, "treetalk", "system", "s", None, None),
    # fork, missing parent, ring, two starts
    row(20, 8, "treetalk", "user", "q"), row(21, 8, "treetalk", "ai", "a", None, 20), row(22, 8, "treetalk", "ai", "b", None, 20),
    row(23, 9, "treetalk", "user", "q"), row(24, 9, "treetalk", "ai", "a", None, 999),
    row(25, 10, "treetalk", "user", "q"), row(26, 10, "treetalk", "ai", "a", None, 27), row(27, 10, "treetalk", "ai", "a", None, 26),
    row(28, 11, "treetalk", "user", "q"), row(29, 11, "treetalk", "ai", "a"),
    # time; null time
    row(30, 12, "pagechat", "user", "q", at=0), row(31, 12, "pagechat", "ai", "a", at=60 * 30),
    row(32, 13, "pagechat", "user", "q", at=0), row(33, 13, "pagechat", "ai", "a"),
    # unknown and blank speakers
    row(34, 14, "lesechat", "narrator", "q", 0), row(35, 14, "lesechat", "ai", "a", 1), row(36, 15, "lesechat", " ", "q", 0), row(37, 15, "lesechat", "ai", "a", 1),
    # no conversation, no message id
    row(38, None, "lesechat", "user", "q", 0), row(None, 16, "lesechat", "user", "q", 0), row(None, 16, "lesechat", "ai", "a", 1),
    # ends in a question
    row(40, 17, "pagechat", "user", "q", at=0), row(41, 17, "pagechat", "ai", "a", at=1), row(42, 17, "pagechat", "user", "q", at=2),
]
GOOD = {1, 7, 12, 16}


def test_left_out_and_turns(spark, alias):
    df = spark.createDataFrame(CASES, SCHEMA)
    m = C.messages(df, alias)
    assert {r[0] for r in C.left_out(m).collect()} == set(range(1, 18)) - GOOD
    t = C.rebuild(m)
    assert {r[0] for r in t.select("conv_id").distinct().collect()} == GOOD
    seven = [(r["turn"], r["speaker"]) for r in t.filter("conv_id = 7").orderBy("turn").collect()]
    assert seven == [(1, "system"), (2, "human"), (3, "assistant")]
    assert [r["turn"] for r in t.filter("conv_id = 1").orderBy("turn").collect()] == [1, 2]


def test_long_chains_by_doubling(spark, alias):
    rows = [row(100 + i, 1, "treetalk", "user" if i % 2 == 0 else "ai", "x", None, 99 + i if i else None) for i in range(37)]
    ring = [row(1000, 2, "treetalk", "user", "x"), *[row(1001 + i, 2, "treetalk", "ai", "x", None, 1001 + (i + 1) % 5) for i in range(5)]]
    m = C.messages(spark.createDataFrame(rows[::-1] + ring, SCHEMA), alias)
    by_join = {r["msg_id"]: r["place"] for r in C.chain_places(m, longest=3).collect()}
    by_array = {r["msg_id"]: r["place"] for r in C.chain_places(m).collect()}
    assert by_join == by_array == {100 + i: i for i in range(37)}


def test_empty_table(spark, alias):
    m = C.messages(spark.createDataFrame([], SCHEMA), alias)
    assert C.left_out(m).count() == 0 and C.rebuild(m).count() == 0
    assert C.calibrated_gap(m, ["conv_id"]) == float("inf")


def test_gap_between_two_heaps(spark):
    at, rows = T0, []
    for s in range(40):
        for k in range(10):
            at += timedelta(seconds=20 + (k * 7) % 30)
            rows.append((len(rows), 1, at))
        at += timedelta(hours=5 + s % 4)
    d = spark.createDataFrame(rows, "msg_id int, conv_id int, sent_at timestamp")
    gap = C.calibrated_gap(d, ["conv_id"])
    assert 60 < gap < 5 * 3600
    assert C.sessionize(d, ["conv_id"], gap).agg(F.max("session")).first()[0] == 39


def test_a_hot_conversation_runs_through_many_tasks(spark, alias):
    """Stretches of one conversation in several tasks give the same verdict,
    sessions and turns as the conversation in one."""
    def rows(c, p, roles, repeat=None, hole=None, every=1):
        at, out = 0, []
        for i, r in enumerate(roles):
            at += every if i % 100 else 6000
            k = i if hole is None or i < hole else i + 1
            k = k - 1 if repeat is not None and i == repeat else k
            out.append(row(c * 10**6 + i, c, p, r, "x", k if p == "lesechat" else None, None, at))
        return out

    turns = ["user", "ai"] * 1500
    data = rows(1, "lesechat", turns) + rows(2, "pagechat", turns) + rows(3, "lesechat", turns, repeat=1501) + rows(4, "lesechat", turns, hole=1700) + rows(5, "pagechat", turns[:1999] + ["user"] + turns[2000:]) + rows(6, "pagechat", [*turns, "user"])
    df = spark.createDataFrame(data, SCHEMA)
    m = C.messages(df, alias)
    width = spark.conf.get("spark.sql.shuffle.partitions")
    got = {}
    for n in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            v = {r["conv_id"]: (r["n"], r["sessions"], r["broken"], r["empty"], r["lacks_reply"]) for r in C.verdicts(m, 3600.0).collect()}
            t = [(r["conv_id"], r["turn"], r["msg_id"]) for r in C.rebuild(m).orderBy("conv_id", "turn").collect()]
            parts = C.stretches(m, 3600.0).groupBy("conv_id").count().agg(F.max("count")).first()[0]
            got[n] = (v, t, C.calibrated_gap(m, ["conv_id"]))
            assert (parts > 1) == (n == "40")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", width)
    assert got["1"] == got["40"]
    v, t, _ = got["1"]
    assert v[1] == (3000, 30, False, False, False) and {c for c, x in v.items() if not any(x[2:])} == {1, 2}
    assert [x[1] for x in t if x[0] == 2] == list(range(1, 3001))
    assert [x[2] for x in t if x[0] == 1] == [10**6 + i for i in range(3000)]
