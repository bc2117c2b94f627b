"""Turns of all platforms."""

from datetime import datetime, timedelta

from lectern.operators import ordered as O
from lectern.plans import texts

T0 = datetime(2025, 1, 1)
SCHEMA = "msg_id bigint, conv_id bigint, platform string, speaker string, content string, seq int, parent_msg_id bigint, sent_at timestamp, loaded_at timestamp"


def row(m, c, p, s, t, seq=None, up=None, at=None):
    return (m, c, p, s, t, seq, up, None if at is None else T0 + timedelta(minutes=at), T0)


ROWS = [
    row(2, 1, "lesechat", "**[User]**", "q", 0), row(1, 1, "lesechat", "ai", "a", 1), row(1, 1, "lesechat", "ai", "a", 1), row(3, 1, "lesechat", "ai", "late"),
    # a chain against the numbers, a fork and a lost parent
    row(12, 2, "treetalk", "(user)", "q"), row(11, 2, "treetalk", "ai", "a", up=12), row(10, 2, "treetalk", "user", "r", up=11),
    row(20, 3, "treetalk", "user", "q", at=0), row(21, 3, "treetalk", "ai", "a1", up=20, at=1), row(23, 3, "treetalk", "ai", "a2", up=20, at=2), row(24, 3, "treetalk", "user", "t", up=21, at=3), row(25, 3, "treetalk", "user", "z", up=99, at=4),
    # a ring
    row(30, 4, "treetalk", "user", "q", up=31), row(31, 4, "treetalk", "ai", "a", up=30),
    row(42, 5, "pagechat", "user", "q", at=0), row(41, 5, "pagechat", "ai", "a", at=5), row(40, 5, "pagechat", "ai", "n"),
    row(None, 6, None, "user", "x", at=1), row(None, 6, None, "user", "y", at=2), row(50, None, "pagechat", "user", "q", at=0),
]


def test_every_platform_has_its_turns(spark, tmp_path):
    alias = spark.createDataFrame([("user", "human"), ("ai", "assistant")], "alias_form string, speaker_role string")
    m = spark.createDataFrame(ROWS, SCHEMA)
    got: dict = {}
    for r in O.turns(m, alias).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["content"], r["turn"], r["speaker"][0]))
    assert got == {
        1: [("q", 0, "h"), ("a", 1, "a"), ("late", 2, "a")], 2: [("q", 0, "h"), ("a", 1, "a"), ("r", 2, "h")], 3: [("q", 0, "h"), ("a1", 1, "a"), ("t", 2, "h"), ("a2", 3, "a"), ("z", 4, "h")],
        4: [("q", 0, "h"), ("a", 1, "a")], 5: [("q", 0, "h"), ("a", 1, "a"), ("n", 2, "a")], 6: [("x", 0, "h"), ("y", 1, "h")],
    }
    m.write.parquet(f"{tmp_path}/chat_messages.parquet")
    alias.write.parquet(f"{tmp_path}/speaker_alias.parquet")
    for name in ("tx4_exchanges_all", "tx4_dialogue", "sc31_flat_all", "ex24_markdown_all"):
        assert {r[0] for r in texts.QUERIES[name](spark, str(tmp_path)).select("conv_id").distinct().collect()} == {1, 2, 3, 4, 5, 6}, name
