import random

import pytest

from lectern.llm import pieces as P

TEXTS = [
    "", "short", "x" * 1600, "x" * 1601, "word " * 900, "A sentence stands here. " * 300, "para one is here.\n\n" * 200, "漢字が続く。" * 900, "ไทยไม่มีช่องว่าง" * 400, "a" + "\u0301" * 4000, "👩‍🏫" * 1500, "one, two; three: four " * 400 + "y" * 5000, "\n\n".join("z" * n for n in (10, 1700, 30, 1590, 5)),
]


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_cover_and_fit(text):
    got = P.split_text(text)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= P.LIMIT for a, b in got)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d  # they overlap or touch, and go on
        assert b - c <= P.OVERLAP
        if b - c < P.OVERLAP:  # fewer only to keep a word whole
            assert all(not ch.isspace() for ch in text[b - P.OVERLAP : c - 1]) or P.GLUED.match(text[b - P.OVERLAP])


def test_balanced_and_at_sentences():
    text = "This is a sentence of some words. " * 200
    got = P.split_text(text.strip())
    new = [b - a for (a, _), b in zip([(0, 0), *[(x[1], 0) for x in got]], [x[1] for x in got])]
    assert max(new) - min(new) < 200
    assert all(text[b - 1] == "." for _, b in got)


def test_random_round_trip():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1601, 9000)
        text = "".join(rng.choice("ab c.d\n,é漢") for _ in range(n)).strip(P.OUTER) or "x"
        got = P.split_text(text)
        out = text[: got[0][1]]
        for (_, b), (c, d) in zip(got, got[1:]):
            out += text[b:d]
        assert out == text


SCHEMA = "id string, text string, char_start double, char_end double, indexed_at string, vector string, piece string, base string"


def test_rows(spark):
    long = "Words of a text. " * 200
    rows = [
        ("old", long, 0.0, 0.0, "2024-01-01T00:00:00.0", None, "clash", "clash"), ("old", "short now", 0.0, 9.0, "2024-02-01T00:00:00.0", None, None, None), ("twice", long, 10.0, 10.0 + len(long), "2024-01-01T00:00:00.0", None, None, None),
        ("twice", long, 10.0, 10.0 + len(long), "2024-01-01T00:00:00.0", None, None, None), ("blank", " \t\r\n" * 900, None, None, "2024-01-01T00:00:00.0", None, None, None), ("null", None, None, None, None, None, None, None), (None, long, None, None, None, None, None, None),
        ("edge", "  " + "y" * 1600 + "\n", None, None, "2024-01-01T00:00:00.0", None, None, None), ("wrong", "\n " + long, 5.0, 6.0, "2024-01-01T00:00:00.0", None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = P.split(P.oversized(df)).orderBy("id", "piece").collect()
    assert {r["id"] for r in got} == {"twice", "wrong"}
    a = [r for r in got if r["id"] == "twice"]
    assert a[0]["char_start"] == 10 and a[-1]["char_end"] == 10 + len(long.strip())
    assert all(r["text"] == long[r["char_start"] - 10 : r["char_end"] - 10] for r in a)
    b = [r for r in got if r["id"] == "wrong"]
    assert b[0]["char_start"] == 2  # offsets that contradict the text are not used
    assert P.split(P.oversized(df.limit(0))).count() == 0
