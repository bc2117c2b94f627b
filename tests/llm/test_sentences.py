import random
import time

import pytest

from lectern.llm import sentences as S


def parts(t):
    return [t[a:b] for a, b in S.units(t)]


CASES = [
    ("", []), (None, []), (" \n\t\u00a0", []), ("One. Two!", ["One.", "Two!"]), ("Dr. Lee met Mrs. Fox on p. 3. They left.", ["Dr. Lee met Mrs. Fox on p. 3.", "They left."]), ("It is 3.14 cm, i.e. less. Next.", ["It is 3.14 cm, i.e. less.", "Next."]),
    ("“It is lost!” cried the clerk, and left. Next.", ["“It is lost!” cried the clerk, and left.", "Next."]), ("“Who is it?” asked Prof. Ott. He came.", ["“Who is it?” asked Prof. Ott.", "He came."]), ("“One here. Two here.” Three.", ["“One here.", "Two here.”", "Three."]),
    ("(A whole one.) Next one.", ["(A whole one.)", "Next one."]), ("He came ... and left. He ended... Then more.", ["He came ... and left.", "He ended...", "Then more."]), ("The first ends.The second goes.", ["The first ends.", "The second goes."]),
    ("1. A heading\n\nText here. More\ntext.", ["1. A heading", "Text here.", "More\ntext."]), ("Am 9. März kam er. Dann ging er.", ["Am 9. März kam er.", "Dann ging er."]), ("Er kam z.\u00a0B. nicht. Tinte usw. Dann ging er.", ["Er kam z.\u00a0B. nicht.", "Tinte usw.", "Dann ging er."]),
    ("„Wer kommt?“, fragte Prof. Ott. Er kam.", ["„Wer kommt?“, fragte Prof. Ott.", "Er kam."]), ("»Er kommt«, schrieb Fr. Lee in Bd. 5. Dann.", ["»Er kommt«, schrieb Fr. Lee in Bd. 5.", "Dann."]), ("« Qui vient ? » demanda M. Roux. Il vint.", ["« Qui vient ? » demanda M. Roux.", "Il vint."]),
    ("«Кто идёт?» — спросил г-н Орлов. Он пришёл.", ["«Кто идёт?» — спросил г-н Орлов.", "Он пришёл."]), ("В 96 г. реестр пропал и т. д. Позже он нашёлся.", ["В 96 г. реестр пропал и т. д.", "Позже он нашёлся."]), ("Ποιος ήρθε; Ο κ. Μαρής ήρθε, βλ. σ. 5. Τέλος.", ["Ποιος ήρθε;", "Ο κ. Μαρής ήρθε, βλ. σ. 5.", "Τέλος."]),
    ("谁来了？他来了。“谁走了？”王明问道。他走了……然后也是如此。", ["谁来了？", "他来了。", "“谁走了？”王明问道。", "他走了……然后也是如此。"]), ("彼が来た。「誰が来たか。」と彼は尋ねた。終わり！", ["彼が来た。", "「誰が来たか。」と彼は尋ねた。", "終わり！"]), ("قال د. سالم نعم. «من جاء؟» سأل علي. انتهى.", ["قال د. سالم نعم.", "«من جاء؟» سأل علي.", "انتهى."]),
    ("वह आया। डॉ. राम पृ. 5 पर हैं। यह 5.2 से.मी. लंबा है।", ["वह आया।", "डॉ. राम पृ. 5 पर हैं।", "यह 5.2 से.मी. लंबा है।"]), ("เขามาแล้ว ใครไป ดร.สมชายยาว5.2เซนติเมตร", ["เขามาแล้ว", "ใครไป", "ดร.สมชายยาว5.2เซนติเมตร"]), ("เขามาแล้ว The man came. He left.", ["เขามาแล้ว", "The man came.", "He left."]),
    ("See www.a.example/p.3 now. Version 2.1.9 is out.", ["See www.a.example/p.3 now.", "Version 2.1.9 is out."]), ("Line one\r\ngoes on.\r\n \r\nNew block", ["Line one\r\ngoes on.", "New block"]), ("J. K. Lee et al. noted it. Was it?! Yes.", ["J. K. Lee et al. noted it.", "Was it?!", "Yes."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_units(text, want):
    assert parts(text) == want


def test_units_are_apart_and_cover():
    for text, _ in CASES:
        u, t = S.units(text), text or ""
        assert all(a < b for a, b in u) and all(x[1] <= y[0] for x, y in zip(u, u[1:]))
        covered = "".join(t[a:b] for a, b in u)
        assert "".join(covered.split()) == "".join(t.split())
        assert all(not t[a].isspace() and not t[b - 1].isspace() for a, b in u)


def test_long_texts_and_runs():
    assert len(S.units("A sentence is here. " * 20_000)) == 20_000
    assert len(S.units("x" * 300_000)) == 1
    assert len(S.units("?! " * 5000)) >= 1


def test_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "x"), (2, None, "x"), (None, "Z z.", "x"), (1, "A b. C d.", "x")], "doc_id bigint, text string, sent_start string")
    assert S.split(df).count() == 5
    assert sorted(r["sentence"] for r in S.split(df, with_text=True).filter("doc_id = 1").collect()) == ["A b.", "A b.", "C d.", "C d."]
    assert S.split(df.limit(0)).count() == 0


def _all_ways(lo, hi, places, events):
    """The search without its bound: every start at every place."""
    starts, ends, gain = [lo, *[p[1] for p in places]], [*[p[0] for p in places], hi], [*[p[2] for p in places], 0.0]
    best, back = [0.0], []
    for j, e in enumerate(ends):
        top, frm = -1e18, 0
        for i in range(j, -1, -1):
            a, open_ = starts[i], 0.0
            for at, opened, cost in events:
                if a <= at < e:
                    open_ += -cost if at != opened and opened >= a else cost
            v = best[i] - S.span_cost(e - a, open_)
            if v > top:
                top, frm = v, i
        best.append(top + gain[j])
        back.append(frm)
    spans, j = [], len(ends)
    while j:
        spans.append((starts[back[j - 1]], ends[j - 1]))
        j = back[j - 1]
    return spans[::-1]


def test_the_bound_is_exact():
    rng = random.Random(3)
    for _ in range(300):
        at, places = 0, []
        for _ in range(rng.randint(1, 14)):
            at += rng.choice((1, 2, 9, 80, 700))
            places.append((at, at + 1, rng.choice((-12, -4.5, -2, -1, -0.5, 0, 0.5, 1, 2, 4, 7))))
            at += 1
        hi = at + rng.choice((1, 30))
        events = []
        for _ in range(rng.randint(0, 5)):
            a, b = sorted(rng.sample(range(hi), 2))
            cost = rng.choice((S.BRACKET_COST, S.QUOTE_COST))
            events += [(a, a, cost), (b, a, cost)]
        events.sort()
        assert S.search(0, hi, places, events) == _all_ways(0, hi, places, events)


def test_every_place_reaches_the_search(monkeypatch):
    seen = []
    whole = S.search
    monkeypatch.setattr(S, "search", lambda lo, hi, places, events: seen.append(len(places)) or whole(lo, hi, places, events))
    text = "Dr. Lee came at 3.14 p.m. (see p. 5). He left! “Who?” asked Mr. Fox. End."
    S.units(text)
    assert seen == [len([m for m in S.CANDIDATE.finditer(text) if m.end() < len(text)])]


def test_parts_of_a_span_decide_jointly():
    # the same mark between the same words: closed brackets let it end, open ones do not
    places = [(10, 11, 3.0)]
    assert S.search(0, 20, places, []) == [(0, 10), (11, 20)]
    assert S.search(0, 20, places, [(5, 5, S.BRACKET_COST), (15, 5, S.BRACKET_COST)]) == [(0, 20)]
    # a doubtful end counts in a span that is far too long, and not in a short one
    assert S.search(0, 1200, [(600, 601, -0.3)], []) == [(0, 600), (601, 1200)]
    assert S.search(0, 200, [(100, 101, -0.3)], []) == [(0, 200)]
    # a unit of one character is dearer than a doubtful end is worth
    assert S.search(0, 50, [(1, 2, 2.0)], []) == [(0, 50)]


@pytest.mark.parametrize("text", ["a." * 60_000, "(" * 40_000 + ". A" + ")" * 40_000, "(]" * 40_000, "“A. " * 20_000, "x" * 100_000 + ". A" * 20_000, "1." * 50_000, "w.w/" * 30_000, "a@b." * 30_000, "Dr. Lee " * 20_000])
def test_work_grows_with_the_text(text):
    t = time.process_time()
    S.units(text)
    assert time.process_time() - t < 6
