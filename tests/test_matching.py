"""The matcher against a plain pass over all pairs."""

import random

from lectern.operators import catalogue as C

BOOKS = "source_id string, title string, authors array<string>, identifiers map<string,string>"
ITEMS = "item string, code string, title string, author string"


def test_exact_title_needs_a_compatible_author(spark):
    b = spark.createDataFrame([("b1", "Letters", ["Adams"], None), ("b2", "Letters", ["Zimmer, Ute"], None), ("b3", "Songs", None, None)], BOOKS)
    i = spark.createDataFrame([("i1", None, "Letters", "zimmer"), ("i2", None, "Letters", None), ("i3", None, "Songs", "Anyone"), ("i4", None, "", "Adams"), ("i5", None, None, "Adams")], ITEMS)
    assert {r["item"]: (r["book"], r["how"]) for r in C.match(i, b).collect()} == {"i1": ("b2", "exact"), "i2": ("b1", "exact"), "i3": ("b3", "exact")}


def test_titles_alone_where_an_author_is_empty(spark):
    b = spark.createDataFrame([("b1", "Storms of the harbour", None, None)], BOOKS)
    i = spark.createDataFrame([("i1", None, "Storms of the harbor", "Kant"), ("i2", None, "Storms of the harbor", None)], ITEMS)
    assert {r["item"]: (r["book"], r["how"]) for r in C.match(i, b).collect()} == {"i1": ("b1", "fuzzy"), "i2": ("b1", "fuzzy")}


def test_short_words_and_scripts_without_blanks(spark):
    b = spark.createDataFrame([("b1", "To be or not", ["Ann"], None), ("b2", "彩色玻璃的贸易", ["Li"], None)], BOOKS)
    i = spark.createDataFrame([("i1", None, "To be or nt", "Ann"), ("i2", None, "彩色玻璃贸易", "Li")], ITEMS)
    assert {r["item"]: r["book"] for r in C.match(i, b).collect()} == {"i1": "b1", "i2": "b2"}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _like(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return round(100 * (1 - _distance(a, b) / max(len(a), len(b), 1)), 4)


def test_no_pair_is_lost(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abco") for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(r.randint(1, n)))
    books = [(f"b{k:02}", text(4), [text(2)] if r.random() < 0.8 else None, None) for k in range(60)]
    items = [(f"i{k}", None, text(4), text(2) if r.random() < 0.8 else None) for k in range(60)]
    b, i = spark.createDataFrame(books, BOOKS), spark.createDataFrame(items, ITEMS)
    for least in (90.0, 80.0, 60.0, 20.0):
        want = {}
        for it, _, t, a in items:
            pairs = [(k, bt, (ba or [""])[0]) for k, bt, ba, _ in books]
            exact = [k for k, bt, ba in pairs if bt == t and ((a or "") in ba or ba in (a or ""))]
            score = lambda bt, ba: round(0.7 * _like(t, bt) + 0.3 * _like(a, ba), 4) if a and ba else _like(t, bt)
            top = max((score(bt, ba), k) for k, bt, ba in pairs)
            if exact:
                want[it] = (min(exact), 100.0, "exact")
            elif top[0] >= least:
                want[it] = (top[1], top[0], "fuzzy")
        got = {x["item"]: (x["book"], round(x["score"], 4), x["how"]) for x in C.match(i, b, least).collect()}
        assert got == want, least


def test_codes_and_editions(spark):
    b = spark.createDataFrame([("b1", "Letters", ["Adams"], {"asin": "B00X1"}), ("b2", "Storms", ["Berg"], None)], BOOKS)
    i = spark.createDataFrame([("i1", "b00x1", "Another title", "Nobody"), ("i2", "none", "Storms (German Edition)", "berg"), ("i3", None, "Storms (2nd  Reading Edition) ", None), ("i4", None, "Storms (Edition of 1800)", None)], ITEMS)
    got = {r["item"]: (r["book"], r["how"]) for r in C.match(i, b).collect()}
    assert got == {"i1": ("b1", "code"), "i2": ("b2", "exact"), "i3": ("b2", "exact")}


def test_other_authors_are_compared_only_where_they_may_win(spark):
    name = lambda k: f"{'abcdefghij'[k % 10] * 5}{'klmnopqrst'[k // 10 % 10] * 5} person"
    books = spark.createDataFrame([("storms the", name(k), f"b{k:02}") for k in range(60)], "bt string, ba string, book string")
    people = spark.createDataFrame([("storms thex", name(k)) for k in range(60)], "t string, a string")
    near = spark.createDataFrame([("storms thex", "storms the", 90.9091)], "t string, bt string, likeness double")
    got = C.contenders(people, near, books).collect()
    assert sorted((r["a"], r["book"], r["score"]) for r in got) == sorted((name(k), f"b{k:02}", 93.6364) for k in range(60))


def test_a_book_of_no_author_ties_with_one_of_the_same(spark):
    b = spark.createDataFrame([("b1", "Harbour storms", ["John Adams"], None), ("b2", "Storms harbour", None, None), ("b3", "Harbour storm", ["John Adams"], None)], BOOKS)
    i = spark.createDataFrame([("i1", None, "Storms Harbour", "Adams John"), ("i2", None, "Harbour stormsx", "Adams John")], ITEMS)
    assert {r["item"]: (r["book"], r["score"], r["how"]) for r in C.match(i, b).collect()}["i2"] == ("b1", 95.3333, "fuzzy")
    i = spark.createDataFrame([("i1", None, "Harbour, storms of", "Adams John")], ITEMS)
    b = spark.createDataFrame([("b1", "of storms harbour", ["John Adams"], None), ("b2", "storms of harbour", None, None)], BOOKS)
    assert [tuple(r) for r in C.match(i, b).collect()] == [("i1", "b2", 100.0, "fuzzy")]
