import pytest

from lectern.llm import markup as M

CASES = [
    ("", set()), (None, set()), ("  \n ", set()), ("Plain prose. Nothing here.", set()), ("Lot #3 & lot #4 cost $5 to $12 each.", set()), ("For a < b and c > d it holds, x<y or y>x.", set()), ("It took 2 * 3 * 4 days (see [12]).", set()), ("The file read_me_first, C\\texts and note ** below.", set()),
    ("<p>One</p>", {"other"}), ("<h2>Head</h2><p>x</p>", {"heading", "other"}), ("# Head\n\ntext here.", {"heading"}), ("Head\n====\n\ntext.", {"heading"}), ("== Head ==\n\ntext.", {"heading"}), ("\\section{Head}\n\ntext.", {"heading"}),
    ("- a\n- b", {"list"}), ("# a b\n# c d\n# e", {"list"}), ("1. a\n2. b\n\nend.", {"list"}), ("<ul><li>a</li><li>b</li></ul>", {"list"}), ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", {"list"}),
    ("```\nx < 3 && y\n```", {"code"}), ("text.\n\n    def f():\n        return 1\n\nend.", {"code"}), ("<pre>a &lt; b</pre>", {"code"}), ("<source>a*b*c</source>", {"code"}), ("\\begin{verbatim}\n# no heading\n\\end{verbatim}", {"code"}), ("```\nopen to the end", {"code"}),
    ("$x^2$", {"formula"}), ("$$\na+b\n$$", {"formula"}), ("\\(a\\)", {"formula"}), ("<math>x_1</math>", {"formula"}), ("words \\(a\\) words.", {"formula"}), ("\\begin{equation}\na\n\\end{equation}", {"formula"}),
    ("a **b** c", {"other"}), ("a *b* c", {"other"}), ("a ~~b~~ c", {"other"}), ("a [b](c.md) d", {"other"}), ("> quoted", {"other"}), ("''a'' b", {"other"}), ("[[P|a]] b", {"other"}), ("a<ref>{{cite|p=1}}</ref> b", {"other"}), ("a~\\cite{k} b", {"other"}), ("\\emph{a} b", {"other"}), ("``a'' b", {"other"}), ("a&nbsp;b", {"other"}), ("a<!-- c --> b", {"other"}), ("<style>p {}</style>text", {"other"}),
    ("&lt;p&gt;One &amp;ldquo;two&amp;rdquo;&lt;/p&gt;", {"other"}), ("&lt;h2&gt;H&lt;/h2&gt;&lt;ul&gt;&lt;li&gt;a&lt;/li&gt;&lt;/ul&gt;", {"heading", "list"}),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_kinds(text, want):
    assert M.analyse(text)[1] == want


def test_clean_text_shows_structure():
    t = "<h2>A <b>b</b></h2><p>One &amp; <i>two</i>.</p><ul><li>x</li><li>y</li></ul><pre><code>p &lt; q</code></pre>\\(z\\)"
    assert M.render(M.analyse(t)[0]) == "## A b\n\nOne & two.\n\n- x\n- y\n\n```\np < q\n```\n\n$z$"


def test_prose_is_left_as_it_is():
    t = "Lot #3 & lot #4 cost $5 to $12 each.\n\nA second one."
    assert M.render(M.analyse(t)[0]) == t


def test_lines_and_formulas_stay_in_their_paragraph():
    t = "One line\nand \\(x\\) more.\n\nNew."
    assert M.render(M.analyse(t)[0]) == "One line\nand $x$ more.\n\nNew."
    assert M.prose(M.analyse(t)[0]) == "One line\nand more.\n\nNew."


def test_held_out_accuracy():
    """Documents composed with another seed than the training table's."""
    good = total = 0
    for text, letters in M.composed(400, seed=99):
        got = M.classify(M.flatten(text)[0])
        want = [M._LETTER[c] for c in letters]
        total += len(want)
        good += sum(a == b for a, b in zip(got, want))
    assert good / total > 0.97


def test_long_text_is_linear():
    assert len(M.analyse("*a* _b_ `c` $ 5 " * 20_000)[0]) == 1


def test_rows(spark):
    df = spark.createDataFrame([("a", "# h", "x"), (None, "- l", "x"), ("b", None, "x")], "source_id string, comments_html string, kind string")
    assert sorted((r[0] or "", r[1]) for r in M.kinds(df).collect()) == [("", "list"), ("a", "heading")]
    assert M.clean(df).count() == 3 and M.kinds(df.limit(0)).count() == 0


def test_the_tree_asks_for_words_and_links_of_blocks_and_neighbours():
    u = M.used(M.tree())
    assert u.get("words") and u.get("links")
    assert u.get("p_words", 0) + u.get("n_words", 0) and u.get("p_links", 0) + u.get("n_links", 0)


LONG = "The long account of the winter in which the river froze was read aloud by the keeper"
DECIDED = [
    # the same sign, told apart by the words around it
    (f"{LONG}\n- as they say - until the evening\n{LONG}", ["prose"] * 3), ("Contents:\n- the old bridge", ["prose", "list"]),
    (f"{LONG}\n12. of March in that year\n{LONG}", ["prose"] * 3), ("Contents:\n1. the old bridge", ["prose", "list"]),
    ("Short title\n-----------", ["heading", "prose"]), (f"{LONG} and {LONG} {LONG}\n-----", ["prose", "prose"]),
    (f"It was $12 for {LONG} and then 9$ more", ["prose"] * 3), ("So $x + y$ holds", ["prose", "formula", "prose"]),
    # the same links, told apart by their words and neighbours
    ("[Home](a.md)\n[About us](b.md)\n[Index](c.md)", ["menu"] * 3), ("[Home](a.md)", ["prose"]), (f"[{LONG}](a.md)\n[{LONG}](b.md)", ["prose"] * 2),
    ("see [Home](a.md) too.\nAs in [Index](c.md) below", ["prose"] * 2),
]


@pytest.mark.parametrize(("text", "want"), DECIDED)
def test_words_and_links_decide(text, want):
    assert [M.KINDS[k] for k in M.classify(M.flatten(text)[0])] == want


def test_nested_signs_vanish_at_any_depth():
    deep = "\\emph{" * 300 + "deep" + "}" * 300
    assert M.strip_inline(deep) == ("deep", True)
    assert M.strip_inline("a **b *c* ~~d~~** [e [f](g.md)](h.md)")[0] == "a b c d e f"
    assert M.strip_inline("{{cite|{{p|{{q}}}}}}x \\footnote{a \\emph{b} c}y") == ("x y", True)
    assert M.strip_inline("a \\*no\\* {b} \\x{open")[0] == "a *no* {b} \\x{open"
    assert len(M.strip_inline("\\emph{" * 100_000)[0]) == 600_000


def test_menus_are_left_out_of_the_clean_text_and_links_in_prose_are_not():
    t = f"{LONG}.\n\n[Home](a.md)\n[About us](b.md)\n[Index](c.md)\n\n{LONG} [as linked](d.md)."
    blocks, kinds = M.analyse(t)
    assert kinds == {"other"} and M.render(blocks) == f"{LONG}.\n\n{LONG} as linked."
