"""Clean text from HTML, Markdown, wiki and LaTeX remains.

A text is flattened into blocks: lines, cells, list items, code, formulas. Each
block has features of its own (word count, link density, the signs at its edges,
the element it stands in) and of its neighbours, and a decision tree trained on
a small labelled table says what it is: prose, heading, list, code, formula or
menu. Signs are read with the word counts and link densities around them: a line
after a dash is an item among items or after a short lead, and prose in the
midst of a long paragraph; a row of short link lines is a menu, a long linked
sentence is prose; a rule under a long line is no heading. Signs that stay
within a block's text (emphasis, links, notes, entities) are taken off after
that and count as ``other`` markup; a menu does so whole.

Defined results
---------------
null, empty and blank texts: empty clean text, no kinds; plain prose, with
signs of prose (``a < b``, ``#3``, ``$5``, ``R&D``): as it is, no kinds;
unclosed structures: to the end of the text; repeated rows: one; a document's
versions: the latest; an empty table: an empty result; extra columns: ignored.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.llm.tokens import _spread

KINDS = ("prose", "heading", "list", "code", "formula", "menu")

#: The elements that are known as tags; anything else in angle brackets is prose.
TAGS = "a abbr address article aside b big blockquote body br caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i img ins kbd li link main mark math meta mi mn mo mrow msup msub mfrac nav nowiki ol p pre q ref references s script section small source span strike strong style sub sup syntaxhighlight table tbody td tfoot th thead title tr tt u ul var".split()
_TAG = rf"</?(?:{'|'.join(sorted(TAGS, key=len, reverse=True))})(?:\s[^<>]*|\s*/)?>"
#: One pass over the text: what is cut out whole, then single signs.
SCAN = regex.compile(
    rf"""(?P<comment><!--.*?(?:-->|\Z))
    |(?P<drop><(?P<dn>style|script)\b[^>]*>.*?(?:</(?P=dn)\s*>|\Z))
    |(?P<pre><(?P<pn>pre|syntaxhighlight|source)\b[^>]*>(?P<pre_in>.*?)(?:</(?P=pn)\s*>|\Z))
    |(?P<fence>(?:(?<=\n)|(?<=\A))[ ]{{0,3}}(?P<fn>```+|~~~+)[^\n`]*\n(?P<fence_in>.*?)(?:\n[ ]{{0,3}}(?P=fn)[^\n]*(?=\n|\Z)|\Z))
    |(?P<verb>\\begin\{{(?P<vn>verbatim|lstlisting|Verbatim|minted|alltt)\}}(?:\[[^\]]*\])?(?P<verb_in>.*?)(?:\\end\{{(?P=vn)\}}|\Z))
    |(?P<env>\\begin\{{(?P<en>equation|align|gather|displaymath|eqnarray|math|multline)\*?\}}(?P<env_in>.*?)(?:\\end\{{(?P=en)\*?\}}|\Z))
    |(?P<math><math\b[^>]*>(?P<math_in>.*?)(?:</math\s*>|\Z))
    |(?P<mspan><span\s+class=["']?math[^>]*>(?P<mspan_in>.*?)</span\s*>)
    |(?P<brack>\\\[(?P<brack_in>.*?)\\\]|\\\((?P<paren_in>.*?)\\\))
    |(?P<dollars>\$\$(?P<dollars_in>[^$]+?)\$\$)
    |(?P<dollar>(?<![\\$\w])\$(?P<dollar_in>[^\s$](?:[^$\n]*[^\s$])?)\$(?![\w$]))
    |(?P<h><h(?P<hl>[1-6])\b[^>]*>(?P<h_in>.*?)(?:</h(?P=hl)\s*>|(?=<h[1-6]\b|<p\b|<div\b)|\Z))
    |(?P<tex>\\(?P<tl>part|chapter|section|subsection|subsubsection|paragraph)\*?\{{(?P<tex_in>[^{{}}\n]*)\}})
    |(?P<texlist>\\(?:begin|end)\{{(?:itemize|enumerate|description)\}}(?:\[[^\]]*\])?)
    |(?P<item>\\item\b(?:\[[^\]]*\])?[ \t]*)
    |(?P<htmllist></?(?:ul|ol|dl)\b[^>]*>)
    |(?P<li><(?:li|dt|dd)\b[^>]*>)
    |(?P<liend></(?:li|dt|dd)\s*>)
    |(?P<blocktag></?(?:p|div|br|blockquote|table|tbody|thead|tr|td|th|hr|section|article|body|html|head|title|center|figure|caption)\b[^<>]*>)
    |(?P<texenv>\\(?:begin|end)\{{[a-zA-Z]+\*?\}})
    |(?P<nl>\r?\n)""",
    regex.X | regex.S | regex.I,
)
INLINE = regex.compile(
    rf"""(?P<tag>{_TAG})
    |(?P<image>!\[(?P<image_in>[^\]\n]*)\]\([^()\s]*\))
    |(?P<link>\[(?P<link_in>[^\[\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s"[^"]*")?\))
    |(?P<wiki>\[\[(?:[^\[\]|\n]*\|)?(?P<wiki_in>[^\[\]|\n]*)\]\])
    |(?P<ext>\[https?://\S+\s(?P<ext_in>[^\]\n]*)\])
    |(?P<strong>\*\*(?=\S)(?P<strong_in>[^*\n]+?)(?<=\S)\*\*|(?<!\w)__(?=\S)(?P<strong2_in>[^\n]+?)(?<=\S)__(?!\w))
    |(?P<em>(?<![*\\])\*(?=[^\s*])(?P<em_in>[^*\n]*?)(?<=[^\s*])\*(?!\*)|(?<![\w_])_(?=[^\s_])(?P<em2_in>[^_\n]*?)(?<=[^\s_])_(?![\w_]))
    |(?P<strike>~~(?=\S)(?P<strike_in>[^~\n]+?)(?<=\S)~~)
    |(?P<wikiem>'{{2,5}}(?=[^'\s])(?P<wikiem_in>[^\n]+?)(?<=\S)'{{2,5}}(?!'))
    |(?P<texquote>``(?P<texquote_in>[^\n`]+?)'')
    |(?P<esc>\\[*_#\[\]`~$%&{{}}\\-])
    |(?P<tick>(?<!`)`(?P<tick_in>[^`\n]+)`(?!`))
    |(?P<tilde>(?<=\w)~(?=\w|\\))
    |(?P<entity>&(?:\#\d{{1,7}}|\#x[0-9a-f]{{1,6}}|[a-z]{{2,8}}\d?);)""",
    regex.X | regex.I,
)
ESCAPED = regex.compile(rf"&lt;(?:/?(?:{'|'.join(TAGS)})\b|!--)", regex.I)
REAL = regex.compile(_TAG, regex.I)
BULLET = regex.compile(r"[ \t]*([-+*•])[ \t]+(?=\S)")
NUMBER = regex.compile(r"[ \t]*\d{1,3}[.)][ \t]+(?=\S)")
HASHES = regex.compile(r"[ ]{0,3}(#{1,6})[ \t]+(?=\S)")
STARS = regex.compile(r"([*#:;]{1,4})[ \t]*(?=[^\s*#:;])")
FRAME = regex.compile(r"(={1,6})[ \t]*([^=\s].*?)[ \t]*\1[ \t]*$")
UNDER = regex.compile(r"[ ]{0,3}(?:=+|-{2,})[ \t]*$")
QUOTE = regex.compile(r"[ ]{0,3}>[ ]?")
#: Words; where they are not set apart, two ideographs or four Thai letters count for one.
WORDS = regex.compile(r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}]{1,2}|\p{Thai}{1,4}|[[\p{L}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]]+")
#: Braces and what opens them, for one pass with a stack.
BRACES = regex.compile(r"(?P<cmd>~?\\(?P<name>[a-zA-Z]+)\*?(?:\[[^\[\]]*\])*\{)|(?P<template>\{\{)|(?P<both>\}\})|(?P<open>\{)|(?P<shut>\})")
#: Commands whose content is a note or a reference and not text.
NOTES = regex.compile(r"(?:footnote|cite[a-z]*|ref|label|index|pageref|marginpar)$")
MATHY = regex.compile(r"[\\^_={}<>+|]|\\[a-z]+")


class Block:
    """A flat block: its text, the element or sign it stands in, whether a blank
    line or an element's edge comes before it, and how many line ends do (0: it
    goes on in the same line, 2: a new paragraph)."""

    __slots__ = ("text", "form", "blank", "gap", "level")

    def __init__(self, text: str, form: str, blank: bool, gap: int = 2, level: int = 0):
        self.text, self.form, self.blank, self.gap, self.level = text, form, blank, gap, level


#: Forms in which the scanner hands over a block.
FORMS = ("line", "h", "li", "pre", "math", "dollar")


def flatten(text: str) -> tuple[list[Block], bool]:
    """The flat blocks of a text, and whether markup was dropped on the way."""
    other = False
    if ESCAPED.search(text) and not REAL.search(text):
        text = html.unescape(text)
    blocks: list[Block] = []
    buf: list[str] = []
    state = {"form": "line", "blank": True, "depth": 0, "after": False, "gap": 2}

    def add(t: str, form: str, blank: bool, level: int = 0) -> None:
        blocks.append(Block(t, form, blank, state["gap"], level))
        state["gap"] = 0

    def flush(nl: bool = False) -> None:
        s = "".join(buf)
        buf.clear()
        if s.strip():
            add(s, state["form"], state["blank"])
            state["blank"] = False
        elif nl and state["after"]:
            state["blank"] = True

    at = 0
    for m in SCAN.finditer(text):
        if m.start() > at:
            buf.append(text[at : m.start()])
            state["after"] = False
        at = m.end()
        k = m.lastgroup
        kind = next(g for g in ("comment", "drop", "pre", "fence", "verb", "env", "math", "mspan", "brack", "dollars", "dollar", "h", "tex", "texlist", "item", "htmllist", "li", "liend", "blocktag", "texenv", "nl") if m.start(g) >= 0) if k not in _PLAIN else k
        if kind == "comment":
            other = True
        elif kind == "nl":
            flush(nl=True)
            state["gap"] = min(2, state["gap"] + 1)
            state["after"] = True
            if state["form"] == "li" and state["depth"] == 0:
                state["form"] = "line"
        elif kind == "drop":
            other = True
            flush()
        elif kind in ("pre", "fence", "verb"):
            flush()
            body = m[f"{kind}_in"] or ""
            if kind == "pre" or ESCAPED.search(body):
                body = _CODE_TAG.sub("", body)
                body = html.unescape(body)
            state["gap"] = 2
            add(body.strip("\n"), "pre", True)
            state["gap"] = 2
        elif kind in ("env", "math", "mspan", "brack", "dollars", "dollar"):
            body = next((m[g] for g in (f"{kind}_in", "brack_in", "paren_in") if g in _GROUPS and m[g] is not None), "")
            flush()
            add(html.unescape(REAL.sub("", body)).strip(), "dollar" if kind == "dollar" else "math", False)
        elif kind == "h":
            flush()
            add(_BARE_SPAN.sub(r"\1", m["h_in"]).strip(), "h", True, int(m["hl"]))
            state["gap"] = 2
        elif kind == "tex":
            flush()
            add(m["tex_in"], "h", True, {"part": 1, "chapter": 1, "section": 2, "subsection": 3}.get(m["tl"].lower(), 4))
            state["gap"] = 2
        elif kind in ("htmllist", "texlist"):
            flush()
            state["gap"] = 2
            closing = m[0].startswith("</") or m[0].startswith("\\end")
            state["depth"] = max(0, state["depth"] + (-1 if closing else 1))
            state["form"] = "line"
        elif kind in ("li", "item"):
            flush()
            state["gap"] = 2
            state["form"] = "li"
        elif kind == "liend":
            flush()
            state["gap"] = 2
            state["form"] = "line"
        else:
            other = True
            flush()
            if state["depth"] == 0 or m[0].startswith("</"):
                state["form"] = "line" if state["depth"] == 0 else state["form"]
            state["blank"] = True
            state["gap"] = 2
    if at < len(text):
        buf.append(text[at:])
    flush()
    return _indented(blocks), other


_PLAIN = {"comment", "nl", "liend", "li", "item", "blocktag", "htmllist", "texlist", "texenv"}
_GROUPS = set(SCAN.groupindex)
_CODE_TAG = regex.compile(r"</?code\b[^>]*>", regex.I)
_HASH_END = regex.compile(r"\s+#+\s*$")
_ITEM_SIGN = regex.compile(r"^[ \t]*(?:[-+*•#:;]+|\d{1,3}[.)])[ \t]*")
_ROW = regex.compile(r"\s*(?:\{\||\|)")
_ROW_SIGN = regex.compile(r"^\s*(?:\{\|[^\n]*|\|\}|\|-+|\|)|\|\s*$|(?<=\s)\|(?=\s)")
_BARE_SPAN = regex.compile(r"<span>(.*?)</span>", regex.I | regex.S)


def _indented(blocks: list[Block]) -> list[Block]:
    """Lines indented by four blanks after a blank line, drawn together."""
    out: list[Block] = []
    for b in blocks:
        deep = b.form == "line" and (b.text.startswith("    ") or b.text.startswith("\t"))
        if deep and out and out[-1].form == "indent" and not b.blank:
            out[-1].text += "\n" + b.text[4:]
        elif deep and b.blank:
            out.append(Block(b.text[4:], "indent", True))
        else:
            out.append(b)
    return out


#: Features of a block; ``p_`` and ``n_`` are those of the block before and after.
FEATURES = (
    "is_h", "is_li", "is_pre", "is_math", "is_dollar", "is_indent", "bullet", "number", "hashes", "stars", "frame", "under", "next_under",
    "p_bullet", "n_bullet", "p_number", "n_number", "p_hash", "n_hash", "blank", "words", "links", "p_words", "n_words", "p_links", "n_links", "mathy", "upper", "stop",
)


LINK = regex.compile(r"\[(?P<md>[^\[\]\n]*)\]\([^()\s]*\)|\[\[(?:[^\[\]|\n]*\|)?(?P<wiki>[^\[\]|\n]*)\]\]|\[https?://\S+\s(?P<ext>[^\]\n]*)\]|<a\b[^>]*>(?P<html>.*?)</a>", regex.I | regex.S)


def link_density(t: str) -> float:
    """Characters of a block's text that stand within links, of all that are seen."""
    if "[" not in t and "<a" not in t and "<A" not in t:
        return 0.0
    inner = signs = 0
    for m in LINK.finditer(t):
        n = len(m["md"] or m["wiki"] or m["ext"] or m["html"] or "")
        inner += n
        signs += m.end() - m.start() - n
    return inner / max(1, len(t.strip()) - signs)


def features(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    x = np.zeros((n, len(FEATURES)), dtype=np.float32)
    words, links, bullet, number, hashed, under = (np.zeros(n + 2, dtype=np.float32) for _ in range(6))
    near = [b.blank for b in blocks] + [True]
    for i, b in enumerate(blocks, 1):
        t = b.text
        words[i] = len(WORDS.findall(t)) if b.form != "pre" else len(t) / 6
        links[i] = link_density(t)
        line = b.form == "line"
        bullet[i] = line and bool(BULLET.match(t))
        number[i] = line and bool(NUMBER.match(t))
        hashed[i] = line and (len(m[1]) if (m := HASHES.match(t)) else 0)
        under[i] = line and bool(UNDER.match(t))
    for i, b in enumerate(blocks):
        k, t = i + 1, b.text
        body = t.lstrip(" \t#*-+=0123456789.)")
        joined_up, joined_down = not near[i], not near[i + 1] if i + 1 < n else False
        x[i] = (
            b.form == "h", b.form == "li", b.form == "pre", b.form == "math", b.form == "dollar", b.form == "indent",
            bullet[k], number[k], hashed[k], bool(b.form == "line" and t[:2] in ("**", "##") and STARS.match(t)), bool(b.form == "line" and FRAME.match(t.strip())), under[k], under[k + 1] if joined_down else 0,
            bullet[k - 1] if joined_up else 0, bullet[k + 1] if joined_down else 0, number[k - 1] if joined_up else 0, number[k + 1] if joined_down else 0,
            hashed[k - 1] if joined_up else 0, hashed[k + 1] if joined_down else 0,
            b.blank, words[k], links[k], words[k - 1], words[k + 1], links[k - 1], links[k + 1],
            len(MATHY.findall(t)) / max(1, len(t)), body[:1].isupper(), t.rstrip()[-1:] in ".!?。！？।",
        )
    return x


# ---- the decision tree --------------------------------------------------------------------------
#: The labelled table: texts whose blocks bear, in order, the given letters
#: (p prose, h heading, l list, c code, f formula).
LABELLED = (
    ("<h2>On bees</h2><p>Bees fly far. They come home.</p><ul><li>honey</li><li>wax and wood</li></ul><pre>x = 1\ny = 2</pre>\\(a+b\\)<p>So it ends.</p>", "hpllcfp"),
    ("# On bees\n\nBees fly far and come home late.\n\n- honey\n- wax\n- Wood\n\n```\nx = 1\n```\n\n$a+b$\n\nThe end of it.", "hplllcfp"),
    ("## Of rain\n\n### rain and wind\n\nIt rained.\n\n* drops\n* Clouds\n\n1. first rain\n2. second rain\n3. Third\n\n$$x^2$$", "hhplllllf"),
    ("== Old maps ==\n\nThe maps are old.\n\n# the first map\n# the second map\n# the third\n\n* paper\n* ink\n\n<source>y < 3</source>\n\n<math>e = m</math>", "hplllllcf"),
    ("Old maps\n========\n\nThe maps are old, and few.\n\nNew maps\n--------\n\nThey are new.", "hppphppp".replace("hppphppp", "hsphsp")),
    ("\\section{Tides}\n\nTides turn twice a day.\n\n\\begin{itemize}\n  \\item spring tide\n  \\item neap tide\n\\end{itemize}\n\n\\begin{verbatim}\nfor t in day:\n    print(t)\n\\end{verbatim}\n\n\\begin{equation}\nh = 2\n\\end{equation}", "hpllcf"),
    ("Plain words only, without signs. A second sentence follows.\n\nLot #7 & lot #8 cost $9 to $11 each.\n\nThe set a < b holds, and R&D - so they say - is dear.", "ppp"),
    ("It was sold for $ 10.50 as No. 3 of the list.\n\n7 * 6 is 42 and 6 * 7 too.\n\nSee [12] and [13] for more.", "ppp"),
    ("The text begins.\n\n    def f(x):\n        return x\n\nThe text goes on.", "pcp"),
    ("<div>First [link](a.md) here.</div>\n<div>A [whole line of link](b.md)</div>\n> A quoted line stands here.\n\n- [one](c.md)\n- [two](d.md)", "pppll"),
    ("# the king's letter\n# the queen's answer\n\n# a lonely heading", "llh"),
    ("# Der Brief des Königs\n\n# the answer\n\n## Die Antwort ##\n\nDer König schrieb.", "hhhp"),
    ("+ a\n+ b\n\n===Höhe===\n\n====Tiefe ====\n\n* x", "llhhl"),
    ("1. only one point\n\nThen words that go on for a while.\n\n- only one dash", "lpl"),
    ("1999. was a year of rain, they say.\n\n~~~sql\nselect 1\n~~~\n\n<ol><li>a<li>b</ol>\n<span class=\"math\">x</span>", "pcllf"),
    ("“It is lost!” cried the clerk.\n\n–\n\nNo. 5\n\n(A note stands here.)", "pppp"),
)
_LETTER = {"p": 0, "h": 1, "l": 2, "c": 3, "f": 4, "m": 5, "s": 0}
#: Longer lines, leads to a list, names of a menu, and lines that begin with a sign in the midst of a paragraph.
LONG = "The long account of the winter in which the river froze twice was read aloud|nobody in the town could say who had first brought the seal to the archive that|Der Turm am See ist alt und niemand weiß mehr wer ihn vor der Flut gebaut hat|Le vieux pont que personne ne traversait plus depuis la crue du printemps dernier menait|El puente antiguo que nadie cruzaba desde la última riada del invierno llevaba hasta|Старый мост по которому никто не ходил со времени последнего паводка вел к башне и|古い橋は洪水の後に誰も渡らなくなり、町の人々はその名前さえ忘れてしまったと言われている|旧城门在洪水之后无人通过，镇上的人连它的名字都忘记了，只有守门人还记得那把钥匙".split("|")
LEADS = "Contents:|Inhalt:|Voir aussi :|Nota:|Also there:|目次：|См. также:".split("|")
MENU = "Home|Index|About us|Über uns|Suche|Accueil|Contacto|Indice|Главная|Αρχική|首页|目次|الرئيسية|मुख पृष्ठ|หน้าแรก|Back to top".split("|")
INNER = ("- as they say - until the evening came", "- 5 degrees in the night, so that it froze", "12. of March in that year, when it fell", "1999. It was built again soon after", "* which stood for a star in the margin")
#: Words of the composed part of the table: phrases, sentences, code, formulas.
PHRASES = "On the tides|the old bridge|Der Turm am See|zwei Boote|La porte du nord|le four à pain|El puente|La torre antica|vino nuovo|Старый мост|новая лодка|Ο πύργος|月の光|旧城门|नया पुल|สะพานเก่า|الجسر القديم|Was there a bridge?|bread, salt and wine from the hills beyond the town|The long account of the winter in which the river froze twice".split("|")
SENTENCES = "The bridge fell.|Bees fly far and come home late, as the keeper knows.|Der Turm steht am See. Er ist alt.|Le four est froid.|旧城门已经关闭。|Старый мост упал.|सेतु पुराना है।|the keeper said so|“It fell!” cried the boy.|Lot #7 & lot #8 cost $9 to $11 each.|A ratio of 3/4 = fair.|For p < q and r > s this holds.|R&D - so they say - is dear.|See note ** above.|It took 6 * 7 days.|He left [sic] at 5.|(A note stands here.)|No. 5|สะพานเก่าปิดแล้ว|A [whole line](b.md)".split("|")
CODES = ("x = 1\ny = 2", "for t in day:\n    print(t)", '{\n  "a": 1\n}', "ls -l | wc", "select a\nfrom b\nwhere c < 3;")
FORMULAS = ("a+b", "x^2 = y", "\\frac{1}{2}", "E = m c^2", "n \\geq 1", "f(x)", "q(a \\vert b)", "n", "\\prod_{k=1}^{m} u_k", "a, b, c", "x \\to y")


def composed(documents: int = 900, seed: int = 11) -> Iterator[tuple[str, str]]:
    """Labelled texts put together by rule in each of four notations."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    for d in range(documents):
        way, parts, letters = ("html", "md", "wiki", "tex")[d % 4], [], ""
        tight = way == "html" and rng.random() < 0.5
        for _ in range(int(rng.integers(1, 9))):
            k = pick("pppphhllcfpphhllcfmbdqru")
            n, code, formula = int(rng.integers(2, 6)), pick(CODES), pick(FORMULAS)
            wrapped = k == "p" and rng.random() < 0.4
            items = [pick(PHRASES if rng.random() < 0.8 else SENTENCES[:8]) for _ in range(n)]
            head = pick(PHRASES)
            if k in "mbdqru":
                extra, marks = _mixed(k, way, pick, rng)
                if extra:
                    parts.append(extra)
                    letters += marks
                    tight = False
                continue
            letters += k * n if k == "l" or wrapped else k
            if k == "p" and wrapped and rng.random() < 0.4:  # a formula within the line
                letters = letters[:-n] + "pfp"
                t = f"{pick(PHRASES)} \\({formula}\\) {pick(PHRASES + SENTENCES[:8])}"
                parts.append(f"<p>{t}</p>" if way == "html" else t)
            elif wrapped:  # lines broken within a paragraph
                t = "\n".join(pick(PHRASES + SENTENCES[:8]) if rng.random() < 0.5 else _line(rng) for _ in range(n))
                parts.append(f"<p>{t}</p>" if way == "html" else t)
            elif k == "p":
                t = pick(SENTENCES) if rng.random() < 0.5 else _line(rng) + pick((".", ""))
                parts.append({"html": pick(("<p>{}</p>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<P>{}<br/>")).format(t)}.get(way, t))
            elif k == "h" and way == "md" and rng.random() < 0.3:
                parts.append(f"{head}\n{pick('=-') * max(3, len(head))}")
                letters += "s"
            elif k == "h":
                level = int(rng.integers(1, 5))
                parts.append({"html": f"<h{level}>{head}</h{level}>", "md": "#" * level + f" {head}" + pick(("", " ##")), "wiki": pick(("{0} {1} {0}", "{0}{1}{0}")).format("=" * (level + 1), head), "tex": pick(("\\section{{{}}}", "\\chapter{{{}}}", "\\subsection*{{{}}}")).format(head)}[way])
            elif k == "l":
                mark = pick("-*+1") if way == "md" else pick("*#")
                lines = "\n".join(f"{i + 1}. {x}" if mark == "1" else f"{mark} {x}" for i, x in enumerate(items))
                kind = pick(("itemize", "enumerate"))
                parts.append({"html": "<ul>" + "".join(f"<li>{x}" + pick(("</li>", "\n")) for x in items) + "</ul>", "tex": f"\\begin{{{kind}}}\n" + "\n".join(f"  \\item {x}" for x in items) + f"\n\\end{{{kind}}}"}.get(way, lines))
            elif k == "c":
                indented = "\n".join("    " + x for x in code.split("\n"))
                after_list = letters[-2:-1] == "c" or not parts
                parts.append({"html": pick(("<pre>{}</pre>", "<pre><code>{}</code></pre>")).format(html.escape(code)), "md": indented if rng.random() < 0.4 and not after_list else f"```\n{code}\n```", "wiki": f"<source>\n{code}\n</source>", "tex": f"\\begin{{verbatim}}\n{code}\n\\end{{verbatim}}"}[way])
            else:
                parts.append({"html": pick(("\\({}\\)", '<span class="math">{}</span>', "$${}$$")), "md": pick(("${}$", "$$\n{}\n$$")), "wiki": "<math>{}</math>", "tex": pick(("\\[ {} \\]", "${}$", "\\begin{{equation}}\n{}\n\\end{{equation}}"))}[way].format(formula))
        if not parts:
            continue
        yield ("" if tight else "\n" if way == "html" else "\n\n").join(parts), letters


def _line(rng: np.random.Generator) -> str:
    """A longer line, or so many of its last words."""
    words = LONG[int(rng.integers(len(LONG)))].split(" ")
    return " ".join(words[int(rng.integers(max(1, len(words) - 5))) :])


def _mixed(k: str, way: str, pick, rng: np.random.Generator) -> tuple[str, str]:
    """Blocks that the same sign opens, and that words and links around them tell apart."""
    link = {"md": "[{0}](p/{1}.md)", "html": '<a href="p/{1}">{0}</a>', "wiki": "[[P{1}|{0}]]", "tex": "[{0}](p/{1}.md)"}[way]
    row = (lambda xs: "".join(f"<div>{x}</div>" for x in xs)) if way == "html" else "\n".join
    n = int(rng.integers(3, 6))
    if k == "m":  # a menu: short link lines among each other
        return row([link.format(pick(MENU), i) for i in range(n)]), "m" * n
    if k == "b":  # a linked sentence or two are prose, and so is one short link alone
        if rng.random() < 0.4:
            return row([link.format(pick(MENU), 1)]), "p"
        if rng.random() < 0.5:  # short lines with a link in them
            return row([f"{pick(('see', 'As in', 'vgl.', 'Voir'))} {link.format(pick(MENU), i)} {pick(('too.', 'and more', 'below', 'in the old hand.'))}" for i in range(n)]), "p" * n
        n = int(rng.integers(1, 4))
        return row([link.format(pick(LONG), i) for i in range(n)]), "p" * n
    if way == "html":
        return "", ""
    if k == "d":  # a sign that opens a line in the midst of a paragraph
        return f"{pick(LONG)}\n{pick(INNER)}\n{pick(LONG)}", "ppp"
    if k == "q":  # a lead and one item
        return f"{pick(LEADS)}\n{pick(('-', '*', '1.', '2)'))} {pick(PHRASES[:18])}", "pl"
    if k == "r":  # a rule under a long line
        return (f"{pick(LONG)} {pick(LONG)}\n{'-' * 5}", "ps") if way == "md" else ("", "")
    # money on both sides of many words is no formula
    return f"It was $12 for {pick(LONG)} and then 9$ more", "ppp"


def grow(x: np.ndarray, y: np.ndarray, depth: int = 20, least: int = 3) -> tuple:
    """A decision tree by least Gini impurity; leaves are class numbers and
    stand for at least so many blocks."""
    if depth == 0 or (y == y[0]).all():
        return (int(np.bincount(y).argmax()),)
    best = None
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        cuts = (v[1:] + v[:-1]) / 2
        for cut in cuts if len(cuts) <= 12 else np.unique(np.quantile(cuts, np.linspace(0, 1, 12), method="nearest")):
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < least:
                continue
            score = 0.0
            for part in (y[left], y[~left]):
                p = np.bincount(part, minlength=len(KINDS)) / len(part)
                score += len(part) * (1 - (p * p).sum())
            if best is None or score < best[0] - 1e-9:
                best = (score, f, float(cut))
    if best is None:
        return (int(np.bincount(y).argmax()),)
    _, f, cut = best
    left = x[:, f] <= cut
    low, high = grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)
    return low if len(low) == 1 and low == high else (f, cut, low, high)


def used(t: tuple) -> dict[str, int]:
    """How many nodes of a tree ask for each feature."""
    if len(t) == 1:
        return {}
    out = {FEATURES[t[0]]: 1}
    for part in t[2:]:
        for f, n in used(part).items():
            out[f] = out.get(f, 0) + n
    return out


@cache
def tree() -> tuple:
    xs, ys = [], []
    for text, letters in [*LABELLED, *composed()]:
        blocks, _ = flatten(text)
        if len(blocks) != len(letters):
            raise ValueError(f"{len(blocks)} blocks for {letters}: {[(b.form, b.text) for b in blocks]} in {text!r}")
        xs.append(features(blocks))
        ys.append([_LETTER[c] for c in letters])
    return grow(np.concatenate(xs), np.concatenate(ys))


def classify(blocks: list[Block], t: tuple | None = None) -> list[int]:
    t = t or tree()
    out = []
    for row in features(blocks).tolist():
        node = t
        while len(node) == 4:
            node = node[2] if row[node[0]] <= node[1] else node[3]
        out.append(node[0])
    return out


# ---- text of the blocks -------------------------------------------------------------------------
def _unbrace(t: str) -> tuple[str, bool]:
    """The text without the commands and templates around braces, however deep,
    in one pass: a command leaves its content, a note and a template nothing."""
    out: list[str] = []
    stack: list[tuple[str, int, str]] = []
    found, at = False, 0

    def shut(sign: str) -> None:
        nonlocal found
        if not stack:
            out.append(sign)
            return
        kind, k, name = stack.pop()
        if kind == "cmd":
            found = True
            out[k] = ""
            if NOTES.match(name):
                del out[k:]
        else:
            out.append(sign)

    for m in BRACES.finditer(t):
        out.append(t[at : m.start()])
        at = m.end()
        if m["both"]:
            if stack and stack[-1][0] == "template":
                del out[stack.pop()[1] :]
                found = True
            else:
                shut("}")
                shut("}")
        elif m["shut"]:
            shut("}")
        else:
            kind = "cmd" if m["cmd"] else "template" if m["template"] else "open"
            stack.append((kind, len(out), m["name"] or ""))
            out.append(m[0])
    out.append(t[at:])
    return "".join(out), found


#: Escaped signs stand aside (in a private range) until the other signs are read.
_ASIDE = 0xE000
_BACK = {_ASIDE + i: i for i in range(33, 127)}


def strip_inline(t: str, count_entities: bool = True) -> tuple[str, bool]:
    """The text without inline markup, and whether there was any. Emphasis and
    links within one another are read from the inside until none is left."""
    found = False
    if "{" in t:
        t, found = _unbrace(t)
    escaped = False

    def sub(m: regex.Match) -> str:
        nonlocal found, hit, escaped
        if m["entity"]:
            plain = html.unescape(m[0])
            if plain == m[0]:
                return m[0]
            found |= count_entities
            return plain
        hit = found = True
        if m["esc"]:
            escaped = True
            return chr(_ASIDE + ord(m[0][1]))
        if m["tilde"]:
            return " "
        for g in ("image_in", "link_in", "wiki_in", "ext_in", "strong_in", "strong2_in", "em_in", "em2_in", "strike_in", "wikiem_in", "texquote_in", "tick_in"):
            if m[g] is not None:
                return m[g]
        return ""

    hit = True
    while hit:
        hit = False
        t = INLINE.sub(sub, t)
    return (t.translate(_BACK) if escaped else t), found


def analyse(text: str | None, grown: tuple | None = None) -> tuple[list[tuple[str, str, int, int]], set[str]]:
    """((kind, clean text, level, line ends before) of each block, kinds of markup found)."""
    if not text or not text.strip():
        return [], set()
    blocks, other = flatten(text)
    kinds: set[str] = set()
    out: list[tuple[str, str, int, int]] = []
    for b, k in zip(blocks, classify(blocks, grown)):
        name = KINDS[k]
        t = b.text
        if name == "menu":
            other = True
            continue
        if name == "code" or name == "formula":
            kinds.add(name)
            out.append((name, t, 0, b.gap))
            continue
        if b.form == "dollar":  # not a formula: the signs belong to prose
            out.append(("prose", f"${t}$", 0, b.gap))
            continue
        if b.form == "indent":
            t = t.strip()
        level = b.level
        if name == "heading":
            kinds.add("heading")
            if (m := FRAME.match(t.strip())) and b.form == "line":
                t, level = m[2], len(m[1])
            elif (m := HASHES.match(t)) and b.form == "line":
                t, level = _HASH_END.sub("", t[m.end() :]), len(m[1])
        elif name == "list":
            kinds.add("list")
            if b.form == "line":
                t = _ITEM_SIGN.sub("", t)
        else:
            if b.form == "line" and UNDER.match(t):
                if not (out and out[-1][0] == "heading" and not b.blank):
                    other = True
                continue
            if QUOTE.match(t) and b.form == "line":
                other = True
                t = QUOTE.sub("", t, count=1)
            if "|" in t and _ROW.match(t):
                other = True
                t = _ROW_SIGN.sub(" ", t)
                if not t.strip(" -|:"):
                    continue
        t, had = strip_inline(t, name == "prose")
        other |= had
        if t.strip():
            out.append((name, t.strip(), level, b.gap))
    if other:
        kinds.add("other")
    return out, kinds


def render(blocks: list[tuple[str, str, int, int]]) -> str:
    """Clean text that shows its structure: headings after ``#``, list items
    after ``-``, code between fences, formulas between dollar signs; lines and
    formulas of a paragraph stay in it."""
    parts: list[str] = []
    last = ""
    flow = ("prose", "formula")
    for kind, t, level, gap in blocks:
        if kind == "heading":
            s = "#" * max(1, level) + " " + t
        elif kind == "list":
            s = "- " + t
        elif kind == "code":
            s = f"```\n{t}\n```"
        elif kind == "formula":
            s = f"${t}$"
        else:
            s = t
        if not parts:
            sep = ""
        elif kind == last == "list":
            sep = "\n"
        elif (kind in flow and last in flow) or (kind == "formula" and last == "list"):
            sep = (" ", "\n", "\n\n")[gap]
        else:
            sep = "\n\n"
        parts.append(sep + s)
        last = kind
    return "".join(parts)


def prose(blocks: list[tuple[str, str, int, int]]) -> str:
    """The running text alone, and items and headings that end as sentences do;
    a formula leaves a blank."""
    parts: list[str] = []
    for kind, t, _, gap in blocks:
        if kind == "prose":
            parts.append(("" if not parts else (" ", "\n", "\n\n")[gap]) + t)
        elif kind in ("list", "heading") and t[-1:] in ".!?…。！？।؟":
            parts.append(("\n\n" if parts else "") + t + "\n\n")
        elif kind != "formula":
            parts.append("\n\n" if parts else "")
    return "".join(parts)


def clean(df: DataFrame, key: str = "source_id", text: str = "comments_html", what: str = "clean") -> DataFrame:
    """(key, clean): the clean text of each row (``what`` = prose: prose only)."""
    show, grown = (render if what == "clean" else prose), tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([show(analyse(t, grown)[0]) for t in b.column(1).to_pylist()], pa.string())], names=[key, "clean"])

    return _spread(df.select(key, text)).mapInArrow(run, f"{key} string, clean string")


def kinds(df: DataFrame, key: str = "source_id", text: str = "comments_html") -> DataFrame:
    """(key, kind): a row for each kind of markup in each row's text."""
    grown = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k in sorted(analyse(t, grown)[1]):
                    ids.append(i)
                    out.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], names=[key, "kind"])

    return _spread(df.select(key, text)).mapInArrow(run, f"{key} string, kind string")
