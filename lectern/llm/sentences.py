"""Sentence units across languages and scripts, by a semi-Markov model.

A text is cut at blank lines into blocks. In a block every terminator (and in
Thai every white space) is a place where a unit may end. Dynamic programming
chooses the spans between such places whose scores add up highest; the score of
a span joins four parts: how its closing word and terminator end a sentence, how
its opening word begins one, its length, and whether the brackets and quotation
marks in it are balanced. Every place takes part in the search; word lists are
one feature of the closing score. Starts that can no longer win are left by a
bound that is exact, so the work of a block grows with its length.

Defined results
---------------
null, empty and blank texts: no units; offsets: code points, end exclusive,
without outer white space; a block without a sentence end: one unit; very long
texts and runs: whole; repeated rows: repeated units; an empty table: an empty
result; a null key: kept as null; extra columns: ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.tokens import _spread

# ---- Fixed values: word lists of the model -------------------------------------------------
#: Abbreviations that a sentence goes on after, whatever follows.
ABBREVIATIONS = frozenset(
    """
    mr mrs ms dr prof st fr hr herr m mm mme mlle me sig sigg sig.ra sra sr srta dra dott ing arch avv on rev gen col sgt capt lt
    cf cfr vgl vol vols fig figs no nr nos nº n° p pp pag pág págs s ss f ff bd bde hrsg hg ed eds éd t ch chap cap lib sec sect art abs
    z.b d.h i.e e.g u.a.m o.ä bzw ca ggf inkl evtl sog resp viz vs z d i e v vv ms mss tab taf kap anm aufl jh jhd geb gest
    p.ex p.ej p.es ex ej es et env av trad rééd núm art ibid op loc sc scil
    κ κα κος κυρ σ σσ βλ πρβλ π.χ π χ τ τόμ κεφ αρ δρ
    г-н г-жа с см ср т стр гл рис табл им проф акад т.е т.к т.н н напр ред изд кн вып д-р
    د ص ج م أ
    डॉ पृ श्री सं प्रो क्र
    ดร ศ นาย นาง ผศ รศ พ.ศ ค.ศ
    """.split()
)
#: Abbreviations and units that may also close a sentence: the next word decides.
CLOSING_ABBREVIATIONS = frozenset(
    """
    etc usw ecc ff u.a u.ä u.s.w al b.c a.d b.c.e c.e a.m p.m v.chr n.chr a.c d.c av.j.-c cm mm km kg mg hrs min sec jr sr co inc ltd corp
    т.д т.п др пр н.э г гг в вв руб коп см млн тыс д п э κ.λπ κ.ά κλπ κ.α μ.χ π.χ εκ δρχ γρ سم كم كغ إلخ هـ مم से.मी कि.मी मी रु
    p.c m.c kal nov dec jan feb mar apr aug sept oct
    """.split()
)
#: Months after an ordinal day ("9. März").
MONTHS = frozenset("januar jänner februar feber märz april mai juni juli august september oktober november dezember jan feb apr aug sept okt nov dez jahrhundert jh jhd kapitel auflage".split())
#: Words by which a clause reports the quotation before it, where letters have no case.
REPORTS = r"(?:と|って)|.{0,14}?(?:问道|說道|说道|問道|答道|喊道|写道|回答|表示|说|問|道[，。！？])|(?:سأل|سألت|قال|قالت|كتب|كتبت|أجاب|صاح|هتف|أضاف)\b|[^।?!\"“”]{0,60}?(?:पूछा|कहा|बोला|बोली|लिखा|चिल्लाया)"

OPEN, CLOSE = "([{（［【〔《〈「『‹", ")]}）］】〕》〉」』›"
BRACKETS = "([{（［【〔"
PAIR = dict(zip(OPEN, CLOSE))
QUOTES = "\"“”„«»‘’'‚"
HARD = "!?！？؟。｡।॥"
BLANK_LINE = re.compile("(?>\r\n|[\r\n\u2028\u2029])[^\\S\r\n\u2028\u2029]*(?:(?>\r\n|[\r\n\u2028\u2029])[^\\S\r\n\u2028\u2029]*)+")
#: Where a unit may end: marks, a semicolon after Greek letters, white space after Thai ones.
CANDIDATE = re.compile("[.!?…。！？｡؟।॥]+|(?<=[\u0370-\u03ff\u1f00-\u1fff])[;\u037e]|(?<=[\u0e00-\u0e7f])\\s+(?=\\S)")
#: The word before a stop with up to three short parts joined to it, read backwards.
CHAIN = regex.compile(r"(?r)(?:(?<![\p{L}\p{M}\p{N}])[\p{L}\p{M}]{1,4}(?:\.-?\s?|-)){0,3}[\p{L}\p{M}\p{N}°º]+")
JOINT = re.compile(r"\.-?|-")
SPACE_BACK = regex.compile(r"(?r)\s")
NEXT_SPACE = re.compile(r"\s")
ADDRESS = re.compile(r"https?://|www\.|(?<=[\w\-])@|(?<=\w)\.\w{2,}/", re.I)
REPORT = regex.compile(REPORTS)
WORD = regex.compile(r"[\p{L}\p{M}\p{N}\-]+")
#: Words after which a number of one or two digits is an ordinal.
ORDINAL_BEFORE = regex.compile(r"(?r)(?:\bam|\bvom|\bzum|dem|der|des|\bim|\bbis)\s*", regex.I)
CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Arabic}\p{Devanagari}\p{Hebrew}\p{Hangul}]")
ENDS_QUOTE = regex.compile(r"[\p{Pi}\p{Pf}\"」』“”]")
#: Brackets and quotation marks; an apostrophe between two letters is none.
MARKS = re.compile(r"[(\[{（［【〔《〈「『‹)\]}）］】〕》〉」』›\"“”„«»‘‚]|(?<![^\W_])['’]|['’](?![^\W_])")

# ---- Weights of the model: every part is a number that is added up ---------------------------
#: How the word and the mark before a place close a unit.
CLOSING = {
    "hard": 5.0, "ellipsis": 4.0, "stop": 4.5, "number": 4.0, "bare": 2.0, "tight": 4.0, "tight_mark": -0.5, "tight_number": 0.0,
    "closing_abbreviation": 2.5, "abbreviation": -7.0, "initial": -7.0, "one_letter": -1.5, "ordinal": -12.0, "inside": -12.0, "space": 5.0,
}
#: How the word or mark after a place opens one.
OPENING = {"capital": 2.5, "caseless": 2.5, "number": 2.0, "mark": 1.5, "other": 1.0, "small": -12.0, "goes_on": -14.0, "report": -12.0}
#: What a span costs for its length: under ``SHORT`` characters, and for each
#: further ``STEP`` characters beyond ``LONG`` one, up to ``LONGEST``.
SHORT, SHORT_COST, LONG, STEP, LONGEST = 3, 3.0, 500, 250, 4.0
#: What a span costs for each pair of brackets or quotation marks of which it
#: holds one end only, up to ``UNBALANCED``.
BRACKET_COST, QUOTE_COST, UNBALANCED = 2.0, 0.4, 6.0

_CLOSER_OF = {"”": "“„", "“": "„", "»": "«", "«": "»", '"': '"', "„": ""}


def _marks(text: str, lo: int, hi: int) -> tuple[dict[int, bool], list[tuple[int, int]]]:
    """For each quotation mark or bracket of a block whether it closes; and the
    pairs (place of the closing mark, place of the opening one)."""
    closes: dict[int, bool] = {}
    pairs: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}

    def push(c: str, i: int) -> None:
        stack.append((c, i))
        held[c] = held.get(c, 0) + 1

    def pop(wanted: str, i: int) -> bool:
        if not any(held.get(c) for c in wanted):
            return False
        while True:  # what stands above is dropped, so each mark is passed once
            c, at = stack.pop()
            held[c] -= 1
            if c in wanted:
                pairs.append((i, at))
                return True

    for m in MARKS.finditer(text, lo, hi):
        c, i = m[0], m.start()
        if c in PAIR:
            push(PAIR[c], i)
        elif c in CLOSE:
            closes[i] = True
            pop(c, i)
        elif c in "'’‘‚":
            after_letter = i > lo and text[i - 1].isalnum()
            before_letter = i + 1 < hi and text[i + 1].isalnum()
            if c in "‘‚" and before_letter and not after_letter:
                push("'", i)
                closes[i] = False
            elif after_letter and before_letter:
                continue
            elif held.get("'") and not (before_letter and not after_letter and text[i - 1 : i] not in ".!?…"):
                pop("'", i)
                closes[i] = True
            elif before_letter and not after_letter:
                push("'", i)
                closes[i] = False
        elif pop(_CLOSER_OF[c], i) or c == "”":
            closes[i] = True
        else:
            push(c, i)
            closes[i] = False
    return closes, pairs


class _Words:
    """What stands before a stop, found with a bounded look back or with marks
    carried along the block, so that a block is passed once."""

    __slots__ = ("text", "lo", "hi", "space", "seen", "url_of", "url")

    def __init__(self, text: str, lo: int, hi: int):
        self.text, self.lo, self.hi = text, lo, hi
        self.space = self.seen = lo - 1  # the last white space before `seen`
        self.url_of, self.url = -2, 0

    def in_address(self, i: int) -> bool:
        """Whether the stop at i stands within a web or mail address."""
        if i > self.seen + 1:
            m = SPACE_BACK.search(self.text, max(self.seen, self.lo), i)
            if m:
                self.space = m.start()
            self.seen = i
        if self.url_of != self.space:
            m = NEXT_SPACE.search(self.text, i, self.hi)
            u = ADDRESS.search(self.text, self.space + 1, m.start() if m else self.hi)
            self.url_of, self.url = self.space, u.end() if u else self.hi + 1
        return self.url <= i


def _known(text: str, lo: int, i: int) -> tuple[str, str, bool]:
    """The word before a stop, in small letters; what its longest listed end is
    ("z. B" before "b"): a closing abbreviation, an abbreviation or nothing; and
    whether other parts are joined to it."""
    m = CHAIN.match(text, lo, i)
    if not m:
        return "", "", False
    chain = _even(m[0])
    cuts = [0, *[p.end() for p in JOINT.finditer(chain)]]
    for at in cuts:
        end = chain[at:]
        if end in CLOSING_ABBREVIATIONS:
            return chain[cuts[-1] :], "closing_abbreviation", len(cuts) > 1
        if end in ABBREVIATIONS:
            return chain[cuts[-1] :], "abbreviation", len(cuts) > 1
    return chain[cuts[-1] :], "", len(cuts) > 1


def _place(w: _Words, m: re.Match, closes: dict[int, bool]) -> tuple[int, int, float] | None:
    """(end, start of the next unit, closing + opening score) of a place."""
    text, lo, hi = w.text, w.lo, w.hi
    i, j, mark = m.start(), m.end(), m[0]
    if mark.isspace():  # Thai: white space stands between sentences and nowhere else
        if text[j] in ")]”»" or text[i - 1] in "ฯๆ" and text[j].isdigit():
            return i, j, CLOSING["inside"]
        return i, j, CLOSING["space"] + OPENING["caseless"]
    end = j
    if closes:
        while end < hi:  # closing marks belong to the unit they close
            k = end
            if text[k] in "   " and k + 1 < hi and text[k + 1] in "»”" and closes.get(k + 1):
                k += 1
            if not closes.get(k):
                break
            end = k + 1
    start = end
    while start < hi and text[start].isspace():
        start += 1
    if start >= hi:
        return None
    gap, quoted, nxt = start > end, end > j, text[start]
    k = start
    while k < hi and (text[k] in QUOTES or text[k] in OPEN or text[k] in "¿¡-–—•*"):
        k += 1
    while k < hi and text[k].isspace():
        k += 1
    first = text[k] if k < hi else nxt
    small, caseless = first.islower(), not first.isascii() and CASELESS.match(first) is not None
    # the opening word
    if nxt in ",;:、，；：;" or quoted and nxt in "-–—":
        opening = OPENING["goes_on"]
    elif small:
        opening = OPENING["small"] if (gap or quoted or mark[0] in "….;;") and "。" not in mark and "।" not in mark else OPENING["other"]
    elif caseless:
        opening = OPENING["report"] if quoted and ENDS_QUOTE.search(text, j, end) and REPORT.match(text, start, hi) else OPENING["caseless"]
    elif first.isupper():
        opening = OPENING["capital"]
    elif first.isdigit():
        opening = OPENING["number"]
    else:
        opening = OPENING["mark" if nxt in QUOTES or nxt in OPEN else "other"]
    if opening <= OPENING["small"]:
        return end, start, CLOSING["hard"] + opening  # no closing word outweighs it
    return end, start, opening + CLOSING[_closing(w, i, j, mark, k, first, nxt, small, caseless, gap, quoted)]


def _closing(w: _Words, i: int, j: int, mark: str, k: int, first: str, nxt: str, small: bool, caseless: bool, gap: bool, quoted: bool) -> str:
    """The name of what the word and the mark before a place are."""
    text, lo, hi = w.text, w.lo, w.hi
    if mark[0] in ";;":
        return "inside" if nxt in ",;" else "hard"
    if "…" in mark or mark.count(".") >= 2:
        if not mark.strip("….…"):
            return "inside" if caseless or nxt in ")）" else "ellipsis"
    if mark[0] in HARD or mark[-1] in HARD:
        if not gap and not quoted and mark[-1] in "!?" and (first.isdigit() or first in "=&/" or w.in_address(i)):
            return "inside"
        return "hard"
    before = text[i - 1] if i > lo else " "
    if quoted:
        return "stop"
    if not gap:
        if first.isdigit() and before.isdigit() or w.in_address(i):
            return "inside"
        if not (before.isalnum() or before in ")]%°" or unicodedata.category(before)[0] == "M"):
            return "inside"
        tail, kind, _ = _known(text, lo, i)
        if kind == "abbreviation" or len(tail) < 2 and not tail.isdigit():
            return "initial" if kind == "" else "abbreviation"
        if first.isupper():
            after = text[k + 1] if k + 1 < hi else " "
            return "initial" if after == "." and not (len(tail) > 2 and before.islower()) else "tight"
        if first.isdigit():
            return "tight_number" if len(tail) > 2 and not any(c.isdigit() for c in tail) else "inside"
        if caseless:
            return "inside" if "ऀ" <= first <= "๿" else "tight"
        return "tight_mark" if nxt in QUOTES or nxt in OPEN else "inside"
    if "ऀ" <= before <= "ॿ":
        return "bare" if first.isupper() else "inside"  # there a stop only abbreviates
    if not (before.isalnum() or before in "°º" or unicodedata.category(before)[0] == "M"):
        return "bare"
    if before.isdigit():
        d = i
        while d > lo and text[d - 1].isdigit():
            d -= 1
        if d == lo:
            return "ordinal"  # the number of a heading or list
        if (n := WORD.match(text, k, hi)) and _even(n[0]) in MONTHS:
            return "ordinal"
        if i - d <= 2 and ORDINAL_BEFORE.match(text, lo, d):
            return "ordinal"
        return "number"
    tail, kind, joined = _known(text, lo, i)
    if kind == "closing_abbreviation":
        return "abbreviation" if first.isdigit() and tail in ABBREVIATIONS else kind
    if kind:
        return kind
    if len(tail) == 1 and not caseless:
        return "initial" if before.isupper() or joined else "one_letter"
    return "stop"


def _even(word: str) -> str:
    """A word in small letters, without blanks, its accents joined to the letters."""
    word = "".join(word.split()).lower()
    return word if word.isascii() else unicodedata.normalize("NFC", word)


def block_units(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Units of one block without outer white space: of all ways to cut it at
    its places the one whose spans add up highest. Every place takes part.

    ``best[j]`` is the best sum of the spans up to place j. A span's sum is the
    opening score of its start and the closing score of its end, less what its
    length and its unbalanced marks cost. Those costs lie between 0 and a bound
    and the cost of a length never falls as the span grows; so a start whose best sum is
    behind another's by more than the costs could ever make up is left for good,
    which leaves a few starts at each place and changes no result."""
    cand = [m for m in CANDIDATE.finditer(text, lo, hi) if m.end() < hi]
    if not cand:
        return [(lo, hi)]
    closes, pairs = _marks(text, lo, hi) if MARKS.search(text, lo, hi) else ({}, [])
    w = _Words(text, lo, hi)
    places = [p for m in cand if (p := _place(w, m, closes)) is not None]
    if not places:
        return [(lo, hi)]
    return search(lo, hi, places, _events(text, pairs))


def _events(text: str, pairs: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """(place, place of the opening mark, cost) of both ends of every pair."""
    out = []
    for shut, at in pairs:
        cost = BRACKET_COST if text[at] in BRACKETS else QUOTE_COST
        out += [(at, at, cost), (shut, at, cost)]
    return sorted(out)


def span_cost(n: int, unbalanced: float) -> float:
    """What a span of n characters costs for its length and its marks."""
    cost = min(unbalanced, UNBALANCED)
    if n < SHORT:
        return cost + SHORT_COST
    return cost + min((n - LONG) / STEP, LONGEST) if n > LONG else cost


def search(lo: int, hi: int, places: list[tuple[int, int, float]], events: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The best spans. A live start is [start, best sum before it, cost of its
    unbalanced marks so far, its number]."""
    most = UNBALANCED if events else 0.0
    behind_later, behind_earlier = SHORT_COST + most, LONGEST + most
    live: list[list] = [[lo, 0.0, 0.0, 0]]
    back: list[int] = []
    at, ne = 0, len(events)
    for j, (end, start, gain) in enumerate([*places, (hi, hi, 0.0)]):
        while at < ne and events[at][0] < end:
            i, opened, cost = events[at]
            at += 1
            for s in live:
                if i >= s[0]:
                    # an end whose other end lies in the span balances it again
                    s[2] += -cost if i != opened and opened >= s[0] else cost
        top, frm = -1e18, 0
        for s in reversed(live):
            n = end - s[0]
            v = s[1]
            if n < SHORT or n > LONG or s[2] > 0:
                v -= span_cost(n, s[2])
            if v > top:
                top, frm = v, s[3]
        top += gain
        back.append(frm)
        most_so_far = live[0][1]
        for s in live:
            if s[1] > most_so_far:
                most_so_far = s[1]
        if top >= most_so_far - behind_earlier:
            if top - behind_later >= live[0][1]:
                live = [s for s in live if s[1] > top - behind_later]
            live.append([start, top, 0.0, j + 1])
    spans, j = [], len(places) + 1
    starts, ends = [lo, *[p[1] for p in places]], [*[p[0] for p in places], hi]
    while j > 0:
        i = back[j - 1]
        spans.append((starts[i], ends[j - 1]))
        j = i
    spans.reverse()
    return spans


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of a text."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    at = 0
    bounds = [(m.start(), m.end()) for m in BLANK_LINE.finditer(text)]
    for a, b in [*bounds, (len(text), len(text))]:
        lo, hi = at, a
        at = b
        while lo < hi and text[lo].isspace():
            lo += 1
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
        if lo < hi:
            out.extend(block_units(text, lo, hi))
    return out


def split(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per sentence unit: (key, sent_start, sent_end[, sentence])."""
    kind = df.schema[key].dataType
    names = [key, "sent_start", "sent_end", *["sentence"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, lo, hi, part = [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for x, y in units(t):
                    row.append(k)
                    lo.append(x)
                    hi.append(y)
                    if with_text:
                        part.append(t[x:y])
            cols = [b.column(0).take(pa.array(row, type=pa.int64())), pa.array(lo, type=pa.int64()), pa.array(hi, type=pa.int64())]
            if with_text:
                cols.append(pa.array(part, type=pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = T.StructType([T.StructField(key, kind), T.StructField("sent_start", T.LongType()), T.StructField("sent_end", T.LongType()), *[T.StructField("sentence", T.StringType())] * with_text])
    return _spread(df.select(key, text)).mapInArrow(run, out)
