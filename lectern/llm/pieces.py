"""Splitting oversized texts at natural boundaries with a fixed overlap.

Balanced targets: the least number of pieces that can hold the text is
computed, equal-length targets are placed, each target is snapped to the
strongest boundary near it (paragraph, line, sentence, clause, word, and only
then any character), and a piece is added whenever a limit fails.

Defined results
---------------
null, empty, blank and short texts: no rows (they fit as they are); outer
blanks, tabs and line breaks: outside every piece but counted in the offsets;
null, 0/0, negative or contradictory item offsets: counted from 0; a run
without any boundary: cut at the limit, never between a letter and its marks;
repeated rows: one item; an item's versions: the latest; null ids: dropped; an
empty table: an empty result; extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.tables import current_chunks

LIMIT, OVERLAP = 1600, 160
#: The outer signs that do not count.
OUTER = " \t\r\n"
#: Boundaries by strength; each match ends where a piece may end.
BOUNDARY = regex.compile(
    r"""(?P<paragraph>(?=\s*\n[^\S\n]*\r?\n))
    |(?P<line>(?=\r?\n))
    |(?P<sentence>[.!?…]+["'”’»)\]]*(?=\s)|[。！？।॥؟]+["'”’»」』）)\]]*)
    |(?P<clause>[;:,—][”"»]?(?=\s)|[、，；：،؛])
    |(?P<thai>(?<=\p{Thai})(?=[ ]))
    |(?P<word>(?=\s))""",
    regex.X,
)
STRENGTH = {"paragraph": 6.0, "line": 5.0, "sentence": 4.0, "thai": 3.5, "clause": 2.0, "word": 1.0}
GLUED = regex.compile(r"[\p{M}‍️︎\U0001F3FB-\U0001F3FF\n]")
WORDLIKE = regex.compile(r"[\p{L}\p{N}\p{M}]")
#: Scripts written without spaces: a word cannot be seen, so none is kept whole.
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")


def cut_before(text: str, lo: int, hi: int, aim: int) -> int:
    """The strongest boundary in (lo, hi], nearness to the aim breaking ties:
    over the whole window distance costs less than one step of strength."""
    best, score = 0, -1.0
    half = max(1, aim - lo, hi - aim)
    for m in BOUNDARY.finditer(text, max(0, lo - 2), min(len(text), hi + 1)):
        at = m.end()
        if lo < at <= hi:
            s = STRENGTH[m.lastgroup] - 0.95 * abs(at - aim) / half
            if s > score:
                best, score = at, s
    if best:
        return best
    at = min(aim, hi)
    while at > lo + 1 and at < len(text) and GLUED.match(text[at]):
        at -= 1
    return at if at > lo + 1 else min(aim, hi)


def overlap_start(text: str, cut: int, overlap: int) -> int:
    """Where the next piece starts: the overlap before the cut, fewer only so
    that no word is broken."""
    at = max(0, cut - overlap)
    if at == 0 or UNSPACED.match(text[at]):
        while at < cut and GLUED.match(text[at]):
            at += 1
        return at
    k = at
    while k < cut and WORDLIKE.match(text[k]) and (WORDLIKE.match(text[k - 1]) or text[k - 1] in "'’-"):
        k += 1
    if k < cut:
        return k
    while at < cut and GLUED.match(text[at]):
        at += 1
    return at


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text without outer blanks."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    count = max(2, -(-(n - overlap) // (limit - overlap)))
    while True:
        pieces, start, last = [], 0, 0
        for i in range(1, count):
            # what is left is shared out anew, so one early cut moves the next targets
            aim = last + (n - last) // (count - i + 1)
            room = start + limit
            reach = max(40, (limit - overlap) // 4)
            lo = max(last, start + overlap, aim - reach)
            hi = min(room, aim + reach, n - 1)
            if hi <= lo:
                break
            cut = cut_before(text, lo, hi, min(aim, hi))
            if cut >= n:
                break
            pieces.append((start, cut))
            last, start = cut, overlap_start(text, cut, overlap)
        else:
            if n - start <= limit:
                return [*pieces, (start, n)]
        count += 1
        if count > n:  # a limit that leaves no room for the overlap
            raise ValueError("the overlap must be smaller than the limit")


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Current rows whose text is over the limit. Texts that fit are dropped
    before the shuffle; their rows stay, so that an old long version of a text
    that is short now does not come up."""
    over = F.length(F.btrim(F.col("text"), F.lit(OUTER))) > limit
    whole = F.col("char_start").isNotNull() & F.col("char_end").isNotNull()
    ok = whole & (F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start")) & (F.col("char_end") - F.col("char_start") == F.length("text"))
    d = current_chunks(chunks, F.when(over, F.col("text")).alias("text"), F.when(over & ok, F.col("char_start")).otherwise(F.lit(0)).cast("long").alias("base"))
    return d.filter("text is not null")


def split(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, text, char_start, char_end) of oversized items (id, text, base)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, no, parts, lo, hi = [], [], [], [], []
            for i, t, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                lead = len(t) - len(t.lstrip(OUTER))
                body = t.strip(OUTER)
                for k, (x, y) in enumerate(split_text(body, limit, overlap)):
                    ids.append(i)
                    no.append(k)
                    parts.append(body[x:y])
                    lo.append(base + lead + x)
                    hi.append(base + lead + y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(no, pa.int32()), pa.array(parts, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["id", "piece", "text", "char_start", "char_end"])

    return items.select("id", "text", "base").mapInArrow(run, "id string, piece int, text string, char_start long, char_end long")
