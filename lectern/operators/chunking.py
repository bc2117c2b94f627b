"""Cutting documents into chunks.

Forms that are sums over the text stay in the JVM; the greedy ones, whose every
cut depends on the one before, run as Arrow batches per document. No text is
lost, and no chunk is over its limit unless one word is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx

OUT = "chunk_index int, chunk string, start int, stop int"


def fixed(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of a fixed size in steps of size minus overlap, as expressions."""
    step = size - overlap
    n = F.length(text)
    last = F.greatest(F.ceil((n - overlap) / F.lit(step)) - 1, F.lit(0))
    d = df.filter(n > 0).select(key, text, F.posexplode(F.sequence(F.lit(0), last)).alias("chunk_index", "_k"))
    lo = (F.col("_k") * step).cast("int")
    return d.select(key, "chunk_index", F.substring(F.col(text), lo + 1, F.lit(size)).alias("chunk"), lo.alias("start"))


def exchanges(messages: DataFrame) -> DataFrame:
    """Dialogue chunks: a user's turns up to and with the replies after them. A
    new exchange starts at a user turn that follows a reply; equal turns go by the
    message's number."""
    w = Window.partitionBy("conv_id").orderBy("turn", "msg_id")
    new = ((F.col("speaker") == "human") & (F.coalesce(F.lag("speaker").over(w), F.lit("assistant")) != "human")).cast("int")
    d = messages.withColumn("_n", new).withColumn("exchange", F.sum("_n").over(w))
    return d.drop("_n")


def section_runs(chunks: DataFrame) -> DataFrame:
    """Runs of neighbouring chunks of one section, numbered within the book."""
    w = Window.partitionBy("book_id").orderBy("chunk_index", "id")
    same = F.lit(True)
    for c in ("section_type", "chapter", "section_title"):
        same = same & (F.coalesce(F.lag(c).over(w), F.lit("\0")) == F.col(c))
    d = chunks.withColumn("_n", (~same).cast("int"))
    return d.withColumn("run", F.sum("_n").over(w)).drop("_n")


def parents(chunks: DataFrame, budget: int = 2048) -> DataFrame:
    """Greedy groups of neighbouring chunks of one run within a budget of
    tokens (a word counts 1.3): the fold runs over a run's sizes only, never
    over its texts."""
    d = section_runs(chunks).withColumn("_t", F.ceil(tx.word_count(F.col("text")) * 1.3).cast("int"))
    g = d.groupBy("book_id", "run").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "_t"))).alias("m"))
    step = lambda a, x: F.when((a["sum"] > 0) & (a["sum"] + x["_t"] > budget), F.struct((a["group"] + 1).alias("group"), x["_t"].alias("sum"), F.concat(a["out"], F.array(a["group"] + 1)).alias("out"))).otherwise(F.struct(a["group"].alias("group"), (a["sum"] + x["_t"]).alias("sum"), F.concat(a["out"], F.array(a["group"])).alias("out")))
    groups = F.aggregate("m", F.struct(F.lit(0).alias("group"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])
    return g.select("book_id", "run", F.explode(F.arrays_zip(F.col("m.id").alias("id"), groups.alias("grp"))).alias("x")).select("book_id", "run", "x.id", F.col("x.grp").alias("parent"))


# ---- greedy chunkers: (start, stop) spans of a text ----------------------------------------------
Span = tuple[int, int]
PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？।])")


def _parts(text: str, lo: int, hi: int, cut: re.Pattern) -> list[Span]:
    out, at = [], lo
    for m in cut.finditer(text, lo, hi):
        if m.end() > at:  # a cut of no width may lie where the part begins
            out.append((at, m.end()))
            at = m.end()
    return [*out, (at, hi)] if at < hi else out


def _fit(text: str, span: Span, size: int) -> list[Span]:
    """A span cut at sentences, then at words, then anywhere, until it fits."""
    if span[1] - span[0] <= size:
        return [span]
    for cut in (SENTENCE, re.compile(r"(?<=\s)(?=\S)")):
        parts = _parts(text, *span, cut)
        if len(parts) > 1:
            return _pack([y for p in parts for y in _fit(text, p, size)], size)
    return [(i, min(i + size, span[1])) for i in range(span[0], span[1], size)]


def _pack(parts: list[Span], size: int) -> list[Span]:
    out: list[Span] = []
    for lo, hi in parts:
        if out and hi - out[-1][0] <= size:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def paragraph_spans(text: str, size: int = 1500, least: int = 100) -> list[Span]:
    """Paragraphs packed to the size; long ones cut at sentences; a short rest
    joins the chunk before it."""
    out = _pack([y for p in _parts(text, 0, len(text), PARAGRAPH) for y in _fit(text, p, size)], size)
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def markdown_spans(text: str, size: int = 1500) -> list[Span]:
    """First and second level headings always start a chunk; sections under
    other headings are packed together."""
    out: list[Span] = []
    for lo, hi in _parts(text, 0, len(text), re.compile(r"\n(?=#{1,2} )")):
        parts = _parts(text, lo, hi, re.compile(r"\n(?=#{3,6} )"))
        out += _pack([y for p in parts for y in _fit(text, p, size)], size)
    return out


def word_spans(text: str, tokens: int = 512, overlap: int = 64) -> list[Span]:
    """Windows of words (1.3 tokens each), drawn back to a sentence end where
    40 percent of the window is kept."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    n, back = max(1, int(tokens / 1.3)), int(overlap / 1.3)
    out, i = [], 0
    while i < len(words):
        j = min(i + n, len(words))
        if j < len(words):
            k = j
            while k > i + int(0.4 * n) and text[words[k - 1][1] - 1] not in ".!?…":
                k -= 1
            if k > i + int(0.4 * n):
                j = k
        out.append((words[i][0], words[j - 1][1]))
        if j == len(words):
            break
        i = max(i + 1, j - back)
    return out


def dialogue_spans(text: str, size: int = 3200) -> list[Span]:
    """Exchanges of a transcript with speaker marks; long ones at paragraphs."""
    turn = re.compile(r"\n(?=(?:\*\*\[?)?(?:user|human|you|frage)\b\]?:?(?:\*\*)?:?)", re.I)
    parts = _parts(text, 0, len(text), turn)
    return [y for p in parts for y in ([p] if p[1] - p[0] <= size else _pack([z for q in _parts(text, *p, PARAGRAPH) for z in _fit(text, q, size)], size))]


CHUNKERS: dict[str, Callable[[str], list[Span]]] = {"paragraph": paragraph_spans, "markdown": markdown_spans, "words": word_spans, "dialogue": dialogue_spans}


def chunk(df: DataFrame, key: str, text: str, how: str | Callable[[str], list[Span]] = "paragraph") -> DataFrame:
    """(key, chunk_index, chunk, start, stop) by a named chunker or a function
    from a text to spans."""
    spans = CHUNKERS[how] if isinstance(how, str) else how
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, part, lo, hi = [], [], [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                for i, (x, y) in enumerate(spans(t) if t else []):
                    row.append(r)
                    no.append(i)
                    part.append(t[x:y])
                    lo.append(x)
                    hi.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(part, pa.string()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=[key, "chunk_index", "chunk", "start", "stop"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, {OUT}")


def sized_by(strategy: Column) -> Column:
    """The chunker a document's front matter asks for."""
    return F.when(strategy == "dialogue", "dialogue").when(strategy == "markdown", "markdown").otherwise("paragraph")
