"""Sections of pages, comments and tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx


def page_section(text: Column, label: Column, share: Column) -> Column:
    """The kind of a page by its first lines, by the look of an index (short
    lines that end in numbers), or by a roman label at the beginning."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    head = F.array_join(F.slice(lines, 1, 5), "\n")
    n = F.size(lines)
    refs = F.size(F.filter(lines, lambda x: x.rlike(r"\d+(?:\s*[,–-]\s*\d+)*$")))
    short = F.size(F.filter(lines, lambda x: F.length(x) < 60))
    index_like = (n >= 10) & (refs > 0.5 * n) & (short > 0.7 * n)
    return F.when(tx.has_keyword(head, tx.BACK) | index_like, "back_matter").when(tx.has_keyword(head, tx.FRONT) | (tx.roman(label).isNotNull() & (share < 0.05)), "front_matter").otherwise("main_content")


def paragraph_starts(line: Column, before: Column, width: Column) -> Column:
    """Whether a line begins a paragraph: indented, or a capital after a short
    line that ends a sentence; never after a hyphen."""
    ended = F.substring(F.rtrim(before), -1, 1).isin(*tx.SENTENCE_END)
    capital = F.ltrim(line).rlike(r"^\p{Lu}")
    return before.isNull() | (~F.rtrim(before).endswith("-") & (line.rlike(r"^ {4,}\S") | (ended & capital & (F.length(F.rtrim(before)) < 0.8 * width))))


def comment_sections(comments: DataFrame, key: str, html: str) -> DataFrame:
    """Parts of a description between its first three levels of headings and
    rules; parts of fewer than 15 words join the part before."""
    parts = F.filter(F.split(F.col(html), r"(?i)(?=<h[1-3]\b)|<hr\s*/?>"), lambda x: tx.strip_tags(x) != "")
    d = comments.select(key, F.posexplode(parts).alias("i", "part"))
    d = d.withColumn("title", F.nullif(tx.strip_tags(F.regexp_extract("part", r"(?is)^<h[1-3][^>]*>(.*?)</h[1-3]>", 1)), F.lit(""))).withColumn("text", tx.strip_tags(F.regexp_replace("part", r"(?is)^<h[1-3][^>]*>.*?</h[1-3]>", "")))
    w = Window.partitionBy(key).orderBy("i")
    big = ((tx.word_count(F.col("text")) >= 15) | (F.col("i") == 0)).cast("int")
    d = d.withColumn("section", F.sum(big).over(w))
    return d.groupBy(key, "section").agg(F.max_by("title", F.struct(F.col("title").isNotNull(), -F.col("i"))).alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n").alias("text"))


def key_passages(html: Column) -> Column:
    """Bold and fourth-level passages of a description."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<(?:b|strong|h4)\b[^>]*>(.*?)</(?:b|strong|h4)>"), F.lit(1))
    return F.filter(F.transform(found, tx.strip_tags), lambda x: x != "")


def language_by_words(text: Column, least: int = 50, sure: float = 0.0) -> Column:
    """A language by the share of its function words; null for short texts. A
    plain stand-in where no trained profile is at hand."""
    t = tx.tokens(text)
    share = lambda ws: F.size(F.filter(t, lambda x: x.isin(*ws))) / F.greatest(F.size(t), F.lit(1))
    each = F.array(*[F.struct(share(ws).alias("s"), F.lit(k).alias("k")) for k, ws in sorted(tx.STOP_WORDS.items())])
    best = F.array_max(each)
    return F.when((F.length(text) >= least) & (best["s"] > sure), best["k"])


def toc_ranges(toc: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each entry with the first and last content chunk on its pages: the pages
    up to the next entry. Entries and chunks meet in one ordered stream."""
    from lectern.operators.ordered import range_map

    m = range_map(chunks.select("book_id", "page_number", "chunk_index", "id"), toc, "book_id", "page_number", "entry").filter("entry is not null")
    return m.groupBy("book_id", "entry").agg(F.min("chunk_index").alias("first_chunk"), F.max("chunk_index").alias("last_chunk"), F.count("*").alias("chunks"))
