"""Quality and state of a chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx

CONTENT = ("content", "child", "parent", "exchange")


def is_content(c: str = "chunk_type") -> Column:
    return F.col(c).isin(*CONTENT)


def index_stats(chunks: DataFrame) -> DataFrame:
    """(metric, value, n): totals and the four value counts, by one grouping."""
    kinds = ["chunk_type", "language", "section_type", "format"]
    g = chunks.groupingSets([[c] for c in kinds] + [[]], *kinds).agg(F.count("*").alias("n"), F.countDistinct("book_id").alias("b"), *[F.grouping(c).alias(f"g_{c}") for c in kinds])
    metric = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, c) for c in kinds], F.lit("total"))
    value = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.col(c)) for c in kinds], F.lit(""))
    rows = g.select(metric.alias("metric"), value.alias("value"), "n", "b")
    books = rows.filter("metric = 'total'").select(F.lit("books").alias("metric"), "value", F.col("b").alias("n"))
    return rows.select("metric", "value", "n").unionByName(books)


def books_indexed(chunks: DataFrame) -> DataFrame:
    first = lambda c: F.min_by(c, F.struct("chunk_index", "id")).alias(c)
    return chunks.groupBy("book_id").agg(first("book_title"), first("author"), first("format"), F.count("*").alias("chunks"), F.max("indexed_at").alias("last_indexed"))


def book_state(chunks: DataFrame) -> DataFrame:
    """Per book: counts and the stored hashes, those of content before those of comments."""
    c = is_content()
    h = lambda cond: F.max(F.when(cond & (F.col("metadata_hash") != ""), F.col("metadata_hash")))
    return chunks.groupBy("book_id").agg(
        F.count("*").alias("total"),
        F.sum(c.cast("long")).alias("content"),
        F.coalesce(h(c), h(F.col("chunk_type") == "calibre_comment"), F.lit("")).alias("metadata_hash"),
        F.max("annotation_hash").alias("annotation_hash"),
        F.max((F.col("chunk_type") == "phase1_metadata").cast("int")).alias("stub"),
        F.max("pending_external").alias("pending"),
    )


def repeated_ids(raw: DataFrame) -> DataFrame:
    """Per book: ids stored more than once and the rows too many."""
    g = raw.filter("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.min("book_id").alias("book_id")).filter("n > 1")
    return g.groupBy("book_id").agg(F.count("*").alias("ids"), F.sum(F.col("n") - 1).alias("excess"))


def missing_labels(chunks: DataFrame, over: float = 0.9) -> DataFrame:
    bad = (F.col("page_label") == "") | (F.col("page_label") == F.col("page_number").cast("string"))
    g = chunks.filter(is_content()).groupBy("book_id").agg(F.round(F.avg(bad.cast("double")), 6).alias("share"), F.min("indexed_at").alias("since"))
    return g.filter(F.col("share") > over)


def words_per_page(chunks: DataFrame) -> DataFrame:
    g = chunks.filter(is_content()).groupBy("book_id").agg(F.sum(tx.word_count(F.col("text"))).alias("words"), F.max("page_number").alias("pages"))
    return g.filter("pages > 0").select("book_id", "words", "pages", F.round(F.col("words") / F.col("pages"), 1).alias("words_per_page"))


def chunk_scores(chunks: DataFrame) -> DataFrame:
    """Per book 0 to 100: cut-off chunks, back matter in front, uneven and short
    chunks count down, section titles and pages up."""
    c = chunks.withColumn("_w", tx.word_count(F.col("text")))
    content = F.col("chunk_type").isin("content", "child")
    para = F.trim(F.element_at(F.split(F.rtrim("text"), "\n\n"), -1))
    cut = content & tx.truncated(F.col("text")) & (tx.word_count(para) > 20)
    last = c.filter("chunk_type <> 'parent'").groupBy("book_id").agg(F.max("chunk_index").alias("_max"))
    c = c.join(last, "book_id", "left")
    early = (F.col("chunk_type") != "parent") & (F.col("section_type") == "back_matter") & (F.col("chunk_index") < F.col("_max") * 0.9)
    n = F.sum(content.cast("int"))
    w = F.when(content, F.col("_w"))
    g = c.groupBy("book_id").agg(
        n.alias("n"), F.sum(cut.cast("int")).alias("cut"), F.sum(early.cast("int")).alias("early"), F.stddev_samp(w).alias("sd"), F.avg(w).alias("mean"),
        F.sum((content & (F.col("_w") < 50)).cast("int")).alias("short"), F.sum((content & ((F.col("section_title") != "") | (F.col("chapter") != ""))).cast("int")).alias("sec"),
        F.max((content & ((F.col("page_number") > 0) | (F.col("page_label") != ""))).cast("int")).alias("pages"),
    )
    d = F.greatest(F.col("n"), F.lit(1))
    early_rate = F.when(F.col("n") > 0, F.col("early") / d).otherwise(0.0)
    cv = F.when(F.col("n") == 0, 1.0).when(F.col("mean") > 0, F.coalesce("sd", F.lit(0.0)) / F.greatest("mean", F.lit(1e-9))).otherwise(0.0)
    s = 100 - 30 * F.col("cut") / d - 25 * early_rate - 10 * F.least(cv, F.lit(1.0)) - 15 * F.col("short") / d + 10 * F.col("sec") / d + 5 * F.col("pages")
    return g.select("book_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), s)), 1).alias("score"), d.cast("bigint").alias("content_chunks"), F.round(F.col("cut") / d, 3).alias("truncation_rate"), F.round(cv, 3).alias("cv"), F.round(F.col("short") / d, 3).alias("short_rate"))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    w = tx.word_count(F.col("text"))
    return chunks.withColumn("w", w).groupBy("book_id").agg(F.count("*").alias("chunks"), F.min("w").alias("min_words"), F.max("w").alias("max_words"), F.percentile("w", 0.5).alias("median_words"), F.round(F.avg("w"), 4).alias("mean_words"), F.round(F.coalesce(F.stddev_samp("w"), F.lit(0.0)), 4).alias("sd_words"))


def scanned(words_pages: DataFrame, books: DataFrame, least: float = 100.0) -> DataFrame:
    """PDF documents without chunks or with few words a page."""
    d = books.filter(F.lower("file_format") == "pdf").join(words_pages.select(F.col("book_id").alias("source_id"), "words_per_page"), "source_id", "left")
    return d.filter(F.col("words_per_page").isNull() | (F.col("words_per_page") < least)).select("source_id", "words_per_page")


def needs_ocr(pages: Column, words: Column, covered: Column, has_chunks: Column) -> Column:
    """Few words a page and text on few pages; short documents never."""
    return F.when((pages > 0) & (pages < 6), False).when(~has_chunks, True).otherwise((words / F.greatest(pages, F.lit(1)) < 150) & (covered < 0.4))
