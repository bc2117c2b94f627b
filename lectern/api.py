"""The library's verbs as functions from tables to DataFrames.

Every verb takes a ``Library`` and returns a DataFrame; nothing is collected
except one query vector. ``main`` is the command line over them.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import catalogue as C
from lectern.operators import chunking, ledger, quality, retrieval
from lectern.operators.models import embed
from lectern.operators.sync import upsert
from lectern.sources import exports, folders
from lectern.tables import book_view, chunk_view, conform, load


@dataclass
class Library:
    """Where the tables lie, and the hooks that models plug into: an embedder is
    a function from a text column to a vector column, a reranker one from a text
    column and a query to a score column, a chunker one from a text to spans."""

    spark: SparkSession
    path: str
    embedder: Callable[[Column], Column] = embed
    reranker: Callable[[Column, str], Column] = retrieval.overlap_score
    chunker: str | Callable[[str], list[tuple[int, int]]] = "paragraph"
    interests: Sequence[str] = field(default_factory=tuple)

    def chunks(self) -> DataFrame:
        return chunk_view(self.spark, self.path)

    def books(self) -> DataFrame:
        return book_view(self.spark, self.path)

    def query_vector(self, text: str) -> list[float]:
        one = self.spark.createDataFrame([(text,)], "t string")
        return list(one.select(self.embedder(F.col("t"))).first()[0])


def search_books(lib: Library, text: str, mode: str = "keyword", top_k: int = 10, max_per_book: int = 3, rerank: bool = False, **filters) -> DataFrame:
    vector = None if mode == "keyword" else lib.query_vector(text)
    wide = 30 if rerank else top_k
    spec = retrieval.SearchSpec(text=text, mode=mode, vector=vector, top_k=wide, max_per_book=retrieval.NO_DIVERSITY if rerank else max_per_book, interests=tuple(lib.interests), **filters)
    r = retrieval.search(lib.chunks(), spec)
    if rerank:
        r = retrieval.diversify(retrieval.rerank(r, text, top_k, lib.reranker), max_per_book, top_k)
    return r.withColumn("citation", retrieval.citation(*[F.col(c) for c in ("author", "book_title", "year", "page_label", "page_number")]))


def search_annotations(lib: Library, text: str, top_k: int = 20) -> DataFrame:
    return search_books(lib, text, top_k=top_k, max_per_book=5, chunk_type="annotations_and_comments", min_length=0)


def exact_phrase(lib: Library, phrase: str, top_k: int = 20) -> DataFrame:
    return search_books(lib, phrase, top_k=top_k, max_per_book=retrieval.NO_DIVERSITY, exact_phrase=True, min_length=0)


def book_details(lib: Library, source_id: str) -> DataFrame:
    return lib.books().filter(F.col("source_id") == source_id)


def list_books(lib: Library, author: str = "", tags: Sequence[str] = (), years: tuple[int, int] | None = None, sort: str = "year") -> DataFrame:
    return C.by_author(lib.books(), author, tags, years, sort)


def list_tags(lib: Library, at_least: int = 1, top: int = 100) -> DataFrame:
    return C.count_each(lib.books(), "tags", "tag").filter(F.col("books") >= at_least).orderBy(F.col("books").desc(), "tag").limit(top)


def list_annotated(lib: Library) -> DataFrame:
    return lib.chunks().filter("chunk_type = 'annotation'").groupBy("book_id").agg(F.count("*").alias("annotations")).orderBy(F.col("annotations").desc(), "book_id")


def duplicates(lib: Library, method: str = "title_author") -> DataFrame:
    return C.duplicates(lib.books(), method)


def bibliography(lib: Library, style: str = "bibtex") -> DataFrame:
    return C.bibliography(lib.books(), style)


def statistics(lib: Library) -> DataFrame:
    return C.bundle(lib.books()).unionByName(quality.index_stats(lib.chunks()).select("metric", F.col("value"), F.col("n").alias("books")))


def chunk_quality(lib: Library) -> DataFrame:
    return quality.chunk_scores(lib.chunks())


def missing_metadata(lib: Library) -> DataFrame:
    return C.missing_fields(lib.books())


def due(lib: Library) -> DataFrame:
    return ledger.due_documents(load(lib.spark, lib.path, "catalogue"), load(lib.spark, lib.path, "index_log"), load(lib.spark, lib.path, "index_runs"))


def prepare(lib: Library, folder: str) -> DataFrame:
    """A folder's documents as conformed chunks without vectors."""
    d = folders.documents(lib.spark, folder).filter("text is not null")
    c = chunking.chunk(d.select("doc_id", "text"), "doc_id", "text", lib.chunker)
    c = c.join(d.select("doc_id", "title", "author", "format", "path"), "doc_id")
    c = c.select(F.concat_ws("_", "doc_id", F.lit("chunk"), F.col("chunk_index").cast("string")).alias("id"), F.col("chunk").alias("text"), F.col("doc_id").alias("book_id"), F.col("doc_id").alias("source_id"), F.col("title").alias("book_title"), "author", "format", F.col("path").alias("source_file"), "chunk_index", F.col("start").alias("char_start"), F.col("stop").alias("char_end"))
    return conform(c)


def index(lib: Library, folder: str, target: str) -> DataFrame:
    """Prepare, embed and fold into a table of chunks; gives the new table."""
    new = prepare(lib, folder).withColumn("vector", lib.embedder(F.col("text")).cast("array<float>")).withColumn("indexed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    out = upsert(lib.chunks(), new)
    out.write.mode("errorifexists").parquet(target)
    return lib.spark.read.parquet(target)


def import_clippings(lib: Library, file: str) -> DataFrame:
    """A clippings file's records with the documents they belong to."""
    t = lib.spark.read.text(file, wholetext=True).select(F.col("value").alias("text"))
    r = exports.clippings(t).withColumn("item", F.concat_ws("|", "title", "author"))
    items = r.select("item", "title", "author", F.lit(None).cast("string").alias("code")).distinct()
    m = C.match(items, lib.books()).select("item", F.col("book").alias("source_id"), "score", "how")
    return r.join(m, "item", "left").drop("item")


VERBS = {
    "query": search_books, "annotations": search_annotations, "phrase": exact_phrase, "details": book_details, "books": list_books, "tags": list_tags, "annotated": list_annotated,
    "duplicates": duplicates, "bibliography": bibliography, "stats": statistics, "quality": chunk_quality, "missing": missing_metadata, "due": due, "prepare": prepare, "import-annotations": import_clippings, "index": index,
}


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lectern", description="Search and upkeep of a document library on Spark.")
    p.add_argument("library", help="folder with the tables")
    p.add_argument("verb", choices=sorted(VERBS))
    p.add_argument("args", nargs="*", help="arguments of the verb, in order")
    p.add_argument("--rows", type=int, default=20, help="rows to show")
    a = p.parse_args(argv)
    from lectern.session import get_session

    spark = SparkSession.getActiveSession() or get_session()
    VERBS[a.verb](Library(spark, a.library), *a.args).drop("vector").show(a.rows, truncate=80)


if __name__ == "__main__":
    main()
