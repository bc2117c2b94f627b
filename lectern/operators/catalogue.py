"""Catalogue analytics: statistics, missing metadata, lists, bibliography.

Works on one current row per document with array columns. Null arrays count as
empty; null years, publishers and languages as missing; ties go by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.session import cut


def arr(c: str) -> Column:
    return F.coalesce(F.col(c), F.array())


def authors_text(sep: str = " & ", unknown: str | None = None) -> Column:
    t = F.array_join(arr("authors"), sep)
    return F.when(F.size(arr("authors")) == 0, F.lit(unknown)).otherwise(t) if unknown is not None else t


def count_each(books: DataFrame, column: str, name: str) -> DataFrame:
    """Documents per value of an array column (each value once per document)."""
    return books.select(F.explode(F.array_distinct(arr(column))).alias(name)).groupBy(name).agg(F.count("*").alias("books"))


def count_by(books: DataFrame, column: str) -> DataFrame:
    return books.filter(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).groupBy(column).agg(F.count("*").alias("books"))


def missing_fields(books: DataFrame) -> DataFrame:
    """Documents with a missing field, and which."""
    flags = F.array_compact(
        F.array(
            F.when(F.size(arr("authors")) == 0, "authors"), F.when(F.coalesce("publisher", F.lit("")) == "", "publisher"), F.when(F.col("year").isNull(), "year"),
            F.when(F.size(arr("tags")) == 0, "tags"), F.when(F.coalesce("language", F.lit("")) == "", "language"), F.when(F.trim(F.coalesce("comments_html", F.lit(""))) == "", "comments"),
        )
    )
    d = books.withColumn("missing", flags).filter(F.size("missing") > 0)
    return d.select("source_id", "title", F.array_join("missing", ",").alias("missing"), F.size("missing").cast("bigint").alias("n_missing"))


def bundle(books: DataFrame) -> DataFrame:
    """All statistics in one table: (metric, value, books)."""
    parts = [count_each(books, c, "value").select(F.lit(c).alias("metric"), "value", "books") for c in ("authors", "tags")]
    parts += [count_by(books, c).select(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value"), "books") for c in ("publisher", "language", "series", "year", "file_format")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_author(books: DataFrame, name: str, tags: Sequence[str] = (), years: tuple[int, int] | None = None, sort: str = "year") -> DataFrame:
    """Documents with an author whose name holds the text, all tags by part of
    their names, within the years; newest first or by title."""
    low = name.lower()
    d = books.filter(F.exists(arr("authors"), lambda a: F.lower(a).contains(low)))
    for t in tags:
        d = d.filter(_any_contains(arr("tags"), t))
    if years:
        d = d.filter(F.col("year").between(*years))
    order = [F.coalesce("year", F.lit(0)).desc(), F.col("source_id")] if sort == "year" else [F.lower("title"), F.col("source_id")]
    return d.orderBy(*order)


def _any_contains(c: Column, part: str) -> Column:
    p = part.lower()
    return F.exists(c, lambda x: F.lower(x).contains(p))


def select_books(books: DataFrame, tag: str | None = None, rating: int | None = None, exact_rating: bool = False, excluded: Sequence[str] = (), authors: Sequence[str] = ()) -> DataFrame:
    """Documents to process: by tag (case does not count), rating, excluded
    tags, parts of authors' names; in tier order."""
    d = books
    low_tags = F.transform(arr("tags"), F.lower)
    if tag:
        d = d.filter(F.array_contains(low_tags, tag.lower()))
    if rating is not None:
        r = F.when(F.col("rating") > 0, F.col("rating"))
        d = d.filter(r.isNull() if exact_rating and rating == 0 else r == rating if exact_rating else r >= rating)
    if excluded:
        d = d.filter(~F.arrays_overlap(low_tags, F.array(*[F.lit(x.lower()) for x in excluded])))
    if authors:
        hit = F.lit(False)
        for a in authors:
            hit = hit | _any_contains(arr("authors"), a)
        d = d.filter(hit)
    return d.withColumn("tier", tier(F.col("rating")))


def tier(rating: Column) -> Column:
    """Order of ratings: 5, 4, 3, none, 2, 1."""
    return F.when(rating == 5, 0).when(rating == 4, 1).when(rating == 3, 2).when(rating == 2, 4).when(rating == 1, 5).otherwise(3)


def priority(books: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Asked-for documents first, then by stars, then the newest id."""
    w = F.col("source_id").isin(*wanted) if wanted else F.lit(False)
    stars = F.when(F.col("rating") == 5, 0).when(F.col("rating") == 4, 1).otherwise(2)
    o = [F.when(w, 0).otherwise(1), stars, F.col("calibre_id").desc(), F.col("source_id")]
    return books.withColumn("position", F.row_number().over(Window.orderBy(*o)))


def best_format(formats: Column, wanted: Sequence[str]) -> Column:
    """The first wanted format that is there, else the first there is."""
    f = F.transform(formats, F.lower)
    pick = [F.when(F.array_contains(f, w), F.lit(w)) for w in wanted]
    return F.coalesce(*pick, F.try_element_at(F.sort_array(f), F.lit(1)))


def bibliography(books: DataFrame, style: str = "bibtex") -> DataFrame:
    """One entry per document in a citation format."""
    year = F.col("year").cast("string")
    names = arr("authors")
    if style == "bibtex":
        key = F.concat(F.regexp_replace(F.lower(F.coalesce(F.element_at(F.split(F.try_element_at(names, F.lit(1)), ","), 1), F.lit("anon"))), r"[^\p{L}\p{N}]", ""), F.coalesce(year, F.lit("nd")))
        e = F.concat_ws(
            "\n", F.concat(F.lit("@book{"), key, F.lit(",")), F.concat(F.lit("  title = {"), F.col("title"), F.lit("},")),
            F.when(F.size(names) > 0, F.concat(F.lit("  author = {"), F.array_join(names, " and "), F.lit("},"))), F.concat(F.lit("  year = {"), year, F.lit("},")),
            F.concat(F.lit("  publisher = {"), F.col("publisher"), F.lit("},")), F.lit("}"),
        )
    elif style == "ris":
        e = F.concat_ws("\n", F.lit("TY  - BOOK"), F.when(F.size(names) > 0, F.array_join(F.transform(names, lambda a: F.concat(F.lit("AU  - "), a)), "\n")), F.concat(F.lit("TI  - "), F.col("title")), F.concat(F.lit("PY  - "), year), F.concat(F.lit("PB  - "), F.col("publisher")), F.lit("ER  - "))
    elif style == "csv":
        e = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in (F.col("title"), F.array_join(names, "; "), year, F.col("publisher"))])
    elif style == "json":
        e = F.to_json(F.struct("source_id", "title", F.array_join(names, "; ").alias("authors"), F.col("year")))
    else:
        e = F.concat_ws(". ", F.nullif(F.array_join(names, ", "), F.lit("")), F.concat(F.col("title"), F.coalesce(F.concat(F.lit(" ("), year, F.lit(")")), F.lit(""))), F.col("publisher"))
    return books.select("source_id", e.alias("entry"))


def duplicates(books: DataFrame, method: str) -> DataFrame:
    """(kind, value, ids, n): groups of documents that share an identifier, a
    title, or a normalised title with the same authors."""
    if method == "identifier":
        d = books.select("source_id", F.explode("identifiers").alias("t", "v")).filter(F.coalesce("v", F.lit("")) != "").select("source_id", F.concat_ws(":", "t", "v").alias("value"))
    elif method == "title":
        d = books.filter("title is not null").select("source_id", F.lower("title").alias("value"))
    elif method == "title_author":
        names = F.array_join(F.sort_array(F.transform(arr("authors"), lambda a: F.trim(F.lower(a)))), ", ")
        d = books.filter("title is not null").select("source_id", F.concat(tx.normal_title(F.col("title")), F.lit(" by "), names).alias("value"))
    else:  # a named method without a rule finds nothing
        d = books.select("source_id", F.lit("").alias("value")).filter(F.lit(False))
    g = d.distinct().groupBy("value").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("source_id")), ",").alias("ids")).filter("n > 1")
    return g.select(F.lit(method).alias("kind"), "value", "ids", "n")


def ordered_words(c: Column) -> Column:
    return F.array_join(F.sort_array(F.split(c, " ")), " ")


def sorted_words(c: Column) -> Column:
    return ordered_words(tx.normal_text(c))


def edit_likeness(x: Column, y: Column) -> Column:
    return F.round(100 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))), 4)


def similarity(a: Column, b: Column) -> Column:
    """Likeness of two texts by edit distance over sorted words, 0 to 100."""
    return edit_likeness(sorted_words(a), sorted_words(b))


#: Marks put before and after a text whose grams are counted.
EDGES = ("\x01", "\x02")


def alike(texts: DataFrame, share: float) -> DataFrame:
    """(t, bt, likeness): all pairs of an item's and a book's text (t, of_item,
    of_book) whose likeness reaches a share. An edit changes at most q of a text's
    grams, so such texts have so many grams in common that the rarest of them (as
    many as may differ, and one) must meet; no pair is lost. A share of nothing
    compares all."""
    off = 1 - share
    q = 3 if 1 - 3 * off >= 0.4 else 2 if 1 - 2 * off >= 0.2 else 1
    n = F.length("t")
    if share > 0:
        padded = F.concat(F.lit(EDGES[0] * (q - 1)), F.col("t"), F.lit(EDGES[1] * (q - 1)))
        grams = texts.select("*", F.explode(F.transform(F.sequence(F.lit(1), n + q - 1), lambda i: F.substring(padded, i, F.lit(q)))).alias("g"))
        grams = grams.groupBy("t", "of_item", "of_book", "g").agg(F.count("*").alias("k"))
        grams = grams.join(grams.groupBy("g").agg(F.count("*").alias("df")), "g").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
        rarest = Window.partitionBy("t").orderBy("df", "g", "k")
        first = grams.withColumn("r", F.row_number().over(rarest)).filter(F.col("r") <= n + 1 - F.ceil((1 - q * off) * n - 1e-9)).select("t", "of_item", "of_book", "g", "k")
        a, b = first.filter("of_item").select("t", "g", "k"), first.filter("of_book").select(F.col("t").alias("bt"), "g", "k")
        pairs = a.join(b, ["g", "k"])
    else:
        pairs = texts.filter("of_item").select("t").crossJoin(texts.filter("of_book").select(F.col("t").alias("bt")))
    m = F.length("bt")
    pairs = pairs.filter(F.least(n, m) >= share * F.greatest(n, m) - 1e-6).select("t", "bt").distinct()
    return pairs.withColumn("likeness", edit_likeness(F.col("t"), F.col("bt"))).filter(F.col("likeness") >= 100 * share - 1e-3)


def contenders(records: DataFrame, near: DataFrame, books: DataFrame) -> DataFrame:
    """(t, a, book, score): the best book of each record's (t, a) own author, and
    the books of others (bt, ba, book) that may still do as well. No author is
    nearer than the same one, so they need a title nearer than that book's, or no
    author at all and a title as near as its score."""
    scored = lambda a: F.round(0.7 * F.col("likeness") + 0.3 * a, 4)
    most = scored(F.lit(100.0))
    of_one = books.filter("ba <> ''").withColumnRenamed("ba", "a")
    same = records.filter("a <> ''").join(near, "t").join(of_one, ["bt", "a"])
    same = same.groupBy("t", "a").agg(F.max(F.struct(most.alias("score"), "book")).alias("m")).select("t", "a", "m.book", "m.score")
    rest = records.join(same.select("t", "a", F.col("score").alias("bar")), ["t", "a"], "left").join(near, "t")
    rest = rest.filter(F.col("bar").isNull() | (most > F.col("bar")) | (F.col("likeness") >= F.col("bar"))).join(books, "bt")
    rest = rest.filter(F.col("bar").isNull() | (most > F.col("bar")) | (F.col("ba") == ""))
    score = F.when((F.col("a") == "") | (F.col("ba") == ""), F.col("likeness")).otherwise(scored(edit_likeness(F.col("a"), F.col("ba"))))
    return same.unionByName(rest.select("t", "a", "book", score.alias("score")))


#: Fixed value: what a shop puts behind a title.
EDITION = r"(?i)\s*\([\p{L}\p{M}\p{N}_\s]+Edition\)\s*$"


def match(items: DataFrame, books: DataFrame, least: float = 80.0) -> DataFrame:
    """Links outside records (item, code, title, author) to documents: by code,
    then by normalised title where one author holds the other (an empty one fits
    all), then by the best likeness of title and author, or of the title alone
    where either has no author. A record's title counts without the name of its
    edition; records without a title are linked by code only."""
    items = items.withColumn("title", F.regexp_replace("title", EDITION, ""))
    b = books.select(F.col("source_id").alias("book"), "title", F.array_join(arr("authors"), " & ").alias("author"), F.map_values(F.coalesce("identifiers", F.create_map())).alias("codes"))
    code = items.filter(F.coalesce("code", F.lit("")) != "").select("item", F.upper("code").alias("k"))
    by_code = code.join(b.select("book", F.explode("codes").alias("k0")).select("book", F.upper("k0").alias("k")), "k").groupBy("item").agg(F.min("book").alias("book")).select("item", "book", F.lit(100.0).alias("score"), F.lit("code").alias("how"))
    names = lambda c: F.coalesce(tx.normal_text(F.col(c)), F.lit(""))
    left = items.join(by_code, "item", "left_anti").select("item", "title", names("title").alias("nt"), names("author").alias("na")).filter("nt <> ''")
    b = b.select("book", "title", names("title").alias("nt"), names("author").alias("ba")).filter("nt <> ''")
    exact = left.join(b.select("book", "nt", "ba"), "nt").filter(F.contains("na", "ba") | F.contains("ba", "na"))
    exact = exact.groupBy("item").agg(F.min("book").alias("book")).select("item", "book", F.lit(100.0).alias("score"), F.lit("exact").alias("how"))
    left = cut(left.join(exact, "item", "left_anti").select("item", sorted_words(F.col("title")).alias("t"), ordered_words(F.col("na")).alias("a")))
    b = cut(b.groupBy(sorted_words(F.col("title")).alias("bt"), ordered_words(F.col("ba")).alias("ba")).agg(F.max("book").alias("book")))
    out = by_code.unionByName(exact)
    # A record with a match over a higher bound has its best one there; only the rest is compared under the lower bound.
    for low in sorted({max(least, x) for x in (95.0, 80.0, least)}, reverse=True):
        share = (low - 1e-4 - 30) / 70  # of the title, where the authors are the same
        texts = left.select("t", F.lit(True).alias("of_item"), F.lit(False).alias("of_book")).unionByName(b.select(F.col("bt").alias("t"), F.lit(False).alias("of_item"), F.lit(True).alias("of_book")))
        texts = texts.groupBy("t").agg(F.max("of_item").alias("of_item"), F.max("of_book").alias("of_book"))
        # Each title and author once: many records share them.
        best = contenders(left.select("t", "a").distinct(), cut(alike(texts, share)), b).filter(F.col("score") >= low)
        best = best.groupBy("t", "a").agg(F.max_by("book", F.struct("score", "book")).alias("book"), F.max("score").alias("score"))
        fuzzy = left.join(best, ["t", "a"]).select("item", "book", "score", F.lit("fuzzy").alias("how"))
        if low > least:
            fuzzy = cut(fuzzy)
            left = left.join(fuzzy, "item", "left_anti")
        out = out.unionByName(fuzzy)
    return out
