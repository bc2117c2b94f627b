"""Retrieval over a chunk table: vector, keyword, phrase and hybrid search with
filters, boosts, diversification, merging and context.

Everything is one lazy plan; the query side (a vector, a few terms) is a
literal. Ties are broken by the id. Null texts and vectors never match; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx

#: Constants of the fusion and of BM25.
RRF_K, K1, B = 60, 1.2, 0.75
NO_DIVERSITY = 999


@dataclass(frozen=True)
class SearchSpec:
    """A search request; what is None is not asked for."""

    text: str = ""
    vector: Sequence[float] | None = None
    mode: str = "hybrid"
    top_k: int = 10
    language: str | None = None
    book_id: str | None = None
    source_id: str | None = None
    chunk_type: str | None = None
    section: str | None = None
    tags: Sequence[str] = ()
    min_length: int = 100
    min_similarity: float = 0.0
    max_per_book: int = NO_DIVERSITY
    stop_languages: Sequence[str] | None = None
    exact_phrase: bool = False
    oversample: int = 5
    interests: Sequence[str] = field(default_factory=tuple)


def section_filter(c: Column, section: str) -> Column:
    """``main`` means main content or unclassified."""
    return c.isin("main_content", "") if section == "main" else c == section


def chunk_type_filter(c: Column, kind: str) -> Column:
    if kind == "content":
        return c.isin("content", "child")
    if kind == "annotations_and_comments":
        return c.isin("annotation", "calibre_comment")
    return c == kind


def source_filter(source_id: Column, catalogue_id: Column, wanted: str) -> Column:
    """A bare number may be the source or the catalogue id."""
    return (source_id == wanted) | (catalogue_id == int(wanted)) if wanted.isdigit() else source_id == wanted


def tag_set(c: Column) -> Column:
    """Trimmed lower-case tags of a comma list."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), ","), lambda x: F.trim(x)), lambda t: t != "")


def has_tags(c: Column, wanted: Sequence[str]) -> Column:
    w = F.array(*[F.lit(t.strip().lower()) for t in wanted])
    return F.size(F.array_except(w, tag_set(c))) == 0


def conditions(s: SearchSpec) -> Column:
    parts = [F.lit(True)]
    if s.language:
        parts.append(F.col("language") == s.language)
    if s.book_id:
        parts.append(F.col("book_id") == s.book_id)
    if s.source_id:
        parts.append(source_filter(F.col("source_id"), F.col("calibre_id"), s.source_id))
    if s.chunk_type:
        parts.append(chunk_type_filter(F.col("chunk_type"), s.chunk_type))
    if s.section:
        parts.append(section_filter(F.col("section_type"), s.section))
    return reduce(Column.__and__, parts)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when((F.size(vector) == len(query)) & (own > 0) & F.lit(norm > 0), dot / (own * norm))


def ranked(df: DataFrame, score: str = "score", k: int | None = None) -> DataFrame:
    """The k best by score, ties by id, with their rank. The window runs over
    the k rows that the top-k has left."""
    order = [F.col(score).desc(), F.col("id")]
    if k is not None:
        df = df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def vector_search(chunks: DataFrame, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest by cosine; filters act before the cut."""
    d = chunks if where is None else chunks.filter(where)
    d = d.withColumn("score", F.round(cosine(F.col("vector"), query), 6)).filter("score is not null and not isnan(score)")
    return ranked(d.drop("vector"), k=k)


def bm25(chunks: DataFrame, terms: Sequence[str], where: Column | None = None, text: str = "text") -> DataFrame:
    """Scores of the chunks that hold a term. Counts are over the whole table,
    filters over the candidates; two passes, each with a partial aggregate."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    d = chunks.withColumn("_tok", tx.tokens(F.col(text)))
    same = lambda t: lambda x: x == F.lit(t)
    tf = [F.size(F.filter("_tok", same(t))).alias(f"_tf{i}") for i, t in enumerate(terms)]
    d = d.withColumn("_len", F.size("_tok")).select("*", *tf).drop("_tok")
    stats = d.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(terms))])
    d = (d if where is None else d.filter(where)).join(F.broadcast(stats))  # one row of counts
    score = F.lit(0.0)
    for i in range(len(terms)):
        n, df, t = F.col("_n"), F.col(f"_df{i}"), F.col(f"_tf{i}")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    any_ = reduce(Column.__or__, [F.col(f"_tf{i}") > 0 for i in range(len(terms))], F.lit(False))
    return d.filter(any_).withColumn("score", F.round(score, 6)).drop(*[c for c in d.columns if c.startswith("_")])


def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Inverted index: (term, id, tf, len). Written bucketed by term it answers
    a query by reading the query's buckets only."""
    d = chunks.select("id", tx.tokens(F.col(text)).alias("t"))
    return d.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("term", "id", "len").agg(F.count("*").alias("tf"))


def keyword_search(chunks: DataFrame, query: str, k: int, where: Column | None = None) -> DataFrame:
    terms = [t for t in "".join(c if c.isalnum() else " " for c in query.lower()).split()]
    if not terms:
        return ranked(chunks.drop("vector").withColumn("score", F.lit(0.0)).filter(F.lit(False)), k=k)
    return ranked(bm25(chunks.drop("vector"), terms, where), k=k)


def exact_phrase(chunks: DataFrame, phrase: str, k: int, where: Column | None = None) -> DataFrame:
    """Texts that hold the phrase, by how often; white space and case do not count."""
    p = " ".join(phrase.lower().split())
    d = (chunks if where is None else chunks.filter(where)).drop("vector")
    t = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+", " "))
    n = ((F.length(t) - F.length(F.replace(t, F.lit(p), F.lit("")))) / len(p)).cast("int") if p else F.lit(0)
    d = d.withColumn("occurrences", n).filter("occurrences > 0").withColumn("score", F.least(F.col("occurrences") / 10.0, F.lit(1.0)))
    o = [F.col("occurrences").desc(), F.col("id")]
    return d.orderBy(*o).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*o)))


def hybrid_search(chunks: DataFrame, query: str, vector: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    """Vector and keyword lists of length k, fused by reciprocal ranks."""
    v = vector_search(chunks, vector, k, where).select("id", F.col("rank").alias("vr"))
    t = keyword_search(chunks, query, k, where).select("id", F.col("rank").alias("tr"))
    f = v.join(t, "id", "full_outer").select("id", F.round(F.coalesce(1 / (RRF_K + F.col("vr")), F.lit(0.0)) + F.coalesce(1 / (RRF_K + F.col("tr")), F.lit(0.0)), 9).alias("score"))
    return ranked(f, k=k).join(chunks.drop("vector"), "id")


def boost(results: DataFrame, query: str) -> DataFrame:
    """Comments count 1.2 times, a query word that is a tag 1.15 times."""
    q = query.lower().split()
    tags = F.split(F.lower(F.coalesce("tags", F.lit(""))), ", ")
    hit = F.arrays_overlap(tags, F.array(*[F.lit(w) for w in q])) if q else F.lit(False)
    s = F.col("score") * F.when(F.col("chunk_type") == "calibre_comment", 1.2).otherwise(1.0) * F.when(hit, 1.15).otherwise(1.0)
    return ranked(results.drop("rank").withColumn("score", F.round(s, 9)))


def interest_boost(results: DataFrame, keywords: Sequence[str], factor: float = 0.1) -> DataFrame:
    """The governing score (of the reranker, if there is one) times 1 + factor
    for each keyword found; the rank field stays."""
    hay = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("tags", F.lit("")))
    m = 1 + factor * tx.keyword_matches(hay, keywords)
    if "rerank_score" not in results.columns:
        return results.withColumn("score", F.round(F.col("score") * m, 9))
    own = F.col("rerank_score").isNotNull()
    return results.withColumns({"rerank_score": F.when(own, F.col("rerank_score") * m), "score": F.when(own, F.col("score")).otherwise(F.col("score") * m)})


def diversify(results: DataFrame, max_per_book: int, k: int, book: str = "book_id") -> DataFrame:
    """In rank order at most so many per book, cut at k, ranked anew."""
    if max_per_book >= NO_DIVERSITY:
        return results.filter(F.col("rank") <= k)
    w = Window.partitionBy(book).orderBy("rank")
    d = results.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_per_book).drop("_n")
    d = d.orderBy("rank").limit(k)
    return d.withColumn("rank", F.row_number().over(Window.orderBy("rank")))


def search(chunks: DataFrame, s: SearchSpec) -> DataFrame:
    """The request's whole chain: function words, mode, boosts, length, tags,
    diversity, similarity, in that order. The cut at the oversampled length
    comes before the later filters, as the similarity cut leaves gaps in ranks."""
    take = s.top_k if s.max_per_book >= NO_DIVERSITY else s.top_k * s.oversample
    where = conditions(s)
    query = s.text if s.exact_phrase else tx.drop_stop_words(s.text, s.stop_languages)
    if s.exact_phrase:
        r = exact_phrase(chunks, s.text, take, where)
    elif s.mode == "semantic":
        r = vector_search(chunks, s.vector or [], take, where)
    elif s.mode == "keyword":
        r = keyword_search(chunks, query, take, where)
    else:
        r = boost(hybrid_search(chunks, query, s.vector or [], take, where), query)
    if s.min_length:
        r = r.filter(F.length("text") >= s.min_length)
    if s.tags:
        r = r.filter(has_tags(F.col("tags"), s.tags))
        r = r.withColumn("rank", F.row_number().over(Window.orderBy("rank")))
    r = diversify(r, s.max_per_book, s.top_k)
    if s.min_similarity > 0 and s.mode == "semantic":
        r = r.filter(F.col("score") >= s.min_similarity)
    return interest_boost(r, s.interests) if s.interests else r


def merge_sources(results: DataFrame, k: int, source: str = "source") -> DataFrame:
    """One list of several sources' lists: by the reranker's score where all
    rows have one, else interleaved by the rank within the source."""
    every = results.agg(F.coalesce(F.min(F.col("rerank_score").isNotNull()), F.lit(False)).alias("_all"))
    d = results.join(F.broadcast(every))
    key = F.when(F.col("_all"), F.col("rerank_score")).otherwise(1 / (RRF_K + F.col("rank")))
    o = [F.col("_key").desc(), F.col(source), F.col("id")]
    d = d.withColumn("_key", key).orderBy(*o).limit(k)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(*o))).drop("_key", "_all")


def overlap_score(text: Column, query: str) -> Column:
    """A deterministic stand-in for a reranking model: the share of the query's
    words that the text holds."""
    q = sorted(set(query.lower().split()))
    t = tx.tokens(text)
    return F.round(F.size(F.array_intersect(F.array(*[F.lit(w) for w in q]), t)) / max(1, len(q)), 6)


def rerank(results: DataFrame, query: str, k: int, scorer=overlap_score) -> DataFrame:
    """Scored anew, cut to three times k, ranked anew."""
    d = results.withColumn("rerank_score", scorer(F.col("text"), query))
    o = [F.col("rerank_score").desc(), F.col("rank")]
    return d.orderBy(*o).limit(3 * k).withColumn("rank", F.row_number().over(Window.orderBy(*o)))


def above(results: DataFrame, threshold: float) -> DataFrame:
    """Rows without a reranker's score pass."""
    return results.filter(F.col("rerank_score").isNull() | (F.col("rerank_score") >= threshold))


def with_context(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """The parent's text where there is one, else the text itself."""
    parents = chunks.filter("chunk_type = 'parent'").select(F.col("id").alias("parent_id"), F.col("text").alias("_parent"))
    r = results.join(parents, "parent_id", "left")
    return r.withColumn("context", F.coalesce(F.when(F.length("_parent") > 0, F.col("_parent")), F.col("text"))).drop("_parent")


def snippet(text: Column, phrase: str, around: int = 200, plain: int = 300) -> Column:
    """The surroundings of the first place of the phrase, else of its earliest
    word, else the beginning."""
    low = F.lower(text)
    p = F.locate(phrase.lower(), low)
    firsts = [F.locate(w, low) for w in phrase.lower().split()]
    word = F.least(*[F.when(f > 0, f) for f in firsts]) if len(firsts) > 1 else F.when(firsts[0] > 0, firsts[0])
    at = F.when(p > 0, p).otherwise(word)
    size = F.when(p > 0, F.lit(len(phrase))).otherwise(F.lit(0))
    lo = F.greatest(at - around, F.lit(1))
    hi = F.least(at + size + around, F.length(text) + 1)
    cutout = F.concat(F.when(lo > 1, "...").otherwise(""), F.substring(text, lo, hi - lo), F.when(hi <= F.length(text), "...").otherwise(""))
    return F.when(at.isNotNull(), cutout).otherwise(F.concat(F.substring(text, 1, plain), F.when(F.length(text) > plain, "...").otherwise("")))


def highlight(text: Column, terms: Sequence[str]) -> Column:
    for t in sorted(set(terms), key=len, reverse=True):
        text = F.regexp_replace(text, f"(?iu)({tx.escape(t)})", "**$1**")
    return text


def citation(author: Column, title: Column, year: Column, page_label: Column, page: Column) -> Column:
    """Author, title (year), page: the printed label before the counted page."""
    p = F.when(F.coalesce(page_label, F.lit("")) != "", page_label).when(page > 0, page.cast("string"))
    return F.concat_ws(", ", F.when(author != "", author), F.concat(title, F.when(year > 0, F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise("")), F.concat(F.lit("p. "), p))


def band(score: Column) -> Column:
    return F.when(score > 0.8, "very high").when(score > 0.6, "high").otherwise("medium")


def prompt(results: DataFrame) -> DataFrame:
    """One text: the results as numbered documents, with its rough size."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    doc = F.concat(F.lit('<document id="doc_'), F.col("rank").cast("string"), F.lit('">'), esc(F.col("text")), F.lit("</document>"))
    d = results.select("rank", doc.alias("doc"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda x: x["doc"]), "\n")
    return d.agg(joined.alias("prompt")).withColumn("approx_tokens", tx.word_count(F.col("prompt")))
