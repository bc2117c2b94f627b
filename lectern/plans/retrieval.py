"""Search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import retrieval as R
from lectern.operators.indexes import KeywordIndex, VectorIndex
from lectern.plans.sql import CHUNKS, COSINE, OK, QUERY, bm25
from lectern.session import shared_dir
from lectern.tables import chunk_view

PHRASE, WORDS = "the order of the chapters", "winter storms register"
TERMS = WORDS.split()


def _vector(chunks: DataFrame) -> list[float]:
    """The first usable vector by id (one row)."""
    v = F.col("vector")
    ok = (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    row = chunks.filter(ok).orderBy("id").select("vector").first()
    return list(row[0]) if row else [0.0] * 64


def _spec(c: DataFrame, **kw) -> R.SearchSpec:
    return R.SearchSpec(text=WORDS, vector=_vector(c) if kw.get("mode", "hybrid") != "keyword" else None, **kw)


def re1_vector_search(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    return R.vector_search(c, _vector(c), 20).select("id", "score", "rank")


def re1_vector_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    s = R.SearchSpec(language="en", section="main", chunk_type="content")
    return R.vector_search(c, _vector(c), 20, R.conditions(s)).select("id", "score", "rank", "language", "section_type", "chunk_type")


def re2_bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_search(chunk_view(spark, d), WORDS, 25).select("id", "score", "rank")


def _index_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"


def re2_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same search over stored postings: only the terms' buckets are read."""
    index = KeywordIndex(spark, _index_path(spark)).add(chunk_view(spark, d), buckets=16)
    return index.search(WORDS, 25).select("id", "score", "rank")


def re1_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same search over stored lists, all of them probed, which is exact."""
    c = chunk_view(spark, d)
    return VectorIndex(spark, _index_path(spark)).add(c).search(_vector(c), 20, probes=1 << 30).select("id", "score", "rank")


def re2_postings(spark: SparkSession, d: str) -> DataFrame:
    p = R.postings(chunk_view(spark, d))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).filter("df >= 20")


def re3_hybrid(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    return R.hybrid_search(c, WORDS, _vector(c), 30).select("id", "score", "rank")


def re4_search_chain(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    return R.search(c, _spec(c, mode="semantic", language="en", top_k=10, max_per_book=2, min_similarity=0.2)).select("id", "book_id", "score", "rank")


def re4_search_keyword(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    return R.search(c, R.SearchSpec(text="the winter storms of the register", mode="keyword", top_k=15, max_per_book=1, stop_languages=["en"])).select("id", "book_id", "score", "rank")


def re5_stop_words(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d).select("id", "text")
    return c.select("id", tx.stop_word_free(F.col("text"), ["en"]).alias("cleaned"))


def re7_exact_phrase(spark: SparkSession, d: str) -> DataFrame:
    return R.exact_phrase(chunk_view(spark, d), PHRASE, 40).select("id", "occurrences", "score", "rank")


def re9_book_ids(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    n = F.col("source_id").rlike(r"^\d+$")
    return c.groupBy("source_id").agg(F.count("*").alias("n")).select("source_id", F.when(n, F.col("source_id").try_cast("bigint")).alias("catalogue_id"), "n")


def re10_service(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    r = R.search(c, _spec(c, mode="semantic", top_k=30))
    r = R.rerank(r.select("id", "book_id", "text", "score", "rank"), WORDS, 10)
    return R.above(R.diversify(r, 3, 10), 0.0).select("id", "book_id", "rerank_score", "rank")


def re12_annotations(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    return R.search(c, R.SearchSpec(text="letter harbour", mode="keyword", chunk_type="annotations_and_comments", top_k=20, max_per_book=5, min_length=0)).select("id", "book_id", "chunk_type", "score", "rank")


def _per_source(spark: SparkSession, d: str) -> DataFrame:
    """Three sources, by the book's number; each searched on its own."""
    c = chunk_view(spark, d).withColumn("source", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("calibre_id") % 3 + 1).cast("int")))
    w = Window.partitionBy("source").orderBy(F.col("score").desc(), "id")
    s = R.bm25(c.drop("vector"), TERMS).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 20)
    return s.withColumn("rerank_score", F.lit(None).cast("double"))


def re13_federated(spark: SparkSession, d: str) -> DataFrame:
    return R.merge_sources(_per_source(spark, d), 25).select("id", "source", "rank")


def re14_federated_raw(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(_per_source(spark, d).drop("rank").filter("chunk_type = 'annotation'"), k=25).select("id", "source", "score", "rank")


def re15_context(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    kids = c.filter("chunk_type = 'child'").drop("vector")
    return R.with_context(kids, c.drop("vector")).select("id", F.length("context").cast("bigint").alias("n"), F.md5("context").alias("hash"))


def re16_snippet(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    return c.select("id", F.md5(R.snippet(F.col("text"), "winter storms")).alias("snippet_hash"))


def re17_highlight(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d).filter(F.lower("text").contains("storms"))
    return c.select("id", F.md5(R.highlight(F.col("text"), ["storms", "winter storms"])).alias("hash"))


def re18_citation(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    return c.select("id", R.citation(*[F.col(x) for x in ("author", "book_title", "year", "page_label", "page_number")]).alias("citation"))


def re19_prompt(spark: SparkSession, d: str) -> DataFrame:
    r = R.keyword_search(chunk_view(spark, d), WORDS, 5)
    return R.prompt(r).select(F.md5("prompt").alias("hash"), F.col("approx_tokens").cast("bigint").alias("approx_tokens"))


def re20_by_book(spark: SparkSession, d: str) -> DataFrame:
    return chunk_view(spark, d).filter("book_id = 'b000000003'").orderBy("chunk_index", "id").limit(50).select("id", "chunk_index", "chunk_type")


def re21_embedding(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in model: words hashed into 64 signed places, unit length."""
    from lectern.operators.models import embed

    return chunk_view(spark, d).select("id", embed(F.col("text")).alias("v")).select("id", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"))


def re23_bands(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    r = R.vector_search(c, _vector(c), 200)
    return r.groupBy(R.band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


def wi4_boost(spark: SparkSession, d: str) -> DataFrame:
    r = R.keyword_search(chunk_view(spark, d), "storms philology", 40)
    return R.boost(r, "storms philology").select("id", "score", "rank")


def wi5_interests(spark: SparkSession, d: str) -> DataFrame:
    r = R.keyword_search(chunk_view(spark, d), WORDS, 30)
    return R.interest_boost(r, ["harbour", "storm", "memory"], 0.1).select("id", "score", "rank")


def wi2_diversify(spark: SparkSession, d: str) -> DataFrame:
    r = R.keyword_search(chunk_view(spark, d), WORDS, 60)
    return R.diversify(r, 2, 15).select("id", "book_id", "rank")


def fi6_tags(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    return c.filter(R.has_tags(F.col("tags"), ["History"])).groupBy("tags").agg(F.count("*").alias("n"))


def fi1_filters(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    s = R.SearchSpec(language="de", section="main", chunk_type="annotations_and_comments")
    return c.filter(R.conditions(s)).groupBy("language", "section_type", "chunk_type").agg(F.count("*").alias("n"))


def fi4_source_match(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    return c.filter(R.source_filter(F.col("source_id"), F.col("calibre_id"), "17")).select("id", "source_id", "calibre_id")


def fi7_min_length(spark: SparkSession, d: str) -> DataFrame:
    return chunk_view(spark, d).groupBy((F.length("text") >= 100).alias("long_enough")).agg(F.count("*").alias("n"))


def fi14_keywords(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    k = ["map", "seal", "règle", "bücher", "order of the chapters"]
    return c.select("id", tx.has_keyword(F.col("text"), k).alias("any_hit"), tx.keyword_matches(F.col("text"), k).cast("bigint").alias("hits"))


def jo9_parents(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_view(spark, d)
    p = c.filter("chunk_type = 'parent'").select(F.col("id").alias("parent_id"), F.col("chapter").alias("parent_chapter"))
    return c.filter("parent_id <> ''").select("id", "parent_id").join(p, "parent_id", "left").select("id", "parent_id", "parent_chapter")


_C = f"with {CHUNKS}"
_V = f"{_C}, {QUERY}, vs as (select ch.*, round({COSINE}, 6) score from ch, qv where {OK})"


def _top(frm: str, k: int, order: str = "score desc, id") -> str:
    return f"(select *, row_number() over (order by {order}) as rank from {frm} order by {order} limit {k})"


_KW = f"{_C}, {bm25(TERMS)}"
_FED = f"""{_C}, {bm25(TERMS)}, ks as (select kw.id, score, chunk_type, (['a', 'b', 'c'])[calibre_id % 3 + 1] as source from kw join ch using (id)),
  fe as (select * from (select *, row_number() over (partition by source order by score desc, id) as rk from ks) where rk <= 20)"""
_KEYS = ["map", "seal", "règle", "bücher", "order of the chapters"]
_hit = lambda k: rf"regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_\p{{M}}]){k}($|[^\p{{L}}\p{{N}}_\p{{M}}])')"

ORACLE = {
    "re1_vector_search": f"{_V} select id, score, rank from {_top('vs', 20)}",
    "re1_vector_search_filtered": f"{_V}, f as (select * from vs where language = 'en' and section_type in ('main_content', '') and chunk_type in ('content', 'child')) select id, score, rank, language, section_type, chunk_type from {_top('f', 20)}",
    "re2_stored": f"{_KW} select id, score, rank from {_top('kw', 25)}",
    "re1_stored": f"{_V} select id, score, rank from {_top('vs', 20)}",
    "re2_bm25": f"{_KW} select id, score, rank from {_top('kw', 25)}",
    "re2_postings": rf"{_C}, x as (select distinct id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) term from ch), y as (select unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) term from ch) select term, df, cf from (select term, count(*) df from x group by 1) join (select term, count(*) cf from y group by 1) using (term) where df >= 20",
    "re3_hybrid": f"{_V}, {bm25(TERMS)}, a as (select id, rank vr from {_top('vs', 30)}), b as (select id, rank tr from {_top('kw', 30)}), f as (select id, round(coalesce(1.0::double / (60 + vr), 0) + coalesce(1.0::double / (60 + tr), 0), 9) score from a full join b using (id)) select id, score, rank from {_top('f', 30)}",
    "re4_search_chain": f"{_V}, a as (select id, book_id, score, text, rank from {_top('(select * from vs where language = ' + chr(39) + 'en' + chr(39) + ')', 50)}), b as (select * from a where length(text) >= 100), c as (select *, row_number() over (partition by book_id order by rank) n from b), e as (select * from c where n <= 2 order by rank limit 10) select * from (select id, book_id, score, row_number() over (order by rank) as rank from e) where score >= 0.2",
    "re4_search_keyword": f"{_KW}, a as (select kw.id, book_id, text, score from kw join ch using (id)), b as (select * from {_top('a', 75)} where length(text) >= 100), c as (select *, row_number() over (partition by book_id order by rank) n from b), e as (select * from c where n <= 1 order by rank limit 15) select id, book_id, score, row_number() over (order by rank) as rank from e",
    "re7_exact_phrase": rf"{_C}, a as (select id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) t from ch), b as (select id, cast((length(t) - length(replace(t, '{PHRASE}', ''))) / {len(PHRASE)} as integer) occurrences from a), c as (select *, least(occurrences / 10.0::double, 1.0) score from b where occurrences > 0) select id, occurrences, score, rank from {_top('c', 40, 'occurrences desc, id')}",
    "re9_book_ids": rf"{_C} select source_id, case when regexp_full_match(source_id, '\d+') then try_cast(source_id as bigint) end catalogue_id, count(*) n from ch group by source_id",
    "re12_annotations": f"{_C}, {bm25(['letter', 'harbour'], chr(39).join(['chunk_type in (', 'annotation', ', ', 'calibre_comment', ')']))}, a as (select kw.id, book_id, chunk_type, score from kw join ch using (id)), b as (select * from {_top('a', 100)}), c as (select *, row_number() over (partition by book_id order by rank) n from b), e as (select * from c where n <= 5 order by rank limit 20) select id, book_id, chunk_type, score, row_number() over (order by rank) as rank from e",
    "re13_federated": f"{_FED} select id, source, row_number() over (order by 1.0::double / (60 + rk) desc, source, id) as rank from fe order by 1.0::double / (60 + rk) desc, source, id limit 25",
    "re14_federated_raw": f"{_FED}, a as (select * from fe where chunk_type = 'annotation') select id, source, score, rank from {_top('a', 25)}",
    "re15_context": f"{_C} select c.id, length(coalesce(case when length(p.text) > 0 then p.text end, c.text)) n, md5(coalesce(case when length(p.text) > 0 then p.text end, c.text)) hash from ch c left join ch p on p.id = c.parent_id and p.chunk_type = 'parent' where c.chunk_type = 'child'",
    "re16_snippet": f"""{_C}, a as (select id, text, instr(lower(text), 'winter storms') p, nullif(instr(lower(text), 'winter'), 0) w1, nullif(instr(lower(text), 'storms'), 0) w2 from ch),
      b as (select *, case when p > 0 then p else least(w1, w2) end pos, case when p > 0 then 13 else 0 end size from a), c as (select *, greatest(pos - 200, 1) lo, least(pos + size + 200, length(text) + 1) hi from b)
      select id, md5(case when pos is not null then (case when lo > 1 then '...' else '' end) || substr(text, lo, hi - lo) || (case when hi <= length(text) then '...' else '' end)
        else substr(text, 1, 300) || (case when length(text) > 300 then '...' else '' end) end) snippet_hash from c""",
    "re17_highlight": rf"{_C} select id, md5(regexp_replace(regexp_replace(text, '(winter storms)', '**\1**', 'gi'), '(storms)', '**\1**', 'gi')) hash from ch where contains(lower(text), 'storms')",
    "re18_citation": f"{_C} select id, concat_ws(', ', case when author <> '' then author end, book_title || case when year > 0 then ' (' || year || ')' else '' end, 'p. ' || case when page_label <> '' then page_label when page_number > 0 then cast(page_number as varchar) end) citation from ch",
    "re19_prompt": rf"""{_KW}, a as (select kw.id, score, text from kw join ch using (id)), t as (select * from {_top('a', 5)}),
      p as (select string_agg('<document id="doc_' || rank || '">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</document>', chr(10) order by rank) s from t) select md5(s) hash, len(regexp_extract_all(s, '\S+')) approx_tokens from p""",
    "re20_by_book": f"{_C} select id, chunk_index, chunk_type from ch where book_id = 'b000000003' order by chunk_index, id limit 50",
    "re23_bands": f"{_V} select case when score > 0.8 then 'very high' when score > 0.6 then 'high' else 'medium' end band, count(*) n from {_top('vs', 200)} group by 1",
    "wi4_boost": f"{_C}, {bm25(['storms', 'philology'])}, t as (select * from {_top('kw', 40)}), b as (select id, round(score * case when chunk_type = 'calibre_comment' then 1.2 else 1 end * case when list_has_any(string_split(lower(tags), ', '), ['storms', 'philology']) then 1.15 else 1 end, 9) score from t join ch using (id)) select id, score, row_number() over (order by score desc, id) as rank from b",
    "wi5_interests": f"{_KW}, t as (select * from {_top('kw', 30)}) select id, round(score * (1 + 0.1 * ({' + '.join('case when ' + _hit(k).replace('lower(text)', 'lower(concat_ws(' + chr(39) + ' ' + chr(39) + ', text, tags))') + ' then 1 else 0 end' for k in ('harbour', 'storm', 'memory'))})), 9) score, rank from t join ch using (id)",
    "wi2_diversify": f"{_KW}, a as (select kw.id, book_id, score from kw join ch using (id)), b as (select * from {_top('a', 60)}), c as (select *, row_number() over (partition by book_id order by rank) n from b), e as (select * from c where n <= 2 order by rank limit 15) select id, book_id, row_number() over (order by rank) as rank from e",
    "fi6_tags": f"{_C} select tags, count(*) n from ch where list_contains(list_transform(string_split(lower(tags), ','), lambda t: trim(t)), 'history') group by tags",
    "fi1_filters": f"{_C} select language, section_type, chunk_type, count(*) n from ch where language = 'de' and section_type in ('main_content', '') and chunk_type in ('annotation', 'calibre_comment') group by all",
    "fi4_source_match": f"{_C} select id, source_id, calibre_id from ch where source_id = '17' or calibre_id = 17",
    "fi7_min_length": f"{_C} select length(text) >= 100 long_enough, count(*) n from ch group by 1",
    "fi14_keywords": f"{_C} select id, ({' or '.join(_hit(k) for k in _KEYS)}) any_hit, {' + '.join(f'cast({_hit(k)} as bigint)' for k in _KEYS)} hits from ch",
    "jo9_parents": f"{_C} select c.id, c.parent_id, p.chapter parent_chapter from ch c left join ch p on p.id = c.parent_id and p.chunk_type = 'parent' where c.parent_id <> ''",
}
QUERIES = {k: f for k, f in list(globals().items()) if k[:2] in ("re", "wi", "fi", "jo") and k[2].isdigit() and callable(f)}
