"""Further queries: predicates, joins, composites and imports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import catalogue as C
from lectern.operators import ordered as O
from lectern.operators import quality as Q
from lectern.operators import retrieval as R
from lectern.operators import sections as X
from lectern.operators import sync as S
from lectern.plans import retrieval as PR
from lectern.plans import texts as PT
from lectern.plans import upkeep as PU
from lectern.plans.retrieval import TERMS, WORDS, _spec, _vector
from lectern.plans.sql import BOOKS, CHUNKS, COSINE, OK, QUERY, bm25
from lectern.tables import book_view, chunk_view, conform, load


def _c(spark, d):
    return chunk_view(spark, d).drop("vector")


def fi2_section(spark, d):
    c = _c(spark, d)
    return c.filter(R.section_filter(F.col("section_type"), "main")).groupBy("section_type").agg(F.count("*").alias("n"))


def fi3_types(spark, d):
    c = _c(spark, d)
    return c.filter(R.chunk_type_filter(F.col("chunk_type"), "content")).groupBy("chunk_type").agg(F.count("*").alias("n"))


def fi5_language(spark, d):
    return _c(spark, d).filter("language = 'fr'").select("id")


def fi8_similarity(spark, d):
    c = chunk_view(spark, d)
    return R.search(c, _spec(c, mode="semantic", top_k=40, min_similarity=0.3, min_length=0)).select("id", "score", "rank")


def fi9_threshold(spark, d):
    r = R.rerank(R.keyword_search(chunk_view(spark, d), WORDS, 30), WORDS, 10)
    return R.above(r, 0.5).select("id", "rerank_score")


def fi19_scores(spark, d):
    """One score from whichever a hit has: similarity, relevance or keyword."""
    h = load(spark, d, "search_hits").distinct()
    ok = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
    return h.select("query_id", "id", F.round(F.coalesce(1 - ok("_distance"), ok("_relevance_score"), ok("_score"), F.lit(0.0)), 6).alias("score"))


def jo2_outer(spark, d):
    b = book_view(spark, d)
    lang = b.select("source_id", "language").filter("coalesce(language, '') <> ''")
    pub = b.select("source_id", "publisher").filter("publisher is not null")
    return b.select("source_id", "title").join(lang, "source_id", "left").join(pub, "source_id", "left")


def jo4_scalar(spark, d):
    """A value per row from a grouped side: the most frequent chunk language."""
    n = _c(spark, d).groupBy("book_id", "language").agg(F.count("*").alias("n")).groupBy("book_id").agg(F.max_by("language", F.struct("n", "language")).alias("main_language"))
    return book_view(spark, d).select(F.col("source_id").alias("book_id")).join(n, "book_id", "left")


def jo5_semi(spark, d):
    a = _c(spark, d).filter("chunk_type = 'annotation'").select(F.col("book_id").alias("source_id"))
    return book_view(spark, d).select("source_id").join(a, "source_id", "left_semi")


def jo6_anti(spark, d):
    a = _c(spark, d).filter("chunk_type = 'annotation'").select(F.col("book_id").alias("source_id"))
    return book_view(spark, d).select("source_id").join(a, "source_id", "left_anti")


def jo8_full(spark, d):
    a, b = PU._stored(spark, d).select("item", F.col("hash").alias("stored")), PU._current(spark, d).select("item", F.col("hash").alias("current"))
    return a.join(b, "item", "full_outer")


def jo10_fuzzy(spark, d):
    """Best match of each title, with a letter more, among all documents."""
    b = book_view(spark, d)
    i = b.select(F.concat(F.lit("i"), "source_id").alias("item"), F.lit(None).cast("string").alias("code"), F.concat("title", F.lit("x")).alias("title"), F.array_join(C.arr("authors"), " & ").alias("author"))
    return C.match(i, b, 60.0).select("item", "score", "how")


def jo11_nearest(spark, d):
    c = chunk_view(spark, d)
    return R.vector_search(c, _vector(c), 1).select("id", "score")


def jo12_fused(spark, d):
    c = chunk_view(spark, d)
    return R.hybrid_search(c, WORDS, _vector(c), 10).groupBy((F.col("score") > 1 / 61).alias("in_both")).agg(F.count("*").alias("n"))


def wi1_top(spark, d):
    return _c(spark, d).select("id", F.length("text").alias("n")).orderBy(F.col("n").desc(), "id").limit(10)


def wi3_ranks(spark, d):
    """Ranks are given before the last cut, so they may have gaps."""
    r = R.keyword_search(chunk_view(spark, d), WORDS, 30)
    return r.filter("length(text) >= 300").select("id", "rank")


def wi6_merge(spark, d):
    return R.merge_sources(PR._per_source(spark, d).withColumn("rerank_score", R.overlap_score(F.col("text"), WORDS)), 20).select("id", "source", "rank")


def wi7_rerank(spark, d):
    r = R.keyword_search(chunk_view(spark, d), WORDS, 40)
    return R.rerank(r, "storms and the harbour", 5).select("id", "rerank_score", "rank")


def wi8_phrase(spark, d):
    return R.exact_phrase(_c(spark, d).withColumn("vector", F.lit(None)), "the harbour town", 20).select("id", "occurrences", "rank")


def wi12_quality(spark, d):
    """The better scored of a book's formats."""
    c = _c(spark, d).withColumn("book_id", F.concat_ws("|", "book_id", "format"))
    s = Q.chunk_scores(c).select(F.substring_index("book_id", "|", 1).alias("book"), F.substring_index("book_id", "|", -1).alias("format"), "score")
    return s.groupBy("book").agg(F.max_by("format", F.struct("score", "format")).alias("format"))


def se4_concatenated(spark, d):
    a = book_view(spark, d).select(F.col("source_id").alias("item"), F.lit("catalogue").alias("source"))
    b = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item"), F.lit("documents").alias("source"))
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"))


def se6_distinct(spark, d):
    b = book_view(spark, d).select(F.col("source_id").alias("book_id"), "publisher")
    return _c(spark, d).select("book_id", "language").join(b, "book_id").select("publisher", "language").distinct()


def re6_stop_sets(spark, d):
    rows = [(k, w) for k, ws in tx.STOP_WORDS.items() for w in ws]
    s = spark.createDataFrame(rows, "lang string, word string")
    t = _c(spark, d).select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("word"))
    return t.groupBy("word").agg(F.count("*").alias("chunks")).join(F.broadcast(s), "word").groupBy("lang").agg(F.sum("chunks").alias("hits"))


def re8_semantic(spark, d):
    c = chunk_view(spark, d)
    return R.search(c, _spec(c, mode="semantic", top_k=7, min_length=0)).select("id", "score", "rank")


def re11_cited(spark, d):
    c = chunk_view(spark, d)
    r = R.search(c, R.SearchSpec(text=WORDS, mode="keyword", top_k=10, max_per_book=3, min_length=0, interests=("harbour", "seal")))
    return r.select("id", "rank", "score", R.citation(*[F.col(x) for x in ("author", "book_title", "year", "page_label", "page_number")]).alias("citation"))


def sk7_migrate(spark, d):
    old = load(spark, d, "chunks").select("id", "text", "book_id")
    c = conform(old)
    return c.groupBy("chunk_type", "pending_external").agg(F.count("*").alias("n"))


def tx10_paragraphs(spark, d):
    x = load(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    wide = x.groupBy("doc_id").agg(F.max(F.length("line")).alias("width"))
    x = x.withColumn("before", F.lag("line").over(w)).join(wide, "doc_id")
    return x.filter("trim(line) <> ''").groupBy("doc_id").agg(F.sum(X.paragraph_starts(F.col("line"), F.col("before"), F.col("width")).cast("int")).alias("paragraphs"))


def tx15_pages(spark, d):
    c = _c(spark, d).filter("page_number > 0")
    top = c.groupBy("book_id").agg(F.max("page_number").alias("pages"))
    return c.join(top, "book_id").select("id", X.page_section(F.col("text"), F.col("page_label"), F.col("page_number") / F.col("pages")).alias("section"))


def tx16_epub_sections(spark, d):
    c = _c(spark, d).select("chapter", "section_title").distinct()
    return c.select("chapter", "section_title", F.when(F.col("section_title") != "", tx.section_type(F.col("section_title"), True)).otherwise(tx.section_type(F.col("chapter"), True)).alias("section"))


def tx20_comments(spark, d):
    b = book_view(spark, d).filter("comments_html is not null")
    return X.comment_sections(b, "source_id", "comments_html").groupBy("source_id").agg(F.count("*").alias("sections"))


def tx21_passages(spark, d):
    b = book_view(spark, d).filter("comments_html is not null")
    return b.select("source_id", F.size(X.key_passages(F.col("comments_html"))).cast("bigint").alias("passages"))


def tx25_language(spark, d):
    return _c(spark, d).select("id", X.language_by_words(F.col("text")).alias("lang"))


def tx27_second_hash(spark, d):
    b = book_view(spark, d)
    arr = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(C.arr(c)), tx.json_string), ", "), F.lit("]"))
    j = F.concat(F.lit('{"abstract": '), tx.json_string(F.col("comments_html")), F.lit(', "authors": '), arr("authors"), F.lit(', "date": '), tx.json_string(F.col("year").cast("string")), F.lit(', "tags": '), arr("tags"), F.lit(', "title": '), tx.json_string(F.col("title")), F.lit("}"))
    return b.select("source_id", F.md5(j).alias("hash"))


def tx41_toc_ranges(spark, d):
    c = _c(spark, d).filter("page_number > 0 and chunk_type in ('content', 'child')")
    return X.toc_ranges(PT._toc(spark, d), c)


def lk5_tagged(spark, d):
    b = book_view(spark, d)
    n = _c(spark, d).filter("chunk_type = 'annotation'").groupBy("book_id").agg(F.count("*").alias("annotations"))
    t = b.filter(F.array_contains(F.transform(C.arr("tags"), F.lower), "philology")).select("source_id", "title")
    return t.join(n, F.col("source_id") == F.col("book_id"), "left").select("source_id", F.concat_ws(",", "source_id", F.concat(F.lit('"'), F.replace("title", F.lit('"'), F.lit('""')), F.lit('"')), F.coalesce("annotations", F.lit(0)).cast("string"), F.lit("tagged")).alias("line"))


def lk9_optional(spark, d):
    b = book_view(spark, d)
    return C.by_author(b, "", (), None, "title").select("source_id").limit(25)


def lk12_tags(spark, d):
    return C.count_each(book_view(spark, d), "tags", "tag").orderBy(F.col("books").desc(), "tag").limit(5)


def lk14_first_seen(spark, d):
    """Against a cache of dates: without one the item is only seeded."""
    b = book_view(spark, d).select("source_id", F.coalesce("created_at", F.lit("")).alias("now"), "calibre_id")
    cache = b.filter("calibre_id % 4 <> 0").select("source_id", F.when(F.col("calibre_id") % 5 == 0, "other").otherwise(F.col("now")).alias("cached"))
    j = b.join(cache, "source_id", "left")
    return j.select("source_id", F.when(F.coalesce("cached", F.lit("")) == "", "seed").when(F.col("cached") != F.col("now"), "changed").otherwise("same").alias("state"))


def lk15_snapshot(spark, d):
    b = book_view(spark, d)
    return b.select("source_id", "title", C.authors_text().alias("authors"), F.array_join(F.sort_array(C.arr("tags")), ",").alias("tags"), F.coalesce("annotation_hash", F.lit("")).alias("annotation_hash"))


def lk19_reindex_comments(spark, d):
    c = _c(spark, d)
    new = book_view(spark, d).filter("trim(coalesce(comments_html, '')) <> ''").select(F.concat("source_id", F.lit("_comment_0")).alias("id"), F.col("source_id").alias("book_id"), F.lit("calibre_comment").alias("chunk_type"))
    return S.upsert(S.delete_where(c, F.col("chunk_type") == "calibre_comment").select("id", "book_id", "chunk_type"), new).groupBy("chunk_type").agg(F.count("*").alias("n"))


def ex1_combined(spark, d):
    """Annotations of one book with the counts of what is left out."""
    a = _c(spark, d).filter("chunk_type = 'annotation' and book_id = 'b000000001'")
    m = O.is_toc_marker(F.col("text"), F.when(F.col("annotation_type") == "note", F.lit("n")), F.lit(None).cast("double"), F.lit(None).cast("int"))
    return a.groupBy(m.alias("left_out")).agg(F.count("*").alias("n"))


def ex4_paths(spark, d):
    return _c(spark, d).select("source_file").distinct().select("source_file", F.sha2("source_file", 256).alias("hash"))


def ex6_primary(spark, d):
    f = _c(spark, d).filter("format <> ''").groupBy("book_id").agg(F.collect_set(F.lower("format")).alias("f"))
    return f.select("book_id", C.best_format(F.col("f"), ["epub", "pdf", "txt"]).alias("format"))


def ex8_lookup(spark, d):
    return _c(spark, d).filter("book_id = 'b000000003' and chunk_type in ('annotation', 'calibre_comment')").select("id", "chunk_type")


def ex9_tags(spark, d):
    b = book_view(spark, d)
    return b.filter(F.array_contains(C.arr("tags"), "law") & ~F.array_contains(C.arr("tags"), "history")).select("source_id")


def ex11_file_hash(spark, d):
    r = load(spark, d, "index_runs")
    return r.select("run_id", F.md5(F.concat_ws(":", (F.unix_micros(F.col("started_at").cast("timestamp")) * 1000).cast("string"), F.col("run_id").cast("string"))).alias("hash"))


def ex16_book_ids(spark, d):
    b = book_view(spark, d)
    first = F.coalesce(F.nullif(F.try_element_at(C.arr("authors"), F.lit(1)), F.lit("")), F.lit("Unknown"))
    return b.select("source_id", tx.slug(F.concat_ws("_", first, "title", F.col("calibre_id").cast("string")), 80).alias("book_key"))


def ex19_toc_map(spark, d):
    """File to chapter and its further entries, from a flat list of entries."""
    e = _c(spark, d).filter("section_title <> ''").groupBy("source_file", "section_title").agg(F.min("chunk_index").alias("i"))
    g = e.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("i", "section_title"))).alias("e"))
    return g.select("source_file", F.element_at("e", 1)["section_title"].alias("chapter"), (F.size("e") - 1).cast("bigint").alias("further"))


def ex28_import(spark, d):
    """Outside annotations: matched to documents and turned to rows, with what
    is left for review."""
    i = _items(spark, d)
    m = C.match(i, book_view(spark, d))
    notes = i.join(m.select("item", "book"), "item").select(F.col("book").alias("book_id"), F.lit("reader").alias("source"), "item", F.col("title").alias("highlight"), F.lit(None).cast("string").alias("note"), F.col("item").alias("position")).withColumn("code", F.col("book_id"))
    return S.annotation_rows(notes).select("id", "book_id")


def _items(spark, d):
    from lectern.plans import catalogue

    return catalogue._items(spark, d)


def ex29_instruction_all(spark, d):
    return _instruction(book_view(spark, d))


def _instruction(b):
    return b.select("source_id", F.concat(F.lit("Add the tag to "), "title", F.lit(" (now: "), F.array_join(C.arr("tags"), ", "), F.lit(")")).alias("instruction"))


def ex31_counters(spark, d):
    log = load(spark, d, "index_log").dropDuplicates(["log_id"]).select(F.concat(F.lit("run="), F.col("run_id").cast("string"), F.lit(" status="), "status").alias("line"))
    return log.groupBy(F.regexp_extract("line", r"run=(\d+)", 1).cast("int").alias("run"), F.regexp_extract("line", r"status=(\w+)", 1).alias("state")).agg(F.count("*").alias("n"))


def ex32_classes(spark, d):
    m = spark.createDataFrame([("cuda", 6), ("cuda", 12), ("cuda", 24), ("mps", 0), ("cpu", 0)], "device string, gb int")
    return m.select("device", "gb", F.when(F.col("device") == "cuda", F.when(F.col("gb") < 8, "minimal").when(F.col("gb") < 16, "balanced").otherwise("maximal")).when(F.col("device") == "mps", "balanced").otherwise("minimal").alias("profile"))


def ex37_sources(spark, d):
    r = PR._per_source(spark, d)
    return r.filter("source = 'b'").select("id", "rank")


_C = f"with {CHUNKS}"
_B = f"with {BOOKS}"
_CB = f"with {CHUNKS}, {BOOKS}"
_V = f"{_C}, {QUERY}, vs as (select ch.*, round({COSINE}, 6) score from ch, qv where {OK})"
_KW = f"{_C}, {bm25(TERMS)}"
_top = PR._top
_AUTH = "array_to_string(coalesce(authors, []), '{}')"
_OVER = lambda ws, c="text": f"round(len(list_filter({sorted(set(ws))!r}, lambda w: list_contains(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), w)))::double / {len(set(ws))}, 6)"
_STRIP = r'''trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))'''
from lectern.plans.catalogue import _AUTH, _MATCH, _json, match_sql  # noqa: E402

_LANGS = ", ".join(f"{{'s': len(list_filter(t, lambda x: list_contains({ws!r}, x)))::double / greatest(len(t), 1), 'k': '{k}'}}" for k, ws in sorted(tx.STOP_WORDS.items()))
ORACLE = {
    "fi2_section": f"{_C} select section_type, count(*) n from ch where section_type in ('main_content', '') group by 1",
    "fi3_types": f"{_C} select chunk_type, count(*) n from ch where chunk_type in ('content', 'child') group by 1",
    "fi5_language": f"{_C} select id from ch where language = 'fr'",
    "fi8_similarity": f"{_V} select id, score, rank from {_top('vs', 40)} where score >= 0.3",
    "fi9_threshold": f"{_KW}, t as (select kw.id, text, score from kw join ch using (id)), r as (select *, {_OVER(TERMS)} rerank_score from {_top('t', 30)}) select id, rerank_score from (select * from r order by rerank_score desc, rank limit 30) where rerank_score >= 0.5",
    "fi19_scores": "select query_id, id, round(coalesce(1 - case when not isnan(_distance) then _distance end, case when not isnan(_relevance_score) then _relevance_score end, case when not isnan(_score) then _score end, 0), 6) score from (select distinct * from search_hits)",
    "jo2_outer": f"{_B} select source_id, title, nullif(language, '') as language, publisher from bk",
    "jo4_scalar": f"{_CB}, n as (select book_id, arg_max(language, (n, language)) l from (select book_id, language, count(*) n from ch group by 1, 2) group by 1) select bk.source_id book_id, l main_language from bk left join n on n.book_id = bk.source_id",
    "jo5_semi": f"{_CB} select source_id from bk where source_id in (select book_id from ch where chunk_type = 'annotation')",
    "jo6_anti": f"{_CB} select source_id from bk where source_id not in (select book_id from ch where chunk_type = 'annotation')",
    "jo8_full": f"{_B}, {PU._CUR}, {PU._STO} select coalesce(so.item, cu.item) item, so.hash stored, cu.hash as \"current\" from so full join cu on so.item = cu.item",
    "jo11_nearest": f"{_V} select id, score from {_top('vs', 1)}",
    "jo12_fused": f"{_V}, {bm25(TERMS)}, a as (select id, rank vr from {_top('vs', 10)}), b as (select id, rank tr from {_top('kw', 10)}), f as (select id, round(coalesce(1.0::double / (60 + vr), 0) + coalesce(1.0::double / (60 + tr), 0), 9) score from a full join b using (id)) select score > 1.0::double / 61 in_both, count(*) n from {_top('f', 10)} group by 1",
    "wi1_top": f"{_C} select id, length(text)::integer n from ch order by n desc, id limit 10",
    "wi3_ranks": f"{_KW}, t as (select kw.id, text, score from kw join ch using (id)) select id, rank from {_top('t', 30)} where length(text) >= 300",
    "wi6_merge": f"{PR._FED}, r as (select fe.id, fe.source, rk, {_OVER(TERMS, 'ch.text')} rs from fe join ch on ch.id = fe.id) select id, source, row_number() over (order by rs desc, source, id) as rank from r order by rs desc, source, id limit 20",
    "wi7_rerank": f"{_KW}, t as (select kw.id, text, score from kw join ch using (id)), r as (select *, {_OVER(['storms', 'and', 'the', 'harbour'])} rerank_score from {_top('t', 40)}) select id, rerank_score, row_number() over (order by rerank_score desc, rank) as rank from r order by rerank_score desc, rank limit 15",
    "wi8_phrase": rf"{_C}, a as (select id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) t from ch), b as (select id, cast((length(t) - length(replace(t, 'the harbour town', ''))) / 16 as integer) occurrences from a) select id, occurrences, rank from {_top('(select * from b where occurrences > 0)', 20, 'occurrences desc, id')}",
    "se4_concatenated": f"{_B} select 'catalogue' as source, count(*) n from bk union all select 'documents', count(*) from documents",
    "se6_distinct": f"{_CB} select distinct bk.publisher, ch.language from ch join bk on bk.source_id = ch.book_id",
    "re6_stop_sets": rf"{_C}, s as (select * from (values {', '.join(f'({k!r}, {w!r})' for k, ws in tx.STOP_WORDS.items() for w in ws)}) v(lang, word)), t as (select distinct id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) word from ch) select lang, count(*) hits from t join s using (word) group by 1",
    "re8_semantic": f"{_V} select id, score, rank from {_top('vs', 7)}",
    "sk7_migrate": "select 'content' chunk_type, 0 pending_external, count(*) n from chunks",
    "tx16_epub_sections": f"{_C} select distinct chapter, section_title, case when section_title <> '' then (case when {PT._KW('section_title', PT._FRONT)} then 'front_matter' when {PT._KW('section_title', PT._BACK)} then 'back_matter' else 'main_content' end) else (case when {PT._KW('chapter', PT._FRONT)} then 'front_matter' when {PT._KW('chapter', PT._BACK)} then 'back_matter' else 'main_content' end) end section from ch",
    "tx21_passages": rf"{_B} select source_id, len(list_filter(regexp_extract_all(comments_html, '(?is)<(?:b|strong|h4)\b[^>]*>(.*?)</(?:b|strong|h4)>', 1), lambda x: {_STRIP.format('x')} <> '')) passages from bk where comments_html is not null",
    "tx25_language": rf"{_C}, a as (select id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') t from ch), b as (select id, text, list_sort([{_LANGS}], 'DESC')[1] m from a) select id, case when length(text) >= 50 and m.s > 0 then m.k end lang from b",
    "tx27_second_hash": f"""{_B} select source_id, md5('{{"abstract": ' || {_json('comments_html')} || ', "authors": [' || array_to_string(list_transform(list_sort(coalesce(authors, [])), lambda t: {_json('t')}), ', ') || '], "date": ' || {_json('cast(year as varchar)')} || ', "tags": [' || array_to_string(list_transform(list_sort(coalesce(tags, [])), lambda t: {_json('t')}), ', ') || '], "title": ' || {_json('title')} || '}}') hash from bk""",
    "tx41_toc_ranges": f"{PT._ASOF}, f as (select ch.book_id, m.entry, ch.chunk_index from mp m join ch on ch.id = m.id where m.entry is not null and ch.chunk_type in ('content', 'child')) select book_id, entry, min(chunk_index) first_chunk, max(chunk_index) last_chunk, count(*) chunks from f group by 1, 2",
    "lk5_tagged": f"{_CB} select bk.source_id, concat_ws(',', bk.source_id, '\"' || replace(title, '\"', '\"\"') || '\"', cast(coalesce(n, 0) as varchar), 'tagged') line from bk left join (select book_id, count(*) n from ch where chunk_type = 'annotation' group by 1) a on a.book_id = bk.source_id where list_contains(list_transform(coalesce(tags, []), lambda t: lower(t)), 'philology')",
    "lk9_optional": f"{_B} select source_id from bk where len(coalesce(authors, [])) > 0 order by lower(title), source_id limit 25",
    "lk12_tags": f"{_B} select tag, count(*) books from (select unnest(list_distinct(coalesce(tags, []))) tag from bk) group by 1 order by 2 desc, 1 limit 5",
    "lk14_first_seen": f"{_B} select source_id, case when calibre_id % 4 = 0 or (calibre_id % 5 <> 0 and coalesce(created_at, '') = '') then 'seed' when calibre_id % 5 = 0 then 'changed' else 'same' end state from bk",
    "lk15_snapshot": f"{_B} select source_id, title, {_AUTH.format('; ')} authors, array_to_string(list_sort(coalesce(tags, [])), ',') tags, coalesce(annotation_hash, '') annotation_hash from bk",
    "lk19_reindex_comments": f"{_CB}, n as (select source_id || '_comment_0' id from bk where trim(coalesce(comments_html, '')) <> '') select chunk_type, count(*) n from (select id, chunk_type from ch where chunk_type <> 'calibre_comment' and id not in (select id from n) union all select id, 'calibre_comment' from n) group by 1",
    "ex1_combined": f"{_C} select (length(text) < 20 and annotation_type <> 'note') or (length(text) < 50 and {PT._KW('text', '|'.join(tx.TOC_WORDS))}) left_out, count(*) n from ch where chunk_type = 'annotation' and book_id = 'b000000001' group by 1",
    "ex4_paths": f"{_C} select distinct source_file, sha256(source_file) hash from ch",
    "ex6_primary": f"{_C} select book_id, case when bool_or(lower(format) = 'epub') then 'epub' when bool_or(lower(format) = 'pdf') then 'pdf' when bool_or(lower(format) = 'txt') then 'txt' else min(lower(format)) end as format from ch where format <> '' group by 1",
    "ex8_lookup": f"{_C} select id, chunk_type from ch where book_id = 'b000000003' and chunk_type in ('annotation', 'calibre_comment')",
    "ex9_tags": f"{_B} select source_id from bk where list_contains(coalesce(tags, []), 'law') and not list_contains(coalesce(tags, []), 'history')",
    "ex11_file_hash": "select run_id, md5(cast(epoch_us(started_at) * 1000 as varchar) || ':' || run_id) hash from index_runs",
    "ex19_toc_map": f"{_C}, e as (select source_file, section_title, min(chunk_index) i from ch where section_title <> '' group by 1, 2) select source_file, arg_min(section_title, (i, section_title)) chapter, count(*) - 1 further from e group by 1",
    "ex29_instruction_all": f"{_B} select source_id, 'Add the tag to ' || title || ' (now: ' || array_to_string(coalesce(tags, []), ', ') || ')' instruction from bk",
    "ex31_counters": "select run_id run, status state, count(*) n from (select distinct on (log_id) * from index_log) group by 1, 2",
    "ex32_classes": "select * from (values ('cuda', 6, 'minimal'), ('cuda', 12, 'balanced'), ('cuda', 24, 'maximal'), ('mps', 0, 'balanced'), ('cpu', 0, 'minimal')) v(device, gb, profile)",
    "ex37_sources": f"{PR._FED} select id, rk as rank from fe where source = 'b'",
}
_FIRST = "coalesce(nullif(authors[1], ''), 'Unknown')"
_KEY = f"lower(concat_ws('_', {_FIRST}, title, calibre_id::varchar))"
for _a, _r in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
    _KEY = f"replace({_KEY}, '{_a}', '{_r}')"
ORACLE |= {
    "jo10_fuzzy": match_sql(f"select 'i' || source_id item, null::varchar code, title || 'x' title, {_AUTH} author from b", 60) + " select item, score, how from al",
    "ex16_book_ids": f"{_B} select source_id, regexp_replace(substr(regexp_replace(regexp_replace({_KEY}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '') book_key from bk",
    "ex28_import": f"{_MATCH}, n as (select book, item, title from al join i0 using (item) where trim(coalesce(title, '')) <> '') select 'reader_' || book || '_note_' || (row_number() over (partition by book order by item, title) - 1) id, book as book_id from n",
}
_ROWS_ONLY = ["wi12_quality", "re11_cited", "tx10_paragraphs", "tx15_pages", "tx20_comments"]
QUERIES = {k: f for k, f in list(globals().items()) if (k in ORACLE or k in _ROWS_ONLY) and callable(f)}
