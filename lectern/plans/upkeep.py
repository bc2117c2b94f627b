"""Queries over the state, quality and upkeep of the chunk table. The library
side is the catalogue, the stored side the current chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import quality as Q
from lectern.operators import sync as S
from lectern.plans.sql import BOOKS, CHUNKS
from lectern.tables import book_view, chunk_view, load


def _c(spark, d):
    return chunk_view(spark, d).drop("vector")


def _current(spark, d):
    """Hashes of the library: the title's for the metadata."""
    return book_view(spark, d).select(F.col("source_id").alias("item"), F.md5(F.coalesce("title", F.lit(""))).alias("hash"), F.coalesce("annotation_hash", F.lit("")).alias("annotation_hash"))


def _stored(spark, d):
    """Hashes as stored: of two documents in seven other ones, of one in ten none."""
    n = F.substring("item", 2, 9).cast("int")
    c = _current(spark, d).filter(n % 10 != 7)
    c = c.withColumn("hash", F.when(n % 7 == 0, "old").when(n % 7 == 1, "").otherwise(F.col("hash"))).withColumn("pending", (n % 11 == 0).cast("int"))
    gone = c.filter(n % 25 == 0).withColumn("item", F.concat(F.lit("x"), "item"))
    return c.unionByName(gone)


def ag6_stats(spark, d):
    return Q.index_stats(_c(spark, d))


def ag7_books(spark, d):
    return Q.books_indexed(_c(spark, d))


def ag8_state(spark, d):
    return Q.book_state(_c(spark, d)).select("book_id", "total", "content", "metadata_hash", "annotation_hash", "stub")


def ag9_hashes(spark, d):
    return Q.book_state(_c(spark, d)).select("book_id", "metadata_hash", (F.col("content") > 0).alias("has_content"))


def ag10_repeated(spark, d):
    return Q.repeated_ids(load(spark, d, "chunks"))


def ag11_labels(spark, d):
    return Q.missing_labels(_c(spark, d), 0.3)


def ag12_words_per_page(spark, d):
    return Q.words_per_page(_c(spark, d))


def ag13_scores(spark, d):
    return Q.chunk_scores(_c(spark, d))


def ag14_statistics(spark, d):
    return Q.chunk_statistics(_c(spark, d))


def ag17_annotations(spark, d):
    """Highlights and notes per document, zero where there are none."""
    a = _c(spark, d).filter("chunk_type = 'annotation'").groupBy("book_id").agg(F.sum((F.col("annotation_type") == "highlight").cast("int")).alias("highlights"), F.sum((F.col("annotation_type") == "note").cast("int")).alias("notes"))
    return book_view(spark, d).select(F.col("source_id").alias("book_id")).join(a, "book_id", "left").fillna(0)


def ag21_per_source(spark, d):
    return load(spark, d, "documents").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"))


def fi16_scanned(spark, d):
    return Q.scanned(Q.words_per_page(_c(spark, d)), book_view(spark, d))


def fi17_ocr(spark, d):
    c = _c(spark, d).filter(Q.is_content()).groupBy("book_id").agg(F.max("page_number").alias("pages"), F.sum(F.length("text")).alias("size"), F.countDistinct("page_number").alias("covered"))
    return c.select("book_id", Q.needs_ocr(F.col("pages"), F.col("size") / 6, F.col("covered") / F.greatest("pages", F.lit(1)), F.lit(True)).alias("needs_ocr"))


def fi18_todo(spark, d):
    have = _c(spark, d).filter(Q.is_content()).select(F.col("book_id").alias("source_id")).distinct()
    return book_view(spark, d).select("source_id").join(have, "source_id", "left_anti")


def sk1_upsert(spark, d):
    raw = load(spark, d, "chunks").select("id", "text", "indexed_at")
    old = raw.filter("indexed_at < '2025-03-01'")
    w = Window.partitionBy("id").orderBy(F.col("indexed_at").desc())
    old = old.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    u = S.upsert(old, raw.filter("indexed_at >= '2025-03-01'"), newest="indexed_at")
    return u.select("id", "indexed_at")


def sk2_defaults(spark, d):
    c = _c(spark, d)
    return c.agg(*[F.sum(F.col(x).isNull().cast("long")).alias(x) for x in ("text", "year", "tags", "char_start", "parent_id")], F.sum((F.col("char_start") == 0).cast("long")).alias("zero_starts"))


def sk3_delete(spark, d):
    c = _c(spark, d)
    left = S.delete_where(c, (F.col("book_id") == "b000000001") & (F.col("chunk_type") != "annotation"))
    return left.groupBy("book_id").agg(F.count("*").alias("n"))


def sk4_update(spark, d):
    c = _c(spark, d)
    u = S.update_where(c, F.col("book_id") == "b000000001", {"publisher": F.lit("Renamed"), "no_such_column": F.lit(1)})
    return u.groupBy("publisher").agg(F.count("*").alias("n"))


def sk5_pending(spark, d):
    return S.mark_pending(_c(spark, d), ["b000000001", "b000000003"]).filter("pending_external = 1").select("book_id").distinct()


def sk6_replace(spark, d):
    c = _c(spark, d)
    new = c.filter("book_id = 'b000000001' and chunk_index < 5 and chunk_type = 'content'").withColumn("text", F.lit("new"))
    return S.replace_book(c, new).filter("book_id = 'b000000001'").groupBy("chunk_type").agg(F.count("*").alias("n"))


def sk8_partitions(spark, d):
    return _c(spark, d).agg(F.count("*").alias("n")).select("n", S.index_partitions(F.col("n")).alias("lists"))


def sk13_rename_tag(spark, d):
    return S.rename_tag(_c(spark, d), "history", "past").groupBy("tags").agg(F.count("*").alias("n"))


def sk14_purge(spark, d):
    bad = book_view(spark, d).filter(F.array_contains("tags", "law")).select(F.col("source_id").alias("book_id"))
    return _c(spark, d).join(bad, "book_id", "left_anti").groupBy("language").agg(F.count("*").alias("n"))


def sk15_orphans(spark, d):
    lib = book_view(spark, d).filter("calibre_id % 20 <> 3").select(F.col("source_id").alias("book_id"))
    return S.orphans(_c(spark, d), lib)


def sk16_notes(spark, d):
    n = _c(spark, d).filter("chunk_type = 'annotation'").select("book_id", F.lit("reader").alias("source"), F.col("book_id").alias("code"), F.substring("text", 1, 40).alias("highlight"), F.when(F.col("chunk_index") % 2 == 0, "seen").alias("note"), F.col("id").alias("position"))
    return S.annotation_rows(n)


def sk19_backfill(spark, d):
    b = book_view(spark, d).select(F.col("source_id").alias("book_id"), F.md5(F.coalesce("title", F.lit(""))).alias("h"))
    c = _c(spark, d).join(b, "book_id", "left")
    return c.withColumn("metadata_hash", F.when((F.col("metadata_hash") == "") & F.col("h").isNotNull(), F.col("h")).otherwise(F.col("metadata_hash"))).groupBy((F.col("metadata_hash") == "").alias("blank")).agg(F.count("*").alias("n"))


def lk13_diff(spark, d):
    return S.snapshot_diff(_stored(spark, d), _current(spark, d))


def lk16_signatures(spark, d):
    b = book_view(spark, d)
    now = b.select(F.col("source_id").alias("item"), F.coalesce("year", F.lit(0)).alias("mtime"), F.length("title").alias("size"))
    cache = now.withColumn("hash", F.md5("item")).withColumn("mtime", F.when(F.col("size") % 5 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return S.unchanged_signature(now, cache).select("item", "hash")


def lk17_metadata_update(spark, d):
    """Fields of a book's chunks and new comment rows in place of the old."""
    c = _c(spark, d)
    u = S.update_where(c, F.col("book_id") == "b000000002", {"author": F.lit("New, A.")})
    u = S.delete_where(u, (F.col("book_id") == "b000000002") & (F.col("chunk_type") == "calibre_comment"))
    new = c.filter("book_id = 'b000000002'").limit(1).select(F.lit("b000000002_comment_0").alias("id"), F.lit("b000000002").alias("book_id"), F.lit("calibre_comment").alias("chunk_type"), F.lit("New, A.").alias("author"))
    return S.upsert(u.select("id", "book_id", "chunk_type", "author"), new).filter("book_id = 'b000000002'").select("id", "chunk_type", "author")


def lk20_pending_external(spark, d):
    """Pending books and whether the catalogue knows them."""
    p = _c(spark, d).filter("pending_external > 0").select("book_id").distinct()
    b = book_view(spark, d).select(F.col("source_id").alias("book_id"), F.lit(True).alias("known"))
    return p.join(b, "book_id", "left").select("book_id", F.coalesce("known", F.lit(False)).alias("known"))


def lk21_layers(spark, d):
    t = load(spark, d, "mix_targets").select("source", F.when(F.col("max_repeats") > 8, F.col("max_repeats")).alias("local"), F.when(F.col("target_share") > 0.05, 7).alias("own"), F.lit(None).cast("int").alias("all"))
    return t.select("source", S.layered([F.col("local"), F.col("own"), F.col("all"), F.lit(3)]).alias("value"))


def lk23_due(spark, d):
    r = load(spark, d, "index_runs")
    return r.select("run_id", (F.date_trunc("month", "started_at") < F.lit("2025-07-01 00:00:00").cast("timestamp")).alias("due"))


def ex12_source_hash(spark, d):
    c = _c(spark, d)
    return c.select("id", F.coalesce(F.nullif("annotation_hash", F.lit("")), F.nullif("metadata_hash", F.lit("")), F.lit("")).alias("hash"))


def ex13_merge(spark, d):
    b = book_view(spark, d).select("source_id", "publisher", "language")
    f = _c(spark, d).groupBy(F.col("book_id").alias("source_id")).agg(F.max("publisher").alias("publisher"), F.max("language").alias("language"))
    return S.merge_metadata(b, f, "source_id", ["publisher", "language"])


def ex14_decision(spark, d):
    state = Q.book_state(_c(spark, d)).select(F.col("book_id").alias("item"), "content", "stub", F.col("metadata_hash").alias("h0"))
    j = _current(spark, d).join(state, "item", "left")
    changed = F.coalesce(F.col("h0"), F.lit("")) != F.col("hash")
    return j.select("item", S.decision(F.coalesce("content", F.lit(0)) > 0, F.coalesce("stub", F.lit(0)) > 0, changed).alias("action"))


def ex17_counts(spark, d):
    return _c(spark, d).agg(F.count("*").alias("n"), F.max((F.col("chunk_type") == "parent").cast("int")).alias("has_parents"))


def ex18_labels(spark, d):
    c = _c(spark, d)
    printed = F.concat(F.lit("p"), F.col("page_number").cast("string"))
    weak = (F.col("page_label") == "") | (F.col("page_label") == F.col("page_number").cast("string"))
    return c.select("id", F.when(weak & (F.col("page_number") > 0), printed).otherwise(F.col("page_label")).alias("label"))


def ex30_queue(spark, d):
    a = _stored(spark, d).filter("pending = 1").select("item")
    b = S.snapshot_diff(_stored(spark, d), _current(spark, d)).filter("change = 'new'").select("item")
    return a.union(b).distinct()


def se1_difference(spark, d):
    return _current(spark, d).select("item").exceptAll(_stored(spark, d).select("item"))


def se2_union(spark, d):
    x = S.snapshot_diff(_stored(spark, d), _current(spark, d))
    return x.filter("change = 'metadata_changed'").select("item").union(x.filter("change = 'annotations_changed'").select("item")).distinct()


def se3_intersection(spark, d):
    b = book_view(spark, d)
    return b.select("source_id", F.array_join(F.sort_array(F.array_intersect(F.coalesce("tags", F.array()), F.array(F.lit("history"), F.lit("law"), F.lit("philology")))), ",").alias("shared"))


def se5_ordered_distinct(spark, d):
    c = _c(spark, d).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "section_type"))).alias("x"))
    return c.select("book_id", F.array_join(F.array_distinct(F.transform("x", lambda s: s["section_type"])), ">").alias("path"))


def wi13_latest(spark, d):
    e = load(spark, d, "index_log").dropDuplicates(["log_id"])
    return e.groupBy("source_id").agg(F.max_by("status", F.struct("processed_at", "log_id")).alias("last_status"), F.min_by("run_id", F.struct("processed_at", "log_id")).alias("first_run"))


def wi18_resume(spark, d):
    done = load(spark, d, "index_log").filter("status = 'completed' and run_id <= 12").select(F.col("source_id").alias("item"))
    return S.resume(_current(spark, d).select("item"), done, 50, F.col("item").desc())


_C = f"with {CHUNKS}"
_B = f"with {BOOKS}"
_CB = f"with {CHUNKS}, {BOOKS}"
_CUR = "cu as (select source_id item, md5(coalesce(title, '')) hash, coalesce(annotation_hash, '') annotation_hash from bk)"
_STO = """s0 as (select item, case when cast(substr(item, 2, 9) as integer) % 7 = 0 then 'old' when cast(substr(item, 2, 9) as integer) % 7 = 1 then '' else hash end hash, annotation_hash,
   cast(cast(substr(item, 2, 9) as integer) % 11 = 0 as integer) pending from cu where cast(substr(item, 2, 9) as integer) % 10 <> 7),
   so as (select * from s0 union all select 'x' || item, hash, annotation_hash, pending from s0 where cast(substr(item, 2, 9) as integer) % 25 = 0)"""
_DIF = """df as (select coalesce(so.item, cu.item) item, case when so.item is null then 'new' when cu.item is null then 'orphan' when so.hash <> '' and so.hash <> cu.hash then 'metadata_changed'
   when so.annotation_hash <> cu.annotation_hash then 'annotations_changed' when so.pending > 0 then 'fulltext_pending' else 'unchanged' end change from so full join cu on so.item = cu.item)"""
_D = f"{_B}, {_CUR}, {_STO}, {_DIF}"
_W = r"len(regexp_extract_all(text, '[^\s\p{Z}\x{85}]+'))"
_IN = "('content', 'child', 'parent', 'exchange')"
_STATE = f"""st as (select book_id, count(*) total, count(*) filter (where chunk_type in {_IN}) content, coalesce(max(metadata_hash) filter (where chunk_type in {_IN} and metadata_hash <> ''),
   max(metadata_hash) filter (where chunk_type = 'calibre_comment' and metadata_hash <> ''), '') metadata_hash, max(annotation_hash) annotation_hash, max(cast(chunk_type = 'phase1_metadata' as integer)) stub from ch group by 1)"""
_END = "('" + "', '".join([".", "!", "?", "…", '"', "”", "»", ")", ":", "。", "！", "？"]) + "')"
_PARA = r"trim(list_extract(string_split(rtrim(text), chr(10) || chr(10)), -1))"

ORACLE = {
    "ag6_stats": f"{_C} select 'total' metric, '' as value, count(*) n from ch union all select 'books', '', count(distinct book_id) from ch union all " + " union all ".join(f"select '{c}', {c}, count(*) from ch group by {c}" for c in ("chunk_type", "language", "section_type", "format")),
    "ag7_books": f"{_C} select book_id, arg_min(book_title, (chunk_index, id)) book_title, arg_min(author, (chunk_index, id)) author, arg_min(format, (chunk_index, id)) as format, count(*) chunks, max(indexed_at) last_indexed from ch group by 1",
    "ag8_state": f"{_C}, {_STATE} select * from st",
    "ag9_hashes": f"{_C}, {_STATE} select book_id, metadata_hash, content > 0 has_content from st",
    "ag10_repeated": "select book_id, count(*) ids, sum(n - 1)::bigint excess from (select id, count(*) n, min(book_id) book_id from chunks where id is not null group by 1 having count(*) > 1) group by 1",
    "ag11_labels": f"{_C} select * from (select book_id, round(avg(case when page_label = '' or page_label = cast(page_number as varchar) then 1.0 else 0.0 end), 6) share, min(indexed_at) since from ch where chunk_type in {_IN} group by 1) where share > 0.3",
    "ag12_words_per_page": f"{_C} select book_id, w::bigint words, p pages, round(w::double / p, 1) words_per_page from (select book_id, sum({_W}) w, max(page_number) p from ch where chunk_type in {_IN} group by 1) where p > 0",
    "ag13_scores": f"""{_C}, mx as (select book_id, max(chunk_index) m from ch where chunk_type <> 'parent' group by 1),
       x as (select ch.*, m, {_W} w, chunk_type in ('content', 'child') c, len(regexp_extract_all({_PARA}, '[^\\s\\p{{Z}}\\x{{85}}]+')) pw, substr(rtrim(text), -1) l from ch left join mx using (book_id)),
       g as (select book_id, count(*) filter (where c) n, count(*) filter (where c and l <> '' and l not in {_END} and pw > 20) cut, count(*) filter (where chunk_type <> 'parent' and section_type = 'back_matter' and chunk_index < m * 0.9) early,
         stddev_samp(w) filter (where c) sd, avg(w) filter (where c) mean, count(*) filter (where c and w < 50) short, count(*) filter (where c and (section_title <> '' or chapter <> '')) sec, max(case when c and (page_number > 0 or page_label <> '') then 1 else 0 end) pages from x group by 1),
       h as (select *, greatest(n, 1)::double d, case when n = 0 then 1.0 when mean > 0 then coalesce(sd, 0) / mean else 0.0 end cv from g)
       select book_id, round(greatest(0, least(100, 100 - 30 * cut / d - 25 * (case when n > 0 then early / d else 0 end) - 10 * least(cv, 1) - 15 * short / d + 10 * sec / d + 5 * pages)), 1) score, d::bigint content_chunks, round(cut / d, 3) truncation_rate, round(cv, 3) cv, round(short / d, 3) short_rate from h""",
    "ag14_statistics": f"{_C}, x as (select book_id, {_W} w from ch) select book_id, count(*) chunks, min(w) min_words, max(w) max_words, quantile_cont(w, 0.5) median_words, round(avg(w), 4) mean_words, round(coalesce(stddev_samp(w), 0), 4) sd_words from x group by 1",
    "ag17_annotations": f"{_CB} select source_id book_id, coalesce(h, 0) highlights, coalesce(n, 0) notes from bk left join (select book_id, count(*) filter (where annotation_type = 'highlight') h, count(*) filter (where annotation_type = 'note') n from ch where chunk_type = 'annotation' group by 1) a on a.book_id = source_id",
    "ag21_per_source": "select lower(trim(source)) as source, count(*) n from documents group by 1",
    "fi16_scanned": f"{_CB}, w as (select book_id, round(w::double / p, 1) words_per_page from (select book_id, sum({_W}) w, max(page_number) p from ch where chunk_type in {_IN} group by 1) where p > 0) select source_id, words_per_page from bk left join w on w.book_id = source_id where lower(file_format) = 'pdf' and (words_per_page is null or words_per_page < 100)",
    "fi17_ocr": f"{_C} select book_id, case when p > 0 and p < 6 then false else (s / 6.0::double) / greatest(p, 1) < 150 and c::double / greatest(p, 1) < 0.4 end needs_ocr from (select book_id, max(page_number) p, sum(length(text)) s, count(distinct page_number) c from ch where chunk_type in {_IN} group by 1)",
    "fi18_todo": f"{_CB} select source_id from bk where source_id not in (select book_id from ch where chunk_type in {_IN})",
    "sk1_upsert": "select id, max(indexed_at) indexed_at from chunks where id is not null group by 1",
    "sk2_defaults": f"{_C} select count(*) filter (where text is null) as text, count(*) filter (where year is null) as year, count(*) filter (where tags is null) tags, count(*) filter (where char_start is null) char_start, count(*) filter (where parent_id is null) parent_id, count(*) filter (where char_start = 0) zero_starts from ch",
    "sk3_delete": f"{_C} select book_id, count(*) n from ch where not (book_id = 'b000000001' and chunk_type <> 'annotation') group by 1",
    "sk4_update": f"{_C} select case when book_id = 'b000000001' then 'Renamed' else publisher end publisher, count(*) n from ch group by 1",
    "sk5_pending": f"{_C} select distinct book_id from ch where pending_external = 1 or book_id in ('b000000001', 'b000000003')",
    "sk6_replace": f"{_C} select chunk_type, count(*) n from ch where book_id = 'b000000001' and (chunk_type = 'annotation' or (chunk_index < 5 and chunk_type = 'content')) group by 1",
    "sk8_partitions": f"{_C} select count(*) n, case when count(*) >= 256 then least(256, greatest(16, floor(sqrt(count(*)))))::integer end lists from ch",
    "sk13_rename_tag": f"{_C} select case when contains(tags, 'history') then array_to_string(list_transform(string_split(tags, ','), lambda t: case when trim(t) = 'history' then 'past' else trim(t) end), ', ') else tags end tags, count(*) n from ch group by 1",
    "sk14_purge": f"{_CB} select language, count(*) n from ch where book_id not in (select source_id from bk where list_contains(tags, 'law')) group by 1",
    "sk15_orphans": f"{_CB} select distinct book_id from ch where book_id not in (select source_id from bk where calibre_id % 20 <> 3)",
    "sk16_notes": f"""{_C}, n as (select book_id, substr(text, 1, 40) h, case when chunk_index % 2 = 0 then 'seen' end note, id p from ch where chunk_type = 'annotation'), m as (select *, row_number() over (partition by book_id order by p, h) - 1 i from n where trim(h) <> '' or trim(coalesce(note, '')) <> '')
       select 'reader_' || book_id || '_note_' || i as id, book_id, h || case when coalesce(note, '') <> '' then ' | Note: ' || note else '' end as text, -1000 - i chunk_index from m""",
    "sk19_backfill": f"{_CB} select (case when metadata_hash = '' and bk.source_id is not null then md5(coalesce(title, '')) else metadata_hash end) = '' blank, count(*) n from ch left join bk on bk.source_id = book_id group by 1",
    "lk13_diff": f"{_D} select item, change from df",
    "lk16_signatures": f"{_B} select source_id item, case when length(title) % 5 <> 0 then md5(source_id) end hash from bk",
    "lk17_metadata_update": f"{_C} select id, chunk_type, 'New, A.' author from ch where book_id = 'b000000002' and chunk_type <> 'calibre_comment' and id <> 'b000000002_comment_0' union all select 'b000000002_comment_0', 'calibre_comment', 'New, A.' where exists (select 1 from ch where book_id = 'b000000002')",
    "lk20_pending_external": f"{_CB} select distinct book_id, bk.source_id is not null known from ch left join bk on bk.source_id = book_id where ch.pending_external > 0",
    "lk21_layers": "select source, coalesce(case when max_repeats > 8 then max_repeats end, case when target_share > 0.05 then 7 end, 3) as value from mix_targets",
    "lk23_due": "select run_id, date_trunc('month', started_at) < timestamp '2025-07-01' due from index_runs",
    "ex12_source_hash": f"{_C} select id, coalesce(nullif(annotation_hash, ''), nullif(metadata_hash, ''), '') hash from ch",
    "ex13_merge": f"{_CB}, f as (select book_id, max(publisher) p, max(language) l from ch group by 1) select source_id, case when coalesce(publisher, '') <> '' then 'catalogue' when f.p is not null then 'file' end origin, coalesce(nullif(publisher, ''), p) publisher, coalesce(nullif(language, ''), l) as language from bk left join f on f.book_id = source_id",
    "ex14_decision": f"{_CB}, {_CUR}, {_STATE} select item, case when coalesce(content, 0) > 0 and coalesce(metadata_hash, '') <> hash then 'metadata_only' when coalesce(content, 0) > 0 then 'skip' when coalesce(stub, 0) > 0 then 'delete_and_full' else 'full' end as action from cu left join st on st.book_id = item",
    "ex17_counts": f"{_C} select count(*) n, max(cast(chunk_type = 'parent' as integer)) has_parents from ch",
    "ex18_labels": f"{_C} select id, case when (page_label = '' or page_label = cast(page_number as varchar)) and page_number > 0 then 'p' || page_number else page_label end as label from ch",
    "ex30_queue": f"{_D} select item from so where pending = 1 union select item from df where change = 'new'",
    "se1_difference": f"{_B}, {_CUR}, {_STO} select item from cu except select item from so",
    "se2_union": f"{_D} select item from df where change in ('metadata_changed', 'annotations_changed')",
    "se3_intersection": f"{_B} select source_id, array_to_string(list_sort(list_distinct(list_filter(coalesce(tags, []), lambda t: t in ('history', 'law', 'philology')))), ',') shared from bk",
    "se5_ordered_distinct": f"{_C}, f as (select book_id, section_type, min((chunk_index, id)) k from ch group by 1, 2) select book_id, string_agg(section_type, '>' order by k) path from f group by 1",
    "wi13_latest": "with l as (select distinct on (log_id) * from index_log) select source_id, arg_max(status, (processed_at, log_id)) last_status, arg_min(run_id, (processed_at, log_id)) first_run from l group by 1",
    "wi18_resume": f"{_B}, {_CUR} select item from cu where item not in (select source_id from index_log where status = 'completed' and run_id <= 12 and source_id is not null) order by item desc limit 50",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in ORACLE and callable(f)}
