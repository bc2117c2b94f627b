"""Queries over the readers' operators, fed from the library's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.plans.sql import BOOKS, CHUNKS
from lectern.session import shared_dir
from lectern.sources import databases as D
from lectern.sources import documents as T
from lectern.sources import exports as X
from lectern.sources import folders as L
from lectern.sources import registry as R
from lectern.tables import book_view, chunk_view, load

FIELDS = ["title", "publisher", "year", "language"]


def _values(spark, d):
    """The catalogue as entity-attribute-value rows."""
    b = book_view(spark, d).select("source_id", *[F.col(f).cast("string").alias(f) for f in FIELDS])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])
    return b.select(F.col("source_id").alias("item"), F.explode(pairs).alias("p")).select("item", "p.field", "p.value").filter("value is not null")


def sc3_eav_scan(spark, d):
    """Items of a kind with a tag and without trash, by semi and anti joins."""
    b = book_view(spark, d)
    items = b.select(F.col("source_id").alias("item"), "file_format")
    tagged = b.filter(F.array_contains("tags", "philology")).select(F.col("source_id").alias("item"))
    trash = b.filter("calibre_id % 9 = 0").select(F.col("source_id").alias("item"))
    return D.not_deleted(items.filter("lower(file_format) = 'pdf'").join(tagged, "item", "left_semi"), trash).select("item")


def sc4_fields(spark, d):
    return D.fields(_values(spark, d), FIELDS)


def sc5_editors(spark, d):
    b = book_view(spark, d).select("source_id", "series", F.posexplode_outer("authors").alias("position", "name"))
    a = b.filter("name is not null").select(F.col("source_id").alias("item"), "position", "name", F.when(F.substring("source_id", -1, 1) == "3", "editor").otherwise("author").alias("kind"))
    return D.creators(a).select("item", F.array_join("creators", "; ").alias("creators"))


def sc6_descendants(spark, d):
    """The messages below one message, over parent links."""
    m = load(spark, d, "chat_messages").filter("platform = 'treetalk'").select(F.col("msg_id").cast("string").alias("id"), F.col("parent_msg_id").cast("string").alias("parent")).distinct()
    root = m.filter("parent is null").agg(F.min("id")).first()[0]
    return D.descendants(m, root or "")


def sc7_attachment(spark, d):
    c = chunk_view(spark, d).select("book_id", "source_file", "format").distinct()
    more = c.select(F.col("book_id").alias("item"), F.concat("source_file", F.lit(".txt")).alias("path"), F.lit("txt").alias("kind"), F.lit(False).alias("deleted"))
    f = c.select(F.col("book_id").alias("item"), F.col("source_file").alias("path"), F.lower("format").alias("kind"), (F.substring("book_id", -1, 1) == "7").alias("deleted"))
    return D.best_attachment(f.unionByName(more))


def sc11_prefix(spark, d):
    p = chunk_view(spark, d).select(F.col("source_file").alias("path")).distinct()
    roots = spark.createDataFrame([("/library/", "all"), ("/library/b00000000", "first"), ("/library/b0000003", "late")], "root string, source string")
    return R.best_prefix(p, roots)


def sc14_formats(spark, d):
    c = chunk_view(spark, d).select("source_file").distinct()
    head = F.when(F.col("source_file").endswith(".pdf"), F.lit("%PDF-1.7").cast("binary")).otherwise(F.lit("plain words").cast("binary"))
    return c.select("source_file", R.file_format(F.col("source_file"), head).alias("kind"))


def sc16_html(spark, d):
    b = book_view(spark, d).filter("comments_html is not null")
    return b.select("source_id", T.html_text(F.col("comments_html")).alias("h")).select("source_id", F.col("h.text").alias("text"), F.size("h.headings").alias("headings"))


def sc18_markdown(spark, d):
    b = book_view(spark, d).filter("comments_html is not null")
    return b.select("source_id", T.html_markdown(F.col("comments_html")).alias("markdown"))


def sc25_file(spark, d):
    """Every clipping document read as a file of records."""
    return X.clippings(load(spark, d, "documents").filter("doc_kind = 'clipping' and text is not null"))


def sc28_pdf_annotations(spark, d):
    a = chunk_view(spark, d).filter("chunk_type = 'annotation'").select("source_id", (F.col("chunk_index") % 12).alias("kind"), F.col("page_number").alias("page"), F.lit(400).alias("pages"), F.col("id").alias("text"))
    return X.pdf_annotations(a)


def sc29_manager(spark, d):
    c = chunk_view(spark, d)
    a = c.filter("chunk_type = 'annotation'").select("id", F.col("book_id").alias("attachment"), F.col("annotation_type").alias("kind"), F.substring("text", 1, 20).alias("text"), F.lit("").alias("comment"), F.concat(F.lpad(F.col("page_number").cast("string"), 5, "0"), F.lit("|x")).alias("sort_index"))
    att = book_view(spark, d).select(F.col("source_id").alias("id"), F.col("calibre_id").cast("string").alias("item"))
    return X.manager_annotations(a, att, a.filter("id like '%_5'").select(F.col("id").alias("item")))


def sc31_roles(spark, d):
    return load(spark, d, "chat_messages").select("msg_id", "speaker").distinct().groupBy(X.role(F.col("speaker")).alias("role")).agg(F.count("*").alias("n"))


def ex7_custom(spark, d):
    b = book_view(spark, d)
    t = {f: b.select(F.col("source_id").alias("book"), F.col(f).cast("string").alias("value")) for f in ("publisher", "year")}
    return D.custom_columns(t).select("book", F.map_entries("custom").alias("e")).select("book", F.array_join(F.transform("e", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("custom"))


def ex25_moments(spark, d):
    e = load(spark, d, "index_runs")
    raw = F.when(F.col("run_id") % 2 == 0, F.unix_seconds(F.col("started_at").cast("timestamp")).cast("string")).otherwise(F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("run_id", F.date_format(X.moment(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


def sc32_projection(spark, d):
    """Two columns of thirty: the scan reads no other."""
    return load(spark, d, "chunks").select("book_id", "chunk_type").groupBy("book_id", "chunk_type").agg(F.count("*").alias("n"))


def sk11_prepared(spark, d):
    """Chunks written with headers and read back, truncated documents apart."""
    at = f"{shared_dir(spark)}/prepared-{uuid.uuid4().hex}"
    X.write_prepared(chunk_view(spark, d).select("book_id", "id", "text"), at, buckets=64)
    ok, _ = X.read_prepared(spark, at)
    return ok.groupBy("book_id").agg(F.count("*").alias("n"))


def sk17_export(spark, d):
    from lectern.operators.retrieval import keyword_search

    r = keyword_search(chunk_view(spark, d), "winter storms register", 5)
    return X.export_markdown(r, "Results").select(F.md5("markdown").alias("hash"))


def sk18_notes(spark, d):
    """Conversations as vault notes: folder by month, slug of the first prompt."""
    from lectern.functions import text as tx

    m = load(spark, d, "chat_messages").filter("platform = 'pagechat' and sent_at is not null").filter(F.coalesce("content", F.lit("")).rlike(r"(?U)\S")).dropDuplicates(["msg_id"])
    g = m.groupBy("conv_id").agg(F.min_by("content", F.struct("sent_at", "msg_id")).alias("t"), F.min("sent_at").alias("at"))
    return g.select("conv_id", F.concat_ws("/", F.date_format("at", "yyyy-MM"), tx.slug(F.col("t"), 40)).alias("path"))


def tx32_key_values(spark, d):
    b = book_view(spark, d)
    t = F.concat(F.lit("---\nTitle: "), F.coalesce("title", F.lit("x")), F.lit("\nLast Read: "), F.coalesce(F.col("year").cast("string"), F.lit("never")), F.lit("\n---\nbody"))
    fm = L.front_matter(t)
    return b.select("source_id", F.try_element_at(fm, F.lit("last_read")).alias("last_read"), L.body(t).alias("body"))


_B = f"with {BOOKS}"
_C = f"with {CHUNKS}"
_CB = f"with {CHUNKS}, {BOOKS}"
ORACLE = {
    "sc3_eav_scan": f"{_B} select source_id item from bk where lower(file_format) = 'pdf' and list_contains(tags, 'philology') and calibre_id % 9 <> 0",
    "sc4_fields": f"{_B} select source_id item, title, publisher, cast(year as varchar) as year, language from bk where title is not null or publisher is not null or year is not null or language is not null",
    "sc5_editors": f"{_B} select source_id item, array_to_string(authors, '; ') creators from bk where len(authors) > 0",
    "sc6_descendants": "with recursive m as (select distinct cast(msg_id as varchar) id, cast(parent_msg_id as varchar) parent from chat_messages where platform = 'treetalk'), d as (select min(id) id from m where parent is null union select m.id from m join d on m.parent = d.id) select id from d",
    "sc7_attachment": f"{_C}, c as (select distinct book_id, source_file, format from ch), f as (select book_id item, source_file path, lower(format) kind from c where right(book_id, 1) <> '7' union all select book_id, source_file || '.txt', 'txt' from c), r as (select *, case kind when 'pdf' then 10 when 'epub' then 8 when 'html' then 3 when 'txt' then 2 else 0 end k from f) select item, path, kind from (select *, row_number() over (partition by item order by k desc, path) n from r where k > 0) where n = 1",
    "sc11_prefix": f"{_C} select distinct source_file path, case when starts_with(source_file, '/library/b00000000') then 'first' when starts_with(source_file, '/library/b0000003') then 'late' when starts_with(source_file, '/library/') then 'all' end source from ch",
    "sc14_formats": rf"{_C} select distinct source_file, case when source_file like '%.pdf' then 'pdf' else coalesce(nullif(lower(regexp_extract(source_file, '\.([A-Za-z0-9]+)$', 1)), ''), 'unknown') end kind from ch",
    "sc28_pdf_annotations": f"{_C} select source_id, case when chunk_index % 12 in (8, 9, 10, 11) then 'highlight' else 'note' end as type, round(page_number / 400.0::double, 6) pos_frac, id as text from ch where chunk_type = 'annotation' and chunk_index % 12 in (0, 2, 8, 9, 10, 11)",
    "sc29_manager": f"{_CB} select cast(bk.calibre_id as varchar) item, annotation_type as type, substr(text, 1, 20) as text, '' as comment, page_number + 1 page from ch join bk on bk.source_id = book_id where chunk_type = 'annotation' and id not like '%_5'",
    "sc31_roles": "select case when lower(trim(speaker)) in ('user', 'human', 'you') then 'user' when lower(trim(speaker)) in ('assistant', 'ai', 'model', 'bot', 'gpt', 'claude', 'grok') then 'assistant' when lower(trim(speaker)) in ('system', 'tool') then 'system' else 'user' end as role, count(*) n from (select distinct msg_id, speaker from chat_messages) group by 1",
    "ex7_custom": f"{_B} select source_id book, concat_ws(';', 'publisher=' || nullif(publisher, ''), 'year=' || year) custom from bk where coalesce(publisher, '') <> '' or year is not null",
    "ex25_moments": "select run_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') as at from index_runs".replace(" as at", ' as "at"'),
    "sc32_projection": "select book_id, chunk_type, count(*) n from chunks group by 1, 2",
    "sk11_prepared": f"{_C} select book_id, count(*) n from ch group by 1",
    "sk18_notes": r"""with m as (select distinct on (msg_id) * from chat_messages where platform = 'pagechat' and sent_at is not null and regexp_matches(coalesce(content, ''), '[^\s\p{Z}]')), g as (select conv_id, arg_min(content, (sent_at, msg_id)) t, min(sent_at) a from m group by 1)
      select conv_id, strftime(a, '%Y-%m') || '/' || regexp_replace(substr(regexp_replace(regexp_replace(replace(replace(replace(replace(lower(t), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') path from g""",
    "tx32_key_values": f"{_B} select source_id, coalesce(cast(year as varchar), 'never') last_read, 'body' as body from bk",
}
_ROWS_ONLY = ["sc16_html", "sc18_markdown", "sc25_file", "sk17_export"]
QUERIES = {k: f for k, f in list(globals().items()) if (k in ORACLE or k in _ROWS_ONLY) and callable(f)}
