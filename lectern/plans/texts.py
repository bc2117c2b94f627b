"""Queries over texts, sections, chunking and order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import chunking as K
from lectern.operators import ordered as O
from lectern.plans.sql import BOOKS, CHUNKS
from lectern.tables import book_view, chunk_view, load


def _c(spark, d):
    return chunk_view(spark, d).drop("vector")


def _docs(spark, d):
    return load(spark, d, "documents").filter("text is not null")


def _all_turns(spark, d):
    """The turns of every platform."""
    return O.turns(load(spark, d, "chat_messages"), load(spark, d, "speaker_alias"))


def tx1_fixed(spark, d):
    return K.fixed(_c(spark, d).filter("length(text) > 0"), "id", "text", 500, 50).select("id", "chunk_index", "start", F.md5("chunk").alias("hash"))


def tx2_paragraphs(spark, d):
    return K.chunk(_docs(spark, d), "doc_id", "text", "paragraph")


def tx3_markdown(spark, d):
    t = book_view(spark, d).filter("comments_html is not null")
    return K.chunk(t, "source_id", "comments_html", "markdown")


def _exchanges(turns):
    return K.exchanges(turns).groupBy("conv_id", "exchange").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"))


def tx4_exchanges_all(spark, d):
    return _exchanges(_all_turns(spark, d))


def tx4_dialogue(spark, d):
    t = _all_turns(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "msg_id", "speaker", "content"))), lambda x: F.concat(F.lit("**"), F.when(x["speaker"] == "human", "User").otherwise("Assistant"), F.lit(":** "), F.coalesce(x["content"], F.lit("")))), "\n\n").alias("text"))
    return K.chunk(t, "conv_id", "text", "dialogue")


def tx6_words(spark, d):
    return K.chunk(_docs(spark, d), "doc_id", "text", "words")


def tx8_runs(spark, d):
    return K.section_runs(_c(spark, d)).groupBy("book_id").agg(F.max("run").alias("runs"))


def tx8_parents(spark, d):
    p = K.parents(_c(spark, d).filter("chunk_type in ('content', 'child')"), 400)
    return p.groupBy("book_id", "run").agg((F.max("parent") + 1).alias("parents"), F.count("*").alias("children"))


def tx9_window(spark, d):
    full = _docs(spark, d)
    lo = F.least(F.lit(700), F.length("text"))
    return full.select("doc_id", F.md5(tx.window_text(F.col("text"), lo, F.least(lo + 300, F.length("text")))).alias("hash"))


def tx11_page_numbers(spark, d):
    c = _c(spark, d)
    lines = F.split("text", "\n")
    n = F.size(lines)
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~((F.trim(s["x"]) == F.col("page_label")) & (F.col("page_label") != "") & ((s["i"] < 3) | (s["i"] >= n - 2))))
    return c.select("id", F.md5(F.array_join(F.transform(kept, lambda s: s["x"]), "\n")).alias("hash"))


def tx12_labels(spark, d):
    c = _c(spark, d)
    return c.select("id", F.regexp_extract("text", r"^(\d{1,4})\s", 1).alias("leading"), F.regexp_extract("text", r"\s(\d{1,4})\.?$", 1).alias("trailing"))


def tx13_roman(spark, d):
    return _c(spark, d).select("page_label").distinct().select("page_label", tx.roman(F.col("page_label")).cast("bigint").alias("value"))


def tx14_sections(spark, d):
    return _c(spark, d).select(F.col("section_title").alias("title")).distinct().select("title", tx.section_type(F.col("title")).alias("by_toc"), tx.section_type(F.col("title"), True).alias("by_file"))


def tx18_numbers(spark, d):
    return _c(spark, d).select(F.concat_ws(" ", "chapter", "section_title").alias("title")).distinct().select("title", tx.section_number(F.col("title")).alias("number"))


def tx19_headings(spark, d):
    """Paragraphs that are a heading (short, no stop) start a section."""
    p = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "p"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    h = (F.length(F.trim("p")) < 60) & ~F.trim("p").rlike(r"[.!?…。！？।:]\s*\z")
    return p.withColumn("h", h.cast("int")).withColumn("section", F.sum("h").over(w)).groupBy("doc_id", "section").agg(F.count("*").alias("paragraphs"))


def tx22_annotations(spark, d):
    a = _c(spark, d).filter("chunk_type = 'annotation'")
    note = F.when(F.col("annotation_type") == "note", F.col("text"))
    body = F.when(note.isNull(), F.concat(F.lit("[ANNOTATION] "), "text")).otherwise(F.concat(F.lit("[ANNOTATION_NOTE] "), note))
    return a.select("id", F.md5(body).alias("hash"))


def tx23_stub(spark, d):
    b = book_view(spark, d)
    line = lambda n, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}: "), c))
    return b.select("source_id", F.concat_ws("\n", line("Title", F.col("title")), line("Authors", F.array_join(F.coalesce("authors", F.array()), ", ")), line("Publisher", F.col("publisher")), line("Year", F.col("year").cast("string"))).alias("stub"))


def tx24_spread(spark, d):
    """Book fields on every chunk."""
    b = book_view(spark, d).select(F.col("source_id").alias("book_id"), "series", "file_format")
    return _c(spark, d).select("id", "book_id").join(b, "book_id", "left")


def tx28_annotation_hash(spark, d):
    return _c(spark, d).filter("chunk_type = 'annotation'").groupBy("book_id").agg(tx.annotation_hash(F.col("text"), F.lit(""), F.col("annotation_type")).alias("hash"))


def tx29_ids(spark, d):
    return _c(spark, d).select("source_file").distinct().select("source_file", tx.stable_id(F.col("source_file")).alias("doc_id"))


def tx30_names(spark, d):
    f = _c(spark, d).select("source_file").distinct()
    return f.select("source_file", F.regexp_extract("source_file", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.regexp_extract("source_file", r"\.([^./]+)$", 1).alias("ext"), F.regexp_extract("source_file", r"(\d+)\.[^./]+$", 1).try_cast("bigint").alias("number"))


def tx31_links(spark, d):
    b = book_view(spark, d)
    return b.select("source_id", F.array_join(tx.wikilinks(F.coalesce("comments_html", F.lit(""))), ";").alias("links"))


def tx37_dates(spark, d):
    """The date of a clipping's head, in either language's form."""
    m = F.regexp_extract("text", r"Added on (\w+) (\d{1,2}), (\d{4})", 0)
    day = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract("text", r"Added on (\w+) (\d{1,2}), (\d{4})", 1), F.regexp_extract("text", r"Added on (\w+) (\d{1,2}), (\d{4})", 2), F.regexp_extract("text", r"Added on (\w+) (\d{1,2}), (\d{4})", 3)), F.lit("MMMM d yyyy"))
    return _docs(spark, d).filter("doc_kind = 'clipping'").select("doc_id", F.when(m != "", F.date_format(day, "yyyy-MM-dd")).alias("added"))


def tx38_tokens(spark, d):
    c = _c(spark, d)
    return c.select("id", F.floor(F.length("text") / 4).cast("bigint").alias("by_length"), F.floor(tx.word_count(F.col("text")) * 1.3).cast("bigint").alias("by_words"))


def tx39_truncated(spark, d):
    return _c(spark, d).groupBy(tx.truncated(F.col("text")).alias("cut")).agg(F.count("*").alias("n"))


def tx40_edges(spark, d):
    c = _c(spark, d)
    return c.select("id", F.md5(F.substring("text", 1, 80)).alias("head"), F.md5(F.expr("right(text, 80)")).alias("tail"))


def _toc(spark, d):
    """A table of contents: the first page of each chapter of a book."""
    c = _c(spark, d).filter("chapter <> '' and page_number > 0")
    return c.groupBy("book_id", "chapter").agg(F.min("page_number").alias("page_number")).groupBy("book_id", "page_number").agg(F.min("chapter").alias("entry"))


def jo15_range_map(spark, d):
    p = _c(spark, d).filter("page_number > 0").select("book_id", "page_number", "id")
    return O.range_map(p, _toc(spark, d), "book_id", "page_number", "entry").select("id", "page_number", "entry")


def tx41_conflicts(spark, d):
    p = _c(spark, d).filter("page_number > 0 and chapter <> ''").select("book_id", "page_number", "id", "chapter")
    m = O.range_map(p, _toc(spark, d), "book_id", "page_number", "entry")
    return m.groupBy((F.col("entry") == F.col("chapter")).alias("agrees")).agg(F.count("*").alias("n"))


def wi14_sessions(spark, d):
    e = load(spark, d, "events")
    return O.gap_sessions(e, "user_id", "ts", "event_id", 1800).groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first_at"))


def wi15_labels(spark, d):
    p = _c(spark, d).filter("page_number > 0").groupBy("book_id", "page_number").agg(F.max("page_label").alias("page_label"))
    return O.repaired_labels(p, "book_id", "page_number", "page_label").select("book_id", "page_number", "repaired")


def wi16_running_lines(spark, d):
    c = _c(spark, d).filter("page_number > 0").select("book_id", "page_number", "text", "id")
    return O.running_lines(c, "book_id", "id", "text", 3, 2).select("book_id", "place", F.md5("line").alias("line"), "pages")


def wi17_fill(spark, d):
    c = O.fill_forward(_c(spark, d).select("book_id", "chunk_index", "id", "section_title"), "book_id", ["chunk_index", "id"], "section_title")
    return c.select("id", "section_title")


def fi10_markers(spark, d):
    a = _c(spark, d).filter("chunk_type = 'annotation'")
    return a.select("id", O.is_toc_marker(F.col("text"), F.when(F.col("annotation_type") == "note", F.lit("n")), F.lit(None).cast("double"), F.lit(None).cast("int")).alias("marker"))


def fi11_annotation_text(spark, d):
    a = _c(spark, d).filter("chunk_type = 'annotation'")
    return a.filter(F.lower(F.concat_ws(" ", "text", "annotation_type")).contains("harbour")).select("id")


def fi20_selection(spark, d):
    s = spark.range(1).select(F.lit("0,3,5-10,7").alias("s"))
    p = s.select(F.explode(F.split("s", ",")).alias("p"))
    lo, hi = F.split("p", "-")[0].cast("int"), F.element_at(F.split("p", "-"), -1).cast("int")
    return p.select(F.explode(F.sequence(lo, hi)).alias("i")).filter("i < 9").distinct()


def sc15_text(spark, d):
    t = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n?", "\n")
    t = F.regexp_replace(t, r"(?s)\A---\n.*?\n---\n", "")
    return _docs(spark, d).select("doc_id", F.md5(t).alias("hash"))


def sc21_scanned_pages(spark, d):
    c = _c(spark, d).filter("page_number > 0")
    return c.groupBy("book_id").agg(F.round(F.avg((F.length("text") >= 100).cast("double")), 6).alias("share")).withColumn("scanned", F.col("share") < 0.3)


def sc25_clippings(spark, d):
    h = _docs(spark, d).filter("doc_kind = 'clipping'")
    return h.select("doc_id", F.regexp_extract("text", r"^(.*?) \(([^()\r\n]+)\)\r?\n", 1).alias("title"), F.regexp_extract("text", r"^(.*?) \(([^()\r\n]+)\)\r?\n", 2).alias("author"), F.regexp_extract("text", r"Location (\d+)-(\d+)", 1).try_cast("int").alias("lo"), F.regexp_extract("text", r"Location (\d+)-(\d+)", 2).try_cast("int").alias("hi"))


def sc27_sidecars(spark, d):
    return _c(spark, d).select("source_file").distinct().select("source_file", F.concat(F.sha2("source_file", 256), F.lit(".json")).alias("sidecar"))


def _flat(turns):
    """Messages of a flat export: a JSON list per conversation, parsed again."""
    j = turns.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "speaker", "content")))).alias("j"))
    m = j.select("conv_id", F.explode(F.from_json("j", "array<struct<turn:int,speaker:string,content:string>>")).alias("m"))
    return m.select("conv_id", "m.turn", "m.speaker", F.md5(F.coalesce("m.content", F.lit(""))).alias("hash"))


def sc31_flat_all(spark, d):
    return _flat(_all_turns(spark, d))


def ex3_annotated(spark, d):
    return _c(spark, d).filter("chunk_type = 'annotation'").groupBy("book_id").agg(F.count("*").alias("n"), F.max("indexed_at").alias("latest"))


def ex2_by_type(spark, d):
    return _c(spark, d).filter("chunk_type = 'annotation' and book_id = 'b000000001'").groupBy("annotation_type").agg(F.count("*").alias("n"))


def ex20_clean_lines(spark, d):
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    t = F.array_join(F.filter(F.transform(F.split("text", "\r?\n"), bare), lambda x: x != ""), "\n\n")
    return _docs(spark, d).select("doc_id", F.md5(t).alias("hash"))


def _markdown(turns):
    line = F.transform(F.array_sort(F.collect_list(F.struct("turn", "msg_id", "speaker", "content"))), lambda x: F.concat(F.lit("**"), x["speaker"], F.lit(":** "), F.coalesce(x["content"], F.lit(""))))
    return turns.groupBy("conv_id").agg(F.md5(F.array_join(line, "\n\n")).alias("hash"), F.count("*").alias("turns"))


def ex24_markdown_all(spark, d):
    return _markdown(_all_turns(spark, d))


def ex33_codes(spark, d):
    m = F.create_map(*[F.lit(x) for p in (("en", "eng"), ("de", "deu"), ("fr", "fra"), ("es", "spa"), ("it", "ita")) for x in p])
    return _c(spark, d).select("language").distinct().select("language", F.coalesce(F.try_element_at(m, F.col("language")), F.lit("und")).alias("code"))


_C = f"with {CHUNKS}"
_CB = f"with {CHUNKS}, {BOOKS}"
_D = "with dc as (select * from documents where text is not null)"
_SP = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}\x{85}]"
_BACK = "|".join(tx.BACK)
_FRONT = "|".join(tx.FRONT)
_KW = lambda c, k: rf"regexp_matches(lower({c}), '(^|[^\p{{L}}\p{{N}}_])({k})($|[^\p{{L}}\p{{N}}_])')"
_END = "('" + "', '".join([".", "!", "?", "…", '"', "”", "»", ")", ":", "。", "！", "？"]) + "')"
_TOC = "tc as (select book_id, page_number, min(chapter) entry from (select book_id, chapter, min(page_number) page_number from ch where chapter <> '' and page_number > 0 group by 1, 2) group by 1, 2)"
_ASOF = f"{_C}, {_TOC}, mp as (select c.id, c.page_number, c.chapter, (select arg_max(entry, t.page_number) from tc t where t.book_id = c.book_id and t.page_number <= c.page_number) entry from ch c where page_number > 0)"

ORACLE = {
    "tx1_fixed": f"{_C}, k as (select id, text, unnest(generate_series(0, greatest(cast(ceil((length(text) - 50) / 450.0) as bigint) - 1, 0))) i from ch where length(text) > 0) select id, i::integer chunk_index, (i * 450)::integer as start, md5(substr(text, i * 450 + 1, 500)) hash from k",
    "tx8_runs": f"{_C}, a as (select book_id, chunk_index, id, case when coalesce(lag(section_type) over w, chr(1)) = section_type and coalesce(lag(chapter) over w, chr(1)) = chapter and coalesce(lag(section_title) over w, chr(1)) = section_title then 0 else 1 end n from ch window w as (partition by book_id order by chunk_index, id)) select book_id, sum(n)::bigint runs from a group by 1",
    "tx9_window": f"{_D}, a as (select doc_id, text, least(700, length(text)) lo, least(least(700, length(text)) + 300, length(text)) hi from dc) select doc_id, md5(substr(text, greatest(lo - 500, 0) + 1, hi + 500 - greatest(lo - 500, 0))) hash from a",
    "tx11_page_numbers": f"{_C}, a as (select id, page_label, string_split(text, chr(10)) l from ch) select id, md5(array_to_string(list_filter(l, lambda x, i: not (trim(x) = page_label and page_label <> '' and (i <= 3 or i > len(l) - 2))), chr(10))) hash from a",
    "tx12_labels": _C + r""" select id, regexp_extract(text, '^(\d{1,4})\s', 1) "leading", regexp_extract(text, '\s(\d{1,4})\.?$', 1) "trailing" from ch""",
    "tx14_sections": f"{_C} select distinct section_title title, case when {_KW('section_title', _BACK)} then 'back_matter' when {_KW('section_title', _FRONT)} then 'front_matter' else 'main_content' end by_toc, case when {_KW('section_title', _FRONT)} then 'front_matter' when {_KW('section_title', _BACK)} then 'back_matter' else 'main_content' end by_file from ch",
    "tx18_numbers": rf"{_C} select title, coalesce(nullif(regexp_extract(title, '^(\d+(?:\.\d+)*)[.\s]', 1), ''), nullif(regexp_extract(title, '(?i)^(?:chapter|section|kapitel|abschnitt)\s+(\d+)', 1), '')) number from (select distinct concat_ws(' ', chapter, section_title) title from ch)",
    "tx19_headings": rf"{_D}, p as (select doc_id, generate_subscripts(s, 1) pos, unnest(s) p from (select doc_id, regexp_split_to_array(text, '\n\s*\n') s from dc)), h as (select *, case when length(trim(p)) < 60 and not regexp_matches(trim(p), '[.!?…。！？।:]\s*\z') then 1 else 0 end h from p), s as (select *, sum(h) over (partition by doc_id order by pos) section from h) select doc_id, section::bigint section, count(*) paragraphs from s group by 1, 2",
    "tx22_annotations": f"{_C} select id, md5(case when annotation_type = 'note' then '[ANNOTATION_NOTE] ' || text else '[ANNOTATION] ' || text end) hash from ch where chunk_type = 'annotation'",
    "tx23_stub": f"{_CB} select source_id, concat_ws(chr(10), case when coalesce(title, '') <> '' then 'Title: ' || title end, case when len(coalesce(authors, [])) > 0 then 'Authors: ' || array_to_string(authors, ', ') end, case when coalesce(publisher, '') <> '' then 'Publisher: ' || publisher end, 'Year: ' || year) stub from bk",
    "tx24_spread": f"{_CB} select id, book_id, series, file_format from ch left join bk on bk.source_id = book_id",
    "tx28_annotation_hash": f"{_C} select book_id, md5(string_agg(text || '||' || annotation_type, chr(10) order by text || '||' || annotation_type)) hash from ch where chunk_type = 'annotation' group by 1",
    "tx29_ids": f"{_C} select distinct source_file, 'folder:' || substr(sha256(source_file), 1, 12) doc_id from ch",
    "tx30_names": rf"{_C} select distinct source_file, regexp_extract(source_file, '([^/]+)\.[^./]+$', 1) stem, regexp_extract(source_file, '\.([^./]+)$', 1) ext, try_cast(nullif(regexp_extract(source_file, '(\d+)\.[^./]+$', 1), '') as bigint) number from ch",
    "tx31_links": rf"with {BOOKS}, e as (select source_id, unnest(regexp_extract_all(coalesce(comments_html, ''), '\[\[([^\]\|#]+)', 1)) l, generate_subscripts(regexp_extract_all(coalesce(comments_html, ''), '\[\[([^\]\|#]+)', 1), 1) i from bk), f as (select source_id, trim(l) l, min(i) i from e group by 1, 2) select bk.source_id, coalesce(string_agg(l, ';' order by i), '') links from bk left join f using (source_id) group by 1",
    "tx37_dates": rf"{_D} select doc_id, strftime(try_strptime(nullif(concat_ws(' ', regexp_extract(text, 'Added on (\w+) (\d{{1,2}}), (\d{{4}})', 1), regexp_extract(text, 'Added on (\w+) (\d{{1,2}}), (\d{{4}})', 2), regexp_extract(text, 'Added on (\w+) (\d{{1,2}}), (\d{{4}})', 3)), '  '), '%B %-d %Y'), '%Y-%m-%d') added from dc where doc_kind = 'clipping'",
    "tx38_tokens": rf"{_C} select id, length(text) // 4 by_length, floor(len(regexp_extract_all(text, '[^\s\p{{Z}}\x{{85}}]+')) * 1.3::double)::bigint by_words from ch",
    "tx39_truncated": f"{_C} select (substr(rtrim(text), -1) <> '' and substr(rtrim(text), -1) not in {_END}) cut, count(*) n from ch group by 1",
    "tx40_edges": f"{_C} select id, md5(substr(text, 1, 80)) head, md5(right(text, 80)) tail from ch",
    "jo15_range_map": f"{_ASOF} select id, page_number, entry from mp",
    "tx41_conflicts": f"{_ASOF} select entry = chapter agrees, count(*) n from mp where chapter <> '' group by 1",
    "wi14_sessions": "with a as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 30 minute then 1 else 0 end n from events), b as (select *, sum(n) over (partition by user_id order by ts, event_id)::bigint session from a) select user_id, session, count(*) events, min(ts) first_at from b group by 1, 2",
    "wi17_fill": f"{_C} select id, last_value(nullif(section_title, '') ignore nulls) over (partition by book_id order by chunk_index, id rows between unbounded preceding and current row) section_title from ch",
    "wi16_running_lines": rf"{_C}, l as (select book_id, id, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '') l from ch where page_number > 0), e as (select book_id, id, 'head' place, unnest(l[1:3]) line from l union select book_id, id, 'foot', unnest(l[greatest(len(l) - 2, 1):len(l)]) from l) select book_id, place, md5(line) line, count(*) pages from e group by book_id, place, e.line having count(*) >= 2",
    "fi10_markers": f"{_C} select id, (length(text) < 20 and annotation_type <> 'note') or (length(text) < 50 and {_KW('text', '|'.join(tx.TOC_WORDS))}) marker from ch where chunk_type = 'annotation'",
    "fi11_annotation_text": f"{_C} select id from ch where chunk_type = 'annotation' and contains(lower(text || ' ' || annotation_type), 'harbour')",
    "fi20_selection": "select distinct i::integer i from (select unnest(generate_series(cast(string_split(p, '-')[1] as integer), cast(string_split(p, '-')[-1] as integer))) i from (select unnest(string_split('0,3,5-10,7', ',')) p)) where i < 9",
    "sc15_text": rf"{_D} select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '^\x{{FEFF}}', ''), '\r\n?', chr(10), 'g'), '(?s)\A---\n.*?\n---\n', '')) hash from dc",
    "sc21_scanned_pages": f"{_C} select book_id, round(avg(case when length(text) >= 100 then 1.0 else 0.0 end), 6) share, avg(case when length(text) >= 100 then 1.0 else 0.0 end) < 0.3 scanned from ch where page_number > 0 group by 1",
    "sc25_clippings": rf"{_D} select doc_id, regexp_extract(text, '^(.*?) \(([^()\r\n]+)\)\r?\n', 1) title, regexp_extract(text, '^(.*?) \(([^()\r\n]+)\)\r?\n', 2) author, try_cast(nullif(regexp_extract(text, 'Location (\d+)-(\d+)', 1), '') as integer) lo, try_cast(nullif(regexp_extract(text, 'Location (\d+)-(\d+)', 2), '') as integer) hi from dc where doc_kind = 'clipping'",
    "sc27_sidecars": f"{_C} select distinct source_file, sha256(source_file) || '.json' sidecar from ch",
    "ex2_by_type": f"{_C} select annotation_type, count(*) n from ch where chunk_type = 'annotation' and book_id = 'b000000001' group by 1",
    "ex3_annotated": f"{_C} select book_id, count(*) n, max(indexed_at) latest from ch where chunk_type = 'annotation' group by 1",
    "ex20_clean_lines": _D + r""" select doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_replace(x, '^[\t\x0b\f\r \x{85}\p{Z}]+|[\t\x0b\f\r \x{85}\p{Z}]+$', '', 'g')), lambda x: x <> ''), chr(10) || chr(10))) hash from dc""",
    "ex33_codes": f"{_C} select distinct language, case language when 'en' then 'eng' when 'de' then 'deu' when 'fr' then 'fra' when 'es' then 'spa' when 'it' then 'ita' else 'und' end code from ch",
}
_DIGIT = "case x when 'm' then 1000 when 'd' then 500 when 'c' then 100 when 'l' then 50 when 'x' then 10 when 'v' then 5 else 1 end"
ORACLE["tx13_roman"] = rf"""{_C}, p as (select distinct page_label, lower(trim(page_label)) r from ch), v as (select *, case when r <> '' and regexp_full_match(r, 'm{{0,3}}(cm|cd|d?c{{0,3}})(xc|xl|l?x{{0,3}})(ix|iv|v?i{{0,3}})') then list_transform(string_split(r, ''), lambda x: {_DIGIT}) end d from p),
   e as (select page_label, d, unnest(coalesce(d, [0])) n, generate_subscripts(coalesce(d, [0]), 1) i from v)
   select page_label, case when any_value(d) is not null then sum(case when n < coalesce(d[i + 1], 0) then -n else n end)::bigint end as value from e group by 1"""
_ROWS_ONLY = ["tx2_paragraphs", "tx3_markdown", "tx4_dialogue", "tx4_exchanges_all", "sc31_flat_all", "ex24_markdown_all", "tx6_words", "tx8_parents", "wi15_labels"]
QUERIES = {k: f for k, f in list(globals().items()) if (k in ORACLE or k in _ROWS_ONLY) and callable(f)}
