"""Catalogue queries. A rating, which the tables lack, is the document's number
modulo 6 (0: not rated)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import catalogue as C
from lectern.plans.sql import BOOKS
from lectern.tables import book_view, load


def _b(spark: SparkSession, d: str) -> DataFrame:
    return book_view(spark, d).withColumn("rating", (F.col("calibre_id") % 6).cast("int"))


def ag1_authors(spark, d):
    return C.count_each(_b(spark, d), "authors", "author")


def ag1_tags(spark, d):
    return C.count_each(_b(spark, d), "tags", "tag")


def ag1_publishers(spark, d):
    return C.count_by(_b(spark, d), "publisher")


def ag1_languages(spark, d):
    return C.count_by(_b(spark, d), "language")


def ag1_series(spark, d):
    return C.count_by(_b(spark, d), "series")


def ag2_ratings(spark, d):
    return _b(spark, d).groupBy(F.round(F.col("rating") / 2.0, 1).alias("stars")).agg(F.count("*").alias("books"))


def ag3_years(spark, d):
    return C.count_by(_b(spark, d), "year")


def ag4_formats(spark, d):
    return C.count_by(_b(spark, d), "file_format")


def ag5_missing(spark, d):
    return C.missing_fields(_b(spark, d))


def ag15_tags_min(spark, d):
    return C.count_each(_b(spark, d), "tags", "tag").filter("books >= 5").orderBy(F.col("books").desc(), "tag").limit(20)


def ag16_joined(spark, d):
    return _b(spark, d).select("source_id", C.authors_text(" & ", "Unknown").alias("authors_text"), F.array_join(F.sort_array(C.arr("tags")), "\x1f").alias("tags_text"))


def ag18_latest(spark, d):
    c = load(spark, d, "index_log")
    return c.filter("source_id is not null").groupBy("source_id").agg(F.max("processed_at").alias("latest"))


def ag19_digest(spark, d):
    c = load(spark, d, "index_log").dropDuplicates(["log_id"]).withColumn("week", F.date_format(F.date_trunc("week", "processed_at"), "yyyy-MM-dd"))
    one = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    return c.groupBy("week").agg(one("completed"), one("failed"), one("skipped"), F.count("*").alias("n"), F.max_by("run_id", F.struct("processed_at", "log_id")).alias("last_run"))


def ag20_same_title(spark, d):
    return _b(spark, d).filter("title is not null").groupBy(F.lower("title").alias("title")).agg(F.count("*").alias("n")).filter("n > 1")


def ag22_bundle(spark, d):
    return C.bundle(_b(spark, d))


def wi9_priority(spark, d):
    return C.priority(_b(spark, d), ["b000000009", "b000000004"]).select("source_id", "position")


def wi10_tiers(spark, d):
    b = C.select_books(_b(spark, d))
    w = Window.orderBy("tier", F.array_join(C.arr("authors"), " & "), "title", "source_id")
    return b.select("source_id", "tier", F.row_number().over(w).alias("position"))


def wi11_format(spark, d):
    b = _b(spark, d)
    f = F.array(F.lower("file_format"), F.lit("txt"), F.when(F.col("calibre_id") % 3 == 0, F.lit("epub")).otherwise(F.lit("djvu")))
    return b.select("source_id", C.best_format(f, ["pdf", "epub", "mobi"]).alias("format"))


def wi19_sorted(spark, d):
    b = _b(spark, d)
    return b.select("source_id", F.row_number().over(Window.orderBy(F.coalesce("year", F.lit(0)).desc(), F.lower("title"), "source_id")).alias("position"))


def fi12_excluded(spark, d):
    return C.select_books(_b(spark, d), excluded=["history", "Law"]).select("source_id")


def fi13_selection(spark, d):
    return C.select_books(_b(spark, d), rating=3, authors=["wen", "mont"]).select("source_id", "rating", "tier")


def fi15_clean(spark, d):
    h = load(spark, d, "search_hits").distinct()
    x = F.col("_score")
    return h.groupBy(F.when(x.isNull() | F.isnan(x), "").otherwise("scored").alias("state")).agg(F.count("*").alias("n"))


def lk1_duplicate_ids(spark, d):
    return C.duplicates(_b(spark, d), "identifier")


def lk2_duplicate_titles(spark, d):
    return C.duplicates(_b(spark, d), "title")


def lk3_duplicate_title_author(spark, d):
    return C.duplicates(_b(spark, d), "title_author")


def lk4_fuzzy_method(spark, d):
    return C.duplicates(_b(spark, d), "fuzzy")


def _items(spark, d):
    """Outside records made from the catalogue: every third keeps its title,
    every third has an edition's name behind it, every third has a letter more
    (DuckDB's distance counts bytes, so the letter is one byte); every eleventh is
    of no book, and every seventh has one of its codes in small letters."""
    b = _b(spark, d)
    t = F.when(F.col("calibre_id") % 11 == 5, F.concat(F.lit("No such book as "), F.col("calibre_id").cast("string"))).when(F.col("calibre_id") % 3 == 0, F.col("title")).when(F.col("calibre_id") % 3 == 1, F.concat("title", F.lit(" (Reading Edition)"))).otherwise(F.concat("title", F.lit("x")))
    code = F.when(F.col("calibre_id") % 7 == 2, F.lower(F.array_min(F.map_values("identifiers"))))
    return b.select(F.col("source_id").alias("item"), code.alias("code"), t.alias("title"), F.array_join(C.arr("authors"), " & ").alias("author"))


def lk6_match_all(spark, d):
    """The matcher over every document."""
    return C.match(_items(spark, d), _b(spark, d))


def lk7_unmatched_all(spark, d):
    i = _items(spark, d)
    return i.join(C.match(i, _b(spark, d)), "item", "left_anti").select("item")


def lk8_by_author(spark, d):
    return C.by_author(_b(spark, d), "wen", ["phil"], (1900, 2030)).select("source_id", "title", "year")


def lk10_bibtex(spark, d):
    return C.bibliography(_b(spark, d), "bibtex").select("source_id", F.md5("entry").alias("hash"))


def lk10_ris(spark, d):
    return C.bibliography(_b(spark, d), "ris").select("source_id", F.md5("entry").alias("hash"))


def lk10_plain(spark, d):
    return C.bibliography(_b(spark, d), "plain")


def lk10_csv(spark, d):
    return C.bibliography(_b(spark, d), "csv")


def lk11_details(spark, d):
    c = load(spark, d, "chunks").select("book_id", "id", "chunk_type").distinct()
    n = c.groupBy("book_id").agg(F.countDistinct("id").alias("chunks"))
    b = _b(spark, d)
    return b.join(n, b.source_id == n.book_id, "left").select("source_id", "title", C.authors_text().alias("authors"), F.size(C.arr("tags")).cast("bigint").alias("tags"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def sc2_listing(spark, d):
    b = _b(spark, d)
    return b.filter(F.array_contains(C.arr("tags"), "philology") & ~F.array_contains(C.arr("tags"), "law") & F.col("file_format").isNotNull()).select("source_id", "title")


def sc5_creators(spark, d):
    """Creators with a fallback: authors, else the series' name."""
    b = _b(spark, d)
    return b.select("source_id", F.coalesce(F.nullif(F.array_join(C.arr("authors"), "; "), F.lit("")), F.nullif(F.col("series"), F.lit("")), F.lit("Unknown")).alias("creators"))


def sc10_changed_since(spark, d):
    b = _b(spark, d)
    return b.filter(F.col("modified").isNull() | (F.col("modified") > F.lit("2024-06-01 00:00:00").cast("timestamp"))).select("source_id")


def sc12_lookup(spark, d):
    return _b(spark, d).filter("source_id = 'b000000007'").select("source_id", "title", C.authors_text().alias("authors"), "publisher", "year")


def sc13_brief(spark, d):
    return _b(spark, d).select("source_id", "title", C.authors_text().alias("authors"))


def jo1_author_stats(spark, d):
    b = _b(spark, d).select("source_id", "year", F.explode(F.array_distinct(C.arr("authors"))).alias("author"))
    return b.groupBy("author").agg(F.count("*").alias("books"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def jo3_shared_identifier(spark, d):
    """Pairs by a shared value, from the value's group and not from all pairs."""
    return C.duplicates(_b(spark, d), "identifier").select("value", F.col("n").alias("documents"))


def jo7_all_tags(spark, d):
    b = _b(spark, d)
    return b.filter(F.forall(F.array(F.lit("his"), F.lit("phi")), lambda w: F.exists(C.arr("tags"), lambda t: F.contains(F.lower(t), w)))).select("source_id")


def jo13_merge(spark, d):
    c = load(spark, d, "chunks").groupBy("book_id").agg(F.countDistinct("id").alias("chunks"))
    return _b(spark, d).select(F.col("source_id").alias("book_id"), "file_format").join(c, "book_id", "left").fillna({"chunks": 0})


def jo14_codes(spark, d):
    """One document per code: a preferred kind of identifier first."""
    e = _b(spark, d).select("source_id", F.explode("identifiers").alias("kind", "v")).filter("coalesce(v, '') <> ''").withColumn("code", F.upper(F.trim("v")))
    w = Window.partitionBy("code").orderBy(F.when(F.col("kind") == "isbn", 0).otherwise(1), "source_id")
    return e.withColumn("r", F.row_number().over(w)).filter("r = 1").select("code", "source_id", "kind")


def tx26_metadata_hash(spark, d):
    b = _b(spark, d)
    h = tx.metadata_hash(F.col("title"), C.authors_text(), F.col("publisher"), F.col("comments_html"), F.col("tags"))
    return b.select("source_id", h.alias("hash"))


def tx33_year(spark, d):
    return _b(spark, d).select("source_id", tx.year_of(F.col("created_at")).alias("created_year"))


def tx34_titles(spark, d):
    return _b(spark, d).select("source_id", tx.normal_title(F.col("title")).alias("normal"))


def tx35_normal(spark, d):
    return _b(spark, d).select("source_id", tx.normal_text(F.col("title")).alias("normal"))


def tx36_slug(spark, d):
    return _b(spark, d).select("source_id", tx.slug(F.col("title")).alias("slug"), F.date_format("modified", "yyyy-MM").alias("month"))


def tx42_tags(spark, d):
    return _b(spark, d).select("source_id", F.array_join(C.arr("tags"), ", ").alias("tags"))


def sc17_strip(spark, d):
    return _b(spark, d).select("source_id", F.md5(tx.strip_tags(F.col("comments_html"))).alias("hash"))


def sk12_file_names(spark, d):
    return _b(spark, d).select("source_id", tx.safe_name(F.col("title")).alias("name"))


def ex5_assembly(spark, d):
    b = _b(spark, d)
    return b.select("source_id", F.coalesce("title", F.lit("Untitled")).alias("title"), C.authors_text(" & ", "Unknown").alias("authors"), F.coalesce("year", F.lit(0)).alias("year"), F.coalesce(F.lower("language"), F.lit("")).alias("language"), F.size(F.coalesce("identifiers", F.create_map().cast("map<string,string>"))).cast("bigint").alias("identifiers"))


def ex10_batch_list(spark, d):
    b = _b(spark, d)
    return b.filter(~F.arrays_overlap(C.arr("tags"), F.array(F.lit("law"))) & F.exists(C.arr("authors"), lambda a: F.lower(a).contains("st")) & F.col("file_format").isNotNull()).select("source_id", C.authors_text(" & ", "Unknown").alias("authors"))


def ex35_distinct_tags(spark, d):
    return _b(spark, d).select(F.explode(C.arr("tags")).alias("tag")).distinct()


def ex38_total(spark, d):
    return _b(spark, d).agg(F.count("*").alias("books"))


_B = f"with {BOOKS}, b as (select *, cast(calibre_id % 6 as integer) rating from bk)"
_AUTH = "array_to_string(coalesce(authors, []), ' & ')"
_IDS = "x as (select source_id, unnest(map_entries(identifiers)) e from b)"
_PLAIN = "translate(lower(trim({c})), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīłńňōőřśšťūůűźżž', 'aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegilnnoorsstuuuzzz')"


def _normal(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({_PLAIN.format(c=c)}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _title(c: str) -> str:
    t = f"trim(lower({c}))"
    for a in tx.ARTICLES:
        t = rf"regexp_replace({t}, '^{a}\s+', '')"
    return rf"trim(regexp_replace(regexp_replace({t}, '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def _each(c: str, name: str) -> str:
    return f"{_B} select {name}, count(*) books from (select unnest(list_distinct(coalesce({c}, []))) {name} from b) group by 1"


def _by(c: str) -> str:
    return f"{_B} select {c}, count(*) books from b where {c} is not null and cast({c} as varchar) <> '' group by 1"


def _json(c: str) -> str:
    q = f"coalesce({c}, '')"
    for a, b in (("\\", "\\\\"), ('"', '\\"')):
        q = f"replace({q}, '{a}', '{b}')"
    for a, b in (("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t")):
        q = f"replace({q}, {a}, '{b}')"
    return f"'\"' || {q} || '\"'"


_STRIP = r"regexp_replace(coalesce(comments_html, ''), '<[^>]+>', ' ', 'g')"
for _a, _r in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_a}', '{_r}')"
_SLUG = "lower(title)"
for _a, _r in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
    _SLUG = f"replace({_SLUG}, '{_a}', '{_r}')"
_FMT = "[lower(file_format), 'txt', case when calibre_id % 3 = 0 then 'epub' else 'djvu' end]"
_SORTW = lambda c: f"array_to_string(list_sort(string_split({_normal(c)}, ' ')), ' ')"
_SIM = lambda a, b: f"round(100 * (1 - levenshtein({_SORTW(a)}, {_SORTW(b)})::double / greatest(length({_SORTW(a)}), length({_SORTW(b)}), 1)), 4)"
def match_sql(items: str, least: float) -> str:
    """Tables up to ``al`` (item, book, score, how): the matcher's rule over all pairs of
    the records in ``i0`` (item, code, title, author) and the documents in ``b``."""
    return rf"""{_B}, i0 as ({items}),
    i as (select item, code, nt, na, array_to_string(list_sort(string_split(nt, ' ')), ' ') st, array_to_string(list_sort(string_split(na, ' ')), ' ') sa
          from (select item, code, {_normal(r"regexp_replace(coalesce(title, ''), '(?i)\s*\([\p{{L}}\p{{M}}\p{{N}}_\s]+Edition\)\s*$', '')".replace('{{', '{').replace('}}', '}'))} nt, {_normal("coalesce(author, '')")} na from i0)),
    k as (select book, nt, na, array_to_string(list_sort(string_split(nt, ' ')), ' ') st, array_to_string(list_sort(string_split(na, ' ')), ' ') sa
          from (select source_id book, {_normal("coalesce(title, '')")} nt, {_normal(_AUTH)} na from b) where nt <> ''),
    bc as (select source_id book, upper(unnest(map_values(identifiers))) c from b),
    co as (select item, min(book) book, 100.0::double score, 'code' how from i join bc on upper(code) = c where code <> '' group by item),
    ex as (select item, min(book) book, 100.0::double score, 'exact' how from i join k using (nt) where nt <> '' and item not in (select item from co) and (contains(i.na, k.na) or contains(k.na, i.na)) group by item),
    lk as (select item, book, i.sa, k.sa ka, round(100 * (1 - levenshtein(i.st, k.st)::double / greatest(length(i.st), length(k.st), 1)), 4) t
           from i, k where i.nt <> '' and item not in (select item from co) and item not in (select item from ex)),
    sc as (select item, book, case when sa = '' or ka = '' then t else round(0.7 * t + 0.3 * round(100 * (1 - levenshtein(sa, ka)::double / greatest(length(sa), length(ka), 1)), 4), 4) end score from lk),
    fz as (select item, book, score, 'fuzzy' how from (select *, row_number() over (partition by item order by score desc, book desc) r from sc where score >= {least}) where r = 1),
    al as (select * from co union all select * from ex union all select * from fz)"""


_MATCH = match_sql(
    f"""select source_id item, case when calibre_id % 7 = 2 then lower(list_min(map_values(identifiers))) end code,
      case when calibre_id % 11 = 5 then 'No such book as ' || calibre_id when calibre_id % 3 = 0 then title when calibre_id % 3 = 1 then title || ' (Reading Edition)' else title || 'x' end title, {_AUTH} author from b""",
    80,
)

ORACLE = {
    "ag1_authors": _each("authors", "author"),
    "ag1_tags": _each("tags", "tag"),
    "ag1_publishers": _by("publisher"),
    "ag1_languages": _by("language"),
    "ag1_series": _by("series"),
    "ag2_ratings": f"{_B} select round(rating / 2.0::double, 1) stars, count(*) books from b group by 1",
    "ag3_years": _by("year"),
    "ag4_formats": _by("file_format"),
    "ag5_missing": f"""{_B}, f as (select source_id, title, list_filter([case when len(coalesce(authors, [])) = 0 then 'authors' end, case when coalesce(publisher, '') = '' then 'publisher' end, case when year is null then 'year' end,
       case when len(coalesce(tags, [])) = 0 then 'tags' end, case when coalesce(language, '') = '' then 'language' end, case when trim(coalesce(comments_html, '')) = '' then 'comments' end], lambda x: x is not null) m from b)
       select source_id, title, array_to_string(m, ',') missing, len(m) n_missing from f where len(m) > 0""",
    "ag15_tags_min": f"select * from ({_each('tags', 'tag')}) where books >= 5 order by books desc, tag limit 20",
    "ag16_joined": f"{_B} select source_id, case when len(coalesce(authors, [])) = 0 then 'Unknown' else {_AUTH} end authors_text, array_to_string(list_sort(coalesce(tags, [])), chr(31)) tags_text from b",
    "ag18_latest": "select source_id, max(processed_at) latest from index_log where source_id is not null group by 1",
    "ag19_digest": "with l as (select distinct on (log_id) * from index_log) select strftime(date_trunc('week', processed_at), '%Y-%m-%d') as week, count(*) filter (where status = 'completed') completed, count(*) filter (where status = 'failed') failed, count(*) filter (where status = 'skipped') skipped, count(*) n, arg_max(run_id, (processed_at, log_id)) last_run from l group by 1",
    "ag20_same_title": f"{_B} select lower(title) title, count(*) n from b where title is not null group by 1 having count(*) > 1",
    "ag22_bundle": f"{_B} " + " union all ".join([*[f"select '{c}' metric, value, count(*) books from (select unnest(list_distinct(coalesce({c}, []))) value from b) group by 2" for c in ("authors", "tags")], *[f"select '{c}', cast({c} as varchar), count(*) from b where {c} is not null and cast({c} as varchar) <> '' group by 2" for c in ("publisher", "language", "series", "year", "file_format")]]),
    "wi9_priority": f"{_B} select source_id, row_number() over (order by case when source_id in ('b000000009', 'b000000004') then 0 else 1 end, case rating when 5 then 0 when 4 then 1 else 2 end, calibre_id desc, source_id) as position from b",
    "wi10_tiers": f"{_B}, t as (select *, case rating when 5 then 0 when 4 then 1 when 3 then 2 when 2 then 4 when 1 then 5 else 3 end tier from b) select source_id, tier, row_number() over (order by tier, {_AUTH}, title, source_id) as position from t",
    "wi11_format": f"{_B} select source_id, coalesce(case when list_contains({_FMT}, 'pdf') then 'pdf' when list_contains({_FMT}, 'epub') then 'epub' when list_contains({_FMT}, 'mobi') then 'mobi' end, list_sort({_FMT})[1]) as format from b",
    "wi19_sorted": f"{_B} select source_id, row_number() over (order by coalesce(year, 0) desc, lower(title), source_id) as position from b",
    "fi12_excluded": f"{_B} select source_id from b where not list_has_any(list_transform(coalesce(tags, []), lambda t: lower(t)), ['history', 'law'])",
    "fi13_selection": f"{_B} select source_id, rating, case rating when 5 then 0 when 4 then 1 when 3 then 2 when 2 then 4 when 1 then 5 else 3 end tier from b where rating >= 3 and len(list_filter(coalesce(authors, []), lambda a: contains(lower(a), 'wen') or contains(lower(a), 'mont'))) > 0",
    "fi15_clean": "select case when _score is null or isnan(_score) then '' else 'scored' end state, count(*) n from (select distinct * from search_hits) group by 1",
    "lk1_duplicate_ids": f"{_B}, {_IDS}, y as (select distinct source_id, e.key || ':' || e.value as value from x where coalesce(e.value, '') <> '') select 'identifier' kind, value, string_agg(source_id, ',' order by source_id) ids, count(*) n from y group by value having count(*) > 1",
    "lk2_duplicate_titles": f"{_B} select 'title' kind, lower(title) as value, string_agg(source_id, ',' order by source_id) ids, count(*) n from b where title is not null group by 2 having count(*) > 1",
    "lk3_duplicate_title_author": f"{_B}, y as (select source_id, {_title('title')} || ' by ' || array_to_string(list_sort(list_transform(coalesce(authors, []), lambda a: trim(lower(a)))), ', ') as value from b where title is not null) select 'title_author' kind, value, string_agg(source_id, ',' order by source_id) ids, count(*) n from y group by value having count(*) > 1",
    "lk4_fuzzy_method": "select '' kind, '' as value, '' ids, 0::bigint n where false",
    "lk6_match_all": f"{_MATCH} select item, book, score, how from al",
    "lk7_unmatched_all": f"{_MATCH} select item from i0 where item not in (select item from al)",
    "lk8_by_author": f"{_B} select source_id, title, year from b where len(list_filter(coalesce(authors, []), lambda a: contains(lower(a), 'wen'))) > 0 and len(list_filter(coalesce(tags, []), lambda t: contains(lower(t), 'phil'))) > 0 and year between 1900 and 2030",
    "lk10_bibtex": rf"""{_B} select source_id, md5(concat_ws(chr(10), '@book{{' || regexp_replace(lower(coalesce(string_split(authors[1], ',')[1], 'anon')), '[^\p{{L}}\p{{N}}]', '', 'g') || coalesce(cast(year as varchar), 'nd') || ',', '  title = {{' || title || '}},',
       case when len(coalesce(authors, [])) > 0 then '  author = {{' || array_to_string(authors, ' and ') || '}},' end, '  year = {{' || year || '}},', '  publisher = {{' || publisher || '}},', '}}')) hash from b""",
    "lk10_ris": f"{_B} select source_id, md5(concat_ws(chr(10), 'TY  - BOOK', case when len(coalesce(authors, [])) > 0 then array_to_string(list_transform(authors, lambda a: 'AU  - ' || a), chr(10)) end, 'TI  - ' || title, 'PY  - ' || year, 'PB  - ' || publisher, 'ER  - ')) hash from b",
    "lk10_plain": f"{_B} select source_id, concat_ws('. ', nullif(array_to_string(coalesce(authors, []), ', '), ''), title || coalesce(' (' || year || ')', ''), publisher) entry from b",
    "lk10_csv": f"{_B} select source_id, concat_ws(',', " + ", ".join(f"'\"' || replace(coalesce({c}, ''), '\"', '\"\"') || '\"'" for c in ("title", "array_to_string(coalesce(authors, []), '; ')", "cast(year as varchar)", "publisher")) + ") entry from b",
    "lk11_details": f"{_B}, n as (select book_id, count(distinct id) c from chunks group by 1) select source_id, title, {_AUTH} authors, len(coalesce(tags, [])) tags, coalesce(c, 0) chunks from b left join n on n.book_id = source_id",
    "sc2_listing": f"{_B} select source_id, title from b where list_contains(coalesce(tags, []), 'philology') and not list_contains(coalesce(tags, []), 'law') and file_format is not null",
    "sc5_creators": f"{_B} select source_id, coalesce(nullif(array_to_string(coalesce(authors, []), '; '), ''), nullif(series, ''), 'Unknown') creators from b",
    "sc10_changed_since": f"{_B} select source_id from b where modified is null or modified > timestamp '2024-06-01'",
    "sc12_lookup": f"{_B} select source_id, title, {_AUTH} authors, publisher, year from b where source_id = 'b000000007'",
    "sc13_brief": f"{_B} select source_id, title, {_AUTH} authors from b",
    "jo1_author_stats": f"{_B} select author, count(*) books, min(year) first_year, max(year) last_year from (select source_id, year, unnest(list_distinct(coalesce(authors, []))) author from b) group by 1",
    "jo3_shared_identifier": f"{_B}, {_IDS}, y as (select distinct source_id, e.key || ':' || e.value as value from x where coalesce(e.value, '') <> '') select value, count(*) documents from y group by value having count(*) > 1",
    "jo7_all_tags": f"{_B} select source_id from b where len(list_filter(coalesce(tags, []), lambda t: contains(lower(t), 'his'))) > 0 and len(list_filter(coalesce(tags, []), lambda t: contains(lower(t), 'phi'))) > 0",
    "jo13_merge": f"{_B}, n as (select book_id, count(distinct id) c from chunks group by 1) select source_id book_id, file_format, coalesce(c, 0) chunks from b left join n on n.book_id = source_id",
    "jo14_codes": f"{_B}, {_IDS}, y as (select source_id, e.key kind, upper(trim(e.value)) code from x where coalesce(e.value, '') <> '') select code, source_id, kind from (select *, row_number() over (partition by code order by case when kind = 'isbn' then 0 else 1 end, source_id) r from y) where r = 1",
    "tx26_metadata_hash": f"{_B} select source_id, md5('{{\"author\": ' || {_json(_AUTH)} || ', \"comments\": ' || {_json('comments_html')} || ', \"publisher\": ' || {_json('publisher')} || ', \"tags\": [' || array_to_string(list_transform(list_sort(coalesce(tags, [])), lambda t: {_json('t')}), ', ') || '], \"title\": ' || {_json('title')} || '}}') hash from b",
    "tx33_year": rf"{_B} select source_id, cast(nullif(regexp_extract(created_at, '\b(\d{{4}})\b', 1), '') as integer) created_year from b",
    "tx34_titles": f"{_B} select source_id, {_title('title')} normal from b",
    "tx35_normal": f"{_B} select source_id, {_normal('title')} normal from b",
    "tx36_slug": rf"{_B} select source_id, regexp_replace(substr(regexp_replace(regexp_replace({_SLUG}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') slug, strftime(modified, '%Y-%m') as month from b",
    "tx42_tags": f"{_B} select source_id, array_to_string(coalesce(tags, []), ', ') tags from b",
    "sc17_strip": rf"{_B} select source_id, md5(trim(regexp_replace({_STRIP}, '\s+', ' ', 'g'))) hash from b",
    "sk12_file_names": f"{_B} select source_id, case when title = regexp_replace(title, '[^A-Za-z0-9._-]', '_', 'g') then title else regexp_replace(title, '[^A-Za-z0-9._-]', '_', 'g') || '_' || substr(md5(title), 1, 8) end as name from b",
    "ex5_assembly": f"{_B} select source_id, coalesce(title, 'Untitled') title, case when len(coalesce(authors, [])) = 0 then 'Unknown' else {_AUTH} end authors, coalesce(year, 0) as year, coalesce(lower(language), '') as language, coalesce(cardinality(identifiers), 0)::bigint identifiers from b",
    "ex10_batch_list": f"{_B} select source_id, case when len(coalesce(authors, [])) = 0 then 'Unknown' else {_AUTH} end authors from b where not list_contains(coalesce(tags, []), 'law') and len(list_filter(coalesce(authors, []), lambda a: contains(lower(a), 'st'))) > 0 and file_format is not null",
    "ex35_distinct_tags": f"{_B} select distinct unnest(coalesce(tags, [])) tag from b",
    "ex38_total": f"{_B} select count(*) books from b",
}
QUERIES = {k: f for k, f in list(globals().items()) if k in ORACLE and callable(f)}
