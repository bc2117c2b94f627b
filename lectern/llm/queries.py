"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import conversations, fusion, languages, markup, mixing, neighbours, pieces, sentences, tokens
from lectern.tables import current_catalogue, current_chunks, instant, latest, load

#: Cosine from which a pair of chunks is reported.
SIMILAR = 0.90
SCORES = {"_distance": False, "_relevance_score": True, "_score": True}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).filter("piece = 0").select("id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split(pieces.oversized(load(spark, d, "chunks")))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return conversations.messages(load(spark, d, "chat_messages"), load(spark, d, "speaker_alias"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.left_out(_messages(spark, d))


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild(_messages(spark, d))


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each conversation as a channel, at the calibrated silence."""
    m = _messages(spark, d)
    gap = conversations.calibrated_gap(m, ["conv_id"])
    s = conversations.sessionize(m, ["conv_id"], gap)
    return s.groupBy("conv_id", "session").agg(F.count("*").alias("messages"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(neighbours.usable(), F.col("vector")).alias("vector")
    return current_chunks(load(spark, d, "chunks"), v).filter("vector is not null")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.Index(_vectors(spark, d), posted=5, fit_on=load(spark, d, "chunks").select("vector")).neighbours(5, SIMILAR, least_overlap=4)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar other chunks of every chunk: posted under 4 pivots,
    sought under 32, so that the work grows with the root of the collection for each row."""
    index = neighbours.Index(_vectors(spark, d), posted=4, prefix=32, second=1, fit_on=load(spark, d, "chunks").select("vector"))
    return index.neighbours(5, probes=32)


def _comments(spark: SparkSession, d: str) -> DataFrame:
    return current_catalogue(load(spark, d, "catalogue"), "comments_html").select("source_id", "comments_html")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.kinds(_comments(spark, d))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean(_comments(spark, d))


def _profiles(spark: SparkSession, d: str):
    c = load(spark, d, "chunks")
    return languages.profiles(languages.training(c, "text", F.col("language"), F.col("id")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The scan is read once: a row's languages are found before the shuffle,
    which then carries a few bytes a row instead of its text."""
    table = _profiles(spark, d)
    c = load(spark, d, "chunks").filter("id is not null").select(F.col("id").alias("record_id"), instant(F.col("indexed_at")).alias("at"), languages.label(F.col("language")).alias("named"), "text")
    c = languages.masks(c, table, ["record_id", "at", "named"]).withColumn("record_kind", F.lit("chunk"))
    c = latest(c, ["record_id"], [F.col("at").desc_nulls_last(), F.col("named").desc_nulls_last(), F.col("langs").desc()])
    b = current_catalogue(load(spark, d, "catalogue"), "comments_html", "language")
    b = b.select(F.to_json(F.struct("source_id", "language")).alias("key"), "comments_html")
    b = languages.masks(markup.clean(b, "key", what="prose"), table, ["key"], "clean")
    key = F.from_json("key", "source_id string, language string")
    b = b.select(key["source_id"].alias("record_id"), languages.label(key["language"]).alias("named"), "langs", F.lit("book").alias("record_kind"))
    return _further(c.select("record_kind", "record_id", "named", "langs").unionByName(b))


def _further(records: DataFrame) -> DataFrame:
    """A row for each language in the bits that the label does not name."""
    each = F.array(*[F.when((F.col("langs").bitwiseAND(F.lit(1 << i)) != 0) & (F.coalesce("named", F.lit("")) != lang), F.lit(lang)) for i, lang in enumerate(languages.LANGUAGES)])
    return records.select("record_kind", "record_id", F.explode(F.array_compact(each)).alias("lang"))


def p6_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of one language in the current chunks and in the cleaned
    comments of the catalogue (places are those of the clean text), with its confidence."""
    table = _profiles(spark, d)
    c = load(spark, d, "chunks").filter("id is not null").select("id", instant(F.col("indexed_at")).alias("at"), "text")
    c = latest(c, ["id"], [F.col("at").desc_nulls_last(), F.xxhash64("text").desc()])
    c = c.select(F.lit("chunk").alias("record_kind"), "id", "text")
    b = markup.clean(_comments(spark, d)).select(F.lit("book").alias("record_kind"), F.col("source_id").alias("id"), F.col("clean").alias("text"))
    return languages.stretches(c.unionByName(b), table, ["record_kind", "id"])


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """The language of each current chunk and catalogue row: that of most of its
    text, with the share it has there times its confidence. A record in which no
    sentence counts has no language and the confidence 0."""
    s = p6_stretches(spark, d).withColumn("n", F.col("stretch_end") - F.col("stretch_start"))
    per = s.groupBy("record_kind", "id", "lang").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("c"))
    all_ = per.groupBy("record_kind", "id").agg(F.sum("n").alias("total"), F.max(F.struct("n", "lang", "c")).alias("top"))
    found = all_.select("record_kind", "id", F.col("top.lang").alias("lang"), F.round(F.col("top.c") * F.col("top.n") / F.col("total"), 4).alias("confidence"))
    c = load(spark, d, "chunks").select(F.lit("chunk").alias("record_kind"), "id")
    b = load(spark, d, "catalogue").select(F.lit("book").alias("record_kind"), F.col("source_id").alias("id"))
    records = c.unionByName(b).filter("id is not null").distinct()
    return records.join(found, ["record_kind", "id"], "left").select("record_kind", "id", "lang", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "search_hits").select("query_id", "id", *SCORES)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Read off the fusion: its ranks under the three scores."""
    return fusion.in_every_top(fusion.fuse(_hits(spark, d), "query_id", "id", SCORES), SCORES).select("query_id", "id")


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.fuse(_hits(spark, d), "query_id", "id", SCORES)
    return fusion.ranking(fused, "query_id", "id").select("query_id", "id", "total", "rank_distance", "rank_relevance_score", "rank_score", "place")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(load(spark, d, "documents").select("doc_id", "text"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return mixing.sizes(load(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Read off the report of the mixture."""
    return p9_shares(spark, d).filter("target_share > 0 and not reachable").select("source")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from lectern.session import cut

    sized = cut(_sized(spark, d))
    totals = mixing.source_totals(sized, load(spark, d, "mix_targets"))
    return mixing.choose(sized, totals), totals


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(load(spark, d, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_turns, p2_sessions, p3_found, p3_neighbours, p4_found, p4_clean, p6_found, p6_stretches, p6_records, p7_found, p7_ranking, p8_ids, p9_found, p9_mixture, p9_shares, p10_found)}

ORACLE = {
    "p1_found": """
        with cur as (select id, text, row_number() over (partition by id order by indexed_at desc) rn from chunks where id is not null)
        select id from cur where rn = 1 and length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) > 1600""",
    "p2_found": r"""
        with m0 as (select *, row_number() over (partition by msg_id order by loaded_at) rn from chat_messages where conv_id is not null),
        m as (select msg_id, conv_id, platform, seq, parent_msg_id, sent_at,
                not regexp_full_match(coalesce(content, ''), '[\s\x{a0}]*') as filled,
                (select max(speaker_role) from speaker_alias a where a.alias_form = trim(regexp_replace(lower(speaker), '[*\[\]():\s\x{a0}]+', ' ', 'g'))) as role
              from m0 where rn = 1),
        chain as (select conv_id, msg_id, 1 as place from m where platform = 'treetalk' and parent_msg_id is null
              and conv_id in (select conv_id from m where platform = 'treetalk' group by 1 having count(*) filter (where parent_msg_id is null) = 1
                              and count(distinct parent_msg_id) = count(*) - 1)),
        walked as (with recursive w(conv_id, msg_id, place) as (select * from chain union all
                     select m.conv_id, m.msg_id, w.place + 1 from w join m on m.conv_id = w.conv_id and m.parent_msg_id = w.msg_id)
                   select * from w),
        o as (select m.*, case platform when 'lesechat' then seq::bigint when 'pagechat' then epoch_us(sent_at) else w.place end as pos
              from m left join walked w using (conv_id, msg_id)),
        nx as (select conv_id, role, lead(role) over (partition by conv_id order by pos, msg_id) as nxt from o where filled and role in ('human', 'assistant') and pos is not null),
        lack as (select conv_id from nx where role = 'human' and coalesce(nxt, 'human') = 'human')
        select conv_id from o group by conv_id, platform
        having bool_or(role is null) or bool_or(pos is null) or not bool_or(coalesce(role = 'human' and filled, false))
            or (platform = 'lesechat' and (count(distinct pos) < count(*) or min(pos) not in (0, 1) or max(pos) - min(pos) + 1 <> count(*)))
            or conv_id in (select conv_id from lack)""",
    "p3_found": """
        with c as (select id, cast(vector as double[]) v, row_number() over (partition by id order by indexed_at desc) rn from chunks where id is not null),
        u as (select id, v, sqrt(list_dot_product(v, v)) n from c where rn = 1 and len(v) = 64
                and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
        p as (select a.id a, b.id b, list_dot_product(a.v, b.v) / (a.n * b.n) s from u a join u b on a.id <> b.id),
        r as (select a, b, s, row_number() over (partition by a order by s desc, b) k from p where s >= 0.9)
        select distinct least(a, b) id_a, greatest(a, b) id_b from r where k <= 5""",
    "p7_found": """
        with h as (select query_id, id, min(case when isnan(_distance) then null else _distance end) d,
                     max(case when isnan(_relevance_score) then null else _relevance_score end) r, max(case when isnan(_score) then null else _score end) s
                   from search_hits where query_id is not null and id is not null group by 1, 2),
        a as (select query_id, id, rank() over (partition by query_id order by d) k from h where d is not null),
        b as (select query_id, id, rank() over (partition by query_id order by r desc) k from h where r is not null),
        c as (select query_id, id, rank() over (partition by query_id order by s desc) k from h where s is not null)
        select query_id, id from a join b using (query_id, id) join c using (query_id, id) where a.k <= 10 and b.k <= 10 and c.k <= 10""",
    "p7_ranking": """
        with h as (select query_id, id, min(case when isnan(_distance) then null else _distance end) d,
                     max(case when isnan(_relevance_score) then null else _relevance_score end) r, max(case when isnan(_score) then null else _score end) s
                   from search_hits where query_id is not null and id is not null group by 1, 2),
        k as (select query_id, id,
                case when d is not null then rank() over (partition by query_id order by d nulls last) end as rank_distance,
                case when r is not null then rank() over (partition by query_id order by r desc nulls last) end as rank_relevance_score,
                case when s is not null then rank() over (partition by query_id order by s desc nulls last) end as rank_score from h),
        t as (select *, round(coalesce(1.0::double / (60 + rank_distance), 0) + coalesce(1.0::double / (60 + rank_relevance_score), 0) + coalesce(1.0::double / (60 + rank_score), 0), 12) as total from k)
        select query_id, id, total, rank_distance, rank_relevance_score, rank_score,
               row_number() over (partition by query_id order by total desc, id) as place from t""",
}
