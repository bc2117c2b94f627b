"""Streams run once over what is there, compared with the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern import streaming as S
from lectern.session import shared_dir
from lectern.streaming.streams import events


def _e(spark, d):
    # a pattern, as a stream takes a lone file only through one
    return events(spark, f"{d}/events.parque[t]")


def st1_ingest(spark, d):
    return S.run(_e(spark, d).filter("event_type is not null").select("event_id", "event_type"))


def st2_upsert(spark, d):
    """The newest event of each user, folded in batch by batch."""
    at = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    S.upsert_stream(spark, f"{d}/events.parque[t]", "event_id bigint, ts timestamp_ntz, user_id bigint", f"{at}/t", f"{at}/c", "user_id", "ts")
    versions = spark.read.schema("event_id bigint, ts timestamp_ntz, user_id bigint, version int").option("basePath", f"{at}/t").parquet(f"{at}/t")
    last = versions.agg(F.max("version").alias("version"))
    return versions.join(F.broadcast(last), "version").select("user_id", "ts")


def st3_windows(spark, d):
    return S.run(S.window_counts(_e(spark, d), "1 hour"), "complete").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total")


def st3_sliding(spark, d):
    return S.run(S.window_counts(_e(spark, d), "2 hours", "1 hour"), "complete").select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def st4_sessions(spark, d):
    return S.run(S.session_counts(_e(spark, d)), "complete").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


def st5_dedup(spark, d):
    return S.run(S.dedup(_e(spark, d), ["event_id"]).select("event_id"))


def st6_signatures(spark, d):
    """Whether an item's signature changed since it was last seen (rows only:
    the state is custom)."""
    e = _e(spark, d).select(F.col("user_id").cast("string").alias("item"), F.col("event_id").alias("mtime"), F.length("event_type").cast("bigint").alias("size"))
    return S.run(S.signature_cache(e))


ORACLE = {
    "st1_ingest": "select event_id, event_type from events where event_type is not null",
    "st2_upsert": "select user_id, max(ts) ts from events group by 1",
    "st3_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) n, round(sum(value), 4) total from events where ts is not null group by 1, 2",
    "st3_sliding": "select strftime(h, '%Y-%m-%d %H') as hour, event_type, count(*) n from (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) h, event_type from events where ts is not null) group by 1, 2",
    "st4_sessions": "with a as (select *, case when ts - lag(ts) over (partition by user_id order by ts) > interval 30 minute then 1 else 0 end n from events where ts is not null), b as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) s from a) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) events from b group by user_id, s",
    "st5_dedup": "select distinct event_id from events",
}
QUERIES = {k: f for k, f in list(globals().items()) if (k in ORACLE or k == "st6_signatures") and callable(f)}
