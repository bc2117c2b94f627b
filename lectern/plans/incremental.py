"""Queries over the work-item ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import ledger
from lectern.tables import load


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_due(spark, d).select("source_id")


def p5_due(spark: SparkSession, d: str) -> DataFrame:
    """Due documents with the reason (new or changed)."""
    due = ledger.due_documents(load(spark, d, "catalogue"), load(spark, d, "index_log"), load(spark, d, "index_runs"))
    return due.select(F.col("item").alias("source_id"), "reason")


def p5_leases(spark: SparkSession, d: str) -> DataFrame:
    """State of every document whose attempts are read as leases, at the time of
    the last entry: tokens of the runs, expired leases, fenced and void attempts."""
    log, runs = load(spark, d, "index_log"), load(spark, d, "index_runs")
    now = log.agg(F.max("processed_at").cast("timestamp").alias("now"))
    e = ledger.leases_from_log(log, runs)
    # one value; an empty log has none
    return ledger.fold(e, F.lit(now.first()[0]).cast("timestamp")).select(F.col("item").alias("source_id"), "token", "state", "done_token", "fenced")


QUERIES = {"p5_found": p5_found, "p5_due": p5_due, "p5_leases": p5_leases}

_DUE = r"""
    with c0 as (select source_id, coalesce(annotation_hash, '') h, case when regexp_matches(modified_at, '^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}') then
                  try_cast(replace(substr(trim(modified_at), 1, 19), 'T', ' ') as timestamp)
                  - case when regexp_matches(modified_at, '[+-]\d{2}:?\d{2}$') then
                      cast(case when substr(right(trim(modified_at), 6), 1, 1) = '-' then -1 else 1 end as integer)
                      * (interval 1 hour * cast(substr(right(trim(modified_at), 6), 2, 2) as integer) + interval 1 minute * cast(right(trim(modified_at), 2) as integer)) else interval 0 hour end
                  + coalesce(interval 1 microsecond * cast(rpad(nullif(regexp_extract(modified_at, '\.(\d{1,6})', 1), ''), 6, '0') as integer), interval 0 hour) end m
                from catalogue where source_id is not null),
    c as (select source_id, max_by(h, coalesce(m, timestamp '1900-01-01')) h, max(m) m from c0 group by 1),
    l0 as (select distinct log_id, source_id, coalesce(annotation_hash, '') h, processed_at, case when regexp_matches(modified_at, '^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}') then
                  try_cast(replace(substr(trim(modified_at), 1, 19), 'T', ' ') as timestamp)
                  - case when regexp_matches(modified_at, '[+-]\d{2}:?\d{2}$') then
                      cast(case when substr(right(trim(modified_at), 6), 1, 1) = '-' then -1 else 1 end as integer)
                      * (interval 1 hour * cast(substr(right(trim(modified_at), 6), 2, 2) as integer) + interval 1 minute * cast(right(trim(modified_at), 2) as integer)) else interval 0 hour end
                  + coalesce(interval 1 microsecond * cast(rpad(nullif(regexp_extract(modified_at, '\.(\d{1,6})', 1), ''), 6, '0') as integer), interval 0 hour) end m
           from index_log where status = 'completed' and run_id not in (select run_id from index_runs where status = 'rolled_back')),
    l as (select *, row_number() over (partition by source_id order by processed_at desc) rn from l0)
    select c.source_id, case when l.source_id is null then 'new' else 'changed' end as reason from c left join l on c.source_id = l.source_id and l.rn = 1
    where l.source_id is null or c.h <> l.h or coalesce(c.m > l.m, false)"""
_LEASES = """
    with r as (select run_id, min(started_at) started, max(case when status = 'rolled_back' then 1 else 0 end) rolled from index_runs where run_id is not null and started_at is not null group by 1),
    k as (select *, row_number() over (order by started, run_id) token from r),
    l as (select distinct on (log_id, source_id) * from index_log where source_id is not null and processed_at is not null),
    a as (select source_id, token, min(started) claimed, max(rolled) void, max(case when status = 'completed' then processed_at end) done from l join k using (run_id) group by 1, 2),
    f as (select *, exists (select 1 from a b where b.source_id = a.source_id and b.token > a.token and b.claimed < a.done) fenced from a),
    g as (select source_id, max(token) token, max(case when done is not null and void = 0 and not fenced then token end) done_token, count(*) filter (where fenced) fenced from f group by 1)
    select g.source_id, g.token, case when f.done is null and f.void = 0 and f.claimed + interval 6 hour > (select max(processed_at) from index_log) then 'leased'
             when g.done_token = g.token then 'done' else 'pending' end as state, g.done_token, g.fenced
    from g join f on g.source_id = f.source_id and g.token = f.token"""
ORACLE = {"p5_leases": _LEASES, "p5_found": f"select source_id from ({_DUE})", "p5_due": _DUE}
