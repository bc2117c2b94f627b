"""A stream run to its end gives what the batch gives."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern import streaming as S
from lectern.streaming.streams import events

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("events")
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i), None) for i in range(200)]
    spark.createDataFrame(rows[:100] + rows[90:100], SCHEMA).coalesce(1).write.mode("append").parquet(str(at))
    spark.createDataFrame(rows[100:], SCHEMA).coalesce(1).write.mode("append").parquet(str(at))
    return str(at)


def test_windows(spark, folder):
    got = S.run(S.window_counts(events(spark, folder)), "complete")
    b = spark.read.parquet(folder).groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").count()
    assert sorted((str(r["start"]), r["event_type"], r["n"]) for r in got.collect()) == sorted((str(r["w"]["start"]), r["event_type"], r["count"]) for r in b.collect())


def test_dedup_and_ingest(spark, folder, tmp_path):
    assert S.run(S.dedup(events(spark, folder), ["event_id"])).count() == 200
    for _ in range(2):  # the second call finds nothing new
        S.ingest(spark, folder, SCHEMA, str(tmp_path / "t"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 210


def test_upsert(spark, folder, tmp_path):
    S.upsert_stream(spark, folder, SCHEMA, str(tmp_path / "t"), str(tmp_path / "c"), "user_id", "ts")
    last = sorted((tmp_path / "t").glob("version=*"))[-1]
    assert sorted(r["event_id"] for r in spark.read.parquet(str(last)).collect()) == [197, 198, 199]


def test_signature_cache(spark, tmp_path):
    sch = "item string, mtime long, size long"
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], sch).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    st = S.signature_cache(spark.readStream.schema(sch).parquet(str(tmp_path / "in/*")))
    got = S.run(st, place=str(tmp_path / "p"))
    assert {r["item"]: r["changed"] for r in got.collect()} == {"a": True, "b": True}
    spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], sch).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    st = S.signature_cache(spark.readStream.schema(sch).parquet(str(tmp_path / "in/*")))
    got = S.run(st, place=str(tmp_path / "p"))
    assert {(r["item"], r["changed"]) for r in got.collect()} == {("a", True), ("b", True), ("a", False)}
