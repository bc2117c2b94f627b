"""The work-item ledger: nothing skipped, nothing repeated."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.operators import ledger as L

T0 = datetime(2025, 1, 1)
SNAP = "item string, hash string, modified timestamp"


def now(minutes):
    return F.lit(T0 + timedelta(minutes=minutes)).cast("timestamp")


def items(df):
    return sorted(r["item"] for r in df.collect())


def test_claim_complete_and_change(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "led"), lease_seconds=600)
    snap = spark.createDataFrame([("a", "1", T0), ("b", None, None), ("c", "3", T0)], SNAP)
    got, token = led.claim(snap, now(0))
    assert items(got) == ["a", "b", "c"] and token == 1
    # leased to us: another claim gets nothing
    again, t2 = led.claim(snap, now(1))
    assert items(again) == [] and t2 == 2
    led.complete(got, now(2))
    assert items(led.pending(snap, now(3))) == []
    changed = spark.createDataFrame([("a", "2", T0), ("b", "", None), ("c", "3", T0 + timedelta(days=1)), ("d", "9", None)], SNAP)
    assert items(led.pending(changed, now(4))) == ["a", "c", "d"]


def test_expired_lease_and_stale_writer(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "led"), lease_seconds=60)
    snap = spark.createDataFrame([("a", "1", T0)], SNAP)
    first, t1 = led.claim(snap, now(0))
    second, t2 = led.claim(snap, now(5))  # the lease ran out
    assert items(second) == ["a"] and t2 > t1
    assert led.result_path(t1) != led.result_path(t2)
    led.complete(first, now(6))  # the stale writer comes late: rejected
    assert items(led.pending(snap, now(7)).filter("state = 'pending'")) == ["a"]
    led.complete(second, now(8))
    assert items(led.pending(snap, now(9))) == []


def test_results_count_once(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "led"), lease_seconds=60)
    snap = spark.createDataFrame([("a", "1", T0)], SNAP)
    first, t1 = led.claim(snap, now(0))
    first.select("item", "hash").write.mode("overwrite").parquet(led.result_path(t1))
    second, t2 = led.claim(snap, now(5))
    second.select("item", "hash").write.mode("overwrite").parquet(led.result_path(t2))
    second.select("item", "hash").write.mode("overwrite").parquet(led.result_path(t2))  # a retry
    led.complete(second, now(6))
    led.complete(first, now(7))
    assert led.results().count() == 1


CAT = "source_id string, modified_at string, annotation_hash string, year int"
LOG = "log_id bigint, run_id int, source_id string, status string, annotation_hash string, modified_at string, processed_at timestamp"
RUNS = "run_id int, started_at timestamp, finished_at timestamp, status string"


def test_from_log(spark):
    t = lambda d: datetime(2025, 1, d)
    cat = spark.createDataFrame(
        [
            ("same", "2024-01-01T00:00:00Z", "h", 1), ("same", "2024-01-01T00:00:00Z", "h", 1), ("new", None, None, 1), ("hash", "2024-01-01T00:00:00", "h2", 1),
            ("zone", "2024-01-01T02:00:00+02:00", "", 1), ("later", "2024-01-01T00:00:01+00:00", "h", 1), ("void", "x", "h", 1), ("unread", "yesterday", "h", 1), ("old", "2023-01-01", "o", 1), ("old", "2024-05-05 00:00:00+00:00", "n", 1), (None, None, None, 1),
        ],
        CAT,
    )
    log = spark.createDataFrame(
        [
            (1, 1, "same", "completed", "h", "2024-01-01T00:00:00+00:00", t(2)), (1, 1, "same", "completed", "h", "2024-01-01T00:00:00+00:00", t(2)), (2, 1, "hash", "completed", "h1", None, t(2)),
            (3, 3, "zone", "completed", None, "2024-01-01T00:00:00", t(2)), (4, 1, "later", "completed", "h", "2024-01-01T00:00:00", t(2)), (5, 2, "void", "completed", "h", "x", t(3)), (6, 1, "unread", "completed", "h", "2024-01-01", t(2)),
            (7, 1, "old", "completed", "n", "2024-05-05T00:00:00Z", t(2)), (8, 2, "old", "completed", "x", "2024-05-05T00:00:00Z", t(5)), (9, 1, "new", "failed", None, None, t(2)), (10, 1, "gone", "completed", "h", None, t(2)), (11, 1, "same", "failed", "z", None, t(9)),
        ],
        LOG,
    )
    runs = spark.createDataFrame([(1, t(1), t(2), "success"), (2, t(1), t(2), "rolled_back"), (3, t(1), None, "failed")], RUNS)
    due = L.due_documents(cat, log, runs)
    assert items(due) == ["hash", "later", "new", "void"]
    empty = L.due_documents(cat.limit(0), log, runs)
    assert empty.count() == 0
    assert L.due_documents(cat, log.limit(0), runs.limit(0)).count() == 8


def _write(led, got, token, word):
    got.select("item", F.lit(word).alias("text")).write.mode("overwrite").parquet(led.result_path(token))


def _results(led):
    return sorted((r["item"], r["token"], r["text"]) for r in led.results().select("item", "token", "text").collect())


def test_the_stale_writers_row_is_not_a_result(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "led"), lease_seconds=60)
    snap = spark.createDataFrame([("a", "1", T0)], SNAP)
    first, t1 = led.claim(snap, now(0))
    _write(led, first, t1, "stale")
    second, t2 = led.claim(snap, now(5))
    _write(led, second, t2, "good")
    led.complete(second, now(6))
    led.complete(first, now(7))
    assert _results(led) == [("a", t2, "good")]


def test_a_slow_clock_does_not_undo_the_fence(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "led"), lease_seconds=60)
    snap = spark.createDataFrame([("a", "1", T0)], SNAP)
    first, t1 = led.claim(snap, now(0))
    _write(led, first, t1, "stale")
    led.claim(snap, now(5))
    led.complete(first, now(1))  # its clock says that it came before the second claim
    state = L.fold(led.events(), now(5)).first()
    assert state["state"] == "leased" and state["done_token"] is None and state["fenced"] == 1
    assert _results(led) == []
    # a fast clock does no harm either: nobody claimed again
    other = L.Ledger(spark, str(tmp_path / "other"), lease_seconds=60)
    got, t = other.claim(snap, now(0))
    _write(other, got, t, "late")
    other.complete(got, now(999))
    assert _results(other) == [("a", t, "late")]


def test_two_claimers_get_different_tokens_and_items_once(spark, tmp_path, monkeypatch):
    one, two = (L.Ledger(spark, str(tmp_path / "led"), lease_seconds=600) for _ in range(2))
    snap = spark.createDataFrame([("a", "1", T0), ("b", "1", T0)], SNAP)
    put, met = one._put, []

    def late(number, entry):
        if not met:  # the other one comes in between reading and writing
            met.append(two.claim(snap, now(0)))
        return put(number, entry)

    monkeypatch.setattr(one, "_put", late)
    mine, t1 = one.claim(snap, now(0))
    theirs, t2 = met[0]
    assert t1 != t2 and items(mine) == [] and items(theirs) == ["a", "b"]
    assert not one._put(t1, {"kind": "claim", "set": "x"})  # the number is taken


def test_a_crash_between_writing_and_recording(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "led"), lease_seconds=60)
    snap = spark.createDataFrame([("a", "1", T0)], SNAP)
    first, t1 = led.claim(snap, now(0))
    _write(led, first, t1, "lost")  # written, never recorded
    assert _results(led) == []
    again, t2 = led.claim(snap, now(5))
    assert items(again) == ["a"]
    _write(led, again, t2, "kept")
    led.complete(again, now(6))
    led.complete(again, now(6))  # recorded twice
    assert _results(led) == [("a", t2, "kept")] and items(led.pending(snap, now(7))) == []


def test_compaction_and_void(spark, tmp_path):
    led = L.Ledger(spark, str(tmp_path / "led"), lease_seconds=60)
    snap = spark.createDataFrame([("a", "1", T0), ("b", "1", T0), (None, "1", T0)], SNAP)
    first, t1 = led.claim(snap, now(0))
    led.complete(first, now(0))
    newer = spark.createDataFrame([("a", "2", T0), ("b", "1", T0)], SNAP)
    second, t2 = led.claim(newer, now(1))
    third, t3 = led.claim(newer, now(9))
    key = lambda: sorted(tuple(r) for r in L.fold(led.events(), now(9)).select("item", "token", "state", "done_token", "done_hash").collect())
    before = key()
    led.compact()
    assert key() == before == [("a", t3, "leased", t1, "1"), ("b", t1, "done", t1, "1")]
    assert len(led._entries(led.top())) == 1
    led.complete(second, now(9))  # fenced, also across the compaction
    assert key() == before
    led.complete(third, now(9))
    assert items(led.pending(newer, now(9))) == []
    led.void(t3)
    assert items(led.pending(newer, now(99))) == ["a"]
