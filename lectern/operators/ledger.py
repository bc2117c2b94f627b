"""Processing only new or changed records: a work-item ledger.

Every record is a work item. Its ledger line is ``pending``, ``leased`` or
``done``; a lease carries a fencing token that grows with every claim, an
expired lease counts as pending again, and a finished attempt counts only if no
higher token had been claimed for the item when it was recorded. The results of
a lease are written under a path made of the token, so a retry overwrites
itself and a stale writer writes elsewhere.

The ledger is a log of numbered entries, each put in place by one atomic step
that fails where the number is taken (a hard link, or a rename that does not
overwrite). An entry names a folder of events (``claim``, ``done``, ``void``).
The number is the order of events and a claim's number is its token: no clock
decides what is stale, and two claimers cannot bear the same token, as one of
them finds its number taken, reads again and claims what is left. Clocks only
decide when a lease is over, which can cost work twice but not a result.

The state is a fold over the events with one shuffle on the item key, partially
aggregated before it; ``compact`` replaces the events so far by the few of each
item that still matter. No state is kept on the driver, only the log's names.

Defined results
---------------
null item keys: no work item, dropped; null and empty hash: equal ("no
annotations"); null or unreadable times: the hash alone decides; repeated
events and records: count once; an empty ledger: everything is pending; an
empty snapshot: nothing is pending; a void token whose predecessor was
compacted away: pending; extra columns: ignored.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.tables import current_catalogue, instant

EVENTS = "item string, token bigint, kind string, seq bigint, at timestamp, until timestamp, hash string, modified timestamp"
_STORED = [f.split()[0] for f in EVENTS.split(", ")]


def tokens(events: DataFrame) -> DataFrame:
    """A row for each token of each item: when it was claimed, its lease, its
    done event, and whether that event is ``valid`` (neither void nor fenced by
    a higher token that was claimed before it)."""
    e = events.filter(F.col("item").isNotNull())
    t = e.groupBy("item", "token").agg(
        F.min(F.when(F.col("kind") == "claim", F.col("seq"))).alias("claimed"),
        F.max(F.when(F.col("kind") == "claim", F.col("until"))).alias("until"),
        F.max(F.when(F.col("kind") == "done", F.struct("seq", "at", "hash", "modified"))).alias("done"),
        F.max((F.col("kind") == "void").cast("int")).alias("void"),
    )
    higher = Window.partitionBy("item").orderBy(F.col("token").desc()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("fence", F.min("claimed").over(higher))
    fenced = F.col("done").isNotNull() & F.coalesce(F.col("fence") < F.col("done.seq"), F.lit(False))
    return t.withColumn("fenced", fenced).withColumn("valid", F.col("done").isNotNull() & (F.col("void") == 0) & ~fenced)


def fold(events: DataFrame, now: Column) -> DataFrame:
    """State of every item from its events.

    ``token`` is the highest token claimed so far (the fence), ``state`` is
    done, leased or pending, ``done_token`` the token whose result stands. The
    version seen by it stays known while the item is worked on again.
    """
    s = tokens(events).groupBy("item").agg(
        F.max(F.struct("token", "until", F.col("done").isNotNull().alias("done"), "valid", "void")).alias("last"),
        F.max(F.when(F.col("valid"), F.struct("token", "done"))).alias("won"),
        F.sum(F.col("fenced").cast("int")).alias("fenced"),
    )
    leased = ~F.col("last.done") & (F.col("last.void") == 0) & (F.col("last.until") > now)
    return s.select(
        "item",
        F.col("last.token").alias("token"),
        F.when(leased, "leased").when(F.col("last.valid"), "done").otherwise("pending").alias("state"),
        F.col("won.token").alias("done_token"),
        F.col("won.done.at").alias("done_at"),
        F.col("won.done.hash").alias("done_hash"),
        F.col("won.done.modified").alias("done_modified"),
        "fenced",
    )


def stale(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Items of the snapshot (item, hash, modified) that must be processed: no
    valid done event; another hash; or a later modification. Leased items are
    given with ``state`` so that the caller may leave them out."""
    s = snapshot.join(state, "item", "left")
    changed = (F.coalesce("hash", F.lit("")) != F.coalesce("done_hash", F.lit(""))) | F.coalesce(F.col("modified") > F.col("done_modified"), F.lit(False))
    never = F.col("done_token").isNull()
    return s.filter(never | changed).select("item", "hash", "modified", F.coalesce("token", F.lit(0).cast("bigint")).alias("token"), F.coalesce("state", F.lit("pending")).alias("state"), F.when(never, "new").otherwise("changed").alias("reason"))


class Ledger:
    """The ledger under a shared folder whose file system renames atomically
    without overwriting (local, HDFS). Any number of drivers may claim, complete
    and compact at once."""

    def __init__(self, spark: SparkSession, path: str, lease_seconds: int = 3600):
        self.spark, self.path, self.lease = spark, path.rstrip("/"), lease_seconds
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # ---- the log ----
    def _numbers(self) -> list[int]:
        log = self._at("log")
        if not self._fs.exists(log):
            return []
        return sorted(int(n) for f in self._fs.listStatus(log) if (n := f.getPath().getName()).isdigit())

    def _entries(self, upto: int) -> list[tuple[int, dict]]:
        """The entries back to the last compaction, oldest first."""
        out = []
        for n in reversed([n for n in self._numbers() if n <= upto]):
            stream = self._fs.open(self._at(f"log/{n:012d}"))
            try:
                entry = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            out.append((n, entry))
            if entry["kind"] == "compact":
                break
        return out[::-1]

    def _put(self, number: int, entry: dict) -> bool:
        """Put an entry in place, whole and at once; False if the number is taken."""
        made, place = f"log/_{uuid.uuid4().hex}", f"log/{number:012d}"
        stream = self._fs.create(self._at(made), False)
        stream.write(json.dumps(entry).encode())
        stream.close()
        try:
            if self._fs.getScheme() == "file":  # a local rename would overwrite
                root = urlparse(self.path).path
                try:
                    os.link(f"{root}/{made}", f"{root}/{place}")
                except FileExistsError:
                    return False
                return True
            return bool(self._fs.rename(self._at(made), self._at(place)))
        finally:
            self._fs.delete(self._at(made), False)

    def top(self) -> int:
        return max(self._numbers(), default=0)

    def _store(self, e: DataFrame) -> str:
        """Write events into a folder that no entry names yet."""
        name = f"events/set={uuid.uuid4().hex}"
        missing = [c for c in _STORED if c not in e.columns]
        types = dict(f.split() for f in EVENTS.split(", "))
        e.select(*[F.lit(None).cast(types[c]).alias(c) if c in missing else F.col(c).cast(types[c]).alias(c) for c in _STORED]).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return name

    def _append(self, kind: str, e: DataFrame) -> int:
        name = self._store(e)
        while True:
            n = self.top() + 1
            if self._put(n, {"kind": kind, "set": name}):
                return n

    def events(self, upto: int | None = None) -> DataFrame:
        """All events up to an entry, each with the number of its entry."""
        entries = self._entries(self.top() if upto is None else upto)
        if not entries:
            return self.spark.createDataFrame([], EVENTS)
        named = self.spark.createDataFrame([(e["set"].split("=")[1], n, e["kind"] == "compact") for n, e in entries], "set string, number bigint, kept boolean")
        d = self.spark.read.schema(EVENTS + ", set string").option("basePath", f"{self.path}/events").parquet(*[f"{self.path}/{e['set']}" for _, e in entries])
        d = d.join(F.broadcast(named), "set")  # one row for each entry since the last compaction
        seq = F.when(F.col("kept"), F.col("seq")).otherwise(F.col("number"))
        return d.withColumn("seq", seq).withColumn("token", F.coalesce("token", "seq")).select(*_STORED)

    # ---- the verbs ----
    def claim(self, snapshot: DataFrame, now: Column | None = None) -> tuple[DataFrame, int]:
        """Lease every item that must be processed and is not leased to someone
        else. Returns the claimed items and the batch's fencing token, which is
        above every token in the ledger. Whoever finds that another entry came
        first looks again, so no item is leased twice at once."""
        now = F.current_timestamp() if now is None else now
        while True:
            base = self.top()
            todo = stale(fold(self.events(base), now), snapshot).filter("state <> 'leased'")
            until = now + F.make_interval(secs=F.lit(self.lease))
            name = self._store(todo.select("item", F.lit("claim").alias("kind"), now.alias("at"), until.alias("until"), "hash", "modified"))
            if self._put(base + 1, {"kind": "claim", "set": name}):
                token = base + 1
                got = self.spark.read.schema(EVENTS).parquet(f"{self.path}/{name}")
                return got.select("item", "hash", "modified", F.lit(token).cast("bigint").alias("token")), token
            self._fs.delete(self._at(name), True)

    def result_path(self, token: int) -> str:
        """Where the batch of a token writes; a retry overwrites the same place."""
        return f"{self.path}/results/token={token:012d}"

    def complete(self, claimed: DataFrame, now: Column | None = None) -> int:
        """Record the batch as done. Events of a stale writer (a token below the
        item's fence) are stored and rejected by the fold, whatever its clock says."""
        now = F.current_timestamp() if now is None else now
        return self._append("done", claimed.select("item", "token", F.lit("done").alias("kind"), now.alias("at"), "hash", "modified"))

    def void(self, token: int) -> int:
        """Withdraw a batch: none of its items counts as done by it."""
        return self._append("void", self.events().filter((F.col("token") == token) & (F.col("kind") == "claim")).select("item", "token", F.lit("void").alias("kind")))

    def results(self) -> DataFrame:
        """Results of items whose done event is valid, each item once: the rows
        written under the token that won, never those of a rejected one."""
        won = fold(self.events(), F.current_timestamp()).filter("done_token is not null").select("item", F.col("done_token").alias("token"))
        return self.spark.read.parquet(f"{self.path}/results").join(won, ["item", "token"], "left_semi")

    def pending(self, snapshot: DataFrame, now: Column | None = None) -> DataFrame:
        return stale(fold(self.events(), F.current_timestamp() if now is None else now), snapshot)

    def compact(self) -> int:
        """Replace the events so far by those that still matter: of each item
        its highest token (claim, done, void) and the one whose result stands.
        Fails softly: if another entry came first, it looks again."""
        while True:
            base = self.top()
            e = self.events(base)
            keep = fold(e, F.current_timestamp()).select("item", F.explode(F.array_distinct(F.array_compact(F.array("token", "done_token")))).alias("token"))
            name = self._store(e.join(keep, ["item", "token"], "left_semi").dropDuplicates())
            if self._put(base + 1, {"kind": "compact", "set": name}):
                return base + 1
            self._fs.delete(self._at(name), True)


def ledger_from_log(log: DataFrame, runs: DataFrame) -> DataFrame:
    """The ledger's events as an existing run log tells them: an entry is the
    claim of its attempt, a ``completed`` entry also its done event, and every
    entry of a rolled-back run is void. An attempt's token is its place in
    time (and the run's number where two fall together), so of two attempts the
    later is the fence of the earlier."""
    entry = log.filter(F.col("source_id").isNotNull()).select("log_id", "run_id", "source_id", "status", "annotation_hash", "modified_at", "processed_at").dropDuplicates(["log_id", "source_id"])
    rolled = runs.filter("status = 'rolled_back'").select("run_id").distinct().withColumn("rolled", F.lit(True))
    e = entry.join(rolled, "run_id", "left").select(
        F.col("source_id").alias("item"),
        (F.coalesce(F.unix_micros(F.col("processed_at").cast("timestamp")), F.lit(-1)) * 4096 + F.pmod(F.coalesce("run_id", F.lit(0)), F.lit(4096))).alias("token"),
        F.explode(F.expr("case when rolled then array('void') when status = 'completed' then array('claim', 'done') else array('claim') end")).alias("kind"),
        F.col("processed_at").cast("timestamp").alias("at"),
        F.col("processed_at").cast("timestamp").alias("until"),
        F.col("annotation_hash").alias("hash"),
        instant(F.col("modified_at")).alias("modified"),
    )
    return e.withColumn("seq", F.col("token"))


def leases_from_log(log: DataFrame, runs: DataFrame, lease_seconds: int = 6 * 3600) -> DataFrame:
    """The same log read as leases: a run claims its documents when it starts
    (its token is its place among the runs), for so many seconds; an entry is
    recorded when it was processed, so one that is written after a later run had
    claimed the document is fenced; entries of a rolled-back run are void."""
    # a few rows: one for each run
    r = runs.filter(F.col("run_id").isNotNull() & F.col("started_at").isNotNull()).groupBy("run_id").agg(F.min("started_at").cast("timestamp").alias("started"), F.max((F.col("status") == "rolled_back").cast("int")).alias("rolled"))
    r = r.withColumn("token", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("started", "run_id")).cast("bigint"))
    entry = log.filter(F.col("source_id").isNotNull() & F.col("processed_at").isNotNull()).select("log_id", "run_id", "source_id", "status", "annotation_hash", "modified_at", "processed_at").dropDuplicates(["log_id", "source_id"])
    e = entry.join(F.broadcast(r), "run_id")
    at = F.col("processed_at").cast("timestamp")
    claim = F.struct(F.lit("claim").alias("kind"), F.unix_micros("started").alias("seq"), F.col("started").alias("at"))
    done = F.struct(F.lit("done").alias("kind"), F.unix_micros(at).alias("seq"), at.alias("at"))
    void = F.struct(F.lit("void").alias("kind"), F.unix_micros(at).alias("seq"), at.alias("at"))
    x = F.explode(F.array_compact(F.array(claim, F.when(F.col("status") == "completed", done), F.when(F.col("rolled") == 1, void)))).alias("x")
    e = e.select(F.col("source_id").alias("item"), "token", (F.col("started") + F.make_interval(secs=F.lit(lease_seconds))).alias("until"), F.col("annotation_hash").alias("hash"), instant(F.col("modified_at")).alias("modified"), x)
    return e.select("item", "token", "x.kind", "x.seq", "x.at", "until", "hash", "modified")


def catalogue_snapshot(catalogue: DataFrame) -> DataFrame:
    """The catalogue's current rows as work items."""
    return current_catalogue(catalogue, "annotation_hash").select(F.col("source_id").alias("item"), F.col("annotation_hash").alias("hash"), F.col("_at").alias("modified"))


def due_documents(catalogue: DataFrame, log: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents that must be processed, with the reason and the state."""
    state = fold(ledger_from_log(log, runs), F.current_timestamp())
    return stale(state, catalogue_snapshot(catalogue))
