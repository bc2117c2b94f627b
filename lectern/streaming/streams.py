"""Streams over files: ingest, upsert, windows, sessions, deduplication, cache.

Every stream reads a folder with a checkpoint in the shared folder, so a run
that broke off goes on where it stopped. Late rows are dropped after the
watermark. Results go to files, never to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.session import shared_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    s = spark.readStream.schema(schema).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run(stream: DataFrame, mode: str = "append", place: str | None = None) -> DataFrame:
    """Everything that is there now, once; the result is read back from files.
    ``complete`` replaces the result with every batch, ``append`` adds to it."""
    spark = stream.sparkSession
    place = place or _place(spark, "stream")
    out = f"{place}/out"

    def sink(batch: DataFrame, number: int) -> None:
        # one folder per batch number: a repeated batch overwrites itself
        to = out if mode == "complete" else f"{out}/batch={number:09d}"
        batch.write.mode("overwrite").parquet(to)

    stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    schema = stream.schema
    return spark.read.schema(schema).parquet(out if mode == "complete" else f"{out}/*")


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Append what is new in a folder to a table; called again it takes only
    files that came since."""

    def sink(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number:09d}")

    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, newest: str) -> None:
    """Fold new files into a table of one row per key. Each batch writes the
    next version beside the last one, so a repeated batch does no harm."""
    from lectern.operators.sync import upsert

    def sink(batch: DataFrame, number: int) -> None:
        if number == 0:
            old = batch.limit(0)
        else:
            old = spark.read.schema(batch.schema).parquet(f"{target}/version={number - 1:09d}")
        upsert(old, batch, key, newest).write.mode("overwrite").parquet(f"{target}/version={number:09d}")

    spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def window_counts(stream: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("w.start").alias("start"), "events")


def dedup(stream: DataFrame, keys: list[str], within: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def signature_cache(stream: DataFrame) -> DataFrame:
    """(item, mtime, size) in, (item, changed) out: whether a file's signature
    differs from the one seen last. The state is one signature per item."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: Any = state.get if state.exists else (None, None)
        changed = False
        for p in parts:
            for m, s in p.sort_values("mtime")[["mtime", "size"]].itertuples(index=False):
                changed |= (int(m), int(s)) != tuple(last)
                last = (int(m), int(s))
        state.update(tuple(last))
        yield pd.DataFrame({"item": [key[0]], "changed": [changed]})

    return stream.groupBy("item").applyInPandasWithState(step, "item string, changed boolean", "mtime long, size long", "append", GroupStateTimeout.NoTimeout)
