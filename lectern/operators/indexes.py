"""Stored search indexes: postings by term and vectors by list.

A search reads what it needs and no more: the buckets of its terms, the lists
nearest to its vector. Both indexes are folders of Parquet files under a shared
path; what is added later lies beside the rest under a higher version, and of a
row's versions only the latest counts.

Defined results
---------------
null ids: not indexed; null and empty texts: counted among the rows, without
postings; rows without a usable vector: in no list; a row added again: its last
version; repeated rows of one call: one; unknown terms: no rows; an empty table:
an empty index; extra columns: ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.session import shuffle_width, table_bytes

K1, B = 1.2, 0.75


class _Stored:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _version(self) -> int:
        if not table_bytes(f"{self.path}/rows", self.spark):
            return 0
        return int(self._read("rows").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0])

    def _latest(self) -> DataFrame:
        """(id, version, len) of every row's last version, partially aggregated."""
        return self._read("rows").groupBy("id").agg(F.max_by(F.struct("version", "len"), "version").alias("r")).select("id", "r.version", "r.len")


class KeywordIndex(_Stored):
    """Postings (term, id, tf) in buckets of terms. A bucket's rows are spread
    over files by id as well, so a term of a third of all rows is many files."""

    def add(self, chunks: DataFrame, text: str = "text", buckets: int = 64, spread: int = 16) -> KeywordIndex:
        v = self._version() + 1
        d = chunks.filter("id is not null").select(F.col("id").cast("string").alias("id"), tx.tokens(F.col(text)).alias("t")).dropDuplicates(["id"])
        d.select("id", F.lit(v).cast("bigint").alias("version"), F.size("t").alias("len")).write.mode("append").parquet(f"{self.path}/rows")
        p = d.select("id", F.explode("t").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
        p = p.select("term", "id", "tf", F.lit(v).cast("bigint").alias("version"), F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
        p = p.repartition(max(shuffle_width(self.spark), buckets), "bucket", F.pmod(F.xxhash64("id"), F.lit(spread))).sortWithinPartitions("bucket", "term")
        p.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        n = self._latest().agg(F.count("*").alias("n"), F.avg("len").alias("average")).withColumn("buckets", F.lit(buckets))
        n.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts")
        return self

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """The current postings of some terms; only their buckets are read."""
        at = self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.xxhash64("term").alias("h")).collect()
        buckets = self._read("counts").first()["buckets"]
        p = self._read("postings").filter(F.col("bucket").isin(sorted({r["h"] % buckets for r in at})) & F.col("term").isin(list(terms)))
        return p.join(self._latest(), ["id", "version"]).select("term", "id", "tf", "len")

    def search(self, query: str, k: int, within: DataFrame | None = None) -> DataFrame:
        """(id, score, rank): BM25 over the stored postings. Counts are over all
        rows; ``within`` (ids) filters the candidates before the best k are taken."""
        terms = sorted({t for t in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
        if not terms or not table_bytes(f"{self.path}/postings", self.spark):
            return self.spark.createDataFrame([], "id string, score double, rank int")
        p = self.postings(terms)
        df = p.groupBy("term").agg(F.count("*").alias("df"))  # one row a term
        p = p.join(F.broadcast(df), "term").join(F.broadcast(self._read("counts")))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("average")))
        if within is not None:
            p = p.join(within.select("id").distinct(), "id", "left_semi")
        s = p.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
        # the k best come together in one task, never more
        top = s.orderBy(F.col("score").desc(), "id").limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))


class VectorIndex(_Stored):
    """Vectors by the nearest of a number of centres, which are fitted on a
    bounded sample when the index is begun and kept with it."""

    def add(self, chunks: DataFrame, vector: str = "vector", dimension: int = 64, lists: int | None = None, sample: int = 16_384) -> VectorIndex:
        v = self._version() + 1
        x = F.col(vector)
        ok = (F.size(x) == dimension) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(x, lambda e: e != 0)
        d = chunks.filter(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), F.when(F.coalesce(ok, F.lit(False)), x.cast("array<float>")).alias("vector")).dropDuplicates(["id"])
        d.select("id", F.lit(v).cast("bigint").alias("version"), F.lit(0).alias("len")).write.mode("append").parquet(f"{self.path}/rows")
        d = d.filter("vector is not null")
        if not len(self.centres()):
            n = d.count()
            rows = d.withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 33)).filter(F.col("h") < int(2**31 * min(1.0, 1.1 * sample / max(n, 1)))).orderBy("h").limit(sample).select("vector").collect()
            if not rows:
                return self
            c = _centres(np.array([r[0] for r in rows], dtype=np.float32).reshape(len(rows), dimension), lists or max(1, int(math.sqrt(n))))
            self.spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], "list int, centre array<float>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        shared = self.spark.sparkContext.broadcast(self.centres())  # at most as many as the sample

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = np.stack(b.column(1).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, dimension), np.float32)
                own = np.argmax(_unit(m) @ shared.value.T, axis=1) if len(m) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=["id", "vector", "list"])

        out = d.mapInArrow(run, "id string, vector array<float>, list int").withColumn("version", F.lit(v).cast("bigint"))
        out = out.repartition(shuffle_width(self.spark), "list", F.pmod(F.xxhash64("id"), F.lit(8)))
        out.write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")
        return self

    def centres(self) -> np.ndarray:
        if not table_bytes(f"{self.path}/centres", self.spark):
            return np.zeros((0, 1), np.float32)
        rows = sorted(self._read("centres").collect())
        return np.array([r["centre"] for r in rows], dtype=np.float32).reshape(len(rows), -1 if rows else 1)

    def search(self, query: Sequence[float], k: int, probes: int = 8) -> DataFrame:
        """(id, score, rank): the k most similar rows of the nearest lists; only those are read."""
        c = self.centres()
        if not len(c) or not table_bytes(f"{self.path}/lists", self.spark):
            return self.spark.createDataFrame([], "id string, score double, rank int")
        q = np.array(query, dtype=np.float64)
        near = np.argsort(-(c @ _unit(q[None, :].astype(np.float32))[0]), kind="stable")[:probes]
        d = self._read("lists").filter(F.col("list").isin([int(i) for i in near])).join(self._latest(), ["id", "version"])
        w = F.array(*[F.lit(float(x)) for x in q])
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        score = dot(F.col("vector"), w) / (F.sqrt(dot(F.col("vector"), F.col("vector"))) * float(np.linalg.norm(q)))
        top = d.select("id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of a sample on the sphere."""
    x = _unit(x)
    if not len(x):
        return x
    c = x[np.random.default_rng(3).choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for i in np.unique(own):
            c[i] = x[own == i].sum(axis=0)
        c = _unit(c)
    return c
