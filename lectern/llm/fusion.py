"""One ranking from several differently-scaled scores: reciprocal rank fusion.

Every item is ranked separately under each score; an item's total is the sum of
1 / (k + rank) over its scores, so only order matters, never range.

Ranks are counted without sorting a whole query in one task: equal scores fall
together before the shuffle, distinct values are put into buckets by the leading
bits of the number (an order-preserving integer), buckets are summed per query,
and only the values within a bucket are sorted.

Defined results
---------------
null and NaN: not scored, no part in that ranking; an item's repeated and
partial rows: one item, its best value under each score; ties: the same rank
(one plus the number of better items); equal totals: by id; null ids or queries:
dropped; infinities: ranked as such; an item without any score: total 0, after
all others; an empty table: an empty result; extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constant of the fusion: how fast the weight of a rank falls.
RRF_K = 60
#: Steps between two powers of two in a bucket number.
STEPS = 256


def order_key(c: Column) -> Column:
    """Buckets that rise with the number: by sign and binary magnitude."""
    mag = F.abs(c)
    exp = F.floor(F.log2(mag))
    exp = F.greatest(F.least(exp, F.lit(1024)), F.lit(-1074))
    frac = F.least(F.floor((mag / F.pow(F.lit(2.0), exp) - 1) * STEPS), F.lit(STEPS - 1))
    step = (exp + 1076) * STEPS + F.greatest(frac, F.lit(0)) + 1
    step = F.when(mag == float("inf"), F.lit(1 << 30)).when(mag == 0, F.lit(0)).otherwise(step)
    return F.when(c < 0, -step).otherwise(step).cast("bigint")


def best_scores(df: DataFrame, group: str, item: str, scores: dict[str, bool]) -> DataFrame:
    """One row per item with the best value under each score (``True``: larger
    is better); NaN counts as null."""
    clean = {s: F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")) for s in scores}
    d = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
    return d.groupBy(group, item).agg(*[(F.max(v) if scores[s] else F.min(v)).alias(s) for s, v in clean.items()])


def ranks(items: DataFrame, group: str, item: str, scores: dict[str, bool]) -> DataFrame:
    """(group, item, score, rank): 1 plus the number of items that are better."""
    long = items.select(group, item, F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in scores]), F.array(*[F.col(s) if up else -F.col(s) for s, up in scores.items()]))).alias("score", "value")).filter("value is not null")
    long = long.withColumn("value", F.col("value") + F.lit(0.0))
    by = [group, "score"]
    values = long.groupBy(*by, "value").agg(F.count("*").alias("n")).withColumn("bucket", order_key(F.col("value")))
    buckets = values.groupBy(*by, "bucket").agg(F.sum("n").alias("bn"))
    above = Window.partitionBy(*by).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*by, "bucket", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("before"))
    within = Window.partitionBy(*by, "bucket").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("better", F.coalesce(F.sum("n").over(within), F.lit(0)))
    values = values.join(buckets, [*by, "bucket"]).select(*by, "value", (F.col("before") + F.col("better") + 1).alias("rank"))
    return long.join(values, [*by, "value"]).select(group, item, "score", "rank")


def fuse(df: DataFrame, group: str, item: str, scores: dict[str, bool], k: int = RRF_K) -> DataFrame:
    """Every item with its total and its rank under each score
    (null where it has none)."""
    items = best_scores(df, group, item, scores)
    r = ranks(items, group, item, scores)
    named = {x: f"rank_{x.strip('_')}" for x in scores}
    per = r.groupBy(group, item).agg(F.sum(1 / (k + F.col("rank"))).alias("total"), *[F.max(F.when(F.col("score") == x, F.col("rank"))).alias(n) for x, n in named.items()])
    none = items.filter(F.coalesce(*scores).isNull()).select(group, item, F.lit(0.0).alias("total"), *[F.lit(None).cast("bigint").alias(n) for n in named.values()])
    return per.unionByName(none).withColumn("total", F.round("total", 12))


def ranking(fused: DataFrame, group: str, item: str) -> DataFrame:
    """``place`` of each item within its group, counted by the same buckets."""
    d = fused.withColumn("bucket", order_key(F.col("total")))
    buckets = d.groupBy(group, "bucket").agg(F.count("*").alias("bn"))
    above = Window.partitionBy(group).orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(group, "bucket", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("before"))
    within = Window.partitionBy(group, "bucket").orderBy(F.col("total").desc(), F.col(item))
    d = d.withColumn("_in", F.row_number().over(within)).join(buckets, [group, "bucket"])
    return d.withColumn("place", (F.col("before") + F.col("_in")).cast("bigint")).drop("bucket", "before", "_in")


def in_every_top(fused: DataFrame, scores: dict[str, bool], top: int = 10) -> DataFrame:
    """Items of a fusion whose rank is among the best ``top`` under every score."""
    keep = F.lit(True)
    for x in scores:
        keep = keep & (F.col(f"rank_{x.strip('_')}") <= top)
    return fused.filter(keep)
