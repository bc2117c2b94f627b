"""Reading the library's tables and choosing the current rows in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The notations of an instant that are read; anything else is unreadable.
INSTANT = r"^\s*(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)\s*(Z|z|[+-]\d{2}:?\d{2})?\s*$"


def instant(c: Column) -> Column:
    """An ISO 8601 text as an instant; without a zone it means UTC; null, empty
    and unreadable texts become null."""
    day, clock, zone = (F.regexp_extract(c, INSTANT, i) for i in (1, 2, 3))
    zone = F.when(F.lower(zone).isin("", "z"), "+00:00").otherwise(zone)
    return F.when(c.rlike(INSTANT), F.try_to_timestamp(F.concat(day, F.lit(" "), clock, zone)))


def latest(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order. A key's versions are few,
    and Spark limits them to one per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def current_catalogue(df: DataFrame, *more: str) -> DataFrame:
    """Current row of each document: the latest ``modified_at`` instant; ties
    (exact repeats) fall together. Null ``source_id`` rows are no documents."""
    cols = [c for c in df.columns if c in {"source_id", "modified_at", *more}]
    d = df.select(*cols).filter(F.col("source_id").isNotNull()).withColumn("_at", instant(F.col("modified_at")))
    ties = [F.col(c).cast("string").desc_nulls_last() for c in cols if c != "source_id"]
    return latest(d, ["source_id"], [F.col("_at").desc_nulls_last(), *ties])


def current_chunks(df: DataFrame, *more: Column | str, keep: Column | None = None) -> DataFrame:
    """Current row of each chunk id: the latest ``indexed_at``. ``keep`` is
    computed before the shuffle, so wide columns can be nulled where unused."""
    d = df.filter(F.col("id").isNotNull()).select("id", instant(F.col("indexed_at")).alias("_at"), *more)
    rest = [c for c in d.columns if c not in ("id", "_at")]
    ties = [F.xxhash64(*rest).desc()] if rest else []
    return latest(d, ["id"], [F.col("_at").desc_nulls_last(), *ties]).drop("_at")


#: Columns of the chunk table and what stands for a missing value.
CHUNK_DEFAULTS = {
    "text": "", "book_id": "", "book_title": "", "author": "", "publisher": "", "year": 0, "calibre_id": 0, "source_id": "", "tags": "", "language": "", "chunk_index": 0,
    "chunk_type": "content", "page_number": 0, "page_label": "", "chapter": "", "section": "", "section_title": "", "section_type": "", "char_start": 0, "char_end": 0,
    "parent_id": "", "annotation_type": "", "annotation_source": "", "annotation_hash": "", "source_file": "", "format": "", "indexed_at": "", "metadata_hash": "", "pending_external": 0,
}


def conform(df: DataFrame) -> DataFrame:
    """Missing columns and null values get the table's defaults; further columns stay."""
    have = set(df.columns)
    out = {}
    for c, default in CHUNK_DEFAULTS.items():
        out[c] = F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    return df.withColumns(out)


def chunk_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current chunks with defaults. Columns that a query does not use are
    pruned from the scan and the shuffle."""
    c = load(spark, sf_dir, "chunks").filter(F.col("id").isNotNull())
    return conform(latest(c, ["id"], [F.col("indexed_at").desc_nulls_last()]))


def book_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current catalogue rows, one per document."""
    c = load(spark, sf_dir, "catalogue").filter(F.col("source_id").isNotNull()).withColumn("modified", instant(F.col("modified_at")))
    return latest(c, ["source_id"], [F.col("modified").desc_nulls_last()])
