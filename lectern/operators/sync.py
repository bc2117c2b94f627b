"""Keeping a stored chunk table in step with a library.

Tables are immutable files, so a change is a new table: an upsert is an
anti-join and a union, a delete its complement, an update a projection. Keys
are compared null-safely nowhere: rows with null keys are never matched and
never lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, batch: DataFrame, key: str = "id", newest: str | None = None) -> DataFrame:
    """Batch rows replace target rows of the same key; of a batch's repeated
    keys the newest wins."""
    if newest:
        w = Window.partitionBy(key).orderBy(F.col(newest).desc_nulls_last())
        batch = batch.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return target.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch, allowMissingColumns=True)


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    return target.filter(~F.coalesce(condition, F.lit(False)))


def update_where(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns where the condition holds; columns the table lacks are left out."""
    have = set(target.columns)
    return target.withColumns({c: F.when(F.coalesce(condition, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items() if c in have})


def mark_pending(target: DataFrame, books: Sequence[str], value: int = 1) -> DataFrame:
    return update_where(target, F.col("book_id").isin(*books), {"pending_external": F.lit(value)})


def replace_book(target: DataFrame, batch: DataFrame, keep: Sequence[str] = ("annotation",)) -> DataFrame:
    """A book's new chunks in place of the old ones, of which the kept types stay."""
    books = batch.select("book_id").distinct()
    stay = target.filter(F.col("chunk_type").isin(*keep))
    gone = target.filter(~F.coalesce(F.col("chunk_type").isin(*keep), F.lit(False))).join(books, "book_id", "left_anti")
    return upsert(gone.unionByName(stay), batch)


def orphans(stored: DataFrame, library: DataFrame, key: str = "book_id") -> DataFrame:
    """Stored keys the library does not have; none if the library is empty,
    which means it could not be read."""
    some = library.limit(1).select(F.lit(1).alias("_one"))
    return stored.select(key).distinct().join(library.select(key).distinct(), key, "left_anti").join(F.broadcast(some)).drop("_one")


def snapshot_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(item, change) of stored (item, hash, annotation_hash, pending) against
    current (item, hash, annotation_hash): new, orphan, metadata_changed only
    against a stored hash that is not empty, annotations_changed, pending."""
    s = stored.select("item", F.col("hash").alias("h0"), F.col("annotation_hash").alias("a0"), F.col("pending").alias("p0"), F.lit(True).alias("_s"))
    c = current.select("item", F.col("hash").alias("h1"), F.col("annotation_hash").alias("a1"), F.lit(True).alias("_c"))
    e = lambda x: F.coalesce(F.col(x), F.lit(""))
    change = (
        F.when(F.col("_s").isNull(), "new")
        .when(F.col("_c").isNull(), "orphan")
        .when((e("h0") != "") & (e("h0") != e("h1")), "metadata_changed")
        .when(e("a0") != e("a1"), "annotations_changed")
        .when(F.col("p0") > 0, "fulltext_pending")
        .otherwise("unchanged")
    )
    return s.join(c, "item", "full_outer").select("item", change.alias("change"))


def decision(has_content: Column, has_stub: Column, changed: Column, force: bool = False, first_phase: bool = False) -> Column:
    """What an indexing run does with a document."""
    if first_phase:
        return F.when(has_content | has_stub, "skip").otherwise("stub")
    c = F.when(has_content & F.lit(force), "delete_and_full").when(has_content & changed, "metadata_only").when(has_content, "skip")
    return c.when(has_stub, "delete_and_full").otherwise("full")


def unchanged_signature(now: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose times and sizes are as cached keep the cached hash; the
    others must be hashed again (null)."""
    c = cache.select("item", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.col("hash").alias("_h"))
    same = (F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s"))
    return now.join(c, "item", "left").select("item", "mtime", "size", F.when(same, F.col("_h")).alias("hash"))


def layered(layers: Sequence[Column]) -> Column:
    """The first layer that says something (local, source, global, default)."""
    return F.coalesce(*layers)


def resume(all_items: DataFrame, done: DataFrame, most: int, order: Column, key: str = "item") -> DataFrame:
    """What is left of a run, cut to the next so many."""
    return all_items.join(done.select(key).distinct(), key, "left_anti").orderBy(order, key).limit(most)


def rename_tag(target: DataFrame, old: str, new: str, column: str = "tags") -> DataFrame:
    """A whole tag of a comma list gets another name."""
    parts = F.transform(F.split(F.col(column), ","), lambda x: F.trim(x))
    out = F.array_join(F.transform(parts, lambda t: F.when(t == old, F.lit(new)).otherwise(t)), ", ")
    return target.withColumn(column, F.when(F.col(column).contains(old), out).otherwise(F.col(column)))


def index_partitions(rows: Column) -> Column:
    """Lists of a vector index over so many rows; none below 256."""
    return F.when(rows >= 256, F.least(F.lit(256), F.greatest(F.lit(16), F.floor(F.sqrt(rows)))).cast("int"))


def annotation_rows(notes: DataFrame) -> DataFrame:
    """Rows for imported notes (book_id, source, code, highlight, note): empty
    ones dropped, numbered within book and source."""
    d = notes.filter((F.trim(F.coalesce("highlight", F.lit(""))) != "") | (F.trim(F.coalesce("note", F.lit(""))) != ""))
    w = Window.partitionBy("book_id", "source").orderBy("position", "highlight")
    d = d.withColumn("_i", F.row_number().over(w) - 1)
    body = F.concat(F.coalesce("highlight", F.lit("")), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" | Note: "), "note")).otherwise(""))
    return d.select(F.concat_ws("_", "source", "code", F.lit("note"), F.col("_i").cast("string")).alias("id"), "book_id", body.alias("text"), (-1000 - F.col("_i")).alias("chunk_index"))


def merge_metadata(catalogue: DataFrame, file: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The catalogue's values, filled from the file's; with the source of each record's first field."""
    f = file.select(key, *[F.col(c).alias(f"_f_{c}") for c in fields])
    d = catalogue.join(f, key, "left")
    pick = {c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.col(f"_f_{c}").cast("string")) for c in fields}
    origin = F.when(F.coalesce(F.col(fields[0]).cast("string"), F.lit("")) != "", "catalogue").when(F.col(f"_f_{fields[0]}").isNotNull(), "file")
    return d.select(key, origin.alias("origin"), *[v.alias(c) for c, v in pick.items()])
