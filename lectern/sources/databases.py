"""Library databases: SQLite files through the Python data source API, and the
two library layouts (linked tables, and entity-attribute-value) as joins."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 50_000


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path, self.table = schema, options["path"], options["table"]

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True, timeout=30)

    def partitions(self) -> list[InputPartition]:
        with self._open() as c:
            lo, hi = c.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        return [_Range(a, min(a + ROWS, hi + 1)) for a in range(lo, hi + 1, ROWS)] if lo is not None else [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        cols = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        with self._open() as c:
            yield from c.execute(f'select {cols} from "{self.table}" where rowid >= ? and rowid < ?', (part.lo, part.hi))


class SQLite(DataSource):
    """``spark.read.format("sqlite").option("path", ...).option("table", ...).schema(...)``;
    read only, in ranges of row ids. The file must be reachable by the executors."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            cols = c.execute(f'pragma table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{n}` {kinds.get((t or '').upper().split('(')[0], 'string')}" for _, n, t, *_ in cols)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, self.options)


def read_table(spark: SparkSession, path: str, table: str, schema: str | None = None) -> DataFrame:
    spark.dataSource.register(SQLite)
    r = spark.read.format("sqlite").option("path", path).option("table", table)
    return (r.schema(schema) if schema else r).load()


def linked(books: DataFrame, **relations: DataFrame) -> DataFrame:
    """Books with their relations (book, value[, position]) as sorted arrays."""
    out = books
    for name, r in relations.items():
        key = F.struct("position", "value") if "position" in r.columns else F.struct("value")
        g = r.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["value"]).alias(name))
        out = out.join(g.withColumnRenamed("book", "id"), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def select_by_tags(books: DataFrame, wanted: str | None = None, excluded: str | None = None, tags: str = "tags") -> DataFrame:
    """Exact, case-sensitive."""
    d = books.filter(F.array_contains(tags, wanted)) if wanted else books
    return d.filter(~F.array_contains(tags, excluded)) if excluded else d


def fields(values: DataFrame, names: list[str]) -> DataFrame:
    """Entity-attribute-value rows (item, field, value) as one row per item."""
    return values.filter(F.col("field").isin(*names)).groupBy("item").pivot("field", names).agg(F.first("value", ignorenulls=True))


def creators(rows: DataFrame) -> DataFrame:
    """(item, creators): authors in order, or editors where there is no author."""
    of = lambda kind: F.transform(F.array_sort(F.filter("c", lambda x: x["kind"] == kind)), lambda x: x["name"])
    g = rows.groupBy("item").agg(F.collect_list(F.struct("position", "name", "kind")).alias("c"))
    return g.select("item", F.when(F.size(of("author")) > 0, of("author")).otherwise(of("editor")).alias("creators"))


def descendants(tree: DataFrame, root: str) -> DataFrame:
    """Ids below a node (id, parent), the node itself included; a ring ends
    where it comes back."""
    spark = tree.sparkSession
    tree.createOrReplaceTempView("_lectern_tree")
    return spark.sql(
        """with recursive d(id, path) as (select id, array(id) from _lectern_tree where id = :root
           union all select t.id, array_append(d.path, t.id) from _lectern_tree t join d on t.parent = d.id where not array_contains(d.path, t.id))
           select distinct id from d""",
        {"root": root},
    )


def best_attachment(files: DataFrame) -> DataFrame:
    """Of an item's attachments (item, path, kind, deleted) the best kind."""
    rank = F.when(F.col("kind") == "pdf", 10).when(F.col("kind") == "epub", 8).when(F.col("kind") == "html", 3).when(F.col("kind") == "txt", 2).otherwise(0)
    w = Window.partitionBy("item").orderBy(rank.desc(), "path")
    d = files.filter(~F.coalesce("deleted", F.lit(False)) & (rank > 0)).withColumn("_r", F.row_number().over(w))
    return d.filter("_r = 1").select("item", "path", "kind")


def not_deleted(items: DataFrame, deleted: DataFrame) -> DataFrame:
    return items.join(deleted.select("item"), "item", "left_anti")


def custom_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """Side tables (book, value) by name, as one map per book."""
    parts = [t.select("book", F.lit(n).alias("name"), F.col("value").cast("string").alias("value")) for n, t in sorted(tables.items())]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    d = d.filter("value is not null and value <> ''").groupBy("book", "name").agg(F.min("value").alias("value"))
    return d.groupBy("book").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("custom"))
