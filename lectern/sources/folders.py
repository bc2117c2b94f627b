"""Folders and vaults of files as document rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.sources.registry import EXTENSIONS, file_format

#: Folders that are never read.
IGNORED = [".git", ".obsidian", ".trash", "node_modules", "__pycache__"]


def files(spark: SparkSession, root: str, extensions: Sequence[str] = tuple(EXTENSIONS), excluded: Sequence[str] = ()) -> DataFrame:
    """(path, modified, size, content) of the readable files below a folder. The
    content is read only where a query asks for it."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    d = d.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions))
    for name in IGNORED:
        d = d.filter(~F.col("path").contains(f"/{name}/"))
    for glob in excluded:
        like = "".join(".*" if c == "*" else "." if c == "?" else tx.escape(c) for c in glob)
        d = d.filter(~F.regexp_extract("path", r"([^/]+)$", 1).rlike(f"^{like}$"))
    return d.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where it is valid, else Latin-1; line ends and the
    byte order mark made even."""
    utf = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    t = F.coalesce(utf, F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(F.regexp_replace(t, "^﻿", ""), "\r\n?", "\n")


def named(path: Column) -> list[Column]:
    """Fields that a file's name gives: date_platform_topic or id_author_title."""
    stem = F.regexp_extract(path, r"([^/]+?)\.[^./]+$", 1)
    parts = F.split(stem, "_")
    dated = stem.rlike(r"^\d{4}-\d{2}-\d{2}_")
    return [
        stem.alias("stem"),
        F.when(dated, F.try_element_at(parts, F.lit(1)).try_cast("date")).alias("day"),
        F.when((F.size(parts) >= 3) & ~dated, F.replace(F.try_element_at(parts, F.lit(2)), F.lit("-"), F.lit(" "))).alias("author"),
        F.when(F.size(parts) >= 3, F.replace(F.array_join(F.slice(parts, 3, 100), " "), F.lit("-"), F.lit(" "))).otherwise(stem).alias("title"),
    ]


def documents(spark: SparkSession, root: str, **kw) -> DataFrame:
    """One row per file: stable id, format, names, text of the plain formats. A
    sidecar ``name.meta.json`` beside the file goes before its name."""
    d = files(spark, root, **kw)
    fmt = file_format(F.col("path"), F.col("content"))
    d = d.select("path", "modified", "size", tx.stable_id(F.col("path")).alias("doc_id"), fmt.alias("format"), *named(F.col("path")), F.when(fmt.isin("txt", "md", "rst"), decoded(F.col("content"))).alias("text"))
    side = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json").load(root)
    s = F.from_json(side["content"].cast("string"), "title string, author string, tags array<string>")
    side = side.select(F.regexp_replace("path", r"\.meta\.json$", "").alias("_base"), s.alias("_m"))
    d = d.withColumn("_base", F.regexp_replace("path", r"\.[^./]+$", "")).join(side, "_base", "left").drop("_base")
    return d.withColumns({"title": F.coalesce("_m.title", "title"), "author": F.coalesce("_m.author", "author"), "tags": F.coalesce("_m.tags", F.array().cast("array<string>"))}).drop("_m")


def front_matter(text: Column) -> Column:
    """The fields between the first two lines of dashes, as a map."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[\w -]+:\s*\S"))
    key = lambda x: F.regexp_replace(F.lower(F.trim(F.substring_index(x, ":", 1))), " ", "_")
    val = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]+:", "")), r"^[\"']|[\"']$", "")
    pairs = F.transform(lines, lambda x: F.struct(key(x).alias("key"), val(x).alias("value")))
    # of a repeated field the first counts
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(pairs, lambda p: p["key"] == k)[0]["value"]))


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")


def notes(spark: SparkSession, root: str) -> DataFrame:
    """A vault: documents with front matter, tags, links and a first paragraph."""
    d = documents(spark, root, extensions=("md",))
    fm, b = front_matter(F.col("text")), body(F.col("text"))
    own = F.transform(F.split(F.regexp_replace(F.coalesce(F.try_element_at(F.col("fm"), F.lit("tags")), F.lit("")), r"[\[\]\"']", ""), ","), lambda x: F.trim(x))
    first = F.try_element_at(F.filter(F.split(F.col("body"), r"\n\s*\n"), lambda p: ~F.ltrim(p).startswith("#") & (F.trim(p) != "")), F.lit(1))
    d = d.withColumn("fm", fm).withColumn("body", b)
    return d.select(
        "path", "doc_id", "modified", F.coalesce(F.try_element_at(F.col("fm"), F.lit("title")), "title").alias("title"), F.coalesce(F.try_element_at(F.col("fm"), F.lit("author")), "author").alias("author"),
        F.array_distinct(F.concat(F.filter(own, lambda x: x != ""), tx.inline_tags(F.col("body")))).alias("tags"), tx.wikilinks(F.col("body")).alias("links"), F.trim(first).alias("comment"), "body",
        F.coalesce(F.try_element_at(F.col("fm"), F.lit("chunking_strategy")), F.lit("paragraph")).alias("strategy"),
    )


def changed_since(docs: DataFrame, cutoff: str | None) -> DataFrame:
    """Documents modified after the cutoff; without a readable time, or with an
    unreadable cutoff, all."""
    t = F.try_to_timestamp(F.lit(cutoff))
    return docs.filter(F.col("modified").isNull() | t.isNull() | (F.col("modified") > t))
