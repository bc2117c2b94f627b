"""Which reader reads what."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic bytes of formats, as hexadecimal beginnings.
MAGIC = {"25504446": "pdf", "504B0304": "zip", "7B5C727466": "rtf", "424F4F4B4D4F4249": "mobi", "D0CF11E0": "doc", "41542654464F524D": "djvu"}
#: Extensions and the extractor that reads them, best quality first.
EXTENSIONS = {"txt": "text", "md": "text", "rst": "text", "html": "html", "htm": "html", "xhtml": "html", "epub": "epub", "pdf": "pdf"}


class Registry:
    """Named things with a quality; the best that fits wins, the first on ties."""

    def __init__(self) -> None:
        self.items: list[tuple[str, float, Callable[[Any], bool], Any]] = []

    def add(self, name: str, fits: Callable[[Any], bool], thing: Any, quality: float = 1.0) -> None:
        self.items.append((name, quality, fits, thing))

    def find(self, what: Any) -> tuple[str, Any] | None:
        best = None
        for name, quality, fits, thing in self.items:
            if fits(what) and (best is None or quality > best[0]):
                best = (quality, name, thing)
        return best and best[1:]

    def names(self) -> list[str]:
        return [n for n, *_ in self.items]


def source_kind(spark: SparkSession, root: str) -> str:
    """What a library folder is, by the file that marks it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, kind in (("metadata.db", "catalogue_db"), ("zotero.sqlite", "reference_db"), (".obsidian", "vault")):
        if fs.exists(jvm.org.apache.hadoop.fs.Path(p, name)):
            return kind
    return "folder"


def file_format(path: Column, content: Column) -> Column:
    """The format by the first bytes, then by the extension; zip files are told
    apart by the names inside their beginning."""
    head = F.hex(F.substring(content, 1, 64))
    text = F.decode(F.substring(content, 1, 256), "ISO-8859-1")
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for magic, name in MAGIC.items():
        if name == "zip":
            hit = F.when(F.contains(text, F.lit("application/epub+zip")), "epub").when(F.contains(text, F.lit("word/")) | (ext == "docx"), "docx").otherwise("zip")
        else:
            hit = F.lit(name)
        out = F.coalesce(out, F.when(head.startswith(magic), hit))
    html = F.lower(F.ltrim(text)).rlike(r"^(?:<!doctype html|<html)")
    return F.coalesce(out, F.when(html, "html"), F.nullif(ext, F.lit("")), F.lit("unknown"))


def best_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Each path with the longest root it lies under. Roots are few (a
    configuration) and checked to be so."""
    if roots.count() > 10_000:
        raise ValueError("too many roots")
    j = paths.join(F.broadcast(roots), F.col("path").startswith(F.col("root")), "left")
    return j.groupBy("path").agg(F.max_by("source", F.length("root")).alias("source"))


def extension(path: str) -> str:
    return PurePosixPath(path).suffix.lower().lstrip(".")
