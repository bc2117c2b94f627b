"""Exports of other programs: clippings, annotations, chats, prepared chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The two languages of a reader's clippings.
MONTHS_DE = dict(zip("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(), range(1, 13)))
HEAD_EN = r"(?mU)^- Your (Highlight|Note|Bookmark) (?:on|at) (?:page (\d+)(?:-\d+)? \| )?(?:Location (\d+)(?:-(\d+))?)?[^|\n]*\| Added on \w+, (\w+) (\d{1,2}), (\d{4}) (\d{1,2}:\d{2}:\d{2} [AP]M)"
HEAD_DE = r"(?mU)^- (?:Ihre|Ihr|Deine) (Markierung|Notiz|Lesezeichen)[^|\n]*?(?:Position (\d+)(?:-(\d+))?)?\s*\| Hinzugefügt am \w+, (\d{1,2})\. (\w+) (\d{4}) (\d{1,2}:\d{2}:\d{2})"


def clippings(files: DataFrame, text: str = "text") -> DataFrame:
    """Records of a reader's clippings file: title, author, kind, place, time, text."""
    d = files.select(F.explode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "==========\n?")).alias("r")).filter(F.trim("r") != "")
    first = F.trim(F.substring_index(F.ltrim(F.regexp_replace("r", r"^[\s﻿]+", "")), "\n", 1))
    en, de = (lambda i: F.regexp_extract("r", HEAD_EN, i)), (lambda i: F.regexp_extract("r", HEAD_DE, i))
    is_en = en(1) != ""
    month = F.create_map(*[F.lit(x) for kv in MONTHS_DE.items() for x in kv])
    t_en = F.try_to_timestamp(F.concat_ws(" ", en(5), en(6), en(7), en(8)), F.lit("MMMM d yyyy h:mm:ss a"))
    t_de = F.try_to_timestamp(F.concat(de(6), F.lit("-"), F.lpad(F.try_element_at(month, de(5)).cast("string"), 2, "0"), F.lit("-"), F.lpad(de(4), 2, "0"), F.lit(" "), F.lpad(de(7), 8, "0")))
    kind = F.when(is_en, F.lower(en(1))).when(de(1) == "Markierung", "highlight").when(de(1) == "Notiz", "note").when(de(1) == "Lesezeichen", "bookmark")
    return d.select(
        F.trim(F.regexp_replace(first, r"\s*\([^()]*\)$", "")).alias("title"), F.regexp_extract(first, r"\(([^()]*)\)$", 1).alias("author"), kind.alias("kind"),
        F.when(is_en, en(3)).otherwise(de(2)).try_cast("int").alias("location"), F.coalesce(t_en, t_de).alias("created_at"),
        F.trim(F.regexp_replace(F.regexp_extract("r", r"(?s)\n- [^\n]*\n(.*)$", 1), r"^\s+|\s+$", "")).alias("highlight"),
    )


def viewer_annotations(files: DataFrame, books: DataFrame) -> DataFrame:
    """A viewer's sidecars, named by the hash of the book's path, joined to the
    books' paths and opened."""
    j = books.select("source_id", F.sha2("path", 256).alias("name")).join(files.select(F.regexp_extract("path", r"([0-9a-f]{64})\.json$", 1).alias("name"), F.col("content").cast("string").alias("j")), "name")
    a = F.from_json("j", "array<struct<type:string,highlighted_text:string,notes:string,timestamp:string,pos_frac:double,spine_index:int>>")
    return j.select("source_id", F.explode(a).alias("a")).select("source_id", "a.*")


def pdf_annotations(rows: DataFrame) -> DataFrame:
    """A PDF's annotations (kind number, page, pages, text): named, with their
    place as a fraction."""
    kind = F.when(F.col("kind").isin(8, 9, 10, 11), "highlight").when(F.col("kind").isin(0, 2), "note").otherwise("other")
    return rows.filter(kind != "other").select("source_id", kind.alias("type"), F.round(F.col("page") / F.greatest("pages", F.lit(1)), 6).alias("pos_frac"), "text")


def manager_annotations(annotations: DataFrame, attachments: DataFrame, deleted: DataFrame) -> DataFrame:
    """A reference manager's annotations with their item and page, without what
    lies in the trash."""
    a = annotations.join(deleted.select(F.col("item").alias("id")), "id", "left_anti")
    page = F.regexp_extract("sort_index", r"^(\d+)", 1).try_cast("int") + 1
    return a.join(attachments.select(F.col("id").alias("attachment"), "item"), "attachment").select("item", F.col("kind").alias("type"), "text", "comment", page.alias("page"))


def role(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin("user", "human", "you"), "user").when(low.isin("assistant", "ai", "model", "bot", "gpt", "claude", "grok"), "assistant").when(low.isin("system", "tool"), "system").otherwise("user")


def chats_flat(files: DataFrame, content: str = "j") -> DataFrame:
    """{title, messages: [{role, content}]} per file."""
    c = F.from_json(content, "title string, messages array<struct<role:string,content:string>>")
    d = files.select(c.alias("c")).select(F.col("c.title").alias("title"), F.posexplode("c.messages").alias("turn", "m"))
    return d.filter(F.trim(F.coalesce("m.content", F.lit(""))) != "").select("title", "turn", role(F.col("m.role")).alias("role"), F.col("m.content").alias("text"))


def chats_tree(files: DataFrame, content: str = "j") -> DataFrame:
    """{title, mapping: {id: {parent, children, message}}} per file: the branch of
    last children, from the root down, as a fold over the file's own nodes."""
    node = "struct<parent:string,children:array<string>,message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>"
    d = files.select(F.from_json(content, f"title string, mapping map<string,{node}>").alias("c"))
    root = F.try_element_at(F.map_keys(F.map_filter("c.mapping", lambda k, v: v["parent"].isNull())), F.lit(1))
    step = lambda path, _: F.when(F.size(F.coalesce(F.try_element_at(F.col("c.mapping"), F.element_at(path, -1))["children"], F.array())) > 0, F.concat(path, F.array(F.element_at(F.try_element_at(F.col("c.mapping"), F.element_at(path, -1))["children"], -1)))).otherwise(path)
    path = F.aggregate(F.sequence(F.lit(1), F.size(F.map_keys("c.mapping"))), F.array(root), step)
    d = d.select(F.col("c.title").alias("title"), F.posexplode(path).alias("turn", "k"), F.col("c.mapping").alias("m"))
    msg = F.try_element_at(F.col("m"), F.col("k"))["message"]
    text = F.array_join(msg["content"]["parts"], "\n")
    return d.select("title", "turn", role(msg["author"]["role"]).alias("role"), text.alias("text")).filter("trim(coalesce(text, '')) <> ''")


def chats_sender(files: DataFrame, content: str = "j") -> DataFrame:
    """{name, chat_messages: [{sender, content: [{type, text}], attachments: [{file_name}]}]}:
    text blocks only, names of attachments after them, other senders dropped."""
    c = F.from_json(content, "name string, chat_messages array<struct<sender:string,content:array<struct<type:string,text:string>>,attachments:array<struct<file_name:string>>>>")
    d = files.select(c.alias("c")).select(F.col("c.name").alias("title"), F.posexplode("c.chat_messages").alias("turn", "m")).filter(F.col("m.sender").isin("human", "assistant"))
    blocks = F.transform(F.filter("m.content", lambda b: b["type"] == "text"), lambda b: b["text"])
    names = F.transform(F.coalesce("m.attachments", F.array().cast("array<struct<file_name:string>>")), lambda a: F.concat(F.lit("["), a["file_name"], F.lit("]")))
    return d.select("title", "turn", role(F.col("m.sender")).alias("role"), F.array_join(F.concat(blocks, names), "\n\n").alias("text"))


def moment(c: Column) -> Column:
    """Epoch seconds or an ISO text as a timestamp."""
    number = c.try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), F.timestamp_seconds(number)), F.try_to_timestamp(c))


# ---- prepared chunks ---------------------------------------------------------------------------
def write_prepared(chunks: DataFrame, path: str, buckets: int | None = None) -> None:
    """Chunks of each document beside a header with their number, as JSON lines;
    the commit of the job makes them appear at once. A document has a folder of
    its own, or with ``buckets`` shares one with others: a library of many
    documents would be as many files."""
    head = chunks.groupBy("book_id").agg(F.count("*").alias("chunk_count")).select("book_id", F.lit(True).alias("_header"), "chunk_count", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("text"))
    rows = chunks.select("book_id", F.lit(False).alias("_header"), F.lit(None).cast("long").alias("chunk_count"), "id", "text")
    d, folder = head.unionByName(rows), "book_id"
    if buckets:
        d, folder = d.withColumn("bucket", F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int")), "bucket"
    # A folder's lines come from one task, and where they are many from several.
    d = d.hint("rebalance", F.col(folder)).sortWithinPartitions(folder, "book_id", F.col("_header").desc())
    d.write.mode("overwrite").partitionBy(folder).json(path)


def read_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(complete chunks, truncated documents): a document whose lines are fewer
    than its header says is not given out."""
    d = spark.read.schema("_header boolean, chunk_count long, id string, text string, book_id string").json(path)
    n = d.groupBy("book_id").agg(F.max("chunk_count").alias("wanted"), F.sum((~F.col("_header")).cast("long")).alias("got"))
    bad = n.filter("wanted is null or got <> wanted")
    return d.filter("not _header").alias("d").join(bad.alias("b"), F.col("d.book_id").eqNullSafe(F.col("b.book_id")), "left_anti").select("book_id", "id", "text"), bad


def export_markdown(results: DataFrame, title: str) -> DataFrame:
    """Ranked results as one Markdown text."""
    part = F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), F.col("book_title"), F.lit("\n\n"), F.substring("text", 1, 500))
    g = results.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("md"))
    return g.select(F.concat(F.lit(f"# {title}\n\n"), "md").alias("markdown"))
