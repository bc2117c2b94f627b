"""Operators over an order: sessions, filling forward, ranges, running lines.

A key may hold a third of all rows, so no window runs over a whole key: keys
are cut into stretches of the ordering column, stretches are summed up, and
the sums are carried from stretch to stretch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_sessions(df: DataFrame, key: str, at: str, tie: str, gap_seconds: int, stretch_seconds: int = 86_400) -> DataFrame:
    """Number of the session of each row: a silence of more than the gap starts
    a new one; exactly the gap does not. Rows without a time come last and
    never split."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    far = 1 << 62
    d = df.withColumn("_t", t).withColumn("_s", F.when(F.col("_t").isNull(), far).otherwise(F.floor(F.col("_t") / (stretch_seconds * 1_000_000))))
    w = Window.partitionBy(key, "_s").orderBy(F.col("_t").asc_nulls_last(), tie)
    d = d.withColumn("_n", F.coalesce((F.col("_t") - F.lag("_t").over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(0)))
    s = d.groupBy(key, "_s").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"), F.sum("_n").alias("n"))
    v = Window.partitionBy(key).orderBy("_s")
    jump = F.coalesce((F.col("lo") - F.lag("hi").over(v) > gap_seconds * 1_000_000).cast("int"), F.lit(0))
    s = s.withColumn("j", jump)
    before = F.coalesce(F.sum("n").over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("base", before + F.sum("j").over(v.rowsBetween(Window.unboundedPreceding, 0))).select(key, "_s", "base")
    d = d.withColumn("_in", F.sum("_n").over(w)).join(s, [key, "_s"])
    return d.withColumn("session", (F.col("base") + F.col("_in")).cast("bigint")).drop("_t", "_s", "_n", "_in", "base")


def fill_forward(df: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """The last value that was not empty, in order. A book's rows are one
    window; books are bounded by what a book is."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(F.nullif(F.col(column), F.lit("")), ignorenulls=True).over(w))


def range_map(points: DataFrame, starts: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each point with the last start at or before it (an as-of join): both
    sides in one ordered stream, so no range join is made."""
    p = points.select(key, F.col(at).alias("_p"), F.struct(*points.columns).alias("_row"), F.lit(None).cast(starts.schema[value].dataType).alias("_v"), F.lit(1).alias("_o"))
    s = starts.select(key, F.col(at).alias("_p"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(0).alias("_o"))
    w = Window.partitionBy(key).orderBy("_p", "_o").rowsBetween(Window.unboundedPreceding, 0)
    d = p.unionByName(s).withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_row is not null")
    return d.select("_row.*", value)


def running_lines(pages: DataFrame, key: str, page: str, text: str, edge: int = 3, least: int = 3) -> DataFrame:
    """Lines that stand among the first or last few of at least so many pages:
    running heads and feet."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = pages.select(key, page, lines.alias("l"))
    head = d.select(key, page, F.explode(F.slice("l", 1, edge)).alias("line"), F.lit("head").alias("place"))
    foot = d.select(key, page, F.explode(F.slice("l", F.greatest(F.size("l") - edge + 1, F.lit(1)), edge)).alias("line"), F.lit("foot").alias("place"))
    # pages are counted apart from lines: partial sums first, then the distinct ones
    g = head.unionByName(foot).distinct().groupBy(key, "place", "line").agg(F.count("*").alias("pages"))
    return g.filter(F.col("pages") >= least)


def repaired_labels(pages: DataFrame, key: str, page: str, label: str, reach: int = 3, most: float = 5.0) -> DataFrame:
    """Printed page numbers: those that stray from their neighbours are taken
    out, gaps are filled along the line between the nearest kept ones, ends are
    carried on by one a page. Done on all labels at once against the median
    of their neighbours as read, so the result does not depend on the order of
    repair and one stray label does not pull the others out."""
    v = F.col(label).try_cast("double")
    w = Window.partitionBy(key).orderBy(page)
    near = [F.lag("_v", k).over(w) + k for k in range(1, reach + 1)] + [F.lead("_v", k).over(w) - k for k in range(1, reach + 1)]
    d = pages.withColumn("_v", v).withColumn("_i", F.row_number().over(w))
    some = F.filter(F.array(*near), lambda x: x.isNotNull())
    d = d.withColumn("_near", some)
    middle = F.try_element_at(F.sort_array("_near"), F.greatest(F.floor((F.size("_near") + 1) / 2).cast("int"), F.lit(1)))
    d = d.withColumn("_ok", F.when(middle.isNull() | (F.abs(F.col("_v") - middle) <= most), F.col("_v")))
    at = F.when(F.col("_ok").isNotNull(), F.struct("_i", "_ok"))
    lo, hi = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("_lo", lo).withColumn("_hi", hi)
    i = F.col("_i")
    between = F.col("_lo._ok") + (i - F.col("_lo._i")) * (F.col("_hi._ok") - F.col("_lo._ok")) / F.greatest(F.col("_hi._i") - F.col("_lo._i"), F.lit(1))
    out = F.coalesce(F.col("_ok"), between, F.col("_lo._ok") + (i - F.col("_lo._i")), F.col("_hi._ok") - (F.col("_hi._i") - i))
    return d.withColumn("repaired", F.round(out).cast("bigint")).drop("_v", "_i", "_near", "_ok", "_lo", "_hi")


def is_toc_marker(text: Column, note: Column, position: Column, spine: Column) -> Column:
    """An annotation that only marks a heading: very short without a note, short
    with a word of tables of contents, or at the very beginning."""
    from lectern.functions import text as tx

    n = F.length(F.coalesce(text, F.lit("")))
    none = F.coalesce(note, F.lit("")) == ""
    return ((n < 20) & none) | ((n < 50) & tx.has_keyword(text, tx.TOC_WORDS)) | F.coalesce(position < 0.05, F.lit(False)) | F.coalesce(spine == 0, F.lit(False))


def _places(ids: pd.Series, parents: pd.Series) -> pd.Series:
    """Place of each message in its tree: a message before its replies, one
    branch after the other, each list in the order given. A missing parent makes
    a start; a ring is entered at its first message."""
    out = []
    for names, ups in zip(ids, parents):
        known = set(names)
        below: dict = {}
        for a, b in zip(names, ups):
            below.setdefault(b if b in known else None, []).append(a)
        place: dict = {}
        for start in [*below.get(None, []), *names]:
            todo = [start]
            while todo:
                at = todo.pop()
                if at not in place:
                    place[at] = len(place)
                    todo += reversed(below.get(at, []))
        out.append([place[a] for a in names])
    return pd.Series(out, dtype=object)


def turns(messages: DataFrame, alias: DataFrame) -> DataFrame:
    """(conv_id, msg_id, turn, speaker, content): every message of every platform
    in its own platform's order: the counter, the parent links or the time. What
    that order leaves out (no counter, no time) follows after the rest, by time and
    number. Of a message loaded again the first counts; a message without a number
    is one of its own; without a conversation there is no turn. A conversation is ordered within one
    task, as its exchanges and exports are."""
    cols = ["conv_id", "msg_id", "platform", "speaker", "content", "seq", "parent_msg_id", "sent_at"]
    key = F.coalesce(F.col("msg_id").cast("string"), F.concat(F.lit("x"), F.xxhash64(*cols).cast("string")))
    first = Window.partitionBy("key").orderBy(F.col("loaded_at").asc_nulls_last(), F.xxhash64(*cols))
    m = messages.filter("conv_id is not null").select(*cols, "loaded_at", key.alias("key")).withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn", "loaded_at")
    bare = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[*\[\](){}<>_#:\s\u00a0]+", " "))
    roles = alias.groupBy(bare(F.col("alias_form")).alias("_label")).agg(F.max("speaker_role").alias("role"))
    m = m.withColumn("_label", bare(F.col("speaker"))).join(F.broadcast(roles), "_label", "left")
    when = [F.col("sent_at").asc_nulls_last(), F.col("msg_id").asc_nulls_last(), F.col("key")]
    tree = F.coalesce(F.col("platform"), F.lit("")) == "treetalk"
    each = m.filter(tree).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("sent_at").isNull().alias("late"), "sent_at", "msg_id", "key", F.col("parent_msg_id").cast("string").alias("up")))).alias("m"))
    each = each.withColumn("place", F.pandas_udf(_places, "array<int>")(F.col("m.key"), F.col("m.up")))
    each = each.select("conv_id", F.explode(F.arrays_zip(F.col("m.key").alias("key"), F.col("place").alias("turn"))).alias("x")).select("conv_id", "x.key", "x.turn")
    trees = m.filter(tree).join(each, ["conv_id", "key"])
    w = Window.partitionBy("conv_id", "platform")
    counted = (F.coalesce(F.col("platform"), F.lit("")) != "pagechat") & F.col("seq").isNotNull()
    rest = m.filter(~tree).withColumn("_c", counted)
    rest = rest.withColumn("_k", F.row_number().over(Window.partitionBy("conv_id", "platform", "_c").orderBy(*when)))
    top = F.coalesce(F.max(F.when(F.col("_c"), F.col("seq"))).over(w), F.lit(-1))
    rest = rest.withColumn("turn", F.when(F.col("_c"), F.col("seq")).otherwise(top + F.col("_k")).cast("int")).drop("_c", "_k")
    every = trees.unionByName(rest)
    return every.select("conv_id", "msg_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), "content")
