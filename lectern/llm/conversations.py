"""Rebuilding conversations from message rows.

Messages are sessionized by channel: a channel's messages are put in order by
the platform's own ordering (a counter, parent links or the time), split into
sessions at silences longer than a gap calibrated on all silences, given roles
through an alias table, and sessions that are broken, empty or without replies
are dropped. An export names its conversations, so the sessions of one
``conv_id`` are judged together: a reply after a long silence is a reply.

No window runs over a conversation: rows are range partitioned by conversation
and place, which cuts a hot conversation into several tasks, each task sums up
its stretch of a conversation in one row, and these rows (one for each task that
a conversation runs through) are put together.

Defined results
---------------
repeated messages (same ``msg_id``): one, the earliest loaded; null ``msg_id``:
a message of its own, which breaks a chain of parent links; null ``conv_id``:
no conversation, dropped; blank (also no-break space only) content: no content;
unlisted, blank or null labels: unknown; ties in the time: by ``msg_id``; an
empty table: empty results; extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.ordered import gap_sessions
from lectern.session import cut, shuffle_width

#: White space of a blank content, the no-break spaces included.
BLANK = r"^[\s   -     　\u0085\u001c-\u001f]*$"
#: Conversations of up to so many messages are ordered within one array; longer
#: ones by pointer doubling over all tasks. Both ways are exact.
CHAIN_ARRAY = 20_000


def bare_label(c: Column) -> Column:
    """A speaker label without decoration, in lower case."""
    c = F.regexp_replace(F.lower(c), r"[\*\[\]\(\)<>{}_#:\s ]+", " ")
    return F.trim(c)


def messages(df: DataFrame, alias: DataFrame) -> DataFrame:
    """Distinct messages with their role (null where unknown)."""
    cols = ["msg_id", "conv_id", "platform", "speaker", "content", "seq", "parent_msg_id", "sent_at"]
    d = df.filter(F.col("conv_id").isNotNull()).select(*cols, "loaded_at")
    key = F.coalesce(F.col("msg_id").cast("string"), F.concat(F.lit("x"), F.xxhash64(*cols).cast("string")))
    w = Window.partitionBy("_k").orderBy(F.col("loaded_at").asc_nulls_last(), F.xxhash64(*cols))
    d = d.withColumn("_k", key).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_k", "loaded_at")
    roles = alias.select(bare_label(F.col("alias_form")).alias("_label"), F.col("speaker_role").alias("role")).dropDuplicates(["_label"])
    d = d.withColumn("_label", bare_label(F.col("speaker"))).join(roles, "_label", "left").drop("_label")
    return d.withColumn("has_content", ~F.coalesce("content", F.lit("")).rlike(BLANK))


def _walk(ids: pd.Series, parents: pd.Series) -> pd.Series:
    """Place of each message in the chain, or null if there is no one chain."""
    out = []
    for i, p in zip(ids, parents):
        n = len(i)
        child = {}
        for a, b in zip(i, p):
            child[None if b is None or b != b else int(b)] = None if a is None or a != a else int(a)
        place, at = {}, None
        while len(child) == n and at in child and len(place) < n:
            at = child[at]
            if at is None or at in place:
                break
            place[at] = len(place)
        out.append([place[int(a)] for a in i] if n and len(place) == n else None)
    return pd.Series(out, dtype=object)


def chain_places(d: DataFrame, longest: int = CHAIN_ARRAY) -> DataFrame:
    """(conv_id, msg_id, place) for conversations whose parent links form one
    unforked chain over all their messages; the others have no rows."""
    t = d.select("conv_id", "msg_id", "parent_msg_id")
    # A chain has one start, one message per parent and no unnamed message;
    # only conversations that pass these sums are walked.
    n = t.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("parent_msg_id").isNull(), 1).otherwise(0)).alias("starts"),
        F.sum(F.when(F.col("msg_id").isNull(), 1).otherwise(0)).alias("unnamed"),
    ).filter("starts = 1 and unnamed = 0")
    t = t.join(n.select("conv_id", "n"), "conv_id")
    small = t.filter(F.col("n") <= longest).groupBy("conv_id").agg(F.collect_list(F.struct("msg_id", "parent_msg_id")).alias("m"))
    small = small.withColumn("place", F.pandas_udf(_walk, "array<int>")(F.col("m.msg_id"), F.col("m.parent_msg_id"))).filter("place is not null")
    small = small.select("conv_id", F.explode(F.arrays_zip(F.col("m.msg_id").alias("msg_id"), F.col("place").alias("place"))).alias("x")).select("conv_id", "x.msg_id", "x.place")
    big = t.filter(F.col("n") > longest)
    top = big.agg(F.max("n")).first()[0]
    if top is None:
        return small
    return small.unionByName(_double(big, int(top)))


def _double(t: DataFrame, top: int) -> DataFrame:
    """Places by pointer doubling: after r rounds each message knows its
    ancestor 2^r links up. Parents with several messages, missing parents and
    rings never reach the start and are left out as broken."""
    w = Window.partitionBy("conv_id", "parent_msg_id")
    s = cut(t.select("conv_id", "msg_id", "n", F.col("parent_msg_id").alias("up"), F.when(F.col("parent_msg_id").isNull(), 0).otherwise(1).cast("bigint").alias("d"), F.count("*").over(w).alias("sib")))
    for _ in range(int(np.ceil(np.log2(top + 1))) + 1):
        a = s.select("conv_id", F.col("msg_id").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        j = s.join(a, ["conv_id", "up"], "left")
        s = cut(j.select("conv_id", "msg_id", "n", F.when(F.col("d2").isNull(), F.col("up")).otherwise(F.col("up2")).alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), "sib"))
        if s.filter("up is not null").isEmpty():
            break
    ok = s.groupBy("conv_id").agg(F.max("sib").alias("sib")).filter("sib = 1")
    stuck = s.filter("up is not null").select("conv_id").distinct()
    return s.join(ok.select("conv_id"), "conv_id", "left_semi").join(stuck, "conv_id", "left_anti").select("conv_id", "msg_id", F.col("d").cast("int").alias("place"))


def ordered(m: DataFrame) -> DataFrame:
    """Messages with their place ``pos`` in the conversation (null where the
    platform's ordering gives none)."""
    tree = m.filter("platform = 'treetalk'")
    places = chain_places(tree)
    tree = tree.join(places, ["conv_id", "msg_id"], "left").withColumn("pos", F.col("place").cast("bigint")).drop("place")
    rest = m.filter("platform is null or platform <> 'treetalk'")
    rest = rest.withColumn("pos", F.when(F.col("platform") == "lesechat", F.col("seq").cast("bigint")).when(F.col("platform") == "pagechat", F.unix_micros(F.col("sent_at").cast("timestamp"))))
    return rest.unionByName(tree)


#: Numbers of the roles in a stretch; 0 is an unknown speaker.
HUMAN, ASSISTANT, SYSTEM = 1, 2, 3
_STRETCH = (
    "conv_id bigint, part int, n bigint, sessions bigint, platform int, unknown boolean, unplaced boolean, human boolean, "
    "repeats bigint, lo bigint, hi bigint, lo_at bigint, hi_at bigint, first int, last int, unanswered boolean"
)
_NEVER = -(1 << 62)


def _in_order(df: DataFrame, *by: Column | str) -> DataFrame:
    """Rows in order over all partitions, a hot key over several of them."""
    return df.repartitionByRange(shuffle_width(df.sparkSession), *by).sortWithinPartitions(*by)


def stretches(m: DataFrame, gap_seconds: float) -> DataFrame:
    """A row for each conversation in each task it runs through: what the
    stretch holds, its sessions, and what its two ends look like."""
    o = ordered(m)
    code = F.create_map(*[F.lit(x) for p in (("lesechat", 1), ("treetalk", 2), ("pagechat", 3)) for x in p])
    role = F.create_map(*[F.lit(x) for p in (("human", HUMAN), ("assistant", ASSISTANT), ("system", SYSTEM)) for x in p])
    o = o.select(
        "conv_id", F.coalesce("pos", F.lit(_NEVER)).alias("pos"), F.coalesce("msg_id", F.lit(_NEVER)).alias("msg_id"),
        F.coalesce(F.try_element_at(role, "role"), F.when(F.col("role").isNotNull(), SYSTEM), F.lit(0)).alias("role"), "has_content",
        F.coalesce(F.try_element_at(code, "platform"), F.lit(0)).alias("platform"),
        F.coalesce(F.unix_micros(F.col("sent_at").cast("timestamp")), F.lit(_NEVER)).alias("at"),
    )
    gap = gap_seconds * 1e6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            rows = _sum_up([c.to_numpy(zero_copy_only=False) for c in b.columns], gap)
            if held is not None and held[0] == rows[0][0]:
                rows[0] = _join(held, rows[0], gap)
            elif held is not None:
                rows.insert(0, held)
            held = rows.pop()
            if rows:
                yield _batch(rows, part)
        if held is not None:
            yield _batch([held], part)

    return _in_order(o, "conv_id", "pos", "msg_id", "role").mapInArrow(run, _STRETCH)


def _batch(rows: list[tuple], part: int) -> pa.RecordBatch:
    cols = list(zip(*[(r[0], part, *r[1:]) for r in rows]))
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in _STRETCH.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[f for f, _ in fields])


def _sum_up(cols: list[np.ndarray], gap: float) -> list[tuple]:
    """The stretches of a run of ordered rows, as tuples of ``_STRETCH`` without the part."""
    conv, pos, _, role, has, platform, at = cols
    edge = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    n = np.diff(np.append(edge, len(conv)))
    same = np.concatenate([[False], conv[1:] == conv[:-1]])
    known = at > _NEVER
    with np.errstate(over="ignore"):
        silent = same & known & np.roll(known, 1) & (at - np.roll(at, 1) > gap)
    repeats = same & (pos == np.roll(pos, 1)) & (pos > _NEVER)
    total = lambda x: np.add.reduceat(x.astype(np.int64), edge)
    human = (role == HUMAN) & has
    speaks = np.flatnonzero((human | ((role == ASSISTANT) & has)) & (pos > _NEVER))
    first, last, bad = np.zeros(len(edge), np.int64), np.zeros(len(edge), np.int64), np.zeros(len(edge), bool)
    if len(speaks):
        own = np.searchsorted(edge, speaks, side="right") - 1
        r = role[speaks]
        twice = (own[1:] == own[:-1]) & (r[1:] == HUMAN) & (r[:-1] == HUMAN)
        bad[own[:-1][twice]] = True
        last[own] = r
        first[own[::-1]] = r[::-1]
    ends = edge + n - 1
    out = (conv[edge], n, 1 + total(silent), np.maximum.reduceat(platform, edge), total(role == 0) > 0, total(pos == _NEVER) > 0, total(human) > 0, total(repeats), pos[edge], pos[ends], at[edge], at[ends], first, last, bad)
    return list(zip(*[x.tolist() for x in out]))


def _join(a: tuple, b: tuple, gap: float) -> tuple:
    """Two stretches of one conversation, one after the other."""
    near = not (a[11] > _NEVER and b[10] > _NEVER and b[10] - a[11] > gap)
    return (
        a[0], a[1] + b[1], a[2] + b[2] - near, max(a[3], b[3]), a[4] or b[4], a[5] or b[5], a[6] or b[6], a[7] + b[7] + (a[9] == b[8] > _NEVER), a[8], b[9], a[10], b[11],
        a[12] or b[12], b[13] or a[13], a[14] or b[14] or (a[13] == HUMAN and b[12] == HUMAN),
    )


def verdicts(m: DataFrame, gap_seconds: float = float("inf")) -> DataFrame:
    """One row per conversation: its ``sessions``, ``broken``, ``empty``,
    ``lacks_reply``. The stretches of a conversation are as many as the tasks it
    runs through."""
    s = stretches(m, gap_seconds)
    c = s.groupBy("conv_id").agg(
        F.sum("n").alias("n"), F.max("platform").alias("platform"), F.max("unknown").alias("unknown"), F.max("unplaced").alias("unplaced"), F.max("human").alias("human"), F.sum("repeats").alias("repeats"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("sessions").alias("parts"), F.max("unanswered").alias("unanswered"), F.sort_array(F.collect_list(F.struct("part", "lo", "hi", "lo_at", "hi_at", "first", "last"))).alias("s"),
    )
    # from stretch to stretch: the last speaker, and what the seams show
    start = F.struct(F.lit(0).alias("last"), F.lit(False).alias("bad"), F.lit(0).alias("joined"), F.lit(_NEVER).alias("hi"), F.lit(_NEVER).alias("at"), F.lit(0).alias("again"))
    silence = gap_seconds * 1e6 if gap_seconds != float("inf") else float(1 << 62)

    def step(a: Column, x: Column) -> Column:
        silent = (a["at"] > _NEVER) & (x["lo_at"] > _NEVER) & ((x["lo_at"] - a["at"]).cast("double") > silence)
        seam = a["hi"] > _NEVER
        return F.struct(
            F.when(x["last"] > 0, x["last"]).otherwise(a["last"]).alias("last"), (a["bad"] | ((a["last"] == HUMAN) & (x["first"] == HUMAN))).alias("bad"),
            (a["joined"] + F.when(seam & ~silent, 1).otherwise(0)).alias("joined"), x["hi"].alias("hi"), x["hi_at"].alias("at"), (a["again"] + F.when(seam & (a["hi"] == x["lo"]), 1).otherwise(0)).alias("again"),
        )

    c = c.withColumn("end", F.aggregate("s", start, step))
    counted = (F.col("platform") == 1) & ((F.col("repeats") + F.col("end.again") > 0) | ~F.col("lo").isin(0, 1) | (F.col("hi") - F.col("lo") + 1 != F.col("n")))
    lacks = F.col("unanswered") | F.col("end.bad") | (F.col("end.last") == HUMAN)
    return c.select("conv_id", "n", (F.col("parts") - F.col("end.joined")).alias("sessions"), (F.col("unknown") | F.col("unplaced") | counted).alias("broken"), (~F.col("human")).alias("empty"), lacks.alias("lacks_reply"))


def left_out(m: DataFrame) -> DataFrame:
    """Conversations to be left out: the channel's messages are stored once,
    the gap is calibrated on their silences, and the sessions are judged."""
    slim = cut(m.drop("content", "speaker"))
    return verdicts(slim, calibrated_gap(slim, ["conv_id"])).filter("broken or empty or lacks_reply").select("conv_id")


def rebuild(m: DataFrame) -> DataFrame:
    """The turns of the conversations that are kept, once each and in order."""
    m = cut(m)
    kept = verdicts(m, calibrated_gap(m, ["conv_id"])).filter("not (broken or empty or lacks_reply)").select("conv_id")
    o = ordered(m).join(kept, "conv_id", "left_semi")
    cols = ["conv_id", "msg_id", F.col("role").alias("speaker"), "content", "pos"]
    return numbered(o.select(*cols), "conv_id", ["pos", "msg_id"], "turn").select("conv_id", "turn", "msg_id", "speaker", "content")


def numbered(df: DataFrame, key: str, by: list[str], name: str) -> DataFrame:
    """Each row's number within its key, in order. A key that runs through
    several tasks is counted task by task; only such keys are joined (at most
    two for each task, which bounds what is broadcast)."""
    fields = df.schema.fields
    at, names = df.columns.index(key), [*df.columns, name, "_part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(at).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(edge, len(k)))
            i = np.arange(len(k)) - np.repeat(edge, size) + 1
            if last is not None and last == k[0]:
                i[: size[0]] += seen
            last, seen = k[-1], int(i[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(i), pa.array(np.full(len(k), part, np.int32))], names=names)

    out = T.StructType([*fields, T.StructField(name, T.LongType()), T.StructField("_part", T.IntegerType())])
    n = cut(_in_order(df, key, *by).mapInArrow(run, out))
    per = n.groupBy(key, "_part").agg(F.max(name).alias("n"))
    many = per.groupBy(key).agg(F.count("*").alias("c"), F.sort_array(F.collect_list(F.struct("_part", "n"))).alias("s")).filter("c > 1")
    w = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = many.select(key, F.explode("s").alias("x")).select(key, "x._part", "x.n").withColumn("_before", F.sum("n").over(w)).select(key, "_part", "_before")
    return n.join(F.broadcast(before), [key, "_part"], "left").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def calibrated_gap(df: DataFrame, channel: list[str], at: str = "sent_at", least: float = 60.0) -> float:
    """Seconds of silence that part sessions: the emptiest place between the
    two heaps of the silences' logarithms. Silences are counted in 64 steps over
    all rows in the tasks, so what reaches the driver is 65 rows a task; without
    a valley between two heaps it is the longest gap, that is nothing is split."""
    whole = len(channel) == 1 and df.schema[channel[0]].dataType == T.LongType()
    key = F.col(channel[0]) if whole else F.xxhash64(*channel)
    t = df.filter(F.col(at).isNotNull()).select(F.coalesce(key, F.lit(_NEVER)).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, h, ends = TaskContext.get().partitionId(), np.zeros(64, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            k, x = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            first = (int(k[0]), int(x[0])) if ends is None else ends[0]
            if ends is not None:
                k, x = np.concatenate([[ends[1][0]], k]), np.concatenate([[ends[1][1]], x])
            h += _steps(np.diff(x)[k[1:] == k[:-1]])
            ends = (first, (int(k[-1]), int(x[-1])))
        if ends is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "h": pa.array([h.tolist()], pa.list_(pa.int64())), "ends": pa.array([[*ends[0], *ends[1]]], pa.list_(pa.int64()))})

    rows = sorted(_in_order(t, "k", "t").mapInArrow(run, "part int, h array<bigint>, ends array<bigint>").collect())
    h = sum((np.array(r["h"]) for r in rows), np.zeros(64, np.int64))
    for a, b in zip(rows, rows[1:]):
        if a["ends"][2] == b["ends"][0]:
            h = h + _steps(np.array([b["ends"][1] - a["ends"][3]]))
    smooth = np.convolve(h, [0.25, 0.5, 0.25], "same")
    best, score = None, 0.0
    for b in range(int(2 * np.log2(least)), 63):
        left, right = smooth[:b].max(initial=0), smooth[b + 1 :].max(initial=0)
        depth = min(left, right) - smooth[b]
        if depth > score and smooth[b] <= 0.5 * min(left, right):
            best, score = b, depth
    return float(2 ** ((best + 0.5) / 2)) if best is not None else float("inf")


def _steps(micros: np.ndarray) -> np.ndarray:
    """Counts of silences of a second and more by the half powers of two of their seconds."""
    g = micros[micros >= 1_000_000] / 1e6
    return np.bincount(np.minimum(np.floor(np.log2(g) * 2), 63).astype(np.int64), minlength=64)


def sessionize(df: DataFrame, channel: list[str], gap_seconds: float, at: str = "sent_at", tie: str = "msg_id") -> DataFrame:
    """Sessions of a channel: a silence longer than the gap starts a new one."""
    if gap_seconds == float("inf"):
        return df.withColumn("session", F.lit(0).cast("bigint"))
    d = df.withColumn("_channel", F.to_json(F.struct(*channel)))
    return gap_sessions(d, "_channel", at, tie, int(gap_seconds)).drop("_channel")
