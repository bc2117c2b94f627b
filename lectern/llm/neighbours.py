"""Most similar vectors for every vector: a permutation index.

Pivots are the centres of a bounded sample. A vector is represented by its
nearest pivots in order; it is posted under each of them, with its place there.
Vectors that meet in a posting list are ranked by the footrule distance of
their permutations; those within the bound are ranked again by their cosine.

Lists keep their length as the collection grows: up to ``PIVOTS`` pivots their
number rises with the collection's root, and beyond that each list is divided by
second pivots, the signed axes of a turn of its own: a vector falls to the axis
nearest to the direction in which it lies off the first pivot. As every list has
another turn, what two similar vectors miss in one list they meet in the next.

Exact copies of a vector are one entry of the index: their rows are joined
after the search, a bounded number of them per entry. A posting list longer
than ``LIST`` is cut into parts, and every pair of parts is a task of its own,
so no list, however hot, is read by one task, and none is capped.

Defined results
---------------
usable vector: the right number of finite values, not all zero; others and null
ids: not in the index; length: does not matter; repeated rows: one, the latest;
copies: neighbours with cosine 1, chosen by id; ties: by id; fewer than k
others: as many as there are; an empty table: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut, shuffle_width

DIMENSION = 64
#: Vectors that the pivots are fitted on, at most; chosen by hash from all rows.
SAMPLE = 16_384
#: Rows of one part of a posting list.
LIST = 16_384
#: Places of a permutation that are kept.
PREFIX = 8
#: First pivots at most, the mean length of a list from which second pivots divide it, and those at most.
PIVOTS, LENGTH, SECOND = 4096, 6_000, 128
#: Lists up to which the table of cut lists is broadcast.
SHOWN = 65_536


def usable(vector: str = "vector", dimension: int = DIMENSION):
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dimension) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def pivots(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of the sample on the sphere."""
    if len(sample) == 0:
        return np.zeros((0, DIMENSION), dtype=np.float32)
    n = min(n, len(sample))
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ c.T, axis=1)
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(own[order]) > 0]))
        sums = np.add.reduceat(sample[order], at, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c[own[order][at]] = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c[own[order][at]])
    return c.astype(np.float32)


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """A batch's vectors as rows of unit length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    x = flat.reshape(-1, dimension).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def footrule_overlap(a: np.ndarray, b: np.ndarray, prefix: int) -> np.ndarray:
    """For each pair of permutations (rows of pivots, nearest first) what their
    footrule distance falls short of the farthest: the sum over shared pivots
    of prefix minus the later of the two places. Places not in a prefix count as
    ``prefix``, so distance = prefix * (prefix + 1) - 2 * overlap."""
    names, small = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    sa, sb = small[: a.size].reshape(a.shape), small[a.size :].reshape(b.shape)
    place = np.zeros((len(names), len(b)), dtype=np.uint8)
    for i in range(prefix):
        place[sb[:, i], np.arange(len(b))] = prefix - i
    out = np.zeros((len(a), len(b)), dtype=np.uint8)
    for i in range(prefix):
        out += np.minimum(place[sa[:, i]], np.uint8(prefix - i))
    return out


def _second(postings: int, m: int) -> int:
    """Second pivots of each list: 1, or an even number that keeps lists short."""
    if postings <= m * LENGTH:
        return 1
    return int(min(SECOND, 2 * np.ceil(postings / (m * LENGTH) / 2)))


class Turns:
    """The second pivots of every list, made by rule from the list's number."""

    def __init__(self, lists: int, dim: int, m2: int):
        rng = np.random.default_rng(17)
        self.m2 = m2
        self.axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : max(1, min(dim, m2 // 2))].astype(np.float32)
        self.order = np.argsort(rng.random((lists, dim)), axis=1)
        self.signs = rng.choice(np.array([-1, 1], dtype=np.float32), size=(lists, dim))

    def lists(self, x: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The list of each vector under the given pivot of each."""
        off = x - (x * c[p]).sum(axis=1, keepdims=True) * c[p]
        t = np.take_along_axis(off, self.order[p], axis=1) * self.signs[p] @ self.axes
        return p * self.m2 + np.argmax(np.concatenate([t, -t], axis=1), axis=1)


class Index:
    """Pivots and the posting lists over them.

    The pivots are fitted on a bounded sample of ``fit_on`` (any rows with
    vectors, by default those that are indexed), so that the rows themselves
    are shuffled and written once."""

    def __init__(self, vectors: DataFrame, id_col: str = "id", vector: str = "vector", n_pivots: int | None = None, posted: int = 5, prefix: int = PREFIX, dimension: int = DIMENSION, sample: int = SAMPLE, fit_on: DataFrame | None = None, second: int | None = None):
        self.spark = vectors.sparkSession
        self.prefix, self.posted, self.dim = prefix, min(posted, prefix), dimension
        source = vectors if fit_on is None else fit_on
        # rows of the source; of a plain table this is read from the files' footers
        n = self.n = source.count()
        self.m = n_pivots or int(min(PIVOTS, max(16, 2 * np.sqrt(max(n, 1)))))
        self.m2 = second or _second(n * self.posted, self.m)
        if self.m2 > 1:  # posted under all places, which makes up for what the division parts
            self.posted = prefix
            self.m2 = second or _second(n * prefix, self.m)
        fit = source.filter(usable(vector, dimension)).select(F.col(vector).cast("array<float>").alias("vector"))
        share = min(1.0, 1.1 * sample / max(n, 1)) * 2**31
        picked = fit.withColumn("h", F.shiftrightunsigned(F.xxhash64("vector"), 33)).filter(F.col("h") <= F.lit(int(share))).orderBy("h").limit(sample).select("vector")
        got = picked.toPandas()["vector"].tolist() if n else []
        x = _unit(np.stack(got).astype(np.float32) if got else np.zeros((0, dimension), np.float32))
        self.pivots = pivots(x, self.m)
        v = vectors.filter(F.col(id_col).isNotNull() & usable(vector, dimension))
        v = v.select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
        # copies of a vector are one entry; the key is 96 bits of its content
        v = v.select("id", F.concat(F.hex(F.xxhash64("vector")), F.lit("-"), F.substring(F.hex(F.hash("vector")), -8, 8)).alias("entry"), "vector")
        self.all = cut(self._permutations(v))
        many = self.all.groupBy("entry").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
        self.many = many.select("entry")
        further = self.all.select("id", "entry").join(many, "entry").filter("id <> first").select("id")
        self.entries = self.all.join(further, "id", "left_anti")

    def _permutations(self, v: DataFrame) -> DataFrame:
        """(id, entry, vector as bytes, perm as bytes, near): the nearest pivots
        in order, and the lists they lead to."""
        shared, prefix, dim = self.spark.sparkContext.broadcast(self.pivots), self.prefix, self.dim
        m2 = self.m2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            turn = Turns(len(c), dim, m2) if m2 > 1 and len(c) else None
            p = min(prefix, len(c))
            for b in batches:
                for lo in range(0, b.num_rows, 2048):
                    part = b.slice(lo, 2048)
                    x = matrix(part.column(2), dim)
                    s = x @ c.T
                    near = np.argpartition(-s, p - 1, axis=1)[:, :p]
                    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
                    if p < prefix:  # fewer pivots than places: pad with names that nobody shares
                        pad = -1 - (np.arange(len(x) * (prefix - p)).reshape(len(x), -1) % 30000)
                        near = np.concatenate([near, pad], axis=1)
                    lists = near
                    if turn:
                        lists = np.stack([np.where(near[:, k] < 0, -1, turn.lists(x, c, np.maximum(near[:, k], 0))) for k in range(prefix)], axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in near.astype(np.int16)], pa.binary()), pa.array(lists[:, :prefix].astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "entry", "vec", "perm", "near"])

        return v.mapInArrow(run, "id string, entry string, vec binary, perm binary, near array<int>")

    def pairs(self, k: int, min_similarity: float = -1.0, least_overlap: int = 1, probes: int | None = None) -> DataFrame:
        """(entry, other, sim): for each entry the best k of each of its lists.
        Entries are posted under their ``posted`` nearest pivots and look into
        the lists of their ``probes`` nearest ones."""
        posted, probes, prefix = self.posted, probes or self.posted, self.prefix
        perms = self.entries
        width = max(posted, min(probes, prefix))
        post = perms.select("entry", "vec", "perm", F.posexplode(F.slice("near", 1, width)).alias("place", "pivot")).filter("pivot >= 0")
        size = perms.select(F.explode(F.slice("near", 1, posted)).alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(LIST)).alias("parts"))
        # only lists that are cut need to be known; they are at most one for each LIST postings
        size = size.filter("parts > 1")
        post = post.join(F.broadcast(size) if self.m * self.m2 <= SHOWN else size, "pivot", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
        h = F.pmod(F.xxhash64("entry"), F.col("parts"))
        # as an entry of the list it is in its part; as a query it looks into every part
        post = post.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        post = post.withColumn("listed", (F.col("place") < posted) & (h == F.col("part"))).withColumn("asks", F.col("place") < probes).filter("listed or asks")
        # queries of a cut list are spread over as many tasks as it has parts
        post = post.withColumn("slot", F.when(F.col("parts") == 1, F.lit(0)).otherwise(h))
        post = self._replicate(post)
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _runs(batches):
                yield from _search(rows, k, min_similarity, least_overlap, prefix, dim)

        # about 320 bytes a posting, 32 MB a task
        width_ = max(shuffle_width(self.spark), int(width * self.n * 320 / 32e6) + 1)
        # without a bound on the overlap nobody looks at the permutations
        perm = "perm" if least_overlap > 1 else F.lit(b"").alias("perm")
        lists = post.select("pivot", "part", "slot", "entry", "vec", perm, "listed", "asks").repartition(width_, "pivot", "part", "slot").sortWithinPartitions("pivot", "part", "slot")
        return lists.mapInArrow(run, "entry string, other string, sim float")

    def _replicate(self, post: DataFrame) -> DataFrame:
        """The entries of a cut list go to every slot of queries of their part."""
        slots = F.when(F.col("listed") & (F.col("parts") > 1), F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(F.array(F.col("slot").cast("bigint")))
        own = F.col("slot").cast("bigint")
        post = post.withColumn("to", F.explode(slots))
        return post.withColumn("asks", F.col("asks") & (F.col("to") == own)).withColumn("slot", F.col("to")).drop("to").filter("listed or asks")

    def neighbours(self, k: int = 5, min_similarity: float = -1.0, least_overlap: int = 1, probes: int | None = None) -> DataFrame:
        """(id, other, sim, place): each row's k most similar other rows among
        those found, with at least the given similarity."""
        found = self.pairs(k, min_similarity, least_overlap, probes)
        best = found.groupBy("entry", "other").agg(F.max("sim").alias("sim"))
        w = Window.partitionBy("entry").orderBy(F.col("sim").desc(), "other")
        best = best.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
        # of copies, the first k + 1 by id stand for all: no row needs more
        many, rows = self.many, self.all.select("id", "entry")
        w = Window.partitionBy("entry").orderBy("id")
        firsts = rows.join(many, "entry", "left_semi").withColumn("c", F.row_number().over(w)).filter(F.col("c") <= k + 1).select("entry", "id")
        firsts = firsts.unionByName(rows.join(many, "entry", "left_anti").select("entry", "id"))
        near = best.join(firsts.select(F.col("entry").alias("other"), F.col("id").alias("other_id")), "other").select("entry", "other_id", "sim")
        if min_similarity <= 1.0:
            twins = firsts.join(many, "entry", "left_semi").select("entry", F.col("id").alias("other_id"), F.lit(1.0).cast("float").alias("sim"))
            near = near.unionByName(twins)
        # an entry's candidates are at most k entries of k + 1 rows and its own copies
        w = Window.partitionBy("entry").orderBy(F.col("sim").desc(), "other_id")
        near = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select("entry", "other_id", "sim")
        out = rows.join(near, "entry").filter("id <> other_id")
        w = Window.partitionBy("id").orderBy(F.col("sim").desc(), "other_id")
        return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("id", F.col("other_id").alias("other"), "sim", "place")


def _unit(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal (pivot, part, slot) of a sorted stream."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        p, q, s = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        edge = np.flatnonzero((np.diff(p) != 0) | (np.diff(q) != 0) | (np.diff(s) != 0)) + 1
        bounds = [0, *edge.tolist(), b.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            if lo == hi:
                continue
            k = (p[lo], q[lo], s[lo])
            if held and k != key:
                yield pa.Table.from_batches(held)
                held = []
            key = k
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _search(rows: pa.Table, k: int, least: float, overlap: int, prefix: int, dim: int) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    names = rows.column("entry").combine_chunks()
    x = np.frombuffer(b"".join(rows.column("vec").to_pylist()), dtype=np.float32).reshape(-1, dim)
    perm = np.frombuffer(b"".join(rows.column("perm").to_pylist()), dtype=np.int16).reshape(-1, prefix) if overlap > 1 else None
    listed = np.flatnonzero(rows.column("listed").to_numpy(zero_copy_only=False))
    asks = np.flatnonzero(rows.column("asks").to_numpy(zero_copy_only=False))
    if not len(listed) or not len(asks):
        return
    y, yp = x[listed], perm[listed] if overlap > 1 else None
    where = np.full(len(x), -1)
    where[listed] = np.arange(len(listed))
    step = max(1, 4_000_000 // len(listed))
    for lo in range(0, len(asks), step):
        q = asks[lo : lo + step]
        sim = x[q] @ y.T
        own = where[q]
        has = own >= 0
        sim[np.flatnonzero(has), own[has]] = -2.0
        if overlap > 1:
            sim[footrule_overlap(perm[q], yp, prefix) < overlap] = -2.0
        if least > -1.0:
            a, c = np.nonzero(sim >= least)
            if not len(a):
                continue
            v = sim[a, c]
            # the best k of each query
            order = np.lexsort((-v, a))
            a, c, v = a[order], c[order], v[order]
            first = np.searchsorted(a, a, side="left")
            ok = np.arange(len(a)) - first < k
            a, c, v = a[ok], c[ok], v[ok]
        else:
            kk = min(k, sim.shape[1])
            c = np.argpartition(-sim, kk - 1, axis=1)[:, :kk]
            a = np.repeat(np.arange(len(q)), kk)
            c = c.ravel()
            v = sim[a, c]
            ok = v > -2.0
            a, c, v = a[ok], c[ok], v[ok]
        if len(a):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q[a])), names.take(pa.array(listed[c])), pa.array(np.minimum(v, 1.0).astype(np.float32))], names=["entry", "other", "sim"])
