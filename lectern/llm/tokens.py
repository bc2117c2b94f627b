"""Encoding a whole corpus with a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash over the vocabulary resolves whole pre-tokens
that are tokens themselves; the misses are merged pair by pair with a heap over
a linked list of bytes, in O(n log n) for a pre-token of n bytes. Every batch
looks up each distinct pre-token once.

The vocabulary's tables are broadcast; their size is fixed by the vocabulary
(about 3 MB for 50 k entries) and does not grow with the corpus.

Defined results
---------------
null and empty text: an empty list; strings that look like special tokens:
plain text; a null document id: kept as null; repeated rows: one row each;
very long texts and runs: whole, no prefix; an empty table: an empty result.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.session import table_bytes

#: Fixed value: the pre-token pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary lies on every machine; a parameter of every call.
VOCABULARY = os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Merged pre-tokens kept by a worker; beyond it the memory is emptied.
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: every key hangs on three vertices
    of a random hypergraph that is peeled; two bits a vertex then name the
    vertex that is the key's own, and a running count makes the places dense."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.size = max(3, int(self.n * 1.25) // 3 + 1)
        for seed in range(64):
            self.seed = seed
            h = self.hashes(keys)
            order = self._peel(h)
            if order is not None:
                break
        else:
            raise ValueError("repeated keys")
        g = np.full(3 * self.size, 3, dtype=np.uint8)
        seen = np.zeros(3 * self.size, dtype=bool)
        v = self.vertices(h)
        for e, own in reversed(order):
            a = v[e]
            rest = sum(int(g[x]) for x in a if x != own and seen[x])
            g[own] = (list(a).index(own) - rest) % 3
            seen[a] = True
        used = np.zeros(3 * self.size, dtype=np.int64)
        for e, own in order:
            used[own] = 1
        self.g, self.rank = np.where(g == 3, 0, g).astype(np.int64), np.cumsum(used) - used

    def hashes(self, keys: list[bytes]) -> np.ndarray:
        f, s = xxhash.xxh3_64_intdigest, self.seed
        return np.fromiter((f(k, s) for k in keys), dtype=np.uint64, count=len(keys))

    def vertices(self, h: np.ndarray) -> np.ndarray:
        m = np.uint64(self.size)
        a = h & np.uint64(0xFFFFFFFF)
        b = h >> np.uint64(32)
        c = ((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return np.stack([a % m, b % m + m, c % m + 2 * m], axis=1).astype(np.int64)

    def _peel(self, h: np.ndarray) -> list[tuple[int, int]] | None:
        v = self.vertices(h)
        degree = np.bincount(v.ravel(), minlength=3 * self.size).tolist()
        mix = [0] * (3 * self.size)
        rows = v.tolist()
        for e, a in enumerate(rows):
            for x in a:
                mix[x] ^= e
        ready = [x for x, d in enumerate(degree) if d == 1]
        order: list[tuple[int, int]] = []
        while ready:
            x = ready.pop()
            if degree[x] != 1:
                continue
            e = mix[x]
            order.append((e, x))
            for y in rows[e]:
                degree[y] -= 1
                mix[y] ^= e
                if degree[y] == 1:
                    ready.append(y)
        return order if len(order) == len(rows) else None

    def places(self, keys: list[bytes]) -> np.ndarray:
        """A place below n for every string; a string that is no key gets the
        place of some key, so the caller compares."""
        v = self.vertices(self.hashes(keys))
        which = self.g[v].sum(axis=1) % 3
        return self.rank[v[np.arange(len(v)), which]]


class Encoder:
    """Both tiers over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.mph = PerfectHash(list(ranks))
        self.words: list[bytes] = [b""] * self.mph.n
        self.ids = np.zeros(self.mph.n, dtype=np.int32)
        for (w, i), p in zip(ranks.items(), self.mph.places(list(ranks))):
            self.words[p], self.ids[p] = w, i
        self.pattern = None
        self.kept: dict[bytes, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"pattern": None, "kept": {}}

    def merge(self, word: bytes) -> np.ndarray:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # where the part that starts here ends; 0: swallowed
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != j:
                continue
            end[i], end[mid] = j, 0
            if j < n:
                before[j] = i
                if (r := ranks.get(word[i : end[j]])) is not None:
                    heapq.heappush(heap, (r, i, end[j]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:j])) is not None:
                heapq.heappush(heap, (r, p, j))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return np.array(out, dtype=np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(values, offsets) of the lists of ids of the texts."""
        if self.pattern is None:
            self.pattern = regex.compile(PATTERN)
        find, code = self.pattern.findall, {}
        flat: list[int] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        add, grow = flat.append, code.setdefault
        for k, t in enumerate(texts):
            if t:
                at = len(flat)
                for w in find(t):
                    add(grow(w, len(code)))
                sizes[k] = len(flat) - at
        words = [w.encode("utf-8", "replace") for w in code]
        parts: list[np.ndarray] = []
        if words:
            place = self.mph.places(words)
            one = self.ids[place].reshape(-1, 1)
            for k, (w, p) in enumerate(zip(words, place.tolist())):
                if self.words[p] == w:
                    parts.append(one[k])
                    continue
                ids = self.kept.get(w)
                if ids is None:
                    if len(self.kept) >= REMEMBERED:
                        self.kept.clear()
                    ids = self.merge(w)
                    if len(w) < 200:
                        self.kept[w] = ids
                parts.append(ids)
        if not flat:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        length = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
        start = np.cumsum(length) - length
        pool = np.concatenate(parts)
        seq = np.array(flat, dtype=np.int64)
        take = length[seq]
        where = np.cumsum(take) - take
        values = pool[np.repeat(start[seq] - where, take) + np.arange(int(take.sum()))]
        per = np.zeros(len(texts) + 1, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(take)])
        per[1:] = ends[np.cumsum(sizes)]
        return values.astype(np.int32), per


def _spread(df: DataFrame) -> DataFrame:
    """Enough tasks for Python work on a scan of few small files; larger scans
    are split by Spark already. Only file names and sizes are looked at."""
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= want:
        return df
    part = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if sum(table_bytes(f, spark) for f in files) >= want * part:
        return df
    return df.repartition(want)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row."""
    enc = df.sparkSession.sparkContext.broadcast(Encoder(read_ranks(vocabulary)))
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = enc.value
        for b in batches:
            values, offsets = e.encode(b.column(1).to_pylist())
            for lo, hi in _pieces(offsets):
                o = pa.array(offsets[lo : hi + 1] - offsets[lo], type=pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(o, pa.array(values[offsets[lo] : offsets[hi]], type=pa.int32()))], names=[key, "ids"])

    out = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _spread(df.select(key, text)).mapInArrow(run, out)


def _pieces(offsets: np.ndarray, most: int = 1 << 24) -> Iterator[tuple[int, int]]:
    """Cut a batch so that a list array's offsets stay within 32 bits."""
    lo = 0
    for i in range(1, len(offsets)):
        if offsets[i] - offsets[lo] > most or i == len(offsets) - 1:
            yield lo, i
            lo = i


def count_tokens(df: DataFrame, *keep: str, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns and ``n_tokens`` of every row; the ids stay with the worker."""
    enc = df.sparkSession.sparkContext.broadcast(Encoder(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = enc.value
        for b in batches:
            _, offsets = e.encode(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(offsets), type=pa.int64())], names=[*keep, "n_tokens"])

    out = T.StructType([*[df.schema[c] for c in keep], T.StructField("n_tokens", T.LongType())])
    return _spread(df.select(*keep, F_text(text))).mapInArrow(run, out)


def F_text(text: str):
    from pyspark.sql import functions as F

    return F.col(text).alias("_text")
