"""Hooks for models: an embedder and a reranker are functions of a column.

The stand-ins are deterministic and need no files; a real model is put in by
passing another function of the same form (an iterator Pandas function that
loads the model once per worker).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashing_embedder(dimension: int = 64):
    """Words hashed into signed places, scaled to unit length; an empty text is
    the zero vector."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dimension)
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode())
                    v[h % dimension] += 1 if h & 0x10000 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).tolist())
            yield pd.Series(out)

    return F.pandas_udf(run, "array<double>")


def embed(text: Column, dimension: int = 64) -> Column:
    return hashing_embedder(dimension)(text)
