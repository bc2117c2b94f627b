"""Mixing sources to target weights by cube-method balanced sampling.

A source's rate is its target share of all tokens over its own tokens, at most
its allowed repeats. The whole part of the rate repeats every document; the
rest is an inclusion probability. The cube method moves these probabilities
through the null space of the constraints (tokens and documents taken) until
each but a few is 0 or 1; the few of a block are gathered per source and moved
again, and the last two are landed by giving up one constraint after the other,
so a source's tokens miss their target by less than two documents.

A source's documents are spread over blocks of bounded size, so a source that
holds a third of all rows is many blocks; what leaves a block undecided is at
most two documents.

Defined results
---------------
sources are compared without outer blanks and case; null, empty and unlisted
sources: not mixed, but their tokens count in the total; null and empty texts:
no tokens, never chosen; repeated documents: each a document of its own;
a listed source without documents: no rows, reported with share 0; a null
share or repeats: 0; no tokens at all: every share 0; extra columns: ignored.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokens import VOCABULARY, count_tokens
from lectern.session import cut

#: Documents of one block of the flight.
BLOCK = 20_000
EPS = 1e-9


def source_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move the probabilities to 0 or 1, keeping the sums of p * tokens and of
    p; at most two are left between. Three undecided documents always have a
    direction in which both sums stand still."""
    p = p.astype(float).copy()
    open_ = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    hand, nxt = open_[:3], 3
    draws = iter(())
    while len(hand) == 3:
        a, b, c = hand
        ta, tb, tc = float(tokens[a]), float(tokens[b]), float(tokens[c])
        u = (tc - tb, ta - tc, tb - ta)  # orthogonal to (1,1,1) and the tokens
        if abs(u[0]) + abs(u[1]) + abs(u[2]) < EPS:
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, d in zip(hand, u):
            if d > EPS:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < -EPS:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        x = next(draws, None)
        if x is None:
            draws = iter(rng.random(4096).tolist())
            x = next(draws)
        step = up if x * (up + down) < down else -down
        for i, d in zip(hand, u):
            p[i] += step * d
        hand = [i for i in hand if EPS < p[i] < 1 - EPS]
        while len(hand) < 3 and nxt < len(open_):
            hand.append(open_[nxt])
            nxt += 1
    p[p < EPS] = 0.0
    p[p > 1 - EPS] = 1.0
    return p


def land(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the last undecided documents without a bias: of two, the token
    constraint is given up and the count kept; the last one is drawn."""
    p = p.copy()
    left = [i for i in range(len(p)) if 0 < p[i] < 1]
    while len(left) > 1:
        a, b = left[:2]
        up, down = min(1 - p[a], p[b]), min(p[a], 1 - p[b])
        step = up if rng.random() * (up + down) < down else -down
        p[a], p[b] = p[a] + step, p[b] - step
        for i in (a, b):
            p[i] = 0.0 if p[i] < EPS else 1.0 if p[i] > 1 - EPS else p[i]
        left = [i for i in left if 0 < p[i] < 1]
    for i in left:
        p[i] = float(rng.random() < p[i])
    return p


def source_totals(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: tokens and documents of the source, tokens of everything,
    the rate and whether the share can be reached."""
    per = sized.groupBy("_key").agg(F.sum("n_tokens").alias("tokens"), F.sum((F.col("n_tokens") > 0).cast("long")).alias("docs"))
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    t = targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), source_key(F.col("source")).alias("_key"))
    t = t.join(per, "_key", "left").join(F.broadcast(total))
    t = t.withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "docs": F.coalesce("docs", F.lit(0))})
    want = F.col("target_share") * F.col("total")
    rate = F.when(F.col("tokens") > 0, F.least(want / F.greatest("tokens", F.lit(1)), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return t.withColumn("rate", rate).withColumn("reachable", F.col("tokens") * F.col("max_repeats") >= want)


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, _key, n_tokens) of every document."""
    d = documents.select("doc_id", source_key(F.col("source")).alias("_key"), "text")
    return count_tokens(d, "doc_id", "_key", vocabulary=vocabulary)


def choose(sized: DataFrame, totals: DataFrame, seed: int = 1) -> DataFrame:
    """(source, doc_id, n_tokens, copies): the mixture."""
    t = totals.filter("rate > 0").select("_key", "source", "rate", "docs")
    d = sized.filter("n_tokens > 0").join(F.broadcast(t), "_key")
    block = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.ceil(F.col("docs") / F.lit(BLOCK)))
    d = d.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole")).withColumn("block", block)
    schema = "source string, doc_id long, n_tokens long, whole long, p double"

    def fly(last: bool):
        def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["doc_id", "n_tokens"])
            tokens = g["n_tokens"].to_numpy(dtype=float)
            word = f"{seed}|{'|'.join(map(str, key))}|{last}"
            rng = np.random.default_rng([ord(c) for c in word])
            p = flight(g["p"].to_numpy(), tokens, rng)
            if last:
                p = land(p, rng)
            return g.assign(p=p)[["source", "doc_id", "n_tokens", "whole", "p"]]

        return run

    one = cut(d.groupBy("source", "block").applyInPandas(fly(False), schema))
    decided = one.filter("p = 0 or p = 1")
    rest = one.filter("p > 0 and p < 1").groupBy("source").applyInPandas(fly(True), schema)
    out = decided.unionByName(rest)
    return out.select("source", "doc_id", "n_tokens", (F.col("whole") + F.col("p").cast("long")).alias("copies")).filter("copies > 0")


def shares(mixture: DataFrame, totals: DataFrame) -> DataFrame:
    """Target and actual share of every listed source."""
    per = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("chosen_tokens"), F.sum("copies").alias("chosen_docs"), F.max("copies").alias("most_copies"))
    all_ = per.agg(F.coalesce(F.sum("chosen_tokens"), F.lit(0)).alias("mixed"))
    s = totals.select("source", "target_share", "tokens", "total", "reachable").join(per, "source", "left").join(F.broadcast(all_))
    c = F.coalesce("chosen_tokens", F.lit(0))
    return s.select(
        "source", "target_share", "tokens", c.alias("chosen_tokens"), F.coalesce("chosen_docs", F.lit(0)).alias("chosen_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.when(F.col("mixed") > 0, c / F.greatest("mixed", F.lit(1))).otherwise(0.0).alias("actual_share"),
        F.when(F.col("total") > 0, c / F.greatest("total", F.lit(1))).otherwise(0.0).alias("share_of_total"), "reachable",
    )
