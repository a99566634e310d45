"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS, PIECES = 64, 8
WIDE = BITS // PIECES


@dataclass
class Rotation:
    """Centre and projection that turn a unit vector into BITS signs."""

    centre: np.ndarray
    project: np.ndarray

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, one byte a piece."""
        return np.packbits((unit - self.centre) @ self.project >= 0, axis=1)


def clean_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the usable rows: id and vector not null, every component finite, not all of them zero."""
    v = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & fine & F.exists("vector", lambda x: x != 0))


def fit_rotation(vectors: DataFrame, sample: int = 10_000, rounds: int = 30, seed: int = 7) -> Rotation:
    """Principal directions of at most `sample` vectors (the first by hash of their id), rotated by turns: signs of the
    projection, then the orthogonal map that comes closest to them.  Fewer dimensions than bits repeat the directions
    under other rotations."""
    few = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()  # bounded by `sample`
    if few.empty:
        return Rotation(np.zeros(1), np.zeros((1, BITS)))
    width = few["vector"].map(len).mode()[0]
    x = np.array(few["vector"][few["vector"].map(len) == width].tolist())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = x.mean(0)
    x = x - centre
    axes = np.linalg.svd(x.T @ x)[2]
    rng, parts, left = np.random.default_rng(seed), [], BITS
    while left > 0:
        w = axes[: min(left, width)].T
        v = x @ w
        r = np.linalg.qr(rng.normal(size=(w.shape[1], w.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ vt).T
        parts.append(w @ r)
        left -= w.shape[1]
    return Rotation(centre, np.hstack(parts))


class Index:
    """Codes of one block of entries, listed by the value of each of their pieces."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, p], kind="stable") for p in range(PIECES)]
        self.starts = [np.searchsorted(codes[o, p], np.arange(257)) for p, o in enumerate(self.order)]
        ones = np.array([bin(v).count("1") for v in range(256)], np.uint8)
        self.ones = ones
        near = ones[np.arange(256)[:, None] ^ np.arange(256)[None, :]]
        #: flips -> value -> values that many bits away
        self.ring = [[np.flatnonzero(row == s) for row in near] for s in range(WIDE + 1)]

    def within(self, code: np.ndarray, need: int) -> np.ndarray:
        """Entries of every code within the smallest Hamming radius that holds `need` of them.

        A code within radius r differs by r // PIECES bits or fewer in some piece.  Piece values are probed with 0, 1,
        2 ... flips; after s flips all codes within PIECES * (s + 1) - 1 bits are at hand."""
        seen = np.zeros(len(self.codes), bool)
        for s in range(WIDE + 1):
            for p in range(PIECES):
                order, starts = self.order[p], self.starts[p]
                for v in self.ring[s][code[p]]:
                    seen[order[starts[v] : starts[v + 1]]] = True
            found = np.flatnonzero(seen)
            bits = self.ones[self.codes[found] ^ code].sum(1, dtype=np.int64)
            reach = PIECES * (s + 1) - 1
            held = np.cumsum(np.bincount(np.minimum(bits, BITS), minlength=BITS + 1))
            if held[min(reach, BITS)] >= min(need, len(self.codes)):
                return found[bits <= int(np.searchsorted(held, min(need, len(self.codes))))]
        return np.arange(len(self.codes))


def _cosines(block: np.ndarray, norms: np.ndarray, q: np.ndarray) -> np.ndarray:
    # one order of summation for every row, so equal vectors score alike
    return (block * q).sum(1) / (norms * np.sqrt((q * q).sum()))


def nearest(
    queries: DataFrame, base: DataFrame, rotation: Rotation, k: int = 5, depth: float = 0.2, least: int = 200,
    block: int = 8192, query_block: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` rows of `base` with the largest cosine to each row of `queries`.

    Both sides are (vec_id, vector) as `clean_vectors` gives them; a row is no neighbour of its own id.  Entries are
    dealt by hash of their id to blocks of about `block` rows, queries to blocks of about `query_block`; each pair of
    blocks is one task's group, so equal vectors and crowded codes never meet in one place.  A block is a
    multi-index: every entry's code is listed under each of its pieces.  A query takes all codes within the smallest
    Hamming radius that holds `depth` of the block (`least` at least), reranks them by cosine in double precision,
    and hands on its `k` best; Spark merges those of all blocks.  Ties take the smaller vec_id.

    An entry of another length than the query is no candidate; fewer candidates than `k` give fewer ranks; an empty
    side gives no rows.  A query id that repeats is one query, that of its first vector in order.
    """
    blocks = max(1, -(-base.count() // block))
    parts = max(1, -(-queries.count() // query_block))
    b = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    entries = base.select(b.alias("b"), "vec_id", "vector").withColumn("q", every(parts))
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("q"), "vec_id", "vector").withColumn("b", every(blocks))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for width, own in left.groupby(left["vector"].map(len)):
            wanted = right[right["vector"].map(len) == width]
            if wanted.empty:
                continue
            own = own.sort_values("vec_id")
            ids = own["vec_id"].to_numpy()
            x, q = np.array(own["vector"].tolist()), np.array(wanted["vector"].tolist())
            norms = np.sqrt((x * x).sum(1))
            fits = width == len(rotation.centre)
            if fits:
                index = Index(rotation.codes(x / norms[:, None]))
                codes = rotation.codes(q / np.sqrt((q * q).sum(1))[:, None])
            need = max(least, int(depth * len(x)), k + 1)
            for i, query_id in enumerate(wanted["vec_id"].to_numpy()):
                # vectors of a width the rotation was not fitted to are compared directly
                at = index.within(codes[i], need) if fits else np.arange(len(x))
                at = at[ids[at] != query_id]
                score = _cosines(x[at], norms[at], q[i])
                best = np.lexsort((ids[at], -score))[:k]
                out += zip([query_id] * len(best), ids[at][best].tolist(), score[best].tolist())
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = entries.groupBy("b", "q").cogroup(asked.groupBy("b", "q")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
