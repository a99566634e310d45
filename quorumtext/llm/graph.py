"""Connected components: union-find inside bounded parts, alternating large-star and small-star steps between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumtext.llm.common import written

#: Edges of a part, which one task holds.
PART = 500_000


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b): each node of a part with the smallest node it is connected with there."""
    held = [(f["a"].to_numpy(), f["b"].to_numpy()) for f in batches]
    if not held:
        return
    a, b = (np.concatenate(x) for x in zip(*held))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)  # nodes are sorted: the smaller place is the smaller node
    roots = np.array([root(x) for x in range(len(nodes))], dtype=np.int64)
    yield pd.DataFrame({"a": nodes, "b": nodes[roots]})


def _star_round(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of its neighbourhood, then every smaller one."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its smallest node.  Edges from a
    node to itself say nothing.

    Edges are read in parts of at most PART; union-find turns each into stars, which are no more than its nodes.  One
    part is the answer.  Several go on in rounds: a node's neighbourhood is only ever reduced by min, with a map-side
    combine, and joined back by a join that Spark can split, until nothing changes.  Rounds are written tables; only
    their row counts and checksums reach the driver.
    """
    e = written(edges.select("a", "b").where("a <> b"), "cc")
    parts = -(-e.count() // PART)
    e = e.coalesce(max(parts, 1)).mapInPandas(_joined, "a long, b long")
    if parts > 1:
        before, e = None, written(e.where("a <> b").distinct(), "cc")
        while True:
            state = e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
            if state == before:
                break
            before, e = state, written(_star_round(e), "cc")
        e = e.unionByName(e.select("b", F.col("b").alias("b2")).toDF("a", "b").distinct())
    return written(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "cc-named")
