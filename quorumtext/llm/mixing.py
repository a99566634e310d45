"""Mixing sources to target weights: hash-random order per source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumtext.llm.common import prefix_sums, word_count, written


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target, start) from (source, size) rows.

    Sources in code-point order, null last, take the weights in turn.  A target that exceeds `most` times its source's
    size stops there and the excess is shared again by weight until none is above.  `start` is the sum of sizes of
    all earlier sources.  Only totals of the open and the closed sources reach the driver, one row per round.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    order = [F.col("source").isNull(), F.col("source")]
    placed = prefix_sums(each, order, "one", "mix-sources").withColumnRenamed("before", "place")
    placed = prefix_sums(placed, order, "source_size", "mix-starts").withColumnRenamed("before", "start")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    state = placed.select(
        "source", "source_size", "start", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int")).alias("weight")
    ).withColumn("cap", F.col("source_size") * most)
    whole = (state.agg(F.sum("source_size")).first()[0] or 0) * share
    # a source closes once the level passes cap / weight; the level only rises, so the closed set only grows
    level, closed = None, -1
    while True:
        shut = F.lit(False) if level is None else F.col("weight") * level > F.col("cap")
        row = state.agg(
            F.sum(F.when(shut, F.col("cap"))), F.sum(F.when(~shut, F.col("weight"))), F.count(F.when(shut, 1))
        ).first()
        if level is not None and (row[2] == closed or row[1] is None):
            break
        if row[1] is None:
            level = 0.0
            break
        closed, level = row[2], (whole - (row[0] or 0.0)) / row[1]
    asked = F.col("weight") * F.lit(float(level))
    return state.select("source", "source_size", "weight", "start", F.least(asked, F.col("cap")).alias("target"))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: str = "mix"
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words of each row the mix takes.

    Every row gets the key md5(seed, doc_id); rows are range-sorted by (source, key), word counts are summed ahead of
    each row, and each source is cut at its budget, the target rounded down.  A budget above the source's size takes
    whole epochs first and cuts the last one; the row at the cut gives the words that are still wanted.  Ties fall to
    doc_id and size, so reruns agree.  Null or empty text has size 0 and gives nothing; a null source is a source of
    its own.  Other columns of `docs` are ignored.
    """
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    slim = written(slim.withColumn("key", key), "mix-sizes")
    targets = source_targets(slim.select("source", "size"), weights, share, most)
    order = [F.col("source").isNull(), F.col("source"), F.col("key"), F.col("doc_id"), F.col("size")]
    summed = prefix_sums(slim, order, "size", "mix-order")
    t = targets.withColumnRenamed("source", "__source")
    both = summed.join(t, F.col("source").eqNullSafe(F.col("__source")))
    budget, whole = F.floor("target").cast("long"), F.col("source_size")
    epochs = F.when(whole > 0, F.floor(budget / whole)).otherwise(0).cast("long")
    last = budget - epochs * whole
    rest = F.greatest(F.least(last - (F.col("before") - F.col("start")), F.col("size")), F.lit(0))
    return both.select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + rest).cast("long").alias("taken")
    )
