"""Reader similarity of a page by shared token counts, and the pivot it picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumtext.functions import text as X


def pair_similarity(tokens: DataFrame, readers: list[str]) -> DataFrame:
    """(page_id, reader, score): summed 2M/T of a reader with all others, M = shared keys with multiplicity.

    tokens: page_id, reader, key.  The reader list is fixed and short, so shared counts are plain columns of two
    aggregations (both combine before they shuffle); no reader pair ever becomes a row.
    """
    count = [F.count_if(F.col("reader") == r).alias(f"c{i}") for i, r in enumerate(readers)]
    per_key = tokens.groupBy("page_id", "key").agg(*count)
    return _similarity(per_key, readers)


def cell_similarity(cells: DataFrame, readers: list[str]) -> DataFrame:
    """`pair_similarity` of aligned cells (page_id, toks in the order of `readers`): a word all wrote alike is one row for
    all of them, and keys are made of the distinct words of a page."""
    each = cells.select("page_id", "toks", F.explode(F.array_distinct("toks")).alias("tok")).where("tok is not null")
    same = [(F.get("toks", F.lit(i)) == F.col("tok")) for i in range(len(readers))]
    per_word = each.groupBy("page_id", "tok").agg(*[F.count_if(s).alias(f"c{i}") for i, s in enumerate(same)])
    counts = [F.sum(f"c{i}").alias(f"c{i}") for i in range(len(readers))]
    return _similarity(per_word.withColumn("key", X.key(F.col("tok"))).groupBy("page_id", "key").agg(*counts), readers)


def _similarity(per_key: DataFrame, readers: list[str]) -> DataFrame:
    n = range(len(readers))
    sums = [F.sum(f"c{i}").alias(f"s{i}") for i in n]
    shared = [F.sum(F.least(f"c{i}", f"c{j}")).alias(f"m{i}_{j}") for i in n for j in n if i < j]
    page = per_key.groupBy("page_id").agg(*sums, *shared)

    def ratio(i: int, j: int):
        total = F.col(f"s{i}") + F.col(f"s{j}")
        return F.when(total == 0, 1.0).otherwise(2 * F.col(f"m{min(i, j)}_{max(i, j)}") / total)

    scores = []
    for i in n:
        score = F.lit(0.0)
        for j in n:
            if i != j:
                score = score + ratio(i, j)
        scores.append(F.struct(F.lit(i).alias("ord"), F.lit(readers[i]).alias("reader"), score.alias("score")))
    return page.select("page_id", F.explode(F.array(*scores)).alias("s")).select("page_id", "s.*")


def pick_pivot(scores: DataFrame) -> DataFrame:
    """Reader with the highest score, ties to the first."""
    best = F.max_by(F.struct("reader", "ord"), F.struct("score", -F.col("ord"))).alias("b")
    return scores.groupBy("page_id").agg(best, F.max("score").alias("score")).select("page_id", "b.reader", "score")
