"""Line dedup: lines found in many documents lose all their copies.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumtext.llm.common import BLANKS, ascii_lower, written


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(line: Column) -> Column:
    """128 bits of a line's key: the line without white space at its ends."""
    key = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, salts: int = 16, carry: str | None = None) -> DataFrame:
    """(doc_id, lines, kept): every line of each row, and the lines that stay, in their order; and the column `carry` if
    one is named.

    A key is the line without ASCII white space at its ends, A-Z lower-cased.  Keys of `min_chars` code points or
    more that occur in at least `min_docs` documents are dropped everywhere.

    Lines are exploded to (document, 128-bit hash), distinct within their row, and written once.  Rows are counted by
    hash with a map-side combine; a hash below the threshold in rows is below it in documents, so only the others
    are counted by distinct documents.  A line that a third of the documents hold is spread over `salts` tasks.  The
    dropped hashes of a document come back to it as one array, and its lines are filtered at their positions.

    Null or empty text is one empty line.  Rows that repeat a doc_id count as one document and each keep their own
    row; rows without doc_id count together as one document.  Other columns of `docs` are ignored.
    """
    base = docs.select("doc_id", "text")
    low = base.select("doc_id", _lines(ascii_lower(F.coalesce("text", F.lit("")))).alias("low"))
    long_enough = F.filter("low", lambda x: F.char_length(F.btrim(x, F.lit(BLANKS))) >= min_chars)
    hashes = F.array_distinct(F.transform(long_enough, _hash))
    rows = written(low.select("doc_id", F.explode(hashes).alias("h")), "line-hashes")
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    spread = often.select("h", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(salts)))
    pairs = salted.join(spread, ["h", "salt"]).select("doc_id", "h", "salt").distinct()
    pairs = written(pairs, "line-pairs")
    drop = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    drop = drop.select("h", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    # a document's set is bounded by its own lines
    gone = pairs.join(drop, ["h", "salt"]).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("h").alias("__gone"))
    more = [carry] if carry else []
    both = docs.select("doc_id", "text", *more).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    lines = both.select("doc_id", "__gone", _lines(F.col("text")).alias("lines"), *more)
    stays = F.filter("lines", lambda x: ~F.array_contains("__gone", _hash(ascii_lower(x))))
    return lines.select("doc_id", "lines", F.when(F.col("__gone").isNull(), F.col("lines")).otherwise(stays).alias("kept"), *more)


def kept_text(kept: Column) -> Column:
    return F.array_join(kept, "\n")
