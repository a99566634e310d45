"""Quality rules: word statistics of each text, then the length-normalised log-likelihood ratio of its hashed n-grams
between a trusted target and the raw corpus.  DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumtext.llm.common import BLANKS, small

#: Weights and scores are whole millionths, so sums do not depend on their order.
UNIT = 1_000_000


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def grams(own: Column, buckets: int) -> Column:
    """Bucket numbers (from 0) of the words and the pairs of neighbouring words in an array of word hashes."""
    n = F.lit(buckets)
    ahead = F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))
    pairs = F.transform(ahead, lambda a, i: F.pmod(F.xxhash64(a, F.get(own, i + 1)), n))
    return F.concat(F.transform(own, lambda h: F.pmod(h, n)), pairs)


def _hashed(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(*keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("__own"))


def _counts(docs: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs in the texts: counted where the texts are, one row a bucket beyond that."""
    seen = _hashed(docs, []).select(F.explode(grams(F.col("__own"), buckets)).alias("b")).groupBy("b").count()
    out = [0] * buckets
    for b, n in seen.collect():  # at most `buckets` rows
        out[b] = n
    return out


@dataclass
class Ratio:
    """Weights of the buckets in millionths of a nat, and the least score of a document that stays; no threshold where
    nothing is trusted."""

    weights: list[int]
    threshold: int | None

    @property
    def buckets(self) -> int:
        return len(self.weights)

    def score(self, own: Column) -> Column:
        """Mean weight of a text's n-grams in whole millionths, rounded down; null for a text without words."""
        table = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<long>")
        total = F.aggregate(grams(own, self.buckets), F.lit(0).cast("long"), lambda s, b: s + F.get(table, b.cast("int")))
        return F.floor(total / (2 * F.size(own) - 1)).cast("long")


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of which every label row says quality 1 and none says toxic."""
    good = (F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    ids = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("doc_id")
    return docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi")


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = 10_000, sigmas: float = 5.0) -> Ratio:
    """Both multinomials over all texts of each side, add-one smoothed.  The threshold lies `sigmas` standard deviations
    below the mean score of the trusted texts."""
    target, raw = _counts(trusted, buckets), _counts(docs, buckets)
    if not sum(target):
        return Ratio([0] * buckets, None)
    shift = math.log((sum(raw) + buckets) / (sum(target) + buckets))
    found = Ratio([round(UNIT * (math.log((t + 1) / (r + 1)) + shift)) for t, r in zip(target, raw)], None)
    s = found.score(F.col("__own"))
    sums = _hashed(trusted, []).where(F.size("__own") > 0).select(s.alias("s"))
    n, one, two = sums.agg(F.count("s"), F.sum("s"), F.sum(F.col("s").cast("decimal(20,0)") * F.col("s"))).first()
    spread = math.sqrt(max(int(two) * n - int(one) ** 2, 0)) / n
    found.threshold = math.floor(one / n - sigmas * spread)
    return found


def quality(docs: DataFrame, ratio: Ratio, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for every row.

    `n_symbols` counts the characters #*$%&|<>; `n_dup_lines` the lines with a word that equal an earlier line;
    `n_repeat_words` the words that lie in a three-word window found twice or more in the text, its first place
    included.  A row fails the base if it has fewer than `least_words` words, or if more than `most_repeated` percent
    of its words are repeated; `kept` is false then, and otherwise says whether the mean log-likelihood ratio of its
    n-grams reaches the threshold.  Every row is judged by the same numbers, so equal texts share one verdict.

    Null and empty texts have no words and fail.  A text is worked on in its own row, in time n log n of its words;
    windows are compared by 64 bits.  Without trusted rows there is no threshold and the base decides alone.  Rows
    that repeat, and ids that repeat, each keep their row; other columns of `docs` are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lined = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    base = docs.select("doc_id", "text", words(F.col("text")).alias("__words"), lined.alias("__lines"))
    base = base.select(
        "doc_id", F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__own"),
    )
    ahead = F.slice("__own", 1, F.greatest(F.size("__own") - 2, F.lit(0)))
    base = base.withColumn("__windows", F.transform(ahead, lambda a, i: F.xxhash64(a, F.get("__own", i + 1), F.get("__own", i + 2))))
    # most texts repeat no window, and need no order
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("__sorted", F.when(some, placed)).drop("__windows")
    same = lambda x, i: F.coalesce(F.get("__sorted", i)["h"] == x["h"], F.lit(False))
    again = F.filter("__sorted", lambda x, i: same(x, i - 1) | same(x, i + 1))
    base = base.withColumn("__starts", F.array_sort(F.transform(again, lambda x: x["i"]))).drop("__sorted")
    reach = F.transform("__starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__starts", i + 1) - p, F.lit(3))))
    covered = F.coalesce(F.aggregate(reach, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    base = base.withColumn("n_repeat_words", covered).drop("__starts")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = base.withColumn("base_failed", failed).withColumn("score", F.when(F.col("n_words") > 0, ratio.score(F.col("__own"))))
    passes = F.lit(True) if ratio.threshold is None else F.col("score") >= ratio.threshold
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score",
        (~F.col("base_failed") & F.coalesce(passes, F.lit(False))).alias("kept"),
    )
