"""Word joins: exact, alias, near (edit distance) and fuzzy (sequence ratio) matches.

The near join is an equi-join on blocking keys that provably lose no pair, followed by the exact test.  The ratio join
deals parts of the words and blocks of the entries to tasks, which bound the ratio of all their pairs at once and match
what is left.  No side is force-broadcast, and a large dictionary is shuffled like any other table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumtext.functions import rx as R
from quorumtext.functions import text as X
from quorumtext.functions.ratio import close_words
from quorumtext.session import cut_lineage

SALT = 8  # tasks a frequent key is dealt over


def lexicon(words: DataFrame, min_key: int = 3) -> DataFrame:
    """(word, ord) -> (key, word): keys of at least `min_key` characters, the last spelling of a key wins."""
    keyed = words.select("word", "ord", X.key(F.col("word")).alias("key")).where(F.length("key") >= min_key)
    return keyed.groupBy("key").agg(F.max_by("word", "ord").alias("word"))


def lexicon_hits(words: DataFrame, lex: DataFrame, key: str = "key") -> DataFrame:
    """Words whose key is in the list; entries of up to 3 characters do not count."""
    keys = lex.where(F.length("word") > 3).select(X.key(F.col("word")).alias(key)).distinct()
    return words.join(keys, key, "left_semi")


def resolve(names: DataFrame, aliases: DataFrame, drugs: DataFrame, name: str = "name") -> DataFrame:
    """Adds `canonical`: the alias target or the name itself when the formulary knows it, else null."""
    keyed = names.withColumn("key", R.drug_key(F.col(name)))
    a = aliases.select(F.col("alias").alias("key"), F.col("canonical").alias("target"))
    d = drugs.select(F.col("name").alias("canonical"), F.lit(True).alias("known"))
    out = keyed.join(a, "key", "left").withColumn("canonical", F.coalesce("target", "key")).join(d, "canonical", "left")
    return out.withColumn("canonical", F.when(F.col("known"), F.col("canonical"))).drop("target", "known")


def group_mates(groups: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Distinct (name, other): every other name of the groups a name is in, for the given `names` only if there are any.

    Membership stays one row a name and group.  Names that are asked for meet the members of their groups, which are
    dealt over SALT tasks, so no row or task holds a whole group; what comes out grows with the names asked for.
    """
    member = groups.select("group_id", "name").where("group_id is not null and name is not null").distinct()
    asked = member if names is None else member.join(names.select("name").distinct(), "name", "left_semi")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    others = member.select("group_id", F.col("name").alias("other"), F.pmod(F.hash("name"), F.lit(SALT)).alias("salt"))
    return asked.join(others, ["group_id", "salt"]).where("name <> other").select("name", "other").distinct()


def expand_groups(groups: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(name, alike): the mates of each name in one sorted array, of the given `names` only if there are any."""
    return group_mates(groups, names).groupBy("name").agg(F.sort_array(F.collect_set("other")).alias("alike"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions by an explicit number, so that small but compute-heavy inputs are not coalesced to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# ---------------------------------------------------------------- edit distance 1 or 2

def _segments(c: Column, d: int) -> Column:
    n = F.length(c)

    def seg(i: Column) -> Column:
        lo = F.floor(i * n / (d + 1)).cast("int")
        hi = F.floor((i + 1) * n / (d + 1)).cast("int")
        return F.xxhash64(F.lit(d), n, i, F.substring(c, lo + 1, hi - lo))

    return F.transform(F.sequence(F.lit(0), F.lit(d)), seg)


def _probes(c: Column, d: int) -> Column:
    n = F.length(c)

    def at_length(m: Column) -> Column:
        def at_segment(i: Column) -> Column:
            lo = F.floor(i * m / (d + 1)).cast("int")
            hi = F.floor((i + 1) * m / (d + 1)).cast("int")
            first, last = F.greatest(F.lit(0), lo - d), F.least(n - (hi - lo), lo + d)
            starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda s: F.xxhash64(F.lit(d), m, i, F.substring(c, s + 1, hi - lo)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(d)), at_segment))

    top = F.greatest(n, F.lit(0))
    lengths = F.filter(
        F.sequence(n - d, n + d),
        lambda m: (m >= 1) & ((F.greatest(top, m) <= 8) if d == 1 else (F.greatest(top, m) > 8)),
    )
    return F.flatten(F.transform(lengths, at_length))


def near_join(left: DataFrame, right: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct (a, b, d) with edit distance at most 1 (words up to 8 characters) or 2.

    A word cut into d+1 pieces keeps at least one piece intact under d edits, shifted by at most d: the pieces
    of one side are matched with the substrings of the other at those places, by hash; the exact test follows.  Words
    are dealt before they are cut; their many substrings are shuffled only if the other side is too large to broadcast.
    """
    x = left.select(a).where(F.length(a) > 0).distinct()
    y = right.select(b).where(F.length(b) > 0).distinct()
    empty = F.array().cast("array<bigint>")
    short, long = F.length(b) <= 8, F.length(b) >= 7
    pieces = F.concat(F.when(short, _segments(F.col(b), 1)).otherwise(empty), F.when(long, _segments(F.col(b), 2)).otherwise(empty))
    probes = F.array_distinct(F.concat(_probes(F.col(a), 1), _probes(F.col(a), 2)))
    xs = spread(x, a).select(a, F.explode(probes).alias("block"))
    ys = spread(y, b).select(b, F.explode(pieces).alias("block"))
    pairs = xs.join(ys, "block").where(X.near(F.col(a), F.col(b))).select(a, b).distinct()
    return pairs.withColumn("d", F.levenshtein(F.col(a), F.col(b)))


# ---------------------------------------------------------------- sequence ratio

#: Entries of a block, and words that meet it as one row.
ENTRIES, WORDS = 4_096, 16_384


def _met(words: DataFrame, entries: DataFrame, cutoff: float, exact: bool, word: str, entry: str) -> DataFrame:
    """(word, entry, ratio): distinct words in bounded parts meet the entries in bounded blocks.

    Parts and blocks are dealt to tasks by both numbers, so a word travels once for every block, and no pair does before
    it is judged.
    """
    xs = cut_lineage(words.select(word).where(F.length(word) > 0).distinct())
    ys = cut_lineage(entries.select(entry).where(F.length(entry) > 0).distinct())
    tasks = int(xs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, parts = -(-ys.count() // ENTRIES) or 1, max(4 * tasks, -(-xs.count() // WORDS))

    def dealt(df: DataFrame, c: str, n: int, name: str, into: str) -> DataFrame:
        return df.groupBy(F.pmod(F.xxhash64(c), F.lit(n)).alias(name)).agg(F.collect_list(c).alias(into))

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name)

    ws = dealt(xs, word, parts, "part", "ws").select("ws", "part", every(blocks, "block"))
    es = dealt(ys, entry, blocks, "block", "es").select("es", "block", every(parts, "part"))
    on = ["block", "part"]
    both = spread(ws, *on).join(spread(es, *on), on).select("ws", "es")
    return both.mapInArrow(close_words(cutoff, exact), "word string, entry string, ratio double").toDF(word, entry, "ratio")


def candidate_pairs(words: DataFrame, entries: DataFrame, cutoff: float, word: str = "word", entry: str = "entry") -> DataFrame:
    """Distinct (word, entry) with enough letters in common, in order: every pair that reaches the ratio, and few others."""
    return _met(words, entries, cutoff, False, word, entry).select(word, entry)


def fuzzy_pairs(words: DataFrame, entries: DataFrame, cutoff: float, word: str = "word", entry: str = "entry") -> DataFrame:
    """Distinct (word, entry, ratio) with sequence ratio of (entry, word) at or above the cutoff."""
    return _met(words, entries, cutoff, True, word, entry)


def fuzzy_top(words: DataFrame, entries: DataFrame, cutoff: float, n: int, word: str = "word", entry: str = "entry") -> DataFrame:
    """Best n entries per word by (ratio, entry) descending: ties go to the larger string."""
    w = Window.partitionBy(word).orderBy(F.desc("ratio"), F.desc(entry))
    return fuzzy_pairs(words, entries, cutoff, word, entry).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
