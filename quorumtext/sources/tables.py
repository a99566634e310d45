"""Keyed tables: cache, upserts, writer words, history.  Targets are never overwritten in place: every function
returns the new table, to be written to a new path (or merged by a table format)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumtext.functions import text as X
from quorumtext.functions.labels import writer_slug

MAX_CHARS = 2_000_000  # fixed value: payload limit of a history entry
HISTORY_CLOUD = 100


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], ts: str = "created_at") -> DataFrame:
    """Newest row per key.  max_by combines before the shuffle, so a key rewritten a billion times stays cheap."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in target.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(ts, "_new")).alias("_r")
    return both.groupBy(*keys).agg(newest).select(*keys, "_r.*").select(*target.columns)


def delete_by(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def owned_by(df: DataFrame, uid: Column) -> DataFrame:
    return df.where(F.col("user_id") == uid)


# ---------------------------------------------------------------- cache

def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 32)


def cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds `value` and `hit`; a blank value is never a hit.  requests: key."""
    good = cache.where(X.strip(F.col("value")) != "").groupBy("key").agg(F.max_by("value", "created_at").alias("value"))
    return requests.join(good, "key", "left").withColumn("hit", F.col("value").isNotNull())


def cached(requests: DataFrame, cache: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(values per key, new cache): `fn` sees each missing key once and returns (key, value, created_at)."""
    looked = cache_hits(requests.select("key").distinct(), cache)
    fresh = fn(looked.where(~F.col("hit")).select("key"))
    useful = fresh.where(X.strip(F.col("value")) != "")
    values = looked.where("hit").select("key", "value").unionByName(fresh.select("key", "value"))
    return values, upsert(cache, useful.select("key", "value", "created_at"), ["key"])


# ---------------------------------------------------------------- writer words

def add_answers(words: DataFrame, answers: DataFrame) -> DataFrame:
    """Confirmed answers, once per writer and comparison key; blank answers and empty writer names are refused."""
    clean = answers.select(
        writer_slug(F.col("writer")).alias("writer"), "original", X.strip(F.col("answer")).alias("answer"), "created_at"
    ).where("writer is not null and answer <> ''")
    keyed = clean.withColumn("k", X.key(F.col("answer")))
    known = words.select("writer", X.key(F.col("answer")).alias("k")).distinct()
    fresh = keyed.join(known, ["writer", "k"], "left_anti").groupBy("writer", "k").agg(
        F.min_by(F.struct("original", "answer", "created_at"), F.struct("created_at", "answer")).alias("r")
    )
    return words.unionByName(fresh.select("writer", "r.*"))


def words_for(local: DataFrame, shared: DataFrame) -> DataFrame:
    """Local words of a writer, then shared ones whose key is new; (writer, answer, created_at, place)."""
    mine = local.withColumn("k", X.key(F.col("answer"))).withColumn("place", F.lit(0))
    theirs = shared.withColumn("k", X.key(F.col("answer"))).join(mine.select("writer", "k").distinct(), ["writer", "k"], "left_anti")
    theirs = theirs.withColumn("place", F.lit(1))
    return mine.unionByName(theirs).drop("k")


# ---------------------------------------------------------------- history

def history_rows(entries: DataFrame, max_chars: int = MAX_CHARS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): too large a payload is refused, a thumb that does not fit is dropped."""
    size = F.length("payload")
    broken = F.try_parse_json("payload").isNull()
    fits = (size <= max_chars) & ~broken
    thumb = F.when(size + F.coalesce(F.length("thumb"), F.lit(0)) <= max_chars, F.col("thumb"))
    return entries.where(fits).withColumn("thumb", thumb), entries.where(~F.coalesce(fits, F.lit(False)))


def history_upsert(history: DataFrame, entries: DataFrame) -> DataFrame:
    return upsert(history, entries, ["user_id", "id"], "updated")


def history_latest(history: DataFrame, per_user: int = HISTORY_CLOUD) -> DataFrame:
    """Newest entries per user.  Spark keeps `per_user` rows per user and partition before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    return history.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_user)


def prefer(*ranked: DataFrame, key: str) -> DataFrame:
    """Rows of the first source that has the key; adds `source_rank`."""
    both = None
    for i, df in enumerate(ranked):
        part = df.withColumn("source_rank", F.lit(i))
        both = part if both is None else both.unionByName(part)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), "source_rank").alias("r")).select(key, "r.*")
