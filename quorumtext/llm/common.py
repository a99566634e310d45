"""What several operators share: written intermediate tables, word lists, distributed prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumtext.session import shared_folder

#: ASCII white space; everything else belongs to words.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Tables written so far and not removed, by the session's user.
MADE: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: lineage is cut, and the rows stay readable
    when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int = 300_000) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows; beyond that Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  Text of ASCII alone takes the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def prefix_sums(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Adds `before`: the sum of `value` over all rows that sort earlier by `order`.

    Rows are range-partitioned on the order and written with their partition number, so a rerun of a lost task
    cannot move a boundary; partition totals (one row per partition) become offsets; the rest is a window inside
    each partition.  A hot first key is spread by the keys behind it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select(*df.columns, *[c.alias(f"__o{i}") for i, c in enumerate(order)])
    keys = [f"__o{i}" for i in range(len(order))]
    ranged = written(keyed.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), name)
    totals = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    # one row per range partition: the broadcast is bounded by the partition count
    joined = summed.join(F.broadcast(offsets), "__part")
    return joined.withColumn("before", F.col("__offset") + F.col("__inside")).select(*df.columns, "before")


#: Bits of a filter: what the driver and each task hold of it, whatever the data.
FILTER_BITS = 1 << 25


def bit_filter(keys: DataFrame, key: str) -> np.ndarray:
    """FILTER_BITS bits that are set for every key (a long), and by chance for others.  Where it serves, a false hit
    only costs work, so more keys than bits stay right."""
    bits = keys.select(F.pmod(key, F.lit(FILTER_BITS)).alias("bit"))
    words = bits.groupBy(F.floor(F.col("bit") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v"))
    rows = words.toPandas()  # at most FILTER_BITS / 64 numbers
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["v"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = (keys % FILTER_BITS).astype(np.uint64)
    return (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)) > 0
