"""Exact medians of groups of any size: values are counted, ranged and selected by place, never held by one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumtext.session import cut_lineage


def medians(rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """(key, one column a name): the median of each value within each key, the mean of the middle two where they are even.

    Null and not-a-number values do not count; a key without any has null, and a null key is a key.  Equal values become
    one row with their number before they move.  The rest is range-partitioned by (name, key, value), so one key may
    fill many tasks: the totals of the ranges, one row a range and key, say in which of them the middle lies, and only
    there values get their place.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in values.items()])
    each = rows.select(F.col(key).alias("key"), F.explode(listed).alias("x")).select("key", "x.name", "x.value")
    counted = each.where("value is not null and not isnan(value)").groupBy("name", "key", "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = cut_lineage(counted.repartitionByRange(parts, "name", "key", "value").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("name", "key", "part").agg(F.sum("n").alias("own"))
    of = Window.partitionBy("name", "key")
    before = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.select("name", "key", "part", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(of).alias("all"))
    # places of the middle values, from 0
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    end = F.col("before") + F.col("own")
    holds = ((low >= F.col("before")) & (low < end)) | ((high >= F.col("before")) & (high < end))
    here = placed.where(holds).select(F.col("name").alias("name_"), F.col("key").alias("key_"), F.col("part").alias("part_"), "before", low.alias("low"), high.alias("high"))
    on = (F.col("name") == F.col("name_")) & F.col("key").eqNullSafe(F.col("key_")) & (F.col("part") == F.col("part_"))
    inside = Window.partitionBy("name", "key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("before") + F.col("upto")
    found = ranged.join(here, on).withColumn("upto", F.sum("n").over(inside)).withColumn("first", last - F.col("n"))
    is_low, is_high = (last > F.col("low")) & (F.col("first") <= F.col("low")), (last > F.col("high")) & (F.col("first") <= F.col("high"))
    middle = found.groupBy("name", "key").agg(
        ((F.max(F.when(is_low, F.col("value"))) + F.max(F.when(is_high, F.col("value")))) / 2).alias("median")
    )
    return middle.groupBy("key").agg(*[F.max(F.when(F.col("name") == n, F.col("median"))).alias(n) for n in values]).withColumnRenamed("key", key)
