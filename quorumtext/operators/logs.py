"""Event-log operators in batch form: trailing windows, cool-down, stalls, overlap, job progress.

A busy client or reader can own a large part of a log, so nothing here puts a whole key into one window: time is
cut into chunks, a chunk borrows the rows of the one before that its window can reach, and running values add a
small per-chunk summary to the value inside the chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumtext.functions import labels as L

SECOND = 1_000_000


def _with_halo(df: DataFrame, seconds: int, chunk_seconds: int) -> DataFrame:
    """Adds us, chunk, own: every row in its chunk, and again in the next one when that chunk can look back to it."""
    size = max(chunk_seconds, seconds) * SECOND
    us = F.unix_micros("ts")
    rows = df.withColumn("us", us).withColumn("c", F.floor(us / size))
    here = F.struct(F.col("c").alias("chunk"), F.lit(True).alias("own"))
    late = F.col("us") > (F.col("c") + 1) * size - seconds * SECOND
    there = F.when(late, F.struct((F.col("c") + 1).alias("chunk"), F.lit(False).alias("own")))
    return rows.withColumn("h", F.explode(F.array_compact(F.array(here, there)))).select("*", "h.*").drop("h", "c")


def trailing(df: DataFrame, keys: list[str], seconds: int, aggs: dict[str, Column], include_self: bool = True, chunk_seconds: int = 3600) -> DataFrame:
    """Aggregates over the last `seconds` of the same key (the far end is open)."""
    w = Window.partitionBy(*keys, "chunk").orderBy("us").rangeBetween(-seconds * SECOND + 1, 0 if include_self else -1)
    out = _with_halo(df, seconds, chunk_seconds)
    for name, agg in aggs.items():
        out = out.withColumn(name, agg.over(w))
    return out.where("own").drop("us", "chunk", "own")


def rate_demand(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests of the same bucket and client in the trailing window, admitted or not."""
    return trailing(requests, ["bucket", "client"], seconds, {"demand": F.count("*")})


def resting(calls: DataFrame) -> DataFrame:
    """calls: reader, ts, status, message -> is the reader (its key) resting at call time, and why: out of quota, provider
    down, day quota used up, key refused."""
    s, m = F.col("status"), F.col("message")
    problem = L.key_problem(s, m)
    rests = {
        "quota": (L.out_of_quota(s, m), L.QUOTA_REST), "upstream": (L.upstream_down(s, m), L.UPSTREAM_REST),
        "day": (problem == "day_quota", L.DAY_REST), "auth": (problem == "auth", L.AUTH_REST),
    }
    out = calls.select("*", *[c.alias(name) for name, (c, _) in rests.items()])
    for name, (_, seconds) in rests.items():
        out = trailing(out, ["reader"], seconds, {f"resting_{name}": F.max(name)}, False, 6 * 3600)
    return out.select(*calls.columns, *[F.coalesce(f"resting_{name}", F.lit(False)).alias(f"resting_{name}") for name in rests])


def stalls(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Events that come after a silence of at least `seconds` (the first event of a key does not)."""
    first = events.groupBy(key).agg(F.min("ts").alias("first_ts"))
    seen = trailing(events, [key], seconds, {"before": F.count("*")}, False, 24 * 3600)
    return seen.join(first, key).withColumn("stalled", (F.col("before") == 0) & (F.col("ts") > F.col("first_ts"))).drop("before", "first_ts")


def running(df: DataFrame, keys: list[str], value: str, how: str = "sum", chunk_seconds: int = 3600, tie: str | None = None) -> DataFrame:
    """Running sum or max of `value` per key in order of `us` (ties by `tie`): inside a chunk plus a chunk summary."""
    agg = {"sum": F.sum, "max": F.max}[how]
    order = ["us"] + ([tie] if tie else [])
    rows = df.withColumn("chunk", F.floor(F.col("us") / (chunk_seconds * SECOND)))
    per_chunk = rows.groupBy(*keys, "chunk").agg(agg(value).alias("total"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per_chunk.withColumn("base", agg("total").over(earlier)).drop("total")
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("part", agg(value).over(inside)).join(base, [*keys, "chunk"])
    total = F.col("part") + F.coalesce("base", F.lit(0)) if how == "sum" else F.greatest("part", "base")
    return own.withColumn("running", total).drop("part", "base", "chunk")


def overlap(jobs: DataFrame, cap: int = 4, chunk_seconds: int = 3600) -> DataFrame:
    """jobs: job, host, start, end (microseconds) -> jobs in flight at every start, marked above the cap."""
    edge = F.explode(F.array(
        F.struct(F.col("start").alias("us"), F.lit(1).alias("delta")), F.struct(F.col("end").alias("us"), F.lit(-1).alias("delta"))
    ))
    edges = jobs.select("job", "host", edge.alias("e")).select("job", "host", "e.*")
    out = running(edges, ["host"], "delta", "sum", chunk_seconds, "delta")
    return out.where("delta = 1").select("job", "host", F.col("running").alias("in_flight"), (F.col("running") > cap).alias("over_cap"))


# ---------------------------------------------------------------- job progress

READER_STATE = {"start": "running", "done": "done", "failed": "failed", "timeout": "timeout"}
STAGE_STATE = {"start": "active", "done": "done", "skipped": "skipped", "failed": "failed"}


def _lookup(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def stage_states(events: DataFrame) -> DataFrame:
    """(job_id, stage, state): last known state of every stage; unknown events are ignored."""
    e = events.where("type = 'stage'").withColumn("state", _lookup(STAGE_STATE, F.col("status"))).where("state is not null")
    return e.groupBy("job_id", "stage").agg(F.max_by("state", "seq").alias("state"))


def reader_states(events: DataFrame, chunk: int = 10_000) -> DataFrame:
    """(job_id, slot, state, model, replaced): last state of every reader slot, and how often a spare stood in.

    The model before an event is looked up inside its chunk of the sequence; a chunk starts from the last model of the
    chunks before it, one row each, so a slot with many events is many tasks.
    """
    e = events.where("type = 'reader' and slot is not null").withColumn("state", _lookup(READER_STATE, F.col("status"))).where("state is not null")
    e = e.withColumn("chunk", F.floor(F.col("seq") / chunk))
    keys = ["job_id", "slot"]
    named = F.when(F.col("model").isNotNull(), F.col("seq"))
    ends = e.groupBy(*keys, "chunk").agg(F.max_by("model", named).alias("model"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "chunk", F.last("model", ignorenulls=True).over(before).alias("carried"))
    w = Window.partitionBy(*keys, "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = e.join(ends, [*keys, "chunk"]).withColumn("last_model", F.coalesce(F.last("model", ignorenulls=True).over(w), "carried"))
    swapped = (F.col("status") == "start") & (F.col("model") != F.col("last_model"))
    marked = seen.withColumn("swapped", F.coalesce(swapped, F.lit(False)).cast("int"))
    return marked.groupBy(*keys).agg(F.max_by("state", "seq").alias("state"), F.max_by("model", named).alias("model"), F.sum("swapped").alias("replaced"))


def order_check(events: DataFrame) -> DataFrame:
    """Per job: plan first, exactly one result or error and that last, reader events inside the read stage."""
    end = F.col("type").isin("result", "error")
    read = (F.col("type") == "stage") & (F.col("stage") == "read")
    reader = F.col("type") == "reader"
    at = lambda c: F.when(c, F.col("seq"))
    g = events.where("type <> 'ping'").groupBy("job_id").agg(
        F.min_by("type", "seq").alias("first"), F.count_if(end).alias("ends"), F.max("seq").alias("last_seq"), F.max(at(end)).alias("end_seq"),
        F.min(at(read & (F.col("status") == "start"))).alias("lo"), F.max(at(read & (F.col("status") == "done"))).alias("hi"),
        F.min(at(reader)).alias("rlo"), F.max(at(reader)).alias("rhi"),
    )
    inside = F.col("rlo").isNull() | F.coalesce((F.col("rlo") > F.col("lo")) & (F.col("rhi") < F.coalesce("hi", F.lit(2**62))), F.lit(False))
    return g.select(
        "job_id", (F.col("first") == "plan").alias("plan_first"),
        ((F.col("ends") == 1) & (F.col("end_seq") == F.col("last_seq"))).alias("one_end"), inside.alias("readers_inside"),
    )
