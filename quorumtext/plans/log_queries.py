"""Registered queries: event logs, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtext.operators import logs
from quorumtext.plans import inputs as I
from quorumtext.plans.catalog import query
from quorumtext.plans.text_queries import CALL_SQL, call_log
from quorumtext.streaming import jobs


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests: bucket = kind, client = user modulo 5 (few, busy clients)."""
    return I.table(spark, sf, "events").select(
        F.col("event_type").alias("bucket"), (F.col("user_id") % 5).alias("client"), "ts", F.col("event_id").alias("request_id")
    )


@query(
    "rate_demand",
    """WITH r AS (SELECT event_type AS bucket, user_id % 5 AS client, event_id AS request_id, epoch_us(ts) AS us FROM events)
    SELECT bucket, client, request_id, count(*) OVER (PARTITION BY bucket, client ORDER BY us RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW) AS demand FROM r""",
)
def rate_demand(spark: SparkSession, sf: str) -> DataFrame:
    return logs.rate_demand(requests(spark, sf), 7200).select("bucket", "client", "request_id", "demand")


@query(
    "cooldown",
    rf"""WITH {CALL_SQL}, m AS (SELECT *, epoch_us(ts) AS us, regexp_replace(lower(message), '[-_\s]+', '', 'g') AS q FROM calls),
    f AS (SELECT *, status = 404 OR (status = 429 AND contains(q, 'perday')) AS quota, contains(lower(message), 'provider returned error') AS up,
      status = 429 AND contains(q, 'perday') AND NOT contains(q, 'upstream') AND NOT contains(q, 'providerreturnederror') AS dq, status IN (401, 403) AS au FROM m)
    SELECT event_id, coalesce(bool_or(quota) OVER (PARTITION BY reader ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING), false) AS resting_quota,
      coalesce(bool_or(up AND NOT quota) OVER (PARTITION BY reader ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND 1 PRECEDING), false) AS resting_upstream,
      coalesce(bool_or(dq) OVER (PARTITION BY reader ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND 1 PRECEDING), false) AS resting_day,
      coalesce(bool_or(au) OVER (PARTITION BY reader ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING), false) AS resting_auth FROM f""",
)
def cooldown(spark: SparkSession, sf: str) -> DataFrame:
    return logs.resting(call_log(spark, sf)).select("event_id", "resting_quota", "resting_upstream", "resting_day", "resting_auth")


@query(
    "gaps",
    """WITH l AS (SELECT event_id, user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT event_id, user_id, coalesce(gap >= INTERVAL 21600 SECOND, false) AS stalled FROM l""",
)
def gaps(spark: SparkSession, sf: str) -> DataFrame:
    e = I.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return logs.stalls(e, "user_id", 21600).select("event_id", "user_id", "stalled")


@query(
    "overlap",
    """WITH j AS (SELECT event_id AS job, event_type AS host, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60) AS BIGINT) * 1000000 + 1 AS e FROM events)
    SELECT a.job, a.host, count(*) AS in_flight, count(*) > 4 AS over_cap FROM j a JOIN j b ON a.host = b.host AND b.s <= a.s AND b.e > a.s GROUP BY ALL""",
)
def overlap(spark: SparkSession, sf: str) -> DataFrame:
    start = F.unix_micros("ts")
    end = start + F.floor(F.col("value") * 60) * 1000000 + 1
    j = I.table(spark, sf, "events").select(F.col("event_id").alias("job"), F.col("event_type").alias("host"), start.alias("start"), end.alias("end"))
    return logs.overlap(j)


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the progress log of one job per user and day part."""
    n = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "plan").when(F.col("event_type") == "click", "stage").when(F.col("event_type") == "signup", "result").otherwise("reader")
    status = F.when(n % 4 == 0, "start").when(n % 4 == 1, "done").when(n % 4 == 2, "failed").otherwise("other")
    return I.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"), n.alias("seq"), "ts", kind.alias("type"),
        F.when(n % 3 == 0, "read").when(n % 3 == 1, "vote").otherwise("context").alias("stage"), status.alias("status"),
        (n % 3).cast("int").alias("slot"), F.concat(F.lit("m"), (n % 7).cast("string")).alias("model"),
    )


JOBS = """je AS (SELECT user_id::VARCHAR AS job_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'plan' WHEN 'click' THEN 'stage' WHEN 'signup' THEN 'result' ELSE 'reader' END AS type,
  CASE event_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'vote' ELSE 'context' END AS stage, CASE event_id % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' ELSE 'other' END AS status,
  (event_id % 3)::INT AS slot, 'm' || event_id % 7 AS model FROM events)"""


@query(
    "job_progress",
    f"""WITH {JOBS}, r AS (SELECT *, CASE status WHEN 'start' THEN 'running' ELSE status END AS state, lag(model) OVER (PARTITION BY job_id, slot ORDER BY seq) AS prev FROM je WHERE type = 'reader' AND status <> 'other')
    SELECT job_id, slot, arg_max(state, seq) AS state, arg_max(model, seq) AS model, count(*) FILTER (WHERE status = 'start' AND model <> prev) AS replaced FROM r GROUP BY ALL""",
)
def job_progress(spark: SparkSession, sf: str) -> DataFrame:
    return logs.reader_states(job_events(spark, sf))


@query(
    "stage_progress",
    f"WITH {JOBS} SELECT job_id, stage, arg_max(CASE status WHEN 'start' THEN 'active' ELSE status END, seq) AS state FROM je WHERE type = 'stage' AND status <> 'other' GROUP BY ALL",
)
def stage_progress(spark: SparkSession, sf: str) -> DataFrame:
    return logs.stage_states(job_events(spark, sf))


@query(
    "event_order",
    f"""WITH {JOBS}, g AS (SELECT job_id, arg_min(type, seq) AS first, count(*) FILTER (WHERE type = 'result') AS ends, max(seq) AS last, max(seq) FILTER (WHERE type = 'result') AS fin,
      min(seq) FILTER (WHERE type = 'stage' AND stage = 'read' AND status = 'start') AS lo, max(seq) FILTER (WHERE type = 'stage' AND stage = 'read' AND status = 'done') AS hi,
      min(seq) FILTER (WHERE type = 'reader') AS rlo, max(seq) FILTER (WHERE type = 'reader') AS rhi FROM je GROUP BY job_id)
    SELECT job_id, first = 'plan' AS plan_first, coalesce(ends = 1 AND fin = last, false) AS one_end, rlo IS NULL OR coalesce(rlo > lo AND rhi < coalesce(hi, 4611686018427387904), false) AS readers_inside FROM g""",
)
def event_order(spark: SparkSession, sf: str) -> DataFrame:
    c = logs.order_check(job_events(spark, sf))
    return c.withColumn("one_end", F.coalesce("one_end", F.lit(False)))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "event_windows",
    "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = jobs.windows(event_stream(spark, sf), "event_type", "6 hours").select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")
    return jobs.run_updates(w, ["start_us", "event_type"], "windows")

