"""Structured Streaming forms of the log operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quorumtext.operators.logs import READER_STATE
from quorumtext.session import shared_folder
from quorumtext.sources import tables

# Vote deadline, give-up time, readers a vote needs.
VOTE_DEADLINE, GIVE_UP, MIN_READERS = 90, 180, 2


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder the session names."""
    root = shared_folder(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def windows(events: DataFrame, key: str, size: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts per tumbling or sliding window and key; rows later than `late` are cut."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))


def distinct_events(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_updates(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Drains an aggregating stream (update mode) into files and returns the last row per key."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)

    def save(batch: DataFrame, epoch: int) -> None:
        # a replayed batch overwrites its own folder, so the sink stays exactly-once
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    written = spark.read.parquet(f"{folder}/out")
    rest = [c for c in written.columns if c not in keys and c != "epoch"]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*")


def run_appends(stream: DataFrame, name: str) -> DataFrame:
    """Drains an appending stream into files and reads them back."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    q = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


# ---------------------------------------------------------------- job progress

def reader_progress(events: DataFrame) -> DataFrame:
    """State of every reader slot after each batch: (job_id, slot, state, model, replaced)."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        seq, status, model, replaced = state.get if state.exists else (-1, "waiting", None, 0)
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            if row.seq <= seq or row.status not in READER_STATE:
                continue
            named = row.model if isinstance(row.model, str) and row.model else None
            if row.status == "start" and named and model and named != model and status != "waiting":
                replaced += 1
            seq, status, model = int(row.seq), READER_STATE[row.status], named or model
        state.update((seq, status, model, replaced))
        yield pd.DataFrame({"job_id": [key[0]], "slot": [key[1]], "state": [status], "model": [model], "replaced": [replaced]})

    return (
        events.where("type = 'reader' and slot is not null")
        .groupBy("job_id", "slot")
        .applyInPandasWithState(
            step, "job_id string, slot int, state string, model string, replaced int",
            "seq bigint, status string, model string, replaced int", "update", GroupStateTimeout.NoTimeout,
        )
    )


# ---------------------------------------------------------------- vote deadline

def vote_ready(readings: DataFrame, slots: int, deadline: int = VOTE_DEADLINE, give_up: int = GIVE_UP, min_readers: int = MIN_READERS) -> DataFrame:
    """page_id, slot, status, text, ts -> one row per page when its vote can start.

    A page goes when all slots are in, at the deadline with enough usable readings, or at give-up; slots still
    out are timeouts, and what they send later is dropped.  Event time only, so a replay gives the same votes.
    """

    def release(key, got, late):
        slots_in = sorted(got)
        usable = [s for s in slots_in if got[s]]
        return pd.DataFrame({
            "page_id": [key[0]], "usable": [len(usable)], "voters": [",".join(map(str, usable))],
            "timed_out": [",".join(str(s) for s in range(slots) if s not in got)], "by_deadline": [late],
        })

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        first, names, oks, done = state.get if state.exists else (None, [], [], False)
        got = dict(zip(names, oks))
        if state.hasTimedOut:
            mark = state.getCurrentWatermarkMs()
            if done:
                state.remove()
                return
            enough = sum(got.values()) >= min_readers
            if enough or mark >= first + give_up * 1000:
                yield release(key, got, True)
                state.update((first, list(got), list(got.values()), True))
                state.setTimeoutTimestamp(max(mark + 1, first + 2 * give_up * 1000))
            else:
                state.update((first, list(got), list(got.values()), False))
                state.setTimeoutTimestamp(first + give_up * 1000)
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "slot"])
        for r in rows.itertuples():
            now = r.ts.value // 1_000_000
            first = now if first is None else first
            if done or int(r.slot) in got:
                continue
            late = now >= first + deadline * 1000
            if late and sum(got.values()) >= min_readers or now >= first + give_up * 1000:
                yield release(key, got, True)
                done = True
                continue
            got[int(r.slot)] = bool(r.status == "done" and isinstance(r.text, str) and r.text.strip())
            if len(got) == slots or late and sum(got.values()) >= min_readers:
                yield release(key, got, late)
                done = True
        state.update((first, list(got), list(got.values()), done))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(first + (2 * give_up if done else deadline) * 1000, mark + 1))

    return (
        readings.withWatermark("ts", "10 seconds")
        .groupBy("page_id")
        .applyInPandasWithState(
            step, "page_id string, usable int, voters string, timed_out string, by_deadline boolean",
            "first bigint, slots array<int>, ok array<boolean>, done boolean", "append", GroupStateTimeout.EventTimeTimeout,
        )
    )


# ---------------------------------------------------------------- answers

ANSWER = "writer string, original string, answer string, created_at timestamp"


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The words that `ingest_answers` has gathered: the first answer per writer and word."""
    empty = spark.createDataFrame([], ANSWER)
    return tables.add_answers(empty, spark.read.schema(ANSWER).option("recursiveFileLookup", True).parquet(f"{folder}/words"))


def ingest_answers(answers: DataFrame, folder: str):
    """Starts a stream that appends confirmed words.  A batch adds its own part and rewrites nothing else; a replayed
    batch overwrites its part, and reading keeps the first answer."""
    spark = answers.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        empty = spark.createDataFrame([], ANSWER)
        tables.add_answers(empty, batch.select("writer", "original", "answer", "created_at")).select(
            "writer", "original", "answer", "created_at"
        ).write.mode("overwrite").parquet(f"{folder}/words/part-{epoch}")

    return answers.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
