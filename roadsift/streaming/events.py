"""Structured Streaming forms of the time operators: windows, sessions, leases, idle sweeps.

Bounded-state operators only: every aggregation has a watermark, and custom state has a
timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files of a folder as a stream with event time ``at``."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def sliding(events: DataFrame, size: str = "1 day", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.window("at", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def first_seen(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def leases(events: DataFrame, lease_ms: int = 60_000, most_attempts: int = 3) -> DataFrame:
    """Work items (user_id) with claims (event_type claim, beat, done): a lease that is not renewed in time goes back to the queue, after some attempts it fails.

    Emits (user_id, state, attempts) at every change."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("queued", 0)
        if state.hasTimedOut:
            status = "failed" if attempts >= most_attempts else "queued"
            state.update((status, attempts))  # the next claim counts on
            yield pd.DataFrame({"user_id": [key[0]], "state": [status], "attempts": [attempts]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for kind in rows["event_type"]:
            before = status
            if kind == "claim" and status == "queued":
                status, attempts = "leased", attempts + 1
            elif kind == "done" and status == "leased":
                status = "done"
            if status != before:
                out.append((key[0], status, attempts))
        state.update((status, attempts))
        if status == "leased":
            state.setTimeoutDuration(lease_ms)
        yield pd.DataFrame(out, columns=["user_id", "state", "attempts"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, state string, attempts int", "status string, attempts int", "update", GroupStateTimeout.ProcessingTimeTimeout)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a table in memory and returns it."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def idle(last_seen: DataFrame, now: str, ttl: str) -> DataFrame:
    """Sessions whose last activity is older than the time to live."""
    return last_seen.filter(F.col("last_seen") < F.expr(f"timestamp'{now}' - interval {ttl}"))
