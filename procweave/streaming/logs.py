"""Run logs as streams: classification, durable append, subscriptions and stage states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"

#: The states of a stage that end it.
FINAL = ("completed", "failed", "skipped")


def classified(logs: DataFrame, message: str = "message") -> DataFrame:
    """Drop blank messages and add the level: error, warning or info."""
    up = F.upper(F.col(message))
    level = F.when(F.rlike(up, F.lit("ERROR|FAILED")), "error").when(F.rlike(up, F.lit("WARNING|SKIP")), "warning").otherwise("info")
    return logs.filter(F.trim(message) != "").withColumn("level", level)


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, files_each: int = 100) -> DataFrame:
    """A stream of the Parquet files of a log folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def append_log(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Append classified entries to a durable log and stop when all that is there is read.

    Each batch writes its own folder, so a batch that runs again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(stream: DataFrame, run_id: int, path: str, checkpoint: str):
    """One subscriber's query: the entries of one run, appended to a folder of its own, until all that is there is read."""
    return append_log(stream.filter(F.col("user_id") == run_id), path, checkpoint)


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: counts by event-time window and type; entries later than ``late`` are not waited for."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))


def append_counts(stream: DataFrame, path: str, checkpoint: str):
    """Keep a table of the windowed counts: every batch adds the windows that it changed, and those that are past go from the state."""
    return append_log(stream, path, checkpoint, mode="update")


def counts_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The counts of every window and type as the last batch left them that changed them."""
    return spark.read.parquet(path).groupBy(F.col("w.start").alias("since"), "event_type").agg(F.max_by("n", "batch").alias("n"))


def stage_states(stream: DataFrame) -> DataFrame:
    """The state of every stage of every run (run_id, stage, status, ts) as entries come in.

    pending goes to running, and running to the final state that comes first by time, which is not left again. Entries may
    come in any order: a state is kept as the earliest final entry and the earliest running one.
    """

    def earliest(held: tuple, frame: pd.DataFrame) -> tuple:
        if frame.empty:
            return held
        status, ts = frame.sort_values(["ts", "status"]).iloc[0][["status", "ts"]]
        return (status, int(ts.value)) if held[0] is None or int(ts.value) < held[1] else held

    def advance(key, frames: Iterator[pd.DataFrame], state):
        kept = state.get if state.exists else (None,) * 4
        final, running = kept[:2], kept[2:]
        for frame in frames:
            ends = frame["status"].isin(FINAL)
            final, running = earliest(final, frame[ends]), earliest(running, frame[~ends & (frame["status"] != "pending")])
        state.update((*final, *running))
        now, since = final if final[0] is not None else running if running[0] is not None else ("pending", 0)
        yield pd.DataFrame({"run_id": [key[0]], "stage": [key[1]], "status": [now], "since": [since]})

    held = "final string, final_at long, running string, running_at long"
    return stream.groupBy("run_id", "stage").applyInPandasWithState(advance, "run_id long, stage string, status string, since long", held, "update", "NoTimeout")
