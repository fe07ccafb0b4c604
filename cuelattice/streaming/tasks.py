"""Streams of requests and task progress: roll-ups, a progress state, and deltas of previews."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuelattice.session import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
PROGRESS = "task_id string, status string, progress double, revision long"
ENDED = ("completed", "failed", "cancelled")


def event_stream(spark: SparkSession, sf_dir: str, schema: str = EVENTS) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Count and sum of each type in each window; rows that are ``late`` are dropped once their window is closed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events at most ``gap`` apart."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is now, and gives its result table.

    Each batch replaces the table's files in the shared folder, so that a batch that is done twice does no harm.
    """
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def advance(state: tuple[str, float, int] | None, updates: list[tuple[str, float]]) -> tuple[str, float, int]:
    """Status, progress and revision after updates: progress never falls, and nothing follows an end."""
    status, progress, revision = state or ("pending", 0.0, 0)
    for new, value in updates:
        if status in ENDED:
            break
        status, progress, revision = new, max(progress, min(100.0, value)), revision + 1
    return status, 100.0 if status == "completed" else progress, revision


def progress(updates: DataFrame) -> DataFrame:
    """Current state of each task of a stream (task_id, seq, status, progress), a row for each batch that moves it."""

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        now = advance(state.get if state.exists else None, list(zip(rows.status, rows.progress.astype(float), strict=True)))
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["task_id", "status", "progress", "revision"]).astype({"task_id": object, "status": object})

    return updates.groupBy("task_id").applyInPandasWithState(step, PROGRESS, "status string, progress double, revision long", "update", GroupStateTimeout.NoTimeout)


def preview_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What turns one snapshot (task_id, position, text) into the next: per task append, patch or replace, and the rows."""
    both = before.select("task_id", "position", F.col("text").alias("old")).join(after.select("task_id", "position", F.col("text").alias("new")), ["task_id", "position"], "full_outer")
    added, lost, changed = F.col("old").isNull(), F.col("new").isNull(), F.col("old") != F.col("new")
    rows = F.array_sort(F.collect_list(F.when((added | changed) & ~lost, F.struct("position", F.col("new").alias("text")))))
    kind = F.when(F.count_if(lost) > 0, "replace").when(F.count_if(F.coalesce(changed, F.lit(False))) > 0, "patch").when(F.count_if(added) > 0, "append").otherwise("none")
    return both.groupBy("task_id").agg(kind.alias("kind"), F.count_if(added).alias("added"), F.count_if(lost).alias("lost"), F.count_if(F.coalesce(changed, F.lit(False))).alias("changed"), rows.alias("rows"))
