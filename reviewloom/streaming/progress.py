"""Progress of reviews: what a stream of events says at each point, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The stages of a review in order.
STAGES = (
    "started", "metadata_loaded", "diff_fetched", "diff_filtered", "scale_detected", "checkout_prepared", "static_analysis_completed",
    "review_started", "file_review_started", "agent_review_started", "agent_review_completed", "agent_review_failed",
    "file_review_completed", "file_review_failed", "posting_comments", "comments_posted", "completed", "failed",
)
EVENTS_KEPT = 60


def percent(current: Column, total: Column) -> Column:
    """0 to 100, halves up; null without a total."""
    return F.when(total > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.floor(current * 100 / total + 0.5))).cast("int"))


def carried(events: DataFrame, column: str = "completed", by: str = "request_id") -> DataFrame:
    """``events`` with what ``column`` last said up to each of them; review_started sets it to 0."""
    order = Window.partitionBy(by).orderBy("seq")
    runs = events.withColumn("run", F.count_if(F.col("stage") == "review_started").over(order))
    in_run = Window.partitionBy(by, "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.col("stage") == "review_started", F.lit(0)).otherwise(F.col(column))
    return runs.withColumn(f"{column}_so_far", F.coalesce(F.last(said, ignorenulls=True).over(in_run), F.lit(0))).drop("run")


def agent_summary(events: DataFrame, by: str = "request_id") -> DataFrame:
    """Segments done, failures, tokens and the last status of each agent in each request."""
    status = (
        F.when(F.col("stage") == "agent_review_started", "running")
        .when(F.col("stage") == "agent_review_completed", "done")
        .when(F.col("stage") == "agent_review_failed", "failed")
    )
    done = F.col("stage") == "agent_review_completed"
    return (
        events.withColumn("status", status)
        .groupBy(by, "agent_id")
        .agg(
            F.count_if(done).alias("completed_segments"),
            F.count_if(F.col("stage") == "agent_review_failed").alias("failures"),
            F.coalesce(F.sum(F.when(done, F.col("tokens"))), F.lit(0)).alias("tokens"),
            F.coalesce(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))), F.lit("waiting")).alias("status"),
        )
    )


def last_events(events: DataFrame, keep: int = EVENTS_KEPT, by: str = "request_id") -> DataFrame:
    """The newest events of each request, newest first."""
    order = Window.partitionBy(by).orderBy(F.col("seq").desc())
    return events.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)


def heartbeats(events: DataFrame, ticks: DataFrame, by: str = "request_id") -> DataFrame:
    """For each tick (by, ts) the stage of the last event up to it: an as-of lookup by one
    running window over events and ticks together, without a range join."""
    both = events.select(by, "ts", "seq", "stage").unionByName(ticks.select(by, "ts", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("stage")))
    order = Window.partitionBy(by).orderBy("ts", F.col("seq").isNull().cast("int"), "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last_stage", F.last("stage", ignorenulls=True).over(order)).filter("seq is null").select(by, "ts", "last_stage")


def latest_heads(tasks: DataFrame, key: str = "change_key") -> DataFrame:
    """Of the heads that arrive while a key is busy only the latest is reviewed.

    tasks: key, busy (number of the busy interval), arrival, head.
    """
    return tasks.groupBy(key, "busy").agg(F.max_by("head", "arrival").alias("head"), F.count("*").alias("merged"))


def stream_carried(events: DataFrame) -> DataFrame:
    """``carried`` for a stream: the last said number of completed files is each request's state."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (so_far,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        said = []
        for stage, value in zip(rows["stage"], rows["completed"], strict=True):
            so_far = 0 if stage == "review_started" else so_far if pd.isna(value) else int(value)
            said.append(so_far)
        state.update((so_far,))
        yield pd.DataFrame({"request_id": key[0], "seq": rows["seq"].to_numpy(), "stage": rows["stage"].to_numpy(), "completed_so_far": said})

    return events.groupBy("request_id").applyInPandasWithState(
        advance, "request_id long, seq long, stage string, completed_so_far long", "completed long", "append", GroupStateTimeout.NoTimeout
    )
