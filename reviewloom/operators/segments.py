"""Review segments: hunks that are near each other, and the signals that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP, MAX_SEGMENTS = 24, 4


def review_segments(hunk_rows: DataFrame, key: str = "doc_id", max_gap: int = MAX_GAP, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """``hunk_rows`` with segment_ix: a gap of more than ``max_gap`` lines on the new side starts
    another; a file with more than ``max_segments`` stays whole."""
    order = Window.partitionBy(key).orderBy("hunk_ix")
    end = F.col("new_start") + F.greatest(F.col("new_lines"), F.lit(1)) - 1
    starts = hunk_rows.withColumn("gap", F.col("new_start") - F.lag(end).over(order)).withColumn("starts", F.coalesce((F.col("gap") > max_gap).cast("int"), F.lit(0)))
    numbered = starts.withColumn("segment_ix", F.sum("starts").over(order))
    last = F.max("segment_ix").over(Window.partitionBy(key))
    return numbered.withColumn("segment_ix", F.when(last >= max_segments, 0).otherwise(F.col("segment_ix"))).drop("gap", "starts")


def run_segments(rows: DataFrame, key: str, order_by: str, value: str, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """segment_ix over runs of equal values (gaps and islands); one run, or too many, is 0."""
    order = Window.partitionBy(key).orderBy(order_by)
    changes = (F.row_number().over(order) > 1) & ~F.lag(value).over(order).eqNullSafe(F.col(value))
    runs = rows.withColumn("changes", changes.cast("int")).withColumn("run", F.sum("changes").over(order))
    last = F.max("run").over(Window.partitionBy(key))
    return runs.withColumn("segment_ix", F.when(last >= max_segments, 0).otherwise(F.col("run"))).drop("changes", "run")


def segment_signals(signals: DataFrame, segment_anchors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Signals by segment: one without a line goes to the first, others to those whose anchors have it.

    signals: key, line, summary; segment_anchors: key, segment_ix, anchor.
    """
    general = F.coalesce("line", F.lit(0)) == 0
    first = signals.filter(general).withColumn("segment_ix", F.lit(0).cast("long"))
    own = segment_anchors.select(key, F.col("segment_ix").cast("long").alias("segment_ix"), F.col("anchor").alias("line")).distinct()
    placed = signals.filter(~general).join(own, [key, "line"])
    return first.select(key, "segment_ix", "line", "summary").union(placed.select(key, "segment_ix", "line", "summary"))
