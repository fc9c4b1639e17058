"""Sharding by global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed

ROW_OVERHEAD_BYTES = 16
#: Ranges of rows at most: their totals meet in one task, which sums them up.
MOST_RANGES = 16_384


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16; a null text has none), text_crc32."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def shard_by_bytes(docs: DataFrame, n_shards: int, rows_per_range: int = 65_536) -> DataFrame:
    """Contiguous, byte-balanced shards of ``docs`` in doc_id order.

    The rows, without their texts, are dealt by ranges of doc_id, MOST_RANGES at most, which
    grow beyond that; each range's totals of bytes and rows give the ranges' global offsets,
    and a running sum in each range, which is sorted and may spill, the global prefix sum. A row goes to the shard that holds the middle of its bytes, when the
    whole is cut at equal targets; so shards are contiguous, and differ from the target by
    less than a row's size. ``slot`` counts the rows of a shard from 0 without gaps.
    Under this law equal texts are rows like others: each goes where its doc_id lies, and
    text_crc32 names the group, which may lie in several shards.

    Null texts have no bytes besides the 16 of a row; null doc_ids come first; repeated rows
    each get a slot of their own (their order among themselves is arbitrary but one); an
    empty table gives no rows; other columns of ``docs`` are ignored.
    """
    rows = sized_rows(docs)
    order = ["doc_id", "text_crc32", "size", "tie"]
    # written once: a lost task's rerun must not deal rows to other ranges
    ranged = checkpointed(
        rows.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(_ranges(rows, rows_per_range), *order[:3])
        .withColumn("range", F.spark_partition_id())
    )
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    inside = Window.partitionBy("range").orderBy(*order)
    # one row a range, MOST_RANGES at most
    placed = (
        ranged.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("at", F.row_number().over(inside))
        .join(offsets, "range")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            # twice the middle, to stay with whole numbers
            F.least(
                F.lit(n_shards - 1),
                F.expr(f"int(((bytes_before + end) * 2 - size) * {n_shards} div (2 * all_bytes))"),
            ).alias("shard"),
            (F.col("rows_before") + F.col("at")).alias("global_row"),
        )
    )
    first = placed.groupBy("shard").agg(F.min("global_row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(  # n_shards rows at most
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("global_row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _ranges(rows: DataFrame, rows_per_range: int) -> int:
    return min(MOST_RANGES, max(1, -(-rows.count() // rows_per_range)))
