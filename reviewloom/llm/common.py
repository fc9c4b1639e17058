"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of an input that would fill fewer.
SMALL_SLOTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only where that is
    unset and Spark runs in this process a temporary folder of this machine is used; on a
    cluster, whose executors could not see it, that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="reviewloom-checkpoint-"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets go of what earlier steps left: Spark removes shuffles, broadcasts and, where it is told to clean them,
    checkpoints once nothing names them, which the driver finds out when it collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def return_memory() -> None:
    """Returns the memory that this worker has freed, as it goes on to other tasks and keeps it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def give_back(batches: Iterator) -> Iterator:
    """``batches`` of a task, after whose last one its worker's freed memory is returned."""
    yield from batches
    return_memory()


def unlike(df: DataFrame, *names: str) -> list[str]:
    """``names`` made different from all columns of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        made.append(name)
    return made


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balanced_buckets(rows: int) -> int:
    """Buckets for a two-level prefix sum: about the square root of the rows, so that
    both a bucket's rows and the list of bucket totals stay small at every size."""
    return max(1, int(rows**0.5) + 1)


def dealing_slots(spark: SparkSession, size: int, slot_size: int) -> int:
    """Slots that postings of texts of ``size`` are dealt to: as many as keep one small, whatever the
    size of the whole, and a few for small inputs."""
    return max(min(SMALL_SLOTS, int(spark.conf.get("spark.sql.shuffle.partitions"))), size // slot_size)
