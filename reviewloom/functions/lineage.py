"""Lineage of iterated DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there, so a step doesn't run those before it again.

    The folder is the session's ``spark.checkpoint.dir``; one of this machine stands in for it in
    local mode only, as other machines could not see it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="reviewloom-checkpoint-"))
    return df.checkpoint()
