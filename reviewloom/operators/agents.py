"""Reviews of segments by several agents: who reviews what, and what comes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assignments(segments: DataFrame, agents: DataFrame) -> DataFrame:
    """A row for each segment and each of a request's agents. agents: agent_id, label, place, a few
    rows that a list in the configuration names, so they are broadcast."""
    return segments.crossJoin(F.broadcast(agents))


def agent_comments(comments: DataFrame, files: DataFrame, agents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Comments with their agent's label, and the old path of their file where that has one.

    comments: key, agent_id, old_path, ...; files: key, old_path; agents: agent_id, label."""
    told = files.select(key, F.col("old_path").alias("file_old_path"))
    old = F.coalesce(F.nullif("file_old_path", F.lit("")), F.col("old_path"))
    return comments.join(told, key, "left").join(F.broadcast(agents.select("agent_id", "label")), "agent_id").withColumn("old_path", old).drop("file_old_path")


def agent_outcomes(runs: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """outcome of each file: comments if any agent gave some; else findings if there are any, else
    the last error if an agent failed, else clean. Tokens are summed over all agents' runs.

    runs: key, segment_ix, place, comments, prompt_tokens, completion_tokens, error; findings: key.
    """
    totals = runs.groupBy(key).agg(
        F.sum("comments").alias("comments"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("segment_ix", "place"))).alias("last_error"),
    )
    found = findings.groupBy(key).agg(F.count("*").alias("findings"))
    joined = totals.join(found, key, "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    outcome = F.when(F.col("comments") > 0, "comments").when(F.col("findings") > 0, "findings").when(F.col("last_error").isNotNull(), "error").otherwise("clean")
    return joined.withColumn("outcome", outcome)


def merged_by_path(results: list[DataFrame], by: str = "path") -> DataFrame:
    """Entries of several analyzers in one table: by, source (the analyzer's place), ord, entry. Lists
    of a path follow each other in the order of analyzers, each in its own."""
    tagged = [r.select(by, F.lit(i).alias("source"), "ord", "entry") for i, r in enumerate(results)]
    merged = tagged[0]
    for r in tagged[1:]:
        merged = merged.unionByName(r)
    return merged.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("source", "ord")))


def entry_counts(lists: DataFrame, column: str) -> DataFrame:
    """n: the entries of all lists."""
    return lists.agg(F.coalesce(F.sum(F.size(F.coalesce(F.col(column), F.expr("array()")))), F.lit(0)).cast("long").alias("n"))


def empty_analysis(files: DataFrame, by: str = "path") -> DataFrame:
    """by, findings, signals: the analyzer that finds nothing, with empty lists for every path."""
    none = F.expr("cast(array() as array<string>)")
    return files.select(by).distinct().select(by, none.alias("findings"), none.alias("signals"))


def error_counts(outcomes: DataFrame, syncs: DataFrame, by: str = "cr_id") -> DataFrame:
    """errors of each request: its failed files, and one more if a comment couldn't be synced.

    outcomes: by, failed; syncs: by, failed_count."""
    files = outcomes.groupBy(by).agg(F.count_if("failed").alias("failed_files"))
    return files.join(syncs, by, "left").select(by, (F.col("failed_files") + F.when(F.col("failed_count") > 0, 1).otherwise(0)).alias("errors"))
