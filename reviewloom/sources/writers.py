"""Comments and states of reviews as Spark sinks, so that a retried task or a plan that runs twice posts nothing twice.

A client is made by the function that option ``client`` names (``module:function``). It has ``posted(resource)``, the bodies that stand
there; ``post(resource, body, anchor)``, with anchor (path, line, side) or None; ``delete(resource, note_id)``,
``outdate(resource, note_id, body)``, ``status(resource, body)``; and, where it wants them, ``committed(counts)``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from reviewloom.operators import comments, filters
from reviewloom.sources.hosting import load_transport

ACTIONS = "resource string, action string, note_id string, path string, line int, side string, body string, key string"
COUNTS = ("attempted", "posted", "skipped", "deleted", "outdated", "stated", "failed")


def write_key(*parts: Column) -> Column:
    """What tells a comment from others: a digest of where it goes and what it says."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def key_mark(key: str) -> str:
    return f"<!-- review-key:{key} -->"


def unanchored(body: str, path: str, line: int) -> str:
    """A body that tells its place itself, below its hidden marker."""
    first, _, rest = body.partition("\n")
    if first.startswith("<!--") and first.endswith("-->"):
        return f"{first}\n{path}:{line}\n\n{rest}"
    return f"{path}:{line}\n\n{body}"


def sync_actions(new: DataFrame, notes: DataFrame, users: DataFrame, marker: str = comments.MARKER) -> DataFrame:
    """The rows of ACTIONS that bring a host's comments to a review's: old ones of ours deleted, or marked as outdated in
    discussions with others, and new ones posted.

    new: resource, path, line, side, body; notes: resource, discussion_id, note_id, is_system, body, author; users: login, one row or
    none (then authors don't count). Equal comments of a place are one.
    """
    user = users.select("login").limit(1).scalar()
    shown = notes.filter(~F.col("is_system")).withColumn("ours", filters.is_managed_comment(F.col("body"), F.col("author"), user, marker))
    totals = shown.groupBy("resource", "discussion_id").agg(F.count("*").alias("n"), F.count_if("ours").alias("n_ours")).filter("n_ours > 0")
    action = F.when(F.col("n") == F.col("n_ours"), "delete").when(~F.contains("body", F.lit(comments.OUTDATED_MARKER)), "outdate")
    old = shown.filter("ours").join(totals, ["resource", "discussion_id"]).withColumn("action", action).filter("action is not null")
    null = lambda kind: F.lit(None).cast(kind)
    old = old.select(
        "resource", "action", F.col("note_id").cast("string").alias("note_id"), null("string").alias("path"), null("int").alias("line"), null("string").alias("side"),
        F.when(F.col("action") == "outdate", comments.outdated(F.col("body"), marker)).alias("body"), write_key(F.col("action"), F.col("resource"), F.col("note_id")).alias("key"),
    )
    key = write_key(F.col("resource"), F.col("path"), F.col("line"), F.col("side"), F.col("body"))
    posts = new.select(
        "resource", F.lit("post").alias("action"), null("string").alias("note_id"), "path", F.col("line").cast("int").alias("line"), "side", comments.decorated(F.col("body"), marker).alias("body"), key.alias("key")
    ).dropDuplicates(["key"])
    return old.unionByName(posts)


@dataclass
class Written(WriterCommitMessage):
    counts: dict = field(default_factory=dict)


class ReviewWrites:
    """Rows of ACTIONS sent to a client, each on its own: one that fails is counted and stops no other.

    A post carries its key as a hidden mark. A task asks once which marks stand in a resource and leaves those out, so what a failed
    attempt had posted isn't posted again. A post that its line makes fail goes without one, under its path and line.
    """

    def __init__(self, options) -> None:
        self.client_name = options["client"]

    def write(self, rows: Iterator) -> Written:
        client, counts = load_transport(self.client_name)(), Counter()
        standing: dict[str, str] = {}
        for row in rows:
            if row.action == "post":
                counts["attempted"] += 1
            try:
                counts[self._sent(client, row, standing)] += 1
            except Exception:  # noqa: BLE001  a failure is counted
                counts["failed"] += 1
        return Written(dict(counts))

    def _sent(self, client, row, standing: dict[str, str]) -> str:
        if row.action == "delete":
            client.delete(row.resource, row.note_id)
            return "deleted"
        if row.action == "outdate":
            client.outdate(row.resource, row.note_id, row.body)
            return "outdated"
        if row.action == "status":
            client.status(row.resource, row.body)
            return "stated"
        if row.action != "post":
            raise ValueError(f"no action: {row.action}")
        if row.resource not in standing:
            standing[row.resource] = "\n".join(client.posted(row.resource))
        mark = key_mark(row.key)
        if mark in standing[row.resource]:
            return "skipped"
        try:
            client.post(row.resource, f"{row.body}\n{mark}", (row.path, row.line, row.side))
        except Exception:  # noqa: BLE001  hosts refuse lines that they don't know
            client.post(row.resource, f"{unanchored(row.body, row.path, row.line)}\n{mark}", None)
        standing[row.resource] += mark
        return "posted"

    def told(self, messages: list, batch: int | None = None) -> None:
        total: Counter = Counter()
        for message in messages:
            total.update(message.counts if message is not None else {})
        client = load_transport(self.client_name)()
        if hasattr(client, "committed"):
            client.committed({c: total[c] for c in COUNTS} | ({} if batch is None else {"batch": batch}))


class ReviewWriter(ReviewWrites, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self.told(messages)

    def abort(self, messages: list) -> None:
        """What was posted stays; the next attempt finds it by its marks."""


class ReviewStreamWriter(ReviewWrites, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.told(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        """What was posted stays; the next attempt finds it by its marks."""


class ReviewSink(DataSource):
    """Format ``review``: rows of ACTIONS to a host. Option ``client``."""

    @classmethod
    def name(cls) -> str:
        return "review"

    def schema(self) -> str:
        return ACTIONS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ReviewWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return ReviewStreamWriter(self.options)
