"""Code hosts as Spark sources and sinks, with the transport given by the caller.

A transport is named ``module:function``, so that tasks load it themselves. A reader's is called with (resource, cursor) and
returns (records, next): the cursor of the next page, as a host's header tells it, or whether there is a next page by
number; nothing, or a page that is no later, ends it. Pages are read to the last: a cap is an option, for searches. Registering:
``spark.dataSource.register(PagedSource)``.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Pages of a search, records of a page, and paths of a search that count.
PAGES, PAGE_SIZE, MAX_RESULTS = 5, 100, 200


def load_transport(name: str) -> Callable:
    """The function named ``module:function``."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class Pages(InputPartition):
    """Pages of a resource: from a cursor on to the end, or one page of a known number."""

    resource: str
    page: int | None = None


class PagedSource(DataSource):
    """Records of paged resources, as JSON. Options: ``resources``, comma-separated, each read on its own; ``transport``;
    ``counts``, a function that tells a resource's number of pages, or None, before it is read, so that each page is
    read on its own; ``pages``, at most so many of each. ``ord`` orders the records of a resource, with ``page``.

    As a stream: the records that a feed appends, by their number; its transport is called with (resource, offset) and returns
    the records from there on. What a batch takes is told by offsets, so a restarted stream repeats none.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "resource string, page int, ord int, record string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FeedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.transport, self.counts = options["transport"], options.get("counts")
        self.most = int(options["pages"]) if "pages" in options else None
        self.resources = [x for x in options["resources"].split(",") if x]

    def partitions(self) -> list[InputPartition]:
        known = load_transport(self.counts) if self.counts else lambda resource: None
        parts: list[InputPartition] = []
        for resource in self.resources:
            n = known(resource)
            upto = n if n is None or self.most is None else min(n, self.most)
            parts += [Pages(resource)] if upto is None else [Pages(resource, page) for page in range(1, upto + 1)]
        return parts

    def read(self, partition: Pages) -> Iterator[tuple]:
        fetch, cursor, page, ord_ = load_transport(self.transport), partition.page or 1, partition.page or 1, 0
        while True:
            records, after = fetch(partition.resource, cursor)
            for record in records:
                yield partition.resource, page, ord_, json.dumps(record, sort_keys=True)
                ord_ += 1
            following = next_cursor(cursor, after)
            if following is None or partition.page is not None or (self.most is not None and page >= self.most):
                return
            cursor, page = following, page + 1


def next_cursor(cursor: int | str, after: bool | int | str | None) -> int | str | None:
    """Where reading goes on, if it does: a page's number grows, other cursors are as told."""
    if after is None or after is False or after == "":
        return None
    if after is True:
        return int(cursor) + 1
    if str(after).isdigit() and str(cursor).isdigit():
        return int(after) if int(after) > int(cursor) else None
    return after


class FeedReader(SimpleDataSourceStreamReader):
    """New records of feeds; an offset is how many of each were read."""

    def __init__(self, options):
        self.transport = options["transport"]
        self.resources = [x for x in options["resources"].split(",") if x]

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.resources, 0)

    def _rows(self, start: dict, end: dict | None) -> Iterator[tuple]:
        fetch = load_transport(self.transport)
        for resource in self.resources:
            first = start.get(resource, 0)
            records = fetch(resource, first)
            for i, record in enumerate(records if end is None else records[: max(0, end[resource] - first)], first):
                yield resource, 0, i, json.dumps(record, sort_keys=True)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(self._rows(start, None))
        read = {r: sum(row[0] == r for row in rows) for r in self.resources}
        return iter(rows), {r: start.get(r, 0) + n for r, n in read.items()}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start, end)


def search_paths(hits: DataFrame, limit: int = MAX_RESULTS) -> DataFrame:
    """Distinct paths of each query's hits in the order they came, ``limit`` at most.

    hits: query, ord, path.
    """
    first = hits.groupBy("query", "path").agg(F.min("ord").alias("ord"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("ord", "path"))).filter(F.col("n") <= limit)


def contents(wanted: DataFrame, files: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """``wanted`` (path, ref) with content: of ``files``, else of ``fallback``, else ''. An empty
    file is a file, so it isn't looked up elsewhere."""
    found = wanted.join(files.select("path", "ref", "content"), ["path", "ref"], "left")
    if fallback is not None:
        other = fallback.select("path", "ref", F.col("content").alias("other"))
        found = found.join(other, ["path", "ref"], "left").withColumn("content", F.coalesce("content", "other")).drop("other")
    return found.withColumn("content", F.coalesce("content", F.lit("")))


def latest_versions(versions: DataFrame, by: str) -> DataFrame:
    """The version of the largest id of each request."""
    return versions.groupBy(by).agg(F.max_by(F.struct(*[c for c in versions.columns if c != by]), "id").alias("v")).select(by, "v.*")


def ndjson(rows: DataFrame) -> DataFrame:
    """One JSON line a row, for a text sink."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def ndjson_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The stream of the JSON lines that come to a folder. Lines without a type, and those that are
    no JSON, go. schema: that of a line, type among its fields."""
    return spark.readStream.text(folder).select(F.from_json("value", schema).alias("row")).filter("row.type is not null").select("row.*")


def write_each(rows: DataFrame, send: Callable[[dict], None]) -> DataFrame:
    """The rows with ok and error: each is sent on its own, and a failure stops no other."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for record in batch.to_dict("records"):
                try:
                    send(record)
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  a failure is a result here
                    errors.append(str(error))
            yield batch.assign(ok=[e is None for e in errors], error=pd.Series(errors, dtype=object, index=batch.index))

    return rows.mapInPandas(write, f"{fields}, ok boolean, error string")


def sync_counts(outcomes: DataFrame) -> DataFrame:
    """attempted, posted, deleted, outdated and failed of outcomes (action, ok)."""
    done = lambda action: F.count_if((F.col("action") == action) & F.col("ok"))
    return outcomes.agg(
        F.count_if(F.col("action") == "post").alias("attempted"),
        done("post").alias("posted"),
        done("delete").alias("deleted"),
        done("outdate").alias("outdated"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


def waiting_ms(error: Exception, attempt: int, base_ms: int = 1000, now: float | None = None) -> int:
    """How long to wait before the next attempt: what the host asks for, in seconds or until a date, else the base
    doubled with each attempt. ``error.headers`` may hold retry-after."""
    headers = getattr(error, "headers", None) or {}
    asked = next((str(v) for k, v in dict(headers).items() if str(k).lower() == "retry-after" and v not in (None, "")), None)
    if asked is not None:
        try:
            seconds = float(asked)
            if 0 <= seconds < float("inf"):
                return int(seconds * 1000 + 0.5)
        except ValueError:
            try:
                return max(0, round((parsedate_to_datetime(asked).timestamp() - (time.time() if now is None else now)) * 1000))
            except (TypeError, ValueError):
                pass
    return base_ms * 2**attempt


def generated(
    prompts: DataFrame, generate: Callable[[str], dict], retries: int = 2, retryable: Callable[[Exception], bool] = lambda e: True, base_ms: int = 1000, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """``prompts`` (key, prompt) with a model's content, tokens and error; the model is given. A failed call is made
    again after the wait that its error asks for."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                answer, error = {}, None
                for attempt in range(retries + 1):
                    try:
                        answer, error = generate(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                        if not retryable(e):
                            break
                        if attempt < retries:
                            sleep(waiting_ms(e, attempt, base_ms) / 1000)
                rows.append((answer.get("content"), int(answer.get("prompt_tokens", 0)), int(answer.get("completion_tokens", 0)), error))
            out = pd.DataFrame(rows, columns=["content", "prompt_tokens", "completion_tokens", "error"], index=batch.index)
            yield pd.concat([batch[["key"]], out.astype({"content": object, "error": object})], axis=1)

    return prompts.select("key", "prompt").mapInPandas(call, "key string, content string, prompt_tokens long, completion_tokens long, error string")
