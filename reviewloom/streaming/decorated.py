"""What readers of a review's progress are told: each event with what was last known, beats between events, and
cards of agents and runs; in batch over all events, and as streams with typed state, timers and a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reviewloom.functions.text import short_path
from reviewloom.streaming.progress import percent

#: Milliseconds between beats, and how long a request without events is remembered.
BEAT_MS, FORGET_MS = 10_000, 3_600_000
LOGS_KEPT, COMMENTS_KEPT, EVENTS_KEPT = 4, 30, 60
# Stages whose events show progress, by what they show; the end of a run.
NONE_DONE, SOME_DONE = ("diff_filtered", "review_started"), (
    "file_review_started", "agent_review_started", "agent_review_completed", "agent_review_failed", "file_review_completed", "file_review_failed",
)
# How agents stand.
WAITING, RUNNING, DONE, FAILED = "等待执行", "运行中", "已完成", "失败"
AGENT_STATES = (("agent_review_started", RUNNING), ("agent_review_completed", DONE), ("agent_review_failed", FAILED))
AGENT_NAMES = (("correctness", "Correctness Agent"), ("security", "Security Agent"), ("regression", "Regression Agent"))


def _shown(stage: Column, completed: Column, total: Column, known_completed: Column, known_total: Column) -> tuple[Column, Column]:
    """current and total of the progress that an event of a stage shows; null for stages that show none."""
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit(0)) for x in c], F.lit(0))
    current = (
        F.when(stage.isin(*NONE_DONE), 0)
        .when(stage.isin(*SOME_DONE), completed)
        .when(stage == "posting_comments", some(known_completed, total))
        .when(stage == "comments_posted", some(known_total, total))
        .when(stage == "completed", total)
    )
    return current, F.when(stage == "comments_posted", some(known_total, total)).otherwise(total)


def decorated(events: DataFrame, by: str = "request_id") -> DataFrame:
    """``events`` with total_files, completed_files and current_path as last known at each, and the percent it shows.

    An event's own counts come first, else those that the request's earlier events left; counts below zero are
    shown but not remembered. review_started forgets what was completed. events: by, seq, stage, total, completed, path.
    """
    order = Window.partitionBy(by).orderBy("seq")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    valid = lambda c: F.when(F.col(c) >= 0, F.col(c))
    runs = events.withColumn("run", F.coalesce(F.count_if(F.col("stage") == "review_started").over(before), F.lit(0)))
    in_run = Window.partitionBy(by, "run").orderBy("seq")
    total_before, total_after = (F.coalesce(F.last(valid("total"), ignorenulls=True).over(w), F.lit(0)) for w in (before, upto))
    done_before = F.coalesce(F.last(valid("completed"), ignorenulls=True).over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = runs.withColumns(
        {
            "total_files": F.coalesce("total", total_before),
            "known_total": total_after,
            "completed_files": F.coalesce("completed", done_before),
            "known_completed": F.when(F.col("stage") == "review_started", 0).otherwise(F.coalesce(valid("completed"), done_before)),
            "current_path": F.last("path", ignorenulls=True).over(upto),
        }
    )
    current, total = _shown(F.col("stage"), F.col("completed_files"), F.col("total_files"), F.col("known_completed"), F.col("known_total"))
    return known.withColumn("percent", F.when(current.isNotNull(), percent(current, total))).drop("run")


def beat_message(completed: Column, total: Column, path: Column) -> Column:
    """What a beat says of the files that are done, and of the one at hand while some are left."""
    counted = F.when(total > 0, F.concat(F.lit("，已完成 "), completed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" 个文件")))
    left = (F.when(total > 0, completed).otherwise(0)) < F.when(total > 0, total).otherwise(F.lit(1 << 53))
    at = F.when(path.isNotNull() & left, F.concat(F.lit("，当前 "), short_path(path)))
    return F.concat(F.lit("⏳ AI Review 进行中"), F.coalesce(counted, F.lit("")), F.coalesce(at, F.lit("")))


def beats(events: DataFrame, ticks: DataFrame, by: str = "request_id") -> DataFrame:
    """For each tick (by, ts) what a beat says then: the state that the last event up to it left. One running window over
    events and ticks together. events: of ``decorated``, with ts."""
    kept = [by, "ts", "seq", "known_total", "known_completed", "current_path"]
    state = F.when(F.col("seq").isNotNull(), F.struct("known_total", "known_completed", "current_path"))
    both = events.select(*kept).unionByName(ticks.select(by, "ts"), allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy("ts", F.col("seq").isNull().cast("int"), "seq").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("s", F.last(state, ignorenulls=True).over(order)).filter("seq is null")
    total, done = F.coalesce("s.known_total", F.lit(0)), F.coalesce("s.known_completed", F.lit(0))
    return found.select(by, "ts", beat_message(done, total, F.col("s.current_path")).alias("message"), percent(done, total).alias("percent"))


STATE = "total long, completed long, path string"
TOLD = "request_id long, seq long, stage string, total_files long, completed_files long, current_path string, known_total long, known_completed long"


class Decoration(StatefulProcessor):
    """A request's progress as a stream: its events with what was last known, and beats while none come.

    The state is one row a request, forgotten when nothing has been said for ``forget_ms``. A timer beats every
    ``beat_ms`` from the first event to the run's end; beats have no seq, and heartbeat as stage."""

    def __init__(self, beat_ms: int = BEAT_MS, forget_ms: int = FORGET_MS) -> None:
        self.beat_ms, self.forget_ms = beat_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", STATE, ttlDurationMs=self.forget_ms)

    def _known(self) -> tuple[int, int, str | None]:
        return tuple(self.state.get()) if self.state.exists() else (0, 0, None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, done, path = self._known()
        told, ended = [], False
        own = lambda x: None if pd.isna(x) else int(x)
        for seq, stage, given_total, given_done, given_path in _in_order(rows):
            shown_total, shown_done = own(given_total), own(given_done)
            shown_total, shown_done = total if shown_total is None else shown_total, done if shown_done is None else shown_done
            total, done = shown_total if shown_total >= 0 else total, shown_done if shown_done >= 0 else done
            path = path if pd.isna(given_path) else given_path
            done = 0 if stage == "review_started" else done
            ended = stage in ("completed", "failed")
            told.append((key[0], seq, stage, shown_total, shown_done, path, total, done))
        self.state.update((total, done, path))
        beating = list(self.handle.listTimers())
        if ended:
            for at in beating:
                self.handle.deleteTimer(at)
        elif not beating:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.beat_ms)
        yield _frame(told)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return  # forgotten: the last beat was the last
        total, done, path = self._known()
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.beat_ms)
        yield _frame([(key[0], None, "heartbeat", total, done, path, total, done)])

    def close(self) -> None:
        pass


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    return zip(*(rows[c] for c in ("seq", "stage", "total", "completed", "path")), strict=True)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in TOLD.split(", ")])
    return frame.astype({"seq": "Int64"})


def stream_decorated(events: DataFrame, beat_ms: int = BEAT_MS, forget_ms: int = FORGET_MS) -> DataFrame:
    """``decorated`` for a stream of events (request_id, seq, stage, total, completed, path), with beats between.

    Timers go by processing time, so a query of it runs until it is stopped. Needs the RocksDB state store."""
    return events.groupBy("request_id").transformWithStateInPandas(Decoration(beat_ms, forget_ms), TOLD, outputMode="Append", timeMode="ProcessingTime")


# -- the latest head of a busy key


def next_head(active: str | None, pending: str | None, kind: str, head: str | None, ok: bool) -> tuple[str | None, str | None, str | None]:
    """active and pending head of a key after an event, and why the active one starts, if it does.

    An arrival replaces the pending head, and starts it where nothing runs. When a run ends well and no other head came, the
    key is idle; else the pending head starts. A failed run's head is still pending, so it starts again unless a later one came."""
    if kind == "arrival":
        return (head, head, "arrival") if active is None else (active, head, None)
    if active is None:
        return None, pending, None
    if ok and pending == active:
        return None, None, None
    return pending, pending, "retry" if pending == active else "follow_up"


STARTS = "key string, seq long, head string, why string"


def coalesced_heads(events: DataFrame) -> DataFrame:
    """key, seq, head, why: the runs that arrivals and ends of runs start, each key's one after the other.

    events: key, seq, kind (arrival or end), head (of arrivals), ok (of ends). Rows are dealt by key and sorted, and one
    pass over each task's rows holds two heads of one key, however many events a key has."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, active, pending = None, None, None
        for batch in batches:
            started = []
            for key, seq, kind, head, ok in zip(*(batch[c] for c in ("key", "seq", "kind", "head", "ok")), strict=True):
                if key != now:
                    now, active, pending = key, None, None
                active, pending, why = next_head(active, pending, kind, head, bool(ok))
                if why:
                    started.append((key, seq, active, why))
            yield pd.DataFrame(started, columns=["key", "seq", "head", "why"])

    rows = events.select(F.col("key").cast("string").alias("key"), "seq", "kind", "head", F.coalesce("ok", F.lit(True)).alias("ok")).filter("key is not null")
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(fold, STARTS)


class Coalescing(StatefulProcessor):
    """``coalesced_heads`` for a stream: two heads are a key's state, forgotten after ``forget_ms`` without events."""

    def __init__(self, forget_ms: int = FORGET_MS) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("heads", "active string, pending string", ttlDurationMs=self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active, pending = self.state.get() if self.state.exists() else (None, None)
        started = []
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, kind, head, ok in zip(*(batch[c] for c in ("seq", "kind", "head", "ok")), strict=True):
            active, pending, why = next_head(active, pending, kind, head, pd.isna(ok) or bool(ok))
            if why:
                started.append((key[0], int(seq), active, why))
        self.state.update((active, pending))
        yield pd.DataFrame(started, columns=["key", "seq", "head", "why"])

    def close(self) -> None:
        pass


def stream_heads(events: DataFrame, forget_ms: int = FORGET_MS) -> DataFrame:
    """``coalesced_heads`` for a stream; events of a batch are taken in the order of their seq."""
    return events.groupBy("key").transformWithStateInPandas(Coalescing(forget_ms), STARTS, outputMode="Append", timeMode="ProcessingTime")


# -- cards


def agent_cards(events: DataFrame, by: str = "request_id") -> DataFrame:
    """by, agent_id, label, status, current_path, completed_segments, comment_count, failures, prompt_tokens,
    completion_tokens, total_tokens, logs (4, newest first), comments (30, the newest event's first).

    Agents that review_started names wait until they say something. Of logs and comments only the newest of each task's
    share are shuffled. events: by, seq, stage, agent_id, agent_label, path, message, comments (array), comment_count,
    prompt_tokens, completion_tokens, agents (array).
    """
    named = events.filter("stage = 'review_started'").select(by, F.explode("agents").alias("agent_id")).distinct()
    said = events.filter(F.coalesce("agent_id", F.lit("")) != "")
    done = F.col("stage") == "agent_review_completed"
    status = F.lit(None).cast("string")
    for stage, word in AGENT_STATES:
        status = F.when(F.col("stage") == stage, word).otherwise(status)
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c)
    counted = said.groupBy(by, "agent_id").agg(
        last(given("agent_label")).alias("label"), last(status).alias("status"), last(given("path")).alias("current_path"), F.count_if(done).alias("completed_segments"), total("comment_count"),
        F.count_if(F.col("stage") == "agent_review_failed").alias("failures"), total("prompt_tokens"), total("completion_tokens"),
    )
    logs = _newest(said.filter(given("message").isNotNull()).select(by, "agent_id", "seq", F.lit(0).alias("at"), F.col("message").alias("x")), by, LOGS_KEPT, "logs")
    comments = _newest(said.filter(done).select(by, "agent_id", "seq", F.posexplode("comments").alias("at", "x")), by, COMMENTS_KEPT, "comments")
    key, none = [by, "agent_id"], F.expr("cast(array() as array<string>)")
    cards = counted.join(named, key, "full").join(logs, key, "left").join(comments, key, "left")
    name = F.col("agent_id")
    for agent, label in AGENT_NAMES:
        name = F.when(F.lower("agent_id") == agent, label).otherwise(name)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return cards.select(
        *key, F.coalesce("label", name).alias("label"), F.coalesce("status", F.lit(WAITING)).alias("status"), F.coalesce("current_path", F.lit("-")).alias("current_path"),
        *[zero(c).alias(c) for c in ("completed_segments", "comment_count", "failures", "prompt_tokens", "completion_tokens")],
        (zero("prompt_tokens") + zero("completion_tokens")).alias("total_tokens"), F.coalesce("logs", none).alias("logs"), F.coalesce("comments", none).alias("comments"),
    )


def _newest(rows: DataFrame, by: str, keep: int, name: str) -> DataFrame:
    """The newest entries x of each agent as an array; of one event in their order."""
    order = Window.partitionBy(by, "agent_id").orderBy(F.col("seq").desc(), "at")
    best = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
    return best.groupBy(by, "agent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda e: e["x"]).alias(name))


def run_cards(events: DataFrame, by: str = "request_id") -> DataFrame:
    """by, status, note, progress, latest_stage, conclusion, reviewed_files, comment_count, prompt_tokens, completion_tokens,
    total_tokens, n_events: how each run stands, by the last that was said of each, zeros not counting as said.

    events: by, seq, stage, message, percent, conclusion, reviewed_files, comment_count, prompt_tokens, completion_tokens, total_tokens.
    """
    last = lambda c, when=None: F.max_by(c, F.when(c.isNotNull() if when is None else when, F.col("seq")))
    told = F.when(F.col("stage") == "completed", F.col("conclusion")).when(F.col("stage") == "failed", "执行失败")
    ended = F.col("stage").isin("completed", "failed")
    numbers = ("reviewed_files", "comment_count", "prompt_tokens", "completion_tokens", "total_tokens")
    return events.groupBy(by).agg(
        F.max_by(F.coalesce(told, F.lit(RUNNING)), "seq").alias("status"), last(F.nullif("message", F.lit(""))).alias("note"), last(F.col("percent")).alias("progress"),
        F.max_by("stage", "seq").alias("latest_stage"), last(told, ended).alias("conclusion"),
        *[F.coalesce(last(F.nullif(F.col(c), F.lit(0))), F.lit(0)).cast("long").alias(c) for c in numbers], F.least(F.count("*"), F.lit(EVENTS_KEPT)).alias("n_events"),
    )
