"""Streams of progress and of heads, held against their batch forms."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from reviewloom.streaming import decorated

EVENTS = "request_id long, seq long, stage string, total long, completed long, path string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def stateful(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def put(folder, n, rows):
    """A file appears whole."""
    part = folder.parent / f"part-{n}"
    part.write_text("\n".join(json.dumps(r) for r in rows))
    part.rename(folder / f"{n}.json")


def until(query, name, spark, done, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        rows = spark.table(name).collect()
        if done(rows):
            return rows
        assert query.isActive, query.exception()
        time.sleep(0.5)
    raise AssertionError(f"not within {seconds} s: {spark.table(name).collect()}")


def started(spark, folder, tmp_path, name, schema, make):
    folder.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    return make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(processingTime="0.5 seconds").start()


ROWS = [
    (1, 1, "started", None, None, None), (1, 2, "diff_filtered", 9, None, None), (1, 3, "review_started", None, 5, None), (1, 4, "file_review_completed", None, 1, "a/b/c.ts"),
    (2, 5, "file_review_started", None, None, "x.ts"), (1, 6, "file_review_completed", -1, None, None), (1, 7, "review_started", None, None, None), (1, 8, "posting_comments", None, None, None),
    (2, 9, "failed", None, None, None),
]


def test_decorated_stream_beats_and_equals_batch(stateful, tmp_path):
    """Events come in two files; request 1 beats while nothing comes, request 2 has ended; the rows are those of the batch form."""
    spark, folder = stateful, tmp_path / "in"
    query = started(spark, folder, tmp_path, "decorated", EVENTS, lambda s: decorated.stream_decorated(s, beat_ms=1500))
    try:
        names = [c.split()[0] for c in EVENTS.split(", ")]
        rows = [dict(zip(names, r, strict=True)) for r in ROWS]
        put(folder, 1, rows[:5])
        until(query, "decorated", spark, lambda found: sum(r["seq"] is not None for r in found) == 5)
        put(folder, 2, rows[5:])
        # beats between the files may come too: those after the last event
        found = until(query, "decorated", spark, lambda found: sum(r["seq"] is not None for r in found) == 9 and sum(r["seq"] is None and r["known_completed"] == 0 for r in found) >= 2)
    finally:
        query.stop()
    batch = decorated.decorated(spark.createDataFrame(ROWS, EVENTS))
    columns = ["request_id", "seq", "stage", "total_files", "completed_files", "current_path", "known_total", "known_completed"]
    assert sorted(tuple(r) for r in found if r["seq"] is not None) == sorted(map(tuple, batch.select(*columns).collect()))
    beats = [tuple(r) for r in found if r["seq"] is None and r["known_completed"] == 0 and r["request_id"] == 1]
    assert (1, None, "heartbeat", 9, 0, "a/b/c.ts", 9, 0) in beats
    last = [r for r in found if r["request_id"] == 2 and r["seq"] == 9]
    assert len(last) == 1 and last[0]["current_path"] == "x.ts"


def test_state_is_forgotten(stateful, tmp_path):
    """A request that says nothing for longer than the time to live starts anew, and its beats end."""
    spark, folder = stateful, tmp_path / "in"
    query = started(spark, folder, tmp_path, "forgotten", EVENTS, lambda s: decorated.stream_decorated(s, beat_ms=60_000, forget_ms=3000))
    try:
        put(folder, 1, [{"request_id": 1, "seq": 1, "stage": "diff_filtered", "total": 9}])
        until(query, "forgotten", spark, lambda found: len(found) == 1)
        time.sleep(4)
        put(folder, 2, [{"request_id": 1, "seq": 2, "stage": "file_review_started"}])
        found = until(query, "forgotten", spark, lambda found: len(found) == 2)
    finally:
        query.stop()
    assert {r["seq"]: r["total_files"] for r in found} == {1: 9, 2: 0}


HEADS = "key string, seq long, kind string, head string, ok boolean"


def arrivals(n=300, keys=6):
    rng = random.Random(2)
    return [(f"k{rng.randrange(keys)}", i, kind, f"h{rng.randrange(4)}" if kind == "arrival" else None, rng.random() > 0.2) for i in range(n) for kind in [rng.choice(["arrival", "arrival", "end"])]]


def coordinator(rows):
    """The keys' state kept in dictionaries, event by event."""
    pending, active, out = {}, {}, []
    for key, seq, kind, head, ok in rows:
        if kind == "arrival":
            pending[key] = head
            if key not in active:
                active[key] = head
                out.append((key, seq, head, "arrival"))
        elif key in active:
            ran = active.pop(key)
            if ok and pending[key] == ran:
                del pending[key]
            else:
                active[key] = pending[key]
                out.append((key, seq, pending[key], "retry" if pending[key] == ran else "follow_up"))
    return out


def test_heads_of_busy_keys(spark):
    rows = arrivals()
    table = spark.createDataFrame(rows, HEADS).repartition(5)
    assert sorted(map(tuple, decorated.coalesced_heads(table).collect())) == sorted(coordinator(rows))
    one = [("k", i, "arrival", f"h{i}", True) for i in range(50)] + [("k", 50, "end", None, True), ("k", 51, "end", None, None), ("k", 52, "end", None, True), (None, 1, "arrival", "x", True)]
    assert list(map(tuple, decorated.coalesced_heads(spark.createDataFrame(one, HEADS)).orderBy("seq").collect())) == [("k", 0, "h0", "arrival"), ("k", 50, "h49", "follow_up")]
    assert decorated.coalesced_heads(spark.createDataFrame([], HEADS)).count() == 0


def test_heads_as_a_stream(stateful, tmp_path):
    spark, folder, rows = stateful, tmp_path / "in", arrivals(90, 3)
    query = started(spark, folder, tmp_path, "heads", HEADS, decorated.stream_heads)
    wanted = sorted(coordinator(rows))
    try:
        for n in range(3):
            put(folder, n, [dict(zip(["key", "seq", "kind", "head", "ok"], r, strict=True)) for r in rows[n * 30 : n * 30 + 30]])
            upto = coordinator(rows[: n * 30 + 30])
            found = until(query, "heads", spark, lambda got: len(got) >= len(upto))
    finally:
        query.stop()
    assert sorted(map(tuple, found)) == wanted


def test_beats_of_odd_states(spark):
    rows = [(1, 0, 0, None), (2, 0, 5, "a/b/c.ts"), (3, 5, 5, "a/b/c.ts"), (4, 7, 0, "c.ts"), (5, -2, 4, "x/y/z/c.ts")]
    table = spark.createDataFrame(rows, "i int, done long, total long, path string")
    found = [r[0] for r in table.orderBy("i").select(decorated.beat_message(F.col("done"), F.col("total"), F.col("path"))).collect()]
    head = "⏳ AI Review 进行中"
    assert found == [head, f"{head}，已完成 0/5 个文件，当前 b/c.ts", f"{head}，已完成 5/5 个文件", f"{head}，当前 c.ts", f"{head}，已完成 -2/4 个文件，当前 z/c.ts"]


def test_cards_without_events(spark):
    events = spark.createDataFrame(
        [(1, 1, "review_started", None, None, None, "hello", None, None, None, None, ["security", "new"])],
        "request_id long, seq long, stage string, agent_id string, agent_label string, path string, message string, comments array<string>, comment_count long, prompt_tokens long, completion_tokens long, agents array<string>",
    )
    cards = {r["agent_id"]: r for r in decorated.agent_cards(events).collect()}
    assert {a: (r["label"], r["status"], r["current_path"], r["total_tokens"], r["logs"]) for a, r in cards.items()} == {"security": ("Security Agent", "等待执行", "-", 0, []), "new": ("new", "等待执行", "-", 0, [])}
    assert decorated.agent_cards(events.limit(0)).count() == 0
