"""Readers to the last page, feeds that go on where they stopped, and writers that post once."""

import json
import os
import tempfile
import time
from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reviewloom.operators import payloads
from reviewloom.sources import hosting, writers

#: Where workers, which don't see this process's settings, read the folder of the present test.
POINTER = os.path.join(tempfile.gettempdir(), f"review-test-home-{os.getuid()}")


def home_folder():
    with open(POINTER) as pointer:
        return pointer.read()


def full_pages(resource: str, page: int):
    """Nine pages of a hundred records, by number."""
    return [{"n": (page - 1) * 100 + i} for i in range(100)], page < 9


def by_header(resource: str, cursor):
    """Three pages by a host's header: the next page's number, then nothing; or cursors that are no numbers."""
    if resource == "tokens":
        return [{"at": cursor}], {1: "aa", "aa": "bb"}.get(cursor)
    return [{"at": cursor}], {1: "2", 2: "3", 3: ""}[cursor]


def stuck(resource: str, cursor):
    return [{"at": cursor}], "1"


def count_of(resource: str):
    return {"known": 9}.get(resource)


def read(spark, **options):
    spark.dataSource.register(hosting.PagedSource)
    return spark.read.format("paged").options(**options).load()


def test_pages_are_read_to_the_last(spark):
    rows = read(spark, resources="diffs,", transport=f"{__name__}:full_pages")
    assert rows.count() == 900
    found = [int(json.loads(r["record"])["n"]) for r in rows.orderBy("ord").collect()]
    assert found == list(range(900))
    assert read(spark, resources="diffs", transport=f"{__name__}:full_pages", pages="5").count() == 500


def test_known_pages_are_read_apart(spark):
    rows = read(spark, resources="known,other", transport=f"{__name__}:full_pages", counts=f"{__name__}:count_of")
    assert rows.rdd.getNumPartitions() == 10 and rows.count() == 1800
    assert [json.loads(r["record"])["n"] for r in rows.filter("resource = 'known'").orderBy("page", "ord").collect()] == list(range(900))


def test_cursors_of_headers(spark):
    rows = read(spark, resources="numbers,tokens,empty".replace(",empty", ""), transport=f"{__name__}:by_header")
    assert [(r["resource"], r["page"], json.loads(r["record"])["at"]) for r in rows.orderBy("resource", "page").collect()] == [
        ("numbers", 1, 1), ("numbers", 2, 2), ("numbers", 3, 3), ("tokens", 1, 1), ("tokens", 2, "aa"), ("tokens", 3, "bb"),
    ]
    assert read(spark, resources="x", transport=f"{__name__}:stuck").count() == 1


def feed(resource: str, offset: int):
    with open(os.path.join(home_folder(), "feed")) as lines:
        return [json.loads(x) for x in lines][offset:]


@pytest.fixture
def home(tmp_path):
    with open(POINTER, "w") as pointer:
        pointer.write(str(tmp_path))
    return tmp_path


def test_webhooks_as_a_stream(spark, home):
    """A restarted stream goes on where it stopped."""
    spark.dataSource.register(hosting.PagedSource)
    schema = "action string, n int"

    def run(wanted):
        rows = spark.readStream.format("paged").options(resources="hook", transport=f"{__name__}:feed").load()
        rows = rows.select(F.from_json("record", schema).alias("r")).select("r.*").filter("action in ('open', 'update')")
        query = rows.writeStream.format("json").option("path", str(home / "out")).option("checkpointLocation", str(home / "cp")).trigger(processingTime="0.3 seconds").start()
        found = lambda: sorted(r["n"] for r in spark.read.schema(schema).json(str(home / "out")).collect()) if (home / "out").exists() else []
        try:
            end = time.time() + 60
            while time.time() < end and len(found()) < wanted:
                assert query.isActive, query.exception()
                time.sleep(0.3)
            time.sleep(1)
            return found()
        finally:
            query.stop()

    (home / "feed").write_text("\n".join(json.dumps({"action": a, "n": i}) for i, a in enumerate(["open", "close", "update"])))
    assert run(2) == [0, 2]
    with (home / "feed").open("a") as lines:
        lines.write("\n" + json.dumps({"action": "open", "n": 3}))
    assert run(3) == [0, 2, 3]


class Client:
    """A host in a folder: a file a post. Lines above 100 are refused, and bodies that say so."""

    def __init__(self):
        self.home = home_folder()

    def _log(self, name, row):
        with open(os.path.join(self.home, name), "a") as log:
            log.write(json.dumps(row) + "\n")

    def posted(self, resource):
        path = os.path.join(self.home, "posts")
        return [r["body"] for r in map(json.loads, open(path)) if r["resource"] == resource] if os.path.exists(path) else []

    def post(self, resource, body, anchor):
        if "refused" in body or (anchor and anchor[1] > 100):
            raise ValueError("no such line")
        self._log("posts", {"resource": resource, "body": body, "anchor": anchor})

    def delete(self, resource, note_id):
        if note_id == "13":
            raise ValueError("not found")
        self._log("deleted", note_id)

    def outdate(self, resource, note_id, body):
        self._log("outdated", [note_id, body])

    def status(self, resource, body):
        self._log("states", [resource, body])

    def committed(self, counts):
        self._log("counts", counts)


def make_client():
    return Client()


def logged(home, name):
    return [json.loads(x) for x in (home / name).read_text().splitlines()] if (home / name).exists() else []


def send(spark, rows):
    spark.dataSource.register(writers.ReviewSink)
    rows.write.format("review").option("client", f"{__name__}:make_client").mode("append").save()


NEW = "resource string, path string, line int, side string, body string"
NOTES = "resource string, discussion_id long, note_id long, is_system boolean, body string, author string"


def test_sync_posts_once_and_falls_back(spark, home):
    new = spark.createDataFrame([("r", "a.ts", 1, "RIGHT", "one"), ("r", "a.ts", 1, "RIGHT", "one"), ("r", "a.ts", 500, "RIGHT", "far"), ("r", "b.ts", 2, "LEFT", "refused"), ("s", "a.ts", 1, "RIGHT", "one")], NEW)
    mark = "<!-- ai-review:mr -->"
    from reviewloom.operators import comments

    ours = comments.MARKER
    notes = spark.createDataFrame(
        [("r", 1, 11, False, f"{ours}\nold", "bot"), ("r", 1, 12, True, "system", "x"), ("r", 2, 13, False, f"{ours}\nold", "bot"), ("r", 3, 14, False, f"{ours}\nold", "bot"), ("r", 3, 15, False, "answer", "dev"), ("r", 4, 16, False, f"{ours} {mark}", "dev")], NOTES
    )
    users = spark.createDataFrame([("bot",)], "login string")
    actions = writers.sync_actions(new, notes, users)
    assert sorted((r["action"], r["note_id"]) for r in actions.collect() if r["action"] != "post") == [("delete", "11"), ("delete", "13"), ("outdate", "14")]
    send(spark, actions)
    assert logged(home, "counts") == [{"attempted": 4, "posted": 3, "skipped": 0, "deleted": 1, "outdated": 1, "stated": 0, "failed": 2}]
    posts = sorted((p["resource"], p["body"].split("<!-- review-key")[0], p["anchor"]) for p in logged(home, "posts"))
    assert posts == [("r", f"{ours}\na.ts:500\n\nfar\n", None), ("r", f"{ours}\none\n", ["a.ts", 1, "RIGHT"]), ("s", f"{ours}\none\n", ["a.ts", 1, "RIGHT"])]
    # the same plan again: nothing is posted twice
    send(spark, writers.sync_actions(new, notes.limit(0), users))
    assert logged(home, "counts")[1] == {"attempted": 4, "posted": 0, "skipped": 3, "deleted": 0, "outdated": 0, "stated": 0, "failed": 1}
    assert len(logged(home, "posts")) == 3
    # without a user all marked notes are ours
    assert writers.sync_actions(new, notes, users.limit(0)).filter("action <> 'post'").count() == 4


def test_a_failed_task_does_not_post_twice(spark, home):
    """A task dies after some posts; the next attempt posts the others only."""
    new = spark.createDataFrame([("r", "a.ts", i, "RIGHT", f"text {i}") for i in range(1, 7)], NEW).coalesce(1)
    actions = writers.sync_actions(new, spark.createDataFrame([], NOTES), spark.createDataFrame([], "login string")).coalesce(1).sortWithinPartitions("line")
    dies = actions.withColumn("body", F.when(F.col("line") == 4, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("body")))
    with pytest.raises(PySparkException):
        send(spark, dies)
    assert logged(home, "counts") == [] and len(logged(home, "posts")) <= 3
    send(spark, actions)
    bodies = [p["body"] for p in logged(home, "posts")]
    assert len(bodies) == len(set(bodies)) == 6


def test_states_and_streams(spark, home):
    spark.dataSource.register(writers.ReviewSink)
    rows = spark.createDataFrame([("r", "status", None, None, None, None, "success", "k1"), ("r", "post", None, "a.ts", 1, "RIGHT", "one", "k2"), ("r", "walk", None, None, None, None, None, "k3")], writers.ACTIONS)
    send(spark, rows)
    assert logged(home, "states") == [["r", "success"]] and logged(home, "counts")[0]["failed"] == 1
    rows.write.json(str(home / "in"))
    stream = spark.readStream.schema(writers.ACTIONS).json(str(home / "in"))
    query = stream.writeStream.format("review").option("client", f"{__name__}:make_client").option("checkpointLocation", str(home / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    told = logged(home, "counts")[1:]
    assert sum(c["skipped"] for c in told) == 1 and sum(c["posted"] for c in told) == 0 and all("batch" in c for c in told)


def test_waits_that_hosts_ask_for(spark):
    now = datetime(2026, 1, 1, tzinfo=timezone.utc)
    error = lambda v: type("E", (Exception,), {"headers": {"Retry-After": v}})()
    asked = {"2.5": 2500, "0.0005": 1, "0": 0, "-1": 4000, "soon": 4000, "Thu, 01 Jan 2026 00:00:07 GMT": 7000, "Wed, 31 Dec 2025 00:00:00 GMT": 0, "": 4000, "inf": 4000}
    assert {k: hosting.waiting_ms(error(k), 2, now=now.timestamp()) for k in asked} == asked
    assert hosting.waiting_ms(ValueError(), 0) == 1000
    rows = spark.createDataFrame([(k,) for k in asked], "asked string")
    found = rows.select("asked", payloads.retry_delay_ms(F.col("asked"), F.lit(2), now=F.to_timestamp(F.lit("2026-01-01 00:00:00"))).alias("ms")).collect()
    assert {r["asked"]: r["ms"] for r in found} == asked


def test_generate_waits(spark, tmp_path):
    log = str(tmp_path / "waits")

    def generate(prompt):
        raise type("Busy", (Exception,), {"headers": {"retry-after": "3"}})("busy") if prompt == "a" else TimeoutError("late")

    def sleep(seconds):
        with open(log, "a") as out:
            out.write(f"{seconds}\n")

    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "key string, prompt string").coalesce(1)
    assert hosting.generated(rows, generate, sleep=sleep).count() == 2
    assert sorted(map(float, open(log).read().split())) == [1, 2, 3, 3]
