"""Contexts of segments and what is told of structured files."""

import random
import time

from pyspark.sql import functions as F

from reviewloom.functions.scanner import key_lines
from reviewloom.operators import configs, contexts

ITEM = "doc_id int, kind string, name string, file string, content string, part int, ord long"
PROFILE = "doc_id int, functions int, types int, slices int, deleted_scopes int"


def kept_by_loops(items, limits):
    """Lists that take items one by one until they are full."""
    out = {}
    for d, kind, name, file, content, _, ord_ in sorted(items, key=lambda x: (x[0], x[5], x[6])):
        full = out.setdefault((d, kind), [])
        cap = dict(zip(("function", "type", "slice", "deleted"), limits[d], strict=True))[kind]
        same = (name, file) if kind in ("function", "type") else (name, file, content) if kind == "slice" else (name, file, ord_)
        if len(full) < cap and same not in [s for s, _ in full]:
            full.append((same, (name, file, content)))
    return sorted((d, kind, i + 1, *item) for (d, kind), full in out.items() for i, (_, item) in enumerate(full))


def test_limits_run_on_over_sources(spark):
    """Fifty segments: a source takes what the ones before left of each limit."""
    rng = random.Random(6)
    limits = {d: tuple(rng.randrange(4) for _ in range(4)) for d in range(50)}
    items, places = [], set()
    for _ in range(900):
        d, part, ord_ = rng.randrange(50), rng.randrange(1, 7), rng.randrange(40)
        if (d, part, ord_) not in places:
            places.add((d, part, ord_))
            items.append((d, rng.choice(["function", "type", "slice", "deleted"]), f"n{rng.randrange(5)}", rng.choice(["current", "a.ts"]), f"c{rng.randrange(3)}", part, ord_))
    made = contexts.within_limits(spark.createDataFrame(items, ITEM), spark.createDataFrame([(d, *x) for d, x in limits.items()], PROFILE), "doc_id")
    assert sorted(map(tuple, made.select("doc_id", "kind", "place", "name", "file", "content").collect())) == kept_by_loops(items, limits)


def test_remote_definitions_are_the_first_that_define(spark):
    """A segment's own file doesn't count among the hits, nor do hits beyond those that are looked at."""
    hits = [("go", f"f{i}", i) for i in range(8)] + [("run", "own", 0), ("run", "x", 1)]
    known = [("f3", "go", "function", "function go() {}"), ("f6", "go", "function", "late"), ("x", "run", "class", "class run {}"), ("own", "run", "class", "mine")]
    asked = [(1, "own", "go", 1, 4), (2, "own", "go", 1, 3), (3, "f3", "go", 1, 6), (4, "f3", "go", 1, 5), (5, "own", "run", 1, 1), (6, "other", "run", 1, 1), (7, "own", "none", 1, 5), (8, "own", "go", 1, 0)]
    found = contexts.remote_definitions(
        spark.createDataFrame(asked, "doc_id int, own_path string, name string, n int, results int"), spark.createDataFrame(hits, "name string, path string, n int"),
        spark.createDataFrame(known, "path string, name string, type string, text string"), "doc_id",
    )
    assert sorted((r["doc_id"], r["path"]) for r in found.collect()) == [(1, "f3"), (3, "f6"), (5, "x"), (6, "own")]


def test_a_long_yaml_file(spark):
    """100,000 lines, and keys nested as deep as that."""
    wide = "\n".join(f"job{i}:\n  stage: s{i % 7}\n  script:\n    - run {i}\n  needs: job{i - 1}" for i in range(20_000))
    deep = "\n".join(" " * min(i, 900) + f"k{i}: v" for i in range(3000))
    files = spark.createDataFrame([(1, wide), (2, deep), (3, None), (4, "- a\n# b: c\n")], "doc_id int, content string")
    touched = spark.createDataFrame([(1, 5), (1, 99_997), (2, 3), (4, 1)], "doc_id int, line int")
    began = time.time()
    lines = configs.yaml_lines(files, touched)
    jobs = {r["job"]: r for r in configs.yaml_jobs(lines).filter("doc_id = 1").collect()}
    paths = sorted((r["doc_id"], r["name"]) for r in configs.yaml_paths(files, touched).collect())
    assert time.time() - began < 60
    assert list(sorted(jobs)) == [f"job{i}" for i in range(6)] and jobs["job3"]["stage"] == "s3" and list(jobs["job3"]["needs"]) == ["job2"]
    assert paths == [(1, "job0.needs"), (1, "job19999.stage"), (2, "k0.k1.k2")]


def test_jobs_start_anew():
    """A key that stands again forgets what was below its first place, but keeps its place."""
    rows = list(key_lines("a:\n  when: x\nb: 1\na:\n  stage: y\r\n  stage:\n", [2, 5]))
    assert [(r[0], r[2], r[3], r[5], r[6], r[7]) for r in rows] == [(1, 1, 1, "a", "", None), (2, 2, 1, "when", "x", "a.when"), (3, 1, 3, "b", "1", None), (4, 1, 4, "a", "", None), (5, 2, 4, "stage", "y", "a.stage"), (6, 2, 4, "stage", "", None)]


def test_null_keys_have_jobs(spark):
    lines = configs.yaml_lines(spark.createDataFrame([(None, "a:\n  stage: s\n")], "doc_id int, content string"), spark.createDataFrame([], "doc_id int, line int"))
    assert [(r["job"], r["stage"]) for r in configs.yaml_jobs(lines).select("job", F.col("stage")).collect()] == [("a", "s")]
