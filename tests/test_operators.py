"""Golden cases of the change-review operators."""

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import classify, clusters, comments, contracts, diff, filters, payloads, segments, symbols
from reviewloom.streaming import progress

PATCH = "noise\n@@ -1,1 +1,2 @@\n-old\n+new\n+more\n@@ -40 +41,0 @@ tail\n-gone\n\\ No newline\n\n--- a\n+++ b\n last\r\n"


@pytest.fixture(scope="module")
def patched(spark):
    return spark.createDataFrame([(1, PATCH), (2, ""), (3, "no header"), (4, "@@ -5,0 +9,3 @@")], "doc_id long, patch string")


def test_hunks(patched):
    rows = [tuple(r)[:-5] + tuple(r)[-4:] for r in diff.hunks(patched).orderBy("doc_id", "hunk_ix").collect()]
    assert rows == [(1, 0, 1, 1, 1, 2), (1, 1, 40, 1, 41, 0), (4, 0, 5, 0, 9, 3)]
    content = diff.hunks(patched).filter("doc_id = 1 and hunk_ix = 0").first()["content"]
    assert content == "@@ -1,1 +1,2 @@\n-old\n+new\n+more\n"


def test_lines(patched):
    rows = diff.lines(diff.hunks(patched))
    added = [(r["new_line"], r["text"]) for r in diff.touched_lines(rows).orderBy("hunk_ix", "line_ix").collect()]
    removed = [(r["old_line"], r["text"]) for r in diff.removed_lines(rows).orderBy("hunk_ix", "line_ix").collect()]
    assert added == [(1, "new"), (2, "more")] and removed == [(1, "old"), (40, "gone")]
    context = [(r["text"], r["old_line"], r["new_line"]) for r in rows.filter("kind = ' '").orderBy("line_ix").collect()]
    assert context == [("--- a", 41, 41), ("+++ b", 42, 42), (" last", 43, 43)]


def test_anchors_fall_back_to_hunk_edges(patched):
    hunks = diff.hunks(patched)
    found = {(r["doc_id"], r["anchor"]) for r in diff.anchors(hunks, diff.lines(hunks)).collect()}
    assert found == {(1, 1), (1, 2), (4, 8), (4, 9), (4, 11), (4, 12)}


def test_whitespace_only(spark):
    rows = [(1, "@@ -1,2 +1,2 @@\n-a b\n-c\n+ab\n+ c\t"), (2, "@@ -1,1 +1,1 @@\n-a\n+b"), (3, "@@ -1,1 +1,2 @@\n-a\n+a\n+"), (4, "@@ -1 +1,0 @@\n-a")]
    found = diff.whitespace_only(diff.lines(diff.hunks(spark.createDataFrame(rows, "doc_id long, patch string"))))
    assert [r["doc_id"] for r in found.collect()] == [1]


@pytest.mark.parametrize(
    ("path", "ignored", "documentation", "deployment"),
    [
        ("README.md", False, True, False),
        ("docs/deployment.md", False, True, True),
        (".github/workflows/release.yml", False, False, True),
        ("infra/production/main.tf", False, False, True),
        ("pnpm-lock.yaml", True, False, False),
        ("src/redist/x.ts", True, False, False),
        ("Dockerfile", False, False, True),
        ("a/Dockerfile", False, False, False),
        ("x.MD", False, True, False),
        ("a.PNG", False, False, False),
    ],
)
def test_paths(spark, path, ignored, documentation, deployment):
    p = F.lit(path)
    row = spark.range(1).select(filters.is_ignored(p), filters.is_documentation(p), filters.is_deployment(p)).first()
    assert tuple(row) == (ignored, documentation, deployment)


@pytest.mark.parametrize(
    ("path", "text", "kind"),
    [
        ("a.yml", "jobs:", "ci_pipeline"),
        ("a.yml", "x: 1", "app_config"),
        ("src/a.test.ts", "", "test"),
        ("readme", "", "docs"),
        ("config/.env.local", "", "app_config"),
        ("src/a.tsx", "", "react_component"),
        ("src/a.ts", "const [x] = usestate(0)", "react_component"),
        ("src/hooks/a.ts", "", "frontend_module"),
        ("src/api/a.ts", "", "backend_service"),
        ("src/a.ts", "", "backend_module"),
        ("a.go", "", "generic"),
    ],
)
def test_kinds(spark, path, text, kind):
    assert spark.range(1).select(classify.file_kind(F.lit(path), F.lit(text))).first()[0] == kind


def test_segments(spark):
    rows = [(1, i, s, 3) for i, s in enumerate((1, 27, 60, 70))] + [(2, i, i * 100, 1) for i in range(5)] + [(3, 0, 5, 1)]
    hunks = spark.createDataFrame(rows, "doc_id long, hunk_ix int, new_start int, new_lines int")
    found = {(r["doc_id"], r["hunk_ix"]): r["segment_ix"] for r in segments.review_segments(hunks).collect()}
    assert [found[1, i] for i in range(4)] == [0, 0, 1, 1] and {found[2, i] for i in range(5)} == {0} and found[3, 0] == 0


def test_run_segments(spark):
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(["a", "a", None, None, "a"])], "f int, n int, k string")
    assert [r["segment_ix"] for r in segments.run_segments(rows, "f", "n", "k").orderBy("n").collect()] == [0, 0, 1, 1, 2]


def test_json_recovery(spark):
    answers = {
        '{"comments": []}': '{"comments": []}',
        'so\n```json\n[{"line": 1}]\n```': '[{"line": 1}]',
        'a {"x": "}"} b': '{"x": "}"}',
        "b [1, 2] c": "[1, 2]",
        '{"a": "{"} {"b": 1}': '[{"a": "{"},{"b": 1}]',
        "{not-valid-json}": None,
        "": None,
    }
    rows = spark.createDataFrame([(k,) for k in answers], "content string")
    assert {r[0]: r[1] for r in rows.select("content", payloads.recovered_json(F.col("content"))).collect()} == answers


def test_one_bad_comment_spoils_a_payload(spark):
    rows = spark.createDataFrame([(1, '[{"line": 1, "body": " x "}, {"line": 0, "body": "y"}]'), (2, '{"comments": [{"line": "3", "body": "x", "side": "LEFT"}]}'), (3, '{"line": 1}')], "payload_id long, json string")
    assert [tuple(r) for r in payloads.payload_comments(rows).collect()] == [(2, 0, 3, "x", "LEFT")]


def test_outdated_body(spark):
    body = f"head {comments.MARKER} tail"
    once = spark.range(1).select(comments.outdated(F.lit(body)).alias("b"))
    first = once.first()["b"]
    assert first == f"{comments.MARKER}\n{comments.OUTDATED_MARKER}\n{comments.OUTDATED_NOTE}\n\nhead  tail"
    assert once.select(comments.outdated(F.col("b"))).first()[0] == first


def test_identifiers(spark):
    content = "+import { type A as B, run } from './x'\n+import def, { y } from 'z'\n+const v: Foo = run(new Foo())\n-gone()"
    rows = symbols.identifier_candidates(spark.createDataFrame([(1, content)], "doc_id long, content string"))
    found = {r["name"]: (r["score"], r["import_source"]) for r in rows.collect()}
    assert found == {"Foo": (6 + 7 + 2 * 2, None), "run": (10 + 6, "./x"), "def": (9, "z")}


def test_contracts(spark):
    fields = "module string, name string, kind string, required int, total int, rest boolean"
    base = spark.createDataFrame([("m", "a", "function", 2, 2, False), ("m", "b", "function", 1, 1, False), ("m", "c", "function", None, None, False), ("m", "d", "function", 1, 1, False)], fields)
    head = spark.createDataFrame([("m", "a", "function", 3, 3, False), ("m", "b", "value", None, None, False), ("m", "c", "function", None, None, False), ("m", "new", "function", 0, 0, False)], fields)
    changes = contracts.contract_changes(base, head)
    assert {(r["name"], r["change_type"]) for r in changes.collect()} == {("a", "signature_changed"), ("b", "kind_changed"), ("d", "removed")}
    uses = spark.createDataFrame([("x", "m", "a", 2, False), ("x", "m", "a", 3, False), ("y", "m", None, 1, False), ("y", "m", "b", 1, True)], "importer string, module string, symbol string, argc int, is_new boolean")
    affected = contracts.affected_imports(changes, uses)
    assert sorted((r["importer"], r["argc"]) for r in contracts.arity_mismatches(affected).collect()) == [("x", 2), ("y", 1)]
    assert sorted((r["importer"], r["usage"]) for r in contracts.kind_mismatches(affected).collect()) == [("y", "call"), ("y", "construct")]


def test_reexports_by_the_shortest_way(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g")], "source string, target string")
    found = {(r["source"], r["target"]): r["depth"] for r in contracts.reexport_closure(edges).collect()}
    assert found["a", "c"] == 1 and found["a", "f"] == 4 and ("a", "g") not in found and ("a", "a") not in found


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4), (4, 5), (5, 6)], "a long, b long")
    assert {tuple(r) for r in clusters.components(pairs).collect()} == {(i, 1) for i in range(1, 7)} | {(8, 8), (9, 8)}


def test_profile_of_agents(spark):
    agents = spark.createDataFrame([("correctness", 1), ("security", 2), ("regression", 3)], "agent_id string, place int")
    raw = spark.createDataFrame([(1, " Security,x,security "), (2, None), (3, "none")], "k long, agents string")
    found = sorted(tuple(r) for r in symbols.agent_profiles(raw, agents, "k").collect())
    assert found == [(1, "security", 1), (2, "correctness", 1), (2, "regression", 3), (2, "security", 2), (3, "correctness", 1)]


def test_percent_rounds_halves_up(spark):
    rows = spark.createDataFrame([(1, 8), (1, 0), (9, 8), (-1, 8)], "c int, t int").select(progress.percent(F.col("c"), F.col("t")))
    assert [r[0] for r in rows.collect()] == [13, None, 100, 0]


def test_progress_as_a_stream(spark, tmp_path):
    events = [(1, 1, "review_started", None), (1, 2, "file_review_completed", 4), (2, 1, "agent_review_started", 7), (1, 3, "agent_review_started", None), (1, 4, "review_started", 9)]
    batch = spark.createDataFrame(events, "request_id long, seq long, stage string, completed long")
    batch.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).json(str(tmp_path / "in"))
    query = progress.stream_carried(stream).writeStream.format("memory").queryName("carried").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = {(r["request_id"], r["seq"]): r["completed_so_far"] for r in spark.table("carried").collect()}
    assert found == {(r["request_id"], r["seq"]): r["completed_so_far"] for r in progress.carried(batch).collect()}


def test_risk_reads_files_once(spark):
    """One scan, and one exchange by request; the in-row forms say what the line tables do."""
    from reviewloom.operators import classify, diff
    from reviewloom.plans import review

    plan = review.cr_scale_risk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
    files = review._files(spark, "/root/testdata/sf0.001")
    odd = [(-1, "a b\n c", "@@ -1 +1 @@\n-a  b\n+ab\n"), (-2, "x", "@@ -1 +1 @@\n-a\n"), (-3, "y", ""), (-4, "z", "@@ -1,2 +1 @@\r\n-auth \r\n--- no\r\n+++ no\r\n\\ none\r\n+x\r\n@@ -9 +9 @@\n-where\n+ a b \n")]
    patches = files.select("doc_id", "path", "patch").unionByName(spark.createDataFrame(odd, "doc_id long, path string, patch string"))
    rows = diff.with_changes(patches)
    lines = diff.lines(diff.hunks(patches.select("doc_id", "patch")))
    kept = {r["doc_id"]: list(r["impacts"]) for r in classify.impacts(lines).collect()}
    blank = {r["doc_id"] for r in diff.whitespace_only(lines).collect()}
    counts = {r["doc_id"]: (r["added"], r["removed"]) for r in diff.changed_counts(lines).collect()}
    texts = {r["doc_id"]: r["diff_text"] for r in classify.diff_text(diff.hunks(patches.select("doc_id", "patch"))).collect()}
    found = rows.select("doc_id", "blank_only", F.size("added").alias("a"), F.size("removed").alias("r"), classify.impacts_of(F.col("added"), F.col("removed")).alias("i"), F.lower(F.array_join("hunk_texts", "\n")).alias("t")).collect()
    for r in found:
        d = r["doc_id"]
        assert list(r["i"]) == kept.get(d, []) and r["blank_only"] == (d in blank) and (r["a"], r["r"]) == counts.get(d, (0, 0)) and r["t"] == texts.get(d, ""), d
