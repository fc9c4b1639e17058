"""What keeps queries in proportion to their tables: the shape of their plans, beside the same results."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators import classify, clusters, diff, modules, payloads, prompts
from reviewloom.plans import review, sources


def plan_of(frame: DataFrame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_aliases_reach_python_by_batches(spark):
    """No call of Python a file; each file's rows keep their own order, whatever order they come in."""
    known = spark.createDataFrame(
        [(f, x, "a", m, ns, None, n, n) for f in ("f", "g", None) for x, m, ns, n in (("one", "m1", False, 1), ("all", "m3", True, 3), ("all", "m2", True, 2))][::-1],
        "path string, local string, symbol string, module string, namespace boolean, member string, line long, ord long",
    ).repartition(3)
    given = spark.createDataFrame([("g", "q", None, "none", 6, 6), ("g", "p", None, "one", 5, 5), ("g", "r", None, "one", 4, 4), ("h", "x", None, "one", 1, 1)], "path string, name string, member string, expression string, line long, ord long")
    whole = known.withColumn("symbol", F.expr("if(namespace, null, symbol)"))
    made = modules.binding_aliases(whole, given)
    assert "FlatMapGroupsInPandas" not in plan_of(made)
    rows = sorted((r["path"] or "", r["ord"], r["local"], r["module"], r["symbol"]) for r in made.collect())
    base = [(0, "one", "m1", "a"), (1, "all", "m2", None), (2, "all", "m3", None)]
    assert rows == [(f, *b) for f in ("", "f", "g") for b in base + ([(3, "r", "m1", "a"), (4, "p", "m1", "a")] if f == "g" else [])]


def _changed_files(spark) -> DataFrame:
    """Files of few classes and of many: numbered folders, folders in folders, the root, repeats, none of either words."""
    shapes = ("src/a/f_{}.ts", "src/a/b/f.ts", "src/a/b/c/f.ts", "x_{}/y.ts", "root.ts", "pkg/p_{}/lock.yaml", "pkg/lock.yaml", "src/hooks/use_doc_{}.ts", "z")
    rows = [(None if i == 60 else i % 3, i, shapes[i * 7 % 9].format(100 + i), [f"S{(i + k) % 11}" for k in range(i % 4)]) for i in range(90)]
    return spark.createDataFrame(rows, "cr_id int, doc_id long, path string, symbols array<string>").withColumn("path_tokens", clusters.path_tokens(F.col("path")))


def _related(files: DataFrame) -> set[tuple]:
    rows, up = [r.asDict() for r in files.withColumn("dir", clusters.directory(F.col("path"))).collect()], lambda d: d.rpartition("/")[0] or "."
    made = set()
    for a in rows:
        for b in rows:
            if a["doc_id"] < b["doc_id"] and a["cr_id"] == b["cr_id"] is not None:
                paths, symbols = (len(set(a[c]) & set(b[c])) for c in ("path_tokens", "symbols"))
                if paths >= 2 or symbols >= 2 or symbols == 1 and (a["dir"] == b["dir"] or a["dir"] == up(b["dir"]) or b["dir"] == up(a["dir"])):
                    made.add((a["cr_id"], a["doc_id"], b["doc_id"], paths, symbols))
    return made


def test_related_pairs_are_not_shuffled(spark):
    """Pairs are made in the rows of their classes, so no exchange deals them; they are those of all pairs looked at."""
    files = _changed_files(spark)
    made = clusters.related_pairs(files)
    assert {tuple(r) for r in made.collect()} == _related(files) and made.count() == len(_related(files)) > 150
    assert not any("other" in keys for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan_of(made)))


def test_links_of_components_grow_with_files(spark):
    """As many links as files hold, not as many as pairs, and the same components."""
    files = _changed_files(spark)
    links = clusters.related_links(files)
    pairs = spark.createDataFrame([(a, b) for _, a, b, *_ in _related(files)], "a long, b long")
    assert {tuple(r) for r in clusters.components(links).collect()} == {tuple(r) for r in clusters.components(pairs).collect()}
    same = files.filter("doc_id = 0").select(F.lit(1).alias("cr_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(299).cast("long"))).alias("doc_id"), "path", "path_tokens", "symbols")
    assert clusters.related_links(same).count() == 299


SF = "/root/testdata/sf0.001"


def test_snippets_are_made_once(spark):
    """A snippet's expressions stand once in its plan, and its lines are told by a length, not listed."""
    rows = spark.createDataFrame([(1, 1, "l", "a {  \n  b\t\n\n\n\nc" + " x \u0085\n" * 90, 900)], "key int, ord int, label string, body string, preferred int")
    made = rows.select(prompts.compacted(F.col("body"), F.lit(40)).alias("t"))
    assert plan_of(made).count("regexp_replace(") <= 3
    assert made.first()["t"] == "a {\n  b\n\nc x\u0085\n x\u0085\n x\u0085" + prompts.TRUNCATED
    assert prompts.packed_blocks(rows, "key", 500)._jdf.queryExecution().optimizedPlan().toString().count("rtrim(") <= 1


def test_sources_are_scanned_once_by_batches(spark):
    plan = plan_of(sources.source_tokens(spark, SF))
    assert plan.count("MapInArrow") == 1 and "UDTF" not in plan


def test_candidates_are_found_once(spark):
    assert "regexp_extract_all" not in plan_of(review.missing_candidates(spark, SF))


def test_json_of_answers_is_looked_for_once(spark):
    """Each way to find JSON stands once in the plan; outermost objects are told by signs, beyond the first plane too."""
    text = 'see \U0001f600 {"line": 2, "body": "a\\\\"} and {"line": "x}" oder {"line": 3, "body": "{\\"}"}'
    rows = spark.createDataFrame([(1, text.replace('{"line": "x}" oder ', "")), (2, text)], "payload_id int, content string").select("payload_id", payloads.recovered_json(F.col("content")).alias("json"))
    made = payloads.payload_comments(rows)
    assert plan_of(made).count("try_parse_json(") <= 12 or plan_of(made).count("parse_json") <= 12
    assert sorted(tuple(r) for r in made.collect()) == [(1, 0, 2, "a\\", "RIGHT"), (1, 1, 3, '{"}', "RIGHT"), (2, 0, 2, "a\\", "RIGHT")]


def test_impacts_of_rows_are_those_of_lines(spark):
    """Impacts and their lines from a file's own row, as from rows of its lines; nothing is shuffled."""
    patches = ("@@ -5,3 +7,2 @@\n x\n-if (a) return\n-  \n y", "@@ -1 +1,2 @@\n-auth\n\\ none\n z\n+++ q\n+new\n@@ -9,2 +4 @@\n+p\n--- w\n-lock", "@@ -3,1 +0,0 @@\n-token", "@@ -3 +1 @@\n-limit\r\n+a", "no hunk", "", None)
    files = spark.createDataFrame(list(enumerate(patches)), "doc_id long, patch string")
    hunks = diff.hunks(files)
    made = classify.impact_signals_of(diff.with_changes(files))
    assert "Exchange" not in plan_of(made)
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(made) == key(classify.impact_signals(classify.impacts(diff.lines(hunks)), diff.anchors(hunks, diff.lines(hunks)))) and made.count() >= 5
