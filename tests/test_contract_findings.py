"""Findings on contracts from sources on: the ways in which a user reaches what changed."""

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import code, contracts, modules
from reviewloom.sources.shapes import ALIAS_CONFIG, CHANGES


def findings(spark, head, base, changed=None):
    files = spark.createDataFrame([(1, p, c) for p, c in head.items()], "repo long, path string, content string")
    old = spark.createDataFrame([(1, p, c) for p, c in base.items()], "repo long, path string, content string")
    rows = changed or [(1, p, p, "modified" if p in base else "added") for p in head if not p.endswith("index.ts")]
    change = spark.createDataFrame(rows, "repo long, path string, old_path string, status string")
    configs = spark.createDataFrame([(1, "tsconfig.json", ALIAS_CONFIG)], "repo long, path string, content string")
    key = F.concat(F.col("repo").cast("string"), F.lit(":"), F.col("path")).alias("file")
    new, was = (code.source_marks(x.select(key, "content"), "file") for x in (files, old))
    changes = contracts.changed_contracts(was, new, change)
    bindings = contracts.binding_table(new, change, files.select("repo", "path"), modules.alias_mappings(configs))
    return sorted((r["path"], r["line"], r["rule_id"], r["name"]) for r in contracts.contract_findings(changes, bindings, new).collect())


DRIFT = contracts.SIGNATURE_RULE
EXPECTED = (
    [("src/a.ts", 4, DRIFT, "updateUserN"), ("src/b.ts", 4, DRIFT, "updateUserN")],
    [("src/a.ts", 4, DRIFT, "updateUserN"), ("src/b.ts", 4, DRIFT, "updateUserN")],
    [("src/a.ts", 4, DRIFT, "updateUserN")],
    [("src/a.ts", 4, DRIFT, "updateUserN"), ("src/b.ts", 4, DRIFT, "updateUserN")],
    [("src/a.ts", 1, contracts.REMOVED_RULE, "goneN"), ("src/a.ts", 2, contracts.KIND_RULE, "MadeN"), ("src/a.ts", 4, contracts.KIND_RULE, "buildN")],
    [("src/a.ts", 10, DRIFT, "updateUserN")],
)


@pytest.mark.parametrize("way", range(6))
def test_ways_to_what_changed(spark, way):
    assert findings(spark, *CHANGES[way]) == EXPECTED[way]


def test_calls_that_fit_and_files_that_moved(spark):
    """Enough arguments, others' functions of the same name, and renamed modules."""
    new = "export function go(a, b, ...c) {}\nexport default function (x) {}\n"
    head = {"lib/new.ts": new, "a.ts": "import go, { go as run } from './lib/new'\nrun(1)\nrun(1, 2, 3)\ngo()\ngo(1)\nother.run(1)\nconst o = { run }\no.run()\n", "b.md": "run()"}
    base = {"lib/old.ts": "export function go(a) {}\nexport default function () {}\n"}
    changed = [(1, "lib/new.ts", "lib/old.ts", "renamed"), (1, "a.ts", "a.ts", "added"), (1, "b.md", "b.md", "added")]
    assert findings(spark, head, base, changed) == [("a.ts", 2, DRIFT, "go"), ("a.ts", 4, DRIFT, "default"), ("a.ts", 8, DRIFT, "go")]


def test_nothing_changed(spark):
    head = {"m.ts": "export const a = 1", "n.ts": "import { a } from './m'\na()\n"}
    assert findings(spark, head, {"m.ts": "export const a = 2"}) == []
    assert findings(spark, head, {}) == []


def test_aliases_follow_statements():
    """A chain of five within one round; one written the wrong way round needs a second, and longer ones end there."""
    known = [("api", None, "m", True, None, 1)]
    chain = [("a", None, "api.go", 2), ("b", None, "a", 3), ("c", None, "b", 4), ("d", None, "c", 5), ("e", None, "d", 6)]
    of = lambda rows: {r[0]: r[1] for r in rows}
    assert of(modules.aliases_in_order(known, chain, 1)) == {"api": None, "a": "go", "b": "go", "c": "go", "d": "go", "e": "go"}
    back = list(reversed(chain[:3]))
    assert set(of(modules.aliases_in_order(known, back, 2))) == {"api", "a", "b"}
    # the last binding of a name counts, and members of objects are reached through them
    both = [("x", None, "api.one", 2), ("x", None, "api.two", 3), ("o", "k", "x", 4), ("y", None, "o.k", 5)]
    assert of(modules.aliases_in_order(known, both))["y"] == "two"
    many = [(f"v{i}", None, f"v{i - 1}" if i else "api.go", i) for i in range(50_000)]
    assert len(modules.aliases_in_order(known, many)) == 50_001
