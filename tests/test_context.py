"""Configuration, packing and host operators against plain versions."""

import random
import re

from pyspark.sql import functions as F

from reviewloom.functions import text
from reviewloom.operators import configs, prompts
from reviewloom.plans import context
from reviewloom.sources import hosting

SF = "/root/testdata/sf0.001"


def compact(content: str, most: int) -> str:
    whole = re.sub("\n{3,}", "\n\n", content.replace("\r\n", "\n")).strip()
    if len(whole) <= most:
        return whole
    kept, used = [], 0
    for line in (x.rstrip() for x in whole.split("\n")):
        longer = len(line) + (1 if kept else 0)
        if used + longer > most - 18:
            break
        kept.append(line)
        used += longer
        if len(kept) >= 12 and "{" in line:
            break
    return ("\n".join(kept) if kept else whole[: most - 18].rstrip()) + prompts.TRUNCATED


def pack(blocks: list[tuple[str, str, int]], budget: int) -> tuple[str, int]:
    out, omitted = [], 0
    for label, body, preferred in blocks:
        made = f"{label}\n```ts\n{compact(body, max(220, min(preferred, budget - 120)))}\n```"
        if len(made) > budget and out:
            omitted += 1
            continue
        out.append(made)
        budget -= len(made) + 2
    return "\n\n".join(out), omitted


def test_compaction_and_packing(spark):
    rng = random.Random(5)
    body = lambda: "\n".join(rng.choice(["", "x {", "a" * rng.randint(1, 90), "  y  "]) for _ in range(rng.randint(1, 40)))
    rows = [(k, i, f"L{i}", body(), rng.choice([200, 400, 900])) for k in range(12) for i in range(6)]
    table = spark.createDataFrame(rows, "key int, ord int, label string, body string, preferred int")
    cut = {(r["key"], r["ord"]): r["c"] for r in table.select("key", "ord", prompts.compacted(F.col("body"), F.lit(300)).alias("c")).collect()}
    assert all(cut[k, i] == compact(b, 300) for k, i, _, b, _ in rows)
    for r in prompts.packed_blocks(table, "key", 1500).collect():
        assert (r["packed"], r["omitted"]) == pack([x[2:] for x in rows if x[0] == r["key"]], 1500)


def section(name: str, items: list[dict], budget: int) -> str:
    """A section by plain loops: definitions once by name and file, functions first; a note on what didn't fit."""
    kinds = {"code": ("function", "type"), "slices": ("slice",), "removed": ("deleted",)}[name]
    empty, hint = prompts.SECTIONS[name]
    blocks, seen = [], set()
    for kind in kinds:
        for x in sorted((i for i in items if i["kind"] == kind), key=lambda i: i["place"]):
            if kind in ("function", "type"):
                if (kind, x["name"], x["file"]) in seen:
                    continue
                seen.add((kind, x["name"], x["file"]))
            source = "当前文件" if x["file"] == "current" else x["file"]
            head = {"function": "函数: ", "type": "类型: ", "slice": "", "deleted": "旧逻辑: "}[kind] + x["name"]
            body = f"原因: {x['name']}\n\n{x['content']}" if kind == "deleted" else x["content"]
            blocks.append((f"【{head} | 来源: {source}】", body, {"function": 900, "type": 820, "slice": 720, "deleted": 760}[kind]))
    if budget <= 0 or not blocks:
        return empty
    packed, omitted = pack(blocks, budget)
    return f"{packed}\n\n{hint} 共省略 {omitted} 段。" if omitted else packed


def test_sections_of_prompts(spark):
    rng = random.Random(11)
    items = [(k, rng.choice(["function", "type", "slice", "deleted"]), i, f"n{rng.randrange(6)}", rng.choice(["current", "a.ts"]), "\n".join("y" * rng.randint(1, 80) for _ in range(rng.randint(1, 30)))) for k in range(20) for i in range(rng.randrange(14))]
    signals = [(k, rng.choice(["eslint", "diff-impact", "dependency-cruiser", "x"]), rng.choice([None, 0, 5]), f"s{rng.randrange(9)}", i) for k in range(0, 20, 2) for i in range(12)]
    limits = [(k, rng.choice([30, 90, 1000]), rng.choice([0, 500, 4000]), rng.choice([0, 500, 4000]), rng.choice([0, 700, 4000])) for k in range(21)]
    made = prompts.context_sections(
        spark.createDataFrame(items, "doc_id int, kind string, place int, name string, file string, content string"),
        spark.createDataFrame(signals, "doc_id int, source string, line int, summary string, ord int"),
        spark.createDataFrame(limits, "doc_id int, signals int, slices int, code int, removed int"),
    )
    found = {r["doc_id"]: r for r in made.collect()}
    assert len(found) == 21
    labels = {"eslint": "[eslint]", "diff-impact": "[change-impact]", "dependency-cruiser": "[dependency-cruiser]", "x": "[tsquery]"}
    for k, most, slices, code, removed in limits:
        own = [dict(zip(["key", "kind", "place", "name", "file", "content"], i, strict=True)) for i in items if i[0] == k]
        for name, budget in (("slices", slices), ("code", code), ("removed", removed)):
            assert found[k][name] == section(name, own, budget), (k, name)
        unique = list(dict.fromkeys((s, n or 0, t) for key, s, n, t, _ in signals if key == k))
        lines, left = [], most
        for s, n, t in unique[:8]:
            line = f"- {labels[s]}{f'[line {n}]' if n else ''} {t}"
            if len(line) > left and lines:
                break
            lines.append(line)
            left -= len(line)
        more = [f"- 其余 {len(unique) - len(lines)} 条信号已省略。"] if len(unique) > len(lines) else []
        assert found[k]["signals"] == ("\n".join(lines + more) if unique else prompts.NO_SIGNALS)


def test_packed_blocks_hold_what_they_use(spark):
    """Long bodies are reduced before they meet, with the results of whole ones."""
    bodies = ["x" * 5000, "a" + " " * 3000 + "\nb {\n" + "c d\n" * 900, "k \n" * 400, "ab" + " " * 890 + "c", "y " * 449 + "z", "\n\n\n" + "q" * 881 + " " * 30 + "\nr"]
    rows = [(1 + i % 2, i, f"l{i}", b * n, p) for i, (b, n, p) in enumerate((b, n, p) for b in bodies for n in (1, 3) for p in (100, 900))]
    table = spark.createDataFrame(rows, "key int, ord int, label string, body string, preferred int")
    assert prompts.reduced_blocks(table, "key", 4000).filter("length(whole) > 901 or length(bare) > 901").count() == 0
    for r in prompts.packed_blocks(table, "key", 4000).collect():
        assert (r["packed"], r["omitted"]) == pack([x[2:] for x in rows if x[0] == r["key"]], 4000)


def test_context_pack_keys_grow(spark, tmp_path):
    spark.range(10_000).selectExpr("id as doc_id", "'text' as text").write.parquet(str(tmp_path / "documents.parquet"))
    assert context.context_pack(spark, str(tmp_path)).count() == 100


def test_yaml_paths(spark):
    content = "a:\n  b: 1\n  c:\n    d: 2\n# e: 3\nf: 4\n  g : 5\nnothing\n"
    files = spark.createDataFrame([(1, content)], "doc_id long, content string")
    touched = spark.createDataFrame([(1, i) for i in (2, 4, 5, 6, 7, 8)], "doc_id long, line int")
    assert [r["name"] for r in configs.yaml_paths(files, touched).orderBy("n").collect()] == ["a.b", "a.c.d", "f", "f.g"]


def test_yaml_key_paths_reads_all_lines(spark, tmp_path):
    """A key that comes first on a file's twelfth line is found."""
    spark.range(12).selectExpr("1L as user_id", "id * 3 as event_id", "if(id < 11, 'view', 'late') as event_type").write.parquet(str(tmp_path / "events.parquet"))
    assert [r["name"] for r in context.yaml_key_paths(spark, str(tmp_path)).orderBy("n").collect()] == ["view", "late"]


def test_section_keys(spark):
    lines = ["top = 1", "[one]", "a: 2", "; b = 3", "[ two ]", "c=4", "a=5"]
    rows = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(lines)], "doc_id long, line int, text string")
    assert [r["name"] for r in configs.section_keys(rows, rows.filter("line <> 3")).orderBy("n").collect()] == ["top", "two.c", "two.a"]


def test_shell_commands(spark):
    lines = ["FOO=1 BAR='x y' npm ci", "# no", "if [ -f x ]; then", "fix it", "npm test", "  docker build ."]
    rows = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(lines)], "doc_id long, hunk_ix int, line_ix int, text string")
    assert [r["name"] for r in configs.shell_commands(rows).orderBy("n").collect()] == ["npm", "fix", "docker"]


def test_top_level_keys(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, // no\n "b": {"c": 2}}'), (2, '// x\n{"z": 1}'), (3, "[1]"), (4, "{bad")], "doc_id long, content string")
    found = [tuple(r) for r in configs.top_level_keys(rows).select("doc_id", "name").orderBy("doc_id").collect()]
    assert (2, "z") in found and not {3, 4} & {d for d, _ in found}


def test_plans_without_sql_run(spark):
    for name in ("yaml_key_paths", "context_pack", "snippet_compact"):
        assert context.queries()[name](spark, SF).count() > 0


def pages(resource: str, page: int):
    """Two pages of three and two records."""
    return [{"path": f"{resource}/{page}/{i}"} for i in range(3 if page == 1 else 2)], page < 2


def test_paged_source(spark):
    spark.dataSource.register(hosting.PagedSource)
    rows = spark.read.format("paged").options(resources="a,b", transport=f"{__name__}:pages").load()
    found = rows.select("resource", "ord", F.get_json_object("record", "$.path").alias("path")).orderBy("resource", "ord").collect()
    assert [tuple(r) for r in found][:5] == [("a", 0, "a/1/0"), ("a", 1, "a/1/1"), ("a", 2, "a/1/2"), ("a", 3, "a/2/0"), ("a", 4, "a/2/1")]
    assert len(found) == 10


def test_search_paths_keep_the_first(spark):
    hits = spark.createDataFrame([("q", 0, "first"), ("q", 1, "shared"), ("q", 2, "shared"), ("q", 3, "second")], "query string, ord int, path string")
    assert [r["path"] for r in hosting.search_paths(hits).orderBy("n").collect()] == ["first", "shared", "second"]


def test_writes_fail_alone(spark):
    def send(record):
        if record["n"] == 2:
            raise ValueError("no")

    rows = spark.createDataFrame([(1, "post"), (2, "post"), (3, "delete")], "n long, action string")
    done = hosting.write_each(rows, send)
    assert sorted((r["n"], r["ok"], r["error"]) for r in done.collect()) == [(1, True, None), (2, False, "no"), (3, True, None)]
    assert tuple(hosting.sync_counts(done).first()) == (2, 1, 1, 0, 1)


def test_generate_retries(spark):
    def generate(prompt):
        if prompt == "bad":
            raise TimeoutError("timed out")
        return {"content": prompt.upper(), "prompt_tokens": 2, "completion_tokens": 3}

    rows = spark.createDataFrame([("1", "good"), ("2", "bad")], "key string, prompt string")
    assert [tuple(r) for r in hosting.generated(rows, generate).orderBy("key").collect()] == [("1", "GOOD", 2, 3, None), ("2", None, 0, 0, "timed out")]


def test_names(spark):
    owner, repo = text.project_parts(F.col("p"))
    rows = spark.createDataFrame([("g/sub/r",), ("r",), ("/a//b/",)], "p string").select(owner, repo)
    assert [tuple(r) for r in rows.collect()] == [("g/sub", "r"), (None, None), ("a", "b")]
    assert spark.range(1).select(text.js_length(F.lit("💡ab"))).first()[0] == 4


def test_ndjson(spark):
    assert hosting.ndjson(spark.range(1)).first()[0] == '{"id":0}'


def test_structured_kind(spark):
    kinds = {"a/B.YAML": "yaml", ".yml": None, "d/.json": None, "x\\y.JSONC": "json", "p.toml": "keys", "q.properties": "keys", "r.sh": "shell", "Dockerfile": "shell", "a/dockerfile": "shell", "my.dockerfile": None, "t.ts": None, "yml": None}
    rows = spark.createDataFrame([(p,) for p in kinds], "path string")
    assert {r["path"]: r["kind"] for r in rows.select("path", configs.structured_kind(F.col("path")).alias("kind")).collect()} == kinds


def test_structured_keys_without_content(spark):
    files = spark.createDataFrame([(1, "a.yml", None), (2, "b.json", ""), (3, "c.ts", "a: 1"), (4, None, "a: 1"), (5, "d.ini", "[s]\r\nk=1")], "doc_id long, path string, content string")
    touched = spark.createDataFrame([(i, 2 if i == 5 else 1, 0, 0, "a: 1") for i in range(1, 6)], "doc_id long, line int, hunk_ix int, line_ix int, text string")
    assert [tuple(r) for r in configs.structured_keys(files, touched).collect()] == [(5, "keys", 1, "s.k")]


def test_lines_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"type": "progress", "n": 1}\n\nno json\n{"n": 2}\n{"type": "result", "n": 3, "more": 4}\n')
    query = hosting.ndjson_stream(spark, str(tmp_path / "in"), "type string, n long").writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("told").collect()) == [("progress", 1), ("result", 3)]
