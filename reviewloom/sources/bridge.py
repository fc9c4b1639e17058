"""Change-review tables made from the driver's tables.

These are synthetic stand-ins that exercise the operators, not real reviews. Every recipe is
per-row arithmetic over whole tables, so the tables grow with their sources, and so do their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.sources.shapes import ALIAS_CONFIG, CHANGES, LIBRARY, MODULES, STRUCTURED, TOUCHED
from reviewloom.streaming.progress import STAGES

#: Path templates by doc_id; N is the id.
PATHS = (
    "src/services/doc_N.ts",
    "src/components/DocN.tsx",
    "src/hooks/use_doc_N.ts",
    "config/app_N.json",
    "tests/doc_N.test.ts",
    "docs/doc_N.md",
    "src/auth/doc_N.ts",
    ".github/workflows/doc_N.yml",
    "scripts/run_N.sh",
    "packages/p_N/pnpm-lock.yaml",
    "src/lib/math_N.ts",
    "ci/steps_N.yaml",
)
STATUSES = ("added", "removed", "renamed", "modified", "changed", "modified")


def _case(key: str, values: tuple[str, ...]) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({key} % {len(values)} as int) + 1)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cr_id, doc_id, path, raw_status, old_path, patch: a file's change, one per document.

    A text's lines become hunk lines: k % 10 places them in hunks of seven with a gap of
    three, (7 * doc_id + k) % 5 makes them removed, added or context, (doc_id + k) % 11 puts
    code before some. All by functions over arrays, without a shuffle.
    """
    lines = read(spark, sf_dir, "documents").select("doc_id", F.expr("split(coalesce(text, ''), '\\n')").alias("raw"))
    body = F.expr(
        """transform(raw, (l, k) -> if(l = '', '', concat(
             case when (doc_id * 7 + k) % 5 = 0 then '-' when (doc_id * 7 + k) % 5 <= 2 then '+' else ' ' end,
             case (doc_id + k) % 11 when 0 then 'if (!value) return null; // ' when 1 then 'const token = session.verify; '
               when 2 then 'select id from t where tenant_id = 1; ' when 3 then 'await transaction.commit(); ' else '' end, l)))"""
    )
    hunks = F.expr(
        """transform(sequence(0, (size(raw) - 1) div 10), h -> filter(slice(body, h * 10 + 1, 7), x -> x <> ''))"""
    )
    text = F.expr(
        """array_join(concat(array('diff --git a b'), flatten(transform(hunks, (x, h) -> if(size(x) = 0, array(),
             concat(array(concat('@@ -', h * 10 * (1 + doc_id % 5) + 1,
                 if(size(filter(x, y -> left(y, 1) <> '+')) = 1, '', concat(',', size(filter(x, y -> left(y, 1) <> '+')))),
                 ' +', h * 10 * (1 + doc_id % 5) + 1,
                 if(size(filter(x, y -> left(y, 1) <> '-')) = 1, '', concat(',', size(filter(x, y -> left(y, 1) <> '-')))), ' @@')), x))))), '\\n')"""
    )
    return (
        lines.withColumn("body", body)
        .withColumn("hunks", hunks)
        .withColumn("patch", text)
        .withColumn("path", F.expr(f"replace({_case('doc_id', PATHS)}, 'N', cast(doc_id as string))"))
        .withColumn("raw_status", F.expr(_case("doc_id", STATUSES)))
        .select(
            F.floor(F.sqrt(F.col("doc_id"))).alias("cr_id"),
            "doc_id",
            "path",
            "raw_status",
            F.when(F.col("raw_status") == "renamed", F.concat(F.lit("old/"), "path")).alias("old_path"),
            "patch",
        )
    )


def review_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cr_id, path, line, side, body, agent_id, ord: comments of three agents, with repeats."""
    events = read(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("cr_id"),
        F.expr("concat('src/f', event_id % 7, '.ts')").alias("path"),
        (F.col("event_id") % 13 + 1).alias("line"),
        F.expr("if(event_id % 3 = 0, 'LEFT', 'RIGHT')").alias("side"),
        F.expr(
            "concat(if(event_id % 4 = 0, concat('Token 消耗: ', event_id, '\\n\\n'), ''), 'issue ', event_type, ' ', event_id % 5, if(event_id % 6 = 0, '  ', ''))"
        ).alias("body"),
        F.expr("element_at(array('correctness', 'security', 'regression'), cast(event_id % 3 as int) + 1)").alias("agent_id"),
        F.col("event_id").alias("ord"),
    )


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, seq, stage, agent_id, tokens, completed (null unless told), ts."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("request_id"),
        F.col("event_id").alias("seq"),
        F.expr(
            """case event_type when 'view' then 'file_review_started' when 'click' then 'agent_review_started'
               when 'purchase' then 'agent_review_completed' when 'error' then 'agent_review_failed' else 'review_started' end"""
        ).alias("stage"),
        F.expr("element_at(array('correctness', 'security', 'regression'), cast(event_id % 3 as int) + 1)").alias("agent_id"),
        F.expr("cast(floor(value) as bigint)").alias("tokens"),
        F.expr("if(event_id % 3 = 0, cast(get_json_object(props, '$.k') as bigint), null)").alias("completed"),
        "ts",
    )


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, seq, ts, stage and what events of progress may say: counts of files, some below zero, paths,
    agents, messages, comments, tokens, a run's conclusion; all stages, in no order of their own."""
    stages = ", ".join(repr(x) for x in STAGES)
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("request_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.expr(f"element_at(array({stages}), cast(event_id * 7 % 18 as int) + 1)").alias("stage"),
        F.expr("case when event_id % 7 = 0 then event_id % 40 when event_id % 13 = 0 then -1L end").alias("total"),
        F.expr("case when event_id % 3 = 0 then event_id % 23 when event_id % 17 = 0 then -2L end").alias("completed"),
        F.expr("if(event_id % 5 < 2, concat('src/lib/f', event_id % 11, '.ts'), null)").alias("path"),
        F.expr("if(event_id % 4 > 0, element_at(array('correctness', 'Security', 'other'), cast(event_id % 3 as int) + 1), null)").alias("agent_id"),
        F.expr("if(event_id % 9 = 0, concat('label ', event_id % 6), null)").alias("agent_label"),
        F.expr("if(event_id % 6 > 0, concat('m', event_id), null)").alias("message"),
        F.expr("transform(sequence(0, cast(event_id % 12 as int)), i -> concat('c', event_id, '.', i))").alias("all"),
        (F.col("event_id") % 4).alias("comment_count"),
        (F.col("event_id") % 5).alias("prompt_tokens"),
        (F.col("event_id") % 8).alias("completion_tokens"),
        (F.col("event_id") % 3).alias("reviewed_files"),
        (F.col("event_id") % 13).alias("total_tokens"),
        F.expr("if(event_id % 2 = 0, 'ok', 'bad')").alias("conclusion"),
        F.expr("if(event_id % 3 > 0, cast(event_id % 101 as int), null)").alias("percent"),
        F.expr("if(event_id % 2 = 0, array('correctness', 'security', 'late'), null)").alias("agents"),
    ).withColumn("comments", F.expr("slice(all, 1, size(all) - 1)")).drop("all")


def head_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seq, kind, head, ok: heads that arrive for a key, and ends of its runs, some of them failures."""
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("k"), "user_id").alias("key"),
        F.col("event_id").alias("seq"),
        F.expr("if(event_id % 5 < 3, 'arrival', 'end')").alias("kind"),
        F.expr("if(event_id % 5 < 3, concat('sha', event_id % 4), null)").alias("head"),
        (F.col("event_id") % 7 > 0).alias("ok"),
    )


def discussion_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """discussion_id, note_id, is_system, body, author: a note for each turn; some discussions are all ours, some
    hold none of ours, by whom a turn is taken to be of."""
    role = F.expr("case when conv_id % 4 = 0 and role = 'user' then 'assistant' when conv_id % 4 <> 0 and conv_id % 5 = 0 and role = 'assistant' then 'user' else role end")
    return (
        read(spark, sf_dir, "conversations")
        .withColumn("role", role)
        .select(
            F.col("conv_id").alias("discussion_id"),
            (F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"),
            (F.col("role") == "system").alias("is_system"),
            F.expr(
                """concat(if(role = 'assistant', '<!-- ai-review:mr -->\\n', ''),
                          if(role = 'assistant' and turn % 6 = 1, '<!-- ai-review-outdated:mr -->\\n', ''), coalesce(text, ''))"""
            ).alias("body"),
            F.expr("if(role = 'assistant', 'review-bot', 'dev')").alias("author"),
        )
    )


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """importer, module, symbol, local, argc, at_call: bindings and calls between modules."""
    return read(spark, sf_dir, "orders").select(
        F.expr("concat(if(o_custkey % 3 = 0, 'u', 'm'), o_custkey div 6)").alias("importer"),
        F.concat(F.lit("m"), F.expr("o_orderkey div 60")).alias("module"),
        F.expr("if(o_orderkey % 9 = 0, null, concat('f', o_orderkey % 8))").alias("symbol"),
        F.concat(F.lit("l"), F.col("o_orderkey") % 8).alias("local"),
        (F.col("o_orderkey") % 5).cast("int").alias("argc"),
        F.expr("o_orderpriority = '1-URGENT'").alias("is_new"),
        F.col("o_orderkey").alias("line"),
    )


def reexport_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target: modules that pass on what two others export, each."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    return parts.select(F.concat(F.lit("m"), "p").alias("source"), F.explode(F.array(F.expr("p div 2"), F.expr("p div 3 + 7"))).alias("t")).select("source", F.concat(F.lit("m"), "t").alias("target")).filter("source <> target")


def export_contracts(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """module, name, kind, required, total, rest: one row an exported symbol; version base or head."""
    shift = 0 if version == "base" else 1
    rows = read(spark, sf_dir, "part")
    kept = rows if version == "base" else rows.filter("p_partkey % 17 <> 0")
    return kept.select(
        F.concat(F.lit("m"), F.expr("p_partkey div 8")).alias("module"),
        F.concat(F.lit("f"), F.col("p_partkey") % 8).alias("name"),
        F.expr(f"if((p_partkey + {shift}) % 11 = 0, 'value', 'function')").alias("kind"),
        F.expr(f"cast(p_partkey % 3 + if({shift} = 1 and p_partkey % 5 = 0, 1, 0) as int)").alias("required"),
        F.expr(f"cast(p_partkey % 3 + 1 + if({shift} = 1 and p_partkey % 5 = 0, 1, 0) as int)").alias("total"),
        (F.col("p_partkey") % 7 == 0).alias("rest"),
    )


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: a module of one of ten shapes for each document, its number in its names."""
    content = F.element_at(F.array(*[F.lit(m) for m in MODULES]), (F.col("doc_id") % len(MODULES)).cast("int") + 1)
    return read(spark, sf_dir, "documents").select("doc_id", F.replace(content, F.lit("N"), F.col("doc_id").cast("string")).alias("content"))


def touched_module_lines(spark: SparkSession, sf_dir: str, both: bool = False) -> DataFrame:
    """doc_id, line: lines of each module that a change touches, in one of two ways, or in both."""
    ways = F.element_at(F.array(*[F.array(*[F.array(*[F.lit(line) for line in way]) for way in ways]) for ways in TOUCHED]), (F.col("doc_id") % len(MODULES)).cast("int") + 1)
    lines = F.flatten(ways) if both else F.element_at(ways, F.expr("cast(doc_id div 10 % 2 as int) + 1"))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(lines.cast("array<bigint>")).alias("line"))


def library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Search hits (name, path, n) and files (path, content) of a library: a supplier's file defines one name and mentions another."""
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("lib/s"), "s_suppkey", F.lit(".ts")).alias("path"))
    name = lambda more: F.element_at(F.array(*[F.lit(x) for x in LIBRARY]), ((F.col("k") + more) % len(LIBRARY)).cast("int") + 1)
    hits = rows.select(F.explode(F.array(name(0), name(1))).alias("name"), "path", F.col("k").alias("n"))
    return hits, rows.select("path", F.format_string("export function %s(a) { return %s }\ninterface Other%s {}\n", name(0), F.col("k").cast("string"), F.col("k").cast("string")).alias("content"))


def structured_files(spark: SparkSession, sf_dir: str, yaml_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc_id, path, content of a structured file for each document, and its touched lines (doc_id, line, hunk_ix, line_ix, text)."""
    shown = STRUCTURED[:4] if yaml_only else STRUCTURED
    cases = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content"), F.array(*[F.lit(n) for n in lines]).alias("touched")) for p, c, lines in shown])
    rows = read(spark, sf_dir, "documents").select("doc_id", F.element_at(cases, (F.col("doc_id") % len(shown)).cast("int") + 1).alias("f")).select("doc_id", "f.*")
    rows = rows.withColumn("content", F.replace("content", F.lit("N"), F.col("doc_id").cast("string")))
    touched = rows.select("doc_id", F.split("content", "\n").alias("l"), F.explode("touched").alias("line"))
    return rows.drop("touched"), touched.select("doc_id", "line", F.lit(0).alias("hunk_ix"), F.col("line").alias("line_ix"), F.get("l", F.col("line") - 1).alias("text"))


def drifts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of a repository for each supplier, in one of six ways: new files, old files (repo, path, content), the
    change (repo, path, old_path, status), configurations, and search hits of names (repo, symbol, path, ord)."""
    repos = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("repo"))
    way = (F.col("repo") % len(CHANGES)).cast("int") + 1
    row = "array<struct<path:string,content:string>>"

    def files(which: int) -> DataFrame:
        sets = F.array(*[F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in case[which].items()]) for case in CHANGES]).cast(f"array<{row}>")
        found = repos.select("repo", F.explode(F.element_at(sets, way)).alias("f")).select("repo", "f.*")
        return found.withColumn("content", F.replace("content", F.lit("N"), F.col("repo").cast("string")))

    head, base = files(0), files(1)
    old = base.select("repo", "path", F.lit(True).alias("was"))
    change = head.filter("path not like '%index.ts'").join(old, ["repo", "path"], "left").select("repo", "path", F.col("path").alias("old_path"), F.when(F.col("was"), "modified").otherwise("added").alias("status"))
    configs = repos.select("repo", F.lit("tsconfig.json").alias("path"), F.lit(ALIAS_CONFIG).alias("content"))
    hits = repos.filter("repo % 4 > 0").select(
        "repo", F.concat(F.expr("if(repo % 6 = 4, 'goneX', 'updateUserX')"), F.lit("")).alias("symbol"), F.explode(F.expr("transform(sequence(0, repo % 15), i -> named_struct('ord', i, 'path', concat('src/x', i, if(i % 3 = 2, '.md', '.ts'))))")).alias("h")
    )
    hits = hits.select("repo", F.replace("symbol", F.lit("X"), F.col("repo").cast("string")).alias("symbol"), "h.path", F.col("h.ord").alias("ord"))
    return head, base, change, configs, hits.unionByName(hits.withColumn("path", F.lit("src/a.ts")).distinct())


def barrels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Exports (module, name) of every third module, and what others pass on (module, source, form,
    name, exported): of the module of half their number by a form that goes by it, and all of another."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    names = F.expr("if(p % 2 = 0, array('default', 'a', 'b'), array('a', 'c'))")
    exports = parts.filter("p % 3 = 0").select(F.concat(F.lit("m"), "p").alias("module"), F.explode(names).alias("name"))
    first = F.expr(
        """named_struct('source', concat('m', p div 2), 'form', element_at(array('named', 'namespace', 'star', 'named'), cast(p % 4 as int) + 1),
             'name', element_at(array('a', null, null, 'default'), cast(p % 4 as int) + 1), 'exported', element_at(array('renamed', 'ns', null, 'a'), cast(p % 4 as int) + 1))"""
    )
    second = F.expr("named_struct('source', concat('m', p div 5 + 1), 'form', 'star', 'name', cast(null as string), 'exported', cast(null as string))")
    passed = parts.filter("p % 3 <> 0").select(F.concat(F.lit("m"), "p").alias("module"), F.explode(F.array(first, second)).alias("x")).select("module", "x.*")
    return exports, passed


def repositories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Configurations (repo, path, content), files (repo, path) and imports (repo, importer, specifier)
    of a repository for each supplier."""
    repos = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("repo"))
    configs = repos.select(
        "repo",
        F.explode(
            F.expr(
                """array(
              named_struct('path', 'tsconfig.json', 'content', if(repo % 4 = 0, '{"extends": "./conf/base", "compilerOptions": {"paths": {"@own/*": ["src/own/*", "lib/*"]}}}', '{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./*"], "exact": ["one"]}}}')),
              named_struct('path', 'conf/base.json', 'content', '{"extends": "../tsconfig.json", "compilerOptions": {"baseUrl": "..", "paths": {"@own/*": ["old/*"], "#*": ["src/*/main"]}}}'),
              named_struct('path', 'jsconfig.json', 'content', if(repo % 3 = 0, '{"compilerOptions": {"paths": {"@own/x": ["src/x"]}}}', 'not json')))"""
            )
        ).alias("c"),
    ).select("repo", "c.*")
    paths = "array('src/own/x.ts', 'lib/y.js', 'old/x.tsx', 'src/k/main/index.ts', 'src/x.mts', 'src/one.d.ts', 'src/a/b.ts', 'src/index.tsx', 'a.ts')"
    files = repos.select("repo", F.explode(F.expr(paths)).alias("path")).filter("not (repo % 5 = 0 and path = 'src/own/x.ts')")
    specifiers = "array('@own/x', '@own/y', '#k', '@/a/b', 'exact', './b', '../', '../../a', 'react', './none')"
    imports = repos.select("repo", F.lit("src/a/c.ts").alias("importer"), F.explode(F.expr(specifiers)).alias("specifier"))
    return configs, files, imports
