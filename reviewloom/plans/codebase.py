"""Plans of modules, scopes and agents, with their SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import agents, diff, modules, prompts, scopes
from reviewloom.plans import values
from reviewloom.plans.oracles import COMMENTS, FILES, LINES, _q, _with
from reviewloom.plans.review import AGENTS, _files, _hunks, _lines
from reviewloom.sources import bridge


def path_forms(spark, sf):
    path = F.expr("element_at(array('./a/../b/', '/x/./y/../../..', 'a//b/./c', '../../q', '', 'a/..', './.d/e.TSX', 'x/y.mjs', 'n.test.jsx'), cast(event_id % 9 as int) + 1)")
    return bridge.read(spark, sf, "events").select("event_id", modules.normalized_path(path).alias("path"), modules.script_kind(path).alias("kind"))


def alias_configs(spark, sf):
    found = modules.alias_mappings(bridge.repositories(spark, sf)[0])
    return found.select("repo", F.col("ord").cast("long").alias("ord"), "pattern", F.array_join("targets", ",").alias("targets"))


def alias_resolution(spark, sf):
    configs, files, imports = bridge.repositories(spark, sf)
    return modules.resolved_imports(imports, files, modules.alias_mappings(configs)).select("repo", "specifier", "path")


def export_barrels(spark, sf):
    return modules.barrel_exports(*bridge.barrels(spark, sf)).select("module", "exported", "target", "symbol", F.array_join("export_path", ".").alias("export_path"))


def import_bindings(spark, sf):
    barrels = modules.barrel_exports(*bridge.barrels(spark, sf))
    imports = bridge.read(spark, sf, "part").select(F.concat(F.lit("u"), "p_partkey").alias("path"), F.concat(F.lit("m"), "p_partkey").alias("module"), F.expr("if(p_partkey % 5 = 0, null, if(p_partkey % 4 = 1, 'ns', 'a'))").alias("symbol_wanted"), F.lit("x").alias("local"))
    return modules.barrel_bindings(imports, barrels).select("path", "local", "target", "symbol", "base")


def _bindings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = bridge.read(spark, sf, "part").select(F.col("p_partkey").alias("path"))
    known = F.expr(
        """array(named_struct('local', 'one', 'symbol', 'a', 'module', 'm1', 'namespace', false, 'member', cast(null as string), 'line', 1L, 'ord', 1L),
                 named_struct('local', 'all', 'symbol', cast(null as string), 'module', 'm2', 'namespace', true, 'member', cast(null as string), 'line', 2L, 'ord', 2L),
                 named_struct('local', if(path % 2 = 0, 'all', 'other'), 'symbol', cast(null as string), 'module', 'm3', 'namespace', true, 'member', cast(null as string), 'line', 3L, 'ord', 3L))"""
    )
    given = F.expr(
        """array(named_struct('name', 'p', 'member', cast(null as string), 'expression', 'one', 'line', 5L, 'ord', 5L),
                 named_struct('name', 'q', 'member', cast(null as string), 'expression', 'all.go', 'line', 6L, 'ord', 6L),
                 named_struct('name', 'o', 'member', 'k', 'expression', if(path % 3 = 0, 'one', 'nothing'), 'line', 7L, 'ord', 7L),
                 named_struct('name', 'r', 'member', cast(null as string), 'expression', 'o.k', 'line', 8L, 'ord', 8L))"""
    )
    return rows.select("path", F.explode(known).alias("b")).select("path", "b.*"), rows.select("path", F.explode(given).alias("b")).select("path", "b.*")


def binding_aliases(spark, sf):
    return modules.binding_aliases(*_bindings(spark, sf)).select("path", "local", "symbol", "module", "namespace", "member", "line")


def namespace_members(spark, sf):
    known, given = _bindings(spark, sf)
    return modules.namespace_members(given, known).select("path", "expression", "module", "symbol")


def chunk_anchors(spark, sf):
    hunks = _hunks(spark, sf)
    return scopes.chunk_anchors(hunks, diff.lines(hunks)).select("doc_id", F.col("hunk_ix").cast("long").alias("hunk_ix"), "line")


def capped_slices(spark, sf):
    rows = bridge.read(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("label"), F.concat(F.lit("f"), F.col("event_id") % 3).alias("file"), F.lit("c").alias("content"), F.col("event_id").alias("ord"))
    return scopes.capped_slices(rows, F.col("doc_id") % 5).select("doc_id", "label", "file", F.col("place").cast("long").alias("place"))


def _agents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, a.capitalize(), p) for a, p in AGENTS], "agent_id string, label string, place int")


def agent_assignments(spark, sf):
    segments = bridge.read(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 3)).alias("segment_ix"))
    return agents.assignments(segments, _agents(spark)).select("doc_id", F.col("segment_ix").cast("long").alias("segment_ix"), "agent_id", "label")


def agent_comments(spark, sf):
    rows = bridge.review_comments(spark, sf).select("ord", F.col("ord").alias("doc_id"), "agent_id", F.expr("if(ord % 2 = 0, 'said', null)").alias("old_path"))
    files = rows.filter("ord % 3 = 0").select("doc_id", F.expr("if(ord % 9 = 0, '', 'file')").alias("old_path"))
    return agents.agent_comments(rows, files, _agents(spark)).select("ord", "agent_id", "label", "old_path")


def agent_outcomes(spark, sf):
    runs = bridge.read(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.expr("event_id div 3").alias("segment_ix"), (F.col("event_id") % 3).alias("place"), F.expr("if(user_id % 3 = 0 and event_id % 50 = 0, 1, 0)").alias("comments"),
        (F.col("event_id") % 7).alias("prompt_tokens"), (F.col("event_id") % 3).alias("completion_tokens"), F.expr("if(user_id % 4 = 1 and event_id % 2 = 0, concat('e', event_id), null)").alias("error"),
    )
    findings = runs.filter("doc_id % 5 = 2").select("doc_id").distinct()
    return agents.agent_outcomes(runs, findings).select("doc_id", F.col("comments").cast("long").alias("comments"), "total_tokens", "last_error", "findings", "outcome")


def merged_results(spark, sf):
    rows = bridge.review_comments(spark, sf).select("path", "ord", F.concat(F.lit("e"), "ord").alias("entry"), "side")
    return agents.merged_by_path([rows.filter("side = 'LEFT'"), rows.filter("side = 'RIGHT'")]).select("path", F.col("n").cast("long").alias("n"), "entry")


def entry_counts(spark, sf):
    return agents.entry_counts(bridge.read(spark, sf, "documents").select(F.split("text", "\n").alias("l")), "l")


def empty_analysis(spark, sf):
    return agents.empty_analysis(_files(spark, sf)).select("path", F.size("findings").alias("findings"), F.size("signals").alias("signals"))


def error_counts(spark, sf):
    outcomes = bridge.read(spark, sf, "events").select(F.col("user_id").alias("cr_id"), (F.col("event_type") == "error").alias("failed"))
    syncs = outcomes.select("cr_id").distinct().filter("cr_id % 3 > 0").withColumn("failed_count", F.col("cr_id") % 2)
    return agents.error_counts(outcomes, syncs).select("cr_id", "errors")


def review_scopes(spark, sf):
    """Scope, diff section and checklist of each file's prompt."""
    hunks = _hunks(spark, sf)
    listed = hunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("hunk_ix", "old_start", "old_lines", "new_start", "new_lines", "content"))).alias("hunks"))
    rows = _files(spark, sf).join(listed, "doc_id", "left")
    none = F.expr("cast(array() as array<struct<hunk_ix:int,old_start:int,old_lines:int,new_start:int,new_lines:int,content:string>>)")
    made = F.coalesce("hunks", none)
    scope = prompts.review_scope(F.col("path"), F.lit("Any file"), F.col("doc_id") % 3 + 1, F.lit(3) * (F.col("doc_id") % 2), made)
    return rows.select("doc_id", F.md5(scope.cast("binary")).alias("scope_md5"), F.md5(prompts.diff_section(F.col("path"), made).cast("binary")).alias("diff_md5"), prompts.checklist(F.array(F.lit("a"), F.col("path"))).alias("checklist"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        path_forms, alias_configs, alias_resolution, export_barrels, import_bindings, binding_aliases, namespace_members, chunk_anchors, capped_slices, agent_assignments, agent_comments,
        agent_outcomes, merged_results, entry_counts, empty_analysis, error_counts, review_scopes,
    )
    return {f.__name__: f for f in listed}


_BARRELS = """exports as (select 'm' || p_partkey as module, unnest(case when p_partkey % 2 = 0 then ['default', 'a', 'b'] else ['a', 'c'] end) as name from part where p_partkey % 3 = 0),
passed as (
  select 'm' || p_partkey as module, 'm' || (p_partkey // 2) as source, (['named', 'namespace', 'star', 'named'])[p_partkey % 4 + 1] as form,
    (['a', null, null, 'default'])[p_partkey % 4 + 1] as name, (['renamed', 'ns', null, 'a'])[p_partkey % 4 + 1] as given from part where p_partkey % 3 <> 0
  union all select 'm' || p_partkey, 'm' || (p_partkey // 5 + 1), 'star', null, null from part where p_partkey % 3 <> 0),
walk(holder, target, symbol, exported, path, chain, known) as (
  select module, module, name, name, [name], cast([] as varchar[]), true from exports
  union all
  select p.module, w.target, w.symbol, case when p.form = 'star' then w.exported else p.given end,
    case p.form when 'star' then w.path when 'named' then list_concat([p.given], w.path[2:]) else list_concat([p.given], w.path) end, list_append(w.chain, p.module), false
  from walk w join passed p on p.source = w.holder
  where len(w.chain) < 5 and not list_contains(w.chain, p.module) and (w.known or w.holder not in (select module from exports))
    and case p.form when 'named' then p.name = w.exported else w.exported <> 'default' end),
found as (select holder as module, target, symbol, path, min(exported) as exported from walk where not known group by all)"""

def oracle_sql() -> dict[str, str]:
    return {
        "path_forms": """select event_id, (['b/', '/', 'a/b/c', '../../q', '.', '.', '.d/e.TSX', 'x/y.mjs', 'n.test.jsx'])[event_id % 9 + 1] as path,
            (['TS', 'TS', 'TS', 'TS', 'TS', 'TS', 'TSX', 'JS', 'JSX'])[event_id % 9 + 1] as kind from events""",
        "alias_configs": """with r as (select s_suppkey as repo from supplier),
            a(o, v, pattern, targets) as (values (1, 0, '@own/*', 'old/*'), (2, 0, '#*', 'src/*/main'), (3, 0, '@own/*', 'src/own/*,lib/*'), (1, 1, '@/*', 'src/*'), (2, 1, 'exact', 'src/one'), (9, 2, '@own/x', 'src/x'))
            select repo, row_number() over (partition by repo order by o) as ord, pattern, targets from r, a where (v = 0 and repo % 4 = 0) or (v = 1 and repo % 4 > 0) or (v = 2 and repo % 3 = 0)""",
        "alias_resolution": """with r as (select s_suppkey as repo from supplier), f(specifier, path, d) as (
              select '@own/x', case when repo % 3 = 0 then 'src/x.mts' when repo % 4 = 0 and repo % 5 > 0 then 'src/own/x.ts' when repo % 4 = 0 then 'old/x.tsx' end, repo from r
              union all select '@own/y', case when repo % 4 = 0 then 'lib/y.js' end, repo from r union all select '#k', case when repo % 4 = 0 then 'src/k/main/index.ts' end, repo from r
              union all select '@/a/b', case when repo % 4 > 0 then 'src/a/b.ts' end, repo from r union all select 'exact', case when repo % 4 > 0 then 'src/one.d.ts' end, repo from r
              union all select './b', 'src/a/b.ts', repo from r union all select '../../a', 'a.ts', repo from r)
            select d as repo, specifier, path from f where path is not null union all select s_suppkey, '../', 'src/index.tsx' from supplier""",
        "export_barrels": _with(_BARRELS, select="select module, exported, target, symbol, array_to_string(path, '.') as export_path from found", recursive=True),
        "import_bindings": _with(
            _BARRELS,
            "u as (select 'u' || p_partkey as u, 'm' || p_partkey as module, case when p_partkey % 5 = 0 then null when p_partkey % 4 = 1 then 'ns' else 'a' end as wanted from part)",
            select="""select u as path, 'x' as local, target, symbol, case when len(inner_path) > 0 then 'x.' || array_to_string(inner_path, '.') else 'x' end as base
            from (select *, case when wanted is null then path[1 : len(path) - 1] else path[2 : len(path) - 1] end as inner_path from u join found using (module) where wanted is null or wanted = exported)""",
            recursive=True,
        ),
        "binding_aliases": """select p_partkey as path, local, symbol, module, namespace, member, cast(line as bigint) as line from part, (values ('one', 'a', 'm1', false, null, 1, -1), ('all', null, 'm2', true, null, 2, -1), ('all', null, 'm3', true, null, 3, 0),
              ('other', null, 'm3', true, null, 3, 1), ('p', 'a', 'm1', false, null, 5, -1), ('q', 'go', 'm3', false, null, 6, 0), ('q', 'go', 'm2', false, null, 6, 1), ('o', 'a', 'm1', true, 'k', 7, 3), ('r', 'a', 'm1', false, null, 8, 3))
            as t(local, symbol, module, namespace, member, line, v) where v = -1 or (v in (0, 1) and p_partkey % 2 = v) or (v = 3 and p_partkey % 3 = 0)""",
        "namespace_members": "select p_partkey as path, 'all.go' as expression, case when p_partkey % 2 = 0 then 'm3' else 'm2' end as module, 'go' as symbol from part",
        "chunk_anchors": _with(
            LINES,
            select="""select doc_id, hunk_ix, new_line as line from lines where kind = '+' union
            select doc_id, hunk_ix, unnest([greatest(1, start), greatest(1, start + greatest(nl, 1) - 1)]) from hunks u where not exists (select 1 from lines l where l.doc_id = u.doc_id and l.hunk_ix = u.hunk_ix and l.kind = '+')""",
        ),
        "capped_slices": """select doc_id, label, file, place from (select doc_id, label, file, row_number() over (partition by doc_id order by ord) as place
            from (select user_id as doc_id, event_type as label, 'f' || (event_id % 3) as file, min(event_id) as ord from events group by all)) where place <= doc_id % 5""",
        "agent_assignments": """select doc_id, unnest(range(0, doc_id % 3 + 1)) as segment_ix, agent_id, label from documents, (values ('correctness', 'Correctness'), ('security', 'Security'), ('regression', 'Regression')) as t(agent_id, label)""",
        "agent_comments": """select event_id as ord, agent_id, upper(agent_id[1]) || agent_id[2:] as label, case when event_id % 3 = 0 and event_id % 9 > 0 then 'file' when event_id % 2 = 0 then 'said' end as old_path
            from (select event_id, (['correctness', 'security', 'regression'])[event_id % 3 + 1] as agent_id from events)""",
        "agent_outcomes": """with t as (select user_id as doc_id, cast(count(*) filter (where user_id % 3 = 0 and event_id % 50 = 0) as bigint) as comments, cast(sum(event_id % 7 + event_id % 3) as bigint) as total_tokens,
              case when user_id % 4 = 1 then 'e' || max(event_id) filter (where event_id % 2 = 0) end as last_error, cast(case when user_id % 5 = 2 then 1 else 0 end as bigint) as findings from events group by user_id)
            select *, case when comments > 0 then 'comments' when findings > 0 then 'findings' when last_error is not null then 'error' else 'clean' end as outcome from t""",
        "merged_results": _with(COMMENTS, select="select path, row_number() over (partition by path order by side, ord) as n, 'e' || ord as entry from comments"),
        "entry_counts": "select cast(sum(len(string_split(text, chr(10)))) as bigint) as n from documents",
        "empty_analysis": _with(FILES, select="select distinct path, 0 as findings, 0 as signals from files"),
        "error_counts": "select user_id as cr_id, count(*) filter (where event_type = 'error') + case when user_id % 3 > 0 and user_id % 2 = 1 then 1 else 0 end as errors from events group by user_id",
        "review_scopes": _with(
            LINES, FILES,
            "u as (select doc_id, count(*) as c, string_agg('  - Hunk ' || (hunk_ix + 1) || ': -' || start || ',' || ol || ' / +' || start || ',' || nl, chr(10) order by hunk_ix) as s, string_agg('### Hunk ' || (hunk_ix + 1) || ' (-' || start || ',' || ol || ' / +' || start || ',' || nl || ')' || chr(10) || '```diff' || chr(10) || regexp_replace(content, '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+$', '') || chr(10) || '```', chr(10) || chr(10) order by hunk_ix) as d from hunks group by doc_id)",
            select="""select doc_id, md5('- 文件路径: ' || path || chr(10) || '- 文件类型: Any file' || chr(10) || case when doc_id % 2 = 1 then '- 当前范围: 这是该文件的第 ' || (doc_id % 3 + 1) || '/3 个局部变更段' else '- 当前范围: 当前 prompt 覆盖该文件的全部可评审 diff' end
              || chr(10) || '- Hunk 数量: ' || coalesce(c, 0) || chr(10) || coalesce(s, '')) as scope_md5,
            md5('文件路径: ' || path || case when c is null then chr(10) || '（该文件没有可展示的 diff hunk）' else chr(10) || chr(10) || d end) as diff_md5, '- a' || chr(10) || '- ' || path as checklist from files left join u using (doc_id)""",
        ),
    }
