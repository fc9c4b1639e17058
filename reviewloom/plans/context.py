"""Plans of context, prompts and host data, with their SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import text
from reviewloom.operators import classify, comments, configs, diff, filters, payloads, prompts, segments, symbols
from reviewloom.operators.classify import STRATEGIES
from reviewloom.plans import values
from reviewloom.plans.oracles import FILES, IMPACTS, LINES, _q, _with
from reviewloom.plans.review import _files, _hunks, _lines
from reviewloom.sources import bridge, hosting


def _events(spark, sf):
    return bridge.read(spark, sf, "events")


def json_touched_keys(spark, sf):
    rows = _events(spark, sf).select(F.col("user_id").alias("doc_id"), F.lit(0).alias("hunk_ix"), F.col("event_id").alias("line_ix"), F.expr("concat('  \"', event_type, event_id % 3, '\": ', event_id)").alias("text"))
    return configs.json_keys(rows).select("doc_id", F.col("n").cast("long").alias("n"), "name")


def shell_commands(spark, sf):
    return configs.shell_commands(diff.touched_lines(_lines(spark, sf))).select("doc_id", F.col("n").cast("long").alias("n"), "name")


def kv_config_keys(spark, sf):
    line = "case when event_id % 5 = 0 then concat('[', event_type, ']') when event_id % 7 = 0 then '# remark' else concat(event_type, event_id % 4, ' = ', event_id) end"
    rows = _events(spark, sf).select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line"), F.expr(line).alias("text"))
    return configs.section_keys(rows, rows.filter("line % 2 = 0")).select("doc_id", F.col("n").cast("long").alias("n"), "name")


def yaml_key_paths(spark, sf):
    rows = _events(spark, sf).groupBy(F.col("user_id").alias("doc_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.concat(F.expr("repeat(' ', 1)"), F.repeat(F.lit(" "), (x["event_id"] % 3).cast("int")), x["event_type"], F.lit(": 1"))), "\n").alias("content")
    )
    touched = rows.select("doc_id", F.explode(F.sequence(F.lit(1), F.size(F.split("content", "\n")))).alias("line"))
    return configs.yaml_paths(rows, touched).select("doc_id", F.col("n").cast("long").alias("n"), "name")


def json_top_keys(spark, sf):
    content = F.expr("""if(doc_id % 3 = 0, '[1]', concat('// what\n{"k', doc_id, '": 1, /* more */ "z": {"in": 2}}'))""")
    return configs.top_level_keys(bridge.read(spark, sf, "documents").select("doc_id", content.alias("content"))).select("doc_id", F.col("n").cast("long").alias("n"), "name")


def structured_changes(spark, sf):
    shape = "cast(doc_id % 6 as int) + 1"
    path = F.expr(f"element_at(array('ci/A.YML', 'x\\\\b.jsonc', 'c.toml', 'd/Dockerfile', 'e.ts', '.yml'), {shape})")
    content = F.expr(f"replace(element_at(array('a:\\n  bN: 1', '{{\\n \"kN\": 1', '[s]\\nkN = 1', 'FROM x\\nrunN it', 'a:\\n  b: 1', 'a:\\n  b: 1'), {shape}), 'N', doc_id)")
    files = bridge.read(spark, sf, "documents").select("doc_id", path.alias("path"), content.alias("content"))
    touched = files.select("doc_id", F.lit(2).alias("line"), F.lit(0).alias("hunk_ix"), F.lit(1).alias("line_ix"), F.split("content", "\n")[1].alias("text"))
    return configs.structured_keys(files, touched).select("doc_id", "kind", F.col("n").cast("long").alias("n"), "name")


def prompt_budgets(spark, sf):
    rows = _files(spark, sf).select("doc_id", (F.col("doc_id") % len(STRATEGIES)).alias("s"), (F.col("doc_id") % 3).alias("segments"))
    dim = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(STRATEGIES)], "s long, signal_budget int, code_budget int")
    parts = prompts.budgets(F.col("signal_budget"), F.col("code_budget"), F.col("segments"))
    return rows.join(F.broadcast(dim), "s").select("doc_id", *[p.alias(n) for p, n in zip(parts, ("signals", "slices", "code", "removed"), strict=True)])


def signal_pack(spark, sf):
    rows = _events(spark, sf).select(
        F.col("user_id").alias("doc_id"),
        F.expr("if(event_id % 2 = 0, 'diff-impact', 'contract')").alias("source"),
        F.expr("if(event_id % 3 = 0, null, event_id % 9)").alias("line"),
        F.concat(F.lit("signal of "), "event_type").alias("summary"),
        F.col("event_id").alias("ord"),
    )
    packed = prompts.packed_signals(rows, "doc_id", 110)
    return packed.select("doc_id", F.col("n").cast("long").alias("n"), "rendered", F.col("omitted").cast("long").alias("omitted"))


def context_pack(spark, sf):
    rows = bridge.read(spark, sf, "documents").select(
        F.floor(F.sqrt(F.col("doc_id"))).alias("key"), F.col("doc_id").alias("ord"), F.concat(F.lit("doc "), "doc_id").alias("label"), F.coalesce("text", F.lit("")).alias("body"), F.lit(900).alias("preferred")
    )
    return prompts.packed_blocks(rows, "key", 4000).select("key", F.length("packed").alias("length"), "omitted")


def impact_lines(spark, sf):
    """Impacts of each file's change as signals, with the line that they point to."""
    return classify.impact_signals_of(diff.with_changes(_files(spark, sf))).select("doc_id", F.col("ord").cast("long").alias("ord"), "line", "summary")


def touched_ranges(spark, sf):
    """Ranges of twenty lines that hold an added one."""
    hunks = _hunks(spark, sf)
    ranges = bridge.read(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 7)).alias("n")).withColumns({"start": F.col("n") * 30 + 1, "end": F.col("n") * 30 + 20})
    return diff.touched_ranges(ranges, diff.lines(hunks)).select("doc_id", "n")


def context_sections(spark, sf):
    """The sections of prompts, over items and signals of each event's user."""
    rows = _events(spark, sf)
    key = F.concat(F.col("user_id"), F.lit(":"), F.floor(F.col("event_id") / 4000))
    kind = F.expr("element_at(array('function', 'type', 'slice', 'deleted'), cast(event_id % 4 as int) + 1)")
    body = F.concat(F.lit("x {\n"), F.repeat(F.concat(F.lit("line "), "event_id", F.lit("\n")), (F.col("event_id") % 90).cast("int")), F.lit("}"))
    items = rows.filter("event_id % 3 > 0").select(key.alias("doc_id"), kind.alias("kind"), F.col("event_id").alias("place"), F.concat(F.lit("n"), F.col("event_id") % 20).alias("name"), F.when(F.col("event_id") % 8 < 4, "current").otherwise("a.ts").alias("file"), body.alias("content"))
    signals = rows.filter("event_id % 3 = 0").select(key.alias("doc_id"), F.lit("eslint").alias("source"), (F.col("event_id") % 4).alias("line"), F.concat(F.lit("s"), F.col("event_id") % 30).alias("summary"), F.col("event_id").alias("ord"))
    limits = rows.select(key.alias("doc_id")).distinct().withColumns({"signals": F.lit(40), "slices": F.lit(1500), "code": F.when(F.col("doc_id").like("%1:%"), 0).otherwise(2600), "removed": F.lit(900)})
    made = prompts.context_sections(items, signals, limits)
    return made.select("doc_id", "signals", *[F.md5(F.col(c).cast("binary")).alias(c) for c in ("slices", "code", "removed")])


def snippet_compact(spark, sf):
    rows = bridge.read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return rows.select("doc_id", F.length(prompts.compacted(F.col("t"), F.lit(400))).alias("length"))


def name_parts(spark, sf):
    owner, repo = text.project_parts(F.col("path"))
    sha = F.expr("element_at(array('', '0000', 'abc'), cast(doc_id % 3 as int) + 1)")
    return _files(spark, sf).select(
        "doc_id",
        owner.alias("owner"),
        repo.alias("repo"),
        text.short_path(F.col("path")).alias("short"),
        text.base_sha(sha, F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("parent")))).alias("base_sha"),
        text.review_label(F.when(F.col("doc_id") % 2 == 0, "merge_request").otherwise("commit"), F.col("doc_id").cast("string")).alias("label"),
    )


def number_fields(spark, sf):
    data = F.expr("case event_id % 4 when 0 then props when 1 then '{\"k\": \"12\"}' when 2 then '{\"k\": \" x \"}' else '{}' end")
    return _events(spark, sf).select("event_id", text.number_field(data, "k").alias("number"), text.string_field(data, "k").alias("string"))


def search_paged(spark, sf):
    hits = bridge.import_edges(spark, sf).filter("symbol is not null").select(F.col("symbol").alias("query"), F.col("line").alias("ord"), F.col("importer").alias("path"))
    return hosting.search_paths(hits).select("query", "path", F.col("n").cast("long").alias("n"))


def file_contents(spark, sf):
    rows = bridge.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("head").alias("ref"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"))
    wanted = rows.select("path", "ref")
    mirror = rows.filter("path % 2 = 0").withColumn("content", F.when(F.expr("path % 6 = 0"), "").otherwise(F.col("content")))
    return hosting.contents(wanted, mirror, rows.filter("path % 3 = 0")).select("path", "content")


def latest_versions(spark, sf):
    rows = bridge.read(spark, sf, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("id"), F.concat(F.lit("sha"), "o_orderkey").alias("head"))
    return hosting.latest_versions(rows, "request")


def webhook_events(spark, sf):
    action = F.expr("case event_type when 'view' then 'open' when 'click' then 'update' when 'error' then 'reopen' else 'close' end")
    found = filters.is_code_change(action, F.expr("if(event_id % 3 = 0, 'abc', '')"), F.expr("if(event_id % 5 = 0, 'c', null)"))
    return _events(spark, sf).filter(found).select("event_id")


def retry_delays(spark, sf):
    asked = F.expr("case event_id % 3 when 0 then '2.5' when 1 then 'soon' end")
    status = F.expr("cast(element_at(array(408, 404, 503, 429, null), cast(event_id % 5 as int) + 1) as int)")
    again = filters.is_retryable(status, F.when(F.col("event_id") % 7 == 0, "etimedout"), F.lit(None).cast("string"), F.when(F.col("event_id") % 11 == 0, "Rate limit hit"))
    return _events(spark, sf).select("event_id", payloads.retry_delay_ms(asked, F.col("event_id") % 4).alias("delay_ms"), again.alias("retryable"), filters.is_truthy(F.expr("if(event_id % 2 = 0, ' Yes ', event_type)")).alias("truthy"))


def usage_lines(spark, sf):
    n = lambda k: F.when(F.col("event_id") % k > 0, (F.col("event_id") % k).cast("int"))
    return _events(spark, sf).select("event_id", comments.usage_line(n(2), n(3), n(5)).alias("line"))


def capped_context(spark, sf):
    rows = _events(spark, sf).select(F.col("user_id").alias("doc_id"), F.expr("if(event_id % 2 = 0, 'function', 'type')").alias("kind"), F.col("event_type").alias("name"), F.concat(F.lit("f"), F.col("event_id") % 3).alias("file"), F.col("event_id").alias("ord"))
    caps = rows.select("doc_id", "kind").distinct().withColumn("cap", F.when(F.col("kind") == "function", 3).otherwise(2))
    return symbols.capped_context(rows, caps).select("doc_id", "kind", "name", "file", F.col("place").cast("long").alias("place"))


def scope_segments(spark, sf):
    rows = _events(spark, sf).select(F.col("user_id").alias("doc_id"), "event_id", "event_type")
    return segments.run_segments(rows, "doc_id", "event_id", "event_type").select("doc_id", "event_id", "segment_ix")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        json_touched_keys, shell_commands, kv_config_keys, yaml_key_paths, json_top_keys, structured_changes, prompt_budgets, signal_pack, context_pack, impact_lines, touched_ranges, context_sections, snippet_compact, name_parts, number_fields,
        search_paged, file_contents, latest_versions, webhook_events, retry_delays, usage_lines, capped_context, scope_segments,
    )
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    strategy = ", ".join(f"({i}, {r[1]}, {r[2]})" for i, r in enumerate(values.STRATEGIES))
    first = lambda inner, keep: f"select doc_id, n, name from (select doc_id, name, row_number() over (partition by doc_id order by spot) as n from (select doc_id, name, min(spot) as spot from ({inner}) group by doc_id, name)) where n <= {keep}"
    return {
        "json_top_keys": "select doc_id, n, case when n = 0 then 'k' || doc_id else 'z' end as name from documents, (values (cast(0 as bigint)), (1)) as t(n) where doc_id % 3 <> 0",
        "structured_changes": """select doc_id, kind, cast(1 as bigint) as n, word || doc_id as name from documents join (values (0, 'yaml', 'a.b'), (1, 'json', 'k'), (2, 'keys', 's.k'), (3, 'shell', 'run')) as t(v, kind, word) on doc_id % 6 = v""",
        "json_touched_keys": first("select user_id as doc_id, event_id as spot, event_type || (event_id % 3) as name from events", 10),
        "shell_commands": _with(
            LINES,
            "bare as (select doc_id, hunk_ix, line_ix, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from lines where kind = '+')",
            "named as (select doc_id, hunk_ix * 1000000 + line_ix as spot, regexp_extract(regexp_replace(t, '^([A-Z_][A-Z0-9_]*=(\"[^\"]*\"|''[^'']*''|[^\\s]+)\\s+)*', ''), '^([A-Za-z0-9_./:-]+)', 1) as name from bare where t <> '' and not starts_with(t, '#') and not regexp_matches(t, '^(if|then|else|fi|for|do|done|while|case|esac)\\b'))",
            select=first("select * from named where name <> ''", 10),
        ),
        "kv_config_keys": f"""with l as (select user_id as doc_id, event_id as line, case when event_id % 5 = 0 then event_type end as section, event_id % 5 <> 0 and event_id % 7 <> 0 as is_key, event_type || (event_id % 4) as own from events),
            s as (select *, last_value(section ignore nulls) over (partition by doc_id order by line rows between unbounded preceding and current row) as last_section from l)
            {first("select doc_id, line as spot, case when last_section is null then own else last_section || '.' || own end as name from s where is_key and line % 2 = 0", 10)}""",
        "prompt_budgets": f"""with d(s, a, b) as (values {strategy}), r as (select doc_id, a, b, case when doc_id % 3 > 1 then 0.82 else 1.0 end as f from documents join d on s = doc_id % {len(STRATEGIES)})
            select doc_id, cast(greatest(260, floor(cast(a as double) * 1.0 * f)) as bigint) as signals, cast(greatest(360, floor(cast(b as double) * cast(0.42 as double) * cast(f as double))) as bigint) as slices,
            cast(greatest(520, floor(cast(b as double) * cast(0.58 as double) * cast(f as double))) as bigint) as code, cast(greatest(260, floor(cast(a as double) * cast(0.95 as double) * cast(f as double))) as bigint) as removed from r""",
        "signal_pack": """with s as (select user_id as doc_id, case when event_id % 2 = 0 then '[change-impact]' else '[tsquery]' end as label, case when event_id % 3 = 0 then 0 else event_id % 9 end as line, 'signal of ' || event_type as summary, event_id as ord,
              event_id % 2 as src from events),
            o as (select doc_id, '- ' || label || case when line > 0 then '[line ' || line || ']' else '' end || ' ' || summary as rendered, ord from s qualify row_number() over (partition by doc_id, src, line, summary order by ord) = 1),
            n as (select *, row_number() over w as n, count(*) over (partition by doc_id) as total, sum(length(rendered)) over w as upto from o window w as (partition by doc_id order by ord)),
            k as (select * from n where n <= 8 and (upto <= 110 or n = 1))
            select doc_id, n, rendered, total - max(n) over (partition by doc_id) as omitted from k""",
        "impact_lines": _with(
            LINES, IMPACTS,
            f"told(impact, summary) as (values {', '.join(f'({_q(k)}, {_q(v)})' for k, v in values.IMPACT_TEXTS)})",
            "edges as (select doc_id, greatest(1, start) as s, nl from hunks)",
            """first as (select doc_id, min(case when kind = '+' then new_line end) as a from lines group by doc_id)""",
            "other as (select doc_id, min(greatest(1, s - 1)) as b from edges group by doc_id)",
            "e as (select doc_id, unnest(impacts) as impact, generate_subscripts(impacts, 1) - 1 as ord from impacts)",
            select="select doc_id, ord, coalesce(a, b) as line, summary from e join told using (impact) left join first using (doc_id) left join other using (doc_id)",
        ),
        "touched_ranges": _with(
            LINES,
            "r as (select doc_id, unnest(range(0, doc_id % 7 + 1)) as n from documents)",
            select="select doc_id, n from r where exists (select 1 from lines l where l.doc_id = r.doc_id and kind = '+' and new_line between n * 30 + 1 and n * 30 + 20)",
        ),
        "name_parts": _with(
            FILES,
            select="""select doc_id, regexp_extract(path, '^(.*)/[^/]*$', 1) as owner, split_part(path, '/', -1) as repo,
            case when len(string_split(path, '/')) > 2 then split_part(path, '/', -2) || '/' || split_part(path, '/', -1) else path end as short,
            case when doc_id % 3 = 2 then 'abc' when doc_id % 2 = 0 then 'parent' else '' end as base_sha, case when doc_id % 2 = 0 then 'MR ' else 'Commit ' end || doc_id as label from files""",
        ),
        "number_fields": """select event_id, case event_id % 4 when 0 then cast(json_extract_string(props, '$.k') as double) when 1 then 12.0 end as number,
            case event_id % 4 when 0 then nullif(trim(json_extract_string(props, '$.k')), '') when 1 then '12' when 2 then 'x' end as string from events""",
        "search_paged": """select query, path, n from (select *, row_number() over (partition by query order by ord, path) as n from (select 'f' || (o_orderkey % 8) as query, case when o_custkey % 3 = 0 then 'u' else 'm' end || (o_custkey // 6) as path, min(o_orderkey) as ord
            from orders where o_orderkey % 9 <> 0 group by 1, 2)) where n <= 200""",
        "file_contents": """select cast(doc_id as varchar) as path, case when doc_id % 6 = 0 then '' when doc_id % 2 = 0 or doc_id % 3 = 0 then md5(coalesce(text, '')) else '' end as content from documents""",
        "latest_versions": "select o_custkey as request, max(o_orderkey) as id, 'sha' || max(o_orderkey) as head from orders group by o_custkey",
        "webhook_events": "select event_id from events where event_type in ('view', 'error') or (event_type = 'click' and (event_id % 3 = 0 or event_id % 5 = 0))",
        "retry_delays": """select event_id, case when event_id % 3 = 0 then 2500 else cast(1000 * pow(2, event_id % 4) as bigint) end as delay_ms,
            event_id % 5 in (0, 2, 3) or event_id % 7 = 0 or event_id % 11 = 0 as retryable, event_id % 2 = 0 as truthy from events""",
        "usage_lines": """select event_id, case when event_id % 2 + event_id % 3 + event_id % 5 > 0 then 'Token 消耗: 输入 ' || (event_id % 2) || ' / 输出 ' || (event_id % 3) || ' / 总计 '
              || case when event_id % 5 = 0 then event_id % 2 + event_id % 3 else event_id % 5 end end as line from events""",
        "capped_context": """with i as (select user_id as doc_id, case when event_id % 2 = 0 then 'function' else 'type' end as kind, event_type as name, 'f' || (event_id % 3) as file, min(event_id) as ord from events group by all),
            p as (select *, row_number() over (partition by doc_id, kind order by ord) as place from i)
            select doc_id, kind, name, file, place from p where place <= case when kind = 'function' then 3 else 2 end""",
        "scope_segments": """with r as (select user_id as doc_id, event_id, event_type, case when event_type is distinct from lag(event_type) over w and row_number() over w > 1 then 1 else 0 end as c from events window w as (partition by user_id order by event_id)),
            n as (select *, sum(c) over (partition by doc_id order by event_id) as run from r)
            select doc_id, event_id, cast(case when max(run) over (partition by doc_id) >= 4 then 0 else run end as bigint) as segment_ix from n""",
    }
