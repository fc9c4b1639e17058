"""Plans of hosts' records and of the texts and payloads of reviews, with their SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import text
from reviewloom.operators import bodies, comments, hosts, texts
from reviewloom.plans.oracles import COMMENTS, NOTES, _with
from reviewloom.sources import bridge, writers

#: What a bridge record says of an order: host by its key, some fields missing.
_GITHUB = """to_json(named_struct('id', o_orderkey * 10, 'number', o_orderkey, 'title', concat('T', o_orderkey), 'body', if(o_orderkey % 3 = 0, null, 'text'),
  'html_url', concat('https://h/', o_orderkey), 'user', if(o_orderkey % 5 = 0, null, named_struct('login', concat('u', o_custkey))),
  'head', named_struct('ref', concat('b', o_orderkey % 7), 'sha', concat('h', o_orderkey)), 'base', named_struct('ref', 'main', 'sha', concat('s', o_orderkey % 11))))"""
_GITLAB = """to_json(named_struct('id', o_orderkey * 10, 'iid', o_orderkey, 'title', concat('T', o_orderkey), 'description', if(o_orderkey % 3 = 0, null, 'text'),
  'web_url', concat('https://h/', o_orderkey), 'author', if(o_orderkey % 5 = 0, null, if(o_orderkey % 3 = 1, named_struct('username', '', 'name', concat('n', o_custkey)), named_struct('username', concat('u', o_custkey), 'name', ''))),
  'source_branch', concat('b', o_orderkey % 7), 'target_branch', 'main', 'sha', if(o_orderkey % 9 = 0, '', concat('h', o_orderkey)),
  'diff_refs', if(o_orderkey % 7 = 0, null, named_struct('base_sha', concat('s', o_orderkey % 11), 'start_sha', if(o_orderkey % 13 = 0, '', 'st'), 'head_sha', concat('d', o_orderkey)))))"""


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.read(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("if(o_orderkey % 2 = 0, 'github', 'gitlab')").alias("host"),
        F.lit("own").alias("owner"),
        F.lit("rep").alias("repo"),
        F.expr(f"if(o_orderkey % 2 = 0, {_GITHUB}, {_GITLAB})").alias("data"),
        F.expr("concat('vb', o_orderkey)").alias("version_base"),
        F.expr("if(o_orderkey % 3 = 0, '', 'vs')").alias("version_start"),
        F.expr("concat('vh', o_orderkey)").alias("version_head"),
    )


def request_metadata(spark, sf):
    found = hosts.request_metadata(_requests(spark, sf), ["o_orderkey"])
    return found.drop("owner", "repo", "kind")


def commit_metadata(spark, sf):
    data = F.expr(
        """if(o_orderkey % 2 = 0,
          to_json(named_struct('sha', concat('c', o_orderkey), 'html_url', if(o_orderkey % 3 = 0, null, 'https://x'), 'author', if(o_orderkey % 5 = 0, null, named_struct('login', 'ann')),
            'commit', named_struct('message', if(o_orderkey % 7 = 0, '', concat('  first ', o_orderkey, '\\nrest')), 'author', named_struct('name', 'Bo')), 'parents', array(named_struct('sha', concat('p', o_orderkey))))),
          to_json(named_struct('id', concat('c', o_orderkey), 'short_id', if(o_orderkey % 3 = 0, '', 'shorty'), 'title', if(o_orderkey % 7 = 0, null, concat('first ', o_orderkey)), 'message', if(o_orderkey % 7 = 0, null, 'all of it'),
            'author_name', if(o_orderkey % 5 = 0, null, 'ann'), 'web_url', if(o_orderkey % 3 = 0, null, 'https://x'), 'parent_ids', if(o_orderkey % 9 = 0, array(), array(concat('p', o_orderkey))))))"""
    )
    rows = bridge.read(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("if(o_orderkey % 2 = 0, 'github', 'gitlab')").alias("host"),
        F.lit("own").alias("owner"),
        F.lit("rep").alias("repo"),
        F.lit("dev").alias("branch"),
        F.expr("concat('abcdef', o_orderkey)").alias("head_sha"),
        F.expr("element_at(array('', '0000', 'base'), cast(o_orderkey % 3 as int) + 1)").alias("asked_base"),
        F.expr("if(o_orderkey % 11 = 0, 'asked title', null)").alias("title"),
        F.expr("if(o_orderkey % 11 = 0, 'asked text', '')").alias("description"),
        F.lit(None).cast("string").alias("url"),
        F.expr("if(o_orderkey % 13 = 0, 'eve', null)").alias("author"),
        F.lit("https://w").alias("web_base"),
        data.alias("data"),
    )
    return hosts.commit_metadata(rows, ["o_orderkey"]).select("o_orderkey", "id", "title", "description", "url", "author", "display_id", "base_sha", "start_sha")


_ENTRY = """if(event_id % 2 = 0,
  to_json(named_struct('filename', concat('f', event_id, '.ts'), 'status', element_at(array('added', 'removed', 'renamed', 'changed', 'copied'), cast(event_id % 5 as int) + 1),
    'previous_filename', if(event_id % 5 = 2, concat('o', event_id, '.ts'), null), 'patch', if(event_id % 6 = 0, if(event_id % 4 = 0, null, ' \\n'), '@@ -1 +1 @@'))),
  to_json(named_struct('new_path', concat('f', event_id, '.ts'), 'old_path', concat('f', event_id, '.ts'), 'new_file', event_id % 5 = 0, 'deleted_file', event_id % 3 = 0, 'renamed_file', event_id % 7 = 0,
    'diff', if(event_id % 11 = 0, null, '@@ -1 +1 @@'))))"""


def file_entries(spark, sf):
    rows = bridge.read(spark, sf, "events").select("event_id", F.expr("if(event_id % 2 = 0, 'github', 'gitlab')").alias("host"), F.expr(_ENTRY).alias("data"))
    return hosts.file_entries(rows, ["event_id"])


def compared_files(spark, sf):
    data = """if(event_id % 2 = 0, concat('{"files": [', e, ', ', e, ']}'), concat('{"compare_same_ref": ', event_id % 5 = 0, ', "diffs": [', e, ']}'))"""
    rows = bridge.read(spark, sf, "events").withColumn("e", F.expr(_ENTRY)).select(
        "event_id",
        F.expr("if(event_id % 2 = 0, 'github', 'gitlab')").alias("host"),
        F.expr("if(event_id % 3 = 0, '', 'base')").alias("base_sha"),
        F.expr("if(event_id % 9 = 0, '', 'asked')").alias("asked_base"),
        F.expr("if(event_id % 7 = 0, 'base', 'head')").alias("head_sha"),
        F.expr(data).alias("data"),
    )
    return hosts.compared_files(rows, ["event_id"]).select("event_id", F.col("ord").cast("long").alias("ord"), "path", "old_path", "status")


def changed_paths(spark, sf):
    rows = bridge.file_diffs(spark, sf).select("cr_id", "path", "old_path")
    return hosts.changed_paths(rows, "cr_id").select(F.col("cr_id").cast("long").alias("cr_id"), "path")


def comment_positions(spark, sf):
    rows = bridge.review_comments(spark, sf).withColumn("old_path", F.expr("case ord % 3 when 0 then concat('old/', path) when 1 then '' end"))
    refs = hosts.normalized_refs(F.lit("b"), F.expr("if(ord % 2 = 0, '', 's')"), F.lit("h"))
    placed = rows.select("ord", hosts.comment_position(F.col("path"), F.col("old_path"), F.col("line"), F.col("side"), refs).alias("p"), hosts.commit_comment(F.col("path"), F.col("old_path"), F.col("line"), F.col("side")).alias("c"))
    return placed.select("ord", "p.start_sha", "p.old_path", "p.new_path", "p.old_line", "p.new_line", F.col("c.path").alias("commit_path"), "c.line_type")


def commit_states(spark, sf):
    status = F.expr("element_at(array('queued', 'in_progress', 'completed'), cast(event_id % 3 as int) + 1)")
    result = F.expr("element_at(array('success', 'neutral', 'cancelled', 'failure', null), cast(event_id % 5 as int) + 1)")
    summary, title = F.expr("if(event_id % 2 = 0, repeat('word ', cast(event_id % 40 as int)), '')"), F.expr("if(event_id % 7 = 0, null, event_type)")
    sha = F.concat(F.lit("c"), F.col("event_id"))
    return bridge.read(spark, sf, "events").select(
        "event_id",
        hosts.commit_state(status, result).alias("state"),
        hosts.status_description(summary, title).alias("description"),
        hosts.commit_url(F.expr("if(event_id % 2 = 0, 'github', 'gitlab')"), F.lit("https://w"), F.lit("own"), F.lit("rep"), sha).alias("url"),
        hosts.encoded_path(F.concat(F.lit("a b/"), F.col("event_type"), F.lit("+c/é.ts"))).alias("encoded"),
        text.execution_key(F.lit("own"), F.lit("rep"), F.expr("if(event_id % 2 = 0, 'merge_request', 'commit')"), F.col("event_id"), sha).alias("execution_key"),
        text.file_url(F.lit("https://w"), F.lit("own/rep"), F.concat(F.lit("a/"), F.col("event_type")), sha).alias("file_url"),
    )


def request_checks(spark, sf):
    kind = F.expr("element_at(array('merge_request', 'commit', null), cast(event_id % 3 as int) + 1)")
    number = F.expr("element_at(array('12', '0', '1.5', 'x', null), cast(event_id % 5 as int) + 1)")
    project, branch = F.expr("if(event_id % 7 = 0, '', 'own/rep')"), F.expr("if(event_id % 11 = 0, null, 'dev')")
    display = texts.review_display(F.expr("if(event_id % 2 = 0, 'merge_request', 'commit')"), F.col("event_id"), F.lit("dev"), F.concat(F.lit("0123456"), F.col("event_id")))
    stream = hosts.wants_stream(F.expr("if(event_id % 2 = 0, event_type, ' Yes')"), F.expr("if(event_id % 4 = 0, 'ndjson', null)"), F.expr("if(event_id % 5 = 0, 'text/html, application/x-ndjson', null)"))
    return bridge.read(spark, sf, "events").select("event_id", hosts.request_errors(kind, number, project, branch, F.lit("c1")).alias("error"), display.alias("display"), stream.alias("stream"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    rows = bridge.read(spark, sf, "documents").select(
        "doc_id",
        (F.col("doc_id") % 4).alias("comments"),
        (F.col("doc_id") % 6).alias("files"),
        F.expr("if(doc_id % 5 = 0, doc_id % 12, 0)").alias("errors"),
        F.struct((F.col("doc_id") % 4).alias("attempted"), (F.col("doc_id") % 3).alias("posted"), (F.col("doc_id") % 2).alias("deleted"), (F.col("doc_id") % 5).alias("outdated"), F.expr("if(doc_id % 7 = 0, 2L, 0L)").alias("failed")).alias("sync"),
        text.review_label(F.expr("if(doc_id % 2 = 0, 'merge_request', 'commit')"), F.col("doc_id").cast("string")).alias("label"),
    )
    return rows.withColumn("result", comments.conclusion(F.col("errors"), F.col("doc_id") % 2 == 0, F.col("comments"), F.col("files")))


def result_texts(spark, sf):
    errors = F.transform(F.sequence(F.lit(1), F.col("errors")), lambda i: F.struct(F.concat(F.lit("p"), i).alias("path"), F.lit("broken").alias("message")))
    errors = F.when(F.col("errors") > 0, errors).otherwise(F.expr("cast(array() as array<struct<path:string,message:string>>)"))
    paths = F.transform(F.sequence(F.lit(0), F.col("doc_id") % 15), lambda i: F.concat(F.lit("f"), i))
    return _results(spark, sf).select(
        "doc_id",
        texts.completion_summary(F.col("result"), F.col("comments"), F.col("files"), F.col("errors"), F.col("sync")).alias("summary"),
        texts.completion_text(F.col("label"), F.col("result"), F.col("files"), F.col("sync"), errors).alias("text"),
        texts.skipped_summary(F.col("files")).alias("skipped"),
        F.md5(texts.skipped_text(F.col("label"), F.col("files")).cast("binary")).alias("skipped_md5"),
        texts.progress_summary(F.lit("SMALL"), F.col("errors"), F.col("files"), F.lit(2), F.lit(3), F.lit(4)).alias("progress"),
        texts.progress_text(F.col("label"), F.lit("T"), F.lit("ann"), F.lit("dev"), F.lit("main"), F.lit("SMALL"), F.col("errors"), paths).alias("progress_text"),
        texts.completion_progress(F.col("result"), F.col("files"), F.col("comments"), F.col("errors"), F.col("sync.failed")).alias("message"),
    )


def _notified(spark: SparkSession, sf: str) -> DataFrame:
    found = bridge.review_comments(spark, sf).groupBy("cr_id").agg(F.array_sort(F.collect_list(F.struct("ord", "path", "line", "body", "side"))).alias("all"))
    return found.select("cr_id", F.transform(F.slice("all", 1, 7), lambda x: F.struct(x["path"].alias("path"), x["line"].alias("line"), x["body"].alias("body"), x["side"].alias("side"))).alias("comments"))


def notifications(spark, sf):
    usage = F.struct(F.col("cr_id").alias("prompt"), (F.col("cr_id") + 1).alias("completion"), (F.col("cr_id") * 2 + 1).alias("total"))
    name = F.col("cr_id").cast("string")
    title, lines = texts.result_notification(
        name, F.lit("gitlab"), F.lit("own/rep"), F.concat(F.lit("!"), name), F.expr("if(cr_id % 2 = 0, '', 'T')"), F.lit("failure"), F.lit(3), F.lit(1), usage, F.expr("if(cr_id % 3 = 0, null, 'https://h')"), F.col("comments")
    )
    bad_title, bad_lines = texts.failure_notification(name, F.lit("github"), F.lit("own/rep"), F.lit("commit"), name, F.lit("no route"))
    address = texts.webhook_address(F.expr("element_at(array(' HTTPS://x ', '', 'ftp://x', null), cast(cr_id % 4 as int) + 1)"))
    return _notified(spark, sf).select("cr_id", title.alias("title"), F.array_join(lines, "\n").alias("lines"), bad_title.alias("failed_title"), F.array_join(bad_lines, "\n").alias("failed_lines"), address.alias("address"))


def response_payloads(spark, sf):
    usage = F.struct(F.col("cr_id").alias("prompt"), (F.col("cr_id") + 1).alias("completion"), (F.col("cr_id") * 2 + 1).alias("total"))
    sync = F.struct(F.lit(1).alias("posted"), F.lit(2).alias("deleted"), F.lit(3).alias("outdated"), F.lit(0).alias("failed"))
    findings = F.transform("comments", lambda x: F.concat(x["path"], F.lit(":"), x["line"]))
    payload = texts.response_payload(F.concat(F.lit("!"), "cr_id"), F.concat(F.lit("r"), "cr_id"), F.lit("success"), F.lit(4), F.lit(0), sync, usage, findings, F.col("comments"))
    return _notified(spark, sf).select("cr_id", payload.alias("p")).select(
        "cr_id", "p.review", "p.requestId", "p.commentCount", "p.syncedCommentCount", "p.tokenUsageTotal", F.array_join("p.findings", ",").alias("findings"), F.element_at("p.comments", 1)["side"].alias("first_side")
    )


def event_envelopes(spark, sf):
    rows = _results(spark, sf).select(
        F.col("doc_id").alias("request_id"), F.lit("own").alias("owner"), F.lit("rep").alias("repo"), F.lit("commit").alias("kind"),
        comments.http_status(F.col("errors"), F.col("result")).alias("status"), "files", "errors", "sync.posted", "sync.failed", F.expr("if(doc_id % 13 = 0, 'lost', null)").alias("error"),
    )
    return texts.envelopes(rows)


def heartbeat_messages(spark, sf):
    done, total = F.expr("if(event_id % 5 = 0, null, event_id % 4)"), F.expr("if(event_id % 7 = 0, 0, 3)")
    return bridge.read(spark, sf, "events").select("event_id", texts.heartbeat_message(done, total, F.expr("if(event_id % 3 = 0, '', event_type)")).alias("message"))


def contract_texts(spark, sf):
    change = F.expr("element_at(array('removed', 'kind_changed', 'signature_changed', 'moved'), cast(p_partkey % 4 as int) + 1)")
    name = F.concat(F.lit("f"), F.col("p_partkey"))
    told = texts.contract_description(change, name, F.expr("if(p_partkey % 3 = 0, '', 'value')"), F.lit("class"), F.lit("f(a)"), F.expr("if(p_partkey % 5 = 0, null, 'f(a, b)')"))
    return bridge.read(spark, sf, "part").select("p_partkey", told.alias("description"), F.md5(texts.exporter_signal(told).cast("binary")).alias("signal_md5"))


_BODY = """case doc_id % 10 when 0 then ' plain remark\\r\\nmore ' when 1 then concat('Do so.\\n代码示例: const a = ', doc_id, ';') when 2 then '代码示例：\\n```\\nreturn 1\\n```'
  when 3 then 'Fix.\\n代码示例:\\n```js\\nx()\\n```' when 4 then 'See 代码示例: `await go(1)`' when 5 then 'See 代码示例: just words' when 6 then 'Do.  代码示例:  '
  when 7 then 'In the image:\\n代码示例:\\nRUN make\\nCMD run' when 8 then '代码示例: ```broken' else 'Use.\\n代码示例:\\nlet words\\nonly here' end"""
_PATH = "concat('a/b', element_at(array('.TSX', '.ts', '.jsx', '.js', '.yml', '.yaml', '.jsonc', '.json', '.py', ''), cast(doc_id % 10 as int) + 1))"


def normalized_bodies(spark, sf):
    rows = bridge.read(spark, sf, "documents").select("doc_id", F.expr(_BODY).alias("body"), F.expr(_PATH.replace("doc_id", "(doc_id div 10)")).alias("path"))
    made = bodies.normalized_body(F.col("body"), F.col("path"))
    usage = comments.usage_line(F.col("doc_id") % 2, F.col("doc_id") % 3, F.lit(None).cast("long"))
    return rows.select("doc_id", made.alias("body"), bodies.looks_like_code(F.col("body")).alias("code"), F.length(bodies.with_usage(F.lit("b"), usage)).alias("with_usage"))


def comment_sync(spark, sf):
    """What a writer is told: old comments of ours to delete or to mark, new ones to post."""
    new = bridge.review_comments(spark, sf).select(F.concat(F.lit("r"), "cr_id").alias("resource"), "path", "line", "side", "body")
    notes = bridge.discussion_notes(spark, sf).withColumn("resource", F.concat(F.lit("r"), F.col("discussion_id") % 100))
    users = bridge.read(spark, sf, "region").filter("r_regionkey = 0").select(F.lit("review-bot").alias("login"))
    actions = writers.sync_actions(new, notes, users)
    return actions.select("resource", "action", "note_id", "path", "line", "side", F.md5(F.col("body").cast("binary")).alias("body_md5"), "key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        request_metadata, commit_metadata, file_entries, compared_files, changed_paths, comment_positions, commit_states, request_checks, result_texts,
        notifications, response_payloads, event_envelopes, heartbeat_messages, contract_texts, normalized_bodies, comment_sync,
    )
    return {f.__name__: f for f in listed}


_RESULTS = """results as (
  select *, case when errors > 0 or (doc_id % 2 = 0 and comments > 0) then 'failure' when files = 0 then 'neutral' else 'success' end as result
  from (select doc_id, doc_id % 4 as comments, doc_id % 6 as files, case when doc_id % 5 = 0 then doc_id % 12 else 0 end as errors,
          doc_id % 4 as attempted, doc_id % 3 as posted, doc_id % 2 as deleted, doc_id % 5 as outdated, case when doc_id % 7 = 0 then 2 else 0 end as failed,
          case when doc_id % 2 = 0 then 'MR ' else 'Commit ' end || doc_id as label from documents))"""
_ENTRIES = """entries as (
  select event_id, 'f' || event_id || '.ts' as path, case when event_id % 2 = 1 then 'f' || event_id || '.ts' when event_id % 5 = 2 then 'o' || event_id || '.ts' end as old_path,
    case when event_id % 2 = 0 then (['added', 'deleted', 'renamed', 'modified', 'modified'])[event_id % 5 + 1]
      when event_id % 5 = 0 then 'added' when event_id % 3 = 0 then 'deleted' when event_id % 7 = 0 then 'renamed' else 'modified' end as status,
    case when event_id % 2 = 1 and event_id % 11 = 0 then '' else '@@ -1 +1 @@' end as patch
  from events where event_id % 2 = 1 or event_id % 6 <> 0)"""
_SHOWN = """shown as (select user_id as cr_id, event_id as ord, 'src/f' || (event_id % 7) || '.ts' as path, event_id % 13 + 1 as line, case when event_id % 3 = 0 then 'LEFT' else 'RIGHT' end as side,
    case when event_id % 4 = 0 then 'Token 消耗: ' || event_id else 'issue ' || event_type || ' ' || (event_id % 5) end as first_line,
    row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as total from events)"""


def oracle_sql() -> dict[str, str]:
    outdated = "m || chr(10) || '<!-- ai-review-outdated:mr -->' || chr(10) || '> outdated by a newer review' || chr(10) || chr(10) || regexp_replace(case when contains(b, m) then substr(b, 1, instr(b, m) - 1) || substr(b, instr(b, m) + length(m)) else b end, '^\\s+|\\s+$', '', 'g')"
    key = lambda *parts: "substr(sha256(" + " || chr(1) || ".join(f"cast({x} as varchar)" for x in parts) + "), 1, 24)"
    return {
        "comment_sync": _with(
            NOTES, COMMENTS,
            "bare as (select 'r' || (discussion_id % 100) as resource, *, regexp_replace(body, '^\\s+|\\s+$', '', 'g') as b, '<!-- ai-review:mr -->' as m from notes where not is_system)",
            "shown as (select *, (contains(b, m) or starts_with(b, 'Token 消耗:') or starts_with(b, '💡 **[')) and author = 'review-bot' as ours from bare)",
            "totals as (select resource, discussion_id, count(*) as n, count(*) filter (where ours) as o from shown group by all having count(*) filter (where ours) > 0)",
            f"""old as (select resource, case when n = o then 'delete' when not contains(body, '<!-- ai-review-outdated:mr -->') then 'outdate' end as action, cast(note_id as varchar) as note_id, {outdated} as made
              from shown join totals using (resource, discussion_id) where ours)""",
            select=f"""select resource, action, note_id, null as path, cast(null as int) as line, null as side, case when action = 'outdate' then md5(made) end as body_md5, {key("action", "resource", "note_id")} as key from old where action is not null
            union all select distinct 'r' || cr_id, 'post', null, path, cast(line as int), side, md5('<!-- ai-review:mr -->' || chr(10) || body), {key("'r' || cr_id", "path", "line", "side", "body")} from comments""",
        ),
        "request_metadata": """select o_orderkey, cast(o_orderkey * 10 as varchar) as id, o_orderkey as number, 'T' || o_orderkey as title, case when o_orderkey % 3 = 0 then '' else 'text' end as description,
            'https://h/' || o_orderkey as url, 'b' || (o_orderkey % 7) as source_branch,
            case when o_orderkey % 2 = 0 or o_orderkey % 9 <> 0 then 'h' || o_orderkey when o_orderkey % 7 = 0 then 'vh' || o_orderkey else 'd' || o_orderkey end as head_sha, 'main' as target_branch,
            case when o_orderkey % 5 = 0 then 'unknown' when o_orderkey % 2 = 1 and o_orderkey % 3 = 1 then 'n' || o_custkey else 'u' || o_custkey end as author,
            case when o_orderkey % 2 = 0 then '#' else '!' end || o_orderkey as display_id,
            case when o_orderkey % 2 = 1 and o_orderkey % 7 = 0 then 'vb' || o_orderkey else 's' || (o_orderkey % 11) end as base_sha,
            case when o_orderkey % 2 = 0 then 's' || (o_orderkey % 11) when o_orderkey % 7 = 0 then case when o_orderkey % 3 = 0 then 'vb' || o_orderkey else 'vs' end
              when o_orderkey % 13 = 0 then 's' || (o_orderkey % 11) else 'st' end as start_sha from orders""",
        "commit_metadata": """select o_orderkey, 'c' || o_orderkey as id,
            case when o_orderkey % 11 = 0 then 'asked title' when o_orderkey % 7 <> 0 then 'first ' || o_orderkey
              else 'Review commit ' || case when o_orderkey % 2 = 1 and o_orderkey % 3 > 0 then 'shorty' else substr('abcdef' || o_orderkey, 1, 8) end end as title,
            case when o_orderkey % 11 = 0 then 'asked text' when o_orderkey % 7 = 0 then 'Push review for dev' when o_orderkey % 2 = 0 then '  first ' || o_orderkey || chr(10) || 'rest' else 'all of it' end as description,
            case when o_orderkey % 3 > 0 then 'https://x' else 'https://w/own/rep/' || case when o_orderkey % 2 = 0 then 'commit/' else '-/commit/' end || 'abcdef' || o_orderkey end as url,
            case when o_orderkey % 13 = 0 then 'eve' when o_orderkey % 5 > 0 then 'ann' when o_orderkey % 2 = 0 then 'Bo' else 'unknown' end as author,
            'dev@' || case when o_orderkey % 2 = 1 and o_orderkey % 3 > 0 then 'shorty' else substr('abcdef' || o_orderkey, 1, 8) end as display_id,
            b as base_sha, b as start_sha from (select *, case when o_orderkey % 3 = 2 then 'base' when o_orderkey % 2 = 1 and o_orderkey % 9 = 0 then '' else 'p' || o_orderkey end as b from orders)""",
        "file_entries": f"with {_ENTRIES} select event_id, path, old_path, status, patch from entries",
        "compared_files": f"""with {_ENTRIES} select event_id, cast(o as bigint) as ord, path, old_path, status from entries, (values (0), (1)) as t(o)
            where (o = 0 or event_id % 2 = 0) and (event_id % 3 > 0 or event_id % 9 > 0) and not (event_id % 3 > 0 and event_id % 7 = 0) and not (event_id % 2 = 1 and event_id % 5 = 0)""",
        "changed_paths": """with f as (select cast(floor(sqrt(doc_id)) as bigint) as cr_id, doc_id, replace((['src/services/doc_N.ts', 'src/components/DocN.tsx', 'src/hooks/use_doc_N.ts', 'config/app_N.json', 'tests/doc_N.test.ts',
              'docs/doc_N.md', 'src/auth/doc_N.ts', '.github/workflows/doc_N.yml', 'scripts/run_N.sh', 'packages/p_N/pnpm-lock.yaml', 'src/lib/math_N.ts', 'ci/steps_N.yaml'])[doc_id % 12 + 1], 'N', cast(doc_id as varchar)) as path from documents)
            select cr_id, path from f union select cr_id, 'old/' || path from f where doc_id % 6 = 2""",
        "comment_positions": """select event_id as ord, case when event_id % 2 = 0 then 'b' else 's' end as start_sha, case when event_id % 3 = 0 then 'old/' else '' end || p as old_path, p as new_path,
            case when event_id % 3 = 0 then event_id % 13 + 1 end as old_line, case when event_id % 3 > 0 then event_id % 13 + 1 end as new_line,
            case when event_id % 3 = 0 then 'old/' else '' end || p as commit_path, case when event_id % 3 = 0 then 'old' else 'new' end as line_type
            from (select *, 'src/f' || (event_id % 7) || '.ts' as p from events)""",
        "commit_states": """select event_id, case when event_id % 3 < 2 then 'pending' when event_id % 5 < 2 then 'success' when event_id % 5 = 2 then 'error' else 'failure' end as state,
            case when length(d) > 140 then substr(d, 1, 137) || '...' else d end as description,
            'https://w/own/rep/' || case when event_id % 2 = 0 then 'commit/' else '-/commit/' end || 'c' || event_id as url, 'a%20b/' || event_type || '%2Bc/%C3%A9.ts' as encoded,
            'own:rep:' || case when event_id % 2 = 0 then 'merge_request:' || event_id else 'commit:c' || event_id end as execution_key,
            'https://w/projects/own%2Frep/repository/files/a%2F' || event_type || '?ref=c' || event_id as file_url
            from (select *, coalesce(nullif(case when event_id % 2 = 0 then repeat('word ', event_id % 40) else '' end, ''), case when event_id % 7 > 0 then event_type end, 'AI review update') as d from events)""",
        "request_checks": """select event_id, case when event_id % 7 = 0 then 'projectPath is required' when event_id % 3 = 0 or event_id % 5 < 4 then case when event_id % 5 > 0 then 'mergeRequestIid is required for merge_request review' end
              when event_id % 11 = 0 then 'branch and headSha are required for commit review' end as error,
            case when event_id % 2 = 0 then 'MR/PR #' || event_id else 'dev@' || substr('0123456' || event_id, 1, 8) end as display, event_id % 2 = 1 or event_id % 4 = 0 or event_id % 5 = 0 as stream from events""",
        "result_texts": f"""with {_RESULTS}
            select doc_id,
              case when failed > 0 then 'AI review 执行失败，评论同步发布 ' || posted || ' 条、清理 ' || deleted || ' 条、标记过期 ' || outdated || ' 条，另有 ' || failed || ' 条同步失败。'
                when errors > 0 then 'AI review 执行失败，分析了 ' || files || ' 个文件，其中 ' || errors || ' 个文件处理失败，请查看日志。'
                when result = 'failure' and comments > 0 then 'AI review 未通过，分析了 ' || files || ' 个文件，并发布了 ' || comments || ' 条阻断评论。'
                when result = 'neutral' and files = 0 then 'AI review 已跳过，过滤后没有高信号文件进入 review 主链。'
                when comments > 0 then 'AI review 已完成，分析了 ' || files || ' 个文件，并发布了 ' || comments || ' 条 review 评论。'
                else 'AI review 已通过，分析了 ' || files || ' 个文件，未发现需要发布的高信号评论。' end as summary,
              case when failed > 0 then label || ' review completed with comment sync failures.' || n || '分析文件数: ' || files || n || '尝试评论数: ' || attempted || n || '已发布评论数: ' || posted || n || '已删除旧评论数: ' || deleted || n || '已标记过期评论数: ' || outdated || n || '评论同步失败数: ' || failed
                when errors = 0 then label || ' review completed.' || n || 'Review 结果: ' || case when result = 'failure' and posted > 0 then '未通过' when result = 'success' then '通过' when result = 'neutral' then '已跳过' else '已完成' end
                  || n || '分析文件数: ' || files || n || '发布评论数: ' || posted || n || '删除旧评论数: ' || deleted || n || '标记过期评论数: ' || outdated
                else label || ' review completed with partial failures.' || n || '分析文件数: ' || files || n || '发布评论数: ' || posted || n || '删除旧评论数: ' || deleted || n || '标记过期评论数: ' || outdated || n || '失败文件数: ' || errors || n || n || '失败详情:' || n
                  || array_to_string(list_transform(range(1, least(errors, 8) + 1), lambda i: '- p' || i || ': broken'), chr(10)) || case when errors > 8 then n || '- ... 另有 ' || (errors - 8) || ' 个文件失败' else '' end end as text,
              'AI review 已跳过：共拿到 ' || files || ' 个变更文件，但过滤后没有高信号文件进入 review 主链。' as skipped,
              md5(label || ' review skipped.' || n || '原始变更文件数: ' || files || n || '进入 review 主链的文件数: 0' || n || '原因: 当前 diff 仅包含被过滤的低信号文件，例如锁文件、构建产物、图片或普通文档改动。') as skipped_md5,
              '正在分析 ' || files || ' 个文件，规模 SMALL，风险分 ' || errors || '，review agent 4 个，文件并发 2，LLM 并发 3。' as progress,
              label || ': T' || n || '作者: ann' || n || '分支: dev -> main' || n || '规模: SMALL' || n || '风险分: ' || errors || n || n || '文件预览:' || n
                || array_to_string(list_transform(range(0, least(doc_id % 15, 11) + 1), lambda i: '- f' || i), chr(10)) || case when doc_id % 15 > 11 then n || '- ... 另有 ' || (doc_id % 15 - 11) || ' 个文件' else '' end as progress_text,
              case when failed > 0 then '💥 AI Review 完成，但评论同步失败 ' || failed || ' 条，请查看日志' when errors > 0 then '⚠️ AI Review 完成，但有 ' || errors || ' 个文件处理失败'
                when result = 'failure' then '❌ AI Review 完成：共 ' || files || ' 个文件，发现 ' || comments || ' 条问题' when comments > 0 then '✅ AI Review 完成：共 ' || files || ' 个文件，发布 ' || comments || ' 条评论'
                else '✅ AI Review 完成：共 ' || files || ' 个文件，未发现阻断问题' end as message
            from (select *, chr(10) as n from results)""",
        "notifications": f"""with {_SHOWN}
            select cr_id, 'AI Review FAILURE - own/rep' as title, '请求 ID：' || cr_id || chr(10) || '代码平台：gitlab' || chr(10) || '项目：own/rep' || chr(10) || '评审对象：!' || cr_id || chr(10) || '标题：' || case when cr_id % 2 = 0 then '-' else 'T' end
                || chr(10) || '结论：failure' || chr(10) || '评审文件数：3' || chr(10) || '评论数：' || least(max(total), 7) || chr(10) || '错误文件数：1' || chr(10) || '输入 Tokens：' || cr_id || chr(10) || '输出 Tokens：' || (cr_id + 1)
                || chr(10) || '总 Tokens：' || (cr_id * 2 + 1) || chr(10) || '详情链接：' || case when cr_id % 3 = 0 then '-' else 'https://h' end || chr(10) || chr(10) || 'Top Findings:' || chr(10)
                || string_agg('- ' || path || ':' || line || ' ' || trim(first_line), chr(10) order by n) filter (where n <= 5) as lines,
              'AI Review FAILED - own/rep' as failed_title, '请求 ID：' || cr_id || chr(10) || '代码平台：github' || chr(10) || '项目：own/rep' || chr(10) || '评审类型：commit' || chr(10) || '评审对象：' || cr_id || chr(10) || '执行结果：failed' || chr(10) || '错误信息：no route' as failed_lines,
              case when cr_id % 4 = 0 then 'HTTPS://x' end as address
            from shown group by cr_id""",
        "response_payloads": f"""with {_SHOWN}
            select cr_id, '!' || cr_id as review, 'r' || cr_id as "requestId", cast(least(max(total), 7) as int) as "commentCount", 1 as "syncedCommentCount", cr_id * 2 + 1 as "tokenUsageTotal",
              string_agg(path || ':' || line, ',' order by n) filter (where n <= 7) as findings, arg_min(side, n) as first_side from shown group by cr_id""",
        "event_envelopes": f"""with {_RESULTS}, s as (select *, case when errors > 0 then 500 when result = 'failure' then 409 else 200 end as status from results)
            select doc_id as request_id, 'accepted' as type, cast(null as int) as status_code, '🤖 已接收 AI Review 请求，目标 own/rep（commit）' as message, cast(null as int) as percent from s
            union all select doc_id, 'error', 500, '💥 AI Review 执行失败：lost', null from s where doc_id % 13 = 0
            union all select doc_id, 'result', status, case when status = 500 then '💥 AI Review 执行失败：共 ' || files || ' 个文件，处理失败 ' || errors || ' 项，评论同步失败 ' || failed || ' 条'
                when status = 409 then '❌ AI Review 未通过：共 ' || files || ' 个文件，同步 ' || posted || ' 条评论' when posted > 0 then '✅ AI Review 已完成：共 ' || files || ' 个文件，同步 ' || posted || ' 条评论'
                else '✅ AI Review 已通过：共 ' || files || ' 个文件，未发现阻断问题' end, case when files > 0 then 100 end from s where doc_id % 13 > 0""",
        "heartbeat_messages": """select event_id, '⏳ AI Review 进行中' || case when known then '，已完成 ' || (event_id % 4) || '/3 个文件' else '' end
            || case when event_id % 3 > 0 and (not known or event_id % 4 < 3) then '，当前 ' || event_type else '' end as message
            from (select *, event_id % 5 > 0 and event_id % 7 > 0 as known from events)""",
        "contract_texts": """select p_partkey, d as description, md5('检测到跨文件契约变更：' || d) as signal_md5 from (select p_partkey, case p_partkey % 4 when 0 then '导出符号 f' || p_partkey || ' 已被移除'
              when 1 then '导出符号 f' || p_partkey || ' 的类型已从 ' || case when p_partkey % 3 = 0 then '旧类型' else 'value' end || ' 变为 class'
              when 2 then '导出函数 f' || p_partkey || ' 的签名已从 f(a) 变为 ' || case when p_partkey % 5 = 0 then '新签名' else 'f(a, b)' end else '导出符号 f' || p_partkey || ' 发生了契约变化' end as d from part)""",
        "normalized_bodies": """with l as (select doc_id, doc_id % 10 as v, (['tsx', 'ts', 'jsx', 'js', 'yaml', 'yaml', 'json', 'json', 'ts', 'ts'])[doc_id // 10 % 10 + 1] as lang, chr(10) as n, '代码示例:' as h from documents)
            select doc_id, case v when 0 then 'plain remark' || n || 'more' when 1 then 'Do so.' || n || n || h || n || n || '```' || lang || n || 'const a = ' || doc_id || ';' || n || '```'
                when 2 then h || n || n || '```' || lang || n || 'return 1' || n || '```' when 3 then 'Fix.' || n || n || h || n || n || '```js' || n || 'x()' || n || '```'
                when 4 then 'See' || n || n || h || n || n || '```' || lang || n || 'await go(1)' || n || '```' when 5 then 'See 代码示例: just words' when 6 then 'Do.  代码示例:'
                when 7 then 'In the image:' || n || n || h || n || n || '```bash' || n || 'RUN make' || n || 'CMD run' || n || '```' when 8 then h || n || n || '```broken'
                else 'Use.' || n || n || h || n || n || '```' || lang || n || 'let words' || n || 'only here' || n || '```' end as body,
              v in (1, 2, 3, 4, 7, 9) as code,
              case when doc_id % 2 + doc_id % 3 > 0 then cast(length('Token 消耗: 输入 0 / 输出 0 / 总计 0') as int) + 3 else 1 end as with_usage from l""",
    }
