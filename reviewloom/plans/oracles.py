"""The plans' results in DuckDB's SQL, written on its own from the same definitions."""

from __future__ import annotations

from reviewloom.plans import values
from reviewloom.sources.bridge import PATHS, STATUSES


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _words(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, {_q(w)})" for w in words) + ")"


LINES = """raw_lines as (
  select doc_id, k, line from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as k from documents)),
body as (
  select doc_id, k, k // 10 as h,
    case when (doc_id * 7 + k) % 5 = 0 then '-' when (doc_id * 7 + k) % 5 <= 2 then '+' else ' ' end as op,
    case (doc_id + k) % 11 when 0 then 'if (!value) return null; // ' when 1 then 'const token = session.verify; '
      when 2 then 'select id from t where tenant_id = 1; ' when 3 then 'await transaction.commit(); ' else '' end || line as rest
  from raw_lines where line <> '' and k % 10 < 7),
hunks as (
  select doc_id, h, row_number() over (partition by doc_id order by h) - 1 as hunk_ix, h * 10 * (1 + doc_id % 5) + 1 as start, ol, nl,
    '@@ -' || (h * 10 * (1 + doc_id % 5) + 1) || case when ol = 1 then '' else ',' || ol end || ' +' || (h * 10 * (1 + doc_id % 5) + 1)
      || case when nl = 1 then '' else ',' || nl end || ' @@' || chr(10) || txt || chr(10) as content
  from (select doc_id, h, count(*) filter (where op <> '+') as ol, count(*) filter (where op <> '-') as nl,
          string_agg(op || rest, chr(10) order by k) as txt from body group by doc_id, h)),
kinds as (
  select doc_id, h, k, row_number() over (partition by doc_id, h order by k) as line_ix, op || rest as l,
    case when op = '+' and not starts_with(rest, '++') then '+' when op = '-' and not starts_with(rest, '--') then '-' else ' ' end as kind from body),
lines as (
  select k.doc_id, u.hunk_ix, k.line_ix, k.kind, case when k.kind = ' ' then l else substr(l, 2) end as text,
    u.start + coalesce(count(*) filter (where k.kind <> '-') over w, 0) as new_line,
    u.start + coalesce(count(*) filter (where k.kind <> '+') over w, 0) as old_line
  from kinds k join hunks u on u.doc_id = k.doc_id and u.h = k.h
  window w as (partition by k.doc_id, k.h order by k.line_ix rows between unbounded preceding and 1 preceding))"""

FILES = f"""files as (
  select cast(floor(sqrt(doc_id)) as bigint) as cr_id, doc_id, replace(({_list(PATHS)})[doc_id % {len(PATHS)} + 1], 'N', cast(doc_id as varchar)) as path,
    case ({_list(STATUSES)})[doc_id % {len(STATUSES)} + 1] when 'removed' then 'deleted' when 'added' then 'added' when 'renamed' then 'renamed' else 'modified' end as status
  from documents)"""

_SCRIPT = "ext in (" + ", ".join(_q(x) for x in values.SCRIPT_ENDINGS) + ")"
PREDICATES = f"""predicates as (
  select *, regexp_matches(path, {_q(values.any_of(values.IGNORED))}) as ignored, regexp_matches(path, '[.](md|mdx|txt)$', 'i') as documentation,
    regexp_matches(lower(path), {_q(values.any_of(values.DEPLOYMENT))}) as deployment, regexp_matches(path, {_q(values.any_of(values.HIGH_RISK))}) as high_risk,
    regexp_extract(split_part(lower(path), '/', -1), '^.+([.][^.]*)$', 1) as ext, split_part(lower(path), '/', -1) as base from files)"""

BLANK_ONLY = """blank_only as (
  select doc_id from (
    select doc_id, n, max(case when kind = '+' then bare end) as a, max(case when kind = '-' then bare end) as r
    from (select doc_id, kind, row_number() over (partition by doc_id, kind order by hunk_ix, line_ix) as n, regexp_replace(text, '\\s+', '', 'g') as bare
          from lines where kind <> ' ') group by doc_id, n) group by doc_id having bool_and(coalesce(a = r, false)))"""

REVIEWABLE = """reviewable as (
  select * from predicates p where not ignored and not documentation and not deployment
    and doc_id in (select doc_id from hunks) and doc_id not in (select doc_id from blank_only))"""

KINDS = f"""texts as (select doc_id, lower(string_agg(content, chr(10) order by hunk_ix)) as t from hunks group by doc_id),
file_kinds as (
  select doc_id, case
    when regexp_matches(low, {_q(values.any_of(values.CI_PATHS))}) or (ext in ('.yml', '.yaml') and {_words("t", values.CI_WORDS)}) then 'ci_pipeline'
    when regexp_matches(low, {_q(values.any_of(values.TEST_PATHS))}) then 'test'
    when ext in ('.md', '.mdx', '.txt') or base = 'readme' then 'docs'
    when base = '.env' or starts_with(base, '.env.') or contains(low, '/.env') or ends_with(low, '/.npmrc') or ends_with(low, '/.yarnrc')
      or ext in ({", ".join(_q(x) for x in values.CONFIG_ENDINGS)}) then 'app_config'
    when {_SCRIPT} and (ext in ('.tsx', '.jsx') or regexp_matches(low, {_q(values.REACT_PATH)}) or {_words("t", values.REACT_WORDS)}) then 'react_component'
    when {_SCRIPT} and (regexp_matches(low, {_q(values.FRONTEND_PATH)}) or {_words("t", values.FRONTEND_WORDS)}) then 'frontend_module'
    when {_SCRIPT} and (regexp_matches(low, {_q(values.BACKEND_PATH)}) or {_words("t", values.BACKEND_WORDS)}) then 'backend_service'
    when {_SCRIPT} then 'backend_module' else 'generic' end as kind
  from (select p.*, lower(path) as low, coalesce(t, '') as t from predicates p left join texts using (doc_id)))"""

IMPACTS = f"""impact_flags as (
  select doc_id, bool_or(kind = '-') and not bool_or(kind = '+') as pure_removal,
    {", ".join(f"bool_or(kind = '-' and trim(text) <> '' and regexp_matches(trim(text), {_q(p)})) as {n}" for n, p in values.IMPACT)}
  from lines group by doc_id),
impacts as (
  select doc_id, list_slice(list_filter([case when pure_removal then 'pure_removal' end, {", ".join(f"case when {n} then '{n}' end" for n, _ in values.IMPACT)}],
    lambda x: x is not null), 1, 3) as impacts from impact_flags)"""

COUNTS = """counts as (select doc_id, count(*) filter (where kind = '+') as added, count(*) filter (where kind = '-') as removed from lines group by doc_id)"""

RISKS = """risks as (
  select cr_id, doc_id, kind, added + removed as changed, cast(
    case when high_risk then 10 else 0 end + ceil((added + removed) / 12.0) + ceil(removed / 10.0) + len(impacts) * 6
    + case when status = 'deleted' or (removed > 0 and added = 0) then 6 else 0 end
    + case kind when 'backend_service' then 8 when 'ci_pipeline' then 8 when 'app_config' then 10 when 'react_component' then 4 else 0 end as bigint) as risk
  from reviewable join counts using (doc_id) join impacts using (doc_id) join file_kinds using (doc_id))"""

SEGMENTS = """gaps as (
  select doc_id, hunk_ix, start - lag(start + greatest(nl, 1) - 1) over (partition by doc_id order by hunk_ix) as gap from hunks),
numbered as (select doc_id, hunk_ix, sum(case when gap > 24 then 1 else 0 end) over (partition by doc_id order by hunk_ix) as s from gaps),
segments as (select doc_id, hunk_ix, cast(case when max(s) over (partition by doc_id) >= 4 then 0 else s end as bigint) as segment_ix from numbered)"""

COMMENTS = """comments as (
  select user_id as cr_id, 'src/f' || (event_id % 7) || '.ts' as path, event_id % 13 + 1 as line, case when event_id % 3 = 0 then 'LEFT' else 'RIGHT' end as side,
    case when event_id % 4 = 0 then 'Token 消耗: ' || event_id || chr(10) || chr(10) else '' end || 'issue ' || event_type || ' ' || (event_id % 5)
      || case when event_id % 6 = 0 then '  ' else '' end as body,
    (['correctness', 'security', 'regression'])[event_id % 3 + 1] as agent_id, event_id as ord from events)"""

PROGRESS = """progress as (
  select user_id as request_id, event_id as seq, case event_type when 'view' then 'file_review_started' when 'click' then 'agent_review_started'
      when 'purchase' then 'agent_review_completed' when 'error' then 'agent_review_failed' else 'review_started' end as stage,
    (['correctness', 'security', 'regression'])[event_id % 3 + 1] as agent_id, cast(floor(value) as bigint) as tokens,
    case when event_id % 3 = 0 then cast(json_extract_string(props, '$.k') as bigint) end as completed, ts from events)"""

NOTES = """notes as (
  select conv_id as discussion_id, conv_id * 1000 + turn as note_id, role = 'system' as is_system, case when role = 'assistant' then 'review-bot' else 'dev' end as author,
    case when role = 'assistant' then '<!-- ai-review:mr -->' || chr(10) else '' end
      || case when role = 'assistant' and turn % 6 = 1 then '<!-- ai-review-outdated:mr -->' || chr(10) else '' end || coalesce(text, '') as body
  from (select * replace (case when conv_id % 4 = 0 and role = 'user' then 'assistant' when conv_id % 4 <> 0 and conv_id % 5 = 0 and role = 'assistant' then 'user' else role end as role) from conversations))"""

CONTRACTS = """imports as (
  select case when o_custkey % 3 = 0 then 'u' else 'm' end || (o_custkey // 6) as importer, 'm' || (o_orderkey // 60) as module, case when o_orderkey % 9 = 0 then null else 'f' || (o_orderkey % 8) end as symbol,
    o_orderkey % 5 as argc, o_orderpriority = '1-URGENT' as is_new, o_orderkey as line from orders),
base as (
  select 'm' || (p_partkey // 8) as module, 'f' || (p_partkey % 8) as name, case when p_partkey % 11 = 0 then 'value' else 'function' end as kind,
    p_partkey % 3 as required, p_partkey % 3 + 1 as total, p_partkey % 7 = 0 as rest from part),
head as (
  select 'm' || (p_partkey // 8) as module, 'f' || (p_partkey % 8) as name, case when (p_partkey + 1) % 11 = 0 then 'value' else 'function' end as new_kind,
    p_partkey % 3 + case when p_partkey % 5 = 0 then 1 else 0 end as new_required, p_partkey % 3 + 1 + case when p_partkey % 5 = 0 then 1 else 0 end as new_total,
    p_partkey % 7 = 0 as new_rest from part where p_partkey % 17 <> 0),
changes as (
  select * from (select *, case when new_kind is null then 'removed' when kind <> new_kind then 'kind_changed'
      when required is distinct from new_required or total is distinct from new_total or rest is distinct from new_rest then 'signature_changed' end as change_type
    from base left join head using (module, name)) where change_type is not null),
affected as (select i.importer, i.symbol, i.argc, i.is_new, i.line, c.* from imports i join changes c on i.module = c.module and (i.symbol is null or i.symbol = c.name))"""

CLUSTER = """cluster_files as (select cr_id, doc_id, path, regexp_replace(path, '/[^/]*$', '') as dir from files),
tokens as (
  select distinct doc_id, cr_id, lower(w) as token from (
    select doc_id, cr_id, unnest(string_split_regex(regexp_replace(seg, '[.][^.]+$', ''), '[-_.]')) as w
    from (select doc_id, cr_id, unnest(string_split(path, '/')) as seg from files)) where length(w) >= 3),
symbols as (select distinct cr_id, doc_id, 'S' || ((doc_id * 7 + i * doc_id) % 23) as token from files, range(3) as r(i)),
shared as (
  select cr_id, a, b, count(*) filter (where f = 'p') as shared_paths, count(*) filter (where f = 's') as shared_symbols from (
    select x.cr_id, x.doc_id as a, y.doc_id as b, 'p' as f from tokens x join tokens y on x.cr_id = y.cr_id and x.token = y.token and x.doc_id < y.doc_id
    union all select x.cr_id, x.doc_id, y.doc_id, 's' from symbols x join symbols y on x.cr_id = y.cr_id and x.token = y.token and x.doc_id < y.doc_id)
  group by cr_id, a, b),
pairs as (
  select s.* from shared s join cluster_files l on l.doc_id = a join cluster_files r on r.doc_id = b
  where shared_symbols >= 2 or shared_paths >= 2 or (shared_symbols >= 1 and (l.dir = r.dir
    or l.dir = case when contains(r.dir, '/') then regexp_replace(r.dir, '/[^/]*$', '') else '.' end
    or r.dir = case when contains(l.dir, '/') then regexp_replace(l.dir, '/[^/]*$', '') else '.' end)))"""

_NAME_SOURCES = " union all ".join(
    f"select doc_id, unnest(regexp_extract_all(t, {_q(p)}, 1)) as name, {n} as score from signal" for p, n in values.NAME_SOURCES
)
NAMES = f"""added_text as (select doc_id, string_agg(substr(l, 2), chr(10) order by hunk_ix, line_ix) as t from (
    select k.doc_id, u.hunk_ix, k.line_ix, k.l from kinds k join hunks u on u.doc_id = k.doc_id and u.h = k.h where k.kind = '+') group by doc_id),
signal as (select p.doc_id, coalesce(t, whole) as t from (select doc_id, 'diff --git a b' || chr(10) || string_agg(content, '' order by hunk_ix) as whole from hunks group by doc_id) p
    left join added_text using (doc_id)),
names as ({_NAME_SOURCES}),
scored as (select doc_id, name, sum(score) as score from names
  where length(name) >= 2 and regexp_matches(name, '^[A-Za-z_$][A-Za-z0-9_$]*$') and name not in ({", ".join(_q(x) for x in values.STOP_NAMES)}) group by doc_id, name),
ranked as (select doc_id, name, cast(score as bigint) as score, row_number() over (partition by doc_id order by score desc, name) as rank from scored)"""


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {select}"


def oracle_sql() -> dict[str, str]:
    reviewing = (LINES, FILES, PREDICATES, BLANK_ONLY, REVIEWABLE)
    risky = (*reviewing, KINDS, IMPACTS, COUNTS, RISKS)
    reason = "case " + " ".join(f"when regexp_matches(lower(text), {_q(p)}) then '{n}'" for n, p in values.REMOVED_BEHAVIOUR) + " else 'default' end"
    strategy = ", ".join(f"('{r[0]}', {r[6]}, {r[8]}, {r[12]}, {r[13]}, {r[14]}, {r[15]})" for r in values.STRATEGIES)
    bare = "regexp_replace(regexp_replace(body, '^Token 消耗:[^\\n]*\\n\\n', ''), '^\\s+|\\s+$', '', 'g')"
    return {
        "cr_scale_risk": _with(
            *risky,
            select="""select cr_id, files, changed_lines, risk_score, case when risk_score > 90 then 'LARGE' when risk_score > 50 and size = 'SMALL' then 'MEDIUM' else size end as scale
            from (select *, case when changed_lines <= 100 and files <= 5 then 'SMALL' when changed_lines <= 500 and files <= 20 then 'MEDIUM' else 'LARGE' end as size
              from (select cr_id, count(*) as files, cast(sum(changed) as bigint) as changed_lines, cast(sum(risk) as bigint) as risk_score from risks group by cr_id))""",
        ),
        "patch_hunks": _with(LINES, select="select doc_id, cast(hunk_ix as int) as hunk_ix, cast(start as int) as old_start, cast(ol as int) as old_lines, cast(start as int) as new_start, cast(nl as int) as new_lines, cast(length(content) as int) as content_length from hunks"),
        "touched_lines": _with(LINES, select="select doc_id, new_line as line, md5(text) as text_md5 from lines where kind = '+'"),
        "removed_lines": _with(LINES, select="select doc_id, old_line as line, md5(text) as text_md5 from lines where kind = '-'"),
        "changed_counts": _with(LINES, COUNTS, select="select * from counts"),
        "changed_anchors": _with(
            LINES,
            select="""select distinct doc_id, new_line as anchor from lines where kind = '+' union
            select doc_id, unnest([greatest(1, f - 1), f, e, e + 1]) from (select doc_id, greatest(1, start) as f, case when nl > 0 then greatest(1, start) + nl - 1 else greatest(1, start) end as e
              from hunks where doc_id not in (select doc_id from lines where kind = '+'))""",
        ),
        "whitespace_only": _with(LINES, BLANK_ONLY, select="select * from blank_only"),
        "file_status": _with(FILES, select="select doc_id, status, case when doc_id % 5 = 0 then 'added' when doc_id % 3 = 0 then 'deleted' when doc_id % 2 = 0 then 'renamed' else 'modified' end as flag_status from files"),
        "path_predicates": _with(FILES, PREDICATES, select=f"select doc_id, ignored, documentation, deployment, high_risk, {_SCRIPT} as script, ext as extension from predicates"),
        "reviewable_files": _with(*reviewing, select="select doc_id, path, status from reviewable"),
        "file_kinds": _with(LINES, FILES, PREDICATES, KINDS, select="select * from file_kinds"),
        "impact_signals": _with(LINES, IMPACTS, select="select doc_id, array_to_string(impacts, ',') as impacts from impacts"),
        "removed_reasons": _with(LINES, select=f"select doc_id, cast(hunk_ix as int) as hunk_ix, line_ix, {reason} as reason from lines where kind = '-'"),
        "file_risks": _with(*risky, select="select doc_id, kind, changed, risk from risks"),
        "retrieval_profiles": _with(
            LINES, FILES, PREDICATES, KINDS, f"strategy(kind, code, lookups, f, t, s, d) as (values {strategy})",
            select="""select doc_id, kind, case when code then f else 0 end as functions, case when code then t else 0 end as types, case when code then s else 0 end as slices,
            case when not code then 0 when status = 'deleted' then greatest(2, d) else d end as deleted_scopes, case when doc_id % 2 > 0 then greatest(1, lookups - 1) else lookups end as remote_lookups
            from file_kinds join files using (doc_id) join strategy using (kind)""",
        ),
        "review_segments": _with(LINES, SEGMENTS, select="select doc_id, cast(hunk_ix as int) as hunk_ix, segment_ix from segments"),
        "segment_signals": _with(
            LINES, SEGMENTS,
            "signals as (select doc_id, case when doc_id % 3 > 0 then new_line end as line, 's' || line_ix as summary from lines where kind = '+' and line_ix % 2 = 1)",
            "anchors as (select distinct doc_id, segment_ix, new_line as line from lines join segments using (doc_id, hunk_ix) where kind = '+')",
            select="select doc_id, 0 as segment_ix, line, summary from signals where line is null or line = 0 union all select s.doc_id, a.segment_ix, s.line, s.summary from signals s join anchors a using (doc_id, line) where s.line <> 0",
        ),
        "comment_dedup": _with(COMMENTS, select=f"select cr_id, path, line, side, agent_id, ord from comments qualify row_number() over (partition by cr_id, path, line, side, {bare} order by ord) = 1"),
        "payload_dedup": _with(COMMENTS, select="select cr_id * 10 + ord % 3 as payload_id, line, ord from comments qualify row_number() over (partition by cr_id * 10 + ord % 3, line, body order by ord) = 1"),
        "static_merge": _with(
            COMMENTS,
            select="""select cr_id, path, line, side, ord from comments c where ord % 2 = 1 or not exists (select 1 from comments o where o.ord % 2 = 1
            and o.cr_id = c.cr_id and o.path = c.path and o.line = c.line and o.side = c.side)""",
        ),
        "review_outcomes": """with r as (select doc_id, toxic * (doc_id % 3) as errors, doc_id % 4 as comments, doc_id % 6 as files, quality = 0 as strict from labels),
            c as (select *, case when errors > 0 then 'failure' when strict and comments > 0 then 'failure' when files = 0 then 'neutral' else 'success' end as conclusion from r)
            select doc_id, conclusion, case when errors > 0 then 500 when conclusion = 'failure' then 409 else 200 end as http,
            case when errors > 0 then 'AI Review completed with errors' when conclusion = 'failure' and comments > 0 then 'AI Review found blocking issues'
              when conclusion = 'neutral' then 'AI Review skipped' else 'AI Review completed' end as title,
            case when doc_id % 3 = 0 then 'pending' when doc_id % 3 = 1 then 'running' when conclusion in ('success', 'neutral') then 'success' when conclusion = 'cancelled' then 'canceled' else 'failed' end as state,
            case when comments > 0 then 'comments' when files % 2 > 0 then 'findings' when errors > 0 then 'error' else 'clean' end as outcome from c""",
        "findings_preview": _with(COMMENTS, select="select cr_id, n, path || ':' || line || ' ' || split_part(body, chr(10), 1) as preview from (select *, row_number() over (partition by cr_id order by ord) as n from comments) where n <= 8"),
        "token_rollup": "select l_orderkey as run_id, cast(sum(cast(floor(l_quantity) as bigint)) as bigint) as prompt_tokens, cast(sum(l_linenumber) as bigint) as completion_tokens, cast(sum(cast(floor(l_quantity) as bigint) + l_linenumber) as bigint) as total_tokens from lineitem group by l_orderkey",
        "status_texts": """select doc_id, md5(case when length(t) > 140 then substr(t, 1, 137) || '...' else t end) as short_md5, cast(least(length(t), 255) as int) as short_length,
            cast(case when length(t) > 2000 then length(rtrim(substr(t, 1, 1984))) + 14 else length(t) end as int) as cut_length from (select doc_id, coalesce(text, '') as t from documents)""",
        "comment_bodies": _with(
            NOTES, "bare as (select note_id, body, regexp_replace(body, '^\\s+|\\s+$', '', 'g') as b, '<!-- ai-review:mr -->' as m from notes)",
            select="""select note_id, md5(case when contains(body, m) then body else m || chr(10) || body end) as decorated_md5,
            md5(case when contains(body, '<!-- ai-review-outdated:mr -->') then body else m || chr(10) || '<!-- ai-review-outdated:mr -->' || chr(10) || '> outdated by a newer review' || chr(10) || chr(10)
              || regexp_replace(case when contains(b, m) then substr(b, 1, instr(b, m) - 1) || substr(b, instr(b, m) + length(m)) else b end, '^\\s+|\\s+$', '', 'g') end) as outdated_md5 from bare""",
        ),
        "discussion_cleanup": _with(
            NOTES,
            "shown as (select *, (contains(body, '<!-- ai-review:mr -->') or starts_with(trim(body), 'Token 消耗:') or starts_with(trim(body), '💡 **[')) and author = 'review-bot' as ours from notes where not is_system)",
            "totals as (select discussion_id, count(*) as n, count(*) filter (where ours) as o from shown group by discussion_id having count(*) filter (where ours) > 0)",
            select="select discussion_id, note_id, action from (select discussion_id, note_id, case when n = o then 'delete' when not contains(body, '<!-- ai-review-outdated:mr -->') then 'outdate' end as action from shown join totals using (discussion_id) where ours) where action is not null",
        ),
        "path_tokens": _with(FILES, CLUSTER, select="select doc_id, token from tokens"),
        "related_pairs": _with(FILES, CLUSTER, select="select cr_id, a, b, shared_paths, shared_symbols from pairs"),
        "change_clusters": _with(
            FILES, CLUSTER, "both_ways as (select a, b from pairs union select b, a from pairs)",
            "reach(node, seen) as (select a, a from both_ways union select e.b, r.seen from reach r join both_ways e on e.a = r.node)",
            select="select node, min(seen) as label from reach group by node", recursive=True,
        ),
        "shared_symbols": _with(FILES, CLUSTER, select="select cr_id, token as item, n, rank from (select *, row_number() over (partition by cr_id order by n desc, token) as rank from (select cr_id, token, count(*) as n from symbols group by cr_id, token having count(*) >= 2)) where rank <= 6"),
        "identifier_candidates": _with(LINES, NAMES, select="select * from ranked"),
        "missing_candidates": _with(LINES, NAMES, select="select doc_id, name, score from (select *, row_number() over (partition by doc_id order by rank) as n from ranked where rank % 2 = 1) where n <= 4"),
        "agent_profiles": """with raw as (select o_orderkey, o_orderkey % 5 as v from orders)
            select o_orderkey, a as agent_id, cast(p as bigint) as place from raw join (values (0, 'correctness', 1), (0, 'security', 2), (0, 'regression', 3), (1, 'security', 1), (1, 'correctness', 2), (2, 'security', 1),
            (3, 'correctness', 1), (4, 'regression', 1), (4, 'security', 2)) as t(v, a, p) using (v)""",
        "contract_changes": _with(CONTRACTS, select="select module, name, change_type from changes"),
        "contract_consumers": _with(CONTRACTS, select="select importer, module, name, line, change_type from affected"),
        "arity_mismatches": _with(CONTRACTS, select="select importer, module, name, line, cast(argc as int) as argc from affected where change_type = 'signature_changed' and (argc < new_required or (not new_rest and argc > new_total))"),
        "kind_mismatches": _with(
            CONTRACTS,
            select="""select importer, module, name, line, 'call' as usage from affected where change_type = 'kind_changed' and not is_new and new_kind <> 'function'
            union all select importer, module, name, line, 'construct' from affected where change_type = 'kind_changed' and is_new and new_kind <> 'class'""",
        ),
        "external_consumers": _with(
            CONTRACTS,
            select="""select symbol, path, n from (select *, row_number() over (partition by symbol order by ord, path) as n from (select symbol, importer as path, min(line) as ord from imports
            where symbol is not null and importer not in (select module from changes) group by symbol, importer)) where n <= 10""",
        ),
        "reexport_closure": _with(
            "edges as (select distinct 'm' || p as source, 'm' || t as target from (select p_partkey as p, unnest([p_partkey // 2, p_partkey // 3 + 7]) as t from part) where p <> t)",
            "walk(source, target, depth) as (select source, target, 1 from edges union select w.source, e.target, w.depth + 1 from walk w join edges e on e.source = w.target where w.depth < 4)",
            select="select source, target, cast(min(depth) as bigint) as depth from walk where source <> target group by source, target", recursive=True,
        ),
        "import_resolution": _with(
            CONTRACTS, "paths as (select distinct 'm' || p_partkey || (['.ts', '.js', '/index.ts', '.tsx'])[p_partkey % 4 + 1] as path from part)",
            f"options as (select distinct importer, module, r as rank, module || ({_list(values.ENDINGS)})[r + 1] as path from imports, range({len(values.ENDINGS)}) as t(r))",
            select="select importer, module, arg_min(path, rank) as path, cast(min(rank) as int) as rank from options where path in (select path from paths) group by importer, module",
        ),
        "json_recovery": "select doc_id as payload_id, doc_id % 7 <> 4 as recovered from documents",
        "payload_comments": """with c as (select doc_id, doc_id % 7 as v, doc_id % 9 + case when doc_id % 14 = 0 then -20 else 0 end as line from documents)
            select doc_id as payload_id, cast(n as bigint) as ord, cast(line as int) as line, 'use {braces} ' || doc_id as body, case when doc_id % 3 = 0 then 'LEFT' else 'RIGHT' end as side
            from c, range(2) as r(n) where line > 0 and (v in (0, 1) and n = 0 or v in (2, 3))""",
        "progress_carried": _with(
            PROGRESS, "runs as (select *, count(*) filter (where stage = 'review_started') over (partition by request_id order by seq) as run from progress)",
            "said as (select *, coalesce(last_value(case when stage = 'review_started' then 0 else completed end ignore nulls) over (partition by request_id, run order by seq rows between unbounded preceding and current row), 0) as c from runs)",
            select="select request_id, seq, stage, c as completed_so_far, cast(least(100, greatest(0, floor(c * 100 / 40.0 + 0.5))) as int) as percent from said",
        ),
        "agent_summary": _with(
            PROGRESS,
            select="""select request_id, agent_id, count(*) filter (where stage = 'agent_review_completed') as completed_segments, count(*) filter (where stage = 'agent_review_failed') as failures,
            cast(coalesce(sum(tokens) filter (where stage = 'agent_review_completed'), 0) as bigint) as tokens,
            coalesce(arg_max(case stage when 'agent_review_started' then 'running' when 'agent_review_completed' then 'done' else 'failed' end, seq) filter (where starts_with(stage, 'agent_')), 'waiting') as status
            from progress group by request_id, agent_id""",
        ),
        "last_events": _with(PROGRESS, select="select request_id, seq, n from (select *, row_number() over (partition by request_id order by seq desc) as n from progress) where n <= 60"),
        "heartbeats": _with(
            PROGRESS, "ticks as (select request_id, unnest(generate_series(date_trunc('day', min(ts)), max(ts), interval 1 day)) as ts from progress group by request_id)",
            select="select t.request_id, cast(t.ts as timestamp) as ts, arg_max(p.stage, (p.ts, p.seq)) as last_stage from ticks t left join progress p on p.request_id = t.request_id and p.ts <= t.ts group by t.request_id, t.ts",
        ),
        "latest_heads": "select o_custkey as change_key, cast(date_trunc('month', o_orderdate) as timestamp) as busy, 'sha' || max(o_orderkey) as head, count(*) as merged from orders group by all",
    }
