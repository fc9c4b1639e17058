"""Plans of a review's progress, with their SQL beside them; tests hold the streams against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.lineage import cut
from reviewloom.plans.oracles import _list, _with
from reviewloom.sources import bridge
from reviewloom.streaming import decorated
from reviewloom.streaming.progress import STAGES


def progress_decorated(spark, sf):
    found = decorated.decorated(bridge.stage_events(spark, sf))
    return found.select("request_id", "seq", "stage", "total_files", "completed_files", "current_path", F.col("percent").cast("long").alias("percent"))


def progress_beats(spark, sf):
    """A beat a minute after each event of a request."""
    told = cut(decorated.decorated(bridge.stage_events(spark, sf)))
    ticks = told.select("request_id", F.expr("ts + interval 1 minute").alias("ts")).distinct()
    return decorated.beats(told, ticks).select("request_id", F.col("ts").cast("timestamp").alias("ts"), "message", F.col("percent").cast("long").alias("percent"))


def coalesced_heads(spark, sf):
    return decorated.coalesced_heads(bridge.head_events(spark, sf))


def agent_cards(spark, sf):
    cards = decorated.agent_cards(bridge.stage_events(spark, sf))
    return cards.withColumns({c: F.array_join(c, "|") for c in ("logs", "comments")})


def run_cards(spark, sf):
    cards = decorated.run_cards(bridge.stage_events(spark, sf))
    return cards.withColumns({"progress": F.col("progress").cast("long"), "n_events": F.col("n_events").cast("long")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (progress_decorated, progress_beats, coalesced_heads, agent_cards, run_cards)}


_EVENTS = f"""e as (
  select user_id as request_id, event_id as seq, ts, ({_list(STAGES)})[event_id * 7 % 18 + 1] as stage, case when event_id % 7 = 0 then event_id % 40 when event_id % 13 = 0 then -1 end as total,
    case when event_id % 3 = 0 then event_id % 23 when event_id % 17 = 0 then -2 end as completed, case when event_id % 5 < 2 then 'src/lib/f' || (event_id % 11) || '.ts' end as path,
    case when event_id % 4 > 0 then (['correctness', 'Security', 'other'])[event_id % 3 + 1] end as agent_id, case when event_id % 9 = 0 then 'label ' || event_id % 6 end as agent_label,
    case when event_id % 6 > 0 then 'm' || event_id end as message, event_id % 4 as comment_count, event_id % 5 as prompt_tokens, event_id % 8 as completion_tokens, event_id % 3 as reviewed_files, event_id % 13 as total_tokens,
    case when event_id % 2 = 0 then 'ok' else 'bad' end as conclusion, case when event_id % 3 > 0 then cast(event_id % 101 as int) end as percent
  from events)"""
_KNOWN = """k as (
  select *, coalesce(total, last_value(case when total >= 0 then total end ignore nulls) over b, 0) as total_files, coalesce(last_value(case when total >= 0 then total end ignore nulls) over u, 0) as known_total,
    last_value(path ignore nulls) over u as current_path, coalesce(sum(case when stage = 'review_started' then 1 else 0 end) over b, 0) as run
  from e window b as (partition by request_id order by seq rows between unbounded preceding and 1 preceding), u as (partition by request_id order by seq rows between unbounded preceding and current row)),
d as (
  select *, coalesce(completed, last_value(case when completed >= 0 then completed end ignore nulls) over r, 0) as completed_files,
    case when stage = 'review_started' then 0 when completed >= 0 then completed else coalesce(last_value(case when completed >= 0 then completed end ignore nulls) over r, 0) end as known_completed
  from k window r as (partition by request_id, run order by seq rows between unbounded preceding and 1 preceding))"""


def oracle_sql() -> dict[str, str]:
    share = lambda a, b: f"case when {b} > 0 then cast(least(100, greatest(0, floor({a} * 100.0 / {b} + 0.5))) as bigint) end"
    first_of = "coalesce(nullif(known_total, 0), nullif(total_files, 0), 0)"
    return {
        "progress_decorated": _with(
            _EVENTS, _KNOWN,
            select=f"""select request_id, seq, stage, total_files, completed_files, current_path, case
              when stage in ('diff_filtered', 'review_started') then {share('0', 'total_files')}
              when stage in ('file_review_started', 'agent_review_started', 'agent_review_completed', 'agent_review_failed', 'file_review_completed', 'file_review_failed') then {share('completed_files', 'total_files')}
              when stage = 'posting_comments' then {share("coalesce(nullif(known_completed, 0), nullif(total_files, 0), 0)", 'total_files')}
              when stage = 'comments_posted' then {share(first_of, first_of)} when stage = 'completed' then {share('total_files', 'total_files')} end as percent from d""",
        ),
        "progress_beats": _with(
            _EVENTS, _KNOWN,
            "t as (select distinct request_id, ts + interval 1 minute as ts from e)",
            "s as (select t.request_id, t.ts, (select arg_max((known_total, known_completed, current_path), (d.ts, seq)) from d where d.request_id = t.request_id and d.ts <= t.ts) as s from t)",
            "n as (select request_id, ts, s[1] as total, s[2] as done, s[3] as path from s)",
            select=f"""select request_id, ts, '⏳ AI Review 进行中' || case when total > 0 then '，已完成 ' || done || '/' || total || ' 个文件' else '' end
              || case when path is not null and (total <= 0 or done < total) then '，当前 lib/' || split_part(path, '/', -1) else '' end as message, {share('done', 'total')} as percent from n""",
        ),
        "coalesced_heads": """with recursive e as (
              select 'k' || user_id as key, event_id as seq, case when event_id % 5 < 3 then 'arrival' else 'end' end as kind, case when event_id % 5 < 3 then 'sha' || event_id % 4 end as head, event_id % 7 > 0 as ok,
                row_number() over (partition by user_id order by event_id) as n from events),
            w(key, n, seq, active, pending, why) as (
              select distinct key, cast(0 as bigint), cast(null as bigint), cast(null as varchar), cast(null as varchar), cast(null as varchar) from e
              union all
              select w.key, e.n, e.seq,
                case when kind = 'arrival' then coalesce(w.active, e.head) when w.active is null or (ok and w.pending = w.active) then null else w.pending end,
                case when kind = 'arrival' then e.head when w.active is null then w.pending when ok and w.pending = w.active then null else w.pending end,
                case when kind = 'arrival' then case when w.active is null then 'arrival' end when w.active is null or (ok and w.pending = w.active) then null when w.pending = w.active then 'retry' else 'follow_up' end
              from w join e on e.key = w.key and e.n = w.n + 1)
            select key, seq, active as head, why from w where why is not null""",
        "agent_cards": _with(
            _EVENTS,
            "named as (select distinct request_id, unnest(['correctness', 'security', 'late']) as agent_id from e where stage = 'review_started' and seq % 2 = 0)",
            "a as (select * from e where agent_id is not null)",
            """c as (select request_id, agent_id, arg_max(agent_label, seq) filter (agent_label is not null) as label,
              arg_max(case stage when 'agent_review_started' then '运行中' when 'agent_review_completed' then '已完成' else '失败' end, seq) filter (stage in ('agent_review_started', 'agent_review_completed', 'agent_review_failed')) as status,
              arg_max(path, seq) filter (path is not null) as current_path, count(*) filter (stage = 'agent_review_completed') as done, sum(comment_count) filter (stage = 'agent_review_completed') as comments,
              count(*) filter (stage = 'agent_review_failed') as failures, sum(prompt_tokens) filter (stage = 'agent_review_completed') as p, sum(completion_tokens) filter (stage = 'agent_review_completed') as q from a group by all)""",
            "l as (select request_id, agent_id, string_agg(message, '|' order by seq desc) as logs from (select * from a where message is not null qualify row_number() over (partition by request_id, agent_id order by seq desc) <= 4) group by all)",
            """m as (select request_id, agent_id, string_agg(x, '|' order by seq desc, i) as comments from (
              select request_id, agent_id, seq, i, 'c' || seq || '.' || i as x from a, range(0, 12) as r(i) where stage = 'agent_review_completed' and i < seq % 12
              qualify row_number() over (partition by request_id, agent_id order by seq desc, i) <= 30) group by all)""",
            select="""select request_id, agent_id, coalesce(label, case lower(agent_id) when 'correctness' then 'Correctness Agent' when 'security' then 'Security Agent' else agent_id end) as label, coalesce(status, '等待执行') as status,
              coalesce(current_path, '-') as current_path, coalesce(done, 0) as completed_segments, cast(coalesce(c.comments, 0) as bigint) as comment_count, coalesce(failures, 0) as failures, cast(coalesce(p, 0) as bigint) as prompt_tokens,
              cast(coalesce(q, 0) as bigint) as completion_tokens, cast(coalesce(p, 0) + coalesce(q, 0) as bigint) as total_tokens, coalesce(logs, '') as logs, coalesce(m.comments, '') as comments
            from c full join named using (request_id, agent_id) left join l using (request_id, agent_id) left join m using (request_id, agent_id)""",
        ),
        "run_cards": _with(
            _EVENTS,
            select="""select request_id, arg_max(case when stage = 'completed' then conclusion when stage = 'failed' then '执行失败' else '运行中' end, seq) as status, arg_max(message, seq) filter (message is not null) as note,
              cast(arg_max(percent, seq) filter (percent is not null) as bigint) as progress, arg_max(stage, seq) as latest_stage, arg_max(case when stage = 'completed' then conclusion else '执行失败' end, seq) filter (stage in ('completed', 'failed')) as conclusion,
              """ + ", ".join(f"coalesce(arg_max({c}, seq) filter ({c} <> 0), 0) as {c}" for c in ("reviewed_files", "comment_count", "prompt_tokens", "completion_tokens", "total_tokens")) + ", least(60, count(*)) as n_events from e group by request_id",
        ),
    }
