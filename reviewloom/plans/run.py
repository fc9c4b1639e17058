"""A review from changed files to its result, composed of the operators; the model is a function that the caller gives."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.lineage import cut
from reviewloom.operators import agents, comments, diff, filters, payloads, prompts, segments
from reviewloom.plans.oracles import BLANK_ONLY, FILES, LINES, PREDICATES, REVIEWABLE, SEGMENTS, _with
from reviewloom.plans.review import AGENTS, _files
from reviewloom.sources import hosting


def segment_prompts(files: DataFrame, panel: DataFrame) -> DataFrame:
    """key, cr_id, doc_id, path, segment_ix, agent_id, place, prompt: one for each segment of a reviewable file and each agent.

    files: cr_id, doc_id, path, status, patch; panel: agent_id, label, place, a few rows."""
    kept = filters.reviewable_changes(diff.with_changes(files)).select("cr_id", "doc_id", "path", "patch")
    parts = segments.review_segments(diff.hunks(kept))
    shown = F.struct("hunk_ix", "old_start", "old_lines", "new_start", "new_lines", "content")
    listed = parts.groupBy("cr_id", "doc_id", "path", "segment_ix").agg(F.array_sort(F.collect_list(shown)).alias("hunks"))
    last = parts.groupBy("doc_id").agg((F.max("segment_ix") + 1).alias("segments"))
    asked = agents.assignments(listed.join(last, "doc_id"), panel)
    scope = prompts.review_scope(F.col("path"), F.lit("file"), F.col("segment_ix") + 1, F.col("segments"), F.col("hunks"))
    text = F.concat(F.lit("Agent: "), "agent_id", F.lit("\n\n"), scope, F.lit("\n\n"), prompts.diff_section(F.col("path"), F.col("hunks")))
    key = F.concat_ws(":", "doc_id", "segment_ix", "agent_id")
    return asked.select(key.alias("key"), "cr_id", "doc_id", "path", "segment_ix", "agent_id", "place", text.alias("prompt"))


def reviewed(files: DataFrame, panel: DataFrame, generate: Callable[[str], dict], findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Comments (cr_id, path, line, side, body, agent_id) and runs (key, doc_id, ..., comments, tokens, error) of a review.

    A run's answer may hold its JSON anywhere; one that holds none, or comments that don't fit, gives none. Comments count
    once a place and body in a request, the first agent's stays; findings (cr_id, path, line, side, body) stand where no
    comment does. Answers, and the comments found in them, are written once, so a plan that reads them twice asks the model and looks for JSON once."""
    asked = cut(segment_prompts(files, panel))
    answers = cut(hosting.generated(asked, generate, retryable=lambda error: False))
    told = answers.select(F.col("key").alias("payload_id"), payloads.recovered_json(F.coalesce("content", F.lit(""))).alias("json"))
    given = cut(comments.deduplicate_payload(payloads.payload_comments(told)))
    placed = given.join(asked.select(F.col("key").alias("payload_id"), "cr_id", "path", "agent_id", "segment_ix", "place"), "payload_id")
    ordered = placed.withColumnRenamed("ord", "n_in_answer").withColumn("ord", F.struct("segment_ix", "place", "n_in_answer"))
    once = comments.deduplicate(ordered).select("cr_id", "path", "line", "side", "body", "agent_id")
    if findings is not None:
        once = comments.merge_findings(findings.withColumn("agent_id", F.lit(None).cast("string")), once)
    counted = given.groupBy("payload_id").agg(F.count("*").alias("comments"))
    runs = asked.drop("prompt").join(answers.drop("content"), "key").join(counted.withColumnRenamed("payload_id", "key"), "key", "left")
    return once, runs.withColumn("comments", F.coalesce("comments", F.lit(0)))


def request_results(files: DataFrame, found: DataFrame, runs: DataFrame) -> DataFrame:
    """cr_id, files, runs, comments, errors, tokens, conclusion, status, title of each request, those without
    reviewable files too."""
    per_run = runs.groupBy("cr_id").agg(
        F.count_distinct("doc_id").alias("files"), F.count("*").alias("runs"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens")
    )
    posted = found.groupBy("cr_id").agg(F.count("*").alias("comments"))
    joined = files.select("cr_id").distinct().join(per_run, "cr_id", "left").join(posted, "cr_id", "left").fillna(0, ["files", "runs", "errors", "tokens", "comments"])
    result = comments.conclusion(F.col("errors"), F.lit(True), F.col("comments"), F.col("files"))
    made = joined.withColumn("conclusion", result)
    return made.withColumns({"status": comments.http_status(F.col("errors"), F.col("conclusion")), "title": comments.completion_title(F.col("conclusion"), F.col("comments"), F.col("errors"))})


def plain_model(prompt: str) -> dict:
    """A model for tests: a comment of the agent's own and one that all give, at the segment's first line; some agents are
    silent, and some calls fail, by the path's length."""
    agent, path = (re.search(p, prompt)[1] for p in (r"^Agent: (\w+)", r"(?m)^文件路径: (.+)$"))
    line = int(re.search(r"### Hunk 1 \(-\d+,\d+ / \+(\d+)", prompt)[1])
    if agent == "security" and len(path) % 5 == 0:
        raise TimeoutError("no answer")
    if agent == "regression" and len(path) % 3 == 0:
        return {"content": "nothing to say", "prompt_tokens": 10, "completion_tokens": 1}
    said = [{"line": line, "body": f"{agent} of {path}"}, {"line": line, "body": "shared"}, {"line": line, "body": "shared", "side": "RIGHT"}]
    return {"content": f"Here it is:\n```json\n{json.dumps({'comments': said})}\n```", "prompt_tokens": 10, "completion_tokens": 5}


def _reviewed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = _files(spark, sf)
    panel = spark.createDataFrame([(a, a.capitalize(), p) for a, p in AGENTS], "agent_id string, label string, place int")
    return files, *reviewed(files, panel, plain_model)


def review_comments(spark, sf):
    return _reviewed(spark, sf)[1]


def review_results(spark, sf):
    results = request_results(*_reviewed(spark, sf))
    return results.withColumns({c: F.col(c).cast("long") for c in ("cr_id", "files", "runs", "errors", "tokens", "comments", "status")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (review_comments, review_results)}


def oracle_sql() -> dict[str, str]:
    base = (
        LINES, FILES, PREDICATES, BLANK_ONLY, REVIEWABLE, SEGMENTS,
        "s as (select cr_id, doc_id, path, segment_ix, min(h.start) as line from reviewable join segments using (doc_id) join hunks h using (doc_id, hunk_ix) group by all)",
        "r as (select *, case when agent = 'security' and length(path) % 5 = 0 then 'error' when agent = 'regression' and length(path) % 3 = 0 then 'silent' else 'said' end as how from s, (values ('correctness', 1), ('security', 2), ('regression', 3)) as t(agent, place))",
        "c as (select cr_id, path, line, agent, segment_ix, place, unnest([agent || ' of ' || path, 'shared']) as body from r where how = 'said')",
        "once as (select * from c qualify row_number() over (partition by cr_id, path, line, body order by segment_ix, place) = 1)",
    )
    return {
        "review_comments": _with(*base, select="select cr_id, path, cast(line as int) as line, 'RIGHT' as side, body, agent as agent_id from once"),
        "review_results": _with(
            *base,
            "p as (select cr_id, count(distinct doc_id) as files, count(*) as runs, count(*) filter (how = 'error') as errors, cast(sum(case how when 'said' then 15 when 'silent' then 11 else 0 end) as bigint) as tokens from r group by cr_id)",
            "n as (select cr_id, count(*) as comments from once group by cr_id)",
            "a as (select cr_id, coalesce(files, 0) as files, coalesce(runs, 0) as runs, coalesce(errors, 0) as errors, coalesce(tokens, 0) as tokens, coalesce(comments, 0) as comments from (select distinct cr_id from files) left join p using (cr_id) left join n using (cr_id))",
            select="""select *, case when errors > 0 or comments > 0 then 'failure' when files = 0 then 'neutral' else 'success' end as conclusion, cast(case when errors > 0 then 500 when comments > 0 then 409 else 200 end as bigint) as status,
              case when errors > 0 then 'AI Review completed with errors' when comments > 0 then 'AI Review found blocking issues' when files = 0 then 'AI Review skipped' else 'AI Review completed' end as title from a""",
        ),
    }
