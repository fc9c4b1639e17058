"""Whole plans: from the driver's tables over the bridge to results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.lineage import cut
from reviewloom.operators import classify, clusters, comments, contracts, diff, filters, modules, payloads, segments, symbols
from reviewloom.sources import bridge
from reviewloom.streaming import progress

AGENTS = (("correctness", 1), ("security", 2), ("regression", 3))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    rows = bridge.file_diffs(spark, sf)
    return rows.withColumn("status", diff.normalized_status(diff.removed_is_deleted(F.col("raw_status"))))


def _hunks(spark: SparkSession, sf: str) -> DataFrame:
    return diff.hunks(_files(spark, sf).select("doc_id", "patch"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return diff.lines(_hunks(spark, sf))


def _reviewable(spark: SparkSession, sf: str) -> DataFrame:
    hunks = _hunks(spark, sf)
    rows = diff.lines(hunks)
    return filters.reviewable(_files(spark, sf), rows, hunks, diff.whitespace_only(rows))


def _risk(spark: SparkSession, sf: str) -> DataFrame:
    """One scan of the files, and all of a file from its own row."""
    return classify.file_risk(filters.reviewable_changes(diff.with_changes(_files(spark, sf))))


def cr_scale_risk(spark, sf):
    """Scale and risk of each change request over its reviewable files."""
    return classify.change_scale(_risk(spark, sf)).select(F.col("cr_id").cast("long").alias("cr_id"), "files", "changed_lines", "risk_score", "scale")


def patch_hunks(spark, sf):
    return _hunks(spark, sf).select("doc_id", "hunk_ix", "old_start", "old_lines", "new_start", "new_lines", F.length("content").alias("content_length"))


def touched_lines(spark, sf):
    return diff.touched_lines(_lines(spark, sf)).select("doc_id", F.col("new_line").cast("long").alias("line"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def removed_lines(spark, sf):
    return diff.removed_lines(_lines(spark, sf)).select("doc_id", F.col("old_line").cast("long").alias("line"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def changed_counts(spark, sf):
    return diff.changed_counts(_lines(spark, sf))


def changed_anchors(spark, sf):
    hunks = _hunks(spark, sf)
    return diff.anchors(hunks, diff.lines(hunks)).select("doc_id", F.col("anchor").cast("long").alias("anchor"))


def whitespace_only(spark, sf):
    return diff.whitespace_only(_lines(spark, sf))


def file_status(spark, sf):
    rows = _files(spark, sf)
    flags = diff.flag_status(F.col("doc_id") % 5 == 0, F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0)
    return rows.select("doc_id", "status", flags.alias("flag_status"))


def path_predicates(spark, sf):
    p = F.col("path")
    return _files(spark, sf).select(
        "doc_id",
        filters.is_ignored(p).alias("ignored"),
        filters.is_documentation(p).alias("documentation"),
        filters.is_deployment(p).alias("deployment"),
        filters.is_high_risk(p).alias("high_risk"),
        filters.is_script(p).alias("script"),
        filters.extension(p).alias("extension"),
    )


def reviewable_files(spark, sf):
    return _reviewable(spark, sf).select("doc_id", "path", "status")


def file_kinds(spark, sf):
    rows = _files(spark, sf).join(classify.diff_text(_hunks(spark, sf)), "doc_id", "left")
    return rows.select("doc_id", classify.file_kind(F.col("path"), F.coalesce("diff_text", F.lit(""))).alias("kind"))


def impact_signals(spark, sf):
    return classify.impacts(_lines(spark, sf)).select("doc_id", F.array_join("impacts", ",").alias("impacts"))


def removed_reasons(spark, sf):
    removed = diff.removed_lines(_lines(spark, sf))
    return removed.select("doc_id", "hunk_ix", F.col("line_ix").cast("long").alias("line_ix"), classify.removed_reason(F.col("text")).alias("reason"))


def file_risks(spark, sf):
    return _risk(spark, sf).select("doc_id", F.col("file_kind").alias("kind"), F.col("changed").cast("long").alias("changed"), "risk")


def retrieval_profiles(spark, sf):
    rows = _files(spark, sf).join(classify.diff_text(_hunks(spark, sf)), "doc_id", "left")
    kinds = rows.select("doc_id", "status", classify.file_kind(F.col("path"), F.coalesce("diff_text", F.lit(""))).alias("kind"))
    joined = kinds.join(F.broadcast(classify.strategies(spark)), "kind")  # nine rows
    out = classify.retrieval_profile(joined, F.col("doc_id") % 2, F.col("status") == "deleted")
    return out.select("doc_id", "kind", "functions", "types", "slices", "deleted_scopes", "remote_lookups")


def review_segments(spark, sf):
    return segments.review_segments(_hunks(spark, sf)).select("doc_id", "hunk_ix", "segment_ix")


def segment_signals(spark, sf):
    hunks = _hunks(spark, sf)
    rows = diff.lines(hunks)
    own = segments.review_segments(hunks).select("doc_id", "hunk_ix", "segment_ix")
    anchor = diff.touched_lines(rows).select("doc_id", "hunk_ix", F.col("new_line").cast("long").alias("anchor")).join(own, ["doc_id", "hunk_ix"])
    line = F.when(F.col("doc_id") % 3 > 0, F.col("new_line").cast("long"))
    signals = diff.touched_lines(rows).filter("line_ix % 2 = 1").select("doc_id", line.alias("line"), F.concat(F.lit("s"), F.col("line_ix")).alias("summary"))
    return segments.segment_signals(signals, anchor)


def comment_dedup(spark, sf):
    return comments.deduplicate(bridge.review_comments(spark, sf)).select("cr_id", "path", "line", "side", "agent_id", "ord")


def payload_dedup(spark, sf):
    rows = bridge.review_comments(spark, sf).withColumn("payload_id", F.col("cr_id") * 10 + F.col("ord") % 3)
    return comments.deduplicate_payload(rows).select("payload_id", "line", "ord")


def static_merge(spark, sf):
    rows = bridge.review_comments(spark, sf).drop("agent_id")
    return comments.merge_findings(rows.filter("ord % 2 = 0"), rows.filter("ord % 2 = 1")).select("cr_id", "path", "line", "side", "ord")


def review_outcomes(spark, sf):
    rows = bridge.read(spark, sf, "labels").select(
        "doc_id", (F.col("toxic") * (F.col("doc_id") % 3)).alias("errors"), (F.col("doc_id") % 4).alias("comments"), (F.col("doc_id") % 6).alias("files"), (F.col("quality") == 0).alias("strict")
    )
    result = comments.conclusion(F.col("errors"), F.col("strict"), F.col("comments"), F.col("files"))
    status = F.expr("element_at(array('queued', 'in_progress', 'completed'), cast(doc_id % 3 as int) + 1)")
    return rows.withColumn("conclusion", result).select(
        "doc_id",
        "conclusion",
        comments.http_status(F.col("errors"), F.col("conclusion")).alias("http"),
        comments.completion_title(F.col("conclusion"), F.col("comments"), F.col("errors")).alias("title"),
        comments.host_state(status, F.col("conclusion")).alias("state"),
        comments.agent_outcome(F.col("comments"), F.col("files") % 2, F.col("errors")).alias("outcome"),
    )


def findings_preview(spark, sf):
    return comments.preview(bridge.review_comments(spark, sf)).select("cr_id", F.col("n").cast("long").alias("n"), "preview")


def token_rollup(spark, sf):
    rows = bridge.read(spark, sf, "lineitem")
    prompt, completion = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    return rows.groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"), F.sum(prompt + completion).alias("total_tokens")
    )


def status_texts(spark, sf):
    rows = bridge.read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return rows.select(
        "doc_id",
        F.md5(comments.shortened(F.col("t"), 140, 137).cast("binary")).alias("short_md5"),
        F.length(comments.shortened(F.col("t"), 255, 252)).alias("short_length"),
        F.length(comments.truncated(F.col("t"), 2000)).alias("cut_length"),
    )


def comment_bodies(spark, sf):
    rows = bridge.discussion_notes(spark, sf)
    return rows.select("note_id", F.md5(comments.decorated(F.col("body")).cast("binary")).alias("decorated_md5"), F.md5(comments.outdated(F.col("body")).cast("binary")).alias("outdated_md5"))


def discussion_cleanup(spark, sf):
    return comments.cleanup_plan(bridge.discussion_notes(spark, sf), "review-bot")


def path_tokens(spark, sf):
    return _files(spark, sf).select("doc_id", F.explode(clusters.path_tokens(F.col("path"))).alias("token"))


def _cluster_files(spark, sf):
    names = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("S"), (F.col("doc_id") * 7 + i * F.col("doc_id")) % 23))
    return _files(spark, sf).select("cr_id", "doc_id", "path", clusters.path_tokens(F.col("path")).alias("path_tokens"), F.array_distinct(names).alias("symbols"))


def related_pairs(spark, sf):
    return clusters.related_pairs(_cluster_files(spark, sf)).select(F.col("cr_id").cast("long").alias("cr_id"), "a", "b", "shared_paths", "shared_symbols")


def change_clusters(spark, sf):
    return clusters.components(clusters.related_links(_cluster_files(spark, sf)))


def shared_symbols(spark, sf):
    rows = _cluster_files(spark, sf).select("cr_id", F.explode("symbols").alias("item"))
    return clusters.shared_items(rows, "cr_id").select(F.col("cr_id").cast("long").alias("cr_id"), "item", "n", F.col("rank").cast("long").alias("rank"))


def identifier_candidates(spark, sf):
    found = symbols.identifier_candidates(_files(spark, sf).withColumnRenamed("patch", "content"))
    return found.select("doc_id", "name", "score", F.col("rank").cast("long").alias("rank"))


def missing_candidates(spark, sf):
    found = cut(symbols.identifier_candidates(_files(spark, sf).withColumnRenamed("patch", "content")))
    known = found.filter("rank % 2 = 0").select("doc_id", "name")
    return symbols.missing_candidates(found, known, 4).select("doc_id", "name", "score")


def agent_profiles(spark, sf):
    agents = spark.createDataFrame(list(AGENTS), "agent_id string, place int")
    lists = "element_at(array('', 'security, correctness', ' Security ,unknown', 'none', 'regression,regression,security'), cast(o_orderkey % 5 as int) + 1)"
    raw = bridge.read(spark, sf, "orders").select("o_orderkey", F.expr(lists).alias("agents"))
    return symbols.agent_profiles(raw, agents, "o_orderkey").select("o_orderkey", "agent_id", F.col("place").cast("long").alias("place"))


def _changes(spark, sf):
    return contracts.contract_changes(bridge.export_contracts(spark, sf, "base"), bridge.export_contracts(spark, sf, "head"))


def contract_changes(spark, sf):
    return _changes(spark, sf).select("module", "name", "change_type")


def contract_consumers(spark, sf):
    return contracts.affected_imports(_changes(spark, sf), bridge.import_edges(spark, sf)).select("importer", "module", "name", "line", "change_type")


def arity_mismatches(spark, sf):
    found = contracts.affected_imports(_changes(spark, sf), bridge.import_edges(spark, sf))
    return contracts.arity_mismatches(found).select("importer", "module", "name", "line", "argc")


def kind_mismatches(spark, sf):
    found = contracts.affected_imports(_changes(spark, sf), bridge.import_edges(spark, sf))
    return contracts.kind_mismatches(found).select("importer", "module", "name", "line", "usage")


def external_consumers(spark, sf):
    rows = bridge.import_edges(spark, sf).filter("symbol is not null")
    hits = rows.select("symbol", F.col("importer").alias("path"), F.col("line").alias("ord"))
    changed = _changes(spark, sf).select(F.col("module").alias("path"))
    return contracts.external_consumers(hits, changed).select("symbol", "path", F.col("n").cast("long").alias("n"))


def reexport_closure(spark, sf):
    return contracts.reexport_closure(bridge.reexport_edges(spark, sf)).select("source", "target", F.col("depth").cast("long").alias("depth"))


def import_resolution(spark, sf):
    rows = bridge.import_edges(spark, sf)
    options = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat("module", F.lit(e)).alias("path")) for i, e in enumerate(modules.ENDINGS)])
    candidates = rows.select("importer", "module", F.explode(options).alias("o")).select("importer", "module", "o.rank", "o.path").distinct()
    files = bridge.read(spark, sf, "part").select(F.expr("concat('m', p_partkey, case p_partkey % 4 when 0 then '.ts' when 1 then '.js' when 2 then '/index.ts' else '.tsx' end)").alias("path"))
    return contracts.first_existing(candidates, files, ["importer", "module"])


def _payloads(spark, sf):
    comment = """concat('{"line": ', doc_id % 9 + if(doc_id % 14 = 0, -20, 0), ', "body": "use {braces} ', doc_id, '"', if(doc_id % 3 = 0, ', "side": "LEFT"', ''), '}')"""
    return bridge.read(spark, sf, "documents").select(
        F.col("doc_id").alias("payload_id"),
        F.expr(
            f"""case doc_id % 7 when 0 then concat('{{"comments": [', {comment}, ']}}')
              when 1 then concat('Here it is:\\n```json\\n[', {comment}, ']\\n```') when 2 then concat('I found {{"comments": [', {comment}, ', ', {comment}, ']}} so.')
              when 3 then concat({comment}, '\\n', {comment}) when 4 then concat('{{not-valid', doc_id) when 5 then '{{"comments": []}}' else concat('so [', {comment}, '] it is') end"""
        ).alias("content"),
    )


def json_recovery(spark, sf):
    return _payloads(spark, sf).select("payload_id", payloads.recovered_json(F.col("content")).isNotNull().alias("recovered"))


def payload_comments(spark, sf):
    rows = _payloads(spark, sf).select("payload_id", payloads.recovered_json(F.col("content")).alias("json"))
    return payloads.payload_comments(rows).select("payload_id", F.col("ord").cast("long").alias("ord"), "line", "body", "side")


def progress_carried(spark, sf):
    rows = progress.carried(bridge.progress_events(spark, sf))
    return rows.select("request_id", "seq", "stage", F.col("completed_so_far").cast("long").alias("completed_so_far"), progress.percent(F.col("completed_so_far"), F.lit(40)).alias("percent"))


def agent_summary(spark, sf):
    return progress.agent_summary(bridge.progress_events(spark, sf))


def last_events(spark, sf):
    return progress.last_events(bridge.progress_events(spark, sf)).select("request_id", "seq", F.col("n").cast("long").alias("n"))


def heartbeats(spark, sf):
    rows = bridge.progress_events(spark, sf)
    spans = rows.groupBy("request_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    ticks = spans.select("request_id", F.explode(F.expr("sequence(date_trunc('DAY', first), last, interval 1 day)")).alias("ts"))
    return progress.heartbeats(rows, ticks)


def latest_heads(spark, sf):
    rows = bridge.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("change_key"), F.date_trunc("month", "o_orderdate").alias("busy"), F.col("o_orderkey").alias("arrival"), F.concat(F.lit("sha"), F.col("o_orderkey")).alias("head")
    )
    return progress.latest_heads(rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        cr_scale_risk, patch_hunks, touched_lines, removed_lines, changed_counts, changed_anchors, whitespace_only, file_status, path_predicates,
        reviewable_files, file_kinds, impact_signals, removed_reasons, file_risks, retrieval_profiles, review_segments, segment_signals,
        comment_dedup, payload_dedup, static_merge, review_outcomes, findings_preview, token_rollup, status_texts, comment_bodies, discussion_cleanup,
        path_tokens, related_pairs, change_clusters, shared_symbols, identifier_candidates, missing_candidates, agent_profiles,
        contract_changes, contract_consumers, arity_mismatches, kind_mismatches, external_consumers, reexport_closure, import_resolution,
        json_recovery, payload_comments, progress_carried, agent_summary, last_events, heartbeats, latest_heads,
    )
    return {f.__name__: f for f in listed}
