"""Texts that a review's result, its progress and its notifications are told in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.comments import truncated
from reviewloom.streaming.progress import percent

FILES_SHOWN, ERRORS_SHOWN, FINDINGS_NOTIFIED = 12, 8, 5


def say(template: str, *values: Column) -> Column:
    """``template`` with a column for each of its {}."""
    parts = template.split("{}")
    shown = [x for pair in zip(map(F.lit, parts), [*[v.cast("string") for v in values], F.lit("")], strict=True) for x in pair]
    return F.concat(*shown)


# What a finished review says, by the first case that holds.
def completion_summary(result: Column, comments: Column, files: Column, errors: Column, sync: Column) -> Column:
    """sync: a struct of posted, deleted, outdated and failed."""
    return (
        F.when(
            sync["failed"] > 0,
            say("AI review 执行失败，评论同步发布 {} 条、清理 {} 条、标记过期 {} 条，另有 {} 条同步失败。", sync["posted"], sync["deleted"], sync["outdated"], sync["failed"]),
        )
        .when(errors > 0, say("AI review 执行失败，分析了 {} 个文件，其中 {} 个文件处理失败，请查看日志。", files, errors))
        .when((result == "failure") & (comments > 0), say("AI review 未通过，分析了 {} 个文件，并发布了 {} 条阻断评论。", files, comments))
        .when((result == "neutral") & (files == 0), F.lit("AI review 已跳过，过滤后没有高信号文件进入 review 主链。"))
        .when(comments > 0, say("AI review 已完成，分析了 {} 个文件，并发布了 {} 条 review 评论。", files, comments))
        .otherwise(say("AI review 已通过，分析了 {} 个文件，未发现需要发布的高信号评论。", files))
    )


def _more(rows: Column, shown: int, template: str) -> Column:
    """The last line of a list that is longer than what is shown."""
    return F.when(F.size(rows) > shown, say(template, F.size(rows) - shown)).otherwise(F.lit(""))


# The detailed text of a finished review.
def completion_text(label: Column, result: Column, files: Column, sync: Column, errors: Column) -> Column:
    """sync: a struct of attempted, posted, deleted, outdated and failed; errors: an array of (path, message)."""
    outcome = (
        F.when((result == "failure") & (sync["posted"] > 0), "Review 结果: 未通过")
        .when(result == "success", "Review 结果: 通过")
        .when((result == "neutral") & (files == 0), "Review 结果: 已跳过")
        .otherwise("Review 结果: 已完成")
    )
    shown = F.array_join(F.transform(F.slice(errors, 1, ERRORS_SHOWN), lambda x: say("- {}: {}", x["path"], x["message"])), "\n")
    text = (
        F.when(
            sync["failed"] > 0,
            say(
                "{} review completed with comment sync failures.\n分析文件数: {}\n尝试评论数: {}\n已发布评论数: {}\n已删除旧评论数: {}\n已标记过期评论数: {}\n评论同步失败数: {}",
                label, files, sync["attempted"], sync["posted"], sync["deleted"], sync["outdated"], sync["failed"],
            ),
        )
        .when(
            F.size(errors) == 0,
            say("{} review completed.\n{}\n分析文件数: {}\n发布评论数: {}\n删除旧评论数: {}\n标记过期评论数: {}", label, outcome, files, sync["posted"], sync["deleted"], sync["outdated"]),
        )
        .otherwise(
            say(
                "{} review completed with partial failures.\n分析文件数: {}\n发布评论数: {}\n删除旧评论数: {}\n标记过期评论数: {}\n失败文件数: {}\n\n失败详情:\n{}{}",
                label, files, sync["posted"], sync["deleted"], sync["outdated"], F.size(errors), shown, _more(errors, ERRORS_SHOWN, "\n- ... 另有 {} 个文件失败"),
            )
        )
    )
    return truncated(text)


# Texts of a review that is skipped or running.
def skipped_summary(files: Column) -> Column:
    return say("AI review 已跳过：共拿到 {} 个变更文件，但过滤后没有高信号文件进入 review 主链。", files)


def skipped_text(label: Column, files: Column) -> Column:
    return truncated(
        say("{} review skipped.\n原始变更文件数: {}\n进入 review 主链的文件数: 0\n原因: 当前 diff 仅包含被过滤的低信号文件，例如锁文件、构建产物、图片或普通文档改动。", label, files)
    )


def progress_summary(scale: Column, risk: Column, files: Column, file_concurrency: Column, llm_concurrency: Column, agents: Column) -> Column:
    return say("正在分析 {} 个文件，规模 {}，风险分 {}，review agent {} 个，文件并发 {}，LLM 并发 {}。", files, scale, risk, agents, file_concurrency, llm_concurrency)


def progress_text(label: Column, title: Column, author: Column, source: Column, target: Column, scale: Column, risk: Column, paths: Column) -> Column:
    shown = F.array_join(F.transform(F.slice(paths, 1, FILES_SHOWN), lambda x: say("- {}", x)), "\n")
    more = _more(paths, FILES_SHOWN, "\n- ... 另有 {} 个文件")
    return truncated(say("{}: {}\n作者: {}\n分支: {} -> {}\n规模: {}\n风险分: {}\n\n文件预览:\n{}{}", label, title, author, source, target, scale, risk, shown, more))


def review_display(kind: Column, number: Column, branch: Column, sha: Column) -> Column:
    """What a target is called: its number, or its branch and the first of its commit's id."""
    return F.when(kind == "merge_request", say("MR/PR #{}", number)).otherwise(say("{}@{}", branch, F.substring(sha, 1, 8)))


# Lines of notifications.
def result_notification(request: Column, host: Column, project: Column, display: Column, title: Column, result: Column, files: Column, errors: Column, usage: Column, url: Column, comments: Column) -> tuple[Column, Column]:
    """Title and lines; usage: a struct of prompt, completion and total; comments: an array of
    (path, line, body), of which the first FINDINGS_NOTIFIED are shown by their first lines."""
    or_dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    first_line = lambda b: F.coalesce(F.nullif(F.trim(F.split(b, "\n")[0]), F.lit("")), F.lit("AI review finding"))
    lines = F.array(
        say("请求 ID：{}", request), say("代码平台：{}", host), say("项目：{}", project), say("评审对象：{}", display), say("标题：{}", or_dash(title)),
        say("结论：{}", result), say("评审文件数：{}", files), say("评论数：{}", F.size(comments)), say("错误文件数：{}", errors),
        say("输入 Tokens：{}", usage["prompt"]), say("输出 Tokens：{}", usage["completion"]), say("总 Tokens：{}", usage["total"]), say("详情链接：{}", or_dash(url)),
    )
    found = F.transform(F.slice(comments, 1, FINDINGS_NOTIFIED), lambda x: say("- {}:{} {}", x["path"], x["line"], first_line(x["body"])))
    shown = F.when(F.size(comments) > 0, F.concat(lines, F.array(F.lit(""), F.lit("Top Findings:")), found)).otherwise(lines)
    return say("AI Review {} - {}", F.upper(result), project), shown


def failure_notification(request: Column, host: Column, project: Column, kind: Column, display: Column, message: Column) -> tuple[Column, Column]:
    lines = F.array(
        say("请求 ID：{}", request), say("代码平台：{}", host), say("项目：{}", project), say("评审类型：{}", kind), say("评审对象：{}", display),
        F.lit("执行结果：failed"), say("错误信息：{}", message),
    )
    return say("AI Review FAILED - {}", project), lines


# Fixed value: what an address begins with.
def webhook_address(raw: Column) -> Column:
    """The trimmed address; null if there is none, or if it isn't http or https."""
    address = F.nullif(F.trim(raw), F.lit(""))
    return F.when(address.rlike("(?i)^https?://"), address)


# Messages of the stream's envelopes.
def accepted_message(owner: Column, repo: Column, kind: Column) -> Column:
    return say("🤖 已接收 AI Review 请求，目标 {}/{}（{}）", owner, repo, kind)


def heartbeat_message(completed: Column, total: Column, path: Column) -> Column:
    """Progress, if a total is known, and the current file, unless all are done."""
    known = F.coalesce(total > 0, F.lit(False)) & completed.isNotNull()
    done = F.when(known, say("，已完成 {}/{} 个文件", completed, total)).otherwise("")
    left = F.coalesce(F.nullif(path, F.lit("")).isNotNull() & (~known | (completed < total)), F.lit(False))
    return F.concat(F.lit("⏳ AI Review 进行中"), done, F.when(left, say("，当前 {}", path)).otherwise(""))


def result_message(status: Column, files: Column, errors: Column, posted: Column, failed: Column) -> Column:
    return (
        F.when(status == 500, say("💥 AI Review 执行失败：共 {} 个文件，处理失败 {} 项，评论同步失败 {} 条", files, errors, failed))
        .when(status == 409, say("❌ AI Review 未通过：共 {} 个文件，同步 {} 条评论", files, posted))
        .when(posted > 0, say("✅ AI Review 已完成：共 {} 个文件，同步 {} 条评论", files, posted))
        .otherwise(say("✅ AI Review 已通过：共 {} 个文件，未发现阻断问题", files))
    )


def error_message(message: Column) -> Column:
    return say("💥 AI Review 执行失败：{}", message)


def completion_progress(result: Column, files: Column, comments: Column, errors: Column, failed: Column) -> Column:
    return (
        F.when(failed > 0, say("💥 AI Review 完成，但评论同步失败 {} 条，请查看日志", failed))
        .when(errors > 0, say("⚠️ AI Review 完成，但有 {} 个文件处理失败", errors))
        .when(result == "failure", say("❌ AI Review 完成：共 {} 个文件，发现 {} 条问题", files, comments))
        .when(comments > 0, say("✅ AI Review 完成：共 {} 个文件，发布 {} 条评论", files, comments))
        .otherwise(say("✅ AI Review 完成：共 {} 个文件，未发现阻断问题", files))
    )


def envelopes(requests: DataFrame) -> DataFrame:
    """request_id, type, status_code, message, percent: the accepted event of each request, and its
    result, or its error if it has one, as rows of a stream.

    requests: request_id, owner, repo, kind, status, files, errors, posted, failed, error.
    """
    failed = F.col("error").isNotNull()
    accepted = F.struct(
        F.lit("accepted").alias("type"), F.lit(None).cast("int").alias("status_code"), accepted_message(F.col("owner"), F.col("repo"), F.col("kind")).alias("message"), F.lit(None).cast("int").alias("percent")
    )
    result = F.struct(
        F.when(failed, "error").otherwise("result").alias("type"),
        F.when(failed, 500).otherwise(F.col("status")).cast("int").alias("status_code"),
        F.when(failed, error_message(F.col("error"))).otherwise(result_message(F.col("status"), F.col("files"), F.col("errors"), F.col("posted"), F.col("failed"))).alias("message"),
        F.when(~failed, percent(F.col("files"), F.col("files"))).cast("int").alias("percent"),
    )
    return requests.select("request_id", F.explode(F.array(accepted, result)).alias("e")).select("request_id", "e.*")


# How a change of a contract is told.
def contract_description(change: Column, name: Column, kind: Column, new_kind: Column, signature: Column, new_signature: Column) -> Column:
    or_else = lambda c, word: F.coalesce(F.nullif(c, F.lit("")), F.lit(word))
    return (
        F.when(change == "removed", say("导出符号 {} 已被移除", name))
        .when(change == "kind_changed", say("导出符号 {} 的类型已从 {} 变为 {}", name, or_else(kind, "旧类型"), or_else(new_kind, "新类型")))
        .when(change == "signature_changed", say("导出函数 {} 的签名已从 {} 变为 {}", name, or_else(signature, "旧签名"), or_else(new_signature, "新签名")))
        .otherwise(say("导出符号 {} 发生了契约变化", name))
    )


def exporter_signal(description: Column) -> Column:
    return say("检测到跨文件契约变更：{}", description)


def response_payload(review: Column, request: Column, result: Column, files: Column, errors: Column, sync: Column, usage: Column, findings: Column, comments: Column) -> Column:
    """The flat record that a request is answered with."""
    return F.struct(
        review.alias("review"),
        request.alias("requestId"),
        result.alias("conclusion"),
        F.size(comments).alias("commentCount"),
        sync["posted"].alias("syncedCommentCount"),
        sync["deleted"].alias("deletedCommentCount"),
        sync["outdated"].alias("outdatedCommentCount"),
        sync["failed"].alias("commentSyncFailureCount"),
        files.alias("reviewedFileCount"),
        errors.alias("errorCount"),
        findings.alias("findings"),
        usage["prompt"].alias("tokenUsagePrompt"),
        usage["completion"].alias("tokenUsageCompletion"),
        usage["total"].alias("tokenUsageTotal"),
        comments.alias("comments"),
    )
