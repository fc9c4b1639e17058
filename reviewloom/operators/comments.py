"""Review comments: deduplication, merging, outcome, clean-up and the texts that report them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.diff import trimmed

# Fixed value: the line of tokens that bodies begin with.
TOKEN_PREFIX = r"^Token 消耗:[^\n]*\n\n"
MARKER, OUTDATED_MARKER = "<!-- ai-review:mr -->", "<!-- ai-review-outdated:mr -->"
OUTDATED_NOTE = "> outdated by a newer review"
PREVIEW = 8


def deduplicate(comments: DataFrame, by: str = "cr_id") -> DataFrame:
    """The first comment, by ord, at each place with each body, when token lines and outer blanks are left out."""
    bare = trimmed(F.regexp_replace("body", TOKEN_PREFIX, ""))
    first = Window.partitionBy(by, "path", "line", "side", "bare").orderBy("ord")
    return comments.withColumn("bare", bare).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "bare")


def deduplicate_payload(comments: DataFrame, by: str = "payload_id") -> DataFrame:
    """The first comment of a model's answer at each line with each body; sides don't matter."""
    first = Window.partitionBy(by, "line", "body").orderBy("ord")
    return comments.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def merge_findings(findings: DataFrame, comments: DataFrame, by: str = "cr_id") -> DataFrame:
    """Findings at places without a comment, and all comments."""
    return findings.join(comments, [by, "path", "line", "side"], "left_anti").unionByName(comments)


def conclusion(errors: Column, fail_on_comments: Column, comments: Column, files: Column) -> Column:
    return F.when(errors > 0, "failure").when(fail_on_comments & (comments > 0), "failure").when(files == 0, "neutral").otherwise("success")


def http_status(errors: Column, result: Column) -> Column:
    """500 with errors, 409 on failure, else 200."""
    return F.when(errors > 0, 500).when(result == "failure", 409).otherwise(200)


# Titles of completed reviews.
def completion_title(result: Column, comments: Column, errors: Column) -> Column:
    return (
        F.when(errors > 0, "AI Review completed with errors")
        .when((result == "failure") & (comments > 0), "AI Review found blocking issues")
        .when(result == "neutral", "AI Review skipped")
        .otherwise("AI Review completed")
    )


def host_state(status: Column, result: Column) -> Column:
    """A commit status for hosts with their own words."""
    return (
        F.when(status == "queued", "pending")
        .when(status == "in_progress", "running")
        .when(result.isin("success", "neutral"), "success")
        .when(result == "cancelled", "canceled")
        .otherwise("failed")
    )


def shortened(text: Column, length: int, keep: int) -> Column:
    """``text``, or its first ``keep`` characters and three dots if it is longer than ``length``."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def truncated(text: Column, length: int = 60_000) -> Column:
    """A long text cut to fit with a note of it."""
    return F.when(F.length(text) > length, F.concat(F.rtrim(F.substring(text, 1, length - 16)), F.lit("\n... truncated"))).otherwise(text)


def decorated(body: Column, marker: str = MARKER) -> Column:
    """The body with its hidden marker, once."""
    return F.when(F.contains(body, F.lit(marker)), body).otherwise(F.concat(F.lit(marker + "\n"), body))


def outdated(body: Column, marker: str = MARKER, outdated_marker: str = OUTDATED_MARKER, note: str = OUTDATED_NOTE) -> Column:
    """The body marked as outdated, once; the first marker moves to the top."""
    bare = trimmed(body)
    at = F.instr(bare, F.lit(marker))
    rest = F.when(at > 0, F.concat(F.substr(bare, F.lit(1), at - 1), F.substr(bare, at + len(marker)))).otherwise(bare)
    made = F.concat_ws("\n", F.lit(marker), F.lit(outdated_marker), F.lit(note), F.lit(""), trimmed(rest))
    return F.when(F.contains(body, F.lit(outdated_marker)), body).otherwise(made)


def cleanup_plan(notes: DataFrame, user: str | None, marker: str = MARKER) -> DataFrame:
    """action (delete or outdate) for each of our notes that a new review replaces.

    System notes don't count. Discussions of our notes only are deleted; in others our notes
    are marked, if they aren't yet.
    """
    from reviewloom.operators.filters import is_managed_comment

    shown = notes.filter(~F.col("is_system")).withColumn("ours", is_managed_comment(F.col("body"), F.col("author"), F.lit(user), marker))
    totals = shown.groupBy("discussion_id").agg(F.count("*").alias("n"), F.count_if("ours").alias("n_ours")).filter("n_ours > 0")
    action = F.when(F.col("n") == F.col("n_ours"), "delete").when(~F.contains("body", F.lit(OUTDATED_MARKER)), "outdate")
    return shown.filter("ours").join(totals, "discussion_id").select("discussion_id", "note_id", action.alias("action")).filter("action is not null")


def preview(comments: DataFrame, by: str = "cr_id", limit: int = PREVIEW) -> DataFrame:
    """The first comments of each request: path:line and the first line of the body."""
    first = Window.partitionBy(by).orderBy("ord")
    line = F.concat(F.col("path"), F.lit(":"), F.col("line"), F.lit(" "), F.split("body", "\n")[0])
    return comments.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= limit).select(by, "n", line.alias("preview"))


# Fixed value: the line of tokens.
def usage_line(prompt: Column, completion: Column, total: Column) -> Column:
    """The line that tells a call's tokens, the total being their sum if it isn't told; null if all are none."""
    prompt, completion = F.coalesce(prompt, F.lit(0)), F.coalesce(completion, F.lit(0))
    total = F.coalesce(total, prompt + completion)
    line = F.concat(F.lit("Token 消耗: 输入 "), prompt, F.lit(" / 输出 "), completion, F.lit(" / 总计 "), total)
    return F.when((prompt != 0) | (completion != 0) | (total != 0), line)


def agent_outcome(n_comments: Column, n_findings: Column, n_failed: Column) -> Column:
    """What a file's review came to when some agents may have failed."""
    return F.when(n_comments > 0, "comments").when(n_findings > 0, "findings").when(n_failed > 0, "error").otherwise("clean")
