"""Predicates on paths, names, bodies and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.diff import trimmed

# Build output, lockfiles and binaries, which are not reviewed.
IGNORED = (
    r"node_modules/",
    r"dist/",
    r"build/",
    r"coverage/",
    r"[.]next/",
    r"storybook-static/",
    r"package-lock[.]json$",
    r"yarn[.]lock$",
    r"pnpm-lock[.]yaml$",
    r"bun[.]lockb$",
    r"[.]min[.]js$",
    r"[.]min[.]css$",
    r"[.]map$",
    r"[.]snap$",
    r"[.]pdf$",
    r"[.]woff$",
    r"[.]woff2$",
    r"[.]ttf$",
    r"[.]eot$",
    r"[.]ico$",
    r"[.]mp4$",
    r"[.]mp3$",
    r"[.]zip$",
    r"[.]gz$",
    r"[.]png$",
    r"[.]jpg$",
    r"[.]jpeg$",
    r"[.]gif$",
    r"[.]svg$",
)
# Lower-cased paths of deployment files.
DEPLOYMENT = (
    r"^[.]gitlab-ci[.]ya?ml$",
    r"^dockerfile(?:[.][^.]+)?$",
    r"(^|/)[.]gitlab/",
    r"(^|/)[.]github/workflows/",
    r"(^|/)[.]circleci/",
    r"(^|/)[.]buildkite/",
    r"(^|/)(deploy|deployment|release|runbook|ops|operation|infra|infrastructure|k8s|kubernetes|helm|charts|terraform|tfvars|manifests)(/|[.-])",
    r"(^|/)(docker-compose|compose)[.]ya?ml$",
    r"(^|/)(azure-pipelines|bitrise)[.]ya?ml$",
    r"[.]tf$",
    r"[.]tfvars$",
)
# Paths that raise the risk.
HIGH_RISK = ("src/auth/", "src/security/", "src/config/", "[.]env")
# Endings of scripts.
SCRIPT_ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
# Words that switch a flag on.
TRUTHY = ("1", "true", "yes", "on", "ndjson")


_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def ascii_words(pattern: str) -> str:
    """``pattern`` with word boundaries that go by ASCII, whatever the engine's own do."""
    return pattern.replace("\\b", _BOUNDARY)


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


IGNORED_PATTERN = any_of(IGNORED)


def is_ignored(path: Column) -> Column:
    """Build output, lockfiles, binaries; directories match anywhere in a path."""
    return path.rlike(IGNORED_PATTERN)


def is_documentation(path: Column) -> Column:
    return path.rlike(r"(?i)[.](md|mdx|txt)$")


def is_deployment(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).rlike(any_of(DEPLOYMENT))


def is_high_risk(path: Column) -> Column:
    return path.rlike(any_of(HIGH_RISK))


def extension(path: Column) -> Column:
    """The lower-cased ending with its dot, '' if none; a name's leading dot is no ending's."""
    name = F.substring_index(F.lower(path), "/", -1)
    return F.regexp_extract(name, r"^.+([.][^.]*)$", 1)


def is_script(path: Column) -> Column:
    return extension(path).isin(*SCRIPT_ENDINGS)


def is_truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(*TRUTHY), F.lit(False))


def is_code_change(action: Column, old_revision: Column, last_commit: Column) -> Column:
    """Merge-request events that bring new code."""
    given = lambda c: F.coalesce(c != "", F.lit(False))
    return action.isin("open", "reopen") | ((action == "update") & (given(old_revision) | given(last_commit)))


# How our older comments begin.
LEGACY_BEGINNINGS = ("Token 消耗:", "💡 **[")


def is_managed_comment(body: Column, author: Column, user: Column, marker: str, with_legacy: bool = True) -> Column:
    """Our own comments: marked, or with an old beginning, and by this user where that is known."""
    bare = trimmed(body)
    ours = F.contains(bare, F.lit(marker))
    if with_legacy:
        for beginning in LEGACY_BEGINNINGS:
            ours = ours | F.startswith(bare, F.lit(beginning))
    return F.coalesce(ours, F.lit(False)) & (user.isNull() | F.coalesce(author == user, F.lit(False)))


# What a failed remote call says when another attempt may help.
RETRY_STATUS, RETRY_CODES = (408, 409, 429), ("ECONNRESET", "ECONNREFUSED", "ECONNABORTED", "ETIMEDOUT", "EAI_AGAIN")
RETRY_NAMES, RETRY_MESSAGES = "timeout|rate|connection", "timeout|timed out|rate limit|too many requests"


def is_retryable(status: Column, code: Column, name: Column, message: Column) -> Column:
    """Errors of a remote call that are worth another attempt."""
    found = (
        status.isin(*RETRY_STATUS) | (status >= 500),
        F.upper(code).isin(*RETRY_CODES),
        F.lower(name).rlike(RETRY_NAMES),
        F.lower(message).rlike(RETRY_MESSAGES),
    )
    whole = F.lit(False)
    for x in found:
        whole = whole | F.coalesce(x, F.lit(False))
    return whole


def reviewable(file_diffs: DataFrame, line_rows: DataFrame, hunk_rows: DataFrame, blank_only: DataFrame, key: str = "doc_id") -> DataFrame:
    """Files worth a review: none that is ignored, documentation, deployment, without hunks or
    changed in blanks only. Path tests come first, as they need no join."""
    named = file_diffs.filter(~is_ignored(F.col("path")) & ~is_documentation(F.col("path")) & ~is_deployment(F.col("path")))
    return named.join(hunk_rows.select(key).distinct(), key, "left_semi").join(blank_only, key, "left_anti")


def reviewable_changes(changes: DataFrame) -> DataFrame:
    """``reviewable`` over rows of ``diff.with_changes``, without a join."""
    named = changes.filter(~is_ignored(F.col("path")) & ~is_documentation(F.col("path")) & ~is_deployment(F.col("path")))
    return named.filter((F.size("hunk_texts") > 0) & ~F.col("blank_only"))
