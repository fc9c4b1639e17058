"""Records of code hosts as change requests, files, comments and states, whatever the host.

Records come as JSON (column ``data``, as sources/hosting.py reads them) beside the target that
was asked for (owner, repo, kind, number, branch, head_sha, base_sha, title, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import base_sha
from reviewloom.operators.diff import flag_status, normalized_status, removed_is_deleted, trimmed

METADATA = ("id", "number", "title", "description", "url", "owner", "repo", "source_branch", "head_sha", "target_branch", "author", "kind", "display_id", "base_sha", "start_sha")
HOSTS = ("github", "gitlab")


def _field(path: str) -> Column:
    return F.get_json_object("data", f"$.{path}")


def _first(*options: Column) -> Column:
    """The first option that isn't null or empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in options])


def normalized_refs(base: Column, start: Column, head: Column) -> Column:
    """base, start (the base if missing) and head of a comparison; '' where there is none."""
    none = F.lit("")
    return F.struct(F.coalesce(base, none).alias("base"), F.coalesce(_first(start, base), none).alias("start"), F.coalesce(head, none).alias("head"))


def _metadata(rows: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    return rows.select(*keys, *[columns[c].alias(c) for c in METADATA])


def request_metadata(rows: DataFrame, keys: list[str]) -> DataFrame:
    """METADATA of merge requests: rows with host, owner, repo, data and, for hosts whose record has
    no refs, those of the latest version (version_base, version_start, version_head)."""
    ours = F.col("host") == "github"
    asked = F.get_json_object("data", "$.diff_refs")
    refs = F.when(asked.isNotNull(), normalized_refs(_field("diff_refs.base_sha"), _field("diff_refs.start_sha"), _field("diff_refs.head_sha"))).otherwise(
        normalized_refs(F.col("version_base"), F.col("version_start"), F.col("version_head"))
    )
    number = F.when(ours, _field("number")).otherwise(_field("iid")).cast("long")
    return _metadata(
        rows,
        keys,
        id=_field("id"),
        number=number,
        title=_field("title"),
        description=F.coalesce(F.when(ours, _field("body")).otherwise(_field("description")), F.lit("")),
        url=F.when(ours, _field("html_url")).otherwise(_field("web_url")),
        owner=F.col("owner"),
        repo=F.col("repo"),
        source_branch=F.when(ours, _field("head.ref")).otherwise(_field("source_branch")),
        head_sha=F.when(ours, _field("head.sha")).otherwise(_first(_field("sha"), refs["head"])),
        target_branch=F.when(ours, _field("base.ref")).otherwise(_field("target_branch")),
        author=F.coalesce(F.when(ours, _first(_field("user.login"))).otherwise(_first(_field("author.username"), _field("author.name"))), F.lit("unknown")),
        kind=F.lit("merge_request"),
        display_id=F.concat(F.when(ours, "#").otherwise("!"), number.cast("string")),
        base_sha=F.when(ours, _field("base.sha")).otherwise(refs["base"]),
        start_sha=F.when(ours, _field("base.sha")).otherwise(refs["start"]),
    )


def commit_metadata(rows: DataFrame, keys: list[str]) -> DataFrame:
    """METADATA of commits; what the target says goes before what the host says.

    rows: host, owner, repo, branch, head_sha, asked_base, title, description, url, author (of the
    target, or null), web_base, data.
    """
    ours = F.col("host") == "github"
    parents = F.when(ours, F.from_json(_field("parents[*].sha"), "array<string>")).otherwise(F.from_json(_field("parent_ids"), "array<string>"))
    one_parent = F.when(ours, _field("parents[0].sha")).otherwise(_field("parent_ids[0]"))
    base = base_sha(F.col("asked_base"), F.coalesce(parents, F.array(one_parent)))
    base = F.coalesce(base, F.lit(""))
    short = F.when(ours, F.substring("head_sha", 1, 8)).otherwise(_first(_field("short_id"), F.substring("head_sha", 1, 8)))
    message = F.when(ours, _field("commit.message")).otherwise(_field("message"))
    first_line = F.when(ours, trimmed(F.split(F.coalesce(message, F.lit("")), "\n")[0])).otherwise(_field("title"))
    return _metadata(
        rows,
        keys,
        id=F.when(ours, _field("sha")).otherwise(_field("id")),
        number=F.lit(None).cast("long"),
        title=_first(F.col("title"), first_line, F.concat(F.lit("Review commit "), short)),
        description=_first(F.col("description"), message, F.concat(F.lit("Push review for "), F.col("branch"))),
        url=_first(F.col("url"), F.when(ours, _field("html_url")).otherwise(_field("web_url")), commit_url(F.col("host"), F.col("web_base"), F.col("owner"), F.col("repo"), F.col("head_sha"))),
        owner=F.col("owner"),
        repo=F.col("repo"),
        source_branch=F.col("branch"),
        head_sha=F.col("head_sha"),
        target_branch=F.col("branch"),
        author=F.coalesce(_first(F.col("author"), F.when(ours, _first(_field("author.login"), _field("commit.author.name"))).otherwise(_field("author_name"))), F.lit("unknown")),
        kind=F.lit("commit"),
        display_id=F.concat("branch", F.lit("@"), short),
        base_sha=base,
        start_sha=base,
    )


def metadata(requests: DataFrame, commits: DataFrame, keys: list[str]) -> DataFrame:
    """Both kinds of targets in one table."""
    return request_metadata(requests, keys).unionByName(commit_metadata(commits, keys))


def file_entries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """path, old_path, status, patch of files' records (host, data).

    One host drops files without a patch and gives an old path to renamed ones only; the other
    keeps empty diffs and always tells the old path.
    """
    ours = F.col("host") == "github"
    flag = lambda name: F.coalesce(_field(name) == "true", F.lit(False))
    patch = F.when(ours, _field("patch")).otherwise(F.coalesce(_field("diff"), F.lit("")))
    status = F.when(ours, normalized_status(removed_is_deleted(F.coalesce(_field("status"), F.lit(""))))).otherwise(
        flag_status(flag("new_file"), flag("deleted_file"), flag("renamed_file"))
    )
    made = rows.select(
        *keys,
        "host",
        F.when(ours, _field("filename")).otherwise(_field("new_path")).alias("path"),
        F.when(ours, F.nullif(_field("previous_filename"), F.lit(""))).otherwise(_field("old_path")).alias("old_path"),
        status.alias("status"),
        patch.alias("patch"),
    )
    return made.filter((F.col("host") != "github") | (trimmed(F.coalesce("patch", F.lit(""))) != "")).drop("host")


def compared_files(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Files between a base and a head; none without a base, if it is the head, or if the host says
    that both are the same. rows: host, base_sha, asked_base, head_sha, data (the comparison's record)."""
    base = _first(F.col("base_sha"), F.col("asked_base"))
    kept = rows.filter(base.isNotNull() & (base != F.col("head_sha")) & (F.coalesce(_field("compare_same_ref"), F.lit("false")) != "true"))
    listed = F.when(F.col("host") == "github", _field("files")).otherwise(_field("diffs"))
    entries = F.from_json(listed, "array<string>")
    return file_entries(kept.select(*keys, "host", F.posexplode(entries).alias("ord", "data")), [*keys, "ord"])


def changed_paths(files: DataFrame, by: str) -> DataFrame:
    """Every path that a change touches, before and after."""
    both = files.select(by, F.explode(F.array("path", "old_path")).alias("path"))
    return both.filter(F.coalesce("path", F.lit("")) != "").distinct()


def comment_position(path: Column, old_path: Column, line: Column, side: Column, refs: Column) -> Column:
    """Where a comment of a merge request stands: an old line on the left, a new one on the right."""
    left = side == "LEFT"
    return F.struct(
        F.lit("text").alias("position_type"),
        refs["base"].alias("base_sha"),
        refs["start"].alias("start_sha"),
        refs["head"].alias("head_sha"),
        _first(old_path, path).alias("old_path"),
        path.alias("new_path"),
        F.when(left, line).alias("old_line"),
        F.when(~left, line).alias("new_line"),
    )


def commit_comment(path: Column, old_path: Column, line: Column, side: Column) -> Column:
    """Where a comment of a commit stands."""
    left = side == "LEFT"
    return F.struct(F.when(left, _first(old_path, path)).otherwise(path).alias("path"), line.alias("line"), F.when(left, "old").otherwise("new").alias("line_type"))


def commit_state(status: Column, result: Column) -> Column:
    """A commit status for hosts that know pending, success, failure and error."""
    return (
        F.when(status.isin("queued", "in_progress"), "pending").when(result.isin("success", "neutral"), "success").when(result == "cancelled", "error").otherwise("failure")
    )


def status_description(summary: Column, title: Column, length: int = 140) -> Column:
    """A status's text: its summary, else its title, shortened."""
    text = F.coalesce(_first(summary, title), F.lit("AI review update"))
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


def commit_url(host: Column, base: Column, owner: Column, repo: Column, sha: Column) -> Column:
    return F.concat(base, F.lit("/"), owner, F.lit("/"), repo, F.when(host == "github", "/commit/").otherwise("/-/commit/"), sha)


def encoded_path(path: Column) -> Column:
    """A path with each of its parts encoded."""
    return F.array_join(F.transform(F.split(path, "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/")


# Messages on requests that can't be served.
def request_errors(kind: Column, number: Column, project: Column, branch: Column, head: Column) -> Column:
    """What is wrong with a request for a review: null if nothing is. A number makes it a merge request's."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    asked = (kind == "merge_request") | number.isNotNull()
    whole = F.trim(number).try_cast("double")
    bad_number = ~F.coalesce((whole > 0) & (whole == F.floor(whole)), F.lit(False))
    return (
        F.when(blank(project), "projectPath is required")
        .when(F.coalesce(asked, F.lit(False)) & bad_number, "mergeRequestIid is required for merge_request review")
        .when(~F.coalesce(asked, F.lit(False)) & (blank(branch) | blank(head)), "branch and headSha are required for commit review")
    )


def wants_stream(query: Column, header: Column, accept: Column) -> Column:
    """Whether a caller asks for events: by a flag in the query, a header, or the type it accepts."""
    from reviewloom.operators.filters import is_truthy

    flag = lambda c: F.coalesce(is_truthy(c), F.lit(False))
    return flag(query) | flag(header) | F.coalesce(F.contains(accept, F.lit("application/x-ndjson")), F.lit(False))
