"""Column functions on names, paths, ids and numbers of reviews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def project_parts(path: Column) -> tuple[Column, Column]:
    """Owner and repository of a project path: the last segment and those before; null with fewer than two."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    enough = F.size(parts) >= 2
    return F.when(enough, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")), F.when(enough, F.element_at(parts, -1))


def short_path(path: Column) -> Column:
    """The last two segments of a longer path."""
    return F.substring_index(path, "/", -2)


def base_sha(sha: Column, parents: Column) -> Column:
    """The base of a change; where it is missing or all zeros, the first parent."""
    missing = sha.isNull() | (sha == "") | sha.rlike("^0+$")
    return F.when(missing, F.coalesce(F.try_element_at(parents, F.lit(1)), F.lit(""))).otherwise(sha)


def number_field(data: Column, name: str) -> Column:
    """A number of a JSON object, also one in a string; null for anything else."""
    return F.trim(F.get_json_object(data, f"$.{name}")).try_cast("double")


def string_field(data: Column, name: str) -> Column:
    """A string of a JSON object, trimmed; null if blank."""
    return F.nullif(F.trim(F.get_json_object(data, f"$.{name}")), F.lit(""))


def review_label(kind: Column, display_id: Column) -> Column:
    return F.concat(F.when(kind == "merge_request", "MR ").otherwise("Commit "), display_id)


def execution_key(owner: Column, repo: Column, kind: Column, number: Column, sha: Column) -> Column:
    """What reviews are serialised by: a request's number, a commit's id."""
    return F.concat_ws(":", owner, repo, kind, F.when(kind == "merge_request", number.cast("string")).otherwise(sha))


def js_length(text: Column) -> Column:
    """Length in UTF-16 units, as JavaScript counts."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def file_url(base: Column, project: Column, path: Column, ref: Column) -> Column:
    """A file's address in a host's API, each part encoded."""
    encoded = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(base, F.lit("/projects/"), encoded(project), F.lit("/repository/files/"), encoded(path), F.lit("?ref="), encoded(ref))
