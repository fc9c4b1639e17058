"""Unified patches as tables of hunks and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.text import once

HUNK_HEADER = r"^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@"
_BEFORE_HEADER = r"(?m)(?=^@@ -[0-9]+,?[0-9]* \+[0-9]+,?[0-9]* @@)"
#: What trimming and whitespace comparison take for blank: ASCII blanks, NBSP, BOM and Unicode's spaces.
BLANK = "\\x09-\\x0D\\x20\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def trimmed(text: Column) -> Column:
    """``text`` without blanks at its ends."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def normalized_status(status: Column) -> Column:
    """One of the four statuses; anything else is modified."""
    return F.when(status.isin("added", "modified", "deleted", "renamed"), status).otherwise("modified")


def removed_is_deleted(status: Column) -> Column:
    """A host's word for deletion, before normalization."""
    return F.when(status == "removed", F.lit("deleted")).otherwise(status)


def flag_status(new: Column, deleted: Column, renamed: Column) -> Column:
    """Status from flags, in the order new, deleted, renamed."""
    return F.when(new, "added").when(deleted, "deleted").when(renamed, "renamed").otherwise("modified")


def hunks(file_diffs: DataFrame) -> DataFrame:
    """One row a hunk: hunk_ix and the header's ranges; a missing length is 1.

    A patch splits before its headers, so no line is exploded and nothing is shuffled; text
    before the first header is dropped. Each line of a hunk's content ends in a line break.
    """
    parts = file_diffs.withColumn("parts", F.filter(F.split(F.concat("patch", F.lit("\n")), _BEFORE_HEADER), lambda x: x.rlike(HUNK_HEADER)))
    rows = parts.select(*[c for c in file_diffs.columns if c != "patch"], F.posexplode("parts").alias("hunk_ix", "content"))
    number = lambda i: F.regexp_extract("content", HUNK_HEADER, i)
    length = lambda i: F.when(number(i) == "", 1).otherwise(number(i).cast("int"))
    return rows.withColumns(
        {"old_start": number(1).cast("int"), "old_lines": length(2), "new_start": number(3).cast("int"), "new_lines": length(4)}
    )


def lines(hunk_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a hunk line with its kind (+, - or context) and its line on both sides.

    Empty lines and lines that start with a backslash don't count on either side; +++ and ---
    inside a hunk count as context.
    """
    shown = (
        hunk_rows.withColumn("all_lines", F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n"))
        .select("*", F.posexplode("all_lines").alias("line_ix", "line"))
        .drop("all_lines", "content")
        .filter((F.col("line") != "") & ~F.col("line").startswith("@@") & ~F.col("line").startswith("\\"))
    )
    kind = (
        F.when(F.col("line").startswith("+") & ~F.col("line").startswith("+++"), "+")
        .when(F.col("line").startswith("-") & ~F.col("line").startswith("---"), "-")
        .otherwise(" ")
    )
    before = Window.partitionBy(key, "hunk_ix").orderBy("line_ix").rowsBetween(Window.unboundedPreceding, -1)
    passed = lambda other: F.coalesce(F.count_if(F.col("kind") != other).over(before), F.lit(0))
    return (
        shown.withColumn("kind", kind)
        .withColumns({"new_line": F.col("new_start") + passed("-"), "old_line": F.col("old_start") + passed("+")})
        .withColumn("text", F.when(F.col("kind") == " ", F.col("line")).otherwise(F.expr("substr(line, 2)")))
        .drop("line")
    )


def with_changes(file_diffs: DataFrame) -> DataFrame:
    """``file_diffs`` with hunk_texts, added and removed (texts of the changed lines in order), and blank_only (whether
    these are as many, not none, and pairwise equal but for blanks), as arrays of each file's own row.

    What the row tables of hunks and lines tell of a whole file is told here without a row a line or a shuffle.
    """
    texts = F.filter(F.split(F.concat("patch", F.lit("\n")), _BEFORE_HEADER), lambda x: x.rlike(HUNK_HEADER))
    shown = lambda text: F.filter(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: (x != "") & ~x.startswith("@@") & ~x.startswith("\\"))
    changed = lambda sign: F.transform(F.filter("shown", lambda x: x.startswith(sign) & ~x.startswith(sign * 3)), lambda x: F.substr(x, F.lit(2)))
    bare = lambda c: F.transform(c, lambda x: F.regexp_replace(x, f"[{BLANK}]+", ""))
    rows = file_diffs.withColumn("hunk_texts", texts).withColumn("shown", F.flatten(F.transform("hunk_texts", shown)))
    rows = rows.withColumns({"added": changed("+"), "removed": changed("-")}).drop("shown")
    same = (F.size("added") > 0) & (F.size("added") == F.size("removed")) & (bare("added") == bare("removed"))
    return rows.withColumn("blank_only", F.coalesce(same, F.lit(False)))


def first_anchor(hunk_texts: Column) -> Column:
    """The least of a file's ``anchors``, from the texts of its hunks as ``with_changes`` has them; null without hunks."""
    number = lambda text, i: F.regexp_extract(text, HUNK_HEADER, i).cast("int")
    shown = lambda text: F.filter(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: (x != "") & ~x.startswith("@@") & ~x.startswith("\\"))
    is_kind = lambda x, sign: x.startswith(sign) & ~x.startswith(sign * 3)

    def first_added(text: Column, lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: is_kind(x, "+")), F.lit(True)).cast("int")
        return once(at, lambda n: F.when(n > 0, number(text, 3) + F.size(F.filter(F.slice(lines, F.lit(1), n - 1), lambda x: ~is_kind(x, "-")))))

    added = F.array_min(F.transform(hunk_texts, lambda text: once(shown(text), lambda lines: first_added(text, lines))))
    edges = F.array_min(F.transform(hunk_texts, lambda text: F.greatest(F.lit(1), number(text, 3) - 1)))
    return F.coalesce(added, edges)


def touched_lines(line_rows: DataFrame) -> DataFrame:
    return line_rows.filter("kind = '+'")


def touched_ranges(ranges: DataFrame, line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ranges (key, start, end and others) that hold an added line. Ranges and lines of a file are laid out once by
    line, and a range asks for the next added line from its start on; so none of them are paired."""
    lines = touched_lines(line_rows).select(key, F.col("new_line").cast("long").alias("start"), F.lit(True).alias("is_line"))
    laid = ranges.withColumn("is_line", F.lit(False)).unionByName(lines, allowMissingColumns=True)
    on = Window.partitionBy(key).orderBy(F.col("start").desc(), F.col("is_line").desc()).rowsBetween(Window.unboundedPreceding, 0)
    following = F.min(F.when(F.col("is_line"), F.col("start"))).over(on)
    return laid.withColumn("following", following).filter(~F.col("is_line") & (F.col("following") <= F.col("end"))).select(*ranges.columns)


def removed_lines(line_rows: DataFrame) -> DataFrame:
    return line_rows.filter("kind = '-'")


def anchors(hunk_rows: DataFrame, line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of the new side to look at: those added, or, where none is, the edges of the hunks."""
    added = touched_lines(line_rows).select(key, F.col("new_line").cast("int").alias("anchor")).distinct()
    first = F.greatest(F.lit(1), F.col("new_start"))
    last = F.when(F.col("new_lines") > 0, first + F.col("new_lines") - 1).otherwise(first)
    edges = F.array(F.greatest(F.lit(1), first - 1), first, last, last + 1)
    without = hunk_rows.join(added.select(key).distinct(), key, "left_anti")
    return added.union(without.select(key, F.explode(edges).alias("anchor")).distinct())


def changed_counts(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbers of added and removed lines of each file."""
    return line_rows.groupBy(key).agg(F.count_if(F.col("kind") == "+").alias("added"), F.count_if(F.col("kind") == "-").alias("removed"))


def whitespace_only(line_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Files whose added and removed lines are as many, not none, and pairwise equal but for blanks."""
    order = Window.partitionBy(key, "kind").orderBy("hunk_ix", "line_ix")
    changed = line_rows.filter("kind <> ' '").select(
        key, "kind", F.row_number().over(order).alias("n"), F.regexp_replace("text", f"[{BLANK}]+", "").alias("bare")
    )
    pairs = changed.groupBy(key, "n").agg(
        F.max(F.when(F.col("kind") == "+", F.col("bare"))).alias("a"), F.max(F.when(F.col("kind") == "-", F.col("bare"))).alias("r")
    )
    return pairs.groupBy(key).agg(F.every(F.coalesce(F.col("a") == F.col("r"), F.lit(False))).alias("same")).filter("same").select(key)
