"""Budgets and packing of what a model is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.text import once
from reviewloom.operators.diff import BLANK

MAX_SIGNALS, TRUNCATED = 8, "\n// ... truncated"


def budgets(signal_budget: Column, code_budget: Column, segments: Column) -> tuple[Column, Column, Column, Column]:
    """Characters for signals, slices, code and removed scopes; less of each in a file of several segments."""
    factor = F.when(segments > 1, F.lit(0.82)).otherwise(F.lit(1.0))
    part = lambda least, of, share: F.greatest(F.lit(least), F.floor(of * share * factor)).cast("long")
    return part(260, signal_budget, 1.0), part(360, code_budget, 0.42), part(520, code_budget, 0.58), part(260, signal_budget, 0.95)


# How signals are labelled by their source, and what is told where there is nothing or more.
SIGNAL_LABELS = (("dependency-cruiser", "[dependency-cruiser]"), ("eslint", "[eslint]"), ("diff-impact", "[change-impact]"))
OTHER_SIGNAL, NO_SIGNALS = "[tsquery]", "（未发现可确认的高置信度信号）"
#: Of each section: what is told where it is empty, and before the number of blocks that didn't fit; characters that blocks get at most.
SECTIONS = {
    "code": ("（未发现外部关联代码）", "（外部关联代码较多，已优先保留最相关定义）"),
    "slices": ("（未提取到关键语义切片）", "（语义切片较多，已优先保留最接近改动的片段）"),
    "removed": ("（未检测到需要重点关注的删除型旧逻辑）", "（删除型旧逻辑较多，已优先保留最危险的片段）"),
}
PREFERRED = {"function": 900, "type": 820, "slice": 720, "deleted": 760}


def signal_label(source: Column, line: Column) -> Column:
    name = F.lit(OTHER_SIGNAL)
    for known, label in SIGNAL_LABELS:
        name = F.when(source == known, label).otherwise(name)
    return F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(name, F.lit("[line "), line, F.lit("]"))).otherwise(name)


def packed_signals(signals: DataFrame, key: str, budget: int | str, limit: int = MAX_SIGNALS) -> DataFrame:
    """key, n, rendered, omitted: rendered signals, once each, while they fit; the first always does.

    signals: key, source, line, summary, ord. What follows the first that doesn't fit is left
    out, as its running length stays above the budget, which is a number or the name of a column.
    """
    most = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    place = F.coalesce("line", F.lit(0))
    again = Window.partitionBy(key, "source", place, "summary").orderBy("ord")
    once = signals.withColumn("again", F.row_number().over(again)).filter("again = 1")
    order = Window.partitionBy(key).orderBy("ord")
    rendered = F.concat(F.lit("- "), signal_label(F.col("source"), F.col("line")), F.lit(" "), F.col("summary"))
    sized = (
        once.withColumn("n", F.row_number().over(order))
        .withColumn("total", F.count("*").over(Window.partitionBy(key)))
        .withColumn("rendered", rendered)
        .withColumn("upto", F.sum(F.length("rendered")).over(order))
        .filter((F.col("n") <= limit) & ((F.col("upto") <= most) | (F.col("n") == 1)))
    )
    kept = F.max("n").over(Window.partitionBy(key))
    return sized.withColumn("omitted", F.col("total") - kept).select(key, "n", "rendered", "omitted")


def compacted(content: Column, most: Column) -> Column:
    """A snippet within ``most`` characters: all of it, or whole lines from its start with a note.

    One fold over the lines: it stops at the first that doesn't fit, and after twelve lines at
    one that opens a block.
    """
    def cut(whole: Column) -> Column:
        bare = F.when(F.length(whole) > most, F.substring(_line_ends_trimmed(whole), F.lit(1), (most + 1).cast("int")))
        return once(bare, lambda b: _compacted(F.length(whole), whole, b, most))

    return once(_snippet(content), cut)


def _snippet(content: Column) -> Column:
    from reviewloom.operators.diff import trimmed

    return trimmed(F.regexp_replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n"))


def _line_ends_trimmed(whole: Column) -> Column:
    """Lines without blanks at their ends, also before a last sign that ends lines elsewhere; a run of blanks is tried once."""
    return F.regexp_replace(whole, r"(?<![^\S\n])[^\S\n]++(?=[\u0085\u2028\u2029]?(?:\n|\z))", "")


def _compacted(size: Column, whole: Column, bare: Column, most: Column) -> Column:
    """compacted() of a snippet of ``size`` characters. ``whole`` is read only if all of it fits;
    of ``bare`` (it without spaces at the ends of lines) no more than ``most`` + 1 characters count."""
    start = F.expr("named_struct('used', 0, 'n', 0, 'done', false)")

    def step(s: Column, line: Column) -> Column:
        longer = s["used"] + F.length(line) + (s["n"] > 0).cast("int")
        fits = ~s["done"] & (longer <= most - 18)
        return F.when(s["done"], s).otherwise(
            F.struct(
                F.when(fits, longer).otherwise(s["used"]).alias("used"),
                (s["n"] + fits.cast("int")).alias("n"),
                (~fits | ((s["n"] + 1 >= 12) & line.contains("{"))).alias("done"),
            )
        )

    def cut(s: Column) -> Column:
        # whole lines from the start are the text up to their joint length
        return F.when(s["n"] == 0, F.rtrim(F.substring(bare, F.lit(1), (most - 18).cast("int")))).otherwise(F.substring(bare, F.lit(1), s["used"]))

    return F.when(size <= most, whole).otherwise(F.concat(F.aggregate(F.split(bare, "\n"), start, step, cut), F.lit(TRUNCATED)))


def reduced_blocks(blocks: DataFrame, key: str, budget: int | str) -> DataFrame:
    """key, ord, label, preferred, and of body what a block of its greatest budget can use: its
    size, whole (if it fits) and bare, cut where the first line that doesn't fit is decided."""
    limit = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    most = F.greatest(F.lit(220), F.least("preferred", F.col("budget") - 120))
    sized = blocks.withColumn("budget", limit).select(key, "ord", "label", "preferred", "budget", _snippet(F.col("body")).alias("snippet")).withColumn("size", F.length("snippet"))
    return sized.select(
        key, "ord", "label", "preferred", "budget", "size",
        F.when(F.col("size") <= most, F.col("snippet")).alias("whole"),
        F.substring(_line_ends_trimmed(F.col("snippet")), F.lit(1), (most + 1).cast("int")).alias("bare"),
    )


def packed_blocks(blocks: DataFrame, key: str, budget: int | str, fence: str = "ts") -> DataFrame:
    """key, packed, omitted: blocks in order while they fit in ``budget`` characters, a number or a column's name.

    blocks: key, ord, label, body, preferred. A block that doesn't fit is skipped, later ones may
    fit; as long as there is none, the next is taken. Skips feed back into the budget, so this
    is one fold over each key's ordered blocks. Bodies are reduced in their own rows before.
    """
    rows = reduced_blocks(blocks, key, budget)
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "label", "size", "whole", "bare", "preferred"))).alias("blocks"), F.max("budget").cast("long").alias("budget"))
    start = F.expr(f"named_struct('left', budget, 'omitted', 0, 'out', cast(array() as array<string>))")

    def step(s: Column, b: Column) -> Column:
        own = F.greatest(F.lit(220), F.least(b["preferred"], s["left"] - 120))
        made = F.concat(b["label"], F.lit(f"\n```{fence}\n"), once(own, lambda o: _compacted(b["size"], b["whole"], b["bare"], o)), F.lit("\n```"))
        return once(made, lambda m: taken(s, m))

    def taken(s: Column, made: Column) -> Column:
        fits = (F.length(made) <= s["left"]) | (F.size(s["out"]) == 0)
        return F.struct(
            F.when(fits, s["left"] - F.length(made) - 2).otherwise(s["left"]).alias("left"),
            (s["omitted"] + (~fits).cast("int")).alias("omitted"),
            F.when(fits, F.concat(s["out"], F.array(made))).otherwise(s["out"]).alias("out"),
        )

    packed = F.aggregate("blocks", start, step)
    return listed.select(key, packed.alias("p")).select(key, F.array_join("p.out", "\n\n").alias("packed"), F.col("p.omitted").alias("omitted"))


def context_sections(items: DataFrame, signals: DataFrame, limits: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, signals, slices, code, removed: the sections of a segment's prompt as texts, each within its characters.

    items: of ``contexts.segment_context`` (key, kind, place, name, file, content); signals: key, source, line, summary, ord;
    limits: key and signals, slices, code, removed, the characters of each. Definitions count once by name and file,
    functions first. A section without blocks or characters says so; one that leaves blocks out tells how many.
    """
    once = items.withColumn("again", F.row_number().over(Window.partitionBy(key, "kind", "name", "file").orderBy("place"))).filter("again = 1 or kind in ('slice', 'deleted')")
    source = F.when(F.col("file") == "current", "当前文件").otherwise(F.col("file"))
    head = F.when(F.col("kind") == "function", F.concat(F.lit("函数: "), "name")).when(F.col("kind") == "type", F.concat(F.lit("类型: "), "name")).when(F.col("kind") == "slice", F.col("name")).otherwise(F.concat(F.lit("旧逻辑: "), F.coalesce("scope_name", "name")))
    named = once if "scope_name" in items.columns else once.withColumn("scope_name", F.lit(None).cast("string"))
    section = F.when(F.col("kind").isin("function", "type"), "code").when(F.col("kind") == "slice", "slices").otherwise("removed")
    preferred = F.lit(PREFERRED["deleted"])
    for kind, characters in PREFERRED.items():
        preferred = F.when(F.col("kind") == kind, characters).otherwise(preferred)
    blocks = named.select(
        key, section.alias("section"), ((F.col("kind") == "type").cast("long") * (1 << 32) + F.col("place")).alias("ord"), F.concat(F.lit("【"), head, F.lit(" | 来源: "), source, F.lit("】")).alias("label"),
        F.when(F.col("kind") == "deleted", F.concat(F.lit("原因: "), "name", F.lit("\n\n"), "content")).otherwise(F.col("content")).alias("body"), preferred.alias("preferred"),
    ).join(limits, key)
    out = limits.select(key)
    for name, (empty, hint) in SECTIONS.items():
        packed = packed_blocks(blocks.filter((F.col("section") == name) & (F.col(name) > 0)), key, name)
        told = F.when(F.col("omitted") > 0, F.concat(F.col("packed"), F.lit(f"\n\n{hint} 共省略 "), F.col("omitted"), F.lit(" 段。"))).otherwise(F.col("packed"))
        out = out.join(packed.select(key, told.alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(empty)))
    lines = packed_signals(signals.join(limits.select(key, F.col("signals").alias("limit")), key), key, "limit")
    listed = lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "rendered"))), lambda x: x["rendered"]), "\n").alias("t"), F.max("omitted").alias("more"))
    rest = F.when(F.col("more") > 0, F.concat(F.col("t"), F.lit("\n- 其余 "), F.col("more"), F.lit(" 条信号已省略。"))).otherwise(F.col("t"))
    return out.join(listed.select(key, rest.alias("signals")), key, "left").withColumn("signals", F.coalesce("signals", F.lit(NO_SIGNALS)))


# How a prompt tells what it covers.
def review_scope(path: Column, label: Column, segment: Column, segments: Column, hunks: Column) -> Column:
    """The scope of a prompt; hunks: an array of (old_start, old_lines, new_start, new_lines, ...)."""
    listed = F.transform(hunks, lambda h, i: F.concat(F.lit("  - Hunk "), i + 1, F.lit(": "), _ranges(h)))
    part = F.when(segments > 1, F.concat(F.lit("- 当前范围: 这是该文件的第 "), segment, F.lit("/"), segments, F.lit(" 个局部变更段"))).otherwise("- 当前范围: 当前 prompt 覆盖该文件的全部可评审 diff")
    return F.concat(F.lit("- 文件路径: "), path, F.lit("\n- 文件类型: "), label, F.lit("\n"), part, F.lit("\n- Hunk 数量: "), F.size(hunks), F.lit("\n"), F.array_join(listed, "\n"))


def _ranges(hunk: Column) -> Column:
    return F.concat(F.lit("-"), hunk["old_start"], F.lit(","), hunk["old_lines"], F.lit(" / +"), hunk["new_start"], F.lit(","), hunk["new_lines"])


def diff_section(path: Column, hunks: Column) -> Column:
    """The hunks of a file, each under its ranges."""
    shown = F.transform(hunks, lambda h, i: F.concat(F.lit("### Hunk "), i + 1, F.lit(" ("), _ranges(h), F.lit(")\n```diff\n"), F.regexp_replace(h["content"], f"[{BLANK}]+$", ""), F.lit("\n```")))
    none = F.concat(F.lit("文件路径: "), path, F.lit("\n（该文件没有可展示的 diff hunk）"))
    return F.when(F.size(hunks) == 0, none).otherwise(F.concat(F.lit("文件路径: "), path, F.lit("\n\n"), F.array_join(shown, "\n\n")))


def checklist(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
