"""Scopes of source files: declarations with the lines they span, and what changes touch of them.

Scopes are rows of the marks that ``code.source_marks`` gives; offsets tell what lies in what. A scope's text is
cut out of its file only where it is asked for, so nested scopes carry no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators import classify, segments, symbols
from reviewloom.operators.filters import ascii_words
from reviewloom.operators.symbols import is_useful

MAX_SCOPES, MAX_CALLEES, MAX_SECOND, MAX_GUARDS, MAX_PARAMETERS, MAX_SENSITIVE = 4, 5, 3, 2, 6, 5
SLICED_SCOPES, MAX_HELPERS, MAX_SLICES, SLICES_BEFORE_GUARDS_STOP = 3, 4, 6, 2
#: What an import that the changed window names counts, and a call or type in a changed scope.
IMPORT_SCORE, SCOPE_SCORE = 12, 7
# Which definition of a name goes first, and how scopes are called.
KIND_RANK = ("function", "interface", "type", "class", "variable")
KIND_LABELS = (("function", "函数"), ("method", "方法"), ("class", "类"), ("interface", "接口"), ("type", "类型"), ("enum", "枚举"), ("variable", "函数变量"))
# Calls that may have effects, and what a guard does.
SENSITIVE = r"^(set[A-Z]|update|insert|delete|query|execute|fetch|post|put|patch|redirect|send|emit)"
GUARD = r"\b(return|throw)\b"
# The labels of slices.
CHAIN_LABEL, FLOW_LABEL, GUARD_LABEL, FUNCTION_LABEL, TYPE_LABEL = "调用链摘要", "数据流摘要", "关键保护分支", "同文件依赖函数", "同文件依赖类型"


def scopes_of(marks: DataFrame, key: str = "path") -> DataFrame:
    """key, scope, kind, name, start_line, end_line, start, end, depth of each declaration, in order of its
    start. A class's accessors and constructor are no scopes; a variable is one if its first holds a function."""
    place = Window.partitionBy(key).orderBy("start", F.col("end").desc(), "kind")
    found = marks.filter("mark = 'scope'").withColumn("scope", F.row_number().over(place).cast("long") - 1)
    return found.select(key, "scope", "kind", "name", F.col("line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "start", "end", "depth")


def with_texts(scopes: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """``scopes`` with the text that each spans. files: key, content."""
    text = F.col("content").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    return scopes.join(files.select(key, "content"), key).withColumn("text", text).drop("content")


def touching(scopes: DataFrame, touched: DataFrame, key: str = "path") -> DataFrame:
    """The scopes that a line of touched (key, line) lies in.

    Lines and scopes of a file are laid out once by line: a scope is touched if the next line from its start
    on isn't behind its end. So a file with many of both needs no pair of them.
    """
    lines = touched.select(key, F.col("line").cast("long").alias("start_line"), F.lit(True).alias("is_line"))
    marked = scopes.withColumn("is_line", F.lit(False)).unionByName(lines, allowMissingColumns=True)
    on = Window.partitionBy(key).orderBy(F.col("start_line").desc(), F.col("is_line").desc()).rowsBetween(Window.unboundedPreceding, 0)
    next_line = F.min(F.when(F.col("is_line"), F.col("start_line"))).over(on)
    return marked.withColumn("next_line", next_line).filter(~F.col("is_line") & (F.col("next_line") <= F.col("end_line"))).select(*scopes.columns)


def changed_scopes(scopes: DataFrame, touched: DataFrame, key: str = "path", limit: int = MAX_SCOPES) -> DataFrame:
    """The scopes that touched lines lie in, the shortest first, ``limit`` of a file, with their place n.

    touched: key, line."""
    order = Window.partitionBy(key).orderBy(F.col("end") - F.col("start"), "scope")
    return touching(scopes, touched, key).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)


def removed_scopes(scopes: DataFrame, removed: DataFrame, key: str = "path") -> DataFrame:
    """The old scopes that removed lines lie in, with the reason that their texts tell.

    scopes are those of the old version; removed: key, line, text."""
    lines = removed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("gone"))
    inside = F.filter("gone", lambda x: x["line"].between(F.col("start_line"), F.col("end_line")) & (x["text"] != ""))
    rows = changed_scopes(scopes, removed.select(key, "line"), key).join(lines, key)
    return rows.withColumn("reason", classify.removed_reason(F.array_join(F.transform(inside, lambda x: x["text"]), "\n"))).drop("gone")


def chunk_anchors(hunks: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, hunk_ix, line: the lines that a hunk adds; its first and last if it adds none."""
    added = lines.filter("kind = '+'").select(key, "hunk_ix", F.col("new_line").cast("long").alias("line"))
    first = F.greatest(F.lit(1), "new_start")
    last = F.greatest(F.lit(1), F.col("new_start") + F.greatest(F.col("new_lines"), F.lit(1)) - 1)
    bare = hunks.join(added.select(key, "hunk_ix").distinct(), [key, "hunk_ix"], "left_anti")
    return added.unionByName(bare.select(key, "hunk_ix", F.explode(F.array_distinct(F.array(first.cast("long"), last.cast("long")))).alias("line")))


def semantic_segments(hunks: DataFrame, scopes: DataFrame, anchors: DataFrame, key: str = "doc_id") -> DataFrame:
    """``hunks`` with segment_ix: runs of hunks whose shortest touched scope is the same; where that
    gives one run, or more than MAX_SEGMENTS, segments by gaps.

    scopes: key and a scope table's columns; anchors: key, hunk_ix, line.
    """
    met = anchors.groupBy(key, "hunk_ix").agg(F.collect_set("line").alias("lines")).join(scopes, key)
    inside = met.filter(F.exists("lines", lambda x: x.between(F.col("start_line"), F.col("end_line"))))
    own = inside.groupBy(key, "hunk_ix").agg(F.min_by("scope", F.struct(F.col("end") - F.col("start"), "scope")).alias("own"))
    named = hunks.join(own, [key, "hunk_ix"], "left").withColumn("value", F.coalesce(F.concat(F.lit("s"), "own"), F.concat(F.lit("h"), "hunk_ix")))
    order = Window.partitionBy(key).orderBy("hunk_ix")
    changes = (F.row_number().over(order) > 1) & ~F.lag("value").over(order).eqNullSafe(F.col("value"))
    runs = named.withColumn("change", changes.cast("int")).withColumn("run", F.sum("change").over(order))
    last = runs.withColumn("last", F.max("run").over(Window.partitionBy(key))).select(key, "hunk_ix", "run", "last")
    by_gap = segments.review_segments(hunks, key).select(*hunks.columns, "segment_ix")
    fits = F.col("last").between(1, segments.MAX_SEGMENTS - 1)
    return by_gap.join(last, [key, "hunk_ix"]).withColumn("segment_ix", F.when(fits, F.col("run")).otherwise(F.col("segment_ix"))).drop("run", "last")


def symbol_type(kind: Column) -> Column:
    """What a scope defines: a function, a class or an interface."""
    return F.when(kind.isin("function", "method", "variable"), "function").when(kind == "class", "class").otherwise("interface")


def local_symbols(scopes: DataFrame, key: str = "path", order: str = "scope") -> DataFrame:
    """key, name, type, scope: what scopes define, the first of each name by ``order``."""
    best = scopes.filter("name is not null").groupBy(key, "name").agg(F.min_by(F.struct(symbol_type(F.col("kind")).alias("type"), "scope"), order).alias("s"))
    return best.select(key, "name", "s.*")


def symbols_by_name(scopes: DataFrame, wanted: DataFrame, key: str = "path") -> DataFrame:
    """``wanted`` (key, name and others) with the definition of the name at its file's top level: a function
    before an interface, a type, a class, and a function in a variable; a scope table's columns."""
    rank = F.array_position(F.lit(list(KIND_RANK)), F.col("kind"))
    top = scopes.filter((F.col("depth") == 0) & (rank > 0)).withColumn("rank", F.row_number().over(Window.partitionBy(key, "name").orderBy(rank, "scope")))
    return wanted.join(top.filter("rank = 1").drop("rank", "depth"), [key, "name"])


def remote_symbols(hits: DataFrame, definitions: DataFrame, limit: Column) -> DataFrame:
    """own_path, name, path: the first search hit of each name, besides the file that asks, that
    defines it. hits: own_path, name, path, n, in which the first ``limit`` others count;
    definitions: path, name."""
    other = hits.filter(F.col("path") != F.col("own_path"))
    placed = other.withColumn("place", F.row_number().over(Window.partitionBy("own_path", "name").orderBy("n"))).filter(F.col("place") <= limit)
    return placed.join(definitions.select("path", "name").distinct(), ["path", "name"], "left_semi").groupBy("own_path", "name").agg(F.min_by("path", "place").alias("path"))


def scope_label(kind: Column, name: Column) -> Column:
    """A scope as readers are told of it."""
    word = F.lit(None).cast("string")
    for k, label in KIND_LABELS:
        word = F.when(kind == k, label).otherwise(word)
    return F.concat_ws(" ", word, name)


def scope_key(kind: Column, name: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", scope_label(kind, F.lit(None).cast("string")), F.coalesce(name, start.cast("string")), start, end)


def inside(scopes: DataFrame, marks: DataFrame, key: str = "path") -> DataFrame:
    """The marks that lie in each of the scopes (a few of a file), beside key, scope; ``ord`` is their order."""
    own = scopes.select(key, "scope", F.col("start").alias("from"), F.col("end").alias("to"))
    met = own.join(marks.withColumnRenamed("start", "ord"), key)
    return met.filter((F.col("ord") >= F.col("from")) & (F.col("end") <= F.col("to"))).drop("from", "to")


def names_in(scopes: DataFrame, marks: DataFrame, key: str = "path") -> DataFrame:
    """key, scope, name, ord: what the marks in each scope name, each once, where it first stands."""
    return inside(scopes, marks, key).groupBy(key, "scope", "name").agg(F.min("ord").alias("ord"))


def _first(rows: DataFrame, key: str, keep: int, listed: str) -> DataFrame:
    """key, scope and an array of the first names of each scope."""
    best = rows.withColumn("n", F.row_number().over(Window.partitionBy(key, "scope").orderBy("ord"))).filter(F.col("n") <= keep)
    return best.groupBy(key, "scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]).alias(listed))


def call_chains(chosen: DataFrame, marks: DataFrame, scopes: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """key, scope, callees, second: what the chosen scopes call, and for the first of these that their file
    defines as functions, the best scored names of the definition.

    A call's names are whom it calls, unless as a member, and those of its arguments that are names.
    Each definition that is called is read once, however many scopes call it.
    """
    useful = names_in(chosen, marks.filter("mark = 'call'"), key).filter(is_useful(F.col("name")))
    direct = _first(useful, key, MAX_CALLEES, "callees")
    hops = direct.select(key, "scope", F.posexplode(F.slice("callees", 1, MAX_SECOND)).alias("n", "name"))
    defined = symbols_by_name(scopes, hops.select(key, "name").distinct(), key).filter(symbol_type(F.col("kind")) == "function")
    texts = with_texts(defined.select(key, "name", "start", "end"), files, key).select(F.struct(key, "name").alias("of"), F.col("text").alias("content"))
    named = symbols.identifier_candidates(texts, "of").select("of", F.col("name").alias("next"), "rank").filter(F.col("next") != F.col("of.name"))
    placed = named.withColumn("place", F.row_number().over(Window.partitionBy("of").orderBy("rank"))).filter(F.col("place") <= MAX_SECOND)
    listed = placed.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "next"))), lambda x: x["next"]).alias("next")).select("of.*", "next")
    lines = hops.join(listed, [key, "name"]).groupBy(key, "scope").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("name", F.lit(" -> "), F.array_join("next", ", ")).alias("line")))), lambda x: x["line"]).alias("second")
    )
    none = F.expr("cast(array() as array<string>)")
    return direct.join(lines, [key, "scope"], "left").withColumn("second", F.coalesce("second", none))


# The summary of a call chain and of a data flow.
def chain_summary(name: Column, direct: Column, second: Column) -> Column:
    lines = F.array(F.concat(F.lit("入口: "), F.coalesce(name, F.lit("匿名作用域"))), F.concat(F.lit("直接调用: "), F.array_join(direct, ", ")))
    hops = F.concat(F.array(F.lit("二跳调用:")), F.transform(second, lambda x: F.concat(F.lit("- "), x)))
    return F.array_join(F.when(F.size(second) > 0, F.concat(lines, hops)).otherwise(lines), "\n")


def guards_in(chosen: DataFrame, marks: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """key, scope, ord, text: the branches in each chosen scope."""
    found = inside(chosen, marks.filter("mark = 'guard'"), key).select(key, "scope", F.col("ord").alias("start"), "end")
    return with_texts(found, files, key).select(key, "scope", F.col("start").alias("ord"), "text")


def data_flows(chosen: DataFrame, marks: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """key, scope, summary of the parameters, guards and sensitive calls of the chosen scopes that have some."""
    parameters = _first(names_in(chosen, marks.filter("mark = 'parameter'"), key).filter(is_useful(F.col("name"))), key, MAX_PARAMETERS, "parameters")
    sensitive = _first(names_in(chosen, marks.filter("mark = 'call'"), key).filter(F.col("name").rlike(SENSITIVE)), key, MAX_SENSITIVE, "sensitive")
    heads = guards_in(chosen, marks, files, key).withColumn("name", F.trim(F.substring_index("text", "\n", 1))).filter(F.col("name").rlike(ascii_words(GUARD)))
    guards = _first(heads, key, MAX_GUARDS, "guards")
    rows = parameters.join(sensitive, [key, "scope"], "full").join(guards, [key, "scope"], "full")
    lines = F.array(
        F.concat(F.lit("输入参数: "), F.array_join("parameters", ", ")),
        F.concat(F.lit("保护条件: "), F.array_join("guards", " | ")),
        F.concat(F.lit("敏感调用: "), F.array_join("sensitive", ", ")),
        F.when(F.col("sensitive").isNotNull(), F.concat(F.lit("可能参与下游调用的输入: "), F.array_join(F.slice("parameters", 1, 5), ", "))),
    )
    return rows.select(key, "scope", F.array_join(F.array_compact(lines), "\n").alias("summary"))


def semantic_slices(chosen: DataFrame, marks: DataFrame, scopes: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """key, place, label, content: slices of each file's changed scopes (with their place n), six at most.

    For the first three scopes a summary of calls, one of data, and branches that return or throw, read until two
    slices stand; then the file's own definitions of what these scopes call or name as types, four at
    most, without what changed itself. Equal slices count once.
    """
    first = chosen.filter(F.col("n") <= SLICED_SCOPES)
    chains = call_chains(first, marks, scopes, files, key).join(first.select(key, "scope", "name"), [key, "scope"])
    chains = chains.select(key, "scope", chain_summary(F.col("name"), F.col("callees"), F.col("second")).alias("chain"))
    flows = data_flows(first, marks, files, key).select(key, "scope", F.col("summary").alias("flow"))
    branch = F.struct("ord", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"), F.col("text").rlike(ascii_words(GUARD)).alias("leaves"))
    branches = guards_in(first, marks, files, key).groupBy(key, "scope").agg(F.array_sort(F.collect_list(branch)).alias("branches"))
    told = first.select(key, "scope", "n").join(chains, [key, "scope"], "left").join(flows, [key, "scope"], "left").join(branches, [key, "scope"], "left")
    row = F.struct("n", "chain", "flow", F.coalesce("branches", F.expr("cast(array() as array<struct<ord:int,text:string,leaves:boolean>>)")).alias("branches"))
    told = told.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("told"))
    slices = F.aggregate("told", F.expr("cast(array() as array<struct<label:string,content:string>>)"), _with_scope)
    made = told.select(key, F.posexplode(slices).alias("at", "s")).select(key, F.lit(0).alias("part"), "at", "s.*")
    # definitions that the scopes lean on
    own = local_symbols(chosen, key, "n").select(key, "name")
    asked = inside(first, marks.filter("mark = 'call' or (mark = 'type' and kind = 'reference')"), key).join(first.select(key, "scope", "n"), [key, "scope"])
    asked = asked.groupBy(key, "name").agg(F.min(F.struct("n", "ord")).alias("spot")).join(own, [key, "name"], "left_anti")
    known = symbols_by_name(scopes, asked, key).withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("spot"))).filter(F.col("at") <= MAX_HELPERS)
    label = F.when(symbol_type(F.col("kind")) == "function", FUNCTION_LABEL).otherwise(TYPE_LABEL)
    helpers = with_texts(known, files, key).select(key, F.lit(1).alias("part"), "at", label.alias("label"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("content"))
    once = made.unionByName(helpers).groupBy(key, "label", "content").agg(F.min(F.struct("part", "at")).alias("spot"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("spot"))).filter(F.col("place") <= MAX_SLICES).drop("spot")


def _with_scope(slices: Column, scope: Column) -> Column:
    """Slices (label, content) with those of one more scope."""
    made = lambda label, content: F.struct(F.lit(label).alias("label"), content.alias("content"))
    new = lambda given: F.array_except(given, slices)
    summaries = F.concat(slices, new(F.filter(F.array(made(CHAIN_LABEL, scope["chain"]), made(FLOW_LABEL, scope["flow"])), lambda x: x["content"].isNotNull())))
    # with two slices one branch is still read, whatever it does
    read = F.when(F.size(summaries) >= SLICES_BEFORE_GUARDS_STOP, F.slice(scope["branches"], 1, 1)).otherwise(scope["branches"])
    leaving = F.transform(F.filter(read, lambda x: x["leaves"]), lambda x: made(GUARD_LABEL, x["text"]))
    room = F.greatest(F.lit(1), SLICES_BEFORE_GUARDS_STOP - F.size(summaries))
    return F.concat(summaries, F.slice(F.array_except(leaving, summaries), F.lit(1), room))


def scored_candidates(chosen: DataFrame, marks: DataFrame, files: DataFrame, touched: DataFrame, diffs: DataFrame, key: str = "path") -> DataFrame:
    """key, name, score, import_source, rank: names that a change speaks of, by the sum of three sources.

    An import whose name occurs in the touched lines or in the first three changed scopes counts 12; a name that
    is called or named as a type in one of the four scopes counts 7 each time, in nested scopes once for each; and names
    count what their places in the changed text do. touched: key, line, text; diffs: key, content.
    """
    lines = touched.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("lines"))
    texts = with_texts(chosen.filter(F.col("n") <= SLICED_SCOPES), files, key).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("texts"))
    window = lines.join(texts, key, "full").select(key, F.concat_ws("\n", "lines", "texts").alias("window"))
    imports = marks.filter("mark = 'import'").join(window, key).filter(F.contains("window", F.col("local")))
    part = lambda rows, source, score, ord_, order: rows.select(key, "name", score.cast("long").alias("score"), source.alias("source"), F.lit(order).alias("part"), ord_.cast("long").alias("ord"))
    none = F.lit(None).cast("string")
    evidence = part(imports.drop("name").withColumnRenamed("local", "name"), F.col("module"), F.lit(IMPORT_SCORE), F.col("start"), 0)
    called = inside(chosen, marks.filter("mark in ('call', 'type')"), key)
    evidence = evidence.unionByName(part(called, none, F.lit(SCOPE_SCORE), F.col("ord"), 1))
    evidence = evidence.unionByName(part(symbols.identifier_candidates(diffs, key), F.col("import_source"), F.col("score"), F.col("rank"), 2))
    useful = evidence.withColumn("name", F.trim("name")).filter(is_useful(F.col("name")))
    scored = useful.groupBy(key, "name").agg(F.sum("score").alias("score"), F.min_by("source", F.when(F.col("source").isNotNull(), F.struct("part", "ord"))).alias("import_source"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "name")))


def capped_slices(slices: DataFrame, cap: Column, key: str = "doc_id") -> DataFrame:
    """Slices, once by label, file and content, in order, as many as ``cap``. slices: key, label, file, content, ord."""
    once = slices.groupBy(key, "label", "file", "content").agg(F.min("ord").alias("ord"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).filter(F.col("place") <= cap)
