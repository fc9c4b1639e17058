"""Drift between what modules export and how others use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.lineage import cut
from reviewloom.operators import code, modules
from reviewloom.operators.filters import is_script

MAX_DEPTH, MAX_CONSUMERS = 4, 10


def contract_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """change_type of each symbol that base exports: removed, kind_changed or signature_changed.

    New exports are no change. Counts that are unknown on both sides are equal.
    """
    told = [c for c in ("kind", "required", "total", "rest", "line", "signature") if c in head.columns]
    new = head.select("module", "name", *[F.col(c).alias(f"new_{c}") for c in told])
    joined = base.join(new, ["module", "name"], "left")
    same = F.col("required").eqNullSafe(F.col("new_required")) & F.col("total").eqNullSafe(F.col("new_total")) & F.col("rest").eqNullSafe(F.col("new_rest"))
    change = F.when(F.col("new_kind").isNull(), "removed").when(F.col("kind") != F.col("new_kind"), "kind_changed").when(~same, "signature_changed")
    return joined.withColumn("change_type", change).filter("change_type is not null")


def affected_imports(changes: DataFrame, imports: DataFrame) -> DataFrame:
    """Imports of changed modules: of the symbol itself, or of the whole module (no symbol)."""
    return imports.join(changes, "module").filter(F.col("symbol").isNull() | (F.col("symbol") == F.col("name")))


def arity_mismatches(affected: DataFrame) -> DataFrame:
    """Calls with fewer arguments than the new contract requires, or more than it takes."""
    few = F.col("argc") < F.col("new_required")
    many = ~F.col("new_rest") & F.col("new_total").isNotNull() & (F.col("argc") > F.col("new_total"))
    return affected.filter((F.col("change_type") == "signature_changed") & F.col("new_required").isNotNull() & (few | many))


def kind_mismatches(affected: DataFrame) -> DataFrame:
    """Calls of what is no function now, constructions of what is no class."""
    changed = affected.filter("change_type = 'kind_changed'")
    calls = changed.filter("not is_new and new_kind <> 'function'").withColumn("usage", F.lit("call"))
    return calls.unionByName(changed.filter("is_new and new_kind <> 'class'").withColumn("usage", F.lit("construct")))


def external_consumers(hits: DataFrame, changed: DataFrame, by: str = "symbol", limit: int = MAX_CONSUMERS, scripts_only: bool = False) -> DataFrame:
    """The first search hits of each symbol outside the changed files, of scripts only if asked.

    hits: by, path, ord; changed: path.
    """
    hits = hits.filter(is_script(F.col("path"))) if scripts_only else hits
    outside = hits.join(changed.select("path").distinct(), "path", "left_anti").groupBy(by, "path").agg(F.min("ord").alias("ord"))
    return outside.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("ord", "path"))).filter(F.col("n") <= limit)


def reexport_closure(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """source, target, depth: modules reached through re-exports, by the shortest way, in
    ``max_depth`` steps. edges: source, target. One join a step, each written before the next."""
    once = cut(edges.select("source", "target").distinct())
    found = step = once.withColumn("depth", F.lit(1))
    hop = once.select(F.col("source").alias("target"), F.col("target").alias("next"))
    for depth in range(2, max_depth + 1):
        step = cut(
            step.join(hop, "target")
            .select("source", F.col("next").alias("target"))
            .filter("source <> target")
            .distinct()
            .join(found.select("source", "target"), ["source", "target"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        found = found.union(step)
    return found


def first_existing(candidates: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """For each key the candidate path of the lowest rank that exists. candidates: by, rank, path."""
    return candidates.join(files.select("path").distinct(), "path", "left_semi").groupBy(*by).agg(F.min_by("path", "rank").alias("path"), F.min("rank").alias("rank"))


# Rules of findings and their texts.
REMOVED_RULE, SIGNATURE_RULE, KIND_RULE = "contract-export-removed", "contract-function-signature-drift", "contract-export-kind-drift"


def _removed_text(module: Column, name: Column) -> Column:
    return F.format_string("**[跨文件契约漂移]** `%s` 已移除导出 `%s`，但当前文件仍在导入它。这样合并后会直接导致模块加载失败或运行时报错。建议同步迁移调用方，或在导出侧保留兼容层。", module, name)


def _signature_text(module: Column, name: Column, old: Column, new: Column) -> Column:
    told = "**[跨文件调用方未同步]** `%s` 导出的 `%s` 已从 %s 变成 %s，但这里仍按旧调用方式传参。合并后很容易出现必填参数缺失、默认值失效或运行时分支漂移。建议同步更新所有调用点。"
    return F.format_string(told, module, name, old, new)


def _kind_text(module: Column, name: Column, old: Column, new: Column, is_new: Column) -> Column:
    told = "**[跨文件调用方式未同步]** `%s` 导出的 `%s` 已从 %s 变为 %s，但这里仍按%s方式使用它。合并后很容易出现运行时报错或语义漂移。建议同步调整调用方式，或在导出侧保留兼容层。"
    return F.format_string(told, module, name, old, new, F.when(is_new, "`new` 构造").otherwise("函数调用"))


def change_summary() -> Column:
    """What a change of a contract is told as."""
    return (
        F.when(F.col("change_type") == "removed", F.format_string("导出符号 %s 已被移除", "name"))
        .when(F.col("change_type") == "kind_changed", F.format_string("导出符号 %s 的类型已从 %s 变为 %s", "name", "kind", "new_kind"))
        .otherwise(F.format_string("导出函数 %s 的签名已从 %s 变为 %s", "name", "signature", "new_signature"))
    )


def _file(repo: str, path: str = "path") -> Column:
    return F.concat(F.col(repo).cast("string"), F.lit(":"), F.col(path))


def _path(file: str) -> Column:
    return F.col(file).substr(F.instr(F.col(file), F.lit(":")) + 1, F.length(F.col(file)))


def changed_contracts(old: DataFrame, new: DataFrame, changed: DataFrame, repo: str = "repo") -> DataFrame:
    """Changes of what the changed files export, by their present paths; ``line`` is where to look, in the new
    version unless the export is gone. old, new: marks by file; changed: repo, path, old_path, status."""
    scripts = changed.filter(is_script(F.col("path")))
    was = scripts.filter("status <> 'added'").select(_file(repo, "old_path").alias("file"), _file(repo).alias("module"))
    before = code.contracts_of(old, "file").join(was, "file").drop("file")
    now = scripts.filter("status <> 'deleted'").select(_file(repo).alias("file"))
    after = code.contracts_of(new, "file").join(now, "file", "left_semi").withColumnRenamed("file", "module")
    return contract_changes(before, after).withColumn("line", F.coalesce("new_line", "line"))


def binding_table(marks: DataFrame, changed: DataFrame, files: DataFrame, aliases: DataFrame, repo: str = "repo") -> DataFrame:
    """file, local, symbol, module, namespace, member, line, ord: what the changed files' names mean in changed modules.

    From source texts to modules: specifiers by folders, aliases and endings; barrels down to the changed module that
    declares a name; then what assignments pass on, in the order of a file's statements. marks: of the new version by
    file, barrels too; changed: repo, path, status; files: repo, path of all that exist; aliases: repo, ord, pattern, targets.
    """
    scripts = changed.filter(is_script(F.col("path")) & (F.col("status") != "deleted")).select(repo, "path", _file(repo).alias("file"))
    known = scripts.select("file")
    every = files.select(repo, "path", _file(repo).alias("file"))
    named = lambda rows: rows.join(every, "file").withColumnsRenamed({"module": "specifier", "path": "importer"})
    imports, passed = named(code.imports_of(marks, "file").join(known, "file", "left_semi")), named(code.reexports_of(marks, "file"))
    asked = imports.select(repo, "importer", "specifier").unionByName(passed.select(repo, "importer", "specifier"))
    means = modules.resolved_imports(asked, files, aliases, repo).withColumn("module", _file(repo)).drop("path")
    key = [repo, "importer", "specifier"]
    imports = cut(imports.join(means, key).select("file", "symbol", "local", "line", "kind", "module"))
    passed = passed.join(means, key).select(F.col("file").alias("module"), F.col("module").alias("source"), F.col("kind").alias("form"), F.col("symbol").alias("name"), F.col("local").alias("exported"))
    exports = code.contracts_of(marks, "file").join(known, "file", "left_semi").select(F.col("file").alias("module"), "name")
    barrels = modules.barrel_exports(exports, passed)
    whole, order = F.col("kind") == "namespace", F.array_position(F.lit(["default", "namespace", "named"]), F.col("kind"))
    direct = imports.join(known.withColumnRenamed("file", "module"), "module", "left_semi").select(
        "file", "local", "symbol", "module", whole.alias("namespace"), F.lit(None).cast("string").alias("member"), F.col("line").cast("long").alias("line"), F.struct("line", order.alias("order"), F.lit(0).alias("n"), "local").alias("at")
    )
    return _numbered(direct.unionByName(_through(imports, barrels)), marks, known)


def _through(imports: DataFrame, barrels: DataFrame) -> DataFrame:
    """Bindings that imports of barrels make: of a name itself, or of a member behind a namespace."""
    found = imports.select("file", F.col("symbol").alias("wanted"), "local", "line", "kind", "module").join(barrels, "module")
    whole, is_direct = F.col("kind") == "namespace", F.size("export_path") == 1
    found = found.filter(whole | ((F.col("wanted") == F.col("exported")) & (is_direct | (F.col("kind") == "named"))))
    base = F.when(whole, modules.access_base(F.col("local"), F.col("export_path"))).when(is_direct, F.col("local")).otherwise(modules.access_base(F.col("local"), F.col("export_path"), skip_root=True))
    behind = whole | ~is_direct
    order = F.array_position(F.lit(["default", "namespace", "named"]), F.col("kind"))
    return found.select(
        "file", base.alias("local"), "symbol", F.col("target").alias("module"), behind.alias("namespace"), F.when(behind, F.element_at("export_path", -1)).alias("member"),
        F.col("line").cast("long").alias("line"), F.struct("line", order.alias("order"), F.lit(1).alias("n"), "local").alias("at"),
    )


def _numbered(bindings: DataFrame, marks: DataFrame, known: DataFrame) -> DataFrame:
    """Bindings in the order of their imports, and those that assignments add."""
    placed = bindings.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("at")).cast("long")).drop("at")
    given = code.assignments_of(marks, "file").join(known, "file", "left_semi")
    return modules.binding_aliases(placed, given.withColumn("ord", F.col("ord").cast("long") + (1 << 40)), "file")


def contract_findings(changes: DataFrame, bindings: DataFrame, marks: DataFrame, repo: str = "repo") -> DataFrame:
    """repo, path, line, side, severity, rule_id, module, name, body: a row for each place that a change of a contract breaks.

    Imports of what is gone; calls with fewer arguments than the new signature asks or more than it takes; calls of
    what is no function any more, and constructions of what is no class. changes: of ``changed_contracts``;
    bindings: of ``binding_table``; marks: of the new version by file.
    """
    met = bindings.select("file", "local", "symbol", "module", "namespace", "member", F.col("line").alias("bound_at")).join(changes.drop("line"), "module")
    met = met.filter(F.col("symbol").isNull() | (F.col("symbol") == F.col("name")))
    module = _path("module")
    gone = met.filter("change_type = 'removed'").select("file", F.col("bound_at").alias("line"), F.lit(REMOVED_RULE).alias("rule_id"), "module", "name", _removed_text(module, F.col("name")).alias("body"))
    callee = F.when(F.col("namespace"), F.concat("local", F.lit("."), F.coalesce("member", "name"))).otherwise(F.col("local"))
    used = met.filter("change_type <> 'removed'").withColumn("callee", callee).join(code.sites_of(marks, "file").withColumn("line", F.col("line").cast("long")), ["file", "callee"])
    drift = arity_mismatches(used.filter("not is_new"))
    drift = drift.select("file", "line", F.lit(SIGNATURE_RULE).alias("rule_id"), "module", "name", _signature_text(module, F.col("name"), F.col("signature"), F.col("new_signature")).alias("body"))
    other = kind_mismatches(used)
    other = other.select("file", "line", F.lit(KIND_RULE).alias("rule_id"), "module", "name", _kind_text(module, F.col("name"), F.col("kind"), F.col("new_kind"), F.col("usage") == "construct").alias("body"))
    found = gone.unionByName(drift).unionByName(other)
    return found.select(
        F.substring_index("file", ":", 1).alias(repo), _path("file").alias("path"), "line", F.lit("RIGHT").alias("side"), F.lit("error").alias("severity"), "rule_id", module.alias("module"), "name", "body"
    )


def contract_signals(changes: DataFrame, hits: DataFrame, changed: DataFrame, repo: str = "repo") -> DataFrame:
    """repo, path, line, summary: what readers of a changed module are told, of each change and of the scripts
    outside of the change that search finds for its name. hits: repo, symbol, path, ord."""
    rows = changes.select(F.substring_index("module", ":", 1).alias(repo), _path("module").alias("path"), "line", "name", change_summary().alias("told"))
    own = rows.select(repo, "path", "line", F.concat(F.lit("检测到跨文件契约变更："), "told").alias("summary"))
    of = hits.withColumn("by", F.struct(F.col(repo).cast("string").alias("repo"), "symbol")).withColumnRenamed("path", "hit")
    outside = of.join(changed.select(repo, F.col("path").alias("hit")), [repo, "hit"], "left_anti").withColumnRenamed("hit", "path")
    counted = external_consumers(outside.select("by", "path", "ord"), changed.select("path").limit(0), "by", scripts_only=True).groupBy("by").agg(F.count("*").alias("n"))
    asked = rows.filter("name <> 'default'").withColumn("by", F.struct(F.col(repo).alias("repo"), F.col("name").alias("symbol")))
    more = asked.join(counted, "by").select(repo, "path", "line", F.format_string("导出契约 %s，仓库内还有 %s 个疑似外部调用文件未包含在本次 diff 中", "told", F.col("n").cast("string")).alias("summary"))
    return own.unionByName(more)
