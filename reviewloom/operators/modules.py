"""What names of modules mean: paths, aliases, barrels, namespaces and local aliases of bindings."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.lineage import cut

# What is tried after a path, in this order.
ENDINGS = (
    "", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".d.ts",
    "/index.ts", "/index.tsx", "/index.mts", "/index.cts", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs", "/index.d.ts",
)
# Configurations that name aliases, in the order they are loaded.
CONFIGS = ("tsconfig.json", "tsconfig.base.json", "tsconfig.app.json", "tsconfig.node.json", "jsconfig.json")
MAX_DEPTH, ALIAS_ROUNDS = 4, 2
_NO_NAMES = "cast(array() as array<string>)"


def normalized_path(path: Column) -> Column:
    """A path without empty parts, '.' and resolvable '..'; a leading and a trailing slash stay, and
    so does '..' at the start of a relative path. An empty path is '.'."""
    absolute = path.startswith("/")
    parts = F.aggregate(F.split(path, "/"), F.expr(_NO_NAMES), lambda d, p: F.when(p == "..", _up(d, p, absolute)).otherwise(_down(d, p)))
    joined = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(parts, "/"))
    tail = F.when(path.endswith("/") & ~joined.endswith("/") & (F.size(parts) > 0), "/").otherwise("")
    return F.coalesce(F.nullif(F.concat(joined, tail), F.lit("")), F.lit("."))


def _up(done: Column, part: Column, absolute: Column) -> Column:
    last = F.try_element_at(done, F.lit(-1))
    return F.when(F.coalesce(last != "..", F.lit(False)), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(absolute, done).otherwise(F.concat(done, F.array(part)))


def _down(done: Column, part: Column) -> Column:
    return F.when(part.isin("", "."), done).otherwise(F.concat(done, F.array(part)))


def directory(path: Column) -> Column:
    """A path without its last part; '.' if that is all of it."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def script_kind(path: Column) -> Column:
    """How a script is parsed, by its ending."""
    ending = F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))
    return F.when(ending == ".tsx", "TSX").when(ending == ".jsx", "JSX").when(ending.isin(".js", ".mjs", ".cjs"), "JS").otherwise("TS")


def alias_mappings(configs: DataFrame, repo: str = "repo") -> DataFrame:
    """repo, ord, pattern, targets of the aliases that a repository's configurations define.

    configs: repo, path, content (JSON). The known names are loaded in order; a configuration is
    loaded once, after the one that it extends (relative paths only, existing ones only). Chains of
    extensions are followed a step at a time; one that closes ends, as its head is loaded already.
    """
    root = F.array_position(F.lit(list(CONFIGS)), F.col("path"))
    extended = F.trim(F.get_json_object("content", "$.extends"))
    whole = F.when(extended.endswith(".json"), extended).otherwise(F.concat(extended, F.lit(".json")))
    parent = F.when(extended.rlike("^[./]"), normalized_path(F.concat(directory(F.col("path")), F.lit("/"), whole)))
    known = cut(configs.select(repo, "path", "content", parent.alias("parent")))
    step = known.filter(root > 0).select(repo, root.alias("root"), F.lit(0).alias("depth"), "path", "parent", F.array("path").alias("chain"))
    found = step = cut(step)
    while not step.isEmpty():
        above = known.select(repo, F.col("path").alias("parent"), F.col("parent").alias("next"))
        step = cut(
            step.join(above, [repo, "parent"])
            .filter(~F.array_contains("chain", F.col("parent")))
            .select(repo, "root", (F.col("depth") + 1).alias("depth"), F.col("parent").alias("path"), F.col("next").alias("parent"), F.concat("chain", F.array("parent")).alias("chain"))
        )
        found = found.unionByName(step)
    # the first root that reaches a configuration loads it, its extensions before it
    order = found.groupBy(repo, "path").agg(F.min(F.struct("root", (-F.col("depth")).alias("depth"))).alias("at"))
    base = normalized_path(F.concat(directory(F.col("path")), F.lit("/"), F.coalesce(F.nullif(F.get_json_object("content", "$.compilerOptions.baseUrl"), F.lit("")), F.lit("."))))
    paths = F.map_entries(F.from_json(F.get_json_object("content", "$.compilerOptions.paths"), "map<string,array<string>>"))
    rows = known.join(order, [repo, "path"]).select(repo, "at", base.alias("base"), F.posexplode(paths).alias("n", "p"))
    targets = F.transform("p.value", lambda t: normalized_path(F.concat("base", F.lit("/"), t)))
    rows = rows.filter(F.size("p.value") > 0).select(repo, F.struct("at", "n").alias("at"), F.col("p.key").alias("pattern"), targets.alias("targets"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(repo).orderBy("at"))).drop("at")


def wildcard(pattern: Column, specifier: Column) -> Column:
    """What stands for * in a specifier; '' for a pattern without it; null if they don't match."""
    at = F.instr(pattern, F.lit("*"))
    before, after = F.substring_index(pattern, "*", 1), F.substr(pattern, at + 1)
    length = F.greatest(F.length(specifier) - F.length(before) - F.length(after), F.lit(0))
    matched = specifier.startswith(before) & specifier.endswith(after)
    return F.when(at == 0, F.when(pattern == specifier, "")).when(matched, F.substr(specifier, F.length(before) + 1, length))


def resolved_imports(imports: DataFrame, files: DataFrame, aliases: DataFrame, repo: str = "repo") -> DataFrame:
    """repo, importer, specifier, path: the file that each import means; without one there is no row.

    A relative specifier goes from the importer's folder; another tries the aliases, the last loaded
    first, and each one's targets in order. Every base tries ENDINGS. imports: repo, importer,
    specifier; files: repo, path; aliases: repo, ord, pattern, targets. Only aliases of a specifier's
    own repository meet it, and only files that exist stay.
    """
    key = [repo, "importer", "specifier"]
    once = imports.select(*key).distinct()
    own = normalized_path(F.concat(directory(F.col("importer")), F.lit("/"), F.col("specifier")))
    relative = once.filter(F.col("specifier").startswith(".")).select(*key, F.lit(0).alias("alias"), F.lit(0).alias("target"), own.alias("base"))
    value = wildcard(F.col("pattern"), F.col("specifier"))
    met = once.filter(~F.col("specifier").startswith(".")).join(aliases, repo).withColumn("value", value).filter("value is not null")
    put = F.transform("targets", lambda t: F.when(F.contains(t, F.lit("*")), F.concat(F.substring_index(t, "*", 1), F.col("value"), F.substr(t, F.instr(t, F.lit("*")) + 1))).otherwise(t))
    aliased = met.select(*key, (-F.col("ord")).alias("alias"), F.posexplode(put).alias("target", "base"))
    tried = relative.unionByName(aliased).select(*key, "alias", "target", "base", F.posexplode(F.array(*[F.lit(e) for e in ENDINGS])).alias("ending", "end"))
    candidates = tried.withColumn("path", normalized_path(F.concat("base", "end"))).join(files.select(repo, "path").distinct(), [repo, "path"], "left_semi")
    return candidates.groupBy(*key).agg(F.min_by("path", F.struct("alias", "target", "ending")).alias("path"))


def barrel_exports(exports: DataFrame, reexports: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """module, exported, target, symbol, export_path: what modules pass on of the known ones.

    exports: module, name of the known modules; reexports: module, source, form (named, namespace or
    star), name, exported. Named ones find one name, default too, and may rename it; a namespace
    gives all names below its own; a star passes all but default. A known module's own exports end a
    chain; others pass on what they got, through max_depth + 1 modules, none of them twice. This goes
    from the exports up, a join a step, each step written before the next.
    """
    known = exports.select("module").distinct()
    links = reexports.select("module", "source", "form", F.col("name").alias("wanted"), F.col("exported").alias("given"))
    step = exports.select(
        F.col("module").alias("source"), F.col("module").alias("target"), F.col("name").alias("symbol"), F.col("name").alias("exported"), F.array("name").alias("export_path"), F.expr(_NO_NAMES).alias("chain")
    )
    found = None
    is_named, is_namespace = F.col("form") == "named", F.col("form") == "namespace"
    exported = F.when(is_named | is_namespace, F.col("given")).otherwise(F.col("exported"))
    path = (
        F.when(is_namespace, F.concat(F.array("given"), F.col("export_path")))
        .when(is_named, F.concat(F.array("given"), F.slice("export_path", 2, 1 << 20)))
        .otherwise(F.col("export_path"))
    )
    for _ in range(max_depth + 1):
        passed = (is_named & (F.col("wanted") == F.col("exported"))) | (~is_named & (F.col("exported") != "default"))
        made = (
            step.join(links, "source")
            .filter(passed & ~F.array_contains("chain", F.col("module")))
            .select("module", "target", "symbol", exported.alias("exported"), path.alias("export_path"), F.concat("chain", F.array("module")).alias("chain"))
        )
        made = cut(made.distinct())
        found = made if found is None else found.unionByName(made)
        step = made.join(known, "module", "left_anti").withColumnRenamed("module", "source")
    return found.groupBy("module", "target", "symbol", "export_path").agg(F.min("exported").alias("exported"))


def access_base(local: Column, export_path: Column, skip_root: bool = False) -> Column:
    """What stands before a name that is reached through a namespace."""
    from_ = 2 if skip_root else 1
    inner = F.slice(export_path, F.lit(from_), F.greatest(F.size(export_path) - from_, F.lit(0)))
    return F.when(F.size(inner) > 0, F.concat(local, F.lit("."), F.array_join(inner, "."))).otherwise(local)


def barrel_bindings(imports: DataFrame, barrels: DataFrame, key: str = "path") -> DataFrame:
    """key, local, target, symbol, base: what imports of barrels mean in the known modules.

    imports: key, symbol_wanted (null for a whole module), local, module. A name that a barrel gives directly
    is the local name itself; names of a namespace stand behind it.
    """
    joined = imports.join(barrels, "module").filter(F.col("symbol_wanted").isNull() | (F.col("symbol_wanted") == F.col("exported")))
    base = F.when(F.col("symbol_wanted").isNull(), access_base(F.col("local"), F.col("export_path"))).otherwise(access_base(F.col("local"), F.col("export_path"), skip_root=True))
    return joined.select(key, "local", "target", "symbol", base.alias("base"))


def namespace_members(expressions: DataFrame, bindings: DataFrame, key: str = "path") -> DataFrame:
    """key, expression, module, symbol: members of namespaces, by the binding that came last.

    expressions: key, expression; bindings: key, local, module, namespace, member, ord.
    """
    base, member = F.regexp_extract("expression", r"^(.*)\.([^.]+)$", 1), F.regexp_extract("expression", r"^(.*)\.([^.]+)$", 2)
    asked = expressions.select(key, "expression").distinct().withColumns({"local": base, "symbol": member}).filter("local <> ''")
    whole = bindings.filter("namespace and member is null").groupBy(key, "local").agg(F.max_by("module", "ord").alias("module"))
    return asked.join(whole, [key, "local"]).select(key, "expression", "module", "symbol")


BINDING = "local string, symbol string, module string, namespace boolean, member string, line long, ord long"
BINDING_TYPES = {"local": pa.string(), "symbol": pa.string(), "module": pa.string(), "namespace": pa.bool_(), "member": pa.string(), "line": pa.int64(), "ord": pa.int64()}
COLUMNS = ["local", "symbol", "module", "namespace", "member", "line"]


def _meant(expression: str, known: list[tuple], by_name: dict[str, int], wholes: dict[str, int]) -> tuple[str, str | None] | None:
    """Module and symbol that an expression means: by the binding that came last among those it names, else as a
    member of the namespace that came last. known: local, symbol, module, namespace, member."""
    at = by_name.get(expression)
    if at is not None:
        return known[at][2], known[at][1]
    base, dot, member = expression.rpartition(".")
    at = wholes.get(base) if dot else None
    return None if at is None else (known[at][2], member)


def aliases_in_order(bindings: list[tuple], assignments: list[tuple], rounds: int = ALIAS_ROUNDS) -> list[tuple]:
    """Bindings (local, symbol, module, namespace, member, line) and those that assignments (name, member, expression, line)
    add, one after the other, so that an alias of an alias is found where it follows. Rounds end when one adds none.

    A dictionary keeps the last binding that each expression names, so a file of any number of both is read once a round.
    """
    known: list[tuple] = []
    by_name: dict[str, int] = {}
    wholes: dict[str, int] = {}
    seen = set()

    def put(binding: tuple) -> bool:
        local, symbol, module, namespace, member, line = binding
        key = (module, symbol, local, namespace, member, line)
        if key in seen:
            return False
        seen.add(key)
        known.append(binding)
        # a whole namespace is named by its default member alone
        by_name[f"{local}.{member or symbol or 'default'}" if namespace else local] = len(known) - 1
        if namespace and member is None:
            wholes[local] = len(known) - 1
        return True

    for binding in bindings:
        put(binding)
    for _ in range(rounds):
        added = False
        for name, member, expression, line in assignments:
            found = _meant(expression, known, by_name, wholes)
            if found:
                added |= put((name, found[1], found[0], member is not None, member, line))
        if not added:
            break
    return known


def binding_aliases(bindings: DataFrame, assignments: DataFrame, key: str = "path", rounds: int = ALIAS_ROUNDS) -> DataFrame:
    """``bindings`` and the local names that a file's assignments give to them, in the order of its statements, in two rounds.

    bindings: key, local, symbol, module, namespace, member, line, ord; assignments: key, name, member
    (of an object literal, or null), expression, line, ord. One fold a file, whose rows are listed in one; files spread over
    tasks and reach Python by batches, so that small files cost no call each.
    """
    given = bindings.select(key, *COLUMNS, "ord", F.lit(None).cast("string").alias("expression"))
    named = assignments.select(
        key, F.col("name").alias("local"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("module"), F.lit(None).cast("boolean").alias("namespace"), "member", "line", "ord", "expression"
    )
    kind = bindings.schema[key].dataType.simpleString()
    listed = given.unionByName(named).groupBy(key).agg(F.collect_list(F.struct(*COLUMNS, "ord", "expression")).alias("rows"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows = list(zip(*[c.to_pylist() for c in lists.flatten().flatten()], strict=True))
            at, made = [], []
            for i, (n, size) in enumerate(zip(_starts(lists), pc.list_value_length(lists).to_pylist(), strict=True)):
                own = sorted(rows[n : n + size], key=lambda r: (r[6] is None, r[6] or 0))
                found = aliases_in_order([r[:6] for r in own if r[7] is None], [(r[0], r[4], r[7], r[5]) for r in own if r[7] is not None], rounds)
                at += [i] * len(found)
                made += [(*b, n) for n, b in enumerate(found)]
            values = zip(*made, strict=True) if made else [[]] * len(BINDING_TYPES)
            columns = [pa.array(list(v), t) for v, t in zip(values, BINDING_TYPES.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *columns], [key, *BINDING_TYPES])

    return listed.mapInArrow(follow, f"{key} {kind}, {BINDING}")


def _starts(lists: pa.ListArray) -> list[int]:
    """Where each list starts among the values of all."""
    return [0, *accumulate(pc.list_value_length(lists).to_pylist())][: len(lists)]
