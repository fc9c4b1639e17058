"""Exports, imports and calls of TypeScript and JavaScript sources, from the marks of one pass over each.

``scanner`` reads a source token by token; a source is one row, its marks are rows of a table, and all
else is joins and aggregates over that table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewloom.functions import scanner

#: Files of a batch whose rows are held together.
FILES_AT_ONCE = 64
CONTRACT_KINDS = ("function", "class", "type", "value")


def _scanned(files: DataFrame, key: str, scan: Callable[[str], Iterator[tuple]], fields: str) -> DataFrame:
    """key and the rows that ``scan`` finds in each file, which reach Python and come back by batches of columns."""
    types = dict(f.split() for f in fields.split(", "))
    schema = pa.schema([(name, pa.string() if t == "string" else pa.bool_() if t == "boolean" else pa.int32()) for name, t in types.items()])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, FILES_AT_ONCE):
                part = batch.slice(first, FILES_AT_ONCE)
                at, made = [], []
                for i, content in enumerate(part.column(1).to_pylist()):
                    found = list(scan(content))
                    at += [i] * len(found)
                    made += found
                values = zip(*made, strict=True) if made else [[]] * len(schema)
                columns = [pa.array(list(v), f.type) for v, f in zip(values, schema, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), *columns], [key, *schema.names])

    given = files.select(key, "content")
    return given.mapInArrow(read, StructType([given.schema[key], *StructType.fromDDL(fields).fields]))


def assignments_of(marks: DataFrame, key: str = "path") -> DataFrame:
    """key, name, member, expression, line, ord of paths that are given names: by declarations of the top level and the
    members of objects there, in order, then by assignments anywhere."""
    late = F.when(F.col("kind") == "assignment", F.lit(1 << 32)).otherwise(F.lit(0))
    return marks.filter("mark = 'assign'").select(key, "name", F.col("local").alias("member"), F.col("module").alias("expression"), F.col("line").cast("long").alias("line"), (late + F.col("start")).alias("ord"))


def source_marks(files: DataFrame, key: str = "path") -> DataFrame:
    """key and the marks (see ``scanner.MARKS``) of each file. files: key, content.

    Files with null or empty content, or nothing but remarks, have none."""
    return _scanned(files, key, scanner.marks, scanner.MARKS)


def source_tokens(files: DataFrame, key: str = "path") -> DataFrame:
    """key, at, kind, text, line, depth, start, end of each token, remarks too."""
    return _scanned(files, key, scanner.tokens, scanner.TOKENS)


def contracts_of(marks: DataFrame, key: str = "path") -> DataFrame:
    """key, name, kind, line, required, total, rest, signature of what a file's top level exports.

    Default exports are named default; counts are null but for functions. Of declarations under one name a
    type counts more than a class, a variable and a function, and the last more than those before. A list of names in
    braces exports what the file declares under them; names it doesn't declare, as imported ones, make no contract.
    """
    top = marks.filter((F.col("depth") == 0) & F.col("kind").isin(*CONTRACT_KINDS))
    own = F.struct("kind", "line", "required", "total", F.coalesce("rest", F.lit(False)).alias("rest"), F.col("local").alias("shown"))
    rank = F.array_position(F.lit(["function", "value", "class", "type"]), F.col("kind"))
    declared = top.filter("mark = 'declaration'").groupBy(key, "name").agg(F.min_by(own, "start").alias("x"))
    listed = aliases_of(marks, key).select(key, "name", "exported").join(declared, [key, "name"])
    found = top.filter("mark = 'export'").select(key, "name", F.struct(F.lit(0).alias("listed"), rank.alias("rank"), "start").alias("at"), own.alias("x"))
    found = found.unionByName(listed.select(key, F.col("exported").alias("name"), F.struct(F.lit(1).alias("listed"), F.lit(0).cast("bigint").alias("rank"), F.lit(0).alias("start")).alias("at"), "x"))
    best = found.groupBy(key, "name").agg(F.max_by("x", "at").alias("x")).select(key, "name", "x.*")
    signature = (
        F.when(F.col("kind") == "function", F.concat("name", "shown"))
        .when(F.col("kind") == "class", F.coalesce(F.concat(F.lit("class "), "shown"), F.lit("default class")))
        .otherwise(F.col("shown"))
    )
    return best.withColumn("signature", signature).drop("shown")


def aliases_of(marks: DataFrame, key: str = "path") -> DataFrame:
    """key, name, exported, line of what a list of names in braces exports from the file itself."""
    return marks.filter("mark = 'export' and kind = 'alias'").select(key, "name", F.col("local").alias("exported"), "line")


def imports_of(marks: DataFrame, key: str = "path") -> DataFrame:
    """key, symbol, local, module, line, kind of each import; a namespace's symbol is null."""
    return marks.filter("mark = 'import'").select(key, F.col("name").alias("symbol"), "local", "module", "line", "kind")


def reexports_of(marks: DataFrame, key: str = "path") -> DataFrame:
    """key, symbol, local, module, line, kind of each re-export; a star's symbol is *."""
    return marks.filter("mark = 'reexport'").select(key, F.col("name").alias("symbol"), "local", "module", "line", "kind")


def sites_of(marks: DataFrame, key: str = "path") -> DataFrame:
    """key, line, callee, is_new, argc of each call or construction by a path of names; ``a['b'](x)`` is one of a.b."""
    return marks.filter("mark = 'site'").select(key, "line", F.col("name").alias("callee"), (F.col("kind") == "new").alias("is_new"), F.col("total").alias("argc"))


def export_contracts(files: DataFrame, key: str = "path") -> DataFrame:
    return contracts_of(source_marks(files, key), key).drop("signature")


def import_bindings(files: DataFrame, key: str = "path") -> DataFrame:
    return imports_of(source_marks(files, key), key)


def reexports(files: DataFrame, key: str = "path") -> DataFrame:
    return reexports_of(source_marks(files, key), key)


def call_sites(files: DataFrame, key: str = "path") -> DataFrame:
    return sites_of(source_marks(files, key), key)


def resolved_modules(importer: Column, specifier: Column) -> Column:
    """A relative specifier as a path from the repository's root, dots resolved by a fold; null
    for packages."""
    parts = F.concat(F.slice(F.split(importer, "/"), F.lit(1), F.size(F.split(importer, "/")) - 1), F.split(specifier, "/"))
    start = F.expr("cast(array() as array<string>)")

    def step(path: Column, part: Column) -> Column:
        up = F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
        return F.when((part == ".") | (part == ""), path).when(part == "..", up).otherwise(F.concat(path, F.array(part)))

    return F.when(specifier.startswith("."), F.array_join(F.aggregate(parts, start, step), "/"))


def usages(imports: DataFrame, calls: DataFrame, key: str = "path") -> DataFrame:
    """Calls of imported names: of a local name itself, or of a member of a namespace.

    imports: key, symbol, local, module; calls: key, line, callee, is_new, argc.
    """
    head, member = F.substring_index("callee", ".", 1), F.when(F.contains("callee", F.lit(".")), F.substring_index("callee", ".", -1))
    sites = calls.select(F.col(key), "line", head.alias("local"), member.alias("member"), "is_new", "argc")
    bound = imports.select(key, "symbol", "local", "module")
    joined = bound.join(sites, [key, "local"])
    plain = joined.filter("symbol is not null and member is null")
    through = joined.filter("symbol is null and member is not null").withColumn("symbol", F.col("member"))
    return plain.unionByName(through).drop("member")
