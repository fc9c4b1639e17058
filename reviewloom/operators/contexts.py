"""What a model is shown beside a change: definitions, slices and removed scopes, within the limits of its file's kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.scopes import symbol_type, symbols_by_name, with_texts

#: Kinds of context, and the column of a profile that limits each.
LIMITS = (("function", "functions"), ("type", "types"), ("slice", "slices"), ("deleted", "deleted_scopes"))
ITEM = ("kind", "name", "file", "content", "part", "ord")


def context_kind(kind: Column) -> Column:
    """Of a scope: whether its definition counts as a function or as a type; classes are functions."""
    return F.when(symbol_type(kind) == "interface", "type").otherwise("function")


def within_limits(items: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """``items`` that are kept, with their place: each once, in the order of their sources, until their kind's limit.

    One running count over all sources of a key; a definition is one with others of its name and file, a slice with
    others of its label, file and text, a removed scope only with itself. items: key and ITEM.
    """
    same = F.when(F.col("kind") == "slice", F.col("content")).when(F.col("kind") == "deleted", F.col("ord").cast("string"))
    again = Window.partitionBy(key, "kind", "name", "file", same).orderBy("part", "ord")
    once = items.withColumn("again", F.row_number().over(again)).filter("again = 1").drop("again")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(key, "kind").orderBy("part", "ord")))
    cap = F.coalesce(*[F.when(F.col("kind") == kind, F.col(column)) for kind, column in LIMITS])
    limits = profiles.select(key, *[c for _, c in LIMITS])
    return placed.join(limits, key).filter(F.col("place") <= cap).drop(*[c for _, c in LIMITS])


def _items(rows: DataFrame, key: str, part: int, kind: Column, name: str, file: Column, order: str) -> DataFrame:
    return rows.select(key, kind.alias("kind"), F.col(name).alias("name"), file.alias("file"), "content", F.lit(part).alias("part"), F.col(order).cast("long").alias("ord"))


def remote_definitions(missing: DataFrame, hits: DataFrame, definitions: DataFrame, key: str) -> DataFrame:
    """``missing`` with the first file besides its own that search finds for its name and that defines it.

    missing: key, own_path, name, results (how many hits count); hits: name, path, n; definitions: path, name, type, text.
    Only as many hits of a name as any key asks for, and one for its own file, meet the keys; of a definition that many
    ask for nothing is copied before the join by its place.
    """
    most = missing.groupBy("name").agg(F.max("results").alias("most"))
    near = hits.withColumn("at", F.row_number().over(Window.partitionBy("name").orderBy("n", "path"))).join(most, "name").filter(F.col("at") <= F.col("most") + 1).drop("most")
    known = near.join(definitions.select("name", "path").distinct().withColumn("defines", F.lit(True)), ["name", "path"], "left").withColumn("defines", F.coalesce("defines", F.lit(False)))
    listed = known.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "path", "defines"))).alias("found"))
    others = F.filter("found", lambda x: x["path"] != F.col("own_path"))
    first = F.filter(F.slice(others, F.lit(1), F.col("results")), lambda x: x["defines"])
    met = missing.filter("results > 0").join(listed, "name").withColumn("path", F.get(first, F.lit(0))["path"]).filter("path is not null").drop("found")
    return met.join(definitions, ["name", "path"])


def segment_context(
    profiles: DataFrame, files: DataFrame, structured: DataFrame, chosen: DataFrame, slices: DataFrame, candidates: DataFrame, scopes: DataFrame, hits: DataFrame, definitions: DataFrame, removed: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """key, kind, place, name, file, content: the context of each segment, from six sources in turn.

    Slices of its structured file; definitions that the change touches; slices of its scopes; other definitions of the
    file that candidates name; definitions elsewhere of candidates that are still missing, as many as the profile
    looks up; removed scopes, unless the file is new. A kind that allows no code has no limits above zero.

    profiles: key, path, status, code_context, remote_search, LIMITS' columns, remote_lookups, results_per_lookup;
    files: key, content; structured: key, label, content, file, ord; chosen: scopes with their place n; slices: key, place, label, content;
    candidates: key, name, rank; scopes: all of the files; hits: name, path, n; definitions: path, name, type, text;
    removed: key, scope's n, reason, text.
    """
    code = profiles.filter("code_context")
    own = profiles.select(key, F.col("path").alias("own_path"))
    texts = lambda rows: with_texts(rows, files, key).withColumnRenamed("text", "content").join(own, key)
    first = chosen.filter("name is not null").withColumn("again", F.row_number().over(Window.partitionBy(key, "name").orderBy("n"))).filter("again = 1")
    found = symbols_by_name(scopes, candidates.select(key, "name", "rank"), key)
    parts = [
        _items(structured, key, 1, F.lit("slice"), "label", F.col("file"), "ord"),
        _items(texts(first), key, 2, context_kind(F.col("kind")), "name", F.lit("current"), "n"),
        _items(slices.join(own, key), key, 3, F.lit("slice"), "label", F.col("own_path"), "place"),
        _items(texts(found), key, 4, context_kind(F.col("kind")), "name", F.lit("current"), "rank"),
    ]
    near = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).join(code.select(key), key, "left_semi")
    resolved = within_limits(near.filter("kind in ('function', 'type')"), profiles, key).select(key, "name").distinct()
    asked = candidates.join(resolved, [key, "name"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("rank")))
    asked = asked.join(code.filter("remote_search").select(key, F.col("path").alias("own_path"), "remote_lookups", F.col("results_per_lookup").alias("results")), key).filter(F.col("n") <= F.col("remote_lookups"))
    remote = remote_definitions(asked.select(key, "own_path", "name", "n", "results"), hits, definitions, key)
    remote = remote.withColumn("content", F.col("text"))
    far = _items(remote, key, 5, F.when(F.col("type") == "interface", "type").otherwise("function"), "name", F.col("path"), "n")
    gone = removed.withColumn("content", F.col("text")).join(code.filter("status <> 'added'").select(key, F.col("path").alias("own_path")), key)
    gone = _items(gone, key, 6, F.lit("deleted"), "reason", F.col("own_path"), "n")
    return within_limits(near.unionByName(far).unionByName(gone), profiles, key).select(key, "kind", "place", "name", "file", "content")
