"""Groups of changed files that belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.lineage import cut

MAX_SHARED = 6


def path_tokens(path: Column) -> Column:
    """Distinct lower-cased words of three letters or more of a path, endings left out."""
    parts = F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: F.split(F.regexp_replace(s, r"[.][^.]+$", ""), "[-_.]"))
    return F.array_distinct(F.transform(F.filter(F.flatten(parts), lambda x: F.length(x) >= 3), F.lower))


def directory(path: Column) -> Column:
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(found == "", ".").otherwise(found)


def file_classes(files: DataFrame, by: str = "cr_id", key: str = "doc_id") -> DataFrame:
    """by, paths, symbols, dir, members: a request's files that can't be told apart by what relates them.

    Words that one file of a request has alone, and folders that are near none of another's, relate nothing and are left
    out first, so that numbered files fall into few classes. files: by, key, path, path_tokens, symbols, keys distinct.
    """
    tokens = F.concat(*[F.transform(F.coalesce(F.array_distinct(c), F.expr("cast(array() as array<string>)")), lambda x: F.struct(F.lit(of).alias("of"), x.alias("token"))) for c, of in (("path_tokens", "path"), ("symbols", "symbol"))])
    known = files.filter(F.col(by).isNotNull() & F.col(key).isNotNull()).select(by, key, directory(F.col("path")).alias("dir"), tokens.alias("all"))
    words = known.select(by, key, F.explode("all").alias("x")).filter("x.token is not null")
    shared = words.join(words.groupBy(by, "x").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), [by, "x"], "left_semi")
    listed = shared.groupBy(by, key).agg(*[F.array_sort(F.collect_list(F.when(F.col("x.of") == of, F.col("x.token")))).alias(c) for c, of in (("paths", "path"), ("symbols", "symbol"))])
    # a folder counts for its own files and for those of the one above
    both = F.array_distinct(F.array("dir", directory(F.col("dir"))))
    dirs = known.groupBy(by, "dir").agg(F.count("*").alias("n")).select(by, "dir", "n", F.explode(both).alias("meet"))
    own = F.sum(F.when(F.col("dir") == F.col("meet"), F.col("n")).otherwise(0)).over(Window.partitionBy(by, "meet"))
    children = F.sum(F.when(F.col("dir") != F.col("meet"), F.col("n")).otherwise(0)).over(Window.partitionBy(by, "meet"))
    is_own = F.col("dir") == F.col("meet")
    near = dirs.withColumns({"own": own, "children": children}).filter((is_own & (F.col("own") + F.col("children") > 1)) | (~is_own & (F.col("own") > 0))).select(by, "dir").distinct()
    placed = known.select(by, key, "dir").join(near.withColumn("near", F.col("dir")), [by, "dir"], "left").select(by, key, F.col("near").alias("dir"))
    return listed.join(placed, [by, key]).groupBy(by, "paths", "symbols", "dir").agg(F.array_sort(F.collect_list(key)).alias("members"))


def related_pairs(files: DataFrame, by: str = "cr_id", key: str = "doc_id") -> DataFrame:
    """Pairs of a request's files that share two path words, two symbols, or one near each other.

    files: by, key, path, path_tokens, symbols. Classes of files meet by an inverted index of words within a request, so
    those that share nothing never do; two that share several are taken at the first that both have. Their members pair off in that row:
    what is shuffled grows with the files, not with the pairs.
    """
    classes = file_classes(files, by, key)
    words = F.concat(*[F.transform(c, lambda x: F.concat(F.lit(of), x)) for c, of in (("paths", "p:"), ("symbols", "s:"))])
    laid = classes.withColumns({"first": F.element_at("members", 1), "words": words}).select("*", F.posexplode("words").alias("at", "word")).withColumn("before", F.slice("words", 1, F.col("at"))).drop("words", "at")
    other = laid.select(by, "word", *[F.col(c).alias(f"{c}_b") for c in ("paths", "symbols", "dir", "members", "first", "before")])
    met = laid.join(other, [by, "word"]).filter((F.col("first") <= F.col("first_b")) & ~F.arrays_overlap("before", "before_b"))
    met = met.withColumns({"in_paths": F.array_intersect("paths", "paths_b"), "in_symbols": F.array_intersect("symbols", "symbols_b")})
    met = met.withColumns({"shared_paths": F.size("in_paths").cast("long"), "shared_symbols": F.size("in_symbols").cast("long")})
    near = F.coalesce((F.col("dir") == F.col("dir_b")) | (F.col("dir") == directory(F.col("dir_b"))) | (F.col("dir_b") == directory(F.col("dir"))), F.lit(False))
    kept = met.filter((F.col("shared_symbols") >= 2) | ((F.col("shared_symbols") >= 1) & near) | (F.col("shared_paths") >= 2))
    is_one = F.col("first") == F.col("first_b")
    paired = kept.select(by, "shared_paths", "shared_symbols", "members_b", is_one.alias("is_one"), F.explode("members").alias("x")).select("*", F.explode("members_b").alias("y")).filter(~F.col("is_one") | (F.col("x") < F.col("y")))
    return paired.select(by, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared_paths", "shared_symbols")


def related_links(files: DataFrame, by: str = "cr_id", key: str = "doc_id") -> DataFrame:
    """Links (a, b) that hold the same files together as ``related_pairs``, about as many as there are files.

    Files that share two path words, two symbols, or a symbol and the folder, are all related to each other, so each
    hangs on the least of them; files of a folder below hang on the least that has the symbol above. Members of a class
    hang on its own least.
    """
    classes = file_classes(files, by, key).withColumn("first", F.element_at("members", 1))
    two = lambda c: F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    kinds = lambda of, pairs: F.transform(pairs, lambda p: F.struct(F.lit(of).alias("of"), p["x"].alias("x"), p["y"].alias("y")))
    folder = lambda of, dir_: F.when(dir_.isNotNull(), F.transform("symbols", lambda s: F.struct(F.lit(of).alias("of"), s.alias("x"), dir_.alias("y"))))
    empty = F.expr("cast(array() as array<struct<of:string,x:string,y:string>>)")
    joint = F.concat(kinds("path", two(F.col("paths"))), kinds("symbol", two(F.col("symbols"))), F.coalesce(folder("folder", F.col("dir")), empty))
    hung = classes.select(by, "first", F.size("members").alias("n"), F.explode(joint).alias("at"))
    hubs = hung.groupBy(by, "at").agg(F.min("first").alias("hub"), F.sum("n").alias("n"))
    links = hung.drop("n").join(hubs.filter("n > 1").drop("n"), [by, "at"]).select("first", "hub")
    above = F.when(directory(F.col("dir")) != F.col("dir"), directory(F.col("dir")))
    below = classes.select(by, "first", F.explode(folder("folder", above)).alias("at"))
    links = links.unionByName(below.join(hubs.drop("n"), [by, "at"]).select("first", "hub")).distinct()
    linked = links.select("first").unionByName(links.select(F.col("hub").alias("first"))).distinct()
    members = classes.join(linked, "first").select(F.explode("members").alias("a"), F.col("first").alias("b"))
    return members.unionByName(links.select(F.col("first").alias("a"), F.col("hub").alias("b"))).filter("a <> b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node, label: the smallest node that each is linked with, over ``pairs`` (a, b).

    Links turn into stars, by turns: a large step hangs a node's larger neighbours on the smallest it knows, a small
    step its smaller ones. The smallest is found by a minimum, summed up in each task's share first, and joined to links by
    the node that knows it, so that no label of a large component gathers rows. Each round is written to the checkpoint
    folder; rounds are as many as the logarithm of the largest component, about.
    """
    links = cut(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a"), F.col("low").alias("b"))))).filter("a <> b")
        links = cut(small.distinct())
        told = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if told == known:
            break
        known = told
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())


def shared_items(sets: DataFrame, by: str, limit: int = MAX_SHARED) -> DataFrame:
    """The items that two sets of a group or more have, the most frequent first, ``limit`` at most.

    sets: by, item with one row for each set that has it.
    """
    counted = sets.groupBy(by, "item").agg(F.count("*").alias("n")).filter("n >= 2")
    order = Window.partitionBy(by).orderBy(F.col("n").desc(), "item")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
