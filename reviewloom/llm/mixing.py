"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import balanced_buckets, checkpointed, unlike

EPOCHS = 3
BLOCK_TOKENS = 16
N_SHARDS = 40
#: Bits of a draw, which orders a source's documents.
DRAW_BITS = 60


def token_count(column: str = "text") -> Column:
    """Number of runs of characters other than space, tab, LF, VT, FF and CR; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """source, source_size, weight, target for the sizes of ``sizes`` (source, size).

    Sources in code point order, null last, get ``weights`` in turn and share all tokens by
    weight. No target exceeds EPOCHS times its source; what is above is shared anew by
    weight. That water level is found in closed form: sources fill up in the order of
    capacity by weight, so a running sum over that order tells which are full.
    One row a source throughout; sources are a dimension, not a fact.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = per_source.withColumn("weight", F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)))
    capacity = F.col("source_size").cast("double") * EPOCHS
    fill = Window.orderBy(F.col("fill_level"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    levels = (
        weighted.withColumn("fill_level", capacity / F.col("weight"))
        .withColumn("all_tokens", F.sum("source_size").over(whole).cast("double"))
        .withColumn("full_before", F.coalesce(F.sum(capacity).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        # the level if all before this one are full and this and all after are not
        .withColumn("level_here", (F.col("all_tokens") - F.col("full_before")) / F.col("weight_left"))
        .withColumn("open", F.col("level_here") <= F.col("fill_level"))
        .withColumn("place", F.row_number().over(fill))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct("place", "level_here"))).over(whole)["level_here"])
    )
    return levels.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") > capacity), capacity)
        .otherwise(F.col("level") * F.col("weight"))
        .alias("target"),
    )


def shard_quotas(targets: DataFrame, block_tokens: int = BLOCK_TOKENS, n_shards: int = N_SHARDS) -> DataFrame:
    """``targets`` with ``blocks`` (a source's own equal-token blocks) and ``upto``, an array: how
    many blocks of it the first 1 ... ``n_shards`` shards have together.

    All tokens make round(all / block_tokens) seats, dealt to the shards evenly; each goes to the
    highest of the quotients target / (2k + 1). As Sainte-Laguë never takes a seat back when
    another is added, the seats of the first j shards are those of the first j - 1 and some more,
    which are shard j's quota. With s sources the divisor that gives h seats is within s / 2h of
    all / h, so a source's seats are known but for a few: those below are certain, those above
    impossible, and the rest, two a source on the average and two more, are ranked, each shard's
    count for itself. Ties go to the source first by code point, null last. No source has more
    than EPOCHS times its blocks.
    """
    whole = Window.partitionBy()
    seats = (
        targets.withColumn("blocks", F.ceil(F.col("source_size") / block_tokens).cast("long"))
        .withColumn("all_target", F.sum("target").over(whole))
        .withColumn("seats", F.round(F.col("all_target") / block_tokens).cast("long"))
        .withColumn("n", F.sum(F.when(F.col("target") > 0, 1).otherwise(0)).over(whole))
    )
    counted = (
        seats.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(n_shards))))
        .withColumn("h", F.expr(f"(seats * shard + {n_shards} div 2) div {n_shards}"))
        .withColumn("fair", F.when(F.col("h") > 0, F.col("target") * F.col("h") / F.col("all_target")).otherwise(0.0))
        .withColumn("spread", F.when(F.col("h") > 0, F.col("n") / (2 * F.col("h"))).otherwise(0.0))
        .withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("fair") * (1 - F.col("spread"))) - 1).cast("long"))
        .withColumn("most", (F.floor(F.col("fair") * (1 + F.col("spread"))) + 2).cast("long"))
        .withColumn("left", F.col("h") - F.sum("sure").over(Window.partitionBy("shard")))
    )
    by_quotient = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").asc_nulls_last(), "k")
    same = ["source", "source_size", "weight", "target", "blocks"]
    return (
        counted.withColumn("k", F.explode_outer(F.when(F.col("fair") > 0, F.sequence("sure", "most"))))
        .withColumn("place", F.row_number().over(by_quotient))
        .groupBy(*same, "shard")
        .agg((F.min("sure") + F.count_if(F.col("k").isNotNull() & (F.col("place") <= F.col("left")))).alias("seats"))
        .groupBy(*same)
        .agg(F.array_sort(F.collect_list(F.struct("shard", F.least("seats", F.col("blocks") * EPOCHS).alias("seats")))).alias("won"))
        .select(*same, F.col("won.seats").alias("upto"))
    )


def _draw(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number of DRAW_BITS bits from the seed, the id and the text."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")


def shard_runs(quotas: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 42) -> DataFrame:
    """``quotas`` with ``runs``: what each shard draws of a source's line of tokens, as arrays of
    (shard, low, high).

    Shards draw their quotas one after the other. While a round takes all blocks, each goes on
    where the one before it ended. The last round takes ``rest`` of ``blocks``; there every shard
    leaves out a seeded part of the blocks that are not needed before its run begins. So each
    block is drawn once a round at most, and each shard has as many blocks as its quota says.
    """
    u = f"cast(conv(substring(md5(cast(concat('{seed}:', coalesce(source, ''), ':', j) as binary)), 1, 4), 16, 10) as bigint)"
    gap = f"((blocks - quota % blocks) * (j * 65536L + {u})) div (n * 65536L)"
    low, high = "greatest(if(j = 0, 0L, upto[j - 1]), round * blocks)", "least(upto[j], (round + 1) * blocks)"
    shift = f"(if((round + 1) * blocks <= quota, 0L, {gap}) - round * blocks)"
    run = f"named_struct('shard', j, 'low', ({low} + {shift}) * {block_tokens}L, 'high', ({high} + {shift}) * {block_tokens}L)"
    runs = f"filter(flatten(transform(sequence(0, n - 1), j -> transform(sequence(0, {EPOCHS - 1}), round -> {run}))), r -> r.low < r.high)"
    rows = quotas.withColumn("n", F.size("upto")).withColumn("quota", F.element_at("upto", -1))
    none = F.expr("cast(array() as array<struct<shard:int,low:bigint,high:bigint>>)")
    return rows.withColumn("runs", F.when(F.col("blocks") > 0, F.expr(runs)).otherwise(none)).drop("n", "quota")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), block_tokens: int = BLOCK_TOKENS, seed: int = 42, n_shards: int = N_SHARDS) -> DataFrame:
    """Words that the mix takes of each document, and the shards that take them.

    A source's documents, in the order of seeded draws, make a line of tokens that is cut into
    equal-token blocks, of which each shard draws its quota (see shard_runs). As the line's order
    is drawn by the seed, a run is a seeded selection of documents, and only the two at its ends
    are cut.

    Positions on the line are prefix sums in two levels, over ranges of draws and in each, so
    that neither a hot source nor the whole meets in one task.

    Null and blank texts have size 0 and give 0; null is a source like others, last in order;
    long texts are counted whole; repeated rows lie on the line one by one; rows of equal draws
    are ordered by doc_id and size; an empty table gives no rows; other columns of ``docs`` are
    ignored. Reruns agree, as only ids, texts and the seed decide.
    """
    rows = checkpointed(
        docs.select(
            "doc_id",
            "source",
            token_count().alias("size"),
            _draw(seed).alias("draw"),
        )
    )
    width = (1 << DRAW_BITS) // balanced_buckets(rows.count()) + 1
    rows = rows.withColumn("bucket", F.expr(f"draw div {width}L"))
    quotas = shard_quotas(source_targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights), block_tokens, n_shards)
    plan = shard_runs(quotas, block_tokens, seed).select(F.col("source").alias("line_source"), "source_size", "target", "runs")
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    over_buckets = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lines = totals.select(
        F.col("source").alias("part_source"),
        F.col("bucket").alias("part_bucket"),
        F.coalesce(F.sum("bucket_size").over(over_buckets), F.lit(0)).alias("bucket_start"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    shared = "greatest(0L, least(line_to, r.high) - greatest(line_from, r.low))"
    return (
        rows.withColumn("upto_row", F.sum("size").over(inside))
        .join(lines, F.col("source").eqNullSafe(F.col("part_source")) & (F.col("bucket") == F.col("part_bucket")))
        .join(plan, F.col("source").eqNullSafe(F.col("line_source")))
        .withColumn("line_to", F.col("bucket_start") + F.col("upto_row"))
        .withColumn("line_from", F.col("line_to") - F.col("size"))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            F.expr(f"aggregate(runs, 0L, (a, r) -> a + {shared})").alias("taken"),
            "source",
            F.expr(f"array_join(array_sort(array_distinct(transform(filter(runs, r -> {shared} > 0), r -> r.shard))), ',')").alias("shards"),
            "draw",
        )
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), block_tokens: int = BLOCK_TOKENS, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, with all columns, as often as the mix takes them: none to EPOCHS
    times, the taken words by the size, rounded. A document without words is not taken.

    Rows that repeat a document (id and text) share what it is taken. Columns of any name are
    kept, as those added here are named unlike them.
    """
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    row, doc, draw, own_draw, total, n, at = unlike(docs, "row", "mix_doc", "mix_draw", "own_draw", "copies", "rows", "place")
    plan = (
        mix_sources(docs.select("doc_id", "source", "text"), weights, block_tokens, seed)
        .groupBy(F.col("doc_id").alias(doc), F.col("draw").alias(draw))
        .agg(F.sum(copies).alias(total), F.count("*").alias(n))
        .filter(F.col(total) > 0)
    )
    # the user's columns travel as one struct
    whole = docs.select(F.struct("*").alias(row), _draw(seed).alias(own_draw))
    same = F.col(f"{row}.doc_id").eqNullSafe(F.col(doc)) & (F.col(own_draw) == F.col(draw))
    alike = Window.partitionBy(doc, draw).orderBy(doc)
    return (
        whole.join(plan, same)
        .withColumn(at, F.row_number().over(alike))
        .withColumn(at, F.expr(f"{total} div {n} + if({at} <= {total} % {n}, 1, 0)"))
        .filter(F.col(at) > 0)
        .select(row, F.explode(F.sequence(F.lit(1), F.col(at))))
        .select(f"{row}.*")
    )
