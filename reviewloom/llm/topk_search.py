"""Exact top-k search by inner product with vector-approximation files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed

#: Vectors and queries whose cells are compared in one group.
VECTORS_PER_BLOCK, QUERIES_PER_BLOCK = 16_384, 1024
CELLS = 256
#: What larger components count as; doubles hold every whole number up to it.
LARGEST = float(2**53)
BOUNDED = "d int, query_row long, row long, low double, high double"


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, d, v: floor(scale * x) of each component, LARGEST in size at most, without vectors
    that take no part."""
    whole = F.col("embedding").isNotNull() & F.expr(
        "forall(embedding, x -> x is not null and not isnan(x) and abs(double(x)) < double('Infinity'))"
    )
    v = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x.cast("double") * scale))))
    return vectors.filter(whole & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), v.alias("v"), F.size("embedding").alias("d"))


def component_cells(rows: DataFrame) -> DataFrame:
    """d, low, width: of each number of components the smallest value and the width of a cell in
    each, so that CELLS cells hold all values. A row for each length of vectors."""
    lengths = rows.select("d").distinct()
    ends = (
        rows.select("d", F.posexplode("v").alias("at", "x"))
        .groupBy("d", "at")
        .agg(F.min("x").alias("low"), F.max("x").alias("top"))
        .groupBy("d")
        .agg(F.array_sort(F.collect_list(F.struct("at", "low", "top"))).alias("e"))
    )
    found = ends.select(F.col("d"), F.col("e.low").alias("low"), F.transform("e", lambda x: F.ceil((x["top"] - x["low"] + 1) / CELLS).cast("long")).alias("width"))
    none = F.expr("cast(array() as array<long>)")
    return lengths.join(found, "d", "left").select("d", F.coalesce("low", none).alias("low"), F.coalesce("width", none).alias("width"))


def _matrix(rows: pd.Series, kind: type) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=kind) for x in rows])


def block_bounds(rows: np.ndarray, cells: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, same_id: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """query_row, row, low and high of the vectors of a block that may be among a query's k best.

    A vector in a cell is its lower edge and less than a cell's width more in each component;
    so the product with the edges, and what the widths can add or take, bound a score. Those
    whose high is below the kth low of the block can't be among the k best. Both are rounded
    outwards by more than what floats lose. ``same_id`` marks pairs that don't count.
    """
    edges = low + cells.astype(np.float64) * width
    base = queries.astype(np.float64) @ edges.T
    above = (np.maximum(queries, 0) * (width - 1.0)).sum(axis=1)[:, None]
    below = (np.minimum(queries, 0) * (width - 1.0)).sum(axis=1)[:, None]
    slack = 1e-12 * max(1, len(low) / 1000) * ((np.abs(queries).astype(np.float64) @ np.abs(edges).max(axis=0))[:, None] + above - below)
    lows, highs = base + below - slack, base + above + slack
    lows[same_id], highs[same_id] = -np.inf, -np.inf
    kth = np.full(len(queries), -np.inf) if lows.shape[1] <= k else np.partition(lows, lows.shape[1] - k, axis=1)[:, lows.shape[1] - k]
    q, v = np.nonzero((highs >= kth[:, None]) & ~same_id)
    return query_rows[q], rows[v], lows[q, v], highs[q, v]


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """The k best inner products of every query with all other vectors, by whole numbers.

    ``is_query`` picks the queries among the rows (vec_id, embedding). Every vector has an
    approximation, a byte a component that names its cell. Only these and the queries are dealt
    to hash blocks of a set size, each pair of which is one group of one task and gives the
    bounds of the vectors that may be among a query's k best in the block. A query's kth low of
    all blocks then leaves few; the exact vectors of these alone are read, by a join, all of
    them, as each one's bound reaches the kth. A task's memory stays the same at any size, and only the number of pairs of blocks grows.

    Ties go to the smaller vec_id. Vectors that are null or hold null, NaN or an infinity take
    no part, nor rows without vec_id; vectors meet those of their own length only, empty ones too, whose products are
    0. A component
    beyond 2^53 after scaling counts as 2^53; scores are ranked as whole numbers of any size,
    and one beyond 64 bits is shown as the last that 64 bits hold. A query's own row is every
    row of its vec_id; repeated candidates count each, repeated queries once. Empty tables and
    lone vectors give no rows; other columns are ignored.
    """
    flagged = vectors.select("vec_id", "embedding", is_query.alias("asks"))
    rows = integer_vectors(flagged, scale)
    marked = integer_vectors(flagged.filter("asks"), scale).dropDuplicates(["vec_id", "v"])
    # written once, as numbers of rows must not change when a task is run again
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    asked = checkpointed(marked.withColumn("query_row", F.monotonically_increasing_id()))
    n, n_asked = rows.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // VECTORS_PER_BLOCK)), max(1, -(-n_asked // QUERIES_PER_BLOCK))
    scales = F.broadcast(component_cells(rows))  # a row for each length of vectors
    cell = F.transform(F.arrays_zip("v", "low", "width"), lambda x: F.floor((x["v"] - x["low"]) / x["width"]))
    pair = lambda key, mine, name, others, other: [
        F.pmod(F.xxhash64(key, F.lit(name)), F.lit(mine)).alias(name),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other),
    ]
    data = rows.join(scales, "d").select("d", "row", "vec_id", cell.cast("array<smallint>").alias("cells"), *pair("row", blocks, "block", query_blocks, "query_block"))
    wanted = asked.join(scales, "d").select("d", "query_row", "vec_id", "v", "low", "width", *pair("query_row", query_blocks, "query_block", blocks, "block"))
    key = ["d", "block", "query_block"]

    def bound(data: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(wanted):
            return pd.DataFrame({"d": [], "query_row": [], "row": [], "low": [], "high": []})
        same = wanted["vec_id"].to_numpy()[:, None] == data["vec_id"].to_numpy()[None, :]
        low, width = (np.asarray(wanted[x].iloc[0], dtype=np.int64) for x in ("low", "width"))
        found = block_bounds(data["row"].to_numpy(), _matrix(data["cells"], np.uint8), wanted["query_row"].to_numpy(), _matrix(wanted["v"], np.int64), same, low, width, k)
        return pd.DataFrame(dict(zip(("query_row", "row", "low", "high"), found, strict=True))).assign(d=int(data["d"].iloc[0]))[["d", "query_row", "row", "low", "high"]]

    bounds = checkpointed(data.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInPandas(bound, BOUNDED))
    by_low = Window.partitionBy("query_row").orderBy(F.col("low").desc())
    kth = bounds.withColumn("n", F.row_number().over(by_low)).filter(F.col("n") == k).select("query_row", F.col("low").alias("kth"))
    left = bounds.join(kth, "query_row", "left").filter("kth is null or high >= kth").select("query_row", "row")
    product = F.aggregate(F.zip_with("v", "q", lambda x, y: x.cast("decimal(19,0)") * y.cast("decimal(19,0)")), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    in_64_bits = F.greatest(F.lit(-(2**63)).cast("decimal(38,0)"), F.least(F.lit(2**63 - 1).cast("decimal(38,0)"), F.col("product"))).cast("long")
    best = Window.partitionBy("query_row").orderBy(F.col("product").desc(), "vec_id")
    return (
        left.join(asked.select("query_row", F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_row")
        .join(rows.select("row", "vec_id", "v"), "row")
        .select("query_row", "query_id", "vec_id", product.alias("product"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", in_64_bits.alias("score"))
    )
