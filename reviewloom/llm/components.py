"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node in ``links`` (a, b).

    Alternating star contraction: a large step hangs a node's larger neighbours on its
    smallest, a small step its smaller ones. Minima are aggregated before they are joined
    back, so a node with many links needs no task for itself. Steps are written to the
    checkpoint folder; they are as many as the logarithm of the largest component, about.
    """
    edges = checkpointed(_distinct(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _distinct(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"))
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
        )
        edges = checkpointed(_distinct(small))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod("b", F.lit(1_000_003)))).first())
        if now == seen or not now[0]:
            break
        seen = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(stars.select(F.col("label").alias("node"), "label").distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").distinct()
