"""Approximate search: recall against brute force, exact scores, and the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import hnsw
from reviewloom.llm.hnsw import approximate_topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, step=20):
    """Every query's k best, (id, rank, other, score)."""
    good = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in sorted({(i, v) for i, v in good if i % step == 0}):
        scored = sorted((-float(np.add.accumulate(np.array(v) * np.array(w))[-1]), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def recall(found, wanted):
    of = lambda rows: {(q, i) for q, _, i, _ in rows}
    return len(of(found) & of(wanted)) / len(of(wanted))


@pytest.mark.parametrize("lengths", [(1.0, 1.0), (0.1, 10.0)])
def test_recall_and_exact_scores(spark, monkeypatch, lengths):
    """Several shards and blocks of queries; vectors of one length, and of very different lengths."""
    monkeypatch.setattr(hnsw, "QUERIES_PER_BLOCK", 40)
    rng = np.random.default_rng(1)
    points = rng.normal(size=(2500, 24)) + rng.normal(size=(30, 24))[rng.integers(0, 30, 2500)]
    points = points / np.linalg.norm(points, axis=1, keepdims=True) * rng.uniform(*lengths, size=(2500, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    found = sorted(map(tuple, approximate_topk(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=20, per_shard=900).collect()))
    wanted = brute(rows, 20)
    assert recall(found, wanted) >= 0.95 and len(found) == len(wanted)
    vectors = dict(rows)
    for q, _, i, score in found[:200]:
        assert score == float(np.add.accumulate(np.array(vectors[q]) * np.array(vectors[i]))[-1])


def test_recall_of_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(i, [float(x) for x in v]) for i, v in table.select("vec_id", "embedding").collect()]
    found = list(map(tuple, approximate_topk(table, F.col("vec_id") % 20 == 0).collect()))
    assert recall(found, brute(rows, 20)) >= 0.95


def test_copies_ties_and_odd_vectors(spark):
    """A third of all rows are one vector; ids and rows repeat; few candidates, other lengths, bad and zero vectors."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(400)] + [(1000 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0]) for i in range(200)]
    rows += [(40, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0])] * 2 + [(40, [2.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (60, [1.0, 2.0]), (61, [3.0, 1.0]), (80, [1e300] * 3), (81, [1e300, 1.0, 1.0])]
    rows += [(20, None), (20, []), (100, [0.0] * 6), (120, [float("nan")] * 6), (140, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (160, [float("inf")] * 6), (None, [1.0] * 6), (2**60 + 20, [1.0] * 6)]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA + ", shard string, block int")
    found = sorted(map(tuple, approximate_topk(table, F.col("vec_id") % 20 == 0, k=5, ef=400).collect()))
    assert found == brute(rows, 5)


def test_tables_without_rows_and_lone_vectors(spark):
    asks = F.col("vec_id") % 20 == 0
    assert approximate_topk(spark.createDataFrame([], SCHEMA), asks).count() == 0
    assert approximate_topk(spark.createDataFrame([(0, [1.0]), (20, [1.0, 2.0]), (20, None)], SCHEMA), asks).count() == 0
    pair = approximate_topk(spark.createDataFrame([(0, [1.0, 1.0]), (7, [1.0, 2.0])], SCHEMA), asks).collect()
    assert list(map(tuple, pair)) == [(0, 1, 7, 3.0)]


def test_each_layer_holds_the_first_nodes_of_the_next():
    x = hnsw.level_surface(np.random.default_rng(3).normal(size=(3000, 8)))
    order, layers = hnsw.build(x)
    sizes = [len(links) for links in layers]
    assert sorted(order) == list(range(3000)) and sizes == sorted(sizes) and sizes[-1] == 3000
    for links in layers:
        r, c = np.nonzero(links >= 0)
        assert links.max() < len(links) and not (links[r, c] == r).any()
        assert all(len(set(row[row >= 0])) == (row >= 0).sum() for row in links[:300])
