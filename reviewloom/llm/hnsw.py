"""Approximate nearest neighbours by inner product: hierarchical navigable small worlds, one a shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed

#: A shard's vectors, fewer where they are long; queries that meet a shard in one group.
VECTORS_PER_SHARD, BYTES_PER_SHARD, QUERIES_PER_BLOCK = 16_384, 32 << 20, 16_384
#: Links a node makes, vectors held while it looks for them, and while a query does.
LINKS, EF_BUILD, EF_SEARCH = 16, 64, 160
#: Nodes linked by brute force before the graph is searched, nodes and queries that go in step.
FIRST, STEP = 256, 1024
INDEX = "d int, shard int, ids binary, starts binary, vectors binary, layers array<int>, links binary"
FOUND = "query_row long, query_id long, vec_id long, score double"


def level_surface(vectors: np.ndarray) -> np.ndarray:
    """Vectors of one norm, so that the nearest by inner product is the nearest by distance: one
    component more fills what each lacks to the longest. Of float32, scaled to a norm of one."""
    scaled = vectors / np.abs(vectors).max()
    norms = np.square(scaled).sum(axis=1)
    return np.column_stack([scaled, np.sqrt(norms.max() - norms)]).astype(np.float32) / np.float32(np.sqrt(norms.max()))


def _merged(ids: np.ndarray, near: np.ndarray, more: np.ndarray, more_near: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    ids, near = np.concatenate([ids, more], axis=1), np.concatenate([near, more_near], axis=1)
    order = np.argsort(-near, axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _rows_of(r: np.ndarray, values: np.ndarray, near: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of sorted rows ``r`` laid into a matrix of ``n`` rows; -1 and -inf fill it."""
    counts = np.bincount(r, minlength=n)
    at = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
    width = int(counts.max(initial=0))
    ids, sims = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32)
    ids[r, at], sims[r, at] = values, near
    return ids, sims


def search_layer(x: np.ndarray, links: np.ndarray, starts: np.ndarray, asked: np.ndarray, ef: int, at_once: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest found of every row of ``asked`` and their products, best first.

    All rows go in step: each opens its ``at_once`` best nodes that aren't open yet, and keeps the
    ``ef`` best of what it saw, until all it keeps are open. -1 fills rows that saw fewer.
    """
    n, rows = len(links), np.arange(len(asked))[:, None]
    seen = np.zeros((len(asked), n), dtype=bool)
    seen[rows, starts] = True
    ids, near = starts.astype(np.int64), np.einsum("ijk,ik->ij", x[starts], asked)
    fill = ((0, 0), (0, max(0, ef - ids.shape[1])))
    ids, near = _merged(np.pad(ids, fill, constant_values=-1), np.pad(near, fill, constant_values=-np.inf), ids[:, :0], near[:, :0], ef)
    is_open, active = ids < 0, np.arange(len(asked))
    while len(active):
        shut = np.where(is_open[active], -np.inf, near[active])
        pick = np.argpartition(-shut, min(at_once, ef) - 1, axis=1)[:, :at_once]
        good = np.take_along_axis(shut, pick, 1) > -np.inf
        is_open[active[:, None], pick] = True
        out = np.where(good[:, :, None], links[np.maximum(ids[active[:, None], pick], 0)], -1).reshape(len(active), -1)
        r, c = np.nonzero(out >= 0)
        c = out[r, c]
        new = ~seen[active[r], c]
        r, c = np.divmod(np.unique(r[new].astype(np.int64) * n + c[new]), n)
        seen[active[r], c] = True
        sims = np.einsum("ij,ij->i", x[c], asked[active[r]])
        better = sims > near[active[r], -1]
        r, c, sims = r[better], c[better], sims[better]
        more, more_near = _rows_of(r, c, sims, len(active))
        both = np.concatenate([near[active], more_near], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :ef]
        near[active] = np.take_along_axis(both, order, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], more], axis=1), order, 1)
        is_open[active] = np.take_along_axis(np.concatenate([is_open[active], more < 0], axis=1), order, 1)
        active = active[~is_open[active].all(axis=1)]
    return ids, near


def diverse(x: np.ndarray, candidates: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
    """``m`` of each row's candidates (best first): those nearer to the row's node than to any taken before
    them, then the best of the others."""
    v = x[np.maximum(candidates, 0)]
    between = v @ v.transpose(0, 2, 1)
    kept, count = np.zeros(candidates.shape, dtype=bool), np.zeros(len(candidates), dtype=int)
    closest = np.full(candidates.shape, -np.inf, np.float32)
    for j in range(candidates.shape[1]):
        take = (near[:, j] > closest[:, j]) & (candidates[:, j] >= 0) & (count < m)
        kept[:, j] = take
        count += take
        np.maximum(closest, between[:, j], out=closest, where=take[:, None])
    order = np.argsort(np.where(candidates < 0, 2, ~kept), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(candidates, order, 1)


def _link_back(x: np.ndarray, links: np.ndarray, sources: np.ndarray, targets: np.ndarray, degree: int) -> None:
    """Adds links from ``targets`` to ``sources``; a node whose places are all taken keeps ``degree`` diverse ones."""
    near = np.einsum("ij,ij->i", x[targets], x[sources])
    order = np.lexsort((-near, targets))
    sources, near = sources[order], near[order]
    nodes, r = np.unique(targets[order], return_inverse=True)
    more, more_near = _rows_of(r, sources, near, len(nodes))
    width = links.shape[1]
    for k in range(0, len(nodes), STEP):
        part = nodes[k : k + STEP]
        old = links[part].astype(np.int64)
        old_near = np.where(old < 0, -np.inf, np.einsum("ijk,ik->ij", x[np.maximum(old, 0)], x[part])).astype(np.float32)
        both, both_near = _merged(old, old_near, more[k : k + STEP], more_near[k : k + STEP], width + degree)
        full = (both >= 0).sum(axis=1) > width
        now = np.full((len(part), width), -1, np.int64)
        fits = both[~full][:, :width]
        now[~full, : fits.shape[1]] = fits
        if full.any():
            now[full, :degree] = diverse(x, both[full], both_near[full], degree)
        links[part] = now


def build_layer(x: np.ndarray, upper: list[np.ndarray], degree: int) -> np.ndarray:
    """Links of a layer that holds all of ``x``. Its first nodes make up the layer above and keep their
    links; the others are put in one after the other, many in step."""
    n = len(x)
    links = np.full((n, degree + LINKS), -1, np.int32)
    if upper:
        first = len(upper[-1])
        links[:first, : upper[-1].shape[1]] = upper[-1]
    else:
        first = _linked_by_force(x, links, degree)
    while first < n:
        size = min(max(first, FIRST), STEP, n - first)
        asked = x[first : first + size]
        ids, near = search_layer(x, links[:first], entries(x, upper, asked), asked, EF_BUILD)
        among = asked @ asked.T
        np.fill_diagonal(among, -np.inf)
        best = np.argpartition(-among, min(LINKS, size) - 1, axis=1)[:, :LINKS]
        mates = np.where(np.take_along_axis(among, best, 1) > -np.inf, best + first, -1)
        ids, near = _merged(ids, near, mates, np.take_along_axis(among, best, 1), EF_BUILD)
        chosen = diverse(x, ids, near, LINKS)
        links[first : first + size, : chosen.shape[1]] = chosen
        r, c = np.nonzero(chosen >= 0)
        # a pair of one step may choose each other: the link is there already
        target, source = chosen[r, c], r + first
        mutual = (links[target] == source[:, None]).any(axis=1)
        _link_back(x, links, source[~mutual], target[~mutual], degree)
        first += size
    return links


def _linked_by_force(x: np.ndarray, links: np.ndarray, degree: int) -> int:
    """Links the first nodes of the top layer, comparing all of them; tells how many."""
    first = min(len(x), FIRST)
    sims = x[:first] @ x[:first].T
    np.fill_diagonal(sims, -np.inf)
    best = np.argsort(-sims, axis=1, kind="stable")[:, : min(first - 1, EF_BUILD)]
    if best.shape[1]:
        chosen = diverse(x, best, np.take_along_axis(sims, best, 1), LINKS)
        links[:first, : chosen.shape[1]] = chosen
        target, source = chosen.ravel(), np.repeat(np.arange(first), chosen.shape[1])
        mutual = (links[target] == source[:, None]).any(axis=1)
        _link_back(x, links, source[~mutual], target[~mutual], degree)
    return first


def entries(x: np.ndarray, upper: list[np.ndarray], asked: np.ndarray, ef: int = 8) -> np.ndarray:
    """Where the search of the next layer starts: down from the top, the best found of each layer."""
    at = np.zeros((len(asked), 1), dtype=np.int64)
    for links in upper:
        ids, _ = search_layer(x, links, at, asked, min(ef, len(links)))
        at = ids[:, :1]
    return at


def build(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the nodes and the links of each layer, top first.

    Levels are drawn as usual, a LINKS-th of a layer in the next; nodes are ordered by them, so a
    layer holds the first nodes of the order. Links name places in the order, LINKS more places than the
    degree being there, so that a node is thinned out once for several links.
    """
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(LINKS)).astype(int)
    order = np.lexsort((rng.random(len(x)), -level))
    x, layers = x[order], []
    for at in range(int(level.max()), -1, -1):
        layers.append(build_layer(x[: int((level >= at).sum())], layers, 2 * LINKS if at == 0 else LINKS))
    return order, layers


def find(x: np.ndarray, layers: list[np.ndarray], asked: np.ndarray, ef: int) -> np.ndarray:
    """Places of the ``ef`` nearest found of each row of ``asked``, -1 where there are fewer."""
    found = [np.zeros((0, ef), dtype=np.int64)]
    for k in range(0, len(asked), STEP):
        part = asked[k : k + STEP]
        found.append(search_layer(x, layers[-1], entries(x, layers[:-1], part), part, ef)[0])
    return np.concatenate(found)


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's graph over its different vectors, as flat arrays; ids of equal vectors follow each other."""
    d, shard = int(rows["d"].iloc[0]), int(rows["shard"].iloc[0])
    matrix, ids = np.stack(rows["v"].to_list()).astype(np.float64), rows["vec_id"].to_numpy()
    _, first, which = np.unique(matrix.view(f"V{8 * d}").ravel(), return_index=True, return_inverse=True)
    distinct = matrix[first]
    order, layers = build(level_surface(distinct), seed=shard)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    by_place = np.lexsort((ids, place[which]))
    starts = np.searchsorted(place[which][by_place], np.arange(len(order) + 1))
    flat = np.concatenate([x.ravel() for x in layers]).astype(np.int32)
    row = (d, shard, ids[by_place].astype(np.int64).tobytes(), starts.astype(np.int64).tobytes(), distinct[order].tobytes(), [len(x) for x in layers], flat.tobytes())
    return pd.DataFrame([row], columns=["d", "shard", "ids", "starts", "vectors", "layers", "links"])


def _layers(sizes: list[int], flat: np.ndarray) -> list[np.ndarray]:
    layers, at = [], 0
    for i, n in enumerate(sizes):
        width = LINKS + (2 * LINKS if i == len(sizes) - 1 else LINKS)
        layers.append(flat[at : at + n * width].reshape(n, width))
        at += n * width
    return layers


def nearest_of_shard(index: pd.Series, queries: pd.DataFrame, k: int, ef: int) -> list[tuple]:
    """(query_row, query_id, vec_id, score) of each query's k best found in the shard."""
    ids, starts = np.frombuffer(index["ids"], np.int64), np.frombuffer(index["starts"], np.int64)
    vectors = np.frombuffer(index["vectors"], np.float64).reshape(len(starts) - 1, -1)
    asked = np.stack(queries["v"].to_list()).astype(np.float64)
    # a query's own length doesn't change the order of its products
    level = np.column_stack([asked / np.abs(asked).max(axis=1, keepdims=True), np.zeros(len(asked))]).astype(np.float32)
    found = find(level_surface(vectors), _layers(list(index["layers"]), np.frombuffer(index["links"], np.int32)), level, ef)
    out = []
    for row, own, q, places in zip(queries["query_row"], queries["vec_id"], asked, found, strict=True):
        places = places[places >= 0]
        # summed from the first component to the last
        scores = np.add.accumulate(vectors[places] * q, axis=1)[:, -1]
        best: list[tuple[float, int]] = []
        for j in np.argsort(-scores, kind="stable"):
            if len(best) >= k and -scores[j] > sorted(best)[k - 1][0]:
                break
            mine = ids[starts[places[j]] : starts[places[j] + 1]]
            best += [(-scores[j], i) for i in mine[mine != own][:k]]
        out += [(row, own, int(i), -float(s)) for s, i in sorted(best)[:k]]
    return out


def approximate_topk(vectors: DataFrame, is_query: Column, k: int = 20, ef: int = EF_SEARCH, per_shard: int = VECTORS_PER_SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query among all other vectors, by
    inner product in double precision (summed from the first component on).

    Rows (vec_id, embedding) are dealt to shards by a hash of their number, so neither a hot id nor
    copies gather. Each shard's different vectors get a navigable graph of layers, written once as flat
    arrays; blocks of queries meet every shard, and the shards' best are merged. A shard and a block have a set size, so a
    task's memory stays the same; only the number of pairs of them grows. All vectors are indexed.

    Ties go to the smaller vec_id. Vectors that are null, empty, zero, or hold null, NaN or an infinity take
    no part, nor rows without vec_id; vectors meet those of their own length only. A query's own row is every row of
    its vec_id; repeated candidates count each, repeated queries once. A query with fewer candidates gets all that
    the search reaches. Products beyond what doubles hold are infinite. Empty tables and lone vectors give no
    rows; other columns are ignored.
    """
    whole = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(double(x)) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    taking = (
        vectors.select("vec_id", "embedding", is_query.alias("asks"))
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
        .select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("d"), "asks")
    )
    # written once, as numbers of rows must not change when a task is run again
    rows = checkpointed(taking.withColumn("row", F.monotonically_increasing_id()))
    lengths = rows.groupBy("d").agg(F.count("*").alias("n"))
    held = F.least(F.lit(per_shard), F.greatest(F.lit(1), F.floor(F.lit(BYTES_PER_SHARD) / (8 * F.col("d")))))
    shards = lengths.select("d", F.ceil(F.col("n") / held).cast("int").alias("shards"))
    dealt = rows.join(F.broadcast(shards), "d").withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))
    index = checkpointed(dealt.select("d", "shard", "vec_id", "v").groupBy("d", "shard").applyInPandas(_index, INDEX))
    asked = checkpointed(rows.filter("asks").dropDuplicates(["vec_id", "v"]).select("d", "vec_id", "v").withColumn("query_row", F.monotonically_increasing_id()))
    blocks = max(1, -(-asked.count() // QUERIES_PER_BLOCK))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = index.withColumn("block", upto(F.lit(blocks)))
    right = asked.join(F.broadcast(shards), "d").withColumn("block", F.pmod(F.xxhash64("query_row"), F.lit(blocks)).cast("int")).withColumn("shard", upto(F.col("shards")))

    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = nearest_of_shard(index.iloc[0], queries, k, ef) if len(index) and len(queries) else []
        return pd.DataFrame(found, columns=["query_row", "query_id", "vec_id", "score"])

    key = ["d", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.drop("shards").groupBy(*key)).applyInPandas(search, FOUND)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
