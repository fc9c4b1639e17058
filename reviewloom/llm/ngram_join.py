"""Similarity join on word shingles with prefixes of token combinations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed, dealing_slots, give_back, return_memory
from reviewloom.llm.components import connected_components
from reviewloom.llm.shingles import BLOCK, dealt, mixed, posting_blocks, read_blocks, set_key, shingle_set

THRESHOLD = 80  # percent
#: Tokens in more sets than this are indexed in pairs, others alone.
RARE_SETS = 16
#: Sets of a block; a task compares two blocks.
BLOCK_SETS = 256
CHARS_PER_SLOT = 8_000_000
_POSTINGS_PER_BLOCK, _COLUMNS = 2_000_000, 8192


def needed_overlap(size: int) -> int:
    """The least intersection with any set that a set of ``size`` can link to."""
    return -(-THRESHOLD * size // 100)


def size_class(size: int) -> int:
    """Linked sets are of the same or the next class, as sizes differ by 100 / THRESHOLD at most."""
    return int(math.log(size) / math.log(100 / THRESHOLD) + 1e-9)


def signatures(size: int, tokens: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The signatures of a set, of which linked sets share one at least; none if the set
    can't link to any.

    ``tokens`` are those that other sets have too, with log frequencies; the rest of the
    ``size`` tokens come first in order of rarity. A prefix in that order must hold out
    against the size - needed_overlap tokens that a partner may lack. A rare token is a
    signature and holds out against one loss. Frequent tokens are dealt by hash into groups,
    in each of which all pairs are signatures; n of them hold out against n - 1 losses. The
    prefix is extended until the sum is one more than what may be lost.
    """
    lost = size - needed_overlap(size)
    alone = size - len(tokens)
    if alone > lost:
        return np.empty(0, dtype=np.uint64)
    order = np.lexsort((tokens, frequency))
    tokens, frequency = tokens[order], frequency[order]
    n_rare = int(np.searchsorted(frequency, log_frequency(np.array([RARE_SETS]))[0], side="right"))
    found = [tokens[: min(n_rare, lost + 1 - alone)]]
    left = lost + 1 - alone - n_rare
    if left > 0:
        frequent = tokens[n_rare:]
        own = size_class(size)
        for cls in (own, own + 1):
            groups = max(1, int((100 / THRESHOLD) ** cls / 15))
            group = (mixed(frequent ^ np.uint64(cls)) % np.uint64(groups)).astype(np.int64)
            # a token is worth one unless it is the first of its group
            first = np.zeros(len(frequent), dtype=bool)
            first[np.unique(group, return_index=True)[1]] = True
            end = int(np.searchsorted(np.cumsum(~first), left)) + 1
            part, in_group = frequent[:end], group[:end]
            by_group = np.argsort(in_group, kind="stable")
            for run in np.split(by_group, np.flatnonzero(np.diff(in_group[by_group])) + 1):
                x = part[run]
                i, j = np.triu_indices(len(x), 1)
                found.append(mixed(np.minimum(x[i], x[j]) * np.uint64(3) + mixed(np.maximum(x[i], x[j])) + np.uint64(cls)))
    return np.unique(np.concatenate(found))


def log_frequency(n: np.ndarray) -> np.ndarray:
    """Four steps an octave: a frequency's place in the order of rarity, as one byte."""
    return np.minimum(255, np.floor(4 * np.log2(np.maximum(n, 1)))).astype(np.uint8)


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and node (a name of the set; null without words) of each row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x) for x in batch.column("text").to_pylist()]
            sizes = pa.array([len(x) for x in found], type=pa.int64())
            nodes = pa.array([set_key(x) if len(x) else None for x in found], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, nodes], names=["doc_id", "n_shingles", "node"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: give_back(sets(batches)), "doc_id long, n_shingles long, node long")


def shared_tokens(docs: DataFrame, slots: int) -> DataFrame:
    """Blocks of the postings whose token is in two different sets or more, with the token's
    log frequency, dealt by node.

    Tasks send each set they meet once; a token's postings meet in its slot, where repeated
    sets count once. There are as many slots as the texts are long, so that a slot stays
    small, and a token of any frequency has one posting a set.
    """

    def postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        owners: list[int] = []

        def block() -> Iterator[pd.DataFrame]:
            sizes = np.array([len(x) for x in held], dtype=np.int64)
            tokens = np.concatenate(held)
            slot = ((tokens >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
            yield posting_blocks(np.array(owners, dtype=np.int64), sizes, sizes, tokens, slot)
            held.clear()
            owners.clear()

        waiting = 0
        for batch in batches:
            for text in batch["text"]:
                found = shingle_set(text)
                if len(found) < 2:  # a single shingle links to equal sets only
                    continue
                node = set_key(found)
                if node not in seen:
                    seen.add(node)
                    held.append(found)
                    owners.append(node)
                    waiting += len(found)
                if waiting > _POSTINGS_PER_BLOCK:
                    yield from block()
                    waiting = 0
        if held:
            yield from block()

    def shared(rows: pd.DataFrame) -> pd.DataFrame:
        return_memory()  # of the slot before
        owner, size, token, _ = read_blocks(rows)
        order = np.lexsort((owner, token))
        owner, size, token = owner[order], size[order], token[order]
        new_token = np.append(True, token[1:] != token[:-1])
        keep = new_token | np.append(True, owner[1:] != owner[:-1])
        owner, size, token, new_token = owner[keep], size[keep], token[keep], new_token[keep]
        starts = np.flatnonzero(new_token)
        sets = np.diff(np.append(starts, len(token)))
        sets = np.repeat(sets, sets)
        many = sets > 1
        owner, size, token, frequency = owner[many], size[many], token[many], log_frequency(sets[many])
        order = np.argsort(owner, kind="stable")
        owner, size, token, frequency = owner[order], size[order], token[order], frequency[order]
        owners, at, counts = np.unique(owner, return_index=True, return_counts=True)
        slot = np.repeat((mixed(owners.view(np.uint64)) % np.uint64(slots)).astype(np.int64), counts)
        return posting_blocks(owners, size[at], counts, token, slot, frequency)

    blocks = docs.select("text").mapInPandas(lambda batches: give_back(postings(batches)), BLOCK)
    return dealt(blocks, slots).groupBy("slot").applyInPandas(shared, BLOCK)


def indexed_sets(docs: DataFrame, slots: int) -> DataFrame:
    """node, size, tokens (those that other sets have), signatures, of the sets that may link."""

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        return_memory()
        owner, size, token, frequency = read_blocks(rows)
        order = np.argsort(owner, kind="stable")
        owner, size, token, frequency = owner[order], size[order], token[order], frequency[order]
        found = []
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, dtype=np.int64)
        for a, b in zip(starts, [*starts[1:], len(owner)], strict=False):
            signs = signatures(int(size[a]), token[a:b], frequency[a:b])
            if len(signs):
                found.append((int(owner[a]), int(size[a]), token[a:b].view(np.int64), signs.view(np.int64)))
        return pd.DataFrame(found, columns=["node", "size", "tokens", "signatures"])

    return dealt(shared_tokens(docs, slots), slots).groupBy("slot").applyInPandas(index, "node long, size int, tokens array<long>, signatures array<long>")


def linked_pairs(size: np.ndarray, tokens: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets, by the exact sizes of all intersections, as a spanning forest of
    them. With two sides, only sets of different sides are compared."""
    n = len(size)
    owner = np.repeat(np.arange(n), [len(x) for x in tokens])
    _, column = np.unique(np.concatenate(tokens), return_inverse=True)
    shared, order = np.zeros((n, n), dtype=np.float64), np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1, _COLUMNS):
        part = slice(*np.searchsorted(column, (low, low + _COLUMNS)))
        x = np.zeros((n, _COLUMNS), dtype=np.float32)
        x[owner[part], column[part] - low] = 1
        shared += x @ x.T
    total = size[:, None].astype(np.float64) + size[None, :]
    links = 100 * shared >= THRESHOLD * (total - shared)
    if side.min() != side.max():
        links &= side[:, None] != side[None, :]
    np.fill_diagonal(links, False)
    forest, seen = [], np.zeros(n, dtype=bool)
    for root in range(n):
        if not seen[root]:
            seen[root], waiting = True, [root]
            while waiting:
                at = waiting.pop()
                new = np.flatnonzero(links[at] & ~seen)
                seen[new] = True
                forest += [(at, int(x)) for x in new]
                waiting += new.tolist()
    return forest


def neighbourhoods(sets: DataFrame) -> DataFrame:
    """node, label of the sets that signatures connect to others. A signature's sets hang on its
    smallest, so it gives a row a set."""
    members = sets.select(F.explode("signatures").alias("sign"), "node")
    lowest = members.groupBy("sign").agg(F.min("node").alias("low"), F.count("*").alias("n")).filter("n > 1")
    return connected_components(members.join(lowest, "sign").select(F.col("low").alias("a"), F.col("node").alias("b")))


def set_links(sets: DataFrame, slots: int) -> DataFrame:
    """node, label of the sets that link to another: components by verified links.

    Sets that share a signature are in one neighbourhood, so every link is inside of one. A
    neighbourhood is cut into blocks of BLOCK_SETS by hash, and each pair of its blocks is
    compared in one task, which holds two blocks and gives a forest of the links it finds: a
    row a set at most, whatever the number of links. Neighbourhoods of one block share tasks.
    """
    near = checkpointed(neighbourhoods(sets))
    sizes = near.groupBy("label").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("blocks"))
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")), F.explode(F.expr("sequence(0L, blocks - 1)"))
    placed = (
        sets.select("node", "size", "tokens")
        .join(near.join(sizes, "label"), "node")
        .withColumn("own", own)
        .withColumn("other", other)
        .withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(slots))).otherwise(F.col("label")))
        .select("task", "label", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "node", "size", "tokens")
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in rows.groupby("label", sort=False):
            nodes = part["node"].to_numpy()
            if len(nodes) > 1:
                forest = linked_pairs(part["size"].to_numpy(), part["tokens"].tolist(), part["own"].to_numpy())
                found += [(nodes[a], nodes[b]) for a, b in forest]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return connected_components(placed.groupBy("task", "first", "second").applyInPandas(compare, "a long, b long"))


def link_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row.

    Two documents link when 100 * intersection >= THRESHOLD * union of their sets of
    distinct SHINGLE_WORDS-word shingles; component_id is the smallest doc_id that links
    reach. Documents with equal sets are one node of the graph, named by 64 bits of a hash,
    so groups of copies are never expanded.

    A document without words, or without text, has no set, links to nothing and is its own
    component; one with fewer words than a shingle has has all of them as one; long texts
    are read whole; repeated rows share a set; an empty table gives no rows; other columns
    are ignored; a null doc_id is never a component_id unless it stands alone.
    """
    rows = checkpointed(document_sets(docs))
    named = labelled_sets(docs, rows)
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_node = named.join(lowest, "label").select("node", "component_id")
    return rows.join(of_node, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def labelled_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, first (its smallest doc_id) and label (of its component) of each set of ``rows``,
    which are the document_sets of ``docs``."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    slots = dealing_slots(docs.sparkSession, chars, CHARS_PER_SLOT)
    labels = set_links(checkpointed(indexed_sets(docs, slots)), slots)
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, but one of each component: that of the smallest
    doc_id, null last, and then of the smallest node. Rows without a set all stay.

    Rows are told apart by doc_id and set, so different texts under one doc_id, or under none,
    don't stand for each other. Rows that repeat both are copies; one of them stays.
    """
    named = labelled_sets(docs, checkpointed(document_sets(docs)))
    best = named.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("last"), "first", "node")).alias("best"))

    def with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x) for x in batch.column("text").to_pylist()]
            nodes = pa.array([set_key(x) if len(x) else None for x in found], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), nodes], names=["row", "node"])

    whole = docs.select(F.struct("*").alias("row"), "text")
    rows = whole.mapInArrow(lambda batches: give_back(with_node(batches)), whole.select("row", F.lit(None).cast("long").alias("node")).schema)
    # null fields of structs are equal; a row without a set has a number of its own
    alone = F.when(F.col("node").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("key", F.struct(F.col("row.doc_id").cast("long").alias("doc_id"), "node", alone.alias("alone")))
    chosen = best.select(F.struct(F.col("best.first").alias("doc_id"), F.col("best.node").alias("node"), F.lit(None).cast("long").alias("alone")).alias("key"), F.lit(True).alias("chosen"))
    return rows.join(chosen, "key", "left").filter("chosen or node is null").dropDuplicates(["key"]).select("row.*")
