"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed, dealing_slots
from reviewloom.llm.shingles import BLOCK, dealt, mixed, posting_blocks, read_blocks
from reviewloom.llm.suffix_dedup import BYTES_PER_SLOT, _bytes, _not_first, _shifted, _slot_of, _to_documents, named, owned, prime_from

SHORTEST, LONGEST = 32, 256
#: Five bits of the gear hash, of which the highest depends on the last 26 bytes.
CUT_BITS = np.uint32(0b11111 << 21)
_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_BYTES_PER_BLOCK = 16_000_000


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gear values of it and the 31 before, each shifted by its
    distance: what rolling h = (h << 1) + gear[byte] gives in 32 bits, by doubling."""
    h, step = _GEAR[data], 1
    while step < 32:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def cut_points(data: np.ndarray) -> list[int]:
    """Ends of the chunks. Cuts lie between characters, where the hash's CUT_BITS are 0, at
    least SHORTEST bytes apart, and no farther than LONGEST (and a character)."""
    if not len(data):
        return []
    starts = np.append((data[1:] & 0xC0) != 0x80, True)  # a character ends at this byte
    likely = np.flatnonzero(((gear_hashes(data) & CUT_BITS) == 0) & starts) + 1
    ends, last = [], 0
    for end in [*likely.tolist(), len(data)]:
        while end - last > LONGEST:
            last += LONGEST
            while not starts[last - 1]:
                last += 1
            ends.append(last)
        if end - last >= SHORTEST or end == len(data) > last:
            ends.append(end)
            last = end
    return ends


def chunk_digests(data: np.ndarray, ends: list[int]) -> np.ndarray:
    """128 bits of each chunk, as rows of two integers."""
    raw, starts = data.tobytes(), [0, *ends][:-1]
    joined = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts, ends, strict=True))
    return np.frombuffer(joined, dtype=np.uint64).reshape(-1, 2)


def repeated_chunks(docs: DataFrame, slots: int) -> DataFrame:
    """Blocks, dealt by document, of the digests that a document with a smaller id has too.

    What repeats within a task's share is settled there, and only its first document asks on;
    so a chunk of any number of documents sends one posting a task at most.
    """

    def postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, np.ndarray]] = []

        def block() -> Iterator[pd.DataFrame]:
            owner = np.repeat(np.array([x[0] for x in held], dtype=np.int64), [len(x[1]) for x in held])
            digests = np.concatenate([x[1] for x in held])
            held.clear()
            low, high = digests[:, 0], digests[:, 1]
            again = _not_first(owner, high, low)
            yield _shifted(_to_documents(owner[again], low[again], high[again], slots), slots)
            owner, low, high = owner[~again], low[~again], high[~again]
            order = np.argsort(owner, kind="stable")
            owners, counts = np.unique(owner, return_counts=True)
            yield posting_blocks(owners, np.zeros(len(owners)), counts, low[order], _slot_of(low[order], slots), high[order])

        waiting = 0
        for batch in batches:
            for doc, text in zip(batch["owner"], batch["text"], strict=True):
                data = _bytes(text)
                held.append((doc, np.unique(chunk_digests(data, cut_points(data)), axis=0)))
                waiting += len(data)
                if waiting > _BYTES_PER_BLOCK:
                    yield from block()
                    waiting = 0
        if held:
            yield from block()

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["slot"].iloc[0] >= slots:
            return _shifted(rows, -slots)
        owner, _, low, high = read_blocks(rows, np.uint64)
        again = _not_first(owner, high, low)
        return _to_documents(owner[again], low[again], high[again], slots)

    return dealt(docs.mapInPandas(postings, BLOCK), slots).groupBy("slot").applyInPandas(judge, BLOCK)


def remove_repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed (bytes), n_spans, spans and kept_text of each row.

    Texts are cut where their content says, so an insertion moves the cuts near it only. A
    chunk goes if its digest is in a document with a smaller doc_id, or earlier in its own.
    Digests are dealt by value, texts by document, once; slots are as many as the texts are
    long. Cuts lie between characters, so what is kept is text.

    A null or empty text has no chunks; one shorter than SHORTEST bytes is a chunk; long ones
    are cut whole; rows that repeat a doc_id lose nothing to each other; a null doc_id is
    above all others; an empty table gives no rows; other columns are ignored.
    """
    docs = owned(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = prime_from(dealing_slots(docs.sparkSession, size, BYTES_PER_SLOT))
    again = checkpointed(repeated_chunks(docs, slots))
    texts = docs.withColumn("slot", F.pmod("owner", F.lit(slots)).cast("int"))

    def cut(blocks: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        owner, _, low, high = read_blocks(blocks, np.uint64)
        gone_of: dict[int, set[tuple[int, int]]] = {}
        for doc, a, b in zip(owner.tolist(), low.tolist(), high.tolist(), strict=True):
            gone_of.setdefault(doc, set()).add((a, b))
        rows = []
        for doc, text in zip(texts["owner"].tolist(), texts["text"], strict=True):
            data = _bytes(text)
            ends = cut_points(data)
            seen = set(gone_of.get(doc, ()))
            kept, spans, start = [], [], 0
            for end, digest in zip(ends, map(tuple, chunk_digests(data, ends).tolist()), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    kept.append(data[start:end])
                elif spans and spans[-1][1] == start:
                    spans[-1] = (spans[-1][0], end)
                else:
                    spans.append((start, end))
                start = end
            left = b"".join(x.tobytes() for x in kept).decode("utf-8", "surrogatepass")
            rows.append((len(data), len(ends), sum(b - a for a, b in spans), len(spans), ",".join(f"{a}:{b}" for a, b in spans), left))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_chunks", "n_removed", "n_spans", "spans", "kept_text"], index=texts.index)
        return pd.concat([texts[["owner", "known"]], out.astype({"spans": object, "kept_text": object})], axis=1)

    fields = "owner long, known boolean, n_bytes long, n_chunks long, n_removed long, n_spans long, spans string, kept_text string"
    return named(dealt(again, slots).groupBy("slot").cogroup(dealt(texts, slots).groupBy("slot")).applyInPandas(cut, fields))
