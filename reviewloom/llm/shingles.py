"""Word shingles as 64-bit hashes, and blocks of (token, owner) postings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

SHINGLE_WORDS = 5
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64
)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than space, tab, LF, VT, FF and CR, with A to Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the SHINGLE_WORDS-word shingles; of all words, if they are
    fewer; none without words."""
    words = words_of(text) if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b"\x20".join(words), seed=len(words))], dtype=np.uint64)
    one = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((one(w) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - SHINGLE_WORDS + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE_WORDS):
        total += hashes[i : i + n] * _MULTIPLIERS[i]
    return np.unique(mixed(total))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def posting_blocks(owners: np.ndarray, sizes: np.ndarray, counts: np.ndarray, tokens: np.ndarray, slots: np.ndarray, extra: np.ndarray | None = None) -> pd.DataFrame:
    """Postings dealt into slots, one row for each slot that has any: the owners in it, their
    sizes and numbers of postings, and the tokens, in the order of owners."""
    owner_at = np.repeat(np.arange(len(owners)), counts)
    order = np.argsort(slots, kind="stable")
    slots, owner_at, tokens = slots[order], owner_at[order], tokens[order]
    extra = None if extra is None else extra[order]
    starts = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])) if len(slots) else np.empty(0, dtype=np.int64)
    rows = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(slots)], strict=False):
        at, n = np.unique(owner_at[a:b], return_counts=True)
        rows.append(
            (
                int(slots[a]),
                _packed(owners[at]),
                sizes[at].astype(np.uint32).tobytes(),
                n.astype(np.uint32).tobytes(),
                tokens[a:b].tobytes(),
                b"" if extra is None else extra[a:b].tobytes(),
            )
        )
    return pd.DataFrame(rows, columns=["slot", "owners", "sizes", "counts", "tokens", "extra"]).astype(
        {"slot": "int32", **dict.fromkeys(("owners", "sizes", "counts", "tokens", "extra"), object)}
    )


def _packed(owners: np.ndarray) -> bytes:
    """Owners in four bytes each, if all of them fit, as most ids do; in eight if not."""
    return owners.astype(np.uint32).tobytes() if len(owners) and owners.min() >= 0 and owners.max() < 1 << 32 else owners.tobytes()


def _owners(packed: bytes, counts: bytes) -> np.ndarray:
    """What _packed made; a count has four bytes, so the lengths tell the width."""
    return np.frombuffer(packed, dtype=np.uint32 if len(packed) == len(counts) else np.int64).astype(np.int64)


def dealt(blocks: DataFrame, slots: int) -> DataFrame:
    """Blocks or texts with a slot, shuffled by it into as many partitions, so that a task's
    share doesn't grow with the input."""
    return blocks.repartition(slots, "slot")


BLOCK = "slot int, owners binary, sizes binary, counts binary, tokens binary, extra binary"


def read_blocks(rows: pd.DataFrame, extra: type = np.uint8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, size, token and extra of each posting of the rows."""
    join = lambda name, kind: np.frombuffer(b"".join(rows[name]), dtype=kind)
    counts = join("counts", np.uint32)
    owners = [_owners(x, y) for x, y in zip(rows["owners"], rows["counts"], strict=True)]
    return (
        np.repeat(np.concatenate(owners) if owners else np.empty(0, dtype=np.int64), counts),
        np.repeat(join("sizes", np.uint32), counts),
        join("tokens", np.uint64),
        join("extra", extra),
    )
