"""Secret scan: fixed patterns, and windows of high Shannon entropy."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ASSIGN = re.compile(
    r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?((?-i:[A-Za-z0-9+/_.=-]+))",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class EntropyClass:
    """A character class, the window that slides over its strings and the least bits a character."""

    kind: str
    characters: str
    window: int
    bits: float


HEX_CLASS = EntropyClass("entropy_hex", "0123456789abcdefABCDEF", 24, 3.2)
TEXT_CLASS = EntropyClass(
    "entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 3.9
)
ENTROPY_CLASSES = (HEX_CLASS, TEXT_CLASS)

#: Strings that look random and are no secrets.
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9_=+/-]+"  # numbers, dates, rules
    r"|[A-Za-z_=+/-]+"  # words, paths without digits
    r"|(?:/?[a-z0-9_.-]{1,16}/){3,}[a-z0-9_.-]*"  # paths of short parts
)

#: Words of values that stand for a secret.
ALLOWED_WORDS = re.compile(r"(?i:example|placeholder|changeme|dummy|sample|your[_-]?(?:key|token))")

_CANDIDATE_BYTES = np.zeros(256, dtype=bool)
_CANDIDATE_BYTES[[ord(c) for c in TEXT_CLASS.characters]] = True
SHORTEST = min(c.window for c in ENTROPY_CLASSES)
_CLOG = [0.0] + [n * math.log2(n) for n in range(1, 1 + max(c.window for c in ENTROPY_CLASSES))]

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
    + [
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_entropy", T.LongType()),
    ]
)


def high_entropy_runs(text: str, kind: EntropyClass) -> list[tuple[int, int]]:
    """Unions of windows of ``kind.window`` characters whose entropy reaches ``kind.bits``.

    Counts change by one character out and one in as the window moves, and with them the
    sum of n * log2(n) that the entropy needs.
    """
    size, found = kind.window, []
    if len(text) < size:
        return found
    counts: dict[str, int] = {}
    for c in text[:size]:
        counts[c] = counts.get(c, 0) + 1
    total = sum(_CLOG[n] for n in counts.values())
    most = size * (math.log2(size) - kind.bits) + 1e-9  # what total may be
    for start in range(len(text) - size + 1):
        if start:
            out, new = text[start - 1], text[start + size - 1]
            n = counts[out]
            total += _CLOG[n - 1] - _CLOG[n]
            counts[out] = n - 1
            n = counts.get(new, 0)
            total += _CLOG[n + 1] - _CLOG[n]
            counts[new] = n + 1
        if total <= most:
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], start + size)
            else:
                found.append((start, start + size))
    return found


def long_strings(text: str) -> list[tuple[int, str]]:
    """(start, string) of each run of SHORTEST or more characters that secrets are made of."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = _CANDIDATE_BYTES[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= SHORTEST
    same = len(raw) == len(text)
    return [
        (s if same else len(raw[:s].decode("utf-8", "surrogatepass")), raw[s:e].decode("ascii"))
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)
    ]


def base_spans(text: str, strings: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches that pass their length."""
    found, low = [], text.lower()
    if any(x in low for x in ("pass", "secret", "token", "key")):  # what each assignment has
        found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(at + m.start(), at + m.end(), "hex") for at, word in strings for m in HEX.finditer(word)]


def allowed(word: str) -> bool:
    """Whether a string is no secret by its form, or by a word in its value: what follows the last '='."""
    return bool(ALLOWED.fullmatch(word) or ALLOWED_WORDS.search(word.rstrip("=").rpartition("=")[2]))


def outside(start: int, end: int, taken: Iterable[tuple]) -> list[tuple[int, int]]:
    """The parts of a span that no span of ``taken`` (start, end, ...) covers."""
    parts = []
    for a, b, *_ in sorted(taken):
        if a < end and start < b:
            if start < a:
                parts.append((start, a))
            start = max(start, b)
    return parts + [(start, end)] if start < end else parts


def entropy_spans(strings: list[tuple[int, str]], base: Iterable[tuple] = ()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of high-entropy windows in strings that no allow-list entry covers,
    without what spans of ``base``, or of a class before, cover of them."""
    found = []
    for at, word in strings:
        taken = [(x[0] - at, x[1] - at) for x in base if x[0] < at + len(word) and at < x[1]]
        for kind in ENTROPY_CLASSES:
            for part in re.finditer(f"[{re.escape(kind.characters)}]{{{kind.window},}}", word):
                if allowed(part[0]) or allowed(word):
                    continue
                for a, b in high_entropy_runs(part[0], kind):
                    a, b = part.start() + a, part.start() + b
                    if allowed(word[a:b]):
                        continue
                    rest = [(x, y) for x, y in outside(a, b, taken) if not allowed(word[x:y])]
                    taken += rest
                    found += [(at + x, at + y, kind.kind) for x, y in rest]
    return found


def secret_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and the entropy spans without what these cover; ordered."""
    order = {k: i for i, k in enumerate((*BASE_KINDS, *(c.kind for c in ENTROPY_CLASSES)))}
    strings = long_strings(text)
    base = base_spans(text, strings)
    added = entropy_spans(strings, base)
    return sorted(base, key=lambda x: (x[0], order[x[2]])), sorted(added, key=lambda x: (x[0], order[x[2]]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document with its secrets; offsets are code points, ends exclusive.

    A document is one row's work, and no row meets another, so nothing is shuffled and a
    lost task is simply run again.

    A null or empty text has no spans; a long one is scanned whole; repeated rows give
    repeated rows; an empty table gives none; other columns of ``docs`` are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate((*BASE_KINDS, *(c.kind for c in ENTROPY_CLASSES)))}
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, added = secret_spans(text) if text else ([], [])
                kinds = [k for _, _, k in base]
                rows.append(
                    (
                        *(kinds.count(k) for k in BASE_KINDS),
                        hashlib.sha256(_joined(base).encode()).hexdigest(),
                        _joined(sorted(base + added, key=lambda x: (x[0], order[x[2]]))),
                        len(added),
                    )
                )
            columns = zip(*rows, strict=True) if rows else [[] for _ in SCHEMA.names[1:]]
            arrays = [pa.array(list(c), type=to_arrow_type(f.dataType)) for c, f in zip(columns, SCHEMA.fields[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=SCHEMA.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)
