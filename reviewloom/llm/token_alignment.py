"""Alignment of two tokenizers by a dictionary of token groups."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed

TOKENIZERS = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# How byte-level vocabularies split a text, and the token that isn't made by merges.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDING = "<|endoftext|>"
#: A block of documents ends at so many characters, or so many groups; characters tokenized in one go.
CHARS_PER_BLOCK, GROUPS_PER_BLOCK, CHARS_AT_ONCE = 16 << 20, 400_000, 1 << 20
#: Where both tokenizers must cut: before a single space between two other signs.
CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
ROWS_PER_BATCH = 5000
IDS = pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())]))
STATS = pa.schema(
    [
        ("block", pa.int64()),
        # a document, its id written out so that any one survives pandas
        ("doc_id", pa.string()),
        *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
        ("groups_sha256", pa.string()),
        ("held", pa.binary()),
        # a group of the block
        ("gid", pa.int32()),
        ("name", pa.string()),
        ("a", IDS),
        ("b", IDS),
        # a linked pair and how many of the block's documents hold it
        ("a_id", pa.int32()),
        ("b_id", pa.int32()),
        ("docs", pa.int64()),
    ]
)
STATS_DDL = (
    "block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, "
    "gid int, name string, a array<struct<id:int,n:long>>, b array<struct<id:int,n:long>>, a_id int, b_id int, docs long"
)
DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held"]
SCORED = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"

Group = tuple[tuple[int, ...], tuple[int, ...]]


class Aligner:
    """Groups of token ids of both tokenizers; each task loads it once."""

    def __init__(self, folder: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        byte_bpe = Tokenizer.from_file(f"{folder}/{BYTE_FILE}")
        byte_bpe.encode_special_tokens = True
        model = json.loads(byte_bpe.to_str())["model"]
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_FILE}")
        # byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in plain]
        sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        decoded = {i: bytes(sign[c] for c in entry) for entry, i in byte_bpe.get_vocab(False).items() if all(c in sign for c in entry)}
        self.a_bytes = [decoded.get(i, b"") for i in range(max(decoded) + 1)]
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_flat, self.b_flat = _flat(self.a_bytes), _flat(self.b_bytes)
        # a piece with a space behind another sign could cross a cut
        self.cuts = not any(re.search("[^▁]▁", p) for p in names)
        # where each merge makes the token next in number, numbers are ranks, and a faster reader of ranks says the same
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        firsts = [model["vocab"].get(m) for m in made]
        is_ranked = firsts == sorted(set(firsts) - {None}) and len(made) + 256 == len(decoded) - (ENDING in model["vocab"])
        if is_ranked:
            ranks = {entry: i for i, entry in decoded.items() if i != model["vocab"].get(ENDING)}
            self.a_ids = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            self.a_ids = lambda text: byte_bpe.encode(text, add_special_tokens=False).ids
        self.byte_bpe = byte_bpe

    def parts(self, text: str, size: int) -> list[str]:
        """Parts of space+text of about ``size``, cut where no token of either kind can reach over. Parts start
        with a space; where signs of U+2581, which the pieces write for a space, stand, nothing is cut."""
        whole, start, out = " " + text, 0, []
        while self.cuts and len(whole) - start > size:
            found = CUT.search(whole, start + size)
            if not found:
                break
            out.append(whole[start : found.start()])
            start = found.start()
        return [*out, whole[start:]]

    def tokens(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Tokens of parts by both, and whether they give back its bytes."""
        a = [self.a_ids(x) for x in parts]
        b = self.pieces.encode([x[1:] for x in parts], num_threads=1)
        whole = [x.encode("utf-8", "surrogatepass") for x in parts]
        return a, b, [x and y for x, y in zip(_same(a, whole, *self.a_flat), _same(b, whole, *self.b_flat), strict=True)]


def _flat(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries' bytes one behind the other, where each starts, and its size."""
    size = np.array([len(x) for x in entries], dtype=np.int64)
    return np.frombuffer(b"".join(entries), dtype=np.uint8), np.cumsum(size) - size, size


def _ids(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=sum(map(len, lists)))


def _same(lists: list[list[int]], whole: list[bytes], entries: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bool]:
    """Whether each list's tokens, joined, are its bytes."""
    same = []
    for ids, text in zip(lists, whole, strict=True):
        ids = np.array(ids, dtype=np.int64)
        sizes = size[ids]
        ends = np.cumsum(sizes)
        if len(ids) == 0 or ends[-1] != len(text):
            same.append(not len(ids) and not text)
            continue
        joined = entries[np.repeat(start[ids] - ends + sizes, sizes) + np.arange(len(text))]
        same.append(bool((joined == np.frombuffer(text, dtype=np.uint8)).all()))
    return same


@lru_cache(1)
def aligner(folder: str) -> Aligner:
    return Aligner(folder)


class Block:
    """Groups of a run of documents, each met group once, with a number of its own."""

    def __init__(self, number: int, find: Aligner) -> None:
        self.number, self.find, self.chars = number, find, 0
        self.gids: dict[Group, int] = {}
        self.names: list[str] = []
        self.links: list[list[int]] = []
        self.pairs: dict[tuple[int, int], int] = {}
        self.docs_of = np.zeros(0, dtype=np.int64)
        self.docs: list[tuple] = []

    def number_of(self, group: Group) -> int:
        """A group's number. A new one's links are spelled out, once however often it occurs."""
        gid = self.gids.get(group)
        if gid is None:
            gid = self.gids[group] = len(self.names)
            a, b = group
            self.names.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
            self.links.append([self.pairs.setdefault(pair, len(self.pairs)) for pair in product(set(a), set(b))])
        return gid

    def _grouped(self, parts: list[str]) -> list[tuple[np.ndarray, int, int, int] | None]:
        """Of each part the numbers of its groups in order and n_a, n_b, n_links; None if it has no tokens.

        The parts' ends are ends of tokens of both kinds, so groups are found over all parts at once."""
        a_lists, b_lists, good = self.find.tokens(parts)
        a_lists, b_lists = ([x for x, ok in zip(lists, good, strict=True) if ok] for lists in (a_lists, b_lists))
        a, b = _ids(a_lists), _ids(b_lists)
        a_ends, b_ends = np.cumsum(self.find.a_flat[2][a]), np.cumsum(self.find.b_flat[2][b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_to, b_to = np.searchsorted(a_ends, ends) + 1, np.searchsorted(b_ends, ends) + 1
        a_from, b_from = (np.concatenate([[0], x[:-1]]) if len(x) else x for x in (a_to, b_to))
        n_a, n_b = a_to - a_from, b_to - b_from
        numbers = np.empty(len(ends), dtype=np.int64)
        single = (n_a == 1) & (n_b == 1)
        keys, which = np.unique(a[a_from[single]] << 32 | b[b_from[single]], return_inverse=True)
        numbers[single] = np.array([self.number_of(((k >> 32,), (k & 0xFFFFFFFF,))) for k in keys.tolist()], dtype=np.int64)[which]
        several = np.nonzero(~single)[0]
        for i, p, q, r, s in zip(several.tolist(), *(x[several].tolist() for x in (a_from, a_to, b_from, b_to)), strict=True):
            numbers[i] = self.number_of((tuple(a[p:q].tolist()), tuple(b[r:s].tolist())))
        upto = np.concatenate([[0], np.searchsorted(a_to, np.cumsum([len(x) for x in a_lists]))]).astype(np.int64)
        found = iter(range(len(a_lists)))
        out: list[tuple[np.ndarray, int, int, int] | None] = []
        for ok in good:
            if not ok:
                out.append(None)
                continue
            k = next(found)
            part = slice(upto[k] if k == 0 else upto[k] + 1, upto[k + 1] + 1)
            out.append((numbers[part], len(a_lists[k]), len(b_lists[k]), int(n_a[part] @ n_b[part])))
        return out

    def add(self, rows: list[tuple[str | None, str | None]], at_once: int = CHARS_AT_ONCE) -> None:
        """Takes documents (doc_id, text) in."""
        waiting: list[tuple[int, str]] = []
        found: list[list[tuple[np.ndarray, int, int, int] | None]] = [[] for _ in rows]
        held = 0

        def read() -> None:
            for (i, _), groups in zip(waiting, self._grouped([x for _, x in waiting]), strict=True):
                found[i].append(groups)
            waiting.clear()

        for i, (_, text) in enumerate(rows):
            for part in self.find.parts(text, at_once) if text else ():
                if waiting and held + len(part) > at_once:
                    read()
                    held = 0
                waiting.append((i, part))
                held += len(part)
        if waiting:
            read()
        seen: list[np.ndarray] = []
        for (doc_id, text), parts in zip(rows, found, strict=True):
            self.chars += len(text or "")
            if not parts or None in parts:
                self.docs.append((doc_id, 0, 0, 0, 0, "", b""))
                continue
            numbers = np.concatenate([p[0] for p in parts])
            times = np.stack(np.unique(numbers, return_counts=True))
            seen.append(times[0])
            written = ";".join([self.names[n] for n in numbers.tolist()])
            sha = hashlib.sha256(written.encode()).hexdigest()
            packed = zlib.compress(times.astype("<u4").tobytes(), 1)
            self.docs.append((doc_id, *(sum(p[k] for p in parts) for k in (1, 2)), len(numbers), sum(p[3] for p in parts), sha, packed))
        self._count(seen)

    def _count(self, seen: list[np.ndarray]) -> None:
        """Counts for every linked pair the documents that hold it, by the different groups of each."""
        sizes = np.array([len(x) for x in self.links], dtype=np.int64)
        flat, start = _ids(self.links), np.cumsum(sizes) - sizes
        counted = np.zeros(len(self.pairs), dtype=np.int64)
        counted[: len(self.docs_of)] = self.docs_of
        for numbers in seen:
            n = sizes[numbers]
            held = flat[np.repeat(start[numbers] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            counted[held if len(held) == len(numbers) and (n == 1).all() else np.unique(held)] += 1
        self.docs_of = counted

    def rows(self) -> Iterator[dict]:
        """Its documents, groups and pairs, each with the columns it has."""
        for doc in self.docs:
            yield {"block": self.number} | dict(zip(DOC, doc, strict=True))
        for group, gid in self.gids.items():
            a, b = ([{"id": i, "n": n} for i, n in Counter(ids).items()] for ids in group)
            yield {"block": self.number, "gid": gid, "name": self.names[gid], "a": a, "b": b}
        for (a_id, b_id), n in zip(self.pairs, self.docs_of.tolist(), strict=True):
            if n:  # a part of a text without tokens may have named others
                yield {"a_id": a_id, "b_id": b_id, "docs": n}


def blocks_of(batches: Iterator[pa.RecordBatch], folder: str, chars: int = CHARS_PER_BLOCK, most: int = GROUPS_PER_BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows of all blocks that a task makes of its documents (doc_id, text)."""
    task, find = TaskContext.get(), aligner(folder)
    first = (task.partitionId() if task else 0) << 33

    def closed(block: Block) -> Iterator[pa.RecordBatch]:
        rows = block.rows()
        while part := list(islice(rows, ROWS_PER_BATCH)):
            yield pa.RecordBatch.from_pylist(part, schema=STATS)

    block = Block(first, find)
    for batch in batches:
        waiting, held = [], 0
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            waiting.append(row)
            held += len(row[1] or "")
            if held >= CHARS_AT_ONCE or block.chars + held >= chars:
                block.add(waiting)
                waiting, held = [], 0
            if block.chars >= chars or len(block.gids) >= most:
                yield from closed(block)
                block = Block(block.number + 1, find)
        if waiting:
            block.add(waiting)
    yield from closed(block)


def _scored(docs: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """n_best and count_sum of a block's documents, by the values of the block's groups."""
    best, total = (np.zeros(int(values["gid"].max()) + 1 if len(values) else 0, dtype=np.int64) for _ in range(2))
    best[values["gid"]], total[values["gid"]] = values["best"], values["total"]
    sums = []
    for held in docs["held"]:
        gids, n = np.frombuffer(zlib.decompress(held), dtype="<u4").reshape(2, -1).astype(np.int64) if held else np.zeros((2, 0), dtype=np.int64)
        sums.append((int(best[gids] @ n), int(total[gids] @ n)))
    return docs.drop(columns=["block", "held"]).assign(n_best=[x for x, _ in sums], count_sum=[x for _, x in sums])


def align_tokenizers(docs: DataFrame, folder: str = TOKENIZERS, chars_per_block: int = CHARS_PER_BLOCK) -> DataFrame:
    """doc_id and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    Each task tokenizes its texts by both vocabularies, long ones in parts, and cuts them into groups where
    tokens of both end. A block of documents (of a set size) numbers its different
    groups, spells out the links of each once, and counts for every linked pair the documents that
    hold it. Blocks' counts of pairs are added up. Different groups of all blocks are expanded into links once, joined
    with the counts, and summed to a value a group; the values go back to every block by the
    group's name, and the documents' sums follow from their numbers of each group. A frequent group or pair has a row for each
    block, not for each document.

    Texts that are null or empty, or that the tokens of either vocabulary don't give back byte by
    byte (as those with U+2581), have zeros and an empty groups_sha256; they count in no pair.
    Repeated rows and rows without doc_id are documents like others. A text of any length is one row of one block. Empty
    tables give no rows; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("string"), "text")
    # written once: a block's numbers are those of the task that made it
    stats = checkpointed(texts.mapInArrow(lambda batches: blocks_of(batches, folder, chars_per_block), STATS_DDL))
    pairs = stats.filter("docs is not null").groupBy("a_id", "b_id").agg(F.sum("docs").alias("docs"))
    pairs = checkpointed(pairs)
    highest = pairs.groupBy("a_id").agg(F.max("docs").alias("highest"))
    pairs = pairs.join(highest, "a_id").select("a_id", "b_id", "docs", (F.col("docs") == F.col("highest")).cast("long").alias("is_best"))
    groups = stats.filter("gid is not null")
    links = (
        groups.groupBy("name")
        .agg(F.first("a").alias("a"), F.first("b").alias("b"))
        .select("name", F.explode("a").alias("a"), "b")
        .select("name", "a", F.explode("b").alias("b"))
        .select("name", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), (F.col("a.n") * F.col("b.n")).alias("n"))
    )
    values = links.join(pairs, ["a_id", "b_id"]).groupBy("name").agg(F.sum(F.col("n") * F.col("is_best")).alias("best"), F.sum(F.col("n") * F.col("docs")).alias("total"))
    valued = groups.select(F.col("block").alias("of"), "gid", "name").join(values, "name").select("of", "gid", "best", "total")
    held = stats.filter("groups_sha256 is not null").select("block", *DOC)
    scored = held.groupBy("block").cogroup(valued.groupBy("of")).applyInPandas(_scored, SCORED)
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
