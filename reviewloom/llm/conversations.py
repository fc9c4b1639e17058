"""Repair of a conversation's structure by cheapest edits."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed

#: A piece of a conversation ends at so many rows, or so many bytes of texts.
ROWS_PER_PIECE, BYTES_PER_PIECE = 65_536, 16 << 20
#: Costs of edits, and what a truncated row adds that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States of a repaired conversation: empty, after system, after user, after assistant. What follows each.
NEXT = ((1, "s"), (2, "u")), ((2, "u"),), ((3, "a"),), ((2, "u"),)
#: Where a conversation may end, and what the inserts cost that end it from every state.
ENDS = (0, 6, 3, 0)
FAR = 1 << 60
WHITE, STOPS = "\x20\t\n\x0b\f\r", ".!?"
ROLES = {"u": "user", "a": "assistant"}
STATES = range(4)
#: A row's code: role initial (0 other, 1 s, 2 u, 3 a), 4 if truncated, 8 if it has to go.
INITIALS = {"s": 1, "u": 2, "a": 3}
TRUNCATED, GONE = 4, 8


def _arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(edit, state, next state, cost) of all edits that use up a row of this code."""
    cut = CUT if code & TRUNCATED else 0
    arcs = [("D", s, s, DELETE) for s in STATES]
    if not code & GONE:
        initial = " sua"[code & 3]
        for s in STATES:
            arcs += [("K", s, t, KEEP + cut) for t, sign in NEXT[s] if sign == initial]
            arcs += [("R", s, t, REROLE + cut) for t, sign in NEXT[s] if sign != "s"]
    return arcs


ROW_ARCS = [_arcs(code) for code in range(16)]
INSERT_ARCS = [("I", s, t, INSERT) for s in STATES for t, sign in NEXT[s] if sign != "s"]
#: By code and state that is come to: where from and at what cost.
INTO_ROW = [[[(s, c) for _, s, to, c in arcs if to == t] for t in STATES] for arcs in ROW_ARCS]
INTO_INSERT = [[(s, c) for _, s, to, c in INSERT_ARCS if to == t] for t in STATES]
#: By code and state: edits in the order of their letters.
OUT = [[sorted((e, t, c, e != "I") for e, s, t, c in [*arcs, *INSERT_ARCS] if s == at) for at in STATES] for arcs in ROW_ARCS]
BUCKETS = REROLE + CUT + 1


def distances(codes: bytes, ends: tuple[int, ...]) -> array:
    """What it costs to come from every node to the end of a piece, by Dial's queue of buckets.

    Node 4 i + s stands before row i in state s; ``ends`` tells what remains after the last row from
    each state. Costs are small whole numbers, so nodes of the next few distances lie in a ring
    of as many buckets, taken in turn; a node is settled when it is first taken out.
    """
    last = 4 * len(codes)
    known = array("q", [FAR]) * (last + 4)
    waiting = sorted((end, last + s) for s, end in enumerate(ends) if end < FAR)
    ring: list[list[int]] = [[] for _ in range(BUCKETS)]
    held, now = 0, waiting[0][0] if waiting else 0
    waiting.reverse()
    settled = bytearray(last + 4)
    while held or waiting:
        if not held:
            now = waiting[-1][0]
        while waiting and waiting[-1][0] == now:
            node = waiting.pop()[1]
            if known[node] > now:
                known[node] = now
                ring[now % BUCKETS].append(node)
                held += 1
        bucket = ring[now % BUCKETS]
        while bucket:
            node = bucket.pop()
            held -= 1
            if settled[node]:
                continue
            settled[node] = 1
            i, t = divmod(node, 4)
            if i:
                row = node - t - 4
                for s, cost in INTO_ROW[codes[i - 1]][t]:
                    if now + cost < known[row + s]:
                        known[row + s] = now + cost
                        ring[(now + cost) % BUCKETS].append(row + s)
                        held += 1
            if node < last:
                for s, cost in INTO_INSERT[t]:
                    if now + cost < known[node - t + s]:
                        known[node - t + s] = now + cost
                        ring[(now + cost) % BUCKETS].append(node - t + s)
                        held += 1
        now += 1
    return known


def tight_walk(codes: bytes, known: array, state: int) -> tuple[str, int]:
    """The least string of edits whose every step is as cheap as ``known`` allows, and the state it ends in."""
    edits, i = [], 0
    while i < len(codes):
        left = known[4 * i + state]
        for edit, to, cost, uses in OUT[codes[i]][state]:
            if left == cost + known[4 * (i + uses) + to]:
                edits.append(edit)
                state, i = to, i + uses
                break
        else:
            raise ValueError("no tight arc")
    return "".join(edits), state


def closing(state: int) -> str:
    """The inserts that end a conversation."""
    return "I" * (ENDS[state] // INSERT)


def repaired(edits: str, rows: Iterator[tuple[str, str]], state: int) -> Iterator[str]:
    """``role:text`` of what the edits leave of the rows (role, text), and of what they put in."""
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = next(t for t, sign in NEXT[state] if sign == role[:1])
        else:
            state, sign = next((t, sign) for t, sign in NEXT[state] if sign != "s")
            role = ROLES[sign]
        yield f"{role}:{text}"


def closing_lines(state: int) -> list[str]:
    lines = []
    for _ in closing(state):
        state, sign = next((t, sign) for t, sign in NEXT[state] if sign != "s")
        lines.append(f"{ROLES[sign]}:")
    return lines


def code_of(role: str, text: str) -> int:
    """A row's code, its repeats apart."""
    stripped = text.rstrip(WHITE)
    return INITIALS.get(role[:1], 0) | (GONE if not stripped else 0 if stripped[-1] in STOPS else TRUNCATED)


def is_legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


COUNTS = ["low", "high", "turns", "blank", "duplicate", "truncated", "illegal"]
READ = pa.schema(
    [
        ("conv", pa.string()),
        ("task", pa.int64()),
        ("piece", pa.int32()),
        *[(c, pa.int64()) for c in COUNTS],
        # a whole conversation
        ("cost", pa.int64()),
        ("audit", pa.string()),
        ("repaired_sha256", pa.string()),
        # a piece of one
        ("codes", pa.binary()),
        ("first_role", pa.string()),
        ("last_role", pa.string()),
        # a row of a piece; its digest where it isn't blank and the first of its kind there
        ("at", pa.int32()),
        ("role", pa.string()),
        ("text", pa.string()),
        ("digest", pa.binary()),
    ]
)
READ_DDL = (
    "conv string, task long, piece int, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string, codes binary, first_role string, last_role string, at int, role string, text string, digest binary"
)


class Piece:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv: str, number: int) -> None:
        self.conv, self.number, self.size = conv, number, 0
        self.rows: list[tuple[str, str]] = []
        self.codes, self.digests = bytearray(), []
        self.seen: set[bytes] = set()
        self.counts = dict.fromkeys(COUNTS, 0) | {"low": None, "high": None}

    def add(self, turn: int | None, role: str, text: str) -> None:
        counts, code = self.counts, code_of(role, text)
        if turn is not None and turn != counts["high"]:
            counts["low"], counts["high"] = turn if counts["low"] is None else counts["low"], turn
            counts["turns"] += 1
        if self.rows and not is_legal(self.rows[-1][0], role):
            counts["illegal"] += 1
        digest = None
        if code & GONE:
            counts["blank"] += 1
        else:
            digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if digest in self.seen:
                counts["duplicate"] += 1
                code, digest = code & 3 | GONE, None
            else:
                self.seen.add(digest)
                counts["truncated"] += code & TRUNCATED == TRUNCATED
        self.rows.append((role, text))
        self.codes.append(code)
        self.digests.append(digest)
        self.size += len(text)

    def solved(self) -> dict:
        """The result of a conversation that is this piece alone."""
        known = distances(bytes(self.codes), ENDS)
        edits, state = tight_walk(bytes(self.codes), known, 0)
        lines = [*repaired(edits, iter(self.rows), 0), *closing_lines(state)]
        sha = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
        return {"conv": self.conv, **self.counts, "cost": known[0], "audit": edits + closing(state), "repaired_sha256": sha}

    def parts(self, task: int) -> Iterator[dict]:
        """The piece and its rows, to be joined with others."""
        key = {"conv": self.conv, "task": task, "piece": self.number}
        ends = {"first_role": self.rows[0][0], "last_role": self.rows[-1][0]} if self.rows else {}
        yield {**key, **self.counts, "codes": bytes(self.codes), **ends}
        for i, ((role, text), digest) in enumerate(zip(self.rows, self.digests, strict=True)):
            yield {**key, "at": i, "role": role, "text": text, "digest": digest}


def read_sorted(batches: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie within a task's sorted rows; pieces and rows of the first and
    the last, which neighbours may share, and of those too long to be held."""
    found = _read_sorted(batches, most_rows, most_bytes)
    for part in iter(lambda: list(_upto(found, 1000, 8 << 20)), []):
        yield pa.RecordBatch.from_pylist(part, schema=READ)


def _upto(rows: Iterator[dict], most: int, size: int) -> Iterator[dict]:
    for row in rows:
        yield row
        most, size = most - 1, size - len(row.get("text") or "") - len(row.get("audit") or "") - len(row.get("codes") or b"")
        if most <= 0 or size <= 0:
            return


def _read_sorted(batches: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[dict]:
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    now, is_cut = None, True
    for batch in batches:
        for conv, turn, role, text, absent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None:
                now = Piece(conv, 0)
            elif conv != now.conv:
                yield from now.parts(task) if is_cut else [now.solved()]
                now, is_cut = Piece(conv, 0), False
            elif len(now.rows) >= most_rows or now.size >= most_bytes:
                yield from now.parts(task)
                now, is_cut = Piece(conv, now.number + 1), True
            if not absent:
                now.add(turn, role, text)
    if now is not None:
        yield from now.parts(task)


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, absent: the rows as their crc32 damages them; ``absent`` are those dropped,
    kept to name their conversation. ``conv`` is the id behind a sign, empty for null."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", name("conv_id"), name("turn")).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(name("text"), STOPS, "")).otherwise(name("text"))
    shown = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(name("role")).alias("role"),
        text.alias("text"),
        (kind == 0).alias("absent"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("again"),
    )
    return shown.drop("again")


def _patched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces with the repeats of earlier pieces marked, and what it costs from each state before a piece to each after it."""
    for batch in batches:
        rows = []
        for row in batch.to_dict("records"):
            codes = bytearray(row["codes"])
            gone = [] if row["gone"] is None else row["gone"]
            cut = sum(codes[i] & TRUNCATED == TRUNCATED for i in gone)
            for i in gone:
                codes[i] = codes[i] & 3 | GONE
            ends = [ENDS] if row["last"] else [tuple(0 if s == t else FAR for t in STATES) for s in STATES]
            through = [[int(x) for x in distances(bytes(codes), e)[:4]] for e in ends]
            rows.append((row["conv"], row["task"], row["piece"], row["last"], bytes(codes), len(gone), cut, [x for y in through for x in y]))
        yield pd.DataFrame(rows, columns=["conv", "task", "piece", "last", "codes", "again", "uncut", "through"])


def _ends(pieces: pd.DataFrame) -> pd.DataFrame:
    """What remains to be paid after each piece of a conversation, from each state, and at its start."""
    pieces = pieces.sort_values(["task", "piece"], ascending=False)
    after, out = list(ENDS), []
    for conv, task, piece, last, through in zip(*(pieces[c] for c in ("conv", "task", "piece", "last", "through")), strict=True):
        costs = np.asarray(through, dtype=np.int64)
        before = costs if last else (costs.reshape(4, 4) + np.array(after)[:, None]).min(axis=0)
        out.append((conv, task, piece, after, int(before[0])))
        after = [int(x) for x in before]
    return pd.DataFrame(out, columns=["conv", "task", "piece", "ends", "remains"])


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From each state before a piece the edits and the state after it."""
    for batch in batches:
        rows = []
        for row in batch.to_dict("records"):
            codes = bytes(row["codes"])
            known = distances(codes, tuple(int(x) for x in row["ends"]))
            ways = [tight_walk(codes, known, s) if known[s] < FAR else ("", -1) for s in STATES]
            ways = [(edits + closing(s) if row["last"] and s >= 0 else edits, s) for edits, s in ways]
            rows.append((row["conv"], row["task"], row["piece"], row["last"], [e for e, _ in ways], [s for _, s in ways]))
        yield pd.DataFrame(rows, columns=["conv", "task", "piece", "last", "ways", "states"])


def _entered(pieces: pd.DataFrame) -> pd.DataFrame:
    """The state before each piece of a conversation."""
    pieces = pieces.sort_values(["task", "piece"])
    state, out = 0, []
    for conv, task, piece, states in zip(*(pieces[c] for c in ("conv", "task", "piece", "states")), strict=True):
        out.append((conv, task, piece, state))
        state = int(states[state])
    return pd.DataFrame(out, columns=["conv", "task", "piece", "state"])


def _rendered(rows: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    """The repaired lines of a piece, null if it has none."""
    piece = pieces.iloc[0]
    rows = rows.sort_values("at")
    state, edits, ending = int(piece["state"]), piece["audit"], []
    after = int(piece["after"])
    if piece["last"]:
        edits, ending = edits[: len(edits) - len(closing(after))], closing_lines(after)
    lines = [*repaired(edits, zip(rows["role"], rows["text"], strict=True), state), *ending]
    made = "\n".join(lines) if lines else None
    return pd.DataFrame([(piece["conv"], piece["task"], piece["piece"], made)], columns=["conv", "task", "piece", "lines"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come piece by piece in order."""
    conv, sha, begun = None, hashlib.sha256(), False
    row = lambda: pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": sha.hexdigest()}], schema=pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())]))
    for batch in batches:
        for name, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if conv is not None and name != conv:
                yield row()
                sha, begun = hashlib.sha256(), False
            conv = name
            if lines is not None:
                sha.update((b"\n" if begun else b"") + lines.encode("utf-8", "surrogatepass"))
                begun = True
    if conv is not None:
        yield row()


def _joined(read: DataFrame) -> DataFrame:
    """Results of the conversations that were read in pieces."""
    key = ["conv", "task", "piece"]
    rows = read.filter("at is not null")
    order = Window.partitionBy("conv").orderBy("task", "piece")
    # a piece may have no rows left, or none with a turn
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pieces = read.filter("codes is not null").select(
        *key, "codes", *COUNTS, F.lead("task").over(order).isNull().alias("last"),
        F.coalesce(F.last("high", ignorenulls=True).over(before) == F.col("low"), F.lit(False)).alias("same_turn"),
        F.last("last_role", ignorenulls=True).over(before).alias("role_before"), "first_role",
    )
    # a row whose like stands in an earlier piece; a piece names each kind of row once
    place = Window.partitionBy("conv", "digest").orderBy("task", "piece")
    gone = rows.filter("digest is not null").select(*key, "at", F.row_number().over(place).alias("n")).filter("n > 1").groupBy(*key).agg(F.collect_list("at").alias("gone"))
    patched = checkpointed(
        pieces.select(*key, "codes", "last")
        .join(gone, key, "left")
        .mapInPandas(_patched, "conv string, task long, piece int, last boolean, codes binary, again long, uncut long, through array<long>")
    )
    ends = patched.select(*key, "last", "through").groupBy("conv").applyInPandas(_ends, "conv string, task long, piece int, ends array<long>, remains long")
    walked = checkpointed(
        patched.select(*key, "last", "codes").join(ends, key).mapInPandas(_walked, "conv string, task long, piece int, last boolean, ways array<string>, states array<int>")
    )
    entered = walked.select(*key, "states").groupBy("conv").applyInPandas(_entered, "conv string, task long, piece int, state int")
    ways = checkpointed(
        walked.join(entered, key).select(*key, "last", "state", F.element_at("ways", F.col("state") + 1).alias("audit"), F.element_at("states", F.col("state") + 1).alias("after"))
    )
    named = ways.select(F.col("conv").alias("c"), F.col("task").alias("t"), F.col("piece").alias("p"), *ways.columns)
    lines = rows.select(*key, "at", "role", "text").groupBy(*key).cogroup(named.groupBy("c", "t", "p")).applyInPandas(_rendered_or_empty, "conv string, task long, piece int, lines string")
    sha = lines.repartition("conv").sortWithinPartitions(*key).select("conv", "lines").mapInArrow(_hashed, "conv string, repaired_sha256 string")
    illegal = F.col("illegal") + F.when(F.col("role_before").isNull() | F.col("first_role").isNull(), 0).when(
        F.concat(F.substring("role_before", 1, 1), F.substring("first_role", 1, 1)).isin("su", "ua", "au"), 0
    ).otherwise(1)
    counted = (
        pieces.join(patched.select(*key, "again", "uncut"), key)
        .join(ends.select(*key, "remains"), key)
        .groupBy("conv")
        .agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.col("turns") - F.col("same_turn").cast("long")).alias("turns"), F.sum("blank").alias("blank"),
            F.sum(F.col("duplicate") + F.col("again")).alias("duplicate"), F.sum(F.col("truncated") - F.col("uncut")).alias("truncated"), F.sum(illegal).alias("illegal"),
            F.min_by("remains", F.struct("task", "piece")).alias("cost"),
        )
    )
    audits = ways.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task", "piece", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    return counted.join(audits, "conv").join(sha, "conv")


def _rendered_or_empty(rows: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    return _rendered(rows, pieces) if len(pieces) else pd.DataFrame(columns=["conv", "task", "piece", "lines"])


def repair_conversations(rows: DataFrame, rows_per_piece: int = ROWS_PER_PIECE, bytes_per_piece: int = BYTES_PER_PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation
    of the rows (conv_id, turn, role, text), after the damage that their crc32 says.

    Rows are sorted by conversation and place over all tasks. A task settles the conversations that lie
    within its share: distances by Dial's buckets over (row, state), back from the end, then the least tight walk. The first and
    the last of a share, and those beyond a piece's size, are cut into pieces. A piece tells what it costs from each state
    before it to each after it; these small tables are joined from the end, each piece walks, and the walks are
    joined from the start. So a conversation of any length is spread over tasks; only its small
    tables, the audit, which is one value of its row, and the stream of bytes into its SHA-256, which knows no other order, are one task's.

    Rows stand by turn, nulls first, then by role and text (its first 256 signs, then its MD5); equal rows are
    interchangeable, so ties don't matter there. Nulls are one space: such a role is none of the three and never kept. Null
    conv_ids are one conversation. Turns that repeat count once for gaps. Empty tables give no rows; other columns are ignored.
    """
    head = F.substring("text", 1, 256)
    place = [F.col("conv"), F.col("turn"), F.col("role"), head, F.md5(F.col("text").cast("binary"))]
    shares = damaged(rows).repartitionByRange(*place).sortWithinPartitions(*place)
    read = checkpointed(shares.mapInArrow(lambda batches: read_sorted(batches, rows_per_piece, bytes_per_piece), READ_DDL))
    shown = ["conv", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = read.filter("repaired_sha256 is not null").select(*shown).unionByName(_joined(read).select(*shown))
    return found.select(
        F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        *shown[4:],
    )
