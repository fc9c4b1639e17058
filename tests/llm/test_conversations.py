"""Repair of conversations, held against a search of all ways."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import conversations
from reviewloom.llm.conversations import ENDS, distances, repair_conversations, tight_walk

SCHEMA = "conv_id long, turn long, role string, text string, task string, piece int, codes int"
WHITE = " \t\n\x0b\f\r"
NEXT, TO, NAMES = {0: "su", 1: "u", 2: "a", 3: "u"}, {"s": 1, "u": 2, "a": 3}, {"u": "user", "a": "assistant"}


def shown(value):
    return " " if value is None else str(value)


def damage(rows):
    found = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else shown(role), "" if kind == 1 else shown(text)
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        found.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return found


def ways(rows, faults):
    """Cost, audit and lines of the best way from the start, by all ways from every row and state."""
    after = {0: (0, "", ()), 1: (6, "II", ("user:", "assistant:")), 2: (3, "I", ("assistant:",)), 3: (0, "", ())}
    for (_, role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        here = {s: [(4 + after[s][0], "D" + after[s][1], after[s][2])] for s in range(4)}
        for s in range(4):
            for sign in NEXT[s] if fault not in ("blank", "duplicate") else "":
                cost, audit, lines = after[TO[sign]]
                more = 3 * (fault == "truncated")
                if role[:1] == sign:
                    here[s].append((more + cost, "K" + audit, (f"{role}:{text}", *lines)))
                if sign != "s":
                    here[s].append((3 + more + cost, "R" + audit, (f"{NAMES[sign]}:{text}", *lines)))
        now = {s: min(x) for s, x in here.items()}
        for _ in range(6):
            for s in range(4):
                for sign in NEXT[s].replace("s", ""):
                    cost, audit, lines = now[TO[sign]]
                    now[s] = min(now[s], (3 + cost, "I" + audit, (f"{NAMES[sign]}:", *lines)))
        after = now
    return after[0]


def plain(rows):
    out = []
    for conv, found in damage(rows).items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()[:256], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in found:
            end = text.rstrip(WHITE)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        cost, audit, lines = ways(found, faults)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "and so", "", None, " \n", "é?", "\x85", "a.\n ", "x" * 3000, "😀 ok. "]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "sys", "umpire"]
    rows = [(rng.randrange(30), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += [(None, None, None, None)] * 3 + [(None, 2, "user", "Hm.")] + [(2**60 + 1, -5, "assistant", "Late.")] * 2
    rows += [(77, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(120)] + [(77, t, "user", "Same.") for t in range(30)]
    return rows + [(conv, 0, "user", "a") for conv in range(100, 160)]


def result(spark, rows, **given):
    table = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, repair_conversations(table, **given).collect()), key=repr)


@pytest.mark.parametrize("rows_per_piece, bytes_per_piece", [(65_536, 1 << 24), (3, 1 << 24), (50, 200)])
def test_repair_is_the_cheapest_and_least(spark, rows_per_piece, bytes_per_piece):
    rows = odd_rows()
    found = result(spark, rows, rows_per_piece=rows_per_piece, bytes_per_piece=bytes_per_piece)
    assert found == plain(rows)
    empty = [r for r in found if r[0] is not None and 100 <= r[0] < 160 and zlib.crc32(f"{r[0]}:0".encode()) % 20 == 0]
    assert empty and all(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in empty)


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds all rows is cut between tasks, repeats and illegal pairs over the cuts included."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"Turn {t}.", "cut", ""])) for t in range(600)]
    assert result(spark, rows) == plain(rows)
    table = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], SCHEMA)
    spread = conversations.damaged(table).repartitionByRange(4, "conv", "turn").select(F.spark_partition_id()).distinct().count()
    assert spread > 1


def test_tables_without_rows(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_buckets_give_shortest_paths():
    """Dial's distances are those that relaxing all arcs until nothing changes gives."""
    rng = random.Random(5)
    for _ in range(60):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 10]) for _ in range(rng.randrange(8)))
        known, nodes = distances(codes, ENDS), [(i, s) for i in range(len(codes) + 1) for s in range(4)]
        best = {n: ENDS[n[1]] if n[0] == len(codes) else 1 << 60 for n in nodes}
        for _ in range(4 * len(nodes)):
            for i, s in nodes[: 4 * len(codes)]:
                for _, t, cost, uses in conversations.OUT[codes[i]][s]:
                    best[i, s] = min(best[i, s], cost + best[i + uses, t])
        assert [best[n] for n in nodes] == list(known)
        edits, state = tight_walk(codes, known, 0)
        assert sum(e != "I" for e in edits) == len(codes) and state in range(4)
