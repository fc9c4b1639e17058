"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal_spans(text: str) -> list[tuple[int, int, int, str]]:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if ok:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def secret_base(text: str) -> list[tuple[int, int, int, str]]:
    found = []
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
    for m in assign.finditer(text or ""):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    for rank, pattern, least, kind in ((1, r"AKIA[A-Z0-9]+", 16, "access"), (2, r"[0-9a-f]+", 32, "hex")):
        for m in re.finditer(pattern, text or ""):
            if len(m[0]) >= least:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(sets: dict[int, frozenset]) -> dict[int, int]:
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: find(i) for i in ids}


def repeats(texts: dict[int, str | None]) -> dict[int, list[bool]]:
    data = {i: (t or "").encode() for i, t in texts.items()}
    first: dict[bytes, int] = {}
    for i in sorted(data):
        for k in range(len(data[i]) - 49):
            first.setdefault(data[i][k : k + 50], i)
    out = {}
    for i, b in data.items():
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        out[i] = gone
    return out


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def contamination(text: str | None, items: dict[int, str | None]) -> tuple[int, int, list[str]]:
    def words(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    w, hit, found = words(text), set(), set()
    for item, t in items.items():
        v = words(t)
        for s in range(max(1, len(v) - 12) if v else 0):
            window = v[s : s + 13]
            for p in range(len(w) - len(window) + 1):
                if w[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)
