"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash picks triggers in every text: of each window of WIDTH bytes the leftmost
GRAM-byte string with the smallest hash. Windows with one trigger make a phrase, the bytes
they cover. Which windows a phrase has depends on its bytes alone, so texts that share a
window share its trigger, at the same place in the window.

The phrases of all documents are the parse, the distinct ones the dictionary. A phrase that
a smaller document has too is repeated as a whole; the parse tells that without its bytes.
Only where a trigger has several phrases, the dictionary's bytes meet, and a suffix array of
them, to the depth of a window, tells which windows they share. Both combine, as each
dictionary phrase stands for its first document in the corpus.

What repeats within a task's share is settled there, and only its first document asks on. So
a phrase of any number of documents sends one posting a task at most. A trigger with more than
HOT_PHRASES phrases (those at the ends of a common passage) is settled by hashes of windows
instead, in the same two levels, so its phrases never meet in one task either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed, dealing_slots
from reviewloom.llm.shingles import BLOCK, dealt, mixed, posting_blocks, read_blocks

WIDTH, GRAM = 50, 16
_GRAMS = WIDTH - GRAM + 1  # of a window, and windows of a phrase at most
_SPAN = _GRAMS - 1 + WIDTH  # bytes of a phrase at most
_PHRASES = 16_000  # that are sorted at once
HOT_PHRASES = 4096  # of a trigger, above which its windows are compared by hash
_PIECE = 1 << 21  # windows of a text that are parsed at once
_BYTES_PER_BLOCK, BYTES_PER_SLOT = 16_000_000, 16_000_000
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_HOT = np.uint64(1 << 63)  # marks a phrase of a hot trigger; no window has this bit
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST_ID = np.iinfo(np.int64).max  # stands for a null doc_id

_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


class _Powers:
    """Powers of the base and of its inverse, as many as the longest piece has needed."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 16)
            cls.up, cls.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        return cls.up, cls.down


def _parsed(data: np.ndarray) -> tuple[np.ndarray, ...]:
    values = _BYTE_VALUES[data]
    grams, step = values, 1
    while step < GRAM:
        grams = grams[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + grams[step:]
        step *= 2
    grams = mixed(grams)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least, step = low, 1
    while step * 2 <= _GRAMS:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < _GRAMS:
        least = np.minimum(least[: len(least) - (_GRAMS - step)], least[_GRAMS - step :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(first[1:], len(at)) - 1
    trigger = at[first]
    up, down = _Powers.of(len(values) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * up[: len(values)])))
    whole = (sums[last + WIDTH] - sums[first]) * down[first]
    shape = (last - first).astype(np.uint64) * np.uint64(1000) + (trigger - first).astype(np.uint64)
    return first, last - first + 1, grams[trigger], mixed(whole ^ mixed(shape + np.uint64(1))), trigger - first


def parse(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """The phrases of a text: first window, number of windows, hash of the trigger, and of
    the phrase, and where in it the trigger is. Long texts are parsed in pieces, so memory stays bounded; at a cut a phrase
    falls in two, each of which is compared by its windows like any other."""
    parts, n = [], len(data) - WIDTH + 1
    for at in range(0, n, _PIECE):
        first, *rest = _parsed(data[at : min(at + _PIECE, n) + WIDTH - 1])
        parts.append((first + at, *rest))
    if not parts:
        parts = [tuple(np.empty(0, dtype=x) for x in (np.int64, np.int64, np.uint64, np.uint64, np.int64))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def owned(docs: DataFrame) -> DataFrame:
    """owner (the doc_id, or what stands for none, as pandas has no null among integers),
    known (whether there is one) and text."""
    owner = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID))
    return docs.select(owner.alias("owner"), F.col("doc_id").isNotNull().alias("known"), "text")


def named(rows: DataFrame) -> DataFrame:
    """``rows`` with doc_id for owner and known."""
    return rows.select(F.when(F.col("known"), F.col("owner")).alias("doc_id"), *[c for c in rows.columns if c not in {"owner", "known"}])


def _slot_of(tokens: np.ndarray, slots: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def prime_from(n: int) -> int:
    """The least prime that is n or more: as a number of slots it spreads ids of any stride."""
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _to_documents(owner: np.ndarray, phrase: np.ndarray, mask: np.ndarray, slots: int) -> pd.DataFrame:
    """Blocks of (phrase, mask) dealt by document."""
    order = np.argsort(owner, kind="stable")
    owners, counts = np.unique(owner, return_counts=True)
    slot = np.repeat(owners % slots, counts)
    return posting_blocks(owners, np.zeros(len(owners)), counts, phrase[order], slot, mask[order])


def _not_first(owner: np.ndarray, *key: np.ndarray) -> np.ndarray:
    """Which postings have a key that a smaller owner has too."""
    order = np.lexsort((owner, *key))
    new = np.zeros(len(owner), dtype=bool)
    new[:1] = True
    for x in key:
        new[1:] |= x[order[1:]] != x[order[:-1]]
    found = np.zeros(len(owner), dtype=bool)
    found[order] = owner[order] > owner[order][new][np.cumsum(new) - 1] if len(owner) else False
    return found


def _shifted(blocks: pd.DataFrame, by: int) -> pd.DataFrame:
    """Blocks whose slots are moved: those that only pass a stage lie above the ones that it works on."""
    return blocks.assign(slot=(blocks["slot"] + by).astype("int32"))


def judged_phrases(docs: DataFrame, slots: int) -> DataFrame:
    """Blocks, dealt by document, of phrases with a mask: all windows repeated (all ones), or
    unknown as the trigger has other phrases and this is the first of its kind (0, or _HOT)."""

    def postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def block() -> Iterator[pd.DataFrame]:
            owner = np.repeat(np.array([x[0] for x in held], dtype=np.int64), [len(x[1]) for x in held])
            trigger, phrase = (np.concatenate([x[i] for x in held]) for i in (1, 2))
            held.clear()
            again = _not_first(owner, phrase)
            yield _shifted(_to_documents(owner[again], phrase[again], np.full(again.sum(), _ALL), slots), slots)
            owner, trigger, phrase = owner[~again], trigger[~again], phrase[~again]
            order = np.argsort(owner, kind="stable")
            owners, counts = np.unique(owner, return_counts=True)
            trigger, phrase = trigger[order], phrase[order]
            # triggers are the smallest hashes around, so slots go by a scramble of them; phrases of
            # a slot's triggers that agree in the low bits only are compared, and found to differ
            yield posting_blocks(owners, np.zeros(len(owners)), counts, phrase, _slot_of(mixed(trigger), slots), trigger.astype(np.uint32))

        waiting = 0
        for batch in batches:
            for doc, text in zip(batch["owner"], batch["text"], strict=True):
                data = _bytes(text)
                _, _, trigger, phrase, _ = parse(data)
                phrase, at = np.unique(phrase, return_index=True)
                held.append((doc, trigger[at], phrase))
                waiting += len(data)
                if waiting > _BYTES_PER_BLOCK:
                    yield from block()
                    waiting = 0
        if held:
            yield from block()

    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["slot"].iloc[0] >= slots:
            return _shifted(rows, -slots)
        owner, _, phrase, trigger = read_blocks(rows, np.uint32)
        order = np.lexsort((owner, phrase, trigger))
        owner, phrase, trigger = owner[order], phrase[order], trigger[order]
        new_trigger = np.append(True, trigger[1:] != trigger[:-1])
        new_phrase = new_trigger | np.append(True, phrase[1:] != phrase[:-1])
        in_phrase = np.cumsum(new_phrase) - 1
        repeated = owner > owner[new_phrase][in_phrase]
        phrases = np.add.reduceat(new_phrase.astype(np.int64), np.flatnonzero(new_trigger))[np.cumsum(new_trigger) - 1]
        unknown = (phrases > 1) & (owner == owner[new_phrase][in_phrase])
        keep = repeated | unknown
        mask = np.where(repeated, _ALL, np.where(phrases > HOT_PHRASES, _HOT, np.uint64(0)))
        return _to_documents(owner[keep], phrase[keep], mask[keep], slots)

    return dealt(docs.mapInPandas(postings, BLOCK), slots).groupBy("slot").applyInPandas(judge, BLOCK)


def _answers(rows: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """doc_id -> sorted phrases and their masks."""
    owner, _, phrase, mask = read_blocks(rows, np.uint64)
    order = np.lexsort((phrase, owner))
    owner, phrase, mask = owner[order], phrase[order], mask[order]
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, dtype=np.int64)
    return {int(owner[a]): (phrase[a:b], mask[a:b]) for a, b in zip(starts, [*starts[1:], len(owner)], strict=False)}


def _found(phrase: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each phrase is among the sorted wanted ones, and whether it is."""
    at = np.minimum(np.searchsorted(wanted, phrase), len(wanted) - 1)
    return at, wanted[at] == phrase


def dictionary_phrases(asked: pd.DataFrame, texts: pd.DataFrame, slots: int) -> pd.DataFrame:
    """What a slot's documents were asked for: the bytes of phrases, dealt by trigger; the hashes
    of the windows of hot triggers' phrases, in the slots above; and above these, dealt by
    document, masks of the windows that a smaller document of this slot has too."""
    wanted, held, hot = _answers(asked), [], []
    for doc, text in zip(texts["owner"], texts["text"], strict=True):
        if int(doc) in wanted:
            data = _bytes(text)
            first, windows, trigger, phrase, inside = parse(data)
            at, is_asked = _found(phrase, wanted[int(doc)][0])
            is_hot = is_asked & (wanted[int(doc)][1][at] == _HOT)
            if is_hot.any():
                hot.append((int(doc), *_window_hashes(data, first[is_hot], windows[is_hot], phrase[is_hot])))
            is_asked &= ~is_hot
            phrase, at = np.unique(phrase[is_asked], return_index=True)
            first, windows, trigger, inside = (x[is_asked][at] for x in (first, windows, trigger, inside))
            padded = np.append(data, np.zeros(_SPAN, dtype=np.uint8))
            spans = np.zeros(len(first), dtype=_ENTRY)
            spans["bytes"] = padded[first[:, None] + np.arange(_SPAN)] * (np.arange(_SPAN) < (windows + WIDTH - 1)[:, None])
            spans["windows"], spans["inside"], spans["trigger"] = windows, inside, trigger
            held.append((doc, phrase, trigger, spans))
    made = [pd.DataFrame({x.split()[0]: [] for x in BLOCK.split(", ")})]
    if held:
        owners, counts = np.array([x[0] for x in held], dtype=np.int64), np.array([len(x[1]) for x in held])
        phrase, trigger, spans = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
        made.append(posting_blocks(owners, np.zeros(len(owners)), counts, phrase, _slot_of(mixed(trigger), slots), spans))
    if hot:
        owner = np.repeat(np.array([x[0] for x in hot], dtype=np.int64), [len(x[1]) for x in hot])
        window, at = (np.concatenate([x[i] for x in hot]) for i in (1, 2))
        again = _not_first(owner, window)
        made.append(_shifted(_window_masks(owner[again], at[again], slots), 2 * slots))
        owner, window, at = owner[~again], window[~again], at[~again]
        order = np.argsort(owner, kind="stable")
        owners, counts = np.unique(owner, return_counts=True)
        window = window[order]
        made.append(_shifted(posting_blocks(owners, np.zeros(len(owners)), counts, window, _slot_of(window, slots), at[order]), slots))
    return pd.concat(made, ignore_index=True) if len(made) > 1 else made[0]


#: Where a window is: its phrase, and its place among the phrase's windows.
_WINDOW = np.dtype([("phrase", np.uint64), ("offset", np.uint8)])


def _window_hashes(data: np.ndarray, first: np.ndarray, windows: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the phrases' windows, and where each is."""
    values = _BYTE_VALUES[data]
    of = np.repeat(np.arange(len(first)), windows)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = first[of] + offset
    hashes = np.zeros(len(start), dtype=np.uint64)
    for i in range(WIDTH):
        hashes = hashes * np.uint64(_BASE) + values[start + i]
    at = np.zeros(len(of), dtype=_WINDOW)
    at["phrase"], at["offset"] = phrase[of], offset
    return mixed(hashes), at


def _window_masks(owner: np.ndarray, at: np.ndarray, slots: int) -> pd.DataFrame:
    """Blocks, dealt by document, of the phrases of windows that are repeated."""
    order = np.lexsort((at["phrase"], owner))
    owner, at = owner[order], at[order]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (at["phrase"][1:] != at["phrase"][:-1]))) if len(owner) else np.empty(0, dtype=np.int64)
    bits = np.uint64(1) << at["offset"].astype(np.uint64)
    masks = np.bitwise_or.reduceat(bits, new) if len(new) else bits
    return _to_documents(owner[new], at["phrase"][new], masks, slots)


#: A phrase of the dictionary: its bytes, its windows, where its trigger is, and the trigger's hash.
_ENTRY = np.dtype([("bytes", np.uint8, _SPAN), ("windows", np.uint8), ("inside", np.uint8), ("trigger", np.uint64)])


def _repeated(owner: np.ndarray, spans: np.ndarray, of: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Which windows (``offset`` in phrase ``of``) a smaller owner's phrase has too: a suffix
    array of the phrases, to the depth of a window, brings equal windows together."""
    suffixes = np.zeros((len(of), 56), dtype=np.uint8)
    suffixes[:, :WIDTH] = np.lib.stride_tricks.sliding_window_view(spans["bytes"], WIDTH, axis=1)[of, offset]
    keys = suffixes.view(">u8").astype(np.uint64)
    order = np.lexsort(keys.T[::-1])
    new = np.append(True, (keys[order[1:]] != keys[order[:-1]]).any(axis=1))
    lowest = np.minimum.reduceat(owner[of[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    found = np.zeros(len(of), dtype=bool)
    found[order] = owner[of[order]] > lowest
    return found


def _masks(owner: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Masks of the phrases' windows that a smaller owner's phrase has too. Equal windows have
    their trigger at one place, so many phrases are compared place by place."""
    windows = spans["windows"].astype(np.int64)
    of = np.repeat(np.arange(len(owner)), windows)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    mask = np.zeros(len(owner), dtype=np.uint64)
    place = spans["inside"].astype(np.int64)[of] - offset
    for part in [slice(None)] if len(owner) <= 2 * _PHRASES else [place == x for x in range(_GRAMS)]:
        if len(of[part]):
            found = _repeated(owner, spans, of[part], offset[part])
            np.bitwise_or.at(mask, of[part][found], np.uint64(1) << offset[part][found].astype(np.uint64))
    return mask


def shared_windows(rows: pd.DataFrame, slots: int) -> pd.DataFrame:
    """Masks of the windows that a smaller document's dictionary phrase has too, for the
    phrases of a slot's triggers, some triggers at a time; or for a slot's hashes of windows."""
    if rows["slot"].iloc[0] >= 2 * slots:
        return _shifted(rows, -2 * slots)
    if rows["slot"].iloc[0] >= slots:
        owner, _, window, at = read_blocks(rows, _WINDOW)
        again = _not_first(owner, window)
        return _window_masks(owner[again], at[again], slots)
    owner, _, phrase, spans = read_blocks(rows, _ENTRY)
    order = np.argsort(spans["trigger"], kind="stable")
    trigger = spans["trigger"][order]
    cuts, starts = [0], np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
    for a in [*starts.tolist(), len(order)]:
        if a - cuts[-1] >= _PHRASES or a == len(order) > cuts[-1]:
            cuts.append(a)
    mask = np.zeros(len(owner), dtype=np.uint64)
    for a, b in zip(cuts, cuts[1:], strict=False):
        mask[order[a:b]] = _masks(owner[order[a:b]], spans[order[a:b]])
    keep = mask > 0
    return _to_documents(owner[keep], phrase[keep], mask[keep], slots)


def removed_bytes(data: np.ndarray, phrases: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which bytes of a text its phrases' masks cover."""
    first, windows, _, phrase, _ = parse(data)
    at, known = _found(phrase, phrases)
    mask = np.where(known, masks[at], np.uint64(0))
    of = np.repeat(np.arange(len(first)), windows)
    offset = (np.arange(len(of)) - first[of]).astype(np.uint64)
    flagged = ((mask[of] >> offset) & np.uint64(1)).astype(np.int64)
    depth = np.zeros(len(data) + 1, dtype=np.int64)
    depth[: len(flagged)] += flagged
    depth[WIDTH : WIDTH + len(flagged)] -= flagged
    return np.cumsum(depth)[:-1] > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the spans of each row.

    A byte of a text's UTF-8 goes if a WIDTH-byte string that covers it starts in a document
    with a smaller doc_id too. Phrases travel as hashes, dealt by trigger in slots that are as
    many as the texts are long; texts travel once, dealt by document, to the masks.

    A null text is empty; a text shorter than WIDTH loses nothing; a long one is parsed in
    pieces; rows that repeat a doc_id lose nothing to each other; a null doc_id is above all
    others; an empty table gives no rows; other columns are ignored.
    """
    docs = owned(docs)
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = prime_from(dealing_slots(docs.sparkSession, chars, BYTES_PER_SLOT))
    judged = checkpointed(judged_phrases(docs, slots))

    texts = docs.withColumn("slot", F.pmod("owner", F.lit(slots)).cast("int"))
    by_slot = dealt(texts, slots).groupBy("slot")
    asked = (
        dealt(judged, slots)
        .groupBy("slot")
        .cogroup(by_slot)
        .applyInPandas(lambda x, y: dictionary_phrases(_unknown(x), y, slots), BLOCK)
    )
    masks = judged.unionByName(dealt(asked, slots).groupBy("slot").applyInPandas(lambda x: shared_windows(x, slots), BLOCK))

    def cut(masks: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        known, rows = _answers(masks), []
        for doc, text in zip(texts["owner"], texts["text"], strict=True):
            data = _bytes(text)
            gone = np.zeros(len(data), dtype=bool)
            if int(doc) in known and len(data) >= WIDTH:
                gone = removed_bytes(data, *_joined(*known[int(doc)]))
            edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8)))
            spans = ",".join(f"{a}:{b}" for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(data[~gone].tobytes()).hexdigest(), spans))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"], index=texts.index)
        return pd.concat([texts[["owner", "known"]], out.astype({"kept_sha256": object, "spans": object})], axis=1)

    fields = "owner long, known boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
    return named(dealt(masks, slots).groupBy("slot").cogroup(by_slot).applyInPandas(cut, fields))


def _unknown(judged: pd.DataFrame) -> pd.DataFrame:
    """The blocks without the phrases whose masks are known."""
    out = []
    for row in judged.itertuples():
        mask, counts = np.frombuffer(row.extra, dtype=np.uint64), np.frombuffer(row.counts, dtype=np.uint32).astype(np.int64)
        ask = (mask == 0) | (mask == _HOT)
        left = np.add.reduceat(ask.astype(np.int64), np.cumsum(counts) - counts)
        out.append((row.owners, row.sizes, left.astype(np.uint32).tobytes(), np.frombuffer(row.tokens, dtype=np.uint64)[ask].tobytes(), mask[ask].tobytes()))
    return pd.DataFrame(out, columns=["owners", "sizes", "counts", "tokens", "extra"])


def _joined(phrases: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct phrases, each with all its masks' windows."""
    new = np.flatnonzero(np.append(True, phrases[1:] != phrases[:-1]))
    return phrases[new], np.bitwise_or.reduceat(masks, new)
