"""Alignment of tokenizers, held against a plain version that tokenizes whole texts."""

import hashlib
import random
from collections import Counter

import pytest

from reviewloom.llm import token_alignment
from reviewloom.llm.token_alignment import TOKENIZERS, align_tokenizers, aligner

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b\n c ", "\n\n x  y\t z", "▁ a▁ b ▁c", "<|endoftext|> a <s> </s> <unk> <0x41>", "x" * 3000, "🙂 🙂🙂  ok", "a　b  c",
    "日本語 テキスト です", "\0 a", "é ́x", "don't 's it's 'll", "The the THE the", "The the THE the", "word " * 2000,
]


def groups_of(text):
    """Groups of the whole text, without stretches."""
    find = aligner(TOKENIZERS)
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = find.byte_bpe.encode(" " + text, add_special_tokens=False).ids, find.pieces.encode(text)
    if b"".join(find.a_bytes[i] for i in a) != whole or b"".join(find.b_bytes[i] for i in b) != whole:
        return None
    ends = []
    for ids, size in ((a, find.a_bytes), (b, find.b_bytes)):
        at, found = 0, []
        for i in ids:
            at += len(size[i])
            found.append(at)
        ends.append(found)
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        i_to, j_to = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append((tuple(a[i:i_to]), tuple(b[j:j_to])))
        i, j = i_to, j_to
    return out


def plain(rows):
    found = [(i, groups_of(t)) for i, t in rows]
    links = lambda groups: [(a, b) for x, y in groups for a in x for b in y]
    counts = Counter(pair for _, g in found if g for pair in set(links(g)))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for i, g in found:
        if g is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        sha = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g).encode()).hexdigest()
        pairs = links(g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(pairs), sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs), sha))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chars", [32 << 20, 500])
def test_alignment(spark, texts, chars):
    rows = [(i, t) for i, t in texts.items()] + [(None if i % 5 == 0 else 1000 + i // 2, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 1, "n", "x") for i, t in rows], "doc_id long, text string, block int, name string, held string").repartition(5)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, align_tokenizers(docs, chars_per_block=chars).select(*columns).collect()), key=repr) == plain(rows)


def test_edges(empty_docs, odd_docs):
    assert align_tokenizers(empty_docs).count() == 0
    rows = align_tokenizers(odd_docs).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 0, 0, *[2**60 + 1] * 4]


def test_parts_are_tokenized_as_the_whole():
    rng = random.Random(9)
    signs = "  ab'é.\n\t1▁🙂 日s <>"
    find = aligner(TOKENIZERS)
    assert find.cuts
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    assert any(len(find.parts(t, 5)) > 2 for t in texts)
    block = token_alignment.Block(0, find)
    for size in (1 << 20, 5):
        block.docs = []
        block.add(list(zip(map(str, range(300)), texts, strict=True)), size)
        names = list(block.gids)
        for text, (_, n_a, _, n_groups, _, sha, _) in zip(texts, block.docs, strict=True):
            groups = groups_of(text)
            written = "" if groups is None else ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
            assert sha == ("" if groups is None else hashlib.sha256(written.encode()).hexdigest()), text
            assert groups is None or (n_a, n_groups) == (sum(len(a) for a, _ in groups), len(groups)) and set(groups) <= set(names)


def test_ranks_read_like_the_vocabulary(texts):
    find = aligner(TOKENIZERS)
    for text in [*texts.values(), *ODD]:
        if text:
            assert find.a_ids(" " + text) == find.byte_bpe.encode(" " + text, add_special_tokens=False).ids
