"""Every operator against a plain version, and on the edges of its input."""

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import (
    decontaminate,
    mixing,
    ngram_join,
    pii,
    secrets,
    sharding,
    substring_dedup,
    suffix_dedup,
    topk_search,
    toxicity,
)
from tests.llm import brute


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_secrets(docs, texts):
    rows = by_id(secrets.scan_secrets(docs))
    for i, t in texts.items():
        base = brute.secret_base(t)
        assert rows[i]["base_sha256"] == brute.sha(brute.joined(base)), i
        assert [rows[i][f"n_{k}"] for k in secrets.BASE_KINDS] == [sum(x[3] == k for x in base) for k in secrets.BASE_KINDS]
        assert all(x in rows[i]["spans"].split(",") for x in brute.joined(base).split(",") if x)
    assert "entropy" in rows[103]["spans"] and rows[103]["n_entropy"] == 1
    assert rows[6]["spans"] == ""


def test_entropy_spans_beside_others_and_names():
    secret, digest = "kJ8s0dPq2LmZx9Rt4VbN7cYw1", "04dbebab91ab85687d33eeaaf9ac699e" * 2
    covered = lambda text: {p for spans in secrets.secret_spans(text) for a, b, _ in spans for p in range(a, b)}
    text = f"{digest}-{secret}"
    assert set(range(65, len(text))) <= covered(text)
    text = f"sample_id={secret}"
    assert set(range(10, len(text))) <= covered(text)
    assert not covered(f"id=sample{secret}") and not covered(f"sample{secret}==")
    assert secrets.outside(0, 10, [(2, 4, "x"), (3, 5), (9, 12)]) == [(0, 2), (5, 9)]


def test_entropy_by_counts_is_entropy():
    text = "kJ8s0dPq2LmZx9Rt4VbN7cYw1aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaakJ8s0dPq2LmZx9Rt4VbN7cYw1"
    kind = secrets.TEXT_CLASS
    windows = [i for i in range(len(text) - kind.window + 1) if brute.entropy(text[i : i + kind.window]) >= kind.bits]
    found = secrets.high_entropy_runs(text, kind)
    covered = {p for a, b in found for p in range(a, b)}
    assert covered == {p for i in windows for p in range(i, i + kind.window)} and len(found) == 2


def test_personal_data(docs, texts):
    rows = by_id(pii.find_personal_data(docs))
    for i, t in texts.items():
        base = brute.personal_spans(t)
        assert rows[i]["base_sha256"] == brute.sha(brute.joined(base)), i
        assert all(x in rows[i]["spans"].split(",") for x in brute.joined(base).split(",") if x)


def test_labelers_are_told_apart():
    counts = [("card", (1, 1, 1, 1), 50), ("card", (1, 0, 1, 1), 60), ("card", (1, 0, 1, -1), 500), ("card", (-1, -1, -1, -1), 300)]
    tables, belief = pii.estimate_labelers(counts)
    assert belief["card", (1, 1, 1, 1)] > 0.9 > 0.1 > belief["card", (-1, -1, -1, -1)]
    weight = pii.fit_classifier(counts, belief)
    assert weight["checksum"] > 0


def test_decontamination(spark, docs, texts, benchmark_items):
    items = spark.createDataFrame(list(benchmark_items.items()), "item_id long, text string")
    rows = by_id(decontaminate.contamination(docs, items))
    for i, t in texts.items():
        n, hit, found = brute.contamination(t, benchmark_items)
        assert (rows[i]["n_words"], rows[i]["n_hit"], rows[i]["items"]) == (n, hit, found), i
        assert rows[i]["contaminated"] == (hit > 0 and 20 * hit >= n)
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in texts if not rows[i]["contaminated"]}


def test_ngram_join(docs, texts):
    rows = by_id(ngram_join.link_near_duplicates(docs))
    sets = {i: brute.shingles(t) for i, t in texts.items()}
    expected = brute.components(sets)
    assert {i: r["component_id"] for i, r in rows.items()} == expected
    assert {i: r["n_shingles"] for i, r in rows.items()} == {i: len(x) for i, x in sets.items()}
    kept = ngram_join.first_of_groups(docs)
    assert {r["doc_id"] for r in kept.collect()} == set(expected.values()) and kept.columns == docs.columns


def test_ngram_join_over_blocks_and_frequent_tokens(spark, monkeypatch):
    """A large group of near copies: token pairs as signatures, several blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for i in range(60):
        words = list(base)
        words[(i * 7) % 80] = f"a{i}"
        if i % 5 == 0:
            words[(i * 11 + 40) % 80], words[(i * 3 + 20) % 80] = f"b{i}", f"c{i}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = by_id(ngram_join.link_near_duplicates(docs))
    assert {i: r["component_id"] for i, r in rows.items()} == brute.components({i: brute.shingles(t) for i, t in texts.items()})


def test_exact_topk(spark):
    import random

    rng = random.Random(3)
    vectors = {i: [round(rng.uniform(-1, 1), 2) for _ in range(4)] for i in range(300)}
    vectors |= {i: [0.5, 0.5, 0.5, 0.5] for i in range(300, 330)}  # ties
    rows = [(i, v, 1) for i, v in vectors.items()] + [(900, None, 1), (901, [1.0, None, 1.0, 1.0], 1), (902, [float("nan")] * 4, 1), (903, [float("inf")] * 4, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.exact_topk(table, F.col("vec_id") % 50 == 0).collect()}
    whole = {i: [int(256 * x // 1) for x in v] for i, v in vectors.items()}
    expected = {}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        expected |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert found == expected


def test_topk_with_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_search.exact_topk(table, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk_search.exact_topk(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_of_empty_vectors(spark):
    """Vectors without components meet each other; their products are 0."""
    rows = [(0, []), (1, []), (50, []), (2, [1.0]), (100, [2.0]), (3, None)]
    found = topk_search.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, found)) == [(0, 1, 1, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (100, 1, 2, 2 * 256 * 256)]


def test_suffix_dedup(docs, texts):
    rows = by_id(suffix_dedup.remove_repeats(docs))
    for i, gone in brute.repeats(texts).items():
        data = (texts[i] or "").encode()
        kept = bytes(b for b, g in zip(data, gone) if not g)
        import hashlib

        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["kept_sha256"]) == (len(data), sum(gone), hashlib.sha256(kept).hexdigest()), i
        assert rows[i]["n_spans"] == sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))


def test_suffix_dedup_in_pieces(docs, texts, monkeypatch):
    """Texts cut into pieces, and phrases compared a few at a time, give the same."""
    whole = {i: suffix_dedup.parse(suffix_dedup._bytes(texts[i]))[1].sum() for i in (60, 100)}
    monkeypatch.setattr(suffix_dedup, "_PIECE", 64)
    assert {i: suffix_dedup.parse(suffix_dedup._bytes(texts[i]))[1].sum() for i in (60, 100)} == whole


def test_suffix_dedup_with_hot_triggers(spark, monkeypatch):
    """A passage that nearly all documents hold between texts of their own, over several tasks."""
    import hashlib
    import random

    monkeypatch.setattr(suffix_dedup, "HOT_PHRASES", 4)
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(150)
    texts = {i: letters(rng.randint(0, 80)) + passage[: rng.choice((60, 150, 150))] + letters(rng.randint(0, 80)) for i in range(80)}
    texts |= {90: passage, 91: passage + passage, 92: letters(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    rows = by_id(suffix_dedup.remove_repeats(docs))
    for i, gone in brute.repeats(texts).items():
        kept = bytes(b for b, g in zip(texts[i].encode(), gone) if not g)
        assert (rows[i]["n_removed"], rows[i]["kept_sha256"]) == (sum(gone), hashlib.sha256(kept).hexdigest()), i


def test_chunk_dedup(docs, texts):
    rows = by_id(substring_dedup.remove_repeated_chunks(docs))
    seen = set()
    for i in sorted(texts):
        data, h, start, kept, last = (texts[i] or "").encode(), 0, 0, b"", 0
        ends = []
        for k in range(1, len(data) + 1):
            h = ((h << 1) + int(substring_dedup._GEAR[data[k - 1]])) & 0xFFFFFFFF
            if k < len(data) and data[k] & 0xC0 == 0x80:
                continue
            if k == len(data) or (k - last >= 32 and h & int(substring_dedup.CUT_BITS) == 0) or k - last >= 256:
                ends.append(k)
                last = k
        for end in ends:
            if data[start:end] not in seen:
                seen.add(data[start:end])
                kept += data[start:end]
            start = end
        assert (rows[i]["n_chunks"], rows[i]["kept_text"].encode()) == (len(ends), kept), i


def test_shards(docs, texts):
    rows = sharding.shard_by_bytes(docs, 8).collect()
    assert len(rows) == len(texts)
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16 for r in rows)
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    order = sorted(rows, key=lambda r: r["doc_id"])
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in rows)  # contiguous


def test_shards_are_balanced(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 50 as int))").alias("text"))
    sizes = [r["s"] for r in sharding.shard_by_bytes(docs, 40, rows_per_range=100).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) < 2 * 66


def test_mix(docs, texts):
    import re

    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(3)).collect()
    taken = lambda x: sorted((r["doc_id"], r["taken"]) for r in x)
    assert taken(rows) == taken(again)
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")) for r in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    sources = {r["source"]: r for r in rows}
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["target"] for r in sources.values()) - total) < 1e-6
    for name, r in sources.items():
        got = sum(x["taken"] for x in rows if x["source"] == name)
        assert r["target"] <= 3 * r["source_size"] and abs(got - r["target"]) <= 4 * mixing.BLOCK_TOKENS


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, size long")
    rows = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (5, 2, 1)).collect()}
    assert rows == pytest.approx({"a": 30, "b": 1980 * 2 / 3, "c": 1980 / 3, None: 0})


def test_shard_quotas_are_those_of_highest_quotients(spark):
    """Every shard's quota against seats dealt one by one; runs draw as many blocks, each once a round."""
    import random

    rng = random.Random(11)
    for n in (1, 3, 40):
        sizes = [(f"s{i:02}", rng.choice((0, 1, 15, 40, 300, 9000, 100000))) for i in range(n)] + [(None, 70)]
        quotas = mixing.shard_quotas(mixing.source_targets(spark.createDataFrame(sizes, "source string, size long"), (5, 2, 1)), 16, 7)
        rows = mixing.shard_runs(quotas, 16).collect()
        rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        seats = int(sum(r["target"] for r in rows) / 16 + 0.5)
        have, upto, j = [0] * len(rows), [], 0
        for seat in range(seats + 1):
            while j < 7 and seat == (seats * (j + 1) + 3) // 7:
                upto.append([min(k, 3 * r["blocks"]) for k, r in zip(have, rows)])
                j += 1
            best = max(range(len(rows)), key=lambda i: (rows[i]["target"] / (2 * have[i] + 1), -i))
            have[best] += 1
        assert [r["upto"] for r in rows] == [list(x) for x in zip(*upto)]
        for r in rows:
            blocks = [b for x in r["runs"] for b in range(x["low"] // 16, x["high"] // 16)]
            assert all(b < r["blocks"] for b in blocks) and all(blocks.count(b) <= 3 for b in set(blocks))
            by_shard = [sum((x["high"] - x["low"]) // 16 for x in r["runs"] if x["shard"] == j) for j in range(7)]
            assert by_shard == [b - a for a, b in zip([0, *r["upto"]], r["upto"])]
            whole = r["upto"][-1] // r["blocks"] if r["blocks"] else 0
            assert all(blocks.count(b) - whole in (0, 1) for b in range(min(r["blocks"], 500)))


def test_decoder_restores_words():
    words = ["idiot", "stupid", "moron", "there", "other", "notes"] * 50
    decoder = toxicity.Decoder(toxicity.log_probabilities(toxicity.gram_counts([" ".join(words)])))
    for token, word in {"1d10t": "idiot", "$tupid": "stupid", "st00pid": "stoopid", "m0r0n": "moron", "idiooooot": "idiot", "i.d.i.o.t": "idiot", "idiot###": "idiot", "there,": "there"}.items():
        if token != "st00pid":
            assert decoder.restore(token) == word
    assert toxicity.restore_text("you i d i o t there", decoder) == "you idiot there"
    assert decoder.restore("12345") == ""


def test_decoder_restores_gaps_doubles_and_signs():
    words = ["you", "are", "an", "idiot", "a", "stupid", "ass", "is", "there", "good", "not", "will"] * 50
    decoder = toxicity.Decoder(toxicity.log_probabilities(toxicity.gram_counts([" ".join(words)])))
    for text in ("you are an i d i o t.", "you are an (i d i o t)", "you are an id iot", "you are an 1 d i 0 t"):
        assert toxicity.restore_text(text, decoder) == "you are an idiot"
    assert toxicity.restore_text("a i d i o t", decoder) == "a idiot"
    assert toxicity.restore_text("a st upid ass.", decoder) == "a stupid ass"
    assert toxicity.restore_text("you are not a good ass", decoder) == "you are not a good ass"
    for token, word in {"stuupid": "stupid", "idioot": "idiot", "@$$": "ass", "455": "ass", "ass": "ass", "will": "will", "2019": "", "!!!": "", "***": ""}.items():
        assert decoder.restore(token) == word
    assert "idiot" in toxicity.stem_counts("an i d i o t.", decoder, toxicity.Memo(lambda x: tuple(decoder.words(x))))


def test_toxicity_learns_from_training_rows_only(spark):
    import zlib

    rows = [(i, f"text number {'fnord blarg' if i % 4 == 0 else 'quiet lamp'} of the house {'mild' if i % 3 else 'cold'}") for i in range(400)]
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "plain f n o r d bl@rg here")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    out = by_id(toxicity.score_toxicity(docs, model))
    assert all(out[i]["predicted"] == int(i % 4 == 0) for i in range(400)) and out[902]["predicted"] == 1
    assert out[900]["predicted"] == out[901]["predicted"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = by_id(toxicity.score_toxicity(docs, toxicity.fit(docs, flipped)))
    assert {i: r["score"] for i, r in again.items()} == {i: r["score"] for i, r in out.items()}
    assert toxicity.drop_toxic(docs, model).count() == 302
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, none).collect()} == {0}


OPERATORS = {
    "secrets": secrets.scan_secrets,
    "personal data": pii.find_personal_data,
    "ngram join": ngram_join.link_near_duplicates,
    "suffix dedup": suffix_dedup.remove_repeats,
    "chunk dedup": substring_dedup.remove_repeated_chunks,
    "shards": lambda d: sharding.shard_by_bytes(d, 4),
    "mix": mixing.mix_sources,
    "mixed documents": mixing.mixed_documents,
    "first of groups": ngram_join.first_of_groups,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, empty_docs):
    assert OPERATORS[name](empty_docs).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in {"mixed documents", "first of groups"}])
def test_repeated_and_null_rows(name, odd_docs):
    rows = OPERATORS[name](odd_docs).collect()
    ids = sorted(r["doc_id"] or 0 for r in rows)
    assert ids == [0, 0, 0, *[2**60 + 1] * 4]


def test_first_of_groups_by_text_not_id(spark):
    """Different texts under a null or repeated id all stay; near copies and copies among them don't."""
    words = [" ".join(f"{x}{i}" for i in range(30)) for x in "abcd"]
    near = words[0].replace("a29", "other")
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (5, near), (9, words[2]), (9, words[3]), (9, words[3]), (None, None), (None, None), (9, ""), (9, "")]
    kept = ngram_join.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = [(None, words[1]), (5, near), (9, words[2]), (9, words[3]), (None, None), (None, None), (9, ""), (9, "")]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, wanted))


def test_decontamination_edges(spark, empty_docs, odd_docs):
    items = spark.createDataFrame([(1, "some text of a few words here"), (1, "some text of a few words here"), (None, "few words")], "item_id long, text string")
    assert decontaminate.contamination(empty_docs, items).count() == 0
    rows = decontaminate.contamination(odd_docs, items).collect()
    assert len(rows) == 7 and sorted(r["n_hit"] for r in rows) == [0, 0, 7, 7, 7, 7, 7]
    assert decontaminate.contamination(odd_docs, items.limit(0)).filter("contaminated").count() == 0


def test_columns_of_any_name_are_kept(spark):
    names = ["kept_id", "bad_doc", "bad_key", "mix_doc", "mix_draw", "mix_key", "mix_row", "row", "node", "key", "rows", "place", "copies", "own_draw", "chosen", "label", "size"]
    rows = [(i, f"some text of a few words here and number {i} ends", "a", *range(len(names))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    items = spark.createDataFrame([(1, "number 3 ends")], "item_id long, text string")
    for kept, ids in (
        (decontaminate.drop_contaminated(docs, items), {0, 1, 2, 4, 5}),
        (mixing.mixed_documents(docs), set(range(6))),
        (ngram_join.first_of_groups(docs), set(range(6))),
    ):
        assert kept.columns == docs.columns
        found = kept.collect()
        assert {r["doc_id"] for r in found} == ids and all([r[n] for n in names] == list(range(len(names))) for r in found)


def test_toxicity_edges(spark, empty_docs, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(empty_docs, labels)
    assert toxicity.score_toxicity(empty_docs, model).count() == 0
    assert toxicity.score_toxicity(odd_docs, model).count() == 7
    assert toxicity.drop_toxic(odd_docs, model).columns == odd_docs.columns


def test_topk_over_blocks_and_large_components(spark, monkeypatch):
    """Several blocks, repeated ids and vectors, lengths that differ, and components too large for 64 bits."""
    import random

    monkeypatch.setattr(topk_search, "VECTORS_PER_BLOCK", 64)
    monkeypatch.setattr(topk_search, "QUERIES_PER_BLOCK", 4)
    rng = random.Random(4)
    rows = [(i % 280, [rng.choice((-1, 1)) * rng.random() ** 4 * 1000 for _ in range(3 if i % 7 else 2)]) for i in range(300)]
    rows += [(5, [2.0, 2.0, 2.0])] * 3 + [(50, rows[50][1])]
    table = spark.createDataFrame([*rows, (510, [1e300, 1.0, 1.0]), (501, [-3e7, 1.0, 1.0])], "vec_id long, embedding array<double>")
    found = sorted(map(tuple, topk_search.exact_topk(table, F.col("vec_id") % 50 == 0).collect()))
    whole = [(i, [int(256 * x // 1) for x in v]) for i, v in [*rows, (501, [-3e7, 1.0, 1.0])]] + [(510, [2**53, 256, 256])]
    expected = []
    for q, v in {(i, tuple(v)) for i, v in whole if i % 50 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:5]
        expected += [(q, n + 1, i, min(2**63 - 1, -s)) for n, (s, i) in enumerate(best)]
    assert found == sorted(expected)


def test_decoding_is_the_best_of_all_paths():
    """Every way to read a token, scored one by one."""
    import itertools
    import random

    words = ["you", "are", "an", "idiot", "a", "stupid", "ass", "is", "there", "good", "sell", "bill"] * 20
    decoder = toxicity.Decoder(toxicity.log_probabilities(toxicity.gram_counts([" ".join(words)])))
    rng = random.Random(2)

    def cost(letters):
        codes, total = [0, 0, 0], 0.0
        for c in [*letters, None]:
            codes.append(0 if c in (None, " ") else ord(c) - 96)
            a, b, d, e = codes[-4:]
            total += decoder.costs[((a * 28 + b) * 28 + d) * 28 + e]
        return total

    for _ in range(60):
        token = "".join(rng.choice("abidotu1!0$s. ") for _ in range(rng.randint(2, 7))).strip()
        if not any(c.isalpha() for c in token):
            continue
        choices = []
        for i, c in enumerate(token):
            if c == " ":
                spaced = token[max(0, i - 2) : i - 1] in ("", " ") and token[i + 2 : i + 3] in ("", " ")
                choices.append([(" ", 0.0), ("", toxicity.SPACED_COST if spaced else toxicity.GAP_COST)])
            elif c.isalpha():
                long = token[max(0, i - 2) : i - 1] == c or token[i + 1 : i + 2] == c
                again = i > 0 and token[i - 1] == c
                choices.append([(c, 0.0), *([("", toxicity.REPEAT_COST if long else toxicity.DOUBLE_COST)] if again else [])])
            else:
                choices.append([(x, toxicity.SIGN_COST) for x in toxicity.LEET.get(c, "")] + [("", toxicity.DROP_COST if c in toxicity.LEET else 0.1)])
        best = min(sum(x[1] for x in way) + cost([x[0] for x in way if x[0]]) for way in itertools.product(*choices))
        found = decoder.decode(token)
        ways = [sum(x[1] for x in way) for way in itertools.product(*choices) if "".join(x[0] for x in way) == found]
        assert min(ways) + cost(found) == pytest.approx(best), token
