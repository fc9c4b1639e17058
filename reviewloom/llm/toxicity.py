"""Toxicity of texts behind a noisy channel: decode first, then score what was meant."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed, give_back

#: Documents of each class that the classifier is fitted on, at most.
SAMPLE_PER_CLASS = 4000
#: Features that are tested by the full statistic, and that it may use, at most.
SHORTLIST, MAX_FEATURES = 8000, 1000

ORDER, LETTERS = 4, 28  # of the language model: a boundary, a to z, any other letter
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "&": "a", "*": "aeiou",
}
#: Costs of the channel, in nats: a sign for a letter, a sign that means nothing, a letter repeated
#: twice or more, or once, a gap inside a word, one between single characters, a sign that is meant as it is.
SIGN_COST, DROP_COST, REPEAT_COST, DOUBLE_COST, GAP_COST, SPACED_COST, LITERAL_COST = 1.0, 3.0, 0.7, 5.0, 5.0, 1.0, 3.8

DOUBLED = re.compile(r"(.)\1")
#: Words as they are, with signs behind them that mean no letter.
PLAIN = re.compile(r"([^\W\d_]+)[.,;:?!]*")
EDGES = ".,;:?!\"'()[]{}<>*#%&$|~^`_-+=/\\«»¿¡…–—"
#: Edges of tokens without a letter, whose signs may be letters.
BARE_EDGES = ".,;:?\"'()[]{}<>%~^`_-=/\\«»¿…–—"
MEMO_SIZE = 300_000
#: Tokens that a task which scores remembers, and those of the text at hand.
SCORED_TOKENS = 200_000
#: Partitions of the sample, which has a set size, and of its features.
SAMPLE_PARTS = 16
#: Rows of a block of the curvature.
DOCS_PER_BLOCK = 512


class _Folded(dict):
    """Characters without accents, by their code; each is taken apart once."""

    def __missing__(self, code: int) -> str:
        made = self[code] = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        return made


_FOLDED = _Folded()


def fold(text: str) -> str:
    """Letters without their accents."""
    return text if text.isascii() else text.translate(_FOLDED)


def _code_table() -> np.ndarray:
    table = np.zeros(0x250, dtype=np.int64)
    for i in range(len(table)):
        base = fold(chr(i).lower())[:1]
        table[i] = ord(base) - 96 if "a" <= base <= "z" else 27 if chr(i).isalpha() else 0
    return table


_CODES = _code_table()


def gram_counts(texts: Iterable[str]) -> np.ndarray:
    """How often each ORDER-gram of letter codes occurs."""
    counts = np.zeros(LETTERS**ORDER, dtype=np.int64)
    for text in texts:
        points = np.frombuffer(("  " + text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], 27)
        index = codes[:-3] * LETTERS**3 + codes[1:-2] * LETTERS**2 + codes[2:-1] * LETTERS + codes[3:]
        grams, n = np.unique(index, return_counts=True)
        counts[grams] += n
    return counts


def log_probabilities(counts: np.ndarray, prior: float = 4.0) -> np.ndarray:
    """log P(letter | ORDER - 1 before it), each order smoothed by the one below."""
    n = counts.reshape((LETTERS,) * ORDER).astype(np.float64)
    p = np.full(LETTERS, 1 / LETTERS)
    for order in range(1, ORDER + 1):
        own = n.sum(axis=tuple(range(ORDER - order)))
        p = (own + prior * p) / (own.sum(axis=-1, keepdims=True) + prior)
    return np.log(p).astype(np.float32).ravel()


def count_grams(docs: DataFrame) -> np.ndarray:
    """Counts over the whole texts of all documents. Tasks send what they have seen, and
    there are LETTERS ** ORDER different rows at most, whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LETTERS**ORDER, dtype=np.int64)
        for batch in batches:
            total += gram_counts(x for x in batch["text"] if x)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen.astype("int32"), "n": total[seen]})

    # columns of numbers, not rows: the driver holds no object for each gram
    rows = docs.select("text").mapInPandas(lambda batches: give_back(count(batches)), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(LETTERS**ORDER, dtype=np.int64)
    counts[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return counts


#: Ways to drop some of up to three doubles, none first.
_SUBSETS = [sorted((tuple(k for k in range(n) if bits >> k & 1) for bits in range(1 << n)), key=lambda x: (len(x), x)) for n in range(4)]


@dataclass
class Decoder:
    """Viterbi search over what a token may mean, under the character language model."""

    logp: np.ndarray

    def __post_init__(self):
        self.costs = (-self.logp.astype(np.float64)).tolist()
        self.sides = Memo(_sides)

    def decode(self, token: str) -> str:
        """The likeliest words: each character stands for itself, for a letter that its sign
        looks like, for nothing (signs between letters), or repeats the letter before it; a
        gap is kept, as a boundary, or dropped. Without any letter in it, a token may also
        mean its signs, all of them; then '' is returned.

        States are the last ORDER - 1 letters; of each the best path is kept, and all that follows
        depends on the state alone, so the result is the best of all paths.
        """
        text, costs = fold(token), self.costs
        if text.isalpha():
            doubled = [i for i in range(1, len(text)) if text[i] == text[i - 1]]
            if len(doubled) <= 3:
                return self._kept_or_dropped(text, doubled)
        bare = not any(c.isalpha() for c in text)
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for i, c in enumerate(text):
            options: list[tuple[str, float]] = []
            if c == " ":
                spaced = text[max(0, i - 2) : i - 1] in ("", " ") and text[i + 2 : i + 3] in ("", " ")
                options += [(" ", 0.0), ("", SPACED_COST if spaced else GAP_COST)]
            elif c.isalpha():
                options.append((c, 0.0))
                if i and text[i - 1] == c:
                    long = text[i - 2 : i - 1] == c or text[i + 1 : i + 2] == c
                    options.append(("", REPEAT_COST if long else DOUBLE_COST))
            else:
                options += [(x, SIGN_COST) for x in LEET.get(c, "")]
                if not bare:
                    options.append(("", DROP_COST if c in LEET else 0.1))
            new: dict[int, tuple[float, tuple]] = {}
            for key, (cost, made) in states.items():
                for letter, channel in options:
                    if letter:
                        code = ord(letter) - 96 if "a" <= letter <= "z" else 0 if letter == " " else 27
                        at = key * LETTERS + code
                        step, to, word = cost + channel + costs[at], at % LETTERS**3, (made, letter)
                    else:
                        step, to, word = cost + channel, key, made
                    if to not in new or step < new[to][0]:
                        new[to] = (step, word)
            states = new
        ends = [(cost + costs[key * LETTERS], made) for key, (cost, made) in states.items()]
        if not ends:
            return ""
        best, made = min(ends, key=lambda x: x[0])
        if bare and best >= LITERAL_COST * sum(c != " " for c in text):
            return ""
        letters = []
        while made:
            made, letter = made
            letters.append(letter)
        return "".join(reversed(letters))

    def _kept_or_dropped(self, text: str, doubled: list[int]) -> str:
        """``decode`` of letters alone, some of them doubled: each double is kept or dropped, so all words are tried."""
        if not doubled:
            return text
        costs, codes = self.costs, [ord(c) - 96 if "a" <= c <= "z" else 27 for c in text]
        price = {i: REPEAT_COST if text[i - 2 : i - 1] == text[i] or text[i + 1 : i + 2] == text[i] else DOUBLE_COST for i in doubled}
        best, kept = math.inf, ()
        for dropped in _SUBSETS[len(doubled)]:
            out = {doubled[k] for k in dropped}
            key, cost = 0, 0.0
            for i, code in enumerate(codes):
                if i in out:
                    cost += price[i]
                else:
                    at = key * LETTERS + code
                    cost += costs[at]
                    key = at % LETTERS**3
            cost += costs[key * LETTERS]
            if cost < best:
                best, kept = cost, out
        return "".join([c for i, c in enumerate(text) if i not in kept]) if kept else text

    def restore(self, token: str) -> str:
        """The word a token means, '' if none: plain words as they are, others decoded."""
        core = token.strip(EDGES)
        at = token.find(core) if core else -1
        if at == 1 and token[0] in "@$!|+":
            core = token[0] + core  # one sign may stand for the first letter, or the last
        if core and len(token) - len(core) - max(at - 1, 0) == 1 and token[-1] in "@$|":
            core = core + token[-1]
        if core.isalpha() and not DOUBLED.search(core):
            return fold(core)
        letters = sum(c.isalpha() for c in core)
        if not letters:
            core = token.strip(BARE_EDGES)
            return self.decode(core) if len(core) > 1 and all(c in LEET for c in core) else ""
        return self.decode(token if 3 * letters < len(core) else core)  # signs at the ends may be letters too

    def runs(self, tokens: list[str]) -> list[tuple[int, int]]:
        """(from, to) of the runs of neighbouring tokens that may hold a word with gaps in it.

        A gap may be inside a word if both its sides are single characters, or if the
        letters next to it are likelier without it, by GAP_COST at least.
        """
        if len(tokens) < 2:
            return []
        sides = self.sides
        packed = np.fromiter(map(sides.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        known, single = (packed[:-1] >= 0) & (packed[1:] >= 0), packed & 1
        packed = np.maximum(packed, 0) >> 1
        t, h = packed[:-1] // LETTERS**3, packed[1:] % LETTERS**3
        last = t % LETTERS * LETTERS**3
        p, two = self.logp, t % LETTERS**2 * LETTERS**2
        kept = p[t * LETTERS] + p[two + h // LETTERS**2] + p[last + h // LETTERS] + p[h]
        dropped = p[t * LETTERS + h // LETTERS**2] + p[two + h // LETTERS] + p[last + h]
        inside = known & ((dropped - kept > GAP_COST) | ((single[:-1] > 0) & (single[1:] > 0)))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
        return [(int(a), int(b) + 1) for a, b in edges.reshape(-1, 2)]

    def words(self, token: str) -> list[str]:
        """What a token means; for a run, the words that its tokens don't mean alone."""
        if " " not in token:
            return [self.restore(token)]
        return list((Counter(self.decode(token).split()) - Counter(map(self.restore, token.split()))).elements())


def _core(token: str) -> str:
    """A token of a run without punctuation at its edges."""
    return token.strip(EDGES) or token


def _sides(token: str) -> int:
    """Codes of a token's last and first three letters, and whether it is a single one, in one number; -1 if it can't be part of a word."""
    core = _core(token)
    if len(core) > 2 and core.isascii() and core.isalpha():
        # most tokens: letters as they are
        a, b, c, x, y, z = core[-3:].encode() + core[:3].encode()
        return (((a - 96) * LETTERS + b - 96) * LETTERS + c - 96) * LETTERS**3 * 2 + (((x - 96) * LETTERS + y - 96) * LETTERS + z - 96) * 2
    single = len(core) == 1 and (core.isalnum() or core in LEET)
    if not single and not core.isalpha() and not any(c.isalpha() for c in core):
        return -1
    a, b, c = (0, 0, 0, *map(_SIGN_CODES.__getitem__, fold(core[-3:])))[-3:]
    x, y, z = (*map(_SIGN_CODES.__getitem__, fold(core[:3])), 0, 0, 0)[:3]
    return (((a * LETTERS + b) * LETTERS + c) * LETTERS**3 + (x * LETTERS + y) * LETTERS + z) * 2 + single


def tokens_of(text: str, decoder: Decoder) -> Counter[str]:
    """Lower-cased tokens, and the runs of them that may hold gaps, with their numbers."""
    tokens = text.lower().split()
    found = Counter(tokens)
    found.update(" ".join(map(_core, tokens[a:b])) for a, b in decoder.runs(tokens))
    return found


def restore_text(text: str, decoder: Decoder) -> str:
    """The text with every token restored."""
    tokens, words, at = (text or "").lower().split(), [], 0
    for a, b in [*decoder.runs(tokens), (len(tokens), len(tokens))]:
        words += map(decoder.restore, tokens[at:a])
        words.append(decoder.decode(" ".join(map(_core, tokens[a:b]))))
        at = b
    return " ".join(x for x in words if x)


def stems_of(word: str) -> tuple[str, ...]:
    """A word itself, and its beginnings, by which inflected words meet."""
    return (word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n)) if word else ()


def features_of(stems: Counter[str]) -> Iterator[str]:
    """Each stem that occurs, and again as one that occurs twice or four times and more."""
    for x, n in stems.items():
        yield x
        if n >= 2:
            yield f"{x}2"
        if n >= 4:
            yield f"{x}4"


def stem_counts(text: str, decoder: Decoder, stems: Memo) -> Counter[str]:
    found: Counter[str] = Counter()
    for token, n in tokens_of(text, decoder).items():
        for x in stems[token]:
            found[x] += n
    return found


class Memo(dict):
    """token -> value, forgotten when large; so memory is bounded on any input."""

    def __init__(self, make, size: int | None = MEMO_SIZE):
        super().__init__()
        self.make, self.most = make, size

    def __missing__(self, token):
        if self.most is not None and len(self) >= self.most:
            self.clear()
        value = self[token] = self.make(token)
        return value


def _sign_code(c: str) -> int:
    c = LEET.get(c, c)[0]
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


#: Letter codes of characters, a sign's by the first letter that it looks like.
_SIGN_CODES = Memo(_sign_code)


@dataclass
class ToxicityModel:
    """Log-probabilities of the decoder's language model, and the classifier's weights."""

    logp: np.ndarray
    weights: dict[str, float]
    bias: float

    def scorer(self):
        decoder = Decoder(self.logp)
        used = {x.rstrip("24") for x in self.weights}

        def make(token: str) -> tuple[str, ...]:
            found = PLAIN.fullmatch(token)
            if not found or not found[1].isalpha():
                return tuple(x for word in decoder.words(token) for x in stems_of(word) if x in used)
            # most tokens are letters that mean what they say, but for doubles
            word = decoder.decode(found[1]) if DOUBLED.search(found[1]) else fold(found[1])
            return tuple(x for x in stems_of(word) if x in used) if word[:4] in starts else ()

        # what a used stem starts with; a word with another beginning has none of them
        starts = {x.rstrip("-")[:4] for x in used}
        # one memory of tokens for their sides; the few with used stems are kept beside it
        stems: dict[str, tuple[str, ...]] = {}

        def both(token: str) -> int:
            if made := make(token):
                stems[token] = made
            return _sides(token)

        decoder.sides, of_runs = Memo(both, None), Memo(make)

        def counts(text: str) -> Counter[str]:
            tokens = text.lower().split()
            found, total = Counter(tokens), Counter()
            # forgotten between texts only, as a text's tokens are asked for again
            if len(decoder.sides) + len(found) > SCORED_TOKENS:
                decoder.sides.clear()
                stems.clear()
            runs = decoder.runs(tokens)
            if len(tokens) == 1:
                decoder.sides[tokens[0]]
            for token, n in found.items():
                for x in stems.get(token, ()):
                    total[x] += n
            for a, b in runs:
                for x in of_runs[" ".join(map(_core, tokens[a:b]))]:
                    total[x] += 1
            return total

        def score(text: str | None) -> float:
            found = sorted(features_of(counts(text or "")))
            z = self.bias + sum(self.weights.get(x, 0.0) for x in found)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id's text divisible by 5; null ids are."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _training_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, float]:
    """doc_id, text, toxic: of each class the labelled documents first by a hash of their
    id, per_class at most; and the share of toxic ones among all labelled documents."""
    usable = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    usable = checkpointed(usable)
    share = usable.agg(F.avg("toxic")).first()[0] or 0.0
    first = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # 2 * per_class rows at most
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id")
    return checkpointed(rows.repartition(SAMPLE_PARTS)), share


def _g_statistic(t: np.ndarray, c: np.ndarray, n_t: int, n_c: int) -> np.ndarray:
    """Log-likelihood ratio of a feature's presence and the class."""
    table = np.stack([t, c, n_t - t, n_c - c]).astype(np.float64)
    n = n_t + n_c
    rows, cols = np.stack([t + c] * 2 + [n - t - c] * 2), np.array([n_t, n_c, n_t, n_c])[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.where(table > 0, table * np.log(table * n / (rows * cols)), 0).sum(axis=0)


def _choose_features(sample: DataFrame, logp, n_toxic: int, n_clean: int) -> list[str]:
    """Features that toxic documents of the sample have oftener than chance would give any
    of all those tested; at most MAX_FEATURES."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(logp.value)
        stems = Memo(lambda token: tuple(x for word in decoder.words(token) for x in stems_of(word)))
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch["text"], batch["toxic"], strict=True):
                for x in features_of(stem_counts(text, decoder, stems)):
                    seen.setdefault(x, [0, 0])[int(y)] += 1
        names = np.array(list(seen), dtype=object)
        counts = np.array(list(seen.values()), dtype=np.int64).reshape(-1, 2)
        for at in range(0, len(names), 20_000):
            part = slice(at, at + 20_000)
            yield pd.DataFrame({"feature": names[part], "t": counts[part, 1], "c": counts[part, 0]}).astype({"feature": object})

    counted = sample.mapInPandas(lambda batches: give_back(count(batches)), "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counted = checkpointed(counted.filter("t + c >= 3").coalesce(SAMPLE_PARTS))
    tested = counted.count()
    # a shortlist by ratio, before the statistic; the driver gets a bounded number of rows
    rare = (
        counted.filter(f"t >= 3 and t * {max(1, n_clean)} > 2 * c * {max(1, n_toxic)}")
        .orderBy(F.expr(f"(t - 1.0) / {max(1, n_toxic)} - 1.5 * c / {max(1, n_clean)}").desc(), "feature")
        .limit(SHORTLIST)
        .toPandas()
    )
    if rare.empty:
        return []
    g = _g_statistic(rare["t"].to_numpy(), rare["c"].to_numpy(), n_toxic, n_clean)
    kept = rare.assign(g=g)[g > 1.7 * np.log(max(tested, 2))]
    return kept.sort_values(["g", "feature"], ascending=[False, True])["feature"].tolist()[:MAX_FEATURES]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Language model over all documents; classifier on the bounded sample of labelled ones.

    Labels are read for rows only that aren't held out. Without labels of both classes, or
    without features that tell them apart, every score is the share of toxic labels.
    """
    spark = docs.sparkSession
    logp = log_probabilities(count_grams(docs))
    sample, share = _training_sample(docs, labels, per_class)
    by_class = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = by_class.get(1, 0), by_class.get(0, 0)
    share = min(max(share, 1e-4), 0.45)
    prior = float(np.log(share / (1 - share)))
    if not n_toxic or not n_clean:
        return ToxicityModel(logp, {}, prior)
    shared = spark.sparkContext.broadcast(logp)
    names = _choose_features(sample, shared, n_toxic, n_clean)
    place = {x: i for i, x in enumerate(names)}

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(shared.value)
        stems = Memo(lambda token: tuple(x for word in decoder.words(token) for x in stems_of(word)))
        for batch in batches:
            found = [sorted(place[x] for x in features_of(stem_counts(text, decoder, stems)) if x in place) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "hits": found})

    # 2 * per_class rows at most, each with the few features it has
    rows = sample.mapInPandas(lambda batches: give_back(hits(batches)), "doc_id long, toxic int, hits array<int>").toArrow().combine_chunks()
    shared.destroy()
    order = pc.sort_indices(rows["doc_id"])
    found, y = rows["hits"].take(order).combine_chunks(), rows["toxic"].take(order).to_numpy().astype(np.float64)
    doc = np.repeat(np.arange(len(found)), np.asarray(pc.list_value_length(found), dtype=np.int64))
    feature = np.asarray(pc.list_flatten(found), dtype=np.int64)
    weight, bias = _fit_logistic(doc, feature, y, len(names))
    bias += prior - float(np.log(n_toxic / n_clean))  # the sample has its own share of toxic documents
    return ToxicityModel(logp, dict(zip(names, weight.tolist(), strict=True)), bias)


def _fit_logistic(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, n_features: int, rounds: int = 25) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on features' presence, by Newton's method.

    ``doc`` and ``feature`` name the features of each document, in the order of documents. The curvature is summed over blocks of
    documents, so no matrix of all of them is held."""
    weight, ridge = np.zeros(n_features + 1), np.append(np.full(n_features, 0.1), 1e-6)
    starts = np.searchsorted(doc, np.arange(0, len(y) + DOCS_PER_BLOCK, DOCS_PER_BLOCK))
    for _ in range(rounds):
        z = weight[-1] + np.bincount(doc, weights=weight[feature], minlength=len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = np.append(np.bincount(feature, weights=(p - y)[doc], minlength=n_features), (p - y).sum()) + ridge * weight
        curve = np.diag(ridge)
        spread = np.sqrt(p * (1 - p) + 1e-9).astype(np.float32)
        for at, (low, high) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            first = at * DOCS_PER_BLOCK
            size = min(DOCS_PER_BLOCK, len(y) - first)
            x = np.zeros((size, n_features + 1), dtype=np.float32)
            x[doc[low:high] - first, feature[low:high]] = 1
            x[:, -1] = 1
            x *= spread[first : first + size, None]
            curve += x.T @ x
        step = np.linalg.solve(curve, slope)
        weight -= step
        if np.abs(step).max() < 1e-6:
            break
    return weight[:-1], float(weight[-1])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.5 or more) of each row of ``docs``.

    Only a text decides its score, so rows are scored where they lie, without a shuffle.
    Null and empty texts score by the bias alone; long ones are read whole; repeated rows
    give repeated rows; an empty table gives none; other columns of ``docs`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            scores = pa.array([of(x) for x in batch.column("text").to_pylist()], type=pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), scores], names=["doc_id", "held_out", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(lambda batches: give_back(score(batches)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text isn't toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(x) < 0.5 for x in batch.column("text").to_pylist()], type=pa.bool_()))

    return docs.mapInArrow(lambda batches: give_back(keep(batches)), docs.schema)
