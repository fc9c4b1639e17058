"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Everything that touches rows is made of DataFrame functions. Only counts of vote patterns,
at most one row for each kind and combination of votes, reach the driver, where expectation
maximisation and the classifier's fit run on them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_spelled", "phone_local", "national_id", "iban")
KINDS = BASE_KINDS + ADDED_KINDS
LABELERS = ("pattern", "gazetteer", "context", "checksum")
CONTEXT_CHARS = 32

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "length(regexp_replace(m, '[^0-9]', ''))"
_LUHN = (
    "aggregate(sequence(1, length(regexp_replace(m, '[^0-9]', ''))), 0L, (a, i) -> a + "
    "(case when i % 2 = 1 then bigint(substr(reverse(regexp_replace(m, '[^0-9]', '')), i, 1)) else "
    "(2 * bigint(substr(reverse(regexp_replace(m, '[^0-9]', '')), i, 1))) div 10 + "
    "(2 * bigint(substr(reverse(regexp_replace(m, '[^0-9]', '')), i, 1))) % 10 end)) % 10 = 0"
)
_DOMAIN = "m rlike '[.][A-Za-z]{2,6}$'"


@dataclass(frozen=True)
class SpanKind:
    """How spans of a kind are found, and how labelers see them; SQL over m (match), b and a (text around).

    ``\\\\G`` (where the last match ended) or a look-behind keep a match from being tried
    inside a run whose start has failed; nothing that would match there is lost.
    """

    name: str
    pattern: str
    guard: str  # a cheap regex that every text with a match has
    keep: str  # which matches are candidates
    base: str  # which candidates are base spans
    checksum: str  # vote
    pattern_vote: str
    cues: str  # gazetteer, a regex on what stands before
    against: str = field(default=r"(?:version|isbn|order|page|vol|no[.]|serial|build)[^A-Za-z]*$")


SPAN_KINDS = (
    SpanKind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@[A-Za-z0-9-]+[.]",
        "true",
        "true",
        f"if({_DOMAIN}, 1, -1)",
        "1",
        r"(?:e-?mail|mail|contact|write|from|to|cc)[^A-Za-z]*$",
    ),
    SpanKind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
        "[0-9][.][0-9]+[.][0-9]",
        "true",
        f"m rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$'",
        f"if(m rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$', 1, -1)",
        "if(m rlike '(?:^|[.])0[0-9]', -1, 1)",
        r"(?:ip|host|server|address|addr|from|client)[^A-Za-z]*$",
    ),
    SpanKind(
        "card",
        r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
        "[0-9](?:[\\x20-]?[0-9]){12}",
        f"{_DIGITS} between 13 and 19",
        f"{_DIGITS} between 14 and 19 and {_LUHN}",
        f"if({_LUHN}, 1, -1)",
        f"if({_DIGITS} in (13, 14, 15, 16, 19), 1, -1)",
        r"(?:card|visa|credit|debit|master|amex|pay)[^A-Za-z]*$",
    ),
    SpanKind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "[+][0-9][\\x20().0-9-]",
        f"{_DIGITS} between 8 and 15",
        f"{_DIGITS} between 10 and 15",
        f"if({_DIGITS} between 10 and 15, 1, -1)",
        "if(m rlike '[0-9][ ).-]+[0-9]', 1, 0)",
        r"(?:tel|phone|call|fax|mobile|cell|whatsapp)[^A-Za-z]*$",
    ),
    SpanKind(
        "email_spelled",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]++(?: ?[(\[] ?dot ?[)\]] ?[A-Za-z0-9-]++)++",
        "[(\\[] ?at ?[)\\]]",
        "true",
        "false",
        "if(m rlike '[A-Za-z]{2,6}$', 1, -1)",
        "1",
        r"(?:e-?mail|mail|contact|write|from|to|cc)[^A-Za-z]*$",
    ),
    SpanKind(
        "phone_local",
        r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
        "[0-9]{3}[).-] ?[0-9]{3}[.-][0-9]{4}",
        "true",
        "false",
        "if(m rlike '^[(]?[2-9]', 1, -1)",
        "1",
        r"(?:tel|phone|call|fax|mobile|cell|whatsapp)[^A-Za-z]*$",
    ),
    SpanKind(
        "national_id",
        r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])",
        "[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "true",
        "false",
        "if(m rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$', 1, -1)",
        "1",
        r"(?:ssn|social|security|id|identity)[^A-Za-z]*$",
    ),
    SpanKind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
        "true",
        "false",
        "if(m rlike '^[A-Z]{2}[0-9]{2}[ 0-9]+$', 1, -1)",
        "if(length(replace(m, ' ', '')) between 15 and 34, 1, -1)",
        r"(?:iban|account|bank|konto|compte|cuenta)[^A-Za-z]*$",
    ),
)

_CANDIDATE = (
    "array<struct<start:bigint,end:bigint,rank:int,kind:string,base:boolean,"
    "pattern:int,gazetteer:int,context:int,checksum:int>>"
)


#: Matches that one fold goes over. Folds append to arrays, which copies them; so a text's
#: matches are folded in blocks, and the blocks once more.
MATCHES_PER_BLOCK = 256


def _candidates(kind: SpanKind, rank: int) -> Column:
    """Candidates of a kind, from ``z``: the texts before (p) and after (n) each match f.

    A running length over both gives each match's start, in code points: in its block first,
    and then, with the lengths of the blocks before, in the text.
    """
    votes = ", ".join(f"'{x}', c.{x}" for x in ("rank", "kind", "base", *LABELERS))
    block = f"""aggregate(slice(z, i * {MATCHES_PER_BLOCK} + 1, {MATCHES_PER_BLOCK}),
          named_struct('at', 0L, 'out', cast(array() as {_CANDIDATE})),
          (s, x) -> named_struct(
            'at', s.at + length(x.p) + coalesce(length(x.f), 0),
            'out', case when x.f is null or not ({_on(kind.keep)}) then s.out
              else concat(s.out, array(named_struct(
                'start', s.at + length(x.p), 'end', s.at + length(x.p) + length(x.f), 'rank', {rank}, 'kind', '{kind.name}',
                'base', {_on(kind.base)},
                'pattern', {_on(kind.pattern_vote)},
                'gazetteer', case when lower(right(x.p, {CONTEXT_CHARS})) rlike r'{kind.cues}' then 1
                                  when lower(right(x.p, {CONTEXT_CHARS})) rlike r'{kind.against}' then -1 else 0 end,
                'context', if(right(x.p, 1) rlike '[A-Za-z0-9]' or left(coalesce(x.n, ''), 1) rlike '[A-Za-z0-9]', -1, 1),
                'checksum', {_on(kind.checksum)}))) end))"""
    return F.expr(
        f"""flatten(aggregate(transform(sequence(0, greatest(size(z) - 1, 0) div {MATCHES_PER_BLOCK}), i -> {block}),
          named_struct('at', 0L, 'out', cast(array() as array<{_CANDIDATE}>)),
          (s, b) -> named_struct('at', s.at + b.at, 'out', concat(s.out, array(
            transform(b.out, c -> named_struct('start', c.start + s.at, 'end', c.end + s.at, {votes})))))).out)"""
    )


def _on(sql: str) -> str:
    """``sql`` over the match m, for the lambda's x.f."""
    return re.sub(r"\bm\b", "x.f", sql)


def label_candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``candidates``: every kind's candidate spans with the labelers' votes (1, 0, -1)."""
    rows = docs.select("doc_id", text_or_empty().alias("t"))
    empty = F.expr("cast(array() as array<string>)")
    for kind in SPAN_KINDS:
        found = F.col("t").rlike(kind.guard)
        rows = rows.withColumns(
            {
                f"p_{kind.name}": F.when(found, F.split("t", kind.pattern, -1)).otherwise(empty),
                f"f_{kind.name}": F.when(found, F.regexp_extract_all("t", F.lit(kind.pattern), F.lit(0))).otherwise(empty),
            }
        )
    rows = rows.drop("t")
    for rank, kind in enumerate(SPAN_KINDS):
        zipped = _candidates(kind, rank)
        rows = rows.withColumnsRenamed({f"p_{kind.name}": "p", f"f_{kind.name}": "f"})
        rows = rows.withColumn("n", F.expr("slice(p, 2, greatest(1, size(p)))"))
        rows = rows.withColumn("z", F.arrays_zip("p", "f", "n")).drop("p", "f", "n")
        rows = rows.withColumn(f"c_{kind.name}", zipped).drop("z")
    every = F.concat(*[F.col(f"c_{k.name}") for k in SPAN_KINDS])
    return rows.select("doc_id", every.alias("candidates"))


Votes = tuple[int, ...]


def estimate_labelers(counts: Sequence[tuple[str, Votes, int]], rounds: int = 50) -> tuple[dict, dict]:
    """Dawid-Skene EM over (kind, votes, count): each labeler's table P(vote | truth), and
    P(true | kind, votes). Starts from the majority of votes; add-one smoothing throughout."""
    belief = {(k, v): min(0.95, max(0.05, 0.5 + 0.15 * sum(v))) for k, v, _ in counts}
    tables: dict = {}
    for _ in range(rounds):
        prior: dict[str, list[float]] = {}
        tables = {(i, y, x): 1.0 for i in range(len(LABELERS)) for y in (0, 1) for x in (-1, 0, 1)}
        for k, v, n in counts:
            p = belief[k, v]
            both = prior.setdefault(k, [1.0, 1.0])
            both[0] += n * (1 - p)
            both[1] += n * p
            for i, x in enumerate(v):
                tables[i, 1, x] += n * p
                tables[i, 0, x] += n * (1 - p)
        for i in range(len(LABELERS)):
            for y in (0, 1):
                total = sum(tables[i, y, x] for x in (-1, 0, 1))
                for x in (-1, 0, 1):
                    tables[i, y, x] /= total
        for k, v, _ in counts:
            no, yes = (math.log(prior[k][y]) + sum(math.log(tables[i, y, x]) for i, x in enumerate(v)) for y in (0, 1))
            belief[k, v] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
    return tables, belief


def fit_classifier(counts: Sequence[tuple[str, Votes, int]], belief: dict, steps: int = 300) -> dict:
    """Logistic regression on votes and kinds, weighted by counts, towards EM's beliefs."""
    names = ["bias", *LABELERS, *KINDS]
    weight = dict.fromkeys(names, 0.0)
    total = sum(n for *_, n in counts) or 1
    for _ in range(steps):
        slope = {x: 0.001 * weight[x] for x in names}
        for k, v, n in counts:
            inputs = {"bias": 1.0, k: 1.0, **dict(zip(LABELERS, map(float, v), strict=True))}
            p = 1 / (1 + math.exp(-sum(weight[x] * y for x, y in inputs.items())))
            for x, y in inputs.items():
                slope[x] += n / total * (p - belief[k, v]) * y
        for x in names:
            weight[x] -= 2.0 * slope[x]
    return weight


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document with its personal data; offsets are code points, ends exclusive.

    Texts are read once, for candidates and votes; the narrow rows are written to the
    checkpoint folder, their vote patterns counted over all documents, and the classifier
    that is fitted on those counts then keeps or drops each candidate. Base spans stay, and
    others that overlap one of them go. No row meets another's, so nothing wide is shuffled.

    A null or empty text has no spans; long texts are searched whole; repeated rows give
    repeated rows; an empty table gives none; other columns of ``docs`` are ignored.
    """
    labelled = checkpointed(label_candidates(docs))
    votes = (
        labelled.filter(F.size("candidates") > 0)
        .select(F.explode("candidates").alias("c"))
        .groupBy("c.kind", *[f"c.{x}" for x in LABELERS])
        .count()
    )
    # at most one row for each kind and each of 3^4 combinations of votes
    counts = [(r["kind"], tuple(r[x] for x in LABELERS), r["count"]) for r in votes.collect()]
    counts.sort()
    _, belief = estimate_labelers(counts)
    weight = fit_classifier(counts, belief)
    kinds = ", ".join(f"'{k}', {weight[k]:.12f}D" for k in KINDS)
    logit = " + ".join([f"{weight['bias']:.12f}D", f"element_at(map({kinds}), c.kind)", *[f"{weight[x]:.12f}D * c.{x}" for x in LABELERS]])
    cut = math.log(threshold / (1 - threshold))
    spans = labelled.select(
        "doc_id",
        F.expr("filter(candidates, c -> c.base)").alias("base"),
        F.expr(f"filter(candidates, c -> not c.base and {logit} >= {cut:.12f}D)").alias("likely"),
    ).select(
        "doc_id",
        F.expr("array_sort(transform(base, c -> struct(c.start, c.rank, c.end, c.kind)))").alias("base"),
        F.expr("filter(likely, c -> not exists(base, b -> b.start < c.end and c.start < b.end))").alias("likely"),
    )
    every = F.expr("array_sort(concat(base, transform(likely, c -> struct(c.start, c.rank, c.end, c.kind))))")
    joined = lambda x: F.array_join(F.transform(x, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")
    return spans.select(
        "doc_id",
        *[F.expr(f"size(filter(base, c -> c.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.size("likely").cast("long").alias("n_added"),
    )
