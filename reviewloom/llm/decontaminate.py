"""Benchmark decontamination as a prefix-filtered containment join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import LOWER, UPPER, checkpointed, unlike

WINDOW_WORDS = 13
#: Words of a token; windows of fewer words have single words for tokens.
TOKEN_WORDS = 3
#: Size up to which a side of a join is broadcast; beyond it the join is left to shuffle.
BROADCAST_BYTES = 64_000_000
_ROW_BYTES = 64  # of a window, token or candidate document, whose fields have fixed widths

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A to Z are lowered


def _raw_words() -> Column:
    return F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(_WORD), F.lit(0))


def words() -> Column:
    """The words of ``text``: runs of digits, letters and anything beyond ASCII, with A to Z lowered."""
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0))


def tokens(words: str, lone: bool) -> Column:
    """For each place of an array of words the words of the token that begins there, null beyond the
    end: TOKEN_WORDS of them, or one."""
    parts = [F.expr(f"slice({words}, {i + 1}, size({words}))").alias(f"w{i}") for i in range(1, 1 if lone else TOKEN_WORDS)]
    return F.arrays_zip(F.col(words).alias("w0"), *parts)


def token_key(token: str, lone: bool) -> Column:
    """A token's key. ``lower`` changes more than A to Z, but words that are equal with A to Z
    lowered stay equal; what it makes equal besides is told apart when windows are verified."""
    return F.xxhash64(*[F.lower(F.col(f"{token}.w{i}")) for i in range(1 if lone else TOKEN_WORDS)])


def digest(window: Column) -> Column:
    """128 bits that name a window; words hold no spaces, so joined ones are told apart."""
    return F.unhex(F.md5(F.array_join(window, " ").cast("binary")))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item (the item_id as text), len, w (the words) and wid of each run of WINDOW_WORDS words,
    or the whole of a shorter item."""
    listed = benchmark.select(F.col("item_id").cast("string").alias("item"), words().alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW_WORDS - 1), F.lit(1)))
    cut = listed.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.lit(WINDOW_WORDS)).alias("w"))
    return cut.select("item", F.size("w").alias("len"), "w", digest(F.col("w")).alias("wid"))


def window_tokens(windows: DataFrame, lone: bool) -> DataFrame:
    """wid, len, at, key: the tokens of the windows with their places; of windows too short for
    tokens of TOKEN_WORDS words if ``lone``, of the others if not."""
    kept = windows.filter(F.col("len") < TOKEN_WORDS if lone else F.col("len") >= TOKEN_WORDS)
    rows = kept.select("wid", "len", F.posexplode(tokens("w", lone)).alias("at", "t"))
    return rows.filter("true" if lone else f"at <= len - {TOKEN_WORDS}").select("wid", "len", "at", token_key("t", lone).alias("key"))


def document_tokens(docs: DataFrame, keys: DataFrame, lone: bool) -> DataFrame:
    """doc_id, text_key, n_words, at, key of the documents' tokens that are among ``keys`` (key), and
    of each document's first place, whatever is there, so that every document has a row."""
    listed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _raw_words().alias("w"))
    rows = listed.select("doc_id", "text_key", F.size("w").alias("n_words"), F.posexplode_outer(tokens("w", lone)).alias("at", "t"))
    whole = F.col("n_words") > 0 if lone else F.col("at") <= F.col("n_words") - TOKEN_WORDS
    keyed = rows.select("doc_id", "text_key", "n_words", F.coalesce("at", F.lit(0)).alias("at"), F.when(whole, token_key("t", lone)).alias("key"))
    return keyed.join(keys.withColumn("known", F.lit(True)), "key", "left").filter("known or at = 0").select("doc_id", "text_key", "n_words", "at", F.when(F.col("known"), F.col("key")).alias("key"))


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def candidates(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key, start, len, wid: where the rarest token of a window occurs with room for the
    window; and doc_id, text_key, n_words of every row of ``docs``.

    Containment of a whole window leaves a prefix of one token in the order of rarity. Rarity
    is the number of occurrences in all documents, counted for the benchmark's tokens only;
    a window with a token that no document has is nowhere. Texts are read once (once more, if
    there are windows of fewer than TOKEN_WORDS words): tokens that the benchmark has too are
    kept, counted and joined with the prefixes.
    """
    once, found, rows = windows.dropDuplicates(["wid"]), None, None
    for lone in (False, True):
        own = checkpointed(window_tokens(once, lone))
        n = own.count()
        if lone and not n:
            continue
        seen = checkpointed(document_tokens(docs, _small(own.select("key").distinct(), n * _ROW_BYTES), lone))
        rows = rows or seen.filter("at = 0").select("doc_id", "text_key", "n_words")
        seen = seen.filter("key is not null")
        counts = seen.groupBy("key").agg(F.count("*").alias("occurs"))
        prefix = (
            own.join(counts, "key", "left")
            .groupBy("wid", "len")
            .agg(F.count_if(F.col("occurs").isNull()).alias("absent"), F.min_by(F.struct("key", "at"), F.struct("occurs", "at")).alias("t"))
            .filter("absent = 0")
            .select("wid", "len", F.col("t.key").alias("key"), F.col("t.at").alias("offset"))
        )
        hits = seen.join(_small(prefix, n * _ROW_BYTES), "key").withColumn("start", F.col("at") - F.col("offset") + 1)
        hits = hits.filter("start >= 1 and start + len - 1 <= n_words").select("doc_id", "text_key", "start", "len", "wid")
        found = hits if found is None else found.unionByName(hits)
    return found, rows


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: its words, those inside an occurrence of an item's window, the
    items with occurring windows, and whether it is contaminated.

    Texts are read for the prefix join, which tells their numbers of words too, and, of documents
    with candidates only, for the comparison of windows by their digests; no exploded row carries
    a text. Candidates are grouped by document, so their number is bounded by a document's
    length and the windows that share a token.

    A null text has no words, an item without words no window, an item without id marks
    words but isn't listed; long texts are searched whole; rows that repeat a document get
    its result each, rows that differ in text under one id their own; without documents there
    are no rows, without items no hits; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    windows = checkpointed(item_windows(benchmark))
    found, rows = candidates(docs, windows)
    met = checkpointed(found.distinct())
    per_doc = met.groupBy(F.col("doc_id").alias("c_doc"), F.col("text_key").alias("c_key")).agg(F.collect_list(F.struct("start", "len", "wid")).alias("c"))
    n_met = met.select("doc_id", "text_key").distinct().count()
    wanted = _small(met.select(F.col("doc_id").alias("c_doc"), F.col("text_key").alias("c_key")).distinct(), n_met * _ROW_BYTES)
    same = F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("text_key") == F.col("c_key"))
    texts = (
        docs.withColumn("text_key", F.xxhash64("text"))
        .join(wanted, same, "left_semi")
        .dropDuplicates(["doc_id", "text_key"])
        .select("doc_id", "text_key", words().alias("w"))
    )
    is_there = F.filter("c", lambda x: digest(F.slice(F.col("w"), x["start"], x["len"])) == x["wid"])
    hits = checkpointed(
        texts.join(per_doc, same)
        .select("doc_id", "text_key", is_there.alias("h"))
        .filter("size(h) > 0")
        .select(
            "doc_id",
            "text_key",
            F.expr("size(array_distinct(flatten(transform(h, x -> sequence(x.start, x.start + x.len - 1)))))").alias("n_hit"),
            F.expr("array_distinct(transform(h, x -> x.wid))").alias("wids"),
        )
    )
    items = windows.select("wid", "item").distinct()
    size = windows.agg(F.sum(F.coalesce(F.octet_length("item"), F.lit(0)) + _ROW_BYTES)).first()[0] or 0
    listed = (
        hits.select("doc_id", "text_key", F.explode("wids").alias("wid"))
        .join(_small(items, size), "wid")
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    result = hits.join(listed.withColumnsRenamed({"doc_id": "c_doc", "text_key": "c_key"}), same).select(
        F.col("doc_id").alias("h_doc"), F.col("text_key").alias("h_key"), "n_hit", "items"
    )
    n_hit, items_or_none = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return (
        rows.join(result, F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("text_key") == F.col("h_key")), "left")
        .withColumns({"n_hit": n_hit, "items": items_or_none})
        .select(
            "doc_id",
            "text_key",
            F.col("n_words").cast("long").alias("n_words"),
            "n_hit",
            "items",
            ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that aren't contaminated. Columns of any name are
    kept, as those added here are named unlike them."""
    doc, key = unlike(docs, "bad_doc", "bad_key")
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left_anti")
