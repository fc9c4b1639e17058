"""Identifiers that changed code speaks of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.filters import ascii_words

# Words that are no identifiers worth a search.
STOP_NAMES = (
    "if", "for", "while", "switch", "catch", "return", "await", "async", "const", "let", "var", "true", "false", "null",
    "undefined", "import", "export", "from", "default", "type", "new", "extends", "implements", "function", "class", "interface", "console",
)
# Where identifiers stand, and what each place counts.
NAME_SOURCES = (
    (r"\b([a-z][A-Za-z0-9_$]*)\s*\(", 6),
    (r"\b(?:extends|implements|new|as)\s+([A-Z][A-Za-z0-9_$]*)", 7),
    (r":\s*([A-Z][A-Za-z0-9_$]*)\b", 6),
    (r"<([A-Z][A-Za-z0-9_$]*)\b", 5),
    (r"\b([A-Z][A-Za-z0-9_$]*)\b", 2),
)
# Imports, and what they count; names that are identifiers.
NAMED_IMPORT, NAMED_SCORE = r"import\s+(?:type\s+)?\{([^}]+)\}\s+from\s+['\"]([^'\"]+)['\"]", 10
DEFAULT_IMPORT, DEFAULT_SCORE = r"import\s+([A-Za-z_$][\w$]*)\s*(?:,\s*\{[^}]+\})?\s+from\s+['\"]([^'\"]+)['\"]", 9
NAMESPACE_IMPORT, NAMESPACE_SCORE = r"import\s+\*\s+as\s+([A-Za-z_$][\w$]*)\s+from\s+['\"]([^'\"]+)['\"]", 7
USEFUL = r"^[A-Za-z_$][A-Za-z0-9_$]*$"


def is_useful(name: Column) -> Column:
    return name.rlike(USEFUL) & (F.length(name) >= 2) & ~name.isin(*STOP_NAMES)


def signal_text(content: Column) -> Column:
    """The added lines of a patch without their sign; all of a text that has none."""
    added = F.filter(F.split(content, "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.when(F.size(added) > 0, F.array_join(F.transform(added, lambda x: F.substr(x, F.lit(2))), "\n")).otherwise(content)


def identifier_candidates(texts: DataFrame, key: str = "doc_id", column: str = "content") -> DataFrame:
    """key, name, score, import_source, rank: names by the sum of what their places count.

    Each text gives one array of (name, score, source), exploded once and summed by name.
    """
    text = signal_text(F.col(column))
    rows = texts.select(key, text.alias("t"))

    def names_at(pattern: str, score: int) -> Column:
        found = F.regexp_extract_all("t", F.lit(pattern), F.lit(1))
        return F.transform(found, lambda x: F.struct(x.alias("name"), F.lit(score).alias("score"), F.lit(None).cast("string").alias("source")))

    plain = [names_at(ascii_words(p), n) for p, n in NAME_SOURCES]

    def imports(pattern: str, score: int) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all("t", F.lit(pattern), F.lit(1)).alias("names"), F.regexp_extract_all("t", F.lit(pattern), F.lit(2)).alias("source"))
        return F.flatten(
            F.transform(
                pairs,
                lambda x: F.transform(
                    F.split(x["names"], ","),
                    lambda n: F.struct(
                        F.trim(F.split(F.regexp_replace(F.trim(n), r"^type\s+", ""), r"(?i)\s+as\s+")[0]).alias("name"), F.lit(score).alias("score"), x["source"].alias("source")
                    ),
                ),
            )
        )

    found = F.concat(imports(NAMED_IMPORT, NAMED_SCORE), imports(DEFAULT_IMPORT, DEFAULT_SCORE), imports(NAMESPACE_IMPORT, NAMESPACE_SCORE), *plain)
    names = rows.select(key, F.posexplode(found).alias("ord", "x")).select(key, "ord", "x.name", "x.score", "x.source").filter(is_useful(F.col("name")))
    scored = names.groupBy(key, "name").agg(F.sum("score").alias("score"), F.min_by("source", F.when(F.col("source").isNotNull(), F.col("ord"))).alias("import_source"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "name")))


def missing_candidates(candidates: DataFrame, resolved: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """The best candidates that aren't resolved yet; resolved: key, name."""
    left = candidates.join(resolved, [key, "name"], "left_anti")
    return left.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).filter(F.col("n") <= limit)


def capped_context(items: DataFrame, caps: DataFrame, key: str = "doc_id") -> DataFrame:
    """Context items, once by kind, name and file, in order, as many of a kind as its cap.

    items: key, kind, name, file, ord; caps: key, kind, cap.
    """
    first = Window.partitionBy(key, "kind", "name", "file").orderBy("ord")
    once = items.withColumn("again", F.row_number().over(first)).filter("again = 1").drop("again")
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(key, "kind").orderBy("ord")))
    return placed.join(caps, [key, "kind"]).filter("place <= cap").drop("cap")


def agent_profiles(raw: DataFrame, agents: DataFrame, key: str) -> DataFrame:
    """key, agent_id, place: the known agents that a comma-separated list names, in its order.

    An empty list is all agents, one that names none that is known is the first agent.
    """
    order = agents.select("agent_id", "place")
    named = raw.select(key, F.posexplode(F.split(F.coalesce("agents", F.lit("")), ",")).alias("n", "a")).select(key, "n", F.lower(F.trim("a")).alias("agent_id"))
    known = named.join(F.broadcast(order.select("agent_id")), "agent_id").groupBy(key, "agent_id").agg(F.min("n").alias("n"))
    placed = known.select(key, "agent_id", F.row_number().over(Window.partitionBy(key).orderBy("n")).alias("place"))
    blank = raw.filter(F.trim(F.coalesce("agents", F.lit(""))) == "").select(key)
    every = blank.join(F.broadcast(order)).select(key, "agent_id", "place")  # a dimension of three rows
    none = raw.select(key).join(blank, key, "left_anti").join(placed.select(key).distinct(), key, "left_anti")
    return placed.union(every).union(none.join(F.broadcast(order.filter("place = 1"))).select(key, "agent_id", "place"))
