"""Answers of a language model: recovering their JSON and checking its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.text import once
from reviewloom.operators.diff import trimmed

FENCED = r"(?is)```(?:json)?\s*(.*?)```"
COMMENT = "array<struct<line:string,body:string,side:string>>"


def is_json(text: Column) -> Column:
    """Whether all of a text is one JSON value. The parser stops after a value, so it is asked
    for the value inside an array and inside an object."""
    inside = lambda a, b: F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull()
    return (text != "") & inside("[", "]") & inside('{"x":', "}")


def top_level_objects(text: Column) -> Column:
    """The outermost {...} of a text, braces in JSON strings left out; one fold over its signs, which keeps
    places, not texts, so it is linear."""
    start = F.expr("named_struct('at', 0, 'depth', 0, 'quoted', false, 'begun', 0, 'found', cast(array() as array<struct<first:int,last:int>>))")

    def step(s: Column, c: Column) -> Column:
        deeper, back = ~s["quoted"] & (c == "{"), ~s["quoted"] & (c == "}") & (s["depth"] > 0)
        at, depth = s["at"] + F.length(c), s["depth"] + deeper.cast("int") - back.cast("int")
        begun = F.when(deeper & (s["depth"] == 0), at).otherwise(s["begun"])
        return F.struct(
            at.alias("at"),
            depth.alias("depth"),
            (s["quoted"] != (c == '"')).alias("quoted"),
            begun.alias("begun"),
            F.when(back & (s["depth"] == 1), F.concat(s["found"], F.array(F.struct(begun.alias("first"), at.alias("last"))))).otherwise(s["found"]).alias("found"),
        )

    # a sign after a backslash is told with it, and signs that mean nothing by runs
    pieces = F.regexp_extract_all(text, F.lit(r'(?s)[^{}"\\]+|\\.?|[{}"]'), F.lit(0))
    places = F.aggregate(pieces, start, step, lambda s: s["found"])
    return F.transform(places, lambda p: F.substr(text, p["first"], p["last"] - p["first"] + 1))


def recovered_json(content: Column) -> Column:
    """The JSON in an answer, by the first of these that parses: all of it, a fenced block, from
    the first { to the last }, from the first [ to the last ], its outermost objects as an array."""
    return once(trimmed(content), _recovered)


def _recovered(text: Column) -> Column:
    between = lambda a, b: F.substr(text, F.instr(text, F.lit(a)), F.length(text) - F.instr(F.reverse(text), F.lit(b)) + 2 - F.instr(text, F.lit(a)))
    holds = lambda a, b: (F.instr(text, F.lit(a)) > 0) & (F.instr(F.reverse(text), F.lit(b)) > 0) & (F.length(text) - F.instr(F.reverse(text), F.lit(b)) + 1 > F.instr(text, F.lit(a)))
    valid = lambda value: once(value, lambda x: F.when(is_json(x), x))
    joined = lambda objects: F.when((F.size(objects) > 0) & F.forall(objects, is_json), F.concat(F.lit("["), F.array_join(objects, ","), F.lit("]")))
    return F.coalesce(
        valid(text),
        F.when(text.rlike(FENCED), valid(trimmed(F.regexp_extract(text, FENCED, 1)))),
        F.when(holds("{", "}"), valid(between("{", "}"))),
        F.when(holds("[", "]"), valid(between("[", "]"))),
        once(top_level_objects(text), joined),
    )


def payload_comments(payloads: DataFrame, key: str = "payload_id") -> DataFrame:
    """key, ord, line, body, side of the comments in recovered JSON: an array of comments, or an
    object with or without ``comments``. One comment that doesn't fit makes the whole payload invalid."""
    none = F.expr(f"cast(array() as {COMMENT})")
    as_object = lambda body: F.coalesce(F.from_json(body, f"struct<comments:{COMMENT}>")["comments"], none)
    listed = once(F.col("json"), lambda body: F.when(F.ltrim(body).startswith("["), F.from_json(body, COMMENT)).otherwise(as_object(body)))
    number = lambda x: x["line"].try_cast("double")
    fits = lambda x: F.coalesce((number(x) > 0) & (number(x) == F.floor(number(x))) & (trimmed(x["body"]) != "") & F.coalesce(x["side"].isin("LEFT", "RIGHT"), F.lit(True)), F.lit(False))
    valid = once(listed, lambda c: F.when(F.forall(c, fits), c))
    # an outer explode, filtered after, as an inner one makes the answer's JSON anew for each of the filters before it
    return payloads.select(key, F.posexplode_outer(valid).alias("ord", "x")).filter("ord is not null").select(
        key, "ord", F.col("x.line").cast("double").cast("int").alias("line"), trimmed(F.col("x.body")).alias("body"), F.coalesce("x.side", F.lit("RIGHT")).alias("side")
    )


#: Dates as hosts write them, without the day of the week and with an offset for GMT.
HTTP_DATE = "d MMM yyyy HH:mm:ss XXX"


def retry_delay_ms(retry_after: Column, attempt: Column, base_ms: int = 1000, now: Column | None = None) -> Column:
    """How long to wait: what the server asks for, in seconds (halves up) or until a date, else the base doubled each
    attempt. ``now`` is the present time unless given."""
    text = F.trim(retry_after)
    asked = text.try_cast("double")
    bare = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]+,\s*", ""), r"\s(GMT|UTC)$", " +00:00")
    until = F.try_to_timestamp(bare, F.lit(HTTP_DATE))
    left = F.greatest(F.lit(0), F.unix_millis(until) - F.unix_millis(F.current_timestamp() if now is None else now))
    finite = (asked >= 0) & (asked < F.lit(float("inf")))
    return F.when(finite, F.floor(asked * 1000 + 0.5).cast("long")).when(asked.isNull() & until.isNotNull(), left).otherwise((base_ms * F.pow(F.lit(2), attempt)).cast("long"))
