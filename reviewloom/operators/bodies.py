"""Bodies of comments as they are posted: line breaks, fenced code examples, token lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.operators.diff import trimmed
from reviewloom.operators.filters import ascii_words

# What code looks like, over several lines and on one.
CODE_LINES = r"(?m)[{}();=>]|^\s*(const|let|var|function|if|return|await|fetch|SELECT|UPDATE|DELETE|INSERT|FROM|RUN|CMD)\b"
CODE_LINE = r"[();=>{}]|\b(const|let|var|return|await|fetch|SELECT|UPDATE|DELETE|INSERT|FROM|set[A-Z][A-Za-z0-9_]*|use[A-Z][A-Za-z0-9_]*)\b"
IMAGE_COMMANDS = r"(?m)^\s*(RUN|CMD|ENTRYPOINT|FROM|COPY|ADD)\b"
# The language of a fence by a path's ending, in this order.
LANGUAGES = ((r"\.tsx$", "tsx"), (r"\.ts$", "ts"), (r"\.jsx$", "jsx"), (r"\.js$", "js"), (r"\.ya?ml$", "yaml"), (r"\.jsonc?$", "json"))
# What introduces a code example, and how it is written.
EXAMPLE, HEADING = r"(?s)代码示例[:：]\s*(.*)$", "代码示例:"
FENCE = "```"


def looks_like_code(content: Column) -> Column:
    """Whether a text is code: signs of code anywhere, or words of it (on several lines, at the start of one)."""
    bare = trimmed(content)
    return F.when(bare == "", False).when(F.contains(bare, F.lit("\n")), bare.rlike(ascii_words(CODE_LINES))).otherwise(bare.rlike(ascii_words(CODE_LINE)))


def fence_language(path: Column, content: Column) -> Column:
    found = F.when(content.rlike(ascii_words(IMAGE_COMMANDS)), "bash")
    for pattern, name in LANGUAGES:
        found = found.when(path.rlike(f"(?i){pattern}"), name)
    return found.otherwise("ts")


def with_language(block: Column, path: Column) -> Column:
    """A fenced block with a language, if it is whole and names none."""
    whole = r"(?s)^```([^\n`]*)\n(.*?)```$"
    code = F.regexp_replace(F.regexp_extract(block, whole, 2), r"\n\z", "")
    named = trimmed(F.regexp_extract(block, whole, 1)) != ""
    return F.when(~block.rlike(whole) | named, block).otherwise(F.concat(F.lit(FENCE), fence_language(path, code), F.lit("\n"), code, F.lit("\n" + FENCE)))


def normalized_body(body: Column, path: Column) -> Column:
    """``body`` with plain line breaks and no blanks around it; a code example that ends it is fenced.

    What follows the heading stays as it is if it is blank, or doesn't look like code.
    """
    text = trimmed(F.replace(body, F.lit("\r\n"), F.lit("\n")))
    example = trimmed(F.regexp_extract(text, EXAMPLE, 1))
    before = F.regexp_replace(F.regexp_extract(text, r"(?s)^(.*?)代码示例[:：]\s*.*$", 1), r"\s+\z", "")
    inline = F.regexp_extract(example, r"(?s)^`([^`]+)`$", 1)
    code = F.when(inline != "", trimmed(inline)).otherwise(example)
    fenced = F.concat(F.lit(FENCE), fence_language(path, code), F.lit("\n"), code, F.lit("\n" + FENCE))
    made = F.when(example.startswith(FENCE), with_language(example, path)).when(looks_like_code(code), fenced)
    whole = trimmed(F.concat(before, F.lit(f"\n\n{HEADING}\n\n"), made))
    return F.when(~text.rlike(EXAMPLE) | (example == "") | made.isNull(), text).otherwise(whole)


def with_usage(body: Column, usage: Column) -> Column:
    """The body after the line that tells a call's tokens, if there is one."""
    return F.when(F.coalesce(usage, F.lit("")) == "", body).otherwise(F.concat(usage, F.lit("\n\n"), body))
