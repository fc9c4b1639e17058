"""What changed lines of configuration and scripts touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from reviewloom.functions import scanner
from reviewloom.operators.diff import trimmed

MAX_KEYS, MAX_PATHS, MAX_JOBS = 10, 8, 6
# Outermost keys of pipelines that are no jobs, what is told of jobs, and where pipelines lie.
SETTINGS = ("stages", "workflow", "default", "variables", "include")
JOB_FIELDS = ("stage", "when", "allow_failure", "needs")
PIPELINE_PATHS = r"^(\.gitlab-ci\.yml$|\.gitlab/|\.github/workflows/|\.circleci/|\.buildkite/)"
# The labels of what is told of structured files.
PATHS_LABEL, JOBS_LABEL, KEYS_LABEL, TOP_LABEL, SECTIONS_LABEL, COMMANDS_LABEL = "配置键路径摘要", "CI 结构摘要", "JSON 键摘要", "JSON 顶层结构", "配置节摘要", "命令结构摘要"
# Lines of configurations and scripts.
KEY_LINE = r"^\s*([A-Za-z0-9_.-]+)\s*:\s*(.*)$"
CONTROL_WORDS = r"^(if|then|else|fi|for|do|done|while|case|esac)(?![A-Za-z0-9_])"
ENV_PREFIX = r"^([A-Z_][A-Z0-9_]*=(\"[^\"]*\"|'[^']*'|[^\s]+)\s+)*"
COMMAND = r"^([A-Za-z0-9_./:-]+)"
# Which files are read as which structure.
KIND_PATHS = (
    ("yaml", r"[^/]\.(yml|yaml)/*$"),
    ("json", r"[^/]\.(json|jsonc)/*$"),
    ("keys", r"[^/]\.(toml|ini|conf|properties)/*$"),
    ("shell", r"[^/]\.(sh|bash|zsh)/*$|(^|/)dockerfile/*$"),
)


def _first_distinct(rows: DataFrame, key: str, value: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` different values of each key, by their first place."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("at"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("at"))).filter(F.col("n") <= limit).select(key, "n", value)


def json_keys(touched: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys that added lines of JSON name: quoted ones first, else bare ones."""
    quoted, bare = F.regexp_extract("text", r'"([^"]+)"\s*:', 1), F.regexp_extract("text", r"([A-Za-z0-9_.-]+)\s*:", 1)
    rows = touched.withColumn("name", F.when(quoted != "", quoted).otherwise(bare)).filter("name <> ''")
    return _first_distinct(rows, key, "name", ["hunk_ix", "line_ix"], MAX_KEYS)


def top_level_keys(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first keys of each JSON object file; comments are left out, other files give none."""
    bare = F.regexp_replace(F.regexp_replace("content", r"(?m)^\s*//.*$", ""), r"(?s)/\*.*?\*/", "")
    return files.select(key, F.posexplode(F.slice(F.json_object_keys(bare), 1, MAX_KEYS)).alias("n", "name"))


def shell_commands(touched: DataFrame, key: str = "doc_id") -> DataFrame:
    """The commands that added script lines start: control words, comments and assignments left out."""
    line = trimmed(F.col("text"))
    command = F.regexp_extract(F.regexp_replace(line, ENV_PREFIX, ""), COMMAND, 1)
    rows = touched.filter((line != "") & ~line.startswith("#") & ~line.rlike(CONTROL_WORDS)).withColumn("name", command).filter("name <> ''")
    return _first_distinct(rows, key, "name", ["hunk_ix", "line_ix"], MAX_KEYS)


def section_keys(lines: DataFrame, touched: DataFrame, key: str = "doc_id") -> DataFrame:
    """section.key of the touched lines of INI-like files.

    lines: key, line (from 1), text; touched: key, line. The section is the last one seen.
    """
    bare = lines.withColumn("t", trimmed(F.col("text"))).filter((F.col("t") != "") & ~F.col("t").rlike("^[#;]"))
    section = F.regexp_extract("t", r"^\[([^\]]+)\]$", 1)
    order = Window.partitionBy(key).orderBy("line")
    named = bare.withColumn("section", F.last(F.when(section != "", F.trim(section)), ignorenulls=True).over(order))
    name = F.regexp_extract("t", r"^([A-Za-z0-9_.-]+)\s*[:=]", 1)
    rows = named.withColumn("own", name).filter((section == "") & (F.col("own") != "")).join(touched.select(key, "line").distinct(), [key, "line"])
    return _first_distinct(rows.withColumn("name", F.concat_ws(".", "section", "own")), key, "name", ["line"], MAX_KEYS)


@udtf(returnType=scanner.KEY_LINES)
class KeyLines:
    """The lines of a text that give a key."""

    def eval(self, content: str, touched: list):
        yield from scanner.key_lines(content, touched)


def yaml_lines(files: DataFrame, touched: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and ``scanner.KEY_LINES`` of each YAML file; ``path`` is that of touched lines.
    files: key, content; touched: key, line."""
    asked = touched.groupBy(key).agg(F.collect_set(F.col("line").cast("int")).alias("touched"))
    none = F.expr("cast(array() as array<int>)")
    rows = files.select(key, "content").join(asked, key, "left").withColumn("touched", F.coalesce("touched", none))
    return rows.lateralJoin(KeyLines(F.col("content").outer(), F.col("touched").outer())).drop("content", "touched")


def yaml_paths(files: DataFrame, touched: DataFrame, key: str = "doc_id", limit: int = MAX_PATHS) -> DataFrame:
    """Key paths of the touched lines of YAML files, the first of them. files: key, content; touched: key, line."""
    named = yaml_lines(files, touched, key).filter("path is not null").select(key, "line", F.col("path").alias("name"))
    return _first_distinct(named, key, "name", ["line"], limit)


def yaml_jobs(lines: DataFrame, key: str = "doc_id", limit: int = MAX_JOBS) -> DataFrame:
    """key, n, job, stage, when, allow_failure, needs: the outermost keys of each YAML file that aren't settings, in the
    order in which they first stand, with what was last said below the last place of each. lines: of ``yaml_lines``."""
    tops = lines.filter((F.col("indent") == 0) & ~F.col("key").isin(*SETTINGS))
    jobs = tops.groupBy(key, F.col("key").alias("job")).agg(F.min("line").alias("first"), F.max("line").alias("top_line"))
    below = lines.filter((F.col("depth") >= 2) & (F.col("value") != "") & F.col("key").isin(*JOB_FIELDS))
    last = lambda name: F.max_by("value", F.when(F.col("key") == name, F.col("line"))).alias(name)
    needs = F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == "needs", F.struct("line", "value")))), lambda x: x["value"]).alias("needs")
    told = below.groupBy(below[key].alias("of"), F.col("top_line").alias("at")).agg(last("stage"), last("when"), last("allow_failure"), needs)
    found = jobs.join(told, (F.col(key).eqNullSafe(F.col("of"))) & (F.col("top_line") == F.col("at")), "left")
    placed = found.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("first"))).filter(F.col("n") <= limit)
    return placed.select(key, "n", "job", "stage", "when", "allow_failure", F.coalesce("needs", F.expr("cast(array() as array<string>)")).alias("needs"))


def job_line() -> Column:
    """A job as readers are told of it."""
    part = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}="), value))
    told = F.array(*[part(c, F.col(c)) for c in ("job", "stage", "when", "allow_failure")], part("needs", F.array_join("needs", ",")))
    return F.concat(F.lit("- "), F.array_join(F.array_compact(told), " | "))


def structured_kind(path: Column) -> Column:
    """yaml, json, keys or shell by a path's ending, in any case; null for other files."""
    plain = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KIND_PATHS):
        kind = F.when(plain.rlike(pattern), name).otherwise(kind)
    return kind


def structured_keys(files: DataFrame, touched: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind, n, name: what touched lines name, read by the kind of their file.

    Files of other kinds, and those without content, give none. files: key, path, content;
    touched: key, line, hunk_ix, line_ix, text.
    """
    known = files.withColumn("kind", structured_kind(F.col("path"))).filter("kind is not null and content <> ''")
    met = touched.join(known.select(key, "kind"), key)
    own = lambda rows, kind: rows.filter(F.col("kind") == kind)
    text = own(known, "keys").select(key, F.posexplode(F.split("content", "\r?\n")).alias("at", "text"))
    found = {
        "yaml": yaml_paths(own(known, "yaml"), own(met, "yaml"), key),
        "json": json_keys(own(met, "json"), key),
        "keys": section_keys(text.select(key, (F.col("at") + 1).alias("line"), "text"), own(met, "keys"), key),
        "shell": shell_commands(own(met, "shell"), key),
    }
    named = [rows.select(key, F.lit(kind).alias("kind"), "n", "name") for kind, rows in found.items()]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


def structured_slices(files: DataFrame, touched: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, label, content, file: what is told of each structured file that a change touches.

    Of YAML the touched paths and, of pipelines, the jobs; of JSON the touched and the outermost keys; of settings the
    touched keys by section; of scripts the commands. files: key, path, content; touched: key, line, hunk_ix, line_ix, text.
    """
    known = files.withColumn("kind", structured_kind(F.col("path"))).filter("kind is not null and content <> ''")
    listed = lambda rows, column: rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(column).alias("t")))), lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("content"))
    keys = structured_keys(files, touched, key)
    label = F.when(F.col("kind") == "yaml", PATHS_LABEL).when(F.col("kind") == "json", KEYS_LABEL).when(F.col("kind") == "keys", SECTIONS_LABEL).otherwise(COMMANDS_LABEL)
    own = listed(keys, "name").join(known.select(key, "kind"), key).select(key, F.lit(0).alias("ord"), label.alias("label"), "content")
    yaml = known.filter("kind = 'yaml'")
    lines = yaml_lines(yaml, touched, key)
    plain = F.lower(F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
    scripted = lines.filter(F.col("path").startswith("jobs.") | F.contains("path", F.lit(".script"))).select(key).distinct()
    pipelines = yaml.filter(plain.rlike(PIPELINE_PATHS)).select(key).union(scripted).distinct()
    jobs = yaml_jobs(lines.join(pipelines, key, "left_semi"), key).withColumn("told", job_line())
    summed = jobs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "told"))), lambda x: x["told"]), "\n").alias("content"))
    bare = F.regexp_replace(F.regexp_replace("content", r"(?m)^\s*//.*$", ""), r"(?s)/\*.*?\*/", "")
    tops = known.filter("kind = 'json'").select(key, F.slice(F.json_object_keys(bare), 1, MAX_KEYS).alias("names")).filter("names is not null")
    tops = tops.select(key, F.array_join(F.transform("names", lambda x: F.concat(F.lit("- "), x)), "\n").alias("content"))
    more = summed.select(key, F.lit(1).alias("ord"), F.lit(JOBS_LABEL).alias("label"), "content").unionByName(tops.select(key, F.lit(1).alias("ord"), F.lit(TOP_LABEL).alias("label"), "content"))
    return own.unionByName(more).join(files.select(key, F.col("path").alias("file")), key)
