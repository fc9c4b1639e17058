"""Readers of sources: golden modules, sources that are hard to read, and rules of scopes, chains and slices."""

import pytest
from pyspark.sql import functions as F

from reviewloom.functions.scanner import Source, marks, tokens
from reviewloom.operators import code, scopes
from reviewloom.plans.sources import MARKS
from reviewloom.sources.shapes import MODULES, TOUCHED


def of(text, *kinds):
    """(kind, name, first line, last line) of the marks of some kinds, in order."""
    return [(m[1], m[2], m[5], m[6]) for m in sorted(marks(text), key=lambda m: (m[7], -m[8])) if m[0] in kinds]


@pytest.mark.parametrize("shape", range(len(MODULES)))
def test_golden_modules(shape):
    shown = lambda x, i: "-" if x is None else {True: "rest", False: "no"}.get(x, x) if i == 12 else str(x)
    # signatures are tested with contracts
    rows = [m if m[0] != "export" or m[1] == "alias" else (*m[:3], None, *m[4:]) for m in marks(MODULES[shape]) if m[0] not in ("declaration", "assign")]
    found = sorted(" ".join(str(shown(x, i)) for i, x in enumerate(m)) for m in rows)
    assert found == sorted(MARKS[shape].strip().split("\n"))


def test_scopes_end_where_they_end():
    text = "function one() {\n  const re = /[{]/\n}\nconst a = 1\nfunction two() { return `${`}`} {` }\nconst s = '{'\nclass Three { x = /}/; m() { if (a / b) { } } }\n"
    assert of(text, "scope") == [("function", "one", 1, 3), ("function", "two", 5, 5), ("class", "Three", 7, 7), ("method", "m", 7, 7)]


def test_heads_over_lines_and_members():
    text = """export default async function load<T extends { a: string }>(
  id: string,
  cb: (error: Error | null) => void = () => {},
): Promise<{ rows: T[] }> {
  return cb(id)
}
abstract class Db {
  private db: Pool
  static #count = 0
  constructor(private pool: Pool) { super() }
  abstract find(id: string): Row
  get size() { return 1 }
  'quoted name'() {}
  @Log({ level: 1 }) async *each<T>(): AsyncIterator<T> { yield 1 }
}
const plain = 1, made = (a) => a
const late = async <T,>(x: T): Promise<T> => { return x }
declare module Outer { export function inside(): void }
"""
    assert of(text, "scope") == [
        ("function", "load", 1, 6), ("class", "Db", 7, 15), ("method", "find", 11, 11), ("method", "'quoted name'", 13, 13), ("method", "each", 14, 14),
        ("variable", "late", 17, 17), ("function", "inside", 18, 18),
    ]
    assert [m[10:] for m in marks(text) if m[0] == "export" and m[2] == "default"] == [(1, 2, False)]


def test_calls_are_identifiers_under_a_call():
    text = "this.db.query(id, opts.x, ...rest)\nfetch<Row>(url)\nnew Box(a)\nnew Plain\nhook?.(b)\nif (c) {}\nreturn (d)\nf(x as T, (y), { z })\nObject.keys(k)['map'](w)\n"
    assert [n for _, n, _, _ in of(text, "call")] == ["id", "fetch", "url", "Box", "a", "Plain", "hook", "b", "f", "k", "w"]
    assert [n for _, n, _, _ in of(text, "site")] == ["this.db.query", "fetch", "Box", "hook", "f", "Object.keys"]


def test_branches_and_their_ends():
    text = "if (a) b()\nelse if (c) {\n  d()\n} else e(\n  1\n)\nif (f)\n  throw new G()\nfor (;;) if (h) { break }\n"
    assert [(a, b) for _, _, a, b in of(text, "guard")] == [(1, 6), (2, 6), (7, 8), (9, 9)]


def test_paths_that_are_given_names():
    text = "const a = api['b'], c = a\nconst o = { run: a, api, 'q': x.y, f() {}, g: h(), ...s }\nlet z\nz = lib.api.go\nif (z = q) {}\nconst {k = b} = c\nfunction f(x = y, {k = l}) { w = v; const inner = a; return u = t }\nclass A { p = q }\ntype T = U\nz.w = a\n"
    found = [(m[1], m[2], m[3], m[4], m[5]) for m in marks(text) if m[0] == "assign"]
    assert found == [
        ("variable", "a", None, "api.b", 1), ("variable", "c", None, "a", 1), ("member", "o", "run", "a", 2), ("member", "o", "api", "api", 2), ("member", "o", "q", "x.y", 2),
        ("assignment", "z", None, "lib.api.go", 4), ("assignment", "z", None, "q", 5), ("assignment", "w", None, "v", 7), ("assignment", "u", None, "t", 7),
    ]


def test_signatures(spark):
    text = """export function f(a: string, b = g(1, 2), ...c: Map<K, V>[]): void {}
export const arrow = async <T,>(x: T, { y }: P = {}) => x, one = z => z, value = { a: 1 }
export default class {}
export class Named {}
export interface Shape {
  a: string
}
function hidden(q?) {}
export { hidden as shown, imported, f as again }
export function over(a): void
export function over(a, b) {}
"""
    files = spark.createDataFrame([("m", text)], "path string, content string")
    found = {r["name"]: (r["kind"], r["line"], r["required"], r["total"], r["rest"], r["signature"]) for r in code.contracts_of(code.source_marks(files)).collect()}
    assert found == {
        "f": ("function", 1, 1, 3, True, "f(a: string, b = g(1, 2), ...c: Map<K, V>[])"), "again": ("function", 1, 1, 3, True, "again(a: string, b = g(1, 2), ...c: Map<K, V>[])"),
        "arrow": ("function", 2, 1, 2, False, "arrow(x: T, { y }: P = {})"), "one": ("function", 2, 1, 1, False, "one(z)"), "value": ("value", 2, None, None, False, "value = { a: 1 }"),
        "default": ("class", 3, None, None, False, "default class"), "Named": ("class", 4, None, None, False, "class Named"), "Shape": ("type", 5, None, None, False, "export interface Shape {"),
        "shown": ("function", 8, 0, 1, False, "shown(q?)"), "over": ("function", 11, 2, 2, False, "over(a, b)"),
    }


def test_large_and_broken_sources():
    assert [m[2] for m in marks("const s = '" + "x" * 1_000_000 + "'\nexport function f(a) {}") if m[0] == "export"] == ["f"]
    assert [m[11] for m in marks("foo(" + "a," * 10_000 + "b)") if m[0] == "site"] == [10_001]
    many = "\n".join(f"function f{i}(a, b) {{\n  if (a) return b\n  return g{i}(a)\n}}" for i in range(20_000))
    assert sum(m[0] == "scope" for m in marks(many)) == 20_000
    for text in ("(" * 50_000, "a<" * 50_000, "if (a) x; else " * 20_000, "{" * 30_000 + "}" * 30_000, "type T = " + "{ a: " * 3_000, "const f = () => {" * 3_000, "`${" * 5_000, "'", "/", "@", "export", "class", "function (", "const {", "import {"):
        list(marks(text))
    assert list(marks(None)) == list(marks("")) == list(marks(" // x\n/* y")) == []


def test_tokens_are_the_source():
    for text in [*MODULES, "a /* b\n */ + `c ${d /* e */} f` // g", "x = y / z; /re[/]/.test(w)"]:
        found = list(tokens(text))
        assert all(text[start:end] == t for _, _, t, _, _, start, end in found)
        assert "".join("".join(t.split()) for _, _, t, *_ in found) == "".join(text.split())
        assert all(Source(text).line(start) == line == text[:start].count("\n") + 1 for _, _, _, line, _, start, _ in found)


def test_marks_as_rows(spark):
    """Files without content have none; other columns and keys of any kind are no matter."""
    files = spark.createDataFrame([(1, MODULES[0], "x"), (2, None, "x"), (3, "", "x"), (None, "f(a)", "x")], "key long, content string, mark string")
    rows = code.source_marks(files, "key")
    assert {r["key"] for r in rows.collect()} == {1, None}
    assert rows.filter("key is null").count() == 3
    assert code.source_marks(files.limit(0), "key").count() == 0


def test_touched_lines_meet_many_scopes(spark):
    """A file of 20,000 declarations and as many touched lines: no pair of them is made."""
    text = "\n".join(f"function f{i}(a) {{\n  return a\n}}" for i in range(20_000))
    files = spark.createDataFrame([("m", text)], "path string, content string")
    table = scopes.scopes_of(code.source_marks(files))
    touched = spark.range(1, 60_001, 3).select(F.lit("m").alias("path"), F.col("id").alias("line"))
    assert scopes.touching(table, touched).count() == 20_000
    assert [r["name"] for r in scopes.changed_scopes(table, touched).orderBy("n").collect()] == ["f0", "f1", "f2", "f3"]
    assert scopes.touching(table, touched.filter("line = 2")).count() == 0
    assert scopes.touching(table, spark.createDataFrame([("m", 5), ("m", 5), ("other", 1)], "path string, line long")).select("name").first()[0] == "f1"


SLICED = """import { Db } from './db'
export function load(id: Key, user) {
  if (!id) { log(id) }
  if (!user) {
    return null
  }
  if (user.gone) throw new Gone(user)
  return shape(query(id))
}
type Key = string
function shape(row) { return wrap(row, new Frame()) }
function one(x) { if (x) { x() } else { return 1 } if (!x) { throw x } }
const Frame = class {}
function query(id) { return Db.get(id) }
"""


def sliced(spark, *lines):
    files = spark.createDataFrame([("m", SLICED)], "path string, content string")
    found = code.source_marks(files)
    table = scopes.scopes_of(found)
    chosen = scopes.changed_scopes(table, spark.createDataFrame([("m", n) for n in lines], "path string, line long"))
    return [(r["label"], r["content"]) for r in scopes.semantic_slices(chosen, found, table, files).orderBy("place").collect()]


def test_slices(spark):
    """A summary of calls and one of data stand, so one branch is read, and it doesn't leave; then what the scope leans
    on. Only the first three callees have a second hop, and shape is the fifth."""
    assert sliced(spark, 4) == [
        (scopes.CHAIN_LABEL, "入口: load\n直接调用: log, id, Gone, user, shape"),
        (scopes.FLOW_LABEL, "输入参数: id, Key, user\n保护条件: if (user.gone) throw new Gone(user)\n敏感调用: query\n可能参与下游调用的输入: id, Key, user"),
        (scopes.TYPE_LABEL, "type Key = string"),
        (scopes.FUNCTION_LABEL, "function shape(row) { return wrap(row, new Frame()) }"),
        (scopes.FUNCTION_LABEL, "function query(id) { return Db.get(id) }"),
    ]


def test_slices_read_branches_until_two_stand(spark):
    """x() is a call of one letter and no chain; the data summary and the first branch that leaves are two."""
    assert sliced(spark, 12) == [
        (scopes.FLOW_LABEL, "保护条件: if (x) { x() } else { return 1 } | if (!x) { throw x }"),
        (scopes.GUARD_LABEL, "if (x) { x() } else { return 1 }"),
    ]


def test_scores_add_up(spark):
    files = spark.createDataFrame([("m", SLICED)], "path string, content string")
    found = code.source_marks(files)
    table = scopes.scopes_of(found)
    touched = spark.createDataFrame([("m", 14, "function query(id) { return Db.get(id) }")], "path string, line long, text string")
    diffs = spark.createDataFrame([("m", "+function query(id) { return Db.get(id) }")], "path string, content string")
    rows = scopes.scored_candidates(scopes.changed_scopes(table, touched), found, files, touched, diffs).orderBy("rank").collect()
    # Db: imported 12, a capital 2; query and get stand before brackets, 6 each; id is an argument, 7
    assert [(r["name"], r["score"], r["import_source"]) for r in rows] == [("Db", 14, "./db"), ("id", 7, None), ("get", 6, None), ("query", 6, None)]


def test_every_way_to_touch_finds_scopes():
    assert all(any(m[0] == "scope" and m[5] <= line <= m[6] for m in marks(MODULES[i]) for line in way) for i, ways in enumerate(TOUCHED) for way in ways)
