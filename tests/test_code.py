"""Exports, imports and calls of small sources."""

from pyspark.sql import functions as F

from reviewloom.operators import code, contracts

SOURCE = """// export function no(a) {}
/* export const neither = 1 */
export async function updateUser(id: string, opts: { a: number, b: string } = {}, ...rest: string[]): void {
}
export default function (x, y?: number) {}
export const run = async (a, [b, c]) => a;
export const twice = x => x * 2;
export const limit: number = 3;
export abstract class Box<T> {}
export interface Shape { a: (b: number) => void }
export type Id = string;
const hidden = (a) => a;
export { hidden as shown };
"""


def test_exports(spark):
    files = spark.createDataFrame([("m.ts", SOURCE)], "path string, content string")
    found = {r["name"]: tuple(r)[2:] for r in code.export_contracts(files).collect()}
    assert found["updateUser"] == ("function", 3, 1, 3, True)
    assert found["default"] == ("function", 5, 1, 2, False)
    assert found["run"] == ("function", 6, 2, 2, False)
    assert found["twice"] == ("function", 7, 1, 1, False)
    assert found["limit"][:2] == ("value", 8) and found["limit"][2] is None
    assert found["Box"][0] == "class" and found["Shape"][0] == "type" and found["Id"][0] == "type"
    assert not {"no", "neither", "hidden"} & set(found)


def test_imports_and_reexports(spark):
    text = "import def, { a as b, type C } from './x'\nimport * as api from '../api'\nexport { u as v } from './user'\nexport * from './all'\nexport * as ns from './ns'\n"
    files = spark.createDataFrame([("src/lib/m.ts", text)], "path string, content string")
    found = {(r["symbol"], r["local"], r["module"], r["line"]) for r in code.import_bindings(files).collect()}
    assert found == {("default", "def", "./x", 1), ("a", "b", "./x", 1), ("C", "C", "./x", 1), (None, "api", "../api", 2)}
    again = {(r["symbol"], r["local"], r["module"], r["kind"]) for r in code.reexports(files).collect()}
    assert again == {("u", "v", "./user", "named"), ("*", "*", "./all", "star"), (None, "ns", "./ns", "namespace")}
    paths = files.select(*[code.resolved_modules(F.col("path"), F.lit(s)) for s in ("./x", "../api", "../../y/z", "react")]).first()
    assert tuple(paths) == ("src/lib/x", "src/api", "y/z", None)


def test_calls(spark):
    text = "updateUser('a, b', f(1, 2));\nnew api.Box({ a: 1, b: 2 });\nregistry['run']()\nif (x) {}\n"
    files = spark.createDataFrame([("m.ts", text)], "path string, content string")
    found = {(r["line"], r["callee"], r["is_new"], r["argc"]) for r in code.call_sites(files).collect()}
    assert {(1, "updateUser", False, 2), (2, "api.Box", True, 1), (3, "registry.run", False, 0)} <= found
    assert not any(r[1] == "if" for r in found)


def test_arity_drift_through_names_and_namespaces(spark):
    """A function takes a third parameter; both consumers call it with two."""
    fields = "path string, content string"
    base = spark.createDataFrame([("src/user-api", "export function updateUser(id, name) {}")], fields)
    head = spark.createDataFrame([("src/user-api", "export function updateUser(id, name, audit) {}")], fields)
    consumers = spark.createDataFrame(
        [("src/a.ts", "import { updateUser } from './user-api'\nupdateUser(1, 2)\n"), ("src/b.ts", "import * as api from './user-api'\napi.updateUser(1, 2)\napi.updateUser(1, 2, 3)\n")], fields
    )
    named = lambda f: code.export_contracts(f).withColumnRenamed("path", "module")
    changes = contracts.contract_changes(named(base), named(head))
    imports = code.import_bindings(consumers).withColumn("module", code.resolved_modules(F.col("path"), F.col("module")))
    used = code.usages(imports, code.call_sites(consumers)).withColumnRenamed("path", "importer").withColumnRenamed("line", "at_line")
    drift = contracts.arity_mismatches(contracts.affected_imports(changes, used))
    assert sorted((r["importer"], r["at_line"]) for r in drift.collect()) == [("src/a.ts", 2), ("src/b.ts", 2)]
