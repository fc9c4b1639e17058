"""Modules of ten shapes, in which N stands for a module's number, and lines of each that a change touches.

They hold what tells readers of sources apart: heads over several lines, members, templates, regular
expressions with brackets, branches, and names that only look like code.
"""

from __future__ import annotations

MODULES = (
    """import { helper } from './h'
export function loadN(id, user) {
  if (!user) return null
  const row = query(id)
  return shapeN(row)
}

function shapeN(row) {
  send(row); clean(row)
}
export class BoxN {
  open(key) {
    return loadN(key, this)
  }
}
interface RowN { id: string }
type IdN = string;
export const runN = async (x) => {
  await post(x)
}""",
    """import { helper } from './h'
export function loadN(id, user) {
  if (!user) return null
  const row = query(id)
  return shapeN(row)
}

function shapeN(row) {
  send(row); clean(row)
}
interface RowN { id: string }
type IdN = string;
export const runN = async (x) => {
  await post(x)
}""",
    """import { load } from './load'
export function oneN(x) { return load(x) }
function partsN(text: string) {
  const open = /[{]/
  const close = text.split(/\\/}/g)
  return close.filter(part => open.test(part))
}
export function lastN(text) {
  const half = text.length / 2
  return partsN(text) / half
}""",
    """import { Db, Row } from './db'
export class StoreN extends BaseN<Row> implements Closing {
  private rows: Map<string, Row> = new Map()
  onOpen = (event) => { this.emit(event) }
  constructor(private readonly db: Db, size?: number) {
    super(db)
  }
  async get(
    id: string,
    opts: OptionsN = {}
  ): Promise<Row> {
    if (!id) throw new Missing(id)
    const row = await this.db.query(id, opts)
    return checkN(row)
  }
  get size(): number { return this.rows.size }
}
function checkN(row: Row) { if (!row) { return emptyN() } return row }""",
    """// export function hidden(a) {}
/* class Gone { */
const greet = "it's { not";
export const textN = (user: User) => {
  const line = `${user.name} } ${format({ at: `${clock()}` })}`
  if (line === "}") {
    return '`'
  }
  return trimN(line) // }
}
export default function (a, b?: number) {}
function trimN(s) { return s.trim() }""",
    """import type { Base, Part as Piece } from '../base'
export interface PageN<T = Piece> extends Base {
  items: T[]
  next(cursor: Cursor): Promise<PageN<T>>
}
export type KeyN = { of: Piece; at: number } | Base['id'];
export enum ColorN { Red = 1, Blue }
export const enum SizeN { Small }
export function mapN<T extends Base, R>(page: PageN<T>, by: (item: T) => R, ...rest: R[]): R[] {
  const first = page.items[0] as Piece
  return page.items.map(item => by(item))
}""",
    """export const apiN = {
  open(key) { return fetchN(key) },
  plain: fetchN,
  async close<T>(t: T): Promise<T> { await deleteN(t); return t },
  get size() { return 1 },
}
export function outerN(list) {
  function innerN(item) {
    return updateN(item)
  }
  list.forEach((item, at) => { setState(at, innerN(item)) })
  return innerN
}
const fetchN = function (key) { return patch(key) }""",
    """export function decideN(a, b) {
  if (a > b) {
    log(a)
  } else if (a === b) {
    throw new Same(a)
  } else return last(b)
  for (const x of a) if (x) { return x }
  try { insertN(a) } catch (e) { if (e) throw e }
  switch (b) { case 1: { return one(b) } default: return b }
}
function insertN(row) {
  while (row) { row = execute(row) }
}
function last(b) { return b }""",
    """import first, { second as third } from './two'
import * as all from "../all"
export { third as passed, first }
export { aN as renamed } from './a'
export * from './rest'
export * as kit from './kit'
export default class extends all.Base {
  run() { return all.make(first, third()) }
}
export async function* eachN({ a, b = first }, [c] = []) {
  yield* all['list'](a, b)
  new all.Box(c, { d: 1, e: [2, 3] })
}""",
    """import React, { useState as useIt } from 'react'
export const ViewN: React.FC<PropsN> = ({ user, onSave }) => {
  const [open, setOpen] = useIt(false)
  if (!user) return null
  const save = async () => {
    if (!open) { return }
    await onSave?.(user)
    setOpen(false)
  }
  return <div onClick={save}>{render(user)}</div>
}
function render(user: UserN) {
  return redirect(user)
}""",
)
#: Lines that a change touches in a module of each shape, in two ways.
TOUCHED = (
    ((3, 13), (9, 16, 19)),
    ((4, 9), (14,)),
    ((2, 5), (9,)),
    ((4, 12), (17, 18)),
    ((5, 6), (11, 12)),
    ((4, 7), (10,)),
    ((2, 9), (11, 14)),
    ((3, 12), (7,)),
    ((8,), (11, 12)),
    ((6, 13), (3,)),
)

# Repositories in which a change of a module meets its users, in six ways: files of the new version, old versions of
# changed files, and which files the change is about (all but barrels and configurations). N stands for a repository's number.
_NEW, _OLD = (f"export async function updateUserN(id: string, name: string{more}) {{\n  return {{ id, name }}\n}}\n" for more in (", active: boolean", ""))
_MODULE = "src/lib/user-api.ts"


def _user(head: str, call: str) -> str:
    return f"{head}\n\nexport async function runN(id: string, name: string) {{\n  return {call}(id, name)\n}}\n"


CHANGES = (
    # through an alias and through a namespace
    ({_MODULE: _NEW, "src/a.ts": _user("import { updateUserN } from '@/lib/user-api'", "updateUserN"), "src/b.ts": _user("import * as userApi from '@/lib/user-api'", "userApi.updateUserN")}, {_MODULE: _OLD}),
    # through a barrel that names what it passes on
    (
        {_MODULE: _NEW, "src/lib/index.ts": "export { updateUserN } from './user-api'\n", "src/a.ts": _user("import { updateUserN } from '@/lib'", "updateUserN"), "src/b.ts": _user("import * as api from '@/lib'", "api.updateUserN")},
        {_MODULE: _OLD},
    ),
    # through a barrel that passes all on
    ({_MODULE: _NEW, "src/lib/index.ts": "export * from './user-api'\n", "src/a.ts": _user("import { updateUserN } from '@/lib'", "updateUserN")}, {_MODULE: _OLD}),
    # through a barrel that passes a namespace on
    (
        {_MODULE: _NEW, "src/lib/index.ts": "export * as api from './user-api'\n", "src/a.ts": _user("import { api } from '@/lib'", "api.updateUserN"), "src/b.ts": _user("import * as lib from '@/lib'", "lib.api.updateUserN")},
        {_MODULE: _OLD},
    ),
    # a function that is a value now, and a class that is a function; an export that is gone
    (
        {
            _MODULE: "export const buildN = { enabled: true }\nexport function MadeN() {}\n",
            "src/a.ts": "import { buildN, MadeN as Own, goneN } from './lib/user-api'\nconst x = new Own()\nexport function run() {\n  return buildN('123')\n}\n",
        },
        {_MODULE: "export function buildN(id: string) {\n  return id\n}\nexport class MadeN {}\nexport const goneN = 1\n"},
    ),
    # through names and members that assignments pass on, one of them three steps long
    (
        {
            _MODULE: _NEW,
            "src/a.ts": "import * as api from '@/lib/user-api'\n\nconst runner = api['updateUserN']\nconst second = runner, third = second\nconst registry = {\n  run: third,\n}\n\nexport async function execute(id: string, name: string) {\n  return registry['run'](id, name)\n}\n",
        },
        {_MODULE: _OLD},
    ),
)
ALIAS_CONFIG = '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}'

#: Names that the files of a library define, one each, and mention, two each.
LIBRARY = ("query", "send", "Row", "useIt", "Base", "Piece", "first", "render", "log", "Same", "execute", "Db", "helper")
# Structured files: path, content, and the lines that a change touches; the first three are YAML.
STRUCTURED = (
    (".gitlab-ci.yml", "stages: [a]\nbuildN:\n  stage: build\n  script:\n    - x: 1\n  needs: a\n  stage: test\n  # when: never\n  needs: b\n  allow_failure: true\nlaterN:\n  when: manual\n", (3, 7, 11)),
    ("conf/a.yaml", "oneN:\n  stage: first\ntwo: 2\noneN:\n  stage: last\n  stage:\n", (5, 4)),
    ("x/b.yml", "on: push\njobs:\n  runN:\n    needs: x\n    when: always\n", (4, 1)),
    (".github/workflows/c.yml", "# only a remark\n- item\n", (1, 2)),
    ("p.json", "{\n  // what\n  \"aN\": 1, \"c\":\n  {\"b\": 2}\n}", (3, 4)),
    ("q.ini", "; x\n[s]\nkN = 1\nm = 2\n", (3,)),
    ("Dockerfile", "FROM x\nA=1 runN it\nif y\nnpm i\n", (2, 3, 4)),
    ("r.ts", "a: 1\n", (1,)),
)
