"""Plans of source files, over modules of ten shapes, with their SQL beside them.

``MARKS`` says, module by module and checked by reading, what a reader of TypeScript finds in each; the SQL starts from it, not from the
scanner, and states the rules of scopes, chains, flows, slices and scores on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.lineage import cut
from reviewloom.operators import classify, code, configs, contexts, contracts, modules, scopes
from reviewloom.plans import values
from reviewloom.plans.oracles import _q, _with
from reviewloom.sources import bridge, shapes

#: mark kind name local module line end_line start end depth required total rest of each mark, - for null.
MARKS = (
    """
import named helper helper ./h 1 1 0 28 0 - - -
export function loadN - - 2 6 29 134 0 2 2 no
export class BoxN - - 11 15 185 252 0 - - no
export function runN - - 18 20 302 354 0 1 1 no
scope function loadN - - 2 6 29 134 0 - - -
scope function shapeN - - 8 10 136 184 0 - - -
scope class BoxN - - 11 15 185 252 0 - - -
scope method open - - 12 14 207 250 1 - - -
scope interface RowN - - 16 16 253 282 0 - - -
scope type IdN - - 17 17 283 301 0 - - -
scope variable runN - - 18 20 302 354 0 - - -
guard if - - - 3 3 65 87 1 - - -
call call query - - 4 4 102 107 1 - - -
call argument id - - 4 4 108 110 2 - - -
call call shapeN - - 5 5 121 127 1 - - -
call argument row - - 5 5 128 131 2 - - -
call call send - - 9 9 161 165 1 - - -
call argument row - - 9 9 166 169 2 - - -
call call clean - - 9 9 172 177 1 - - -
call argument row - - 9 9 178 181 2 - - -
call call loadN - - 13 13 230 235 2 - - -
call argument key - - 13 13 236 239 3 - - -
call call post - - 19 19 345 349 1 - - -
call argument x - - 19 19 350 351 2 - - -
parameter name id - - 2 2 51 53 1 - - -
parameter name user - - 2 2 55 59 1 - - -
parameter name row - - 8 8 152 155 1 - - -
parameter name key - - 12 12 212 215 2 - - -
parameter name x - - 18 18 329 330 1 - - -
site call query - - 4 4 102 111 1 - 1 -
site call shapeN - - 5 5 121 132 1 - 1 -
site call send - - 9 9 161 170 1 - 1 -
site call clean - - 9 9 172 182 1 - 1 -
site call loadN - - 13 13 230 246 2 - 2 -
site call post - - 19 19 345 352 1 - 1 -
""",
    """
import named helper helper ./h 1 1 0 28 0 - - -
export function loadN - - 2 6 29 134 0 2 2 no
export function runN - - 13 15 234 286 0 1 1 no
scope function loadN - - 2 6 29 134 0 - - -
scope function shapeN - - 8 10 136 184 0 - - -
scope interface RowN - - 11 11 185 214 0 - - -
scope type IdN - - 12 12 215 233 0 - - -
scope variable runN - - 13 15 234 286 0 - - -
guard if - - - 3 3 65 87 1 - - -
call call query - - 4 4 102 107 1 - - -
call argument id - - 4 4 108 110 2 - - -
call call shapeN - - 5 5 121 127 1 - - -
call argument row - - 5 5 128 131 2 - - -
call call send - - 9 9 161 165 1 - - -
call argument row - - 9 9 166 169 2 - - -
call call clean - - 9 9 172 177 1 - - -
call argument row - - 9 9 178 181 2 - - -
call call post - - 14 14 277 281 1 - - -
call argument x - - 14 14 282 283 2 - - -
parameter name id - - 2 2 51 53 1 - - -
parameter name user - - 2 2 55 59 1 - - -
parameter name row - - 8 8 152 155 1 - - -
parameter name x - - 13 13 261 262 1 - - -
site call query - - 4 4 102 111 1 - 1 -
site call shapeN - - 5 5 121 132 1 - 1 -
site call send - - 9 9 161 170 1 - 1 -
site call clean - - 9 9 172 182 1 - 1 -
site call post - - 14 14 277 284 1 - 1 -
""",
    """
import named load load ./load 1 1 0 29 0 - - -
export function oneN - - 2 2 30 72 0 1 1 no
export function lastN - - 8 11 210 301 0 1 1 no
scope function oneN - - 2 2 30 72 0 - - -
scope function partsN - - 3 7 73 209 0 - - -
scope function lastN - - 8 11 210 301 0 - - -
call call load - - 2 2 63 67 1 - - -
call argument x - - 2 2 68 69 2 - - -
call argument part - - 6 6 201 205 3 - - -
call call partsN - - 10 10 280 286 1 - - -
call argument text - - 10 10 287 291 2 - - -
parameter name x - - 2 2 51 52 1 - - -
parameter name text - - 3 3 89 93 1 - - -
parameter name part - - 6 6 183 187 2 - - -
parameter name text - - 8 8 232 236 1 - - -
site call load - - 2 2 63 70 1 - 1 -
site call text.split - - 5 5 142 160 1 - 1 -
site call close.filter - - 6 6 170 207 1 - 1 -
site call open.test - - 6 6 191 206 2 - 1 -
site call partsN - - 10 10 280 292 1 - 1 -
""",
    """
import named Db Db ./db 1 1 0 30 0 - - -
import named Row Row ./db 1 1 0 30 0 - - -
export class StoreN - - 2 17 31 482 0 - - no
scope class StoreN - - 2 17 31 482 0 - - -
scope method get - - 8 15 255 433 1 - - -
scope function checkN - - 18 18 483 553 0 - - -
guard if - - - 12 12 330 360 2 - - -
guard if - - - 18 18 511 540 1 - - -
call new Map - - 3 3 130 133 1 - - -
call argument event - - 4 4 170 175 3 - - -
call argument db - - 6 6 245 247 3 - - -
call new Missing - - 12 12 349 356 2 - - -
call argument id - - 12 12 357 359 3 - - -
call argument id - - 13 13 397 399 3 - - -
call argument opts - - 13 13 401 405 3 - - -
call call checkN - - 14 14 418 424 2 - - -
call argument row - - 14 14 425 428 3 - - -
call call emptyN - - 18 18 530 536 2 - - -
type heritage BaseN - - 2 2 59 64 0 - - -
type reference Row - - 2 2 65 68 0 - - -
type heritage Closing - - 2 2 81 88 0 - - -
type reference Map - - 3 3 107 110 1 - - -
type reference Row - - 3 3 119 122 1 - - -
type reference Db - - 5 5 214 216 2 - - -
type reference OptionsN - - 10 10 292 300 2 - - -
type reference Promise - - 11 11 311 318 1 - - -
type reference Row - - 11 11 319 322 1 - - -
type reference Row - - 18 18 504 507 1 - - -
parameter name event - - 4 4 148 153 2 - - -
parameter name db - - 5 5 210 212 2 - - -
parameter name Db - - 5 5 214 216 2 - - -
parameter name size - - 5 5 218 222 2 - - -
parameter name id - - 9 9 270 272 2 - - -
parameter name opts - - 10 10 286 290 2 - - -
parameter name OptionsN - - 10 10 292 300 2 - - -
parameter name row - - 18 18 499 502 1 - - -
parameter name Row - - 18 18 504 507 1 - - -
site new Map - - 3 3 130 135 1 - 0 -
site call this.emit - - 4 4 160 176 2 - 1 -
site new Missing - - 12 12 349 360 2 - 1 -
site call this.db.query - - 13 13 383 406 2 - 2 -
site call checkN - - 14 14 418 429 2 - 1 -
site call emptyN - - 18 18 530 538 2 - 0 -
""",
    """
export function textN - - 4 10 79 250 0 1 1 no
export function default - - 11 11 251 293 0 1 2 no
scope variable textN - - 4 10 79 250 0 - - -
scope function - - - 11 11 251 293 0 - - -
scope function trimN - - 12 12 294 331 0 - - -
guard if - - - 6 8 184 222 1 - - -
call call format - - 5 5 151 157 2 - - -
call call clock - - 5 5 167 172 5 - - -
call call trimN - - 9 9 232 237 1 - - -
call argument line - - 9 9 238 242 2 - - -
type reference User - - 4 4 107 111 1 - - -
parameter name user - - 4 4 101 105 1 - - -
parameter name User - - 4 4 107 111 1 - - -
parameter name a - - 11 11 276 277 1 - - -
parameter name b - - 11 11 279 280 1 - - -
parameter name s - - 12 12 309 310 1 - - -
site call format - - 5 5 151 179 2 - 1 -
site call clock - - 5 5 167 174 5 - 0 -
site call trimN - - 9 9 232 243 1 - 1 -
site call s.trim - - 12 12 321 329 1 - 0 -
""",
    """
import named Base Base ../base 1 1 0 50 0 - - -
import named Part Piece ../base 1 1 0 50 0 - - -
export type PageN - - 2 5 51 156 0 - - no
export type KeyN - - 6 6 157 215 0 - - no
export type ColorN - - 7 7 216 252 0 - - no
export type SizeN - - 8 8 253 286 0 - - no
export function mapN - - 9 12 287 466 0 2 3 rest
scope interface PageN - - 2 5 51 156 0 - - -
scope type KeyN - - 6 6 157 215 0 - - -
scope enum ColorN - - 7 7 216 252 0 - - -
scope enum SizeN - - 8 8 253 286 0 - - -
scope function mapN - - 9 12 287 466 0 - - -
call call by - - 11 11 455 457 2 - - -
call argument item - - 11 11 458 462 3 - - -
type reference Piece - - 2 2 78 83 0 - - -
type heritage Base - - 2 2 93 97 0 - - -
type reference T - - 3 3 109 110 1 - - -
type reference Cursor - - 4 4 128 134 2 - - -
type reference Promise - - 4 4 137 144 1 - - -
type reference PageN - - 4 4 145 150 1 - - -
type reference T - - 4 4 151 152 1 - - -
type reference Piece - - 6 6 182 187 1 - - -
type reference Base - - 6 6 204 208 0 - - -
type reference Base - - 9 9 318 322 0 - - -
type reference PageN - - 9 9 333 338 1 - - -
type reference T - - 9 9 339 340 1 - - -
type reference T - - 9 9 354 355 2 - - -
type reference R - - 9 9 360 361 1 - - -
type reference R - - 9 9 372 373 1 - - -
type reference R - - 9 9 378 379 0 - - -
type reference Piece - - 10 10 417 422 1 - - -
parameter name cursor - - 4 4 120 126 2 - - -
parameter name Cursor - - 4 4 128 134 2 - - -
parameter name page - - 9 9 327 331 1 - - -
parameter name PageN - - 9 9 333 338 1 - - -
parameter name T - - 9 9 339 340 1 - - -
parameter name by - - 9 9 343 345 1 - - -
parameter name item - - 9 9 348 352 2 - - -
parameter name T - - 9 9 354 355 2 - - -
parameter name R - - 9 9 360 361 1 - - -
parameter name rest - - 9 9 366 370 1 - - -
parameter name R - - 9 9 372 373 1 - - -
parameter name item - - 11 11 447 451 2 - - -
site call page.items.map - - 11 11 432 464 1 - 1 -
site call by - - 11 11 455 463 2 - 1 -
""",
    """
export value apiN - - 1 6 0 170 0 - - no
export function outerN - - 7 13 171 335 0 1 1 no
scope method open - - 2 2 24 56 1 - - -
scope method close - - 4 4 77 140 1 - - -
scope function outerN - - 7 13 171 335 0 - - -
scope function innerN - - 8 10 204 256 1 - - -
scope variable fetchN - - 14 14 336 387 0 - - -
call call fetchN - - 2 2 43 49 2 - - -
call argument key - - 2 2 50 53 3 - - -
call call deleteN - - 4 4 118 125 2 - - -
call argument t - - 4 4 126 127 3 - - -
call call updateN - - 9 9 239 246 2 - - -
call argument item - - 9 9 247 251 3 - - -
call call setState - - 11 11 288 296 3 - - -
call argument at - - 11 11 297 299 4 - - -
call call innerN - - 11 11 301 307 4 - - -
call argument item - - 11 11 308 312 5 - - -
call call patch - - 14 14 375 380 1 - - -
call argument key - - 14 14 381 384 2 - - -
type reference T - - 4 4 95 96 2 - - -
type reference Promise - - 4 4 99 106 1 - - -
type reference T - - 4 4 107 108 1 - - -
parameter name key - - 2 2 29 32 2 - - -
parameter name t - - 4 4 92 93 2 - - -
parameter name T - - 4 4 95 96 2 - - -
parameter name list - - 7 7 194 198 1 - - -
parameter name item - - 8 8 220 224 2 - - -
parameter name item - - 11 11 273 277 3 - - -
parameter name at - - 11 11 279 281 3 - - -
parameter name key - - 14 14 361 364 1 - - -
site call fetchN - - 2 2 43 54 2 - 1 -
site call deleteN - - 4 4 118 128 2 - 1 -
site call updateN - - 9 9 239 252 2 - 1 -
site call list.forEach - - 11 11 259 317 1 - 1 -
site call setState - - 11 11 288 314 3 - 2 -
site call innerN - - 11 11 301 313 4 - 1 -
site call patch - - 14 14 375 385 1 - 1 -
""",
    """
export function decideN - - 1 10 0 281 0 2 2 no
scope function decideN - - 1 10 0 281 0 - - -
scope function insertN - - 11 13 282 344 0 - - -
scope function last - - 14 14 345 374 0 - - -
guard if - - - 2 6 34 127 1 - - -
guard if - - - 4 6 67 127 1 - - -
guard if - - - 7 7 149 168 1 - - -
guard if - - - 8 8 202 216 2 - - -
call call log - - 3 3 51 54 2 - - -
call argument a - - 3 3 55 56 3 - - -
call new Same - - 5 5 96 100 2 - - -
call argument a - - 5 5 101 102 3 - - -
call call last - - 6 6 120 124 1 - - -
call argument b - - 6 6 125 126 2 - - -
call call insertN - - 8 8 177 184 2 - - -
call argument a - - 8 8 185 186 3 - - -
call call one - - 9 9 251 254 3 - - -
call argument b - - 9 9 255 256 4 - - -
call call execute - - 12 12 328 335 2 - - -
call argument row - - 12 12 336 339 3 - - -
parameter name a - - 1 1 24 25 1 - - -
parameter name b - - 1 1 27 28 1 - - -
parameter name row - - 11 11 299 302 1 - - -
parameter name b - - 14 14 359 360 1 - - -
site call log - - 3 3 51 57 2 - 1 -
site new Same - - 5 5 96 103 2 - 1 -
site call last - - 6 6 120 127 1 - 1 -
site call insertN - - 8 8 177 187 2 - 1 -
site call one - - 9 9 251 257 3 - 1 -
site call execute - - 12 12 328 340 2 - 1 -
""",
    """
import default default first ./two 1 1 0 46 0 - - -
import named second third ./two 1 1 0 46 0 - - -
import namespace - all ../all 2 2 47 76 0 - - -
reexport named aN renamed ./a 4 4 111 146 0 - - -
reexport star * * ./rest 5 5 147 169 0 - - -
reexport namespace - kit ./kit 6 6 170 198 0 - - -
export alias first first - 3 3 77 110 0 - - -
export alias third passed - 3 3 77 110 0 - - -
export class default - - 7 9 199 284 0 - - no
export function eachN - - 10 13 285 410 0 1 2 no
scope class - - - 7 9 199 284 0 - - -
scope method run - - 8 8 241 282 1 - - -
scope function eachN - - 10 13 285 410 0 - - -
call argument first - - 8 8 265 270 3 - - -
call call third - - 8 8 272 277 3 - - -
call argument a - - 11 11 365 366 2 - - -
call argument b - - 11 11 368 369 2 - - -
call argument c - - 12 12 385 386 2 - - -
type heritage all - - 7 7 228 231 0 - - -
type heritage Base - - 7 7 232 236 0 - - -
parameter name a - - 10 10 316 317 2 - - -
parameter name b - - 10 10 319 320 2 - - -
parameter name first - - 10 10 323 328 2 - - -
parameter name c - - 10 10 333 334 2 - - -
site call all.make - - 8 8 256 280 2 - 2 -
site call third - - 8 8 272 279 3 - 0 -
site call all.list - - 11 11 353 370 1 - 2 -
site new all.Box - - 12 12 377 408 1 - 2 -
""",
    """
import default default React react 1 1 0 48 0 - - -
import named useState useIt react 1 1 0 48 0 - - -
export function ViewN - - 2 11 49 330 0 1 1 no
scope variable ViewN - - 2 11 49 330 0 - - -
scope variable save - - 5 9 178 278 1 - - -
scope function render - - 12 14 331 387 0 - - -
guard if - - - 4 4 153 175 1 - - -
guard if - - - 6 6 209 230 2 - - -
call call useIt - - 3 3 138 143 1 - - -
call call onSave - - 7 7 241 247 2 - - -
call argument user - - 7 7 250 254 3 - - -
call call setOpen - - 8 8 260 267 2 - - -
call call render - - 10 10 309 315 2 - - -
call argument user - - 10 10 316 320 3 - - -
call call redirect - - 13 13 371 379 1 - - -
call argument user - - 13 13 380 384 2 - - -
type reference PropsN - - 2 2 78 84 0 - - -
type reference UserN - - 12 12 353 358 1 - - -
parameter name user - - 2 2 91 95 2 - - -
parameter name onSave - - 2 2 97 103 2 - - -
parameter name user - - 12 12 347 351 1 - - -
parameter name UserN - - 12 12 353 358 1 - - -
site call useIt - - 3 3 138 150 1 - 1 -
site call onSave - - 7 7 241 255 2 - 1 -
site call setOpen - - 8 8 260 274 2 - 1 -
site call render - - 10 10 309 321 2 - 1 -
site call redirect - - 13 13 371 385 1 - 1 -
""",
)


def _marks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The files and what a reader finds in them, read once."""
    files = bridge.module_files(spark, sf)
    return files, cut(code.source_marks(files, "doc_id"))


def _chosen(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    files, marks = _marks(spark, sf)
    table = scopes.scopes_of(marks, "doc_id")
    return files, marks, table, scopes.changed_scopes(table, bridge.touched_module_lines(spark, sf), "doc_id")


def source_tokens(spark, sf):
    """Tokens of each kind and how deep they go, and that all signs of a source are in them but blanks."""
    files = bridge.module_files(spark, sf)
    found = code.source_tokens(files, "doc_id").groupBy("doc_id").agg(
        F.max("depth").cast("long").alias("deepest"), F.count_if(F.col("kind") == "remark").alias("remarks"), F.count_if(F.col("kind") == "string").alias("strings"),
        F.count_if(F.col("kind") == "regex").alias("regexes"), F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("read"),
    )
    blanks = files.select("doc_id", F.length(F.regexp_replace("content", r"\s", "")).alias("solid"))
    return found.join(blanks, "doc_id").select("doc_id", "deepest", "remarks", "strings", "regexes", (F.col("solid") == F.col("read")).alias("whole"))


def source_contracts(spark, sf):
    _, marks = _marks(spark, sf)
    return code.contracts_of(marks, "doc_id").select("doc_id", "name", "kind", "line", "required", "total", "rest")


def source_calls(spark, sf):
    """Calls of imported names with the module that they mean."""
    files, marks = _marks(spark, sf)
    path = F.concat(F.lit("src/m"), F.col("doc_id"), F.lit(".ts"))
    imports = code.imports_of(marks, "doc_id").withColumn("module", F.coalesce(code.resolved_modules(path, F.col("module")), "module"))
    return code.usages(imports, code.sites_of(marks, "doc_id"), "doc_id").select("doc_id", "symbol", "module", "line", "is_new", "argc")


def source_bindings(spark, sf):
    """What modules import and pass on."""
    _, marks = _marks(spark, sf)
    kept = ("doc_id", "symbol", "local", "module", "line", "kind")
    return code.imports_of(marks, "doc_id").select(*kept).unionByName(code.reexports_of(marks, "doc_id").select(*kept))


def scope_extract(spark, sf):
    files, marks = _marks(spark, sf)
    found = scopes.with_texts(scopes.scopes_of(marks, "doc_id"), files, "doc_id")
    label = scopes.scope_label(F.col("kind"), F.col("name"))
    return found.select("doc_id", "scope", "kind", "name", "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("text_md5"), label.alias("label"), scopes.scope_key(F.col("kind"), F.col("name"), F.col("start_line"), F.col("end_line")).alias("key"))


def changed_scopes(spark, sf):
    *_, chosen = _chosen(spark, sf)
    return chosen.select("doc_id", "name", "scope", F.col("n").cast("long").alias("n"))


def removed_scopes(spark, sf):
    files, marks = _marks(spark, sf)
    lines = files.select("doc_id", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).cast("long").alias("line"), "text")
    removed = lines.join(bridge.touched_module_lines(spark, sf), ["doc_id", "line"])
    return scopes.removed_scopes(scopes.scopes_of(marks, "doc_id"), removed, "doc_id").select("doc_id", "scope", "name", "reason")


def semantic_segments(spark, sf):
    """Hunks of a line each, at the lines of both ways to touch a module."""
    files, marks = _marks(spark, sf)
    lines = bridge.touched_module_lines(spark, sf, both=True).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("l"))
    hunks = lines.select("doc_id", F.posexplode("l").alias("hunk_ix", "line")).select("doc_id", "hunk_ix", F.col("line").cast("int").alias("new_start"), F.lit(1).alias("new_lines"))
    anchors = hunks.select("doc_id", "hunk_ix", F.col("new_start").cast("long").alias("line"))
    return scopes.semantic_segments(hunks, scopes.scopes_of(marks, "doc_id"), anchors).select("doc_id", F.col("hunk_ix").cast("long").alias("hunk_ix"), F.col("segment_ix").cast("long").alias("segment_ix"))


def symbol_lookup(spark, sf):
    _, marks = _marks(spark, sf)
    table = scopes.scopes_of(marks, "doc_id")
    wanted = table.select("doc_id", "name").distinct()
    return scopes.symbols_by_name(table, wanted, "doc_id").select("doc_id", "name", "kind", (F.col("end") - F.col("start")).alias("length"))


def local_symbols(spark, sf):
    *_, chosen = _chosen(spark, sf)
    return scopes.local_symbols(chosen, "doc_id", "n").select("doc_id", "name", "type", "scope")


def remote_symbols(spark, sf):
    _, marks = _marks(spark, sf)
    table = scopes.scopes_of(marks, "doc_id")
    defined = scopes.local_symbols(table.filter("depth = 0"), "doc_id").select(F.concat(F.lit("f"), "doc_id").alias("path"), F.regexp_replace("name", "[0-9]+$", "").alias("name"))
    asked = bridge.read(spark, sf, "documents").select(F.concat(F.lit("f"), "doc_id").alias("own_path"), F.explode(F.array(F.lit("Box"), F.lit("load"))).alias("name"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n"), "doc_id")
    hits = asked.withColumn("path", F.concat(F.lit("f"), F.col("doc_id") + (F.col("n") * 2 + 1) * F.when(F.col("n") == 1, 0).otherwise(1)))
    return scopes.remote_symbols(hits, defined, F.lit(2)).select("own_path", "name", "path")


def call_chains(spark, sf):
    files, marks, table, chosen = _chosen(spark, sf)
    found = scopes.call_chains(chosen, marks, table, files, "doc_id").join(chosen.select("doc_id", "scope", "name"), ["doc_id", "scope"])
    return found.select("doc_id", "scope", scopes.chain_summary(F.col("name"), F.col("callees"), F.col("second")).alias("summary"))


def data_flows(spark, sf):
    files, marks, _, chosen = _chosen(spark, sf)
    return scopes.data_flows(chosen, marks, files, "doc_id")


def semantic_slices(spark, sf):
    files, marks, table, chosen = _chosen(spark, sf)
    return scopes.semantic_slices(chosen, marks, table, files, "doc_id").select("doc_id", F.col("place").cast("long").alias("place"), "label", "content")


def ast_candidates(spark, sf):
    """Names that a change of a module speaks of: its touched lines are what was added."""
    files, marks, _, chosen = _chosen(spark, sf)
    lines = files.select("doc_id", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).cast("long").alias("line"), "text")
    touched = lines.join(bridge.touched_module_lines(spark, sf), ["doc_id", "line"])
    diffs = touched.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l")).select("doc_id", F.array_join(F.transform("l", lambda x: F.concat(F.lit("+"), x["text"])), "\n").alias("content"))
    found = scopes.scored_candidates(chosen, marks, files, touched, diffs, "doc_id")
    return found.select("doc_id", "name", "score", "import_source", F.col("rank").cast("long").alias("rank"))


def _drift(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    head, base, change, configs, hits = bridge.drifts(spark, sf)
    key = F.concat(F.col("repo").cast("string"), F.lit(":"), F.col("path")).alias("file")
    new, old = (cut(code.source_marks(files.select(key, "content"), "file")) for files in (head, base))
    changes = cut(contracts.changed_contracts(old, new, change))
    return head, change, configs, hits, new, changes


def contract_findings(spark, sf):
    """Places that changes of contracts break, from sources on: imports, aliases, barrels, assignments, calls."""
    head, change, configs, _, marks, changes = _drift(spark, sf)
    bindings = contracts.binding_table(marks, change, head.select("repo", "path"), modules.alias_mappings(configs))
    return contracts.contract_findings(changes, bindings, marks).select("repo", "path", "line", "rule_id", "module", "name", "body")


def contract_signals(spark, sf):
    _, change, _, hits, _, changes = _drift(spark, sf)
    return contracts.contract_signals(changes, hits, change).select("repo", "path", F.col("line").cast("long").alias("line"), "summary")


def segment_context(spark, sf):
    """The context of a change of each module, by the limits of one of the kinds of files."""
    files, marks, table, chosen = _chosen(spark, sf)
    chosen = cut(chosen)
    path = F.concat(F.lit("src/m"), F.col("doc_id"), F.lit(".ts"))
    kinds = [(i, k[0]) for i, k in enumerate(classify.STRATEGIES)]
    kind = F.element_at(F.array(*[F.lit(k) for _, k in kinds]), (F.col("doc_id") % len(kinds)).cast("int") + 1)
    status = F.when(F.col("doc_id") % 7 == 0, "deleted").when(F.col("doc_id") % 5 == 1, "added").otherwise("modified")
    rows = files.select("doc_id", path.alias("path"), kind.alias("kind"), status.alias("status")).join(F.broadcast(classify.strategies(spark)), "kind")  # nine rows
    profiles = classify.retrieval_profile(rows, F.col("doc_id") % 2, F.col("status") == "deleted")
    structured = files.filter("doc_id % 3 = 0").select("doc_id", F.lit("命令结构摘要").alias("label"), F.lit("- run").alias("content"), path.alias("file"), F.lit(0).alias("ord"))
    lines = files.select("doc_id", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).cast("long").alias("line"), "text")
    touched = cut(lines.join(bridge.touched_module_lines(spark, sf), ["doc_id", "line"]))
    diffs = touched.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l")).select("doc_id", F.array_join(F.transform("l", lambda x: F.concat(F.lit("+"), x["text"])), "\n").alias("content"))
    candidates = cut(scopes.scored_candidates(chosen, marks, files, touched, diffs, "doc_id"))
    slices = scopes.semantic_slices(chosen, marks, table, files, "doc_id")
    removed = scopes.with_texts(scopes.removed_scopes(table, touched, "doc_id"), files, "doc_id")
    hits, library = bridge.library(spark, sf)
    known = scopes.scopes_of(code.source_marks(library))
    found = scopes.with_texts(scopes.symbols_by_name(known, known.select("path", "name").distinct()), library)
    definitions = found.select("path", "name", scopes.symbol_type(F.col("kind")).alias("type"), "text")
    made = contexts.segment_context(profiles, files, structured, chosen, slices, candidates, table, hits, definitions, removed)
    return made.select("doc_id", "kind", F.col("place").cast("long").alias("place"), "name", "file", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def yaml_jobs(spark, sf):
    files, touched = bridge.structured_files(spark, sf, yaml_only=True)
    found = configs.yaml_jobs(configs.yaml_lines(files, touched))
    return found.select("doc_id", F.col("n").cast("long").alias("n"), "job", "stage", "when", "allow_failure", F.array_join("needs", ",").alias("needs"))


def structured_slices(spark, sf):
    files, touched = bridge.structured_files(spark, sf)
    return configs.structured_slices(files, touched).select("doc_id", F.col("ord").cast("long").alias("ord"), "label", "content")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        source_tokens, source_contracts, source_calls, source_bindings, scope_extract, changed_scopes, removed_scopes, semantic_segments, symbol_lookup, local_symbols, remote_symbols,
        call_chains, data_flows, semantic_slices, ast_candidates, contract_findings, contract_signals, segment_context, yaml_jobs, structured_slices,
    )
    return {f.__name__: f for f in listed}


def _cell(value: str) -> str:
    return "null" if value == "-" else value if value.lstrip("-").isdigit() else _q(value)


_MARKED = "marked(i, mark, kind, name, local, module, line, end_line, s, e, depth, required, total, rest) as (values " + ", ".join(
    f"({i}, {', '.join(map(_cell, row.split()))})" for i, rows in enumerate(MARKS) for row in rows.strip().split("\n")
) + ")"
_MODULES = "modules(i, t) as (values " + ", ".join(f"({i}, {_q(t)})" for i, t in enumerate(shapes.MODULES)) + ")"
_WAYS = "ways(i, v, line) as (values " + ", ".join(f"({i}, {v}, {line})" for i, ways in enumerate(shapes.TOUCHED) for v, lines in enumerate(ways) for line in lines) + ")"
_N = "cast(doc_id as varchar)"
_USEFUL = f"length(name) >= 2 and regexp_matches(name, '^[A-Za-z_$][A-Za-z0-9_$]*$') and name not in ({', '.join(map(_q, values.STOP_NAMES))})"
def _scored(asked: str, p: str) -> str:
    """CTE ``p``scored: names of texts (id, t) by what their places count; the modules' lines hold no import in one line but by braces or as a default."""
    places = " union all ".join(f"select id, unnest(regexp_extract_all(t, {_q(pattern)}, 1)) as name, {n} as score, null as source from {p}asked" for pattern, n in values.NAME_SOURCES)
    return f"""{p}asked as ({asked}),
{p}found as ({places} union all select id, trim(split_part(unnest(string_split(regexp_extract(t, 'import\\s+(?:type\\s+)?\\{{([^}}]+)\\}}\\s+from', 1), ',')), ' as ', 1)), 10, regexp_extract(t, 'from\\s+[''"]([^''"]+)', 1) from {p}asked where regexp_matches(t, 'import\\s+(?:type\\s+)?\\{{')),
{p}scored as (select id, name, cast(sum(score) as bigint) as score, max(source) as source, row_number() over (partition by id order by sum(score) desc, name) as rank from {p}found where {_USEFUL} group by id, name)"""


_BASE = (
    _MODULES, _MARKED, _WAYS,
    "docs as (select doc_id, doc_id % 10 as i, doc_id // 10 % 2 as v from documents)",
    f"marks as (select doc_id, mark, kind, replace(name, 'N', {_N}) as name, replace(local, 'N', {_N}) as local, module, cast(line as bigint) as line, cast(end_line as bigint) as end_line, s, e, depth, required, total, rest, "
    f"replace(substr(t, s + 1, e - s), 'N', {_N}) as text from docs join modules using (i) join marked using (i))",
    "scopes as (select doc_id, row_number() over (partition by doc_id order by s, e desc) - 1 as scope, kind, name, line as start_line, end_line, s, e, depth, text from marks where mark = 'scope')",
    "file_lines as (select doc_id, generate_subscripts(string_split(t, chr(10)), 1) as line, replace(unnest(string_split(t, chr(10))), 'N', cast(doc_id as varchar)) as text from docs join modules using (i))",
    "touched as (select doc_id, line from docs join ways using (i, v))",
    """chosen as (select *, row_number() over (partition by doc_id order by length(text), scope) as n from scopes s
  where exists (select 1 from touched t where t.doc_id = s.doc_id and t.line between start_line and end_line) qualify n <= 4)""",
    "called as (select c.doc_id, c.scope, m.name, min(m.s) as spot from chosen c join marks m on m.doc_id = c.doc_id and m.mark = 'call' and m.s >= c.s and m.e <= c.e group by all)",
    f"direct as (select doc_id, scope, name, row_number() over (partition by doc_id, scope order by spot) as n from called where {_USEFUL} qualify n <= 5)",
    "defined as (select *, row_number() over (partition by doc_id, name order by list_position(['function', 'interface', 'type', 'class', 'variable'], kind), scope) as r from scopes where depth = 0 and kind in ('function', 'interface', 'type', 'class', 'variable') qualify r = 1)",
)
_CHAINS = (
    _scored("select doc_id || ':' || name as id, text as t from defined where kind in ('function', 'variable')", "own_"),
    """hops as (select d.doc_id, d.scope, d.n, d.name || ' -> ' || string_agg(s.name, ', ' order by s.rank) as line from direct d join (
    select *, row_number() over (partition by id order by rank) as k from own_scored where name <> split_part(id, ':', 2)) s on s.id = d.doc_id || ':' || d.name and k <= 3
  where d.n <= 3 group by d.doc_id, d.scope, d.n, d.name)""",
    """chains as (select doc_id, scope, '入口: ' || coalesce(max(c.name), '匿名作用域') || chr(10) || '直接调用: ' || string_agg(d.name, ', ' order by d.n)
    || coalesce((select chr(10) || '二跳调用:' || chr(10) || string_agg('- ' || line, chr(10) order by n) from hops h where h.doc_id = d.doc_id and h.scope = d.scope), '') as summary
  from direct d join chosen c using (doc_id, scope) group by doc_id, scope)""",
)
_FLOWS = (
    """guards as (select c.doc_id, c.scope, m.s, trim(m.text, ' ' || chr(10)) as text, regexp_matches(m.text, '\\b(return|throw)\\b') as leaves from chosen c join marks m on m.doc_id = c.doc_id and m.mark = 'guard' and m.s >= c.s and m.e <= c.e)""",
    f"""given as (select doc_id, scope, name, row_number() over (partition by doc_id, scope order by spot) as n from (
    select c.doc_id, c.scope, m.name, min(m.s) as spot from chosen c join marks m on m.doc_id = c.doc_id and m.mark = 'parameter' and m.s >= c.s and m.e <= c.e group by all) where {_USEFUL} qualify n <= 6)""",
    """heads as (select doc_id, scope, trim(split_part(text, chr(10), 1)) as head, row_number() over (partition by doc_id, scope order by s) as n from guards
  where regexp_matches(split_part(text, chr(10), 1), '\\b(return|throw)\\b') qualify n <= 2)""",
    """strong as (select doc_id, scope, name, row_number() over (partition by doc_id, scope order by spot) as n from called
  where regexp_matches(name, '^(set[A-Z]|update|insert|delete|query|execute|fetch|post|put|patch|redirect|send|emit)') qualify n <= 5)""",
    """parts as (
  select doc_id, scope, p, p5, g, f from chosen
  left join (select doc_id, scope, string_agg(name, ', ' order by n) as p, string_agg(name, ', ' order by n) filter (n <= 5) as p5 from given group by all) using (doc_id, scope)
  left join (select doc_id, scope, string_agg(head, ' | ' order by n) as g from heads group by all) using (doc_id, scope)
  left join (select doc_id, scope, string_agg(name, ', ' order by n) as f from strong group by all) using (doc_id, scope))""",
    """flows as (select doc_id, scope, concat_ws(chr(10), '输入参数: ' || p, '保护条件: ' || g, '敏感调用: ' || f, case when f is not null then '可能参与下游调用的输入: ' || p5 end) as summary from parts where p is not null or g is not null or f is not null)""",
)

_SLICES = (
    # what each scope has to tell, in order; branches once each, those that leave
    "told as (select c.doc_id, c.n, c.scope, k.summary as chain, f.summary as flow from chosen c left join chains k using (doc_id, scope) left join flows f using (doc_id, scope) where c.n <= 3)",
    "branches as (select doc_id, scope, list(text order by s) as b, list(leaves order by s) as l from guards group by doc_id, scope)",
    """walk(doc_id, n, slices) as (
      select distinct doc_id, cast(0 as bigint), cast([] as struct(label varchar, content varchar)[]) from chosen
      union all
      select doc_id, n, list_concat(s2, list_filter(leaving, lambda x, k: not list_contains(s2, x) and list_position(leaving, x) = k)[1 : greatest(1, 2 - len(s2))]) from (
        select doc_id, n, s2, list_transform(list_filter(range(1, case when len(s2) >= 2 then 1 else len(b) end + 1), lambda j: l[j]), lambda j: {'label': '关键保护分支', 'content': b[j]}) as leaving from (
          select w.doc_id, t.n, coalesce(b, []) as b, coalesce(l, []) as l,
            list_concat(w.slices, list_filter([{'label': '调用链摘要', 'content': chain}, {'label': '数据流摘要', 'content': flow}], lambda x: x['content'] is not null and not list_contains(w.slices, x))) as s2
          from walk w join told t on t.doc_id = w.doc_id and t.n = w.n + 1 left join branches r on r.doc_id = t.doc_id and r.scope = t.scope)))""",
    """asked_names as (select c.doc_id, m.name, min((c.n, m.s)) as spot from chosen c join marks m on m.doc_id = c.doc_id and (m.mark = 'call' or (m.mark = 'type' and m.kind = 'reference')) and m.s >= c.s and m.e <= c.e where c.n <= 3
      and m.name not in (select name from chosen o where o.doc_id = c.doc_id and name is not null) group by all)""",
    "helpers as (select a.doc_id, row_number() over (partition by a.doc_id order by spot) as k, case when kind in ('function', 'variable') then '同文件依赖函数' else '同文件依赖类型' end as label, trim(text, ' ' || chr(10)) as content from asked_names a join defined d using (doc_id, name) qualify k <= 4)",
    "ends as (select doc_id, arg_max(slices, n) as slices from walk group by doc_id)",
    "every as (select doc_id, 0 as part, generate_subscripts(slices, 1) as k, unnest(slices)['label'] as label, unnest(slices)['content'] as content from ends union all select doc_id, 1, k, label, content from helpers)",
    "sliced as (select doc_id, row_number() over (partition by doc_id order by part, k) as place, label, content from (select doc_id, label, content, min(part) as part, arg_min(k, part) as k from every group by doc_id, label, content) qualify place <= 6)",
)
_CANDIDATES = (
    "added as (select doc_id, string_agg(text, chr(10) order by line) as t from file_lines join touched using (doc_id, line) group by doc_id)",
    _scored("select doc_id as id, t from added", ""),
    "near as (select doc_id, coalesce(t, '') || chr(10) || coalesce((select string_agg(text, chr(10) order by n) from chosen c where c.doc_id = a.doc_id and n <= 3), '') as w from added a)",
    f"""evidence as (
  select m.doc_id, m.local as name, 12 as score, m.module as source from marks m join near using (doc_id) where m.mark = 'import' and contains(w, m.local)
  union all select c.doc_id, m.name, 7, null from chosen c join marks m on m.doc_id = c.doc_id and m.mark in ('call', 'type') and m.s >= c.s and m.e <= c.e
  union all select id, name, score, source from scored)""",
    f"""candidates as (select doc_id, name, score, import_source, row_number() over (partition by doc_id order by score desc, name) as rank
  from (select doc_id, name, cast(sum(score) as bigint) as score, max(source) as import_source from evidence where {_USEFUL} group by doc_id, name))""",
)
_STRATEGY = ", ".join(f"({i}, {str(r[6]).lower()}, {str(r[7]).lower()}, {r[8]}, {r[9]}, {', '.join(map(str, r[12:16]))})" for i, r in enumerate(values.STRATEGIES))
_LIBRARY = ", ".join(f"({i}, {_q(x)})" for i, x in enumerate(shapes.LIBRARY))
_CONTEXT = (
    f"strategy(k, code, far, lookups, results, f, t, s, d) as (values {_STRATEGY})",
    """profiles as (
  select doc_id, 'src/m' || doc_id || '.ts' as path, code, far, results, doc_id % 7 = 0 as deleted, doc_id % 7 > 0 and doc_id % 5 = 1 as added, case when doc_id % 2 = 1 then greatest(1, lookups - 1) else lookups end as lookups,
    case when code then f else 0 end as f, case when code then t else 0 end as t, case when code then s else 0 end as s, case when not code then 0 when doc_id % 7 = 0 then greatest(2, d) else d end as d
  from documents join strategy on k = doc_id % 9)""",
    """items1 as (
  select doc_id, 'slice' as kind, '命令结构摘要' as name, path as file, '- run' as content, 1 as part, 0 as ord from profiles where doc_id % 3 = 0
  union all select doc_id, case when kind in ('function', 'method', 'variable', 'class') then 'function' else 'type' end, name, 'current', text, 2, n from chosen where name is not null qualify row_number() over (partition by doc_id, name order by n) = 1
  union all select doc_id, 'slice', label, 'src/m' || doc_id || '.ts', content, 3, place from sliced
  union all select doc_id, case when d.kind in ('function', 'variable', 'class') then 'function' else 'type' end, name, 'current', text, 4, rank from candidates join defined d using (doc_id, name))""",
    """kept1 as (select doc_id, name from (
    select i.*, p.f, p.t, row_number() over (partition by i.doc_id, kind order by part, ord) as place from (
      select * from items1 where kind in ('function', 'type') qualify row_number() over (partition by doc_id, kind, name, file order by part, ord) = 1) i join profiles p using (doc_id) where code)
  where place <= case when kind = 'function' then f else t end)""",
    "missing as (select c.doc_id, c.name, p.path, results, row_number() over (partition by c.doc_id order by rank) as n, lookups from candidates c join profiles p using (doc_id) where code and far and not exists (select 1 from kept1 k where k.doc_id = c.doc_id and k.name = c.name) qualify n <= lookups)",
    f"library(k, name) as (values {_LIBRARY})",
    "hits as (select name, s_suppkey, row_number() over (partition by name order by s_suppkey) as spot, s_suppkey % 13 = k as defines from supplier join library on s_suppkey % 13 = k or (s_suppkey + 1) % 13 = k)",
    "remote as (select m.doc_id, m.name, min(n) as n, min(s_suppkey) as f from missing m join hits h on h.name = m.name and defines and spot <= results group by m.doc_id, m.name)",
    """items as (
  select * from items1 union all
  select doc_id, 'function', name, 'lib/s' || f || '.ts', 'export function ' || name || '(a) { return ' || f || ' }', 5, n from remote
  union all select doc_id, 'deleted', reason, path, text, 6, n from profiles join removed using (doc_id) where not added)""",
)


def oracle_sql() -> dict[str, str]:
    reason = "case " + " ".join(f"when regexp_matches(t, {_q(p)}) then '{n}'" for n, p in values.REMOVED_BEHAVIOUR) + " else 'default' end"
    contract = "select doc_id, name, kind, cast(line as int) as line, required, total, rest = 'rest' as rest from marks where mark = 'export' and kind <> 'alias'"
    resolved = """case when not starts_with(module, '.') then module when starts_with(module, '../') then module[4:] else 'src' || module[2:] end"""
    return {
        "source_tokens": _with(
            *_BASE,
            """told(i, deepest, remarks, strings, regexes) as (values (0, 3, 0, 1, 0), (1, 2, 0, 1, 0), (2, 3, 0, 1, 2), (3, 3, 0, 1, 0), (4, 5, 3, 3, 0), (5, 3, 0, 2, 0), (6, 5, 0, 0, 0), (7, 4, 0, 0, 0), (8, 4, 0, 6, 0), (9, 3, 0, 1, 0))""",
            select="select doc_id, cast(deepest as bigint) as deepest, cast(remarks as bigint) as remarks, cast(strings as bigint) as strings, cast(regexes as bigint) as regexes, true as whole from docs join told using (i)",
        ),
        "source_contracts": _with(*_BASE, select=contract),
        "source_calls": _with(
            *_BASE,
            "imports as (select doc_id, name as symbol, local, module from marks where mark = 'import')",
            "sites as (select doc_id, split_part(name, '.', 1) as local, case when contains(name, '.') then split_part(name, '.', -1) end as member, cast(line as int) as line, kind = 'new' as is_new, total as argc from marks where mark = 'site')",
            select=f"select doc_id, coalesce(symbol, member) as symbol, {resolved} as module, line, is_new, argc from imports join sites using (doc_id, local) where (symbol is null) = (member is not null)",
        ),
        "source_bindings": _with(*_BASE, select="select doc_id, name as symbol, local, module, cast(line as int) as line, kind from marks where mark in ('import', 'reexport')"),
        "scope_extract": _with(
            *_BASE,
            "labels(kind, label) as (values ('function', '函数'), ('method', '方法'), ('class', '类'), ('interface', '接口'), ('type', '类型'), ('enum', '枚举'), ('variable', '函数变量'))",
            select="""select doc_id, scope, kind, name, start_line, end_line, md5(text) as text_md5, concat_ws(' ', label, name) as label, label || ':' || coalesce(name, cast(start_line as varchar)) || ':' || start_line || ':' || end_line as key
            from scopes join labels using (kind)""",
        ),
        "changed_scopes": _with(*_BASE, select="select doc_id, name, scope, n from chosen"),
        "removed_scopes": _with(
            *_BASE,
            "gone as (select doc_id, line, lower(text) as t from file_lines join touched using (doc_id, line))",
            select=f"""select doc_id, scope, name, {reason} as reason from (select c.doc_id, c.scope, c.name, string_agg(t, chr(10) order by line) as t from chosen c join gone g on g.doc_id = c.doc_id and g.line between start_line and end_line and t <> '' group by all)""",
        ),
        "semantic_segments": _with(
            *_BASE,
            "hunks as (select doc_id, line, row_number() over (partition by doc_id order by line) - 1 as hunk_ix from (select distinct doc_id, line from docs join ways using (i)))",
            "own as (select h.doc_id, hunk_ix, line, coalesce('s' || (select arg_min(scope, (length(text), scope)) from scopes s where s.doc_id = h.doc_id and line between start_line and end_line), 'h' || hunk_ix) as own from hunks h)",
            "runs as (select *, sum(c) over (partition by doc_id order by hunk_ix) as run from (select *, case when hunk_ix > 0 and own <> lag(own) over (partition by doc_id order by hunk_ix) then 1 else 0 end as c from own))",
            select="select doc_id, hunk_ix, cast(case when max(run) over (partition by doc_id) between 1 and 3 then run else 0 end as bigint) as segment_ix from runs",
        ),
        "symbol_lookup": _with(*_BASE, select="select doc_id, name, kind, cast(length(text) as int) as length from defined where name is not null"),
        "local_symbols": _with(
            *_BASE,
            select="""select doc_id, name, case when kind in ('function', 'method', 'variable') then 'function' when kind = 'class' then 'class' else 'interface' end as type, scope
            from chosen where name is not null qualify row_number() over (partition by doc_id, name order by n) = 1""",
        ),
        "remote_symbols": """with h as (select doc_id, name, n, doc_id + (n * 2 + 1) as other from documents, (values ('Box'), ('load')) as t(name), (values (0), (2)) as r(n)),
            o as (select * from h join (select doc_id as d from documents) on d = other where (name = 'load' and other % 10 in (0, 1)) or (name = 'Box' and other % 10 = 0))
            select 'f' || doc_id as own_path, name, 'f' || arg_min(other, n) as path from o group by doc_id, name""",
        "call_chains": _with(*_BASE, *_CHAINS, select="select * from chains"),
        "data_flows": _with(*_BASE, *_FLOWS, select="select * from flows"),
        "semantic_slices": _with(
            *_BASE, *_CHAINS, *_FLOWS,
            *_SLICES, select="select * from sliced",
            recursive=True,
        ),
        "contract_findings": _with(
            "r as (select cast(s_suppkey as varchar) as repo, s_suppkey % 6 as way from supplier)",
            "f(way, path, line, rule, name) as (values (0, 'src/a.ts', 4, 's', 'updateUserN'), (0, 'src/b.ts', 4, 's', 'updateUserN'), (1, 'src/a.ts', 4, 's', 'updateUserN'), (1, 'src/b.ts', 4, 's', 'updateUserN'), (2, 'src/a.ts', 4, 's', 'updateUserN'), "
            "(3, 'src/a.ts', 4, 's', 'updateUserN'), (3, 'src/b.ts', 4, 's', 'updateUserN'), (4, 'src/a.ts', 1, 'r', 'goneN'), (4, 'src/a.ts', 2, 'k', 'MadeN'), (4, 'src/a.ts', 4, 'k', 'buildN'), (5, 'src/a.ts', 10, 's', 'updateUserN'))",
            "t(rule, name, rule_id, body) as (values "
            "('s', 'updateUserN', 'contract-function-signature-drift', '**[跨文件调用方未同步]** `src/lib/user-api.ts` 导出的 `updateUserN` 已从 updateUserN(id: string, name: string) 变成 updateUserN(id: string, name: string, active: boolean)，但这里仍按旧调用方式传参。合并后很容易出现必填参数缺失、默认值失效或运行时分支漂移。建议同步更新所有调用点。'), "
            "('r', 'goneN', 'contract-export-removed', '**[跨文件契约漂移]** `src/lib/user-api.ts` 已移除导出 `goneN`，但当前文件仍在导入它。这样合并后会直接导致模块加载失败或运行时报错。建议同步迁移调用方，或在导出侧保留兼容层。'), "
            "('k', 'MadeN', 'contract-export-kind-drift', '**[跨文件调用方式未同步]** `src/lib/user-api.ts` 导出的 `MadeN` 已从 class 变为 function，但这里仍按`new` 构造方式使用它。合并后很容易出现运行时报错或语义漂移。建议同步调整调用方式，或在导出侧保留兼容层。'), "
            "('k', 'buildN', 'contract-export-kind-drift', '**[跨文件调用方式未同步]** `src/lib/user-api.ts` 导出的 `buildN` 已从 function 变为 value，但这里仍按函数调用方式使用它。合并后很容易出现运行时报错或语义漂移。建议同步调整调用方式，或在导出侧保留兼容层。'))",
            select="select repo, path, cast(line as bigint) as line, rule_id, 'src/lib/user-api.ts' as module, replace(name, 'N', repo) as name, replace(body, 'N', repo) as body from r join f using (way) join t using (rule, name)",
        ),
        "contract_signals": _with(
            "r as (select s_suppkey as n, cast(s_suppkey as varchar) as repo, s_suppkey % 6 = 4 as other from supplier)",
            "c(other, name, line, told) as (values (false, 'updateUserN', 1, '导出函数 updateUserN 的签名已从 updateUserN(id: string, name: string) 变为 updateUserN(id: string, name: string, active: boolean)'), "
            "(true, 'buildN', 1, '导出符号 buildN 的类型已从 function 变为 value'), (true, 'MadeN', 2, '导出符号 MadeN 的类型已从 class 变为 function'), (true, 'goneN', 5, '导出符号 goneN 已被移除'))",
            # of a search's paths src/x0.ts, src/x1.ts, src/x2.md ... two of three are scripts, ten at most count
            "x as (select *, least(10, n % 15 + 1 - (n % 15 + 1) // 3) as users from r join c using (other))",
            select="""select repo, 'src/lib/user-api.ts' as path, cast(line as bigint) as line, replace('检测到跨文件契约变更：' || told, 'N', repo) as summary from x
            union all select repo, 'src/lib/user-api.ts', line, replace('导出契约 ' || told || '，仓库内还有 ' || users || ' 个疑似外部调用文件未包含在本次 diff 中', 'N', repo) from x where n % 4 > 0 and name in ('updateUserN', 'goneN')""",
        ),
        "ast_candidates": _with(*_BASE, *_CANDIDATES, select="select * from candidates"),
        "segment_context": _with(
            *_BASE, *_CHAINS, *_FLOWS, *_SLICES, *_CANDIDATES,
            f"""removed as (select doc_id, n, text, {reason} as reason from (select c.doc_id, c.n, c.text, lower(coalesce(string_agg(l.text, chr(10) order by l.line), '')) as t
              from chosen c join file_lines l on l.doc_id = c.doc_id and l.line between start_line and end_line join touched u on u.doc_id = l.doc_id and u.line = l.line where l.text <> '' group by all))""",
            *_CONTEXT,
            select="""select doc_id, kind, place, name, file, md5(content) as content_md5 from (
              select i.*, p.*, row_number() over (partition by i.doc_id, kind order by part, ord) as place from (
                select * from items qualify row_number() over (partition by doc_id, kind, name, file, case when kind = 'slice' then content when kind = 'deleted' then cast(ord as varchar) end order by part, ord) = 1) i
              join (select doc_id, code, f, t, s, d from profiles where code) p on p.doc_id = i.doc_id)
            where place <= case kind when 'function' then f when 'type' then t when 'slice' then s else d end""",
            recursive=True,
        ),
        "yaml_jobs": """with d as (select doc_id, doc_id % 4 as v, cast(doc_id as varchar) as id from documents), j(v, n, job, stage, "when", allow_failure, needs) as (values
              (0, 1, 'buildN', 'test', null, 'true', 'a,b'), (0, 2, 'laterN', null, 'manual', null, ''), (1, 1, 'oneN', 'last', null, null, ''), (1, 2, 'two', null, null, null, ''), (2, 1, 'on', null, null, null, ''), (2, 2, 'jobs', null, 'always', null, 'x'))
            select doc_id, cast(n as bigint) as n, replace(job, 'N', id) as job, stage, "when", allow_failure, needs from d join j using (v)""",
        "structured_slices": """with d as (select doc_id, doc_id % 8 as v, cast(doc_id as varchar) as id from documents), s(v, ord, label, content) as (values
              (0, 0, '配置键路径摘要', '- buildN.stage' || chr(10) || '- laterN'), (0, 1, 'CI 结构摘要', '- job=buildN | stage=test | allow_failure=true | needs=a,b' || chr(10) || '- job=laterN | when=manual'),
              (1, 0, '配置键路径摘要', '- oneN' || chr(10) || '- oneN.stage'), (2, 0, '配置键路径摘要', '- on' || chr(10) || '- jobs.runN.needs'), (2, 1, 'CI 结构摘要', '- job=on' || chr(10) || '- job=jobs | when=always | needs=x'),
              (4, 0, 'JSON 键摘要', '- aN' || chr(10) || '- b'), (4, 1, 'JSON 顶层结构', '- aN' || chr(10) || '- c'), (5, 0, '配置节摘要', '- s.kN'), (6, 0, '命令结构摘要', '- runN' || chr(10) || '- npm'))
            select doc_id, cast(ord as bigint) as ord, label, replace(content, 'N', id) as content from d join s using (v)""",
    }
