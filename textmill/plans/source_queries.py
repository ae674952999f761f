"""Extraction, resolution and traversal over a source corpus that is written from the standard tables: one file of a template for
each row, with its key in the place of every `%`. The expected rows are stated by hand, line by line, beside each template."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import functions as F

from ..corpus import explicit
from ..functions import extract as ex
from ..operators import edit as ed
from ..operators import graph as gr
from ..operators import resolve as rs
from ..operators import sink
from ..operators import symbols as sy
from ..operators.grep import Search
from ..sources.tree import files, tree
from ..sources.walk import walk
from ..storage import fresh_path, materialize
from .catalogue import query, table

TS = """\
import { base, type B } from "./shared";
import type { T } from "@lib/types";
import pad from "left-pad/sub"; // import no from "./commented"
export * from "./gone%";
const text = "import y from './string'";
export async function run%(a: number) {
  const inner% = (x: T) => x;
  return import("../../lib/util.js");
}
export class Box% {
  open%(key: string) { return key; }
}
interface Shape% { a: number }
type Alias% = B | T;
enum Color% { Red, Green }
"""
RUST = """\
use crate::part%::{Thing, sub::Other as O, self};
use super::shared::*;
use std::fmt;
mod inner;
pub struct Part% { a: u32 }
impl Part% {
    pub fn new%() -> Self { Part% { a: 1 } }
}
/* use crate::no; /* nested */ fn no() {} */
pub(crate) async fn free%(s: &str) -> &str { "fn quoted() {}" }
const LIMIT%: u32 = 3;
trait Act { fn act%(&self); }
"""
PYTHON = """\
import os, json
from .base import thing%
from ..up import other
LIMIT = 3
class Node%:
    def walk%(self):
        def inner%():
            return "import no"
        return inner%
async def main%():
    import late%
"""
VUE = """\
<template><b>import x from "./no"</b></template>
<script lang="ts">
import Part from "./part%.vue";
export function setup%() { return 1; }
</script>
"""
HASKELL = """\
module M% where
import qualified Data.Map as M
area% 0 = 0
area% n = n * n
other% x = x
area% y = y
data Tree% = Leaf | Node
"""
MARKDOWN = """\
# Book %
text
## One % ##
```
# not a heading
```
### Deep
## Two
# End
"""
LUA = """\
local util = require("pkg.util%")
-- function no() end
--[[ function no2()
end ]]
local function near%(a)
  local inner% = function(x) return x end
  return inner%(a)
end
function Box.open%(k)
  if k then return "function no3()" end
end
function Box:close%() end
"""
#: Of each template: table, key, path and the rest of the path, text.
FILES = {
    "ts": ("customer", "c_custkey", "src/app/c%.ts", TS),
    "rust": ("supplier", "s_suppkey", "crate/src/part%.rs", RUST),
    "python": ("supplier", "s_suppkey", "pkg/mod/m%.py", PYTHON),
    "vue": ("nation", "n_nationkey", "src/app/v%.vue", VUE),
    "haskell": ("nation", "n_nationkey", "hs/M%.hs", HASKELL),
    "markdown": ("region", "r_regionkey", "docs/b%.md", MARKDOWN),
    "lua": ("nation", "n_nationkey", "lua/l%.lua", LUA),
    "none": ("region", "r_regionkey", "data/r%.xyz", "import x\n"),
}
#: Files that the imports above lead to, with their own text.
SINGLE = [
    ("src/app/shared.ts", 'export const base = require("../../lib/util");\n'),
    ("lib/types.ts", "export type T = number;\n"),
    ("lib/util.ts", 'import "./types";\n'),
    ("crate/src/lib.rs", "pub mod shared;\n"),
    ("crate/src/shared.rs", "pub fn helper() {}\n"),
    ("pkg/mod/base.py", "x = 1\n"),
    ("pkg/up.py", "from .mod import base\n"),
    ("pkg/mod/__init__.py", ""),
]
ALIASES = rs.project_paths('{"compilerOptions": {"baseUrl": ".", /* own names */ "paths": {"@lib/*": ["lib/*"],}}}')

SYMBOLS = {
    "ts": [("run%", "function", 6, 22, 0), ("inner%", "function", 7, 8, 1), ("Box%", "class", 10, 13, 0), ("open%", "method", 11, 2, 1), ("Shape%", "interface", 13, 10, 0), ("Alias%", "type", 14, 5, 0), ("Color%", "enum", 15, 5, 0)],
    "rust": [("inner", "module", 4, 4, 0), ("Part%", "struct", 5, 11, 0), ("new%", "method", 7, 11, 0), ("free%", "function", 10, 20, 0), ("LIMIT%", "constant", 11, 6, 0), ("Act", "trait", 12, 6, 0), ("act%", "method", 12, 15, 1)],
    "python": [("LIMIT", "constant", 4, 0, 0), ("Node%", "class", 5, 6, 0), ("walk%", "method", 6, 8, 1), ("inner%", "function", 7, 12, 2), ("main%", "function", 10, 10, 0)],
    "vue": [("setup%", "function", 4, 16, 0)],
    "haskell": [("area%", "function", 3, 0, 0), ("other%", "function", 5, 0, 0), ("area%", "function", 6, 0, 0), ("Tree%", "type", 7, 5, 0)],
    "lua": [("near%", "function", 5, 15, 0), ("inner%", "function", 6, 8, 1), ("open%", "function", 9, 13, 0), ("close%", "method", 12, 13, 0)],
    "markdown": [("Book %", "module", 1, 2, 0), ("One %", "module", 3, 3, 1), ("Deep", "module", 7, 4, 2), ("Two", "module", 8, 3, 1), ("End", "module", 9, 2, 0)],
}
#: (specifier, kind, line, target, kind of the target)
IMPORTS = {
    "ts": [("./shared", "static", 1, "src/app/shared.ts", "path"), ("@lib/types", "static", 2, "lib/types.ts", "path"), ("left-pad/sub", "static", 3, "left-pad", "external"), ("./gone%", "reexport", 4, "./gone%", "unresolved"), ("../../lib/util.js", "dynamic", 8, "lib/util.ts", "path")],
    "rust": [("crate::part%::Thing", "use", 1, "crate/src/part%.rs", "path"), ("crate::part%::sub::Other", "use", 1, "crate/src/part%.rs", "path"), ("crate::part%", "use", 1, "crate/src/part%.rs", "path"), ("super::shared::*", "use", 2, "crate/src/shared.rs", "path"), ("std::fmt", "use", 3, "std", "external"), ("inner", "mod", 4, "inner", "unresolved")],
    "python": [("os", "import", 1, "os", "external"), ("json", "import", 1, "json", "external"), (".base", "from", 2, "pkg/mod/base.py", "path"), ("..up", "from", 3, "pkg/up.py", "path"), ("late%", "import", 11, "late%", "external")],
    "vue": [("./part%.vue", "static", 3, "./part%.vue", "unresolved")],
    "haskell": [("Data.Map", "import", 2, "Data.Map", "unresolved")],
    "lua": [("pkg.util%", "require", 1, "pkg.util%", "unresolved")],
}
SINGLE_IMPORTS = [("src/app/shared.ts", "../../lib/util", "require", 1, "lib/util.ts", "path"), ("lib/util.ts", "./types", "static", 1, "lib/types.ts", "path"), ("crate/src/lib.rs", "shared", "mod", 1, "crate/src/shared.rs", "path"), ("pkg/up.py", ".mod", "from", 1, "pkg/mod/__init__.py", "path")]
SINGLE_SYMBOLS = [("lib/types.ts", 0, "T", "type", 1, 12, 0), ("crate/src/lib.rs", 0, "shared", "module", 1, 8, 0), ("crate/src/shared.rs", 0, "helper", "function", 1, 7, 0)]


#: Fixed value: files that a task parses, so that its memory stays the same whatever the tables hold.
FILES_PER_TASK = 20_000


def _filled(text: str, key: str):
    return F.replace(F.lit(text), F.lit("%"), F.col(key).cast("string"))


def sources(spark, sf_dir):
    """(path, text) of the written corpus."""
    made = [table(spark, sf_dir, t).select(_filled(path, key).alias("path"), _filled(text, key).alias("text")) for t, key, path, text in FILES.values()]
    rows = reduce(lambda a, b: a.unionByName(b), [*made, spark.createDataFrame(SINGLE, "path string, text string")])
    n = sum(table(spark, sf_dir, t).count() for t, *_ in FILES.values())
    parts = max(spark.sparkContext.defaultParallelism, -(-n // FILES_PER_TASK))
    return rows.repartition(parts, "path")  # small tables come in one split, their parsing does not


def analysed(spark, sf_dir):
    return ex.analyses(sources(spark, sf_dir))


def resolved(spark, sf_dir):
    files = sources(spark, sf_dir)
    return materialize(rs.resolve(ex.imports(ex.analyses(files)), files.select("path"), ALIASES), "resolved")


def _literal(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def expected(rows: dict[str, list[tuple]], single: list[tuple], names: str) -> str:
    """SQL of the stated rows: (path, place in the file, names) of each template and key, and those of the single files."""
    parts = []
    for name, listed in rows.items():
        t, key, path, _ = FILES[name]
        values = ", ".join("(" + ", ".join(map(_literal, (k, *r))) + ")" for k, r in enumerate(listed))
        cols = ", ".join(f"replace({c}, '%', k) AS {c}" if isinstance(listed[0][j], str) else c for j, c in enumerate(names.split(", ")))
        parts.append(f"SELECT replace('{path}', '%', k) AS path, idx, {cols} FROM (SELECT CAST({key} AS VARCHAR) AS k FROM {t}), (VALUES {values}) AS v(idx, {names})")
    parts.append("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in single) + f") AS v(path, idx, {names})")
    return " UNION ALL ".join(parts)


SYMBOL_ROWS = expected(SYMBOLS, SINGLE_SYMBOLS, "name, kind, line, col, depth")
IMPORT_ROWS = expected(IMPORTS, [(r[0], 0, *r[1:]) for r in SINGLE_IMPORTS], "specifier, kind, line, dst, to_kind")


@query("source_symbols", f"SELECT path, CAST(idx AS INTEGER) AS idx, name, kind, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, CAST(depth AS INTEGER) AS depth FROM ({SYMBOL_ROWS}) q")
def source_symbols(spark, sf_dir):
    return ex.symbols(analysed(spark, sf_dir)).select("path", "idx", "name", "kind", "line", F.col("column").alias("col"), "depth")


@query("source_outline", f"SELECT path, CAST(idx + 1 AS INTEGER) AS position, repeat('  ', CAST(depth AS INTEGER)) || kind || ' ' || name AS entry, CAST(line AS BIGINT) AS line FROM ({SYMBOL_ROWS}) q")
def source_outline(spark, sf_dir):
    rows = sy.outline(ex.symbols(analysed(spark, sf_dir)))
    return rows.select("path", "position", F.concat(F.repeat(F.lit("  "), F.col("depth")), "kind", F.lit(" "), "name").alias("entry"), "line")


@query("source_nesting", f"SELECT path, CAST(idx AS INTEGER) AS idx, CAST(depth AS INTEGER) AS depth FROM ({SYMBOL_ROWS}) q")
def source_nesting(spark, sf_dir):
    return sy.nesting(ex.symbols(analysed(spark, sf_dir))).select("path", "idx", "depth")


@query("source_merged", f"SELECT path, name, kind, CAST(depth AS INTEGER) AS depth, CAST(line AS BIGINT) AS line FROM ({SYMBOL_ROWS}) q WHERE path LIKE 'hs/%'")
def source_merged(spark, sf_dir):
    """The equations of a function, told one by one, become one symbol again."""
    files = sources(spark, sf_dir).where("path like 'hs/%'")
    found = F.regexp_extract_all("text", F.lit(r"(?m)^(?:data )?(\w+)(?= [^\n]*=)"), F.lit(1))
    lines = F.regexp_extract_all(F.regexp_replace("text", "(?m)^", "\u0001"), F.lit(r"\x01([^\n]*)"), F.lit(1))
    at = F.filter(F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit(" = ")), i + 1)), lambda i: i.isNotNull())
    each = files.select("path", F.posexplode(F.arrays_zip(found.alias("name"), at.alias("line"))).alias("idx", "s")).select("path", "idx", "s.name", "s.line")
    each = each.select("path", "idx", "name", F.when(F.startswith("name", F.lit("Tree")), "type").otherwise("function").alias("kind"), F.lit(0).alias("depth"), F.col("line").cast("long").alias("line"))
    return sy.merge_adjacent(each).select("path", "name", "kind", "depth", "line")


@query("source_languages", "SELECT replace(p, '%', k) AS path, l AS language FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS p, CAST({k} AS VARCHAR) AS k, {'NULL' if n == 'none' else _literal('typescript' if n == 'ts' else n)} AS l FROM {t}" for n, (t, k, p, _) in FILES.items()) + ") q UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{ {'ts': 'typescript', 'rs': 'rust', 'py': 'python'}[p.rpartition('.')[2]] }')" for p, _ in SINGLE) + ") v")
def source_languages(spark, sf_dir):
    return analysed(spark, sf_dir).select("path", "language")


_LISTED = " UNION ALL ".join([f"SELECT replace('{path}', '%', CAST({key} AS VARCHAR)) AS path, {'NULL' if n == 'none' else _literal(text)} AS text FROM {t}" for n, (t, key, path, text) in FILES.items()] + [f"SELECT '{p}', {_literal(text)}" for p, text in SINGLE])
#: Fixed value: between the sizes of the templates.
LIST_BYTES = 300


@query("source_from_list", f"WITH f AS ({_LISTED}), l AS (SELECT path, text FROM f UNION ALL SELECT path, text FROM f WHERE path LIKE 'crate/%' UNION ALL SELECT 'gone/' || n_nationkey || '.ts', '' FROM nation), t AS (SELECT path, CASE WHEN text IS NULL THEN 'unsupported' WHEN path LIKE 'gone/%' THEN 'missing' WHEN strlen(replace(text, '%', regexp_extract(path, '([0-9]+)[.][a-z]+$', 1))) > {LIST_BYTES} THEN 'oversize' ELSE 'scanned' END AS state FROM l) SELECT count(*) AS listed, count(*) FILTER (WHERE state = 'scanned') AS scanned, count(*) FILTER (WHERE state = 'unsupported') AS unsupported, count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state = 'oversize') AS oversize, count(DISTINCT path) FILTER (WHERE state = 'scanned') AS indexed FROM t")
def source_from_list(spark, sf_dir):
    """A list that names some files twice and some that are not there."""
    from ..operators.sweep import from_list

    f = sources(spark, sf_dir)
    gone = table(spark, sf_dir, "nation").select(F.concat(F.lit("gone/"), F.col("n_nationkey").cast("string"), F.lit(".ts")).alias("path"))
    listed = f.select("path").unionByName(f.where(F.startswith("path", F.lit("crate/"))).select("path")).unionByName(gone)
    return from_list(listed, f, sorted(ex.LANGUAGES), LIST_BYTES)[1]


@query("source_imports", f"SELECT path, specifier, kind, CAST(line AS BIGINT) AS line FROM ({IMPORT_ROWS}) q")
def source_imports(spark, sf_dir):
    return ex.imports(analysed(spark, sf_dir)).select("path", "specifier", "kind", "line")


EDGES = f"SELECT path AS src, dst, to_kind, CASE WHEN to_kind = 'unresolved' THEN 'not found' END AS reason, specifier, CAST(line AS BIGINT) AS line FROM ({IMPORT_ROWS}) q"


@query("source_edges", EDGES)
def source_edges(spark, sf_dir):
    return resolved(spark, sf_dir).select("src", "dst", "to_kind", "reason", "specifier", "line")


@query("source_edges_ordered", f"SELECT row_number() OVER (ORDER BY src, line, specifier) AS position, src, line, specifier, dst FROM ({EDGES}) e")
def source_edges_ordered(spark, sf_dir):
    return gr.in_order(resolved(spark, sf_dir)).select("position", "src", "line", "specifier", "dst")


@query("source_externals", f"SELECT dst AS package, count(*) AS imports, count(DISTINCT src) AS files FROM ({EDGES}) e WHERE to_kind = 'external' GROUP BY dst")
def source_externals(spark, sf_dir):
    return resolved(spark, sf_dir).where("to_kind = 'external'").groupBy(F.col("dst").alias("package")).agg(F.count("*").alias("imports"), F.count_distinct("src").alias("files"))


@query("source_rdeps", f"WITH e AS ({EDGES}), a AS (SELECT src, dst, 0 AS distance FROM e WHERE dst = 'lib/types.ts'), b AS (SELECT e.src, e.dst, 1 FROM e WHERE dst IN (SELECT src FROM a) AND dst <> 'lib/types.ts') SELECT src, dst, CAST(distance AS INTEGER) AS distance FROM (SELECT * FROM a UNION ALL SELECT * FROM b) q")
def source_rdeps(spark, sf_dir):
    edges = resolved(spark, sf_dir).where("to_kind = 'path'")
    return gr.rdeps(edges, ["lib/types.ts"], 2, max_result=None).select("src", "dst", "distance")


@query("source_importers", f"SELECT DISTINCT src FROM ({EDGES}) e WHERE dst = 'crate/src/shared.rs'")
def source_importers(spark, sf_dir):
    """Importers, verified: only one edge is known before, the other files that name the target are parsed and resolved anew."""
    files = sources(spark, sf_dir)
    known = spark.createDataFrame([("crate/src/lib.rs", "crate/src/shared.rs")], "src string, dst string")
    return rs.verified_importers(files, "crate/src/shared.rs", known, ALIASES)


_NAMED = " UNION ALL ".join([f"SELECT replace('{path}', '%', CAST({key} AS VARCHAR)) AS path FROM {t}" for t, key, path, text in FILES.values() if "shared" in text] + [f"SELECT '{p}'" for p, text in SINGLE if "shared" in text and p not in ("crate/src/lib.rs", "crate/src/shared.rs")])


@query("source_importers_bounded", f"WITH e AS ({EDGES}), c AS (SELECT path, row_number() OVER (ORDER BY path) AS r FROM ({_NAMED}) n) SELECT src AS path, specifier, line, 'Exact' AS guarantee, (SELECT count(*) > 60 FROM c) AS truncated FROM e WHERE dst = 'crate/src/shared.rs' AND (src = 'crate/src/lib.rs' OR src IN (SELECT path FROM c WHERE r <= 25)) UNION ALL SELECT path, NULL, NULL, 'Approximate', (SELECT count(*) > 60 FROM c) FROM c WHERE r > 25 AND r <= 60")
def source_importers_bounded(spark, sf_dir):
    """Sixty candidates at most, 25 of them parsed: the rest may import the target."""
    known = spark.createDataFrame([("crate/src/lib.rs", "crate/src/shared.rs", "shared", 1)], "src string, dst string, specifier string, line long")
    rows, more = rs.importers(sources(spark, sf_dir), "crate/src/shared.rs", known, ALIASES, 60, 25)
    return rows.withColumn("truncated", F.lit(more))


@query("source_upsert", f"WITH e AS ({EDGES}) SELECT src, dst, to_kind FROM e WHERE src NOT LIKE 'src/app/v%' AND src <> 'pkg/up.py' UNION ALL SELECT 'src/app/v' || n_nationkey || '.vue', 'src/app/shared.ts', 'path' FROM nation")
def source_upsert(spark, sf_dir):
    """The index after all Vue files changed and one file went."""
    files = sources(spark, sf_dir)
    fresh = files.where("path like 'src/app/v%'").select("path", F.lit('<script>import "./shared";</script>').alias("text"))
    new = rs.resolve(ex.imports(ex.analyses(fresh)), files.select("path"), ALIASES)
    gone = spark.createDataFrame([("pkg/up.py",)], "path string")
    return gr.replace_edges(resolved(spark, sf_dir), fresh.select("path").unionByName(gone), new).select("src", "dst", "to_kind")


MANIFESTS = {
    "libs/core/package.json": '{"name": "@own/core", "exports": {".": {"import": "./esm/main.ts", "require": "./cjs/main.cjs"}, "./parts/*": "./esm/parts/*.ts", "./secret": null}, "imports": {"#env": {"browser": "./esm/web.ts", "default": "./esm/node.ts"}, "#dep": "left-pad/x"}}',
    "libs/plain/package.json": '{"name": "plain", "main": "lib/start.js"}',
}
CONFIGS = {"tsconfig.json": '{"extends": ["./conf/base"], /* no paths of its own */ "compilerOptions": {}}', "conf/base.json": '{"compilerOptions": {"baseUrl": "..", "paths": {"~/*": ["apps/*"]}}}'}
PACKAGE_FILES = ["apps/b.ts", "libs/core/esm/main.ts", "libs/core/cjs/main.cjs", "libs/core/esm/parts/one.ts", "libs/core/esm/web.ts", "libs/core/esm/node.ts", "libs/plain/lib/start.js", "libs/plain/extra.js"]
USER = 'import "@own/core";\nconst c = require("@own/core");\nimport "@own/core/parts/one";\nimport "@own/core/secret";\nimport "@own/core/none%";\nimport "plain";\nimport "plain/extra.js";\nimport "~/b";\nimport "other/x";\n'
MEMBER = 'import "#env";\nimport "#dep";\nimport "#gone";\n'
#: Of the two texts: line, target, kind of the target.
PACKAGE_EDGES = [
    ("apps/a%.ts", 1, "libs/core/esm/main.ts", "path"),
    ("apps/a%.ts", 2, "libs/core/cjs/main.cjs", "path"),
    ("apps/a%.ts", 3, "libs/core/esm/parts/one.ts", "path"),
    ("apps/a%.ts", 4, "@own/core/secret", "unresolved"),
    ("apps/a%.ts", 5, "@own/core/none%", "unresolved"),
    ("apps/a%.ts", 6, "libs/plain/lib/start.js", "path"),
    ("apps/a%.ts", 7, "libs/plain/extra.js", "path"),
    ("apps/a%.ts", 8, "apps/b.ts", "path"),
    ("apps/a%.ts", 9, "other", "external"),
    ("libs/core/esm/use%.ts", 1, "libs/core/esm/node.ts", "path"),
    ("libs/core/esm/use%.ts", 2, "left-pad", "external"),
    ("libs/core/esm/use%.ts", 3, "#gone", "unresolved"),
]


@query("source_packages", "SELECT replace(p, '%', CAST(s_suppkey AS VARCHAR)) AS src, CAST(line AS BIGINT) AS line, replace(d, '%', CAST(s_suppkey AS VARCHAR)) AS dst, to_kind FROM supplier, (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in PACKAGE_EDGES) + ") AS v(p, line, d, to_kind)")
def source_packages(spark, sf_dir):
    """Imports of the tree's own packages, by their exports and conditions, and through a project file that extends another."""
    keys = table(spark, sf_dir, "supplier")
    texts = [keys.select(_filled(p, "s_suppkey").alias("path"), _filled(t, "s_suppkey").alias("text")) for p, t in (("apps/a%.ts", USER), ("libs/core/esm/use%.ts", MEMBER))]
    found = texts[0].unionByName(texts[1])
    names = found.select("path").unionByName(spark.createDataFrame([(p,) for p in PACKAGE_FILES], "path string"))
    aliases, _ = rs.inherited_paths(CONFIGS, "tsconfig.json")
    return rs.resolve(ex.imports(ex.analyses(found)), names, aliases, rs.packages(MANIFESTS)).select("src", "line", "dst", "to_kind")


@query("source_guarantee", f"WITH e AS ({EDGES}), v AS (SELECT src, dst FROM e WHERE src = 'src/app/c1.ts' AND to_kind = 'path'), o AS (SELECT count(*) AS escaped FROM e WHERE to_kind = 'path' AND src IN (SELECT 'src/app/c1.ts' UNION SELECT dst FROM v WHERE dst <> 'lib/types.ts') AND dst = 'lib/types.ts') SELECT CASE WHEN escaped = 0 THEN 'Exact' ELSE 'Approximate' END AS guarantee, CAST(3 AS BIGINT) AS visited, escaped FROM o")
def source_guarantee(spark, sf_dir):
    """What an answer about dependencies is worth where some lead out of the view."""
    edges = resolved(spark, sf_dir)
    view = explicit(spark, ["src/app/c1.ts", "src/app/shared.ts", "lib/util.ts"])
    flags = {c: F.lit(c != "has_opaque") for c in ("indexed", "has_opaque", "imports_supported", "imports_complete", "resolver_live", "resolution_complete")}
    return gr.deps_guarantee(edges, sources(spark, sf_dir).select("path").withColumns(flags), ["src/app/c1.ts"], 2, view)


#: Whether the imports of a template's files are all known, stated by hand: Rust is resolved in part, the last three and the unknown are not read.
EXACT = {"ts": "n <= 5", "rust": "false", "python": "n <= 5", "vue": "n <= 5", "haskell": "false", "markdown": "false", "lua": "false", "none": "false"}
IMPORTS_OF = {"ts": 5, "python": 5, "vue": 1}


@query("source_exactness", "SELECT path, exact FROM (" + " UNION ALL ".join([f"SELECT replace('{path}', '%', CAST({key} AS VARCHAR)) AS path, {EXACT[n].replace('n ', str(IMPORTS_OF.get(n, 0)) + ' ')} AS exact FROM {t}" for n, (t, key, path, _) in FILES.items()] + [f"SELECT '{p}', {'false' if p.endswith('.rs') else 'true'}" for p, _ in SINGLE] + ["SELECT 'src/app/o' || n_nationkey || '.ts', false FROM nation", "SELECT 'src/app/m' || r_regionkey || '.ts', false FROM region"]) + ") q")
def source_exactness(spark, sf_dir):
    """Which files' imports are complete and right, by what the analysis found: five imports are resolved of each file at most; some files
    import by expressions, some have six imports."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    opaque = n.select(F.concat(F.lit("src/app/o"), F.col("n_nationkey").cast("string"), F.lit(".ts")).alias("path"), F.lit('const a = require("./" + name);\n').alias("text"))
    many = r.select(F.concat(F.lit("src/app/m"), F.col("r_regionkey").cast("string"), F.lit(".ts")).alias("path"), F.lit("".join(f'import "./x{k}";\n' for k in range(6))).alias("text"))
    files_ = sources(spark, sf_dir).unionByName(opaque).unionByName(many)
    return gr.node_flags(ex.analyses(files_), 5).select("path", gr.forward_exact().alias("exact"))


@query("source_view", f"WITH e AS ({EDGES}) SELECT src, dst, CAST(0 AS INTEGER) AS distance FROM e WHERE src = 'src/app/shared.ts' OR src = 'src/app/c1.ts' AND (dst IN ('src/app/shared.ts', 'lib/util.ts') OR to_kind <> 'path')")
def source_view(spark, sf_dir):
    """Dependencies seen through an explicit list of files."""
    view = explicit(spark, ["./src/app/c1.ts", "src/app/../app/shared.ts", "src/app/shared.ts", "lib/util.ts"])
    return gr.deps(resolved(spark, sf_dir), ["src/app/c1.ts", "src/app/shared.ts"], 1, view).select("src", "dst", "distance")


#: A folder is written from regions and nations: hidden names, rules of two ignore files, a folder that they drop.
TREE = """WITH f AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.txt' AS p, n_name AS t FROM nation UNION ALL SELECT 'r' || r_regionkey || '/.hidden', r_name FROM region UNION ALL SELECT 'r' || r_regionkey || '/skip/x.log', r_name FROM region
UNION ALL SELECT 'r' || r_regionkey || '/keep.log', r_name FROM region UNION ALL SELECT '.ignore', '*.log' || chr(10) || '!keep.log' || chr(10) || 'r1/n*' || chr(10)), k AS (SELECT * FROM f WHERE NOT (p LIKE '%/skip/x.log' OR p LIKE 'r1/n%'))"""


def written_tree(spark, sf_dir) -> str:
    """Root of the written folder, which the driver and the executors share."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    at = lambda df, key, tail, text: df.select(F.concat(F.lit("r"), F.col(key).cast("string"), tail).alias("path"), F.col(text).alias("content"))
    rows = at(n, "n_regionkey", F.concat(F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit(".txt")), "n_name")
    for tail in ("/.hidden", "/skip/x.log", "/keep.log"):
        rows = rows.unionByName(at(r, "r_regionkey", F.lit(tail), "r_name"))
    root = fresh_path(spark, "tree").removeprefix("file://")
    sink.commit(rows.unionByName(spark.createDataFrame([(".ignore", "*.log\n!keep.log\nr1/n*\n")], "path string, content string")), root)
    return root


@query("tree_entries", TREE + " SELECT p AS rel_path, 'file' AS kind, regexp_matches(p, '(^|/)[.]') AS is_hidden, CAST(strlen(t) AS BIGINT) AS size FROM k UNION ALL SELECT 'r' || r_regionkey, 'dir', false, 0 FROM region UNION ALL SELECT 'r' || r_regionkey || '/skip', 'dir', false, 0 FROM region")
def tree_entries(spark, sf_dir):
    return tree(spark, written_tree(spark, sf_dir)).select("rel_path", "kind", "is_hidden", "size")


@query("tree_visible", TREE + " SELECT p AS rel_path, t AS text, false AS is_binary, true AS valid_utf8 FROM f WHERE NOT regexp_matches(p, '(^|/)[.]')")
def tree_visible(spark, sf_dir):
    """Without hidden files, ignore rules not respected, contents read."""
    return files(spark, written_tree(spark, sf_dir), hidden=False, respectIgnore=False).select(F.col("path").alias("rel_path"), "text", "is_binary", "valid_utf8")


@query("tree_grep", TREE + " SELECT p AS path, t AS text FROM k WHERE contains(t, 'ICA')")
def tree_grep(spark, sf_dir):
    return Search(files(spark, written_tree(spark, sf_dir)), "ICA").content().select("path", "text")


@query("tree_pruned", TREE + " SELECT p AS rel_path, t AS text FROM f WHERE p LIKE 'r1/%' AND NOT regexp_matches(p, '(^|/)[.]') AND strlen(t) > 5")
def tree_pruned(spark, sf_dir):
    """One folder's visible files of some size; the listing is given the filters."""
    wanted = F.startswith("rel_path", F.lit("r1/")) & ~F.col("is_hidden") & (F.col("size") > 5)
    return files(spark, written_tree(spark, sf_dir), wanted, respectIgnore=False).select(F.col("path").alias("rel_path"), "text")


@query("tree_walk", TREE + """, d AS (SELECT 'r' || r_regionkey AS p FROM region), x AS (SELECT p AS rel_path, 'file' AS kind, CAST(strlen(t) AS BIGINT) AS size FROM k UNION ALL SELECT p || t, 'dir', 0 FROM d, (VALUES (''), ('/skip'), ('/up'), ('/peer')) v(t))
SELECT *, CAST(1 + len(rel_path) - len(replace(rel_path, '/', '')) AS INTEGER) AS level FROM x""")
def tree_walk(spark, sf_dir):
    """Links followed: each folder has one to the root and one to its neighbour, which are listed and lead nowhere new."""
    root = written_tree(spark, sf_dir)
    keys = [r[0] for r in table(spark, sf_dir, "region").select("r_regionkey").collect()]
    for k in keys:
        os.symlink("..", f"{root}/r{k}/up")
        os.symlink(f"../r{keys[(keys.index(k) + 1) % len(keys)]}", f"{root}/r{k}/peer")
    return walk(spark, root, follow_symlinks=True).select("rel_path", "kind", "size", "level")


@query("tree_written", TREE + " SELECT p AS path, CAST(strlen(t) AS BIGINT) AS bytes_written, true AS existed, t AS text FROM f WHERE p LIKE '%.txt'")
def tree_written(spark, sf_dir):
    """Files written anew over a written folder, with what the sink tells of them and what is read back."""
    root = written_tree(spark, sf_dir)
    again = files(spark, root, respectIgnore=False).where(F.endswith("path", F.lit(".txt"))).select("path", "content")
    told = sink.commit(again, root)
    return told.join(files(spark, root, respectIgnore=False).select("path", "text"), "path").select("path", "bytes_written", "existed", "text")


#: Edits of one file each: text, edits (old, new), then the new text or the kind and place of the error.
CASES = [
    ("batch", "alpha % beta\ngamma\n", [("alpha", "beta"), ("gamma", "delta %")], "beta % beta\ndelta %\n", None, None, False, 1),
    ("bom", "\ufeffone %\r\ntwo\r\n", [("one %\ntwo", "three\nfour")], "\ufeffthree\r\nfour\r\n", None, None, False, 1),
    ("normal", "keep “%”   \nsay “hi” — %  \nend ﬁne\n", [('say "hi" - %', "bye %")], "keep “%”   \nbye %\nend ﬁne\n", None, None, True, 2),
    ("blanks", "a  b %\n", [("  ", "_")], None, "empty", 0, None, None),
    ("missing", "a %\n", [("a", "b"), ("zzz", "y")], None, "noMatch", 1, None, None),
    ("twice", "a % a\n", [("a", "b")], None, "multipleMatches", 0, None, None),
    ("overlap", "abc%\n", [("ab", "x"), ("bc", "y")], None, "overlap", 1, None, None),
    ("same", "abc %\n", [("abc", "abc")], None, "noChange", None, None, None),
]


def cases(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    fill = lambda c: F.replace(F.col(c), F.lit("%"), F.col("k"))
    rows = keys.crossJoin(F.broadcast(spark.createDataFrame([(c[0], c[1]) for c in CASES], "name string, text string")))  # 8 rows
    corpus = rows.select(F.concat_ws("/", "name", "k").alias("path"), fill("text").alias("text"))
    edits = spark.createDataFrame([(c[0], i, *e) for c in CASES for i, e in enumerate(c[2])], "name string, edit_index int, old string, new string")
    rows = keys.crossJoin(F.broadcast(edits))
    return corpus, rows.select(F.concat_ws("/", "name", "k").alias("path"), "edit_index", fill("old").alias("old_text"), fill("new").alias("new_text"))


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if not isinstance(v, str):
        return str(v)
    return " || ".join(f"chr({ord(x)})" if x in "\r\n\ufeff" else _literal(x) for x in re.split("([\r\n\ufeff])", v) if x) or "''"


CASE_SQL = "SELECT name || '/' || s_suppkey AS path, replace(content, '%', CAST(s_suppkey AS VARCHAR)) AS content, error_kind, CAST(edit_index AS INTEGER) AS edit_index, CAST(normalized AS BOOLEAN) AS normalized, CAST(first_changed_line AS INTEGER) AS first_changed_line, CAST(old_lines AS INTEGER) AS old_lines, CAST(new_lines AS INTEGER) AS new_lines FROM supplier, (VALUES " + ", ".join("(" + ", ".join(map(_sql, (c[0], *c[3:], c[1].count("\n") + 1, None if c[3] is None else c[3].count("\n") + 1))) + ")" for c in CASES) + ") AS c(name, content, error_kind, edit_index, normalized, first_changed_line, old_lines, new_lines)"


@query("edit_cases", CASE_SQL)
def edit_cases(spark, sf_dir):
    corpus, edits = cases(spark, sf_dir)
    return ed.edit_batch(corpus, edits).select("path", "content", "error_kind", "edit_index", "normalized", "first_changed_line", "old_lines", "new_lines")


HUNKS = """SELECT 'h/' || s_suppkey AS path, CAST(hunk AS INTEGER) AS hunk, CAST(row AS INTEGER) AS row, op, CAST(old_line AS INTEGER) AS old_line, CAST(new_line AS INTEGER) AS new_line, replace(text, '%', CAST(s_suppkey AS VARCHAR)) AS text
FROM supplier, (VALUES (0, 0, 'equal', 1, 1, 'l1'), (0, 1, 'delete', 2, NULL, 'old %'), (0, 2, 'insert', NULL, 2, 'new %'), (0, 3, 'insert', NULL, 3, 'more'), (0, 4, 'equal', 3, 4, 'l3'), (1, 0, 'equal', 7, 8, 'l7'), (1, 1, 'delete', 8, NULL, 'gone'), (1, 2, 'equal', 9, 9, 'l9')) AS v(hunk, row, op, old_line, new_line, text)"""


@query("edit_hunks", HUNKS)
def edit_hunks(spark, sf_dir):
    """Differences with one line of context, in two groups."""
    text = "l1\nold %\nl3\nl4\nl5\nl6\nl7\ngone\nl9"
    keys = table(spark, sf_dir, "supplier")
    corpus = keys.select(F.concat(F.lit("h/"), F.col("s_suppkey").cast("string")).alias("path"), _filled(text, "s_suppkey").alias("text"), _filled("old %", "s_suppkey").alias("old"), _filled("new %\nmore", "s_suppkey").alias("new"))
    edits = corpus.select("path", F.lit(0).alias("edit_index"), F.col("old").alias("old_text"), F.col("new").alias("new_text")).unionByName(corpus.select("path", F.lit(1).alias("edit_index"), F.lit("gone\n").alias("old_text"), F.lit("").alias("new_text")))
    rows = ed.edit_batch(corpus.select("path", "text"), edits, diff_context=1).select("path", F.posexplode("hunks").alias("hunk", "h"))
    return rows.select("path", "hunk", F.posexplode("h").alias("row", "r")).select("path", "hunk", "row", "r.op", "r.old_line", "r.new_line", "r.text")
