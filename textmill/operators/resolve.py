"""Import resolution as joins: candidates of each import, in order of preference, against the table of files.

JavaScript and TypeScript: relative specifiers by extension and index probing, aliases of a project file (``paths``) and of those it
extends, exports and private names of the tree's own packages; other packages are external. Rust: crate, self, super, bare and mod paths, the deepest module file that exists; an unknown first segment is an
external crate. Other languages: relative paths and dotted modules.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..batches import pieces
from ..storage import materialize

#: Endings tried for a module path, in order.
ENDINGS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".vue"]


def stem(path: Column | str) -> Column:
    """What the candidates of a module path share: a path without an index name and one of the ENDINGS. A stem has at most
    1 + 2 * len(ENDINGS) paths, an import one or two stems for each path that it may mean."""
    return F.regexp_replace(path, rf"(?:/index)?(?:{'|'.join(map(re.escape, ENDINGS))})\z", "")


def stems(candidates: Column | str) -> Column:
    """The distinct stems of a list of candidates."""
    return F.array_distinct(F.transform(candidates, stem))


def strip_jsonc(text: str) -> str:
    """JSON with comments and trailing commas to JSON."""
    out, k = [], 0
    while k < len(text):
        if text[k] == '"':
            e = k + 1
            while e < len(text) and text[e] != '"':
                e += 2 if text[e] == "\\" else 1
            out.append(text[k : e + 1])
            k = e + 1
        elif text.startswith("//", k):
            k = text.find("\n", k) if "\n" in text[k:] else len(text)
        elif text.startswith("/*", k):
            e = text.find("*/", k + 2)
            k = len(text) if e < 0 else e + 2
        else:
            out.append(text[k])
            k += 1
    return re.sub(r",(\s*[}\]])", r"\1", "".join(out))


def _patterns(options: dict, folder: str) -> list[tuple[str, list[str]]]:
    base = posixpath.normpath(posixpath.join(folder, options.get("baseUrl", ".")))
    clean = lambda p: posixpath.normpath(posixpath.join(base, p)).removeprefix("./")
    return sorted(((k, [clean(t) for t in v]) for k, v in options.get("paths", {}).items()), key=lambda x: -len(x[0]))


def project_paths(config: str, folder: str = "") -> list[tuple[str, list[str]]]:
    """(pattern, targets) of a project file's compilerOptions.paths, relative to its baseUrl."""
    return _patterns(json.loads(strip_jsonc(config)).get("compilerOptions", {}), folder)


def inherited_paths(configs: dict[str, str], path: str) -> tuple[list[tuple[str, list[str]]], list[str]]:
    """(patterns as `project_paths` gives them, notes) of the project file ``path`` among ``configs`` (path to text), with all that it
    ``extends``: one file or a list, of which a later one wins; what the file says itself wins over both. ``paths`` and ``baseUrl`` are
    relative to the file that states them. Bases that are packages, missing or their own bases are noted and left out."""
    notes: list[str] = []

    def merged(at: str, above: tuple[str, ...]) -> dict:
        found = json.loads(strip_jsonc(configs[at]))
        bases, folder, out = found.get("extends", []), posixpath.dirname(at), {}
        for base in [bases] if isinstance(bases, str) else bases:
            if not base.startswith((".", "/")):
                notes.append(f"{at} extends the package {base}")
                continue
            to = posixpath.normpath(posixpath.join(folder, base)).removeprefix("/")
            to = next((t for t in (to, to + ".json", to + "/tsconfig.json") if t in configs), to)
            if to not in configs or to in (*above, at):
                notes.append(f"{at} extends {base}, which " + ("extends it" if to in configs else "is missing"))
            else:
                out |= merged(to, (*above, at))
        own = found.get("compilerOptions", {})
        if "baseUrl" in own:
            out["baseUrl"] = posixpath.normpath(posixpath.join(folder, own["baseUrl"]))
        if "paths" in own:
            out |= {"paths": own["paths"], "folder": folder}
        return out

    options = merged(path, ())
    base = options.get("baseUrl", options.get("folder", ""))
    return _patterns({"paths": options.get("paths", {})}, base), notes


#: Name, folder, ``exports`` and ``imports`` of a package of the tree.
Package = tuple[str, str, object, object]


def packages(manifests: dict[str, str]) -> list[Package]:
    """The packages of a tree from its manifests (path to text), the deepest folder first. Without ``exports`` every file may be
    imported, and the package itself is its ``module`` or ``main``."""
    out = []
    for path, text in manifests.items():
        m = json.loads(text)
        inside = "node_modules" in path.split("/")
        if m.get("name") and not inside or m.get("imports") and not inside:
            exports = m.get("exports")
            if exports is None:
                exports = {".": "./" + posixpath.normpath(m.get("module") or m.get("main") or "index"), "./*": "./*"}
            elif not isinstance(exports, dict) or not any(k.startswith(".") for k in exports):
                exports = {".": exports}
            out.append((m.get("name") or "", posixpath.dirname(path), exports, m.get("imports") or {}))
    return sorted(out, key=lambda p: (-len(p[1]), p[0]))


def _under(target: object, conditions: tuple[str, ...], inner: str) -> list[str]:
    """Paths that a target gives under some conditions: of an object the first key that holds, of a list all that give one."""
    if isinstance(target, str):
        return [target.replace("*", inner)]
    if isinstance(target, list):
        return [p for t in target for p in _under(t, conditions, inner)]
    for key, t in target.items() if isinstance(target, dict) else ():
        if key == "default" or key in conditions:
            found = _under(t, conditions, inner)
            if found or t is None:
                return found
    return []


def _mapped(table: dict, key: str, conditions: tuple[str, ...]) -> list[str]:
    """What a table of subpaths has for a key: the key itself, else the pattern with the longest head."""
    if key in table and "*" not in key:
        return _under(table[key], conditions, "")
    best = None
    for pattern in table:
        head, star, tail = pattern.partition("*")
        if star and key.startswith(head) and key.endswith(tail) and len(key) >= len(head) + len(tail) and (best is None or len(head) > len(best.partition("*")[0])):
            best = pattern
    if best is None:
        return []
    head, _, tail = best.partition("*")
    return _under(table[best], conditions, key[len(head) : len(key) - len(tail)])


def _packaged(path: str, specifier: str, kind: str, known: list[Package], conditions: tuple[str, ...]) -> tuple[list[str], str | None] | None:
    """(roots, external package) of an import of a package of the tree or of a private name (#...); None if it is neither."""
    held = ("require" if kind in ("require", "ts-require") else "import", *conditions)
    if specifier.startswith("#"):
        own = next((p for p in known if not p[1] or path.startswith(p[1] + "/")), None)
        found = _mapped(own[3], specifier, held) if own else []
        outside = next((f for f in found if not f.startswith(".")), None)
        return [posixpath.normpath(posixpath.join(own[1], f)) for f in found if f.startswith(".")], outside and _package_name(outside)
    for name, folder, exports, _ in known:
        if name and (specifier == name or specifier.startswith(name + "/")):
            return [posixpath.normpath(posixpath.join(folder, f)) for f in _mapped(exports, "." + specifier[len(name) :], held)], None
    return None


def _package_name(specifier: str) -> str:
    return "/".join(specifier.split("/")[: 2 if specifier.startswith("@") else 1])


def _js(path: str, specifier: str, aliases: list[tuple[str, list[str]]], kind: str = "static", known: list[Package] = (), conditions: tuple[str, ...] = ()) -> tuple[list[str], str | None]:
    """(candidates, external package) of one import."""
    roots = []
    if specifier.startswith("."):
        roots = [posixpath.normpath(posixpath.join(posixpath.dirname(path), specifier))]
    elif specifier.startswith("/"):
        roots = [specifier.lstrip("/")]
    else:
        for pattern, targets in aliases:
            head, star, tail = pattern.partition("*")
            if specifier == pattern or star and specifier.startswith(head) and specifier.endswith(tail) and len(specifier) >= len(head) + len(tail):
                inner = specifier[len(head) : len(specifier) - len(tail)] if star else ""
                roots = [t.replace("*", inner) for t in targets]
                break
        else:
            got = _packaged(path, specifier, kind, known, conditions)
            if got is None:
                return [], _package_name(specifier)
            if not got[0]:
                return got
            roots = got[0]
    out = []
    for r in roots:
        out.append(r)
        swap = re.sub(r"\.(c|m)?js(x?)$", r".\1ts\2", r)
        out += [swap] if swap != r else []
        out += [r + e for e in ENDINGS] + [f"{r}/index{e}" for e in ENDINGS]
    return out, None


def _rust(path: str, specifier: str, kind: str) -> tuple[list[str], str | None]:
    stem = re.sub(r"(/(mod|lib|main))?\.rs$", "", path)
    root = path[: path.find("src/") + 4] if "src/" in path else ""
    home = posixpath.dirname(path) if re.search(r"(^|/)(mod|lib|main)\.rs$", path) else stem
    segs = [s for s in specifier.split("::") if s and s != "*"]
    file = lambda base, parts: [posixpath.normpath(posixpath.join(base, *parts)) + e for e in (".rs", "/mod.rs")]
    if kind == "mod":
        return file(home, segs), None
    external = None
    if segs and segs[0] == "crate":
        base, segs = root, segs[1:]
        last = [root + "lib.rs", root + "main.rs"]
    elif segs and segs[0] in ("self", "super"):
        base = home
        while segs and segs[0] in ("self", "super"):
            base = posixpath.dirname(base) if segs[0] == "super" else base
            segs = segs[1:]
        last = [base + ".rs", base + "/mod.rs", base + "/lib.rs"]
    else:
        base, last, external = home, [], segs[0] if segs else None
    out = []
    for n in range(len(segs), 0, -1):
        out += file(base, segs[:n])
        if external and base != root.rstrip("/"):
            out += file(root, segs[:n])
    return out + last, external


def _other(path: str, specifier: str) -> tuple[list[str], str | None]:
    if re.match(r"[a-z]+://", specifier):
        return [], specifier.split("/")[2]
    if specifier.startswith("/"):
        return [specifier.lstrip("/")], None
    if re.match(r"\.*[\w.]+$", specifier) and path.endswith(".py"):
        dots = len(specifier) - len(specifier.lstrip("."))
        base = posixpath.dirname(path) if dots else ""
        for _ in range(max(0, dots - 1)):
            base = posixpath.dirname(base)
        mod = posixpath.join(base, *specifier.lstrip(".").split("."))
        return [mod + ".py", mod + "/__init__.py"], None if dots else specifier.split(".")[0]
    return [posixpath.normpath(posixpath.join(posixpath.dirname(path), specifier))], None


IMPORT = ["path", "specifier", "kind", "line", "span_start", "span_end"]
#: Copies of a result that many imports may share, so that no task gets all of these.
SALT = 16


def candidates(imports: DataFrame, aliases: list[tuple[str, list[str]]] = (), known: list[Package] = (), conditions: tuple[str, ...] = ()) -> DataFrame:
    """``imports`` with the paths that each may mean, in order of preference (``candidates``), and the package that it is else (``external``).
    They depend on the import alone, not on the files that there are. Row by row, without a shuffle."""
    import pyarrow as pa

    names = imports.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in imports.dtypes) + ", candidates array<string>, external string"
    aliases, known, conditions = list(aliases), list(known), tuple(conditions)

    def run(batches: Iterator) -> Iterator:
        for b in pieces(batches):
            got = []
            for path, spec, kind in zip(b["path"].to_pylist(), b["specifier"].to_pylist(), b["kind"].to_pylist(), strict=True):
                ext = path.rpartition(".")[2]
                got.append(_rust(path, spec, kind) if ext == "rs" else _js(path, spec, aliases, kind, known, conditions) if ext in ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "vue") else _other(path, spec))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.string())], names=[*names, "candidates", "external"])

    return imports.mapInArrow(run, schema)


def settled(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of imports with `candidates`: the first candidate among ``files`` (path), else the external package, else unresolved.

    Lists meet the files by `stem`, one row for all endings of a module. Imports that mean the same module have the same list, wherever they stand, so lists are resolved once each; the result is joined back
    by the list's digest and a salt, so that a module that all files import is no hot key, and the lists themselves are not shuffled again.
    All joins are by sorted shuffles: the files and the lists grow with the input, whatever the planner takes their size for."""
    rows = rows.withColumn("_list", F.when(F.size("candidates") > 0, F.md5(F.concat_ws("\0", "candidates")))).withColumn("_salt", F.pmod(F.xxhash64(*IMPORT), F.lit(SALT)).cast("int"))
    lists = rows.where("_list is not null").select("_list", "candidates").distinct()
    tried = lists.select("_list", "candidates", F.explode(stems("candidates")).alias("_stem"))
    found = tried.join(files.select(F.col("path").alias("dst"), stem("path").alias("_stem")).hint("merge"), "_stem")  # files that come twice change nothing
    found = found.select("_list", F.array_position("candidates", F.col("dst")).alias("rank"), "dst").where("rank > 0")
    best = found.groupBy("_list").agg(F.min(F.struct("rank", "dst")).alias("best"))
    salts = rows.where("_list is not null").select("_list", "_salt").distinct()  # those that occur: a list of one import has one
    best = salts.join(best.select("_list", F.col("best.dst").alias("dst")).hint("merge"), "_list")
    out = rows.drop("candidates").join(best.hint("merge"), ["_list", "_salt"], "left")
    kind = F.when(F.col("dst").isNotNull(), "path").when(F.col("external").isNotNull(), "external").otherwise("unresolved")
    return out.select(F.col("path").alias("src"), F.coalesce("dst", "external", "specifier").alias("dst"), kind.alias("to_kind"), F.when(kind == "unresolved", "not found").alias("reason"), "specifier", "kind", "line", "span_start", "span_end")


def resolve(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, list[str]]] = (), known: list[Package] = (), conditions: tuple[str, ...] = ()) -> DataFrame:
    """Edges (src, dst, to_kind, reason, specifier, kind, line, span_start, span_end): dst is a path, an external package, or the
    specifier itself if unresolved. ``files``: (path). ``known``: the tree's own `packages`, whose exports are read under the condition
    import or require, as the import is told, and under ``conditions``; what a package does not export is unresolved."""
    return settled(materialize(candidates(imports, aliases, known, conditions), "imports"), files)  # written: texts are parsed once


def importers_to_verify(files: DataFrame, target: str, known: DataFrame) -> DataFrame:
    """Files whose text names a target (its stem, or its folder for an index file) but that no known edge (src) covers: to be
    analysed again before an answer about importers is called exact."""
    stem = posixpath.splitext(posixpath.basename(target))[0]
    if stem in ("index", "mod", "__init__"):
        stem = posixpath.basename(posixpath.dirname(target)) or stem
    return files.where(F.contains("text", F.lit(stem)) & (F.col("path") != target)).join(known.select(F.col("src").alias("path")), "path", "left_anti")


def verified_importers(files: DataFrame, target: str, known: DataFrame, aliases: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """(src) of all importers of a target: those of ``known`` edges (src, dst) and, parsed and resolved anew, those among the files that name it."""
    from ..functions import extract

    own = known.where(F.col("dst") == target).select("src")
    todo = importers_to_verify(files, target, own)
    edges = resolve(extract.imports(extract.analyses(todo)), files.select("path"), aliases)
    return own.unionByName(edges.where((F.col("dst") == target) & (F.col("to_kind") == "path")).select("src")).distinct()


#: Files that an answer about importers looks at, and of these those that it parses anew.
MOST_CANDIDATES, MOST_PARSED = 1024, 256


def importers(files: DataFrame, target: str, known: DataFrame, aliases: list[tuple[str, list[str]]] = (), most_candidates: int = MOST_CANDIDATES, most_parsed: int = MOST_PARSED) -> tuple[DataFrame, bool]:
    """((path, specifier, line, guarantee) of a target's importers, whether there were more candidates than ``most_candidates``).

    Edges of ``known`` (src, dst, specifier, line) are Exact. Of the other files that name the target, in path order, the first ``most_parsed``
    are parsed and resolved anew: what they import is Exact, those that do not are left out, unless they import by expressions. Those, and
    the other candidates, may import it and are Approximate, without specifier and line."""
    from ..functions import extract

    own = known.where(F.col("dst") == target)
    todo = importers_to_verify(files, target, own)
    first = materialize(todo.select("path").distinct().orderBy("path").limit(most_candidates + 1), "candidates")
    ranked = materialize(first.withColumn("r", F.row_number().over(Window.orderBy("path"))), "ranked")  # most_candidates + 1 rows
    read = extract.analyses(files.join(F.broadcast(ranked.where(F.col("r") <= most_parsed)), "path"))  # most_parsed rows
    read = materialize(read.select("path", "language", "has_opaque", "imports"), "parsed")
    edges = resolve(extract.imports(read), files.select("path"), aliases).where((F.col("dst") == target) & (F.col("to_kind") == "path"))
    found = materialize(edges.select(F.col("src").alias("path"), "specifier", "line"), "found")
    exact = own.select(F.col("src").alias("path"), "specifier", F.col("line").cast("long").alias("line")).unionByName(found)
    open_ = read.where("language is null or has_opaque").select("path").join(found, "path", "left_anti")
    rest = ranked.where((F.col("r") > most_parsed) & (F.col("r") <= most_candidates)).select("path").union(open_)
    none = [F.lit(None).cast("string").alias("specifier"), F.lit(None).cast("long").alias("line")]
    rows = exact.withColumn("guarantee", F.lit("Exact")).unionByName(rest.select("path", *none, F.lit("Approximate").alias("guarantee")))
    return rows, ranked.count() > most_candidates
