"""Symbols and imports of source texts: a registry of extractors, one per language, run by `mapInArrow`.

An extractor is ``text -> (symbols, imports, opaque)``: symbols (name, kind, name_start, def_start, def_end) and imports
(specifier, kind, start, end) in character offsets; opaque says that something is imported that cannot be read off the text.
Comments and strings never give either. A language without an extractor is unsupported, never empty. New ones are registered with
`register`, the last registration for an extension wins.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator
from functools import cache

from pyspark.sql import DataFrame

from ..batches import pieces

Symbol = tuple[str, str, int, int, int]
Import = tuple[str, str, int, int]
Extractor = Callable[[str], tuple[list[Symbol], list[Import], bool]]

LANGUAGES: dict[str, str] = {}
EXTRACTORS: dict[str, Extractor] = {}
#: Of two symbols on one name the kind of the lower number stays.
SPECIFIC = {"method": 0, "function": 1, "constructor": 1, "class": 2, "struct": 2, "interface": 2, "enum": 2, "trait": 2, "type": 3, "module": 4, "constant": 5, "field": 6}
PER_FILE = 10_000


def register(language: str, extensions: tuple[str, ...], extractor: Extractor | None) -> None:
    for e in extensions:
        LANGUAGES[e] = language
    if extractor:
        EXTRACTORS[language] = extractor


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rpartition("/")[2].rpartition(".")[2]) if "." in path else None


def mask(text: str, line: tuple[str, ...] = ("//",), block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "\"'`", nested: bool = False, keep_strings: bool = False) -> str:
    """The text with comments (and strings, unless kept) blanked; line ends and all offsets stay."""
    starts, ends, marks = _scanners(line, block, quotes)
    out, last, k, n = [], 0, 0, len(text)

    def blank(a: int, b: int) -> None:
        nonlocal last
        out.append(text[last:a])
        out.append(_NOT_FEED.sub(" ", text[a:b]))
        last = min(b, n)

    while k < n and (m := starts.search(text, k)):
        k, what = m.start(), m.lastgroup
        if what == "line":
            e = text.find("\n", k)
            e = n if e < 0 else e
            blank(k, e)
            k = e
        elif what == "block":
            depth, e = 1, m.end()
            while e < n and depth:
                if nested:
                    m = marks.search(text, e)
                    e = m.end() if m else n
                    depth += 0 if m is None else 1 if m[0] == block[0] else -1
                else:
                    e = text.find(block[1], e)
                    depth, e = (1, n) if e < 0 else (0, e + len(block[1]))
            blank(k, e)
            k = e
        else:
            e = ends[m[0]].match(text, k + 1).end()
            if not keep_strings:
                blank(k + 1, e)
            k = e + 1
    out.append(text[last:])
    return "".join(out)


_NOT_FEED = re.compile(r"[^\n]")


@cache
def _scanners(line: tuple[str, ...], block: tuple[str, str] | None, quotes: str):
    """What starts a comment or a string; for each quote the rest of its string; both marks of a nested comment."""
    forms = {"line": "|".join(map(re.escape, line)), "block": re.escape(block[0]) if block else "", "quote": "|".join(map(re.escape, quotes))}
    starts = [f"(?P<{k}>{p})" for k, p in forms.items() if p]
    ends = {q: re.compile(r"(?:\\(?:[\s\S]|\Z)|[^\\%s])*" % (re.escape(q) + ("" if q == "`" else r"\n"))) for q in quotes}
    return re.compile("|".join(starts) or r"(?!)"), ends, block and re.compile("|".join(map(re.escape, block)))


_BRACES = re.compile("[{};]")


def _closing(text: str, at: int) -> int:
    """End of the braces that open at or after ``at`` (before a semicolon), else the end of the statement."""
    depth = 0
    for m in _BRACES.finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif depth == 0:
            return m.end()
    return len(text)


def _by_patterns(masked: str, patterns: list[tuple[str, str]]) -> list[Symbol]:
    out = []
    for kind, p in patterns:
        for m in re.finditer(p, masked, re.M):
            start = m.start("def") if "def" in m.groupdict() else m.start()
            out.append((m["name"], kind, m.start("name"), start, _closing(masked, m.end("name"))))
    return out


def python(text: str):
    starts = [0, *[m.end() for m in re.finditer("\n", text)]]
    raw = text.split("\n")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        m = mask(text, ("#",), None, "\"'")
        syms = [(x["name"], "class" if x["kw"] == "class" else "function", x.start("name"), x.start("kw"), x.end()) for x in re.finditer(r"^[ \t]*(?P<kw>class|def|async def)\s+(?P<name>\w+)", m, re.M)]
        imps = [(x[1], "import", x.start(1), x.end(1)) for x in re.finditer(r"^[ \t]*(?:import|from)\s+([\w.]+)", m, re.M)]
        return syms, imps, False
    at = lambda line, col: starts[line - 1] + len(raw[line - 1].encode()[:col].decode("utf-8", "ignore"))
    syms, imps, opaque = [], [], False

    def walk(node, inside: str) -> None:
        nonlocal opaque
        for c in ast.iter_child_nodes(node):
            if isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(c, ast.ClassDef) else "method" if inside == "class" else "function"
                begin = at(c.lineno, c.col_offset)
                syms.append((c.name, kind, text.find(c.name, begin + 3), begin, at(c.end_lineno, c.end_col_offset)))
                walk(c, kind if kind == "class" else "function")
                continue
            if inside == "module" and isinstance(c, ast.Assign | ast.AnnAssign):
                for t in c.targets if isinstance(c, ast.Assign) else [c.target]:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        begin = at(t.lineno, t.col_offset)
                        syms.append((t.id, "constant", begin, begin, at(c.end_lineno, c.end_col_offset)))
            if isinstance(c, ast.Import):
                imps.extend((a.name, "import", at(c.lineno, c.col_offset), at(c.end_lineno, c.end_col_offset)) for a in c.names)
            elif isinstance(c, ast.ImportFrom):
                imps.append(("." * c.level + (c.module or ""), "from", at(c.lineno, c.col_offset), at(c.end_lineno, c.end_col_offset)))
            elif isinstance(c, ast.Call) and getattr(c.func, "id", getattr(c.func, "attr", "")) in ("__import__", "import_module") and not (c.args and isinstance(c.args[0], ast.Constant)):
                opaque = True
            walk(c, inside)

    walk(tree, "module")
    return syms, imps, opaque


_JS = [
    ("class", r"(?P<def>\bclass)\s+(?P<name>[A-Za-z_$][\w$]*)"),
    ("function", r"(?P<def>\b(?:async\s+)?function\b\s*\*?)\s*(?P<name>[A-Za-z_$][\w$]*)"),
    ("function", r"(?P<def>\b(?:const|let|var))\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=;{]+)?=>|[A-Za-z_$][\w$]*\s*=>)"),
    ("method", r"^[ \t]+(?P<def>(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*)(?P<name>(?!(?:if|for|while|switch|catch|function|return|constructor)\b)[A-Za-z_$#][\w$]*)\s*\([^()]*\)\s*(?::\s*[\w<>\[\]| ]+)?\s*\{"),
]
_TS = [("interface", r"(?P<def>\binterface)\s+(?P<name>[A-Za-z_$][\w$]*)"), ("type", r"(?P<def>\btype)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*="), ("enum", r"(?P<def>\b(?:const\s+)?enum)\s+(?P<name>[A-Za-z_$][\w$]*)"), ("module", r"(?P<def>\bnamespace)\s+(?P<name>[A-Za-z_$][\w$.]*)")]


def javascript(text: str, patterns=None):
    masked = mask(text)
    syms = _by_patterns(masked, patterns or _JS)
    loose, imps, opaque = mask(text, keep_strings=True), [], False
    real = lambda at: masked[at] == loose[at]  # noqa: E731  outside strings
    forms = [
        ("static", r"\bimport\s+(?:type\s+)?(?:[\w$*{}\s,]+?\s+from\s*)?(?P<q>[\"'])(?P<s>(?:[^\"'\\\n])*)(?P=q)"),
        ("reexport", r"\bexport\s+(?:type\s+)?(?:\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s*(?P<q>[\"'])(?P<s>[^\"'\\\n]*)(?P=q)"),
        ("ts-require", r"\bimport\s+[\w$]+\s*=\s*require\s*\(\s*(?P<q>[\"'])(?P<s>[^\"'\\\n]*)(?P=q)\s*\)"),
        ("dynamic", r"\bimport\s*\(\s*(?P<q>[\"'])(?P<s>[^\"'\\\n]*)(?P=q)\s*[,)]"),
        ("require", r"(?<![\w$.])require\s*\(\s*(?P<q>[\"'])(?P<s>[^\"'\\\n]*)(?P=q)\s*\)"),
    ]
    taken = set()
    for kind, p in forms:
        for m in re.finditer(p, loose):
            if real(m.start()) and m.start("s") not in taken:
                taken.add(m.start("s"))
                imps.append((m["s"], kind, m.start("s"), m.end("s")))
    for m in re.finditer(r"(?:(?<![\w$.])require|\bimport)\s*\(\s*([^\s)])", loose):
        if real(m.start()) and not (m[1] in "\"'" and m.end() in taken):  # anything but one plain string
            opaque = True
    return syms, imps, opaque


def typescript(text: str):
    return javascript(text, _JS + _TS)


def vue(text: str):
    syms, imps, opaque = [], [], False
    for m in re.finditer(r"<script\b([^>]*)>(.*?)</script>", text, re.S | re.I):
        s, i, o = (typescript if re.search(r"lang=[\"']tsx?[\"']", m[1]) else javascript)(m[2])
        a = m.start(2)
        syms += [(n, k, x + a, y + a, z + a) for n, k, x, y, z in s]
        imps += [(n, k, x + a, y + a) for n, k, x, y in i]
        opaque |= o
    return syms, imps, opaque


def _use_leaves(tree: str) -> list[str]:
    """Leaves of a use tree: a::{b, c as d, self} -> a::b, a::c, a; globs stay."""
    tree = re.sub(r"\s+", " ", tree).strip()
    brace = tree.find("{")
    if brace < 0:
        leaf = re.sub(r"\s+as\s+\w+$", "", tree).strip()
        return [leaf.removesuffix("::self")] if leaf else []
    head, depth, last, parts = tree[:brace], 0, brace + 1, []
    for k in range(brace, len(tree)):
        depth += {"{": 1, "}": -1}.get(tree[k], 0)
        if depth == 1 and tree[k] == "," or depth == 0:
            parts.append(tree[last:k])
            last = k + 1
            if depth == 0:
                break
    return [head.removesuffix("::") if leaf == "self" else head + leaf for p in parts for leaf in _use_leaves(p)]


def rust(text: str):
    masked = mask(re.sub(r"'(?:\\.|[^\\'\n])'", lambda m: "' '" + " " * (len(m[0]) - 3), text), nested=True, quotes='"')
    vis = r"(?:pub(?:\([^)]*\))?\s+)?"
    syms = _by_patterns(masked, [(k, rf"(?:^|(?<=[{{;}}]))\s*(?P<def>{vis}(?:async\s+|unsafe\s+|const\s+)*{w})\s+(?P<name>\w+)") for k, w in (("function", "fn"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("type", "type"), ("module", "mod"))])
    syms += [(m["name"], "constant", m.start("name"), m.start("def"), _closing(masked, m.end())) for m in re.finditer(rf"^\s*(?P<def>{vis}(?:const|static)(?:\s+mut)?)\s+(?P<name>[A-Z_][A-Z0-9_]*)\s*:", masked, re.M)]
    bodies = [(m.end(), _closing(masked, m.start())) for m in re.finditer(r"^\s*(?:unsafe\s+)?(?:impl|(?:pub\s+)?trait)\b[^;{]*\{", masked, re.M)]
    syms = [(n, "method" if k == "function" and any(a <= x < b for a, b in bodies) else k, x, y, z) for n, k, x, y, z in syms]
    imps = []
    for m in re.finditer(rf"(?:^|(?<=[{{;}}]))\s*{vis}use\s+([^;]+);", masked, re.M):
        imps += [(leaf, "use", m.start(1), m.end(1)) for leaf in _use_leaves(m[1])]
    imps += [(m[1], "mod", m.start(1), m.end(1)) for m in re.finditer(rf"(?:^|(?<=[{{;}}]))\s*{vis}mod\s+(\w+)\s*;", masked, re.M)]
    return syms, imps, False


def _braced(patterns: list[tuple[str, str]], imports: str | None = None, line=("//",), block=("/*", "*/"), quotes="\"'`") -> Extractor:
    def run(text: str):
        masked = mask(text, line, block, quotes)
        loose = mask(text, line, block, quotes, keep_strings=True)
        imps = [(m[1], "import", m.start(1), m.end(1)) for m in re.finditer(imports, loose, re.M)] if imports else []
        return _by_patterns(masked, patterns), imps, False

    return run


_C = [("struct", r"(?P<def>\bstruct)\s+(?P<name>\w+)\s*\{"), ("enum", r"(?P<def>\benum)\s+(?:class\s+)?(?P<name>\w+)\s*\{"), ("function", r"^(?P<def>[A-Za-z_][\w\s*&:<>,]*?[\s*&])(?P<name>(?!(?:if|for|while|switch|return|sizeof)\b)[A-Za-z_]\w*)\s*\([^;{}()]*\)\s*(?:const\s*)?\{")]
_JAVA = [("class", r"(?P<def>\b(?:class|record))\s+(?P<name>\w+)"), ("interface", r"(?P<def>\binterface)\s+(?P<name>\w+)"), ("enum", r"(?P<def>\benum)\s+(?P<name>\w+)"), ("struct", r"(?P<def>\bstruct)\s+(?P<name>\w+)"), ("method", r"^[ \t]+(?P<def>(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|synchronized)\s+)*[\w<>\[\],.?]+\s+)(?P<name>(?!(?:if|for|while|switch|catch|return|new|else)\b)\w+)\s*\([^;{}()]*\)\s*(?:throws\s+[\w,. ]+)?\s*\{")]
_GO = [("method", r"^(?P<def>func)\s+\([^)]*\)\s*(?P<name>\w+)"), ("function", r"^(?P<def>func)\s+(?P<name>\w+)"), ("struct", r"^(?P<def>type)\s+(?P<name>\w+)\s+struct\b"), ("interface", r"^(?P<def>type)\s+(?P<name>\w+)\s+interface\b"), ("type", r"^(?P<def>type)\s+(?P<name>\w+)\s+(?!struct\b|interface\b)\S")]


def markdown(text: str):
    out, fence, pos = [], None, 0
    for line in text.split("\n"):
        m = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if m and (fence is None or line.strip().startswith(fence)):
            fence = None if fence else m[1]
        elif fence is None and (h := re.match(r" {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$", line)) and h[2]:
            out.append((h[2], len(h[1]), pos + h.start(2), pos))
        pos += len(line) + 1
    ends = [next((s for _, v, _, s in out[k + 1 :] if v <= level), len(text)) for k, (_, level, _, _) in enumerate(out)]
    return [(n, "module", a, s, e) for (n, _, a, s), e in zip(out, ends, strict=True)], [], False


def html(text: str):
    found = [(re.sub(r"<[^>]*>", "", m[2]).strip(), int(m[1]), m.start(2), m.start()) for m in re.finditer(r"<h([1-6])\b[^>]*>(.*?)</h\1>", text, re.S | re.I)]
    ends = [next((s for _, v, _, s in found[k + 1 :] if v <= level), len(text)) for k, (_, level, _, _) in enumerate(found)]
    links = [(m[2], "href", m.start(2), m.end(2)) for m in re.finditer(r"\b(?:href|src)\s*=\s*([\"'])(.*?)\1", text, re.S | re.I)]
    return [(n, "module", a, s, e) for (n, _, a, s), e in zip(found, ends, strict=True)], links, False


def bash(text: str):
    masked = mask(text, ("#",), None, "\"'")
    syms = _by_patterns(masked, [("function", r"^\s*(?P<def>)(?:function\s+)?(?P<name>[A-Za-z_][\w-]*)\s*\(\s*\)\s*\{"), ("function", r"^\s*(?P<def>function)\s+(?P<name>[A-Za-z_][\w-]*)\s*\{")])
    return syms, [(m[1], "source", m.start(1), m.end(1)) for m in re.finditer(r"^\s*(?:source|\.)\s+([^\s;&|]+)", masked, re.M)], False


def haskell(text: str):
    masked = mask(text, ("--",), ("{-", "-}"), '"', nested=True)
    syms = [(m[1], "function", m.start(1), m.start(), m.end()) for m in re.finditer(r"^((?!(?:data|newtype|type|class|instance|import|module|where|infix[lr]?)\b)[a-z_][\w']*)(?=[^:\n]*=)(?!\s*::).*$", masked, re.M)]
    syms += [(m[2], "type", m.start(2), m.start(), m.end()) for m in re.finditer(r"^(data|newtype|type|class)\s+(?:\([^)]*\)\s*=>\s*)?([A-Z]\w*)", masked, re.M)]
    return syms, [(m[1], "import", m.start(1), m.end(1)) for m in re.finditer(r"^import\s+(?:qualified\s+)?([\w.]+)", masked, re.M)], False


def lua(text: str):
    """Functions by their last name, methods (a:b) among them; bodies run to the line that closes them at the same indent."""
    code = re.sub(r"--\[(=*)\[.*?\]\1\]", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    masked, loose = mask(code, ("--",), None, "\"'"), mask(code, ("--",), None, "\"'", keep_strings=True)
    syms = []
    for m in re.finditer(r"^(?P<indent>[ \t]*)(?P<def>(?:local[ \t]+)?function[ \t]+)(?:[\w.]*(?P<sep>[.:]))?(?P<name>[A-Za-z_]\w*)[ \t]*\(|^(?P<indent2>[ \t]*)(?P<def2>(?:local[ \t]+)?)(?:[\w.]*\.)?(?P<name2>[A-Za-z_]\w*)[ \t]*=[ \t]*function\b", masked, re.M):
        which = "" if m["name"] else "2"
        feed = masked.find("\n", m.end())
        one = masked[m.end() : len(masked) if feed < 0 else feed]
        close = None if re.search(r"\bend\b", one) else re.compile(rf"^{m['indent' + which]}end\b", re.M).search(masked, m.end())
        end = close.end() if close else m.end() + len(one)
        syms.append((m["name" + which], "method" if m["sep"] == ":" else "function", m.start("name" + which), m.start("def" + which), end))
    imps = [(m["s"], "require", m.start("s"), m.end("s")) for m in re.finditer(r"(?<![\w.:])require\s*\(?\s*(?P<q>[\"'])(?P<s>[^\"'\\\n]*)(?P=q)", loose) if masked[m.start()] == loose[m.start()]]
    return syms, imps, bool(re.search(r"(?<![\w.:])require\s*\(\s*[^\s\"')]", masked))


_ZIG = [("function", r"(?P<def>\b(?:pub\s+)?(?:export\s+)?fn)\s+(?P<name>\w+)"), ("struct", r"(?P<def>\b(?:pub\s+)?const)\s+(?P<name>\w+)\s*=\s*(?:extern\s+|packed\s+)?struct\b"), ("enum", r"(?P<def>\b(?:pub\s+)?const)\s+(?P<name>\w+)\s*=\s*enum\b")]
_RUBY = [(k, rf"^\s*(?P<def>{w})\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!]?)") for k, w in (("method", "def"), ("class", "class"), ("module", "module"))]
_PHP = [("class", r"(?P<def>\bclass)\s+(?P<name>\w+)"), ("interface", r"(?P<def>\binterface)\s+(?P<name>\w+)"), ("trait", r"(?P<def>\btrait)\s+(?P<name>\w+)"), ("function", r"(?P<def>\bfunction)\s+&?(?P<name>\w+)")]

register("python", ("py", "pyi"), python)
register("javascript", ("js", "mjs", "cjs", "jsx"), javascript)
register("typescript", ("ts", "mts", "cts"), typescript)
register("tsx", ("tsx",), typescript)
register("vue", ("vue",), vue)
register("rust", ("rs",), rust)
register("go", ("go",), _braced(_GO, r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$'))
register("c", ("c", "h"), _braced(_C, r'^\s*#\s*include\s*[<"]([^>"\n]+)[>"]', quotes="\"'"))
register("cpp", ("cpp", "cc", "cxx", "hpp", "hh"), _braced([("class", r"(?P<def>\bclass)\s+(?P<name>\w+)\s*[:{]"), *_C], r'^\s*#\s*include\s*[<"]([^>"\n]+)[>"]', quotes="\"'"))
register("java", ("java",), _braced(_JAVA, r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"))
register("csharp", ("cs",), _braced(_JAVA, r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"))
register("kotlin", ("kt", "kts"), _braced([("function", r"(?P<def>\bfun)\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)"), ("class", r"(?P<def>\b(?:class|object))\s+(?P<name>\w+)"), ("interface", r"(?P<def>\binterface)\s+(?P<name>\w+)")], r"^\s*import\s+([\w.*]+)"))
register("swift", ("swift",), _braced([("function", r"(?P<def>\bfunc)\s+(?P<name>\w+)"), ("class", r"(?P<def>\bclass)\s+(?P<name>\w+)"), ("struct", r"(?P<def>\bstruct)\s+(?P<name>\w+)"), ("enum", r"(?P<def>\benum)\s+(?P<name>\w+)"), ("interface", r"(?P<def>\bprotocol)\s+(?P<name>\w+)")], r"^\s*import\s+(\w+)"))
register("php", ("php",), _braced(_PHP, r"^\s*use\s+([\w\\]+)\s*;"))
register("ruby", ("rb",), _braced(_RUBY, r"^\s*require(?:_relative)?\s+[\"']([^\"']+)[\"']", ("#",), None, "\"'"))
register("zig", ("zig",), _braced(_ZIG, r'@import\("([^"\n]+)"\)', ("//",), None, "\""))
register("haskell", ("hs", "lhs"), haskell)
register("lua", ("lua",), lua)
register("bash", ("sh", "bash", "zsh"), bash)
register("markdown", ("md", "markdown"), markdown)
register("html", ("html", "htm"), html)


def analyze(path: str, text: str):
    """(language, symbols, imports, opaque) of one file, or None if the language is unsupported. symbols: (idx, name, kind, line,
    column, depth, name_start, def_start, def_end); imports: (specifier, kind, line, start, end)."""
    language = language_of(path)
    if language not in EXTRACTORS:
        return None
    syms, imps, opaque = EXTRACTORS[language](text)
    best: dict[int, Symbol] = {}
    for s in syms:
        if s[2] not in best or (SPECIFIC.get(s[1], 9), s[4] - s[3]) < (SPECIFIC.get(best[s[2]][1], 9), best[s[2]][4] - best[s[2]][3]):
            best[s[2]] = s
    feeds = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect.bisect_left(feeds, at)
    out, ends = [], []
    for name, kind, at, start, end in sorted(best.values(), key=lambda s: (s[3], -s[4], s[2])):
        while ends and ends[-1] <= start:
            ends.pop()
        n = line(at)
        row = (name, kind, n + 1, at - (feeds[n - 1] + 1 if n else 0), len(ends), at, start, end)
        if not (language == "haskell" and out and out[-1][:2] == row[:2] and out[-1][4] == row[4]):
            out.append(row)
        ends.append(end)
    return language, [(k, *r) for k, r in enumerate(out[:PER_FILE])], [(s, k, line(a) + 1, a, b) for s, k, a, b in sorted(set(imps), key=lambda i: (i[2], i[0]))], opaque


ANALYSIS = "path string, language string, has_opaque boolean, symbols array<struct<idx:int,name:string,kind:string,line:long,column:long,depth:int,name_start:long,def_start:long,def_end:long>>, imports array<struct<specifier:string,kind:string,line:long,span_start:long,span_end:long>>"


def analyses(corpus: DataFrame) -> DataFrame:
    """One row per file (path, text): language (null if unsupported), has_opaque, symbols, imports. Explode what is needed."""
    import pyarrow as pa

    s = pa.struct([("idx", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int64()), ("column", pa.int64()), ("depth", pa.int32()), *[(n, pa.int64()) for n in ("name_start", "def_start", "def_end")]])
    i = pa.struct([("specifier", pa.string()), ("kind", pa.string()), ("line", pa.int64()), ("span_start", pa.int64()), ("span_end", pa.int64())])
    types = [pa.string(), pa.string(), pa.bool_(), pa.list_(s), pa.list_(i)]

    def run(batches: Iterator) -> Iterator:
        for b in pieces(batches):
            rows = []
            for path, text in zip(b["path"].to_pylist(), b["text"].to_pylist(), strict=True):
                got = analyze(path, text or "")
                if got is None:
                    rows.append((path, None, None, None, None))
                else:
                    rows.append((path, got[0], got[3], got[1], got[2]))
            cols = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["path", "language", "has_opaque", "symbols", "imports"])

    return corpus.select("path", "text").mapInArrow(run, ANALYSIS)


def symbols(analysed: DataFrame) -> DataFrame:
    return analysed.selectExpr("path", "inline(symbols)")


def imports(analysed: DataFrame) -> DataFrame:
    return analysed.selectExpr("path", "inline(imports)")
