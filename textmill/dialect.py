"""Pattern dialects, compiled on the driver to Java regular expressions for `rlike`.

Regexes: look-around, back-references and possessive quantifiers are invalid input; classes are Unicode-aware, only
a line feed ends a line. They run on Java's engine, but for patterns whose quantifiers are nested so that backtracking may take
exponential time: those run on a linear one (`linear_regex`). Globs: two dialects, path search (``*`` stops at a slash) and line search (``*`` crosses slashes).
"""

from __future__ import annotations

import posixpath
import re

from .errors import invalid


def lexical(path: str) -> str:
    """A relative path without `.`, `..`, doubled and trailing slashes, by its text alone; the empty path is the root."""
    clean = posixpath.normpath(path.strip("/")) if path.strip("/") else ""
    if clean == ".." or clean.startswith("../"):
        raise invalid("outside the root", path=path)
    return "" if clean == "." else clean


def has_upper(pattern: str) -> bool:
    """Whether a pattern has an uppercase letter that is not part of an escape such as \\W or \\pL."""
    return any(c.isupper() for c in re.sub(r"\\[pP]\{[^}]*\}|\\[pP].|\\.", "", pattern))


def java_regex(pattern: str, case_insensitive: bool = False, smart_case: bool = False, fixed: bool = False, multiline: bool = False) -> str:
    """The pattern with the flags that make Java's engine agree with the line-search dialect."""
    if not fixed:
        if re.search(r"\(\?(?:=|!|<=|<!|>)", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k<)", pattern):
            raise invalid(f"look-around and back-references are not supported: {pattern!r}")
        if re.search(r"(?<!\\)(?:\\\\)*[*+?}]\+", pattern):
            raise invalid(f"possessive quantifiers are not supported: {pattern!r}")
        try:
            re.compile(re.sub(r"\\[pP](\{\^?\w+\}|\w)|\\z|\\x\{[0-9A-Fa-f]+\}", "x", pattern))
        except re.error as e:
            if "unknown extension" not in str(e) and "bad escape" not in str(e):
                raise invalid(f"bad pattern {pattern!r}: {e}") from None
    body = java_quote(pattern) if fixed else pattern.replace("(?P<", "(?<")
    fold = case_insensitive or smart_case and not has_upper(pattern)
    return f"(?d{'U' if not fixed else ''}{'iu' if fold else ''}{'sm' if multiline else ''}){body}"


def _parsed(pattern: str):
    """Python's parse of a pattern, its property classes taken as word characters; None if Python cannot parse it."""
    plain = re.sub(r"\\[pP](\{\^?\w+\}|\w)", r"\\w", pattern).replace("(?<", "(?P<").replace("\\z", "\\Z")
    try:
        return re._parser.parse(re.sub(r"\\x\{[0-9A-Fa-f]+\}", ".", plain))
    except (re.error, OverflowError, RecursionError):
        return None


def required_literal(pattern: str) -> str | None:
    """The longest string that a text must hold for the pattern to match anywhere in it; None if there is no such string, or if case
    may differ."""
    tree = _parsed(pattern)
    if tree is None or tree.state.flags & re.IGNORECASE:
        return None
    found, run = [], []

    def flush() -> None:
        found.append("".join(run))
        run.clear()

    def collect(items) -> None:
        for op, args in items:
            name = str(op)
            if name == "LITERAL":
                run.append(chr(args))
            elif name == "SUBPATTERN" and not args[1] and not args[2]:
                collect(args[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and args[0] >= 1:
                flush()
                collect(args[2])
                flush()
            elif name != "AT":
                flush()

    collect(tree)
    flush()
    best = max((x for x in found if "\n" not in x), key=len, default="")
    return best or None


def backtracks(pattern: str) -> bool:
    """Whether a backtracking engine may take exponential time: something is repeated without bound that itself repeats, or whose
    alternatives may start alike."""

    def risky(items, inside: bool) -> bool:
        for op, args in items:
            name = str(op)
            if name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, body = args
                if inside and high > max(1, low) or risky(body, inside or high > 64):
                    return True
            elif name == "BRANCH":
                heads = [str(b[0]) if len(b) else "" for b in args[1]]
                if inside and (len(set(heads)) < len(heads) or not all(h.startswith("(LITERAL") for h in heads)) or any(risky(b, inside) for b in args[1]):
                    return True
            elif name == "SUBPATTERN" and risky(args[3], inside):
                return True
        return False

    tree = _parsed(pattern)
    return tree is not None and risky(tree, False)


#: What the classes of the line-search dialect hold, in the syntax of RE2.
_CLASSES = {"d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{Nd}\p{Pc}", "s": r"\s\x{b}\x{85}\p{Z}"}


def linear_regex(pattern: str, fold: bool = False) -> str | None:
    """The pattern for Arrow's RE2, which matches in linear time; None where RE2 has no such pattern (word boundaries of all
    alphabets, set operations, negated classes within a class)."""
    out, k, depth = [], 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            e = pattern[k + 1]
            if e in "bB" or depth and e in "WSD":
                return None
            if e.lower() in _CLASSES:
                body = _CLASSES[e.lower()]
                out.append(body if depth else f"[{'^' if e.isupper() else ''}{body}]")
            else:
                out.append(c + e)
            k += 2
            continue
        if c == "[":
            if depth:
                return None
            depth = 1
            if m := re.match(r"\[\^?\]?", pattern[k:]):
                out.append(m[0])
                k += len(m[0])
                continue
        elif c == "]" and depth:
            depth = 0
        elif depth and pattern[k : k + 2] in ("&&", "--", "~~"):
            return None
        out.append("(?P<" if pattern.startswith("(?<", k) else c)
        k += 3 if pattern.startswith("(?<", k) else 1
    regex = ("(?i)" if fold else "") + "".join(out)
    import pyarrow as pa
    import pyarrow.compute as pc

    try:
        pc.match_substring_regex(pa.array([""]), regex)
    except pa.ArrowInvalid:
        return None
    return regex


def java_quote(text: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c.isspace() or c == "_") and ord(c) < 128 else c for c in text)


def _braces(glob: str) -> list[str]:
    """Alternatives of {a,b} groups, nested ones too."""
    depth, start = 0, -1
    for k, c in enumerate(glob):
        if c == "\\":
            continue
        if c == "{":
            if depth == 0:
                start = k
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                parts, level, last = [], 0, start + 1
                for j in range(start + 1, k):
                    level += {"{": 1, "}": -1}.get(glob[j], 0)
                    if glob[j] == "," and level == 0:
                        parts.append(glob[last:j])
                        last = j + 1
                parts.append(glob[last:k])
                return [x for p in parts for x in _braces(glob[:start] + p + glob[k + 1 :])]
    if depth:
        raise invalid(f"unclosed brace in glob {glob!r}")
    return [glob]


def glob_regex(glob: str, literal_separator: bool) -> str:
    """A whole-string Java regex. ``literal_separator``: ``*`` and ``?`` stop at slashes."""
    any_one = "[^/]" if literal_separator else "(?s:.)"
    out = []
    for g in _braces(glob):
        r, k = "", 0
        while k < len(g):
            c = g[k]
            if c == "*":
                n = len(re.match(r"\*+", g[k:])[0])
                before, after = k == 0 or g[k - 1] == "/", k + n == len(g) or g[k + n] == "/"
                if n == 2 and before and after:
                    if k + n == len(g):
                        r += "(?s:.*)"
                    else:
                        r += "(?:(?s:.*)/)?"
                        n += 1
                else:
                    r += any_one + "*"
                k += n
                continue
            if c == "?":
                r += any_one
            elif c == "[":
                end = g.find("]", k + 2 if g[k + 1 : k + 2] in ("!", "^", "]") else k + 1)
                if end < 0:
                    raise invalid(f"unclosed class in glob {glob!r}")
                body = g[k + 1 : end]
                neg = body[:1] in ("!", "^")
                body = body[1:] if neg else body
                r += "[" + ("^" if neg else "") + re.sub(r"([\[\]\\&^~])", r"\\\1", body) + "]"
                k = end
            elif c == "\\" and k + 1 < len(g):
                k += 1
                r += java_quote(g[k])
            else:
                r += java_quote(c)
            k += 1
        out.append(r)
    return "^(?:" + "|".join(out) + ")$"


def find_regex(pattern: str) -> tuple[str, bool] | None:
    """(regex, on the whole path rather than the name) of a path search; None for the empty pattern, which is all."""
    if not pattern:
        return None
    flags = "(?d)" if has_upper(pattern) else "(?diu)"
    if "/" not in pattern:
        return flags + glob_regex(pattern, True), False
    if not pattern.startswith(("/", "**/")):
        pattern = "**/" + pattern
    return flags + glob_regex(pattern, True), True


def ignore_rules(text: str) -> list[tuple[str, bool, bool]]:
    """(regex on the relative path, only directories, is an exception) of an ignore file; the last match decides."""
    rules = []
    for raw in text.splitlines():
        line = raw.rstrip("\r")
        if not line.endswith("\\ "):
            line = line.rstrip(" ")
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line.removeprefix("\\")
        only_dirs = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        rules.append((glob_regex(line if anchored else "**/" + line, True), only_dirs, keep))
    return rules


def ignored(rules: list[tuple[str, bool, bool]], rel_path: str, is_dir: bool) -> bool:
    """Whether rules drop a path or one of the folders above it."""
    parts = rel_path.split("/")
    for k in range(1, len(parts) + 1):
        sub, folder, state = "/".join(parts[:k]), is_dir or k < len(parts), False
        for regex, only_dirs, keep in rules:
            if (folder or not only_dirs) and re.match(regex, sub):
                state = not keep
        if state:
            return True
    return False
