"""Text rewrites on one file's text: all edits match the original, all or nothing. Pure Python, called from Arrow batches.

If every target occurs as it is, edits are placed in the text. Else all are placed in a normalized form (NFKC, line ends
trimmed, quotes, dashes and blanks folded), and only the lines that an edit touches are rewritten. A byte-order mark and the
file's line ends (those of its first line) are kept.
"""

from __future__ import annotations

import difflib
import unicodedata
from dataclasses import dataclass

from ..errors import CorpusError, invalid

#: Edits of a file, bytes of all targets and replacements (and of a text that is not ASCII, in normal form), bytes
#: searched in all, lines of a difference, bytes of a result.
MOST_EDITS = 10_000
MOST_INPUT, MOST_WORK, MOST_LINES, MOST_RESULT = 8 << 20, 512 << 20, 1_000_000, 64 << 20
#: White space that line ends lose in the normalized form.
TRIM = "\t\n\x0b\x0c\r \xa0                　﻿"
#: Characters folded to their plain forms.
FOLD = {
    **dict.fromkeys(map(ord, "‘’‚‛"), "'"),
    **dict.fromkeys(map(ord, "“”„‟"), '"'),
    **dict.fromkeys(map(ord, "‐‑‒–—―−"), "-"),
    **dict.fromkeys(map(ord, "\xa0           　"), " "),
}


def normalize_line(line: str) -> str:
    return unicodedata.normalize("NFKC", line).rstrip(TRIM).translate(FOLD)


def normalize(text: str) -> str:
    return "\n".join(normalize_line(x) for x in text.split("\n"))


@dataclass
class Rewritten:
    content: str
    replacements: int
    normalized: bool


def _places(text: str, target: str) -> list[int]:
    out, at = [], text.find(target)
    while at >= 0:
        out.append(at)
        at = text.find(target, at + 1)
    return out


def _locate(text: str, edits: list[tuple[str, str]], whitespace_exact: bool) -> list[tuple[int, int, int]]:
    spans = []
    for k, (old, _) in enumerate(edits):
        if not old or not old.strip(TRIM) and not whitespace_exact:
            raise CorpusError("empty", "the target is empty or only white space", edit_index=k)
        at = _places(text, old)
        if not at:
            raise CorpusError("noMatch", "the target does not occur", edit_index=k)
        if len(at) > 1:
            raise CorpusError("multipleMatches", f"the target occurs {len(at)} times", edit_index=k)
        spans.append((at[0], at[0] + len(old), k))
    spans.sort()
    for (_, e, _), (s, _, k) in zip(spans, spans[1:], strict=False):
        if s < e:
            raise CorpusError("overlap", "two edits touch the same text", edit_index=k)
    return spans


def apply_edits(text: str, edits: list[tuple[str, str]], whitespace_exact: bool = False) -> Rewritten:
    """Raises CorpusError (noMatch, multipleMatches, overlap, empty, noChange, with edit_index)."""
    if not edits or len(edits) > MOST_EDITS:
        raise invalid(f"between 1 and {MOST_EDITS} edits")
    if sum(len(s.encode()) for e in edits for s in e) > MOST_INPUT:
        raise invalid(f"targets and replacements of more than {MOST_INPUT} bytes")
    size = len(text) if text.isascii() else len(text.encode())
    if not text.isascii() and size > MOST_INPUT:
        raise invalid(f"a text with other than ASCII characters of more than {MOST_INPUT} bytes")
    if len(edits) * size > MOST_WORK:
        raise invalid(f"edits that search more than {MOST_WORK} bytes")
    mark = "﻿" if text.startswith("﻿") else ""
    body = text[len(mark) :]
    first = body.find("\n")
    crlf = first > 0 and body[first - 1] == "\r"
    lf = lambda s: s.replace("\r\n", "\n").replace("\r", "\n")
    body, edits = lf(body), [(lf(a), lf(b)) for a, b in edits]
    exact = all(a in body for a, _ in edits if a)
    if exact:
        spans, new, at = _locate(body, edits, whitespace_exact), [], 0
        for s, e, k in spans:
            new += [body[at:s], edits[k][1]]
            at = e
        result = "".join(new) + body[at:]
    else:
        result = _in_normal_form(body, edits, whitespace_exact)
    if result == body:
        raise CorpusError("noChange", "the edits change nothing")
    return Rewritten(mark + (result.replace("\n", "\r\n") if crlf else result), len(edits), not exact)


def _in_normal_form(body: str, edits: list[tuple[str, str]], whitespace_exact: bool) -> str:
    lines = body.split("\n")
    normal = [normalize_line(x) for x in lines]
    text, starts, at = "\n".join(normal), [], 0
    for x in normal:
        starts.append(at)
        at += len(x) + 1
    targets = [(normalize(a), b) for a, b in edits]
    spans = _locate(text, targets, whitespace_exact)
    import bisect

    out, line = [], 0
    k = 0
    while k < len(spans):
        a, b = bisect.bisect_right(starts, spans[k][0]) - 1, bisect.bisect_left(starts, spans[k][1]) - 1
        group = [spans[k]]
        while k + 1 < len(spans) and bisect.bisect_right(starts, spans[k + 1][0]) - 1 <= b:
            k += 1
            group.append(spans[k])
            b = max(b, bisect.bisect_left(starts, spans[k][1]) - 1)
        out += lines[line:a]
        block, pos = "\n".join(normal[a : b + 1]), starts[a]
        piece, last = [], 0
        for s, e, n in group:
            piece += [block[last : s - pos], targets[n][1]]
            last = e - pos
        out.append("".join(piece) + block[last:])
        line, k = b + 1, k + 1
    return "\n".join(out + lines[line:])


def hunks(old: str, new: str, context: int = 4) -> list[list[tuple[str, int | None, int | None, str]]]:
    """Groups of (op, old line, new line, text), lines from 1, with ``context`` equal lines around changes."""
    a, b, out = old.split("\n"), new.split("\n"), []
    for group in difflib.SequenceMatcher(None, a, b, autojunk=False).get_grouped_opcodes(context):
        rows: list = []
        for op, i1, i2, j1, j2 in group:
            if op == "equal":
                rows += [("equal", i + 1, j1 + i - i1 + 1, a[i]) for i in range(i1, i2)]
            else:
                rows += [("delete", i + 1, None, a[i]) for i in range(i1, i2)]
                rows += [("insert", None, j + 1, b[j]) for j in range(j1, j2)]
        out.append(rows)
    return out


def check_result(old: str, new: str, copies_old: int, copies_new: int, lines: bool, most: int = MOST_RESULT) -> None:
    """Raises CorpusError where an answer would be too large: a difference's both texts and the copies asked for, or its lines."""
    a, b = len(old.encode()), len(new.encode())
    if a * (1 + copies_old) + b * (1 + copies_new) > most:
        raise invalid(f"a result of more than {most} bytes")
    if lines and max(old.count("\n"), new.count("\n")) >= MOST_LINES:
        raise invalid(f"a difference of more than {MOST_LINES} lines; skip it")


def first_changed_line(old: str, new: str) -> int | None:
    for k, (x, y) in enumerate(zip(old.split("\n"), new.split("\n"), strict=False)):
        if x != y:
            return k + 1
    n, m = old.count("\n"), new.count("\n")
    return None if n == m else min(n, m) + 2
