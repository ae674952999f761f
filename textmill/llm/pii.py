"""Personal data: base patterns, high-recall candidate generators, boosted trees, calibrated thresholds, redaction.

Base spans (`base_spans`) are always reported. Generators propose further spans that the base patterns miss (spelled-out
mail addresses, phones without a plus sign, IPv6, account numbers, keys and passwords, ...), overlapping
as they come. Boosted trees score each from its format and from the words around it; a kind's threshold is the lowest
calibrated probability at which its precision reaches PRECISION. Of overlapping spans the base
spans win, then the more probable one. The trees are trained here, on generated examples (EXAMPLES of them, seeded),
so no real person's data is needed: six tenths for the trees, two for the calibration curve, two for the thresholds. The reported
`held_out` figures come from other templates, in other surroundings, which nothing is fitted on.

Places are code points, end exclusive. A null text is the empty text (no spans); repeated rows each get a row; null ids
stay null; an empty table gives no rows; other columns are ignored (`redacted` keeps them).
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release

#: Kinds in the order of reports; the first four have base patterns.
KINDS = ["email", "ip", "card", "phone", "secret", "account", "national_id"]
EXAMPLES = 12_000
PRECISION = 0.98

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_DIGITS = tuple("0123456789")
_DOT, _AT = r"(?:\(dot\)|\[dot\]|\{dot\}| dot |\.)", r"(?:\(at\)|\[at\]|\{at\}| at )"
_TIGHT, _LABEL = r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.)", r"[A-Za-z0-9][A-Za-z0-9-]*+"
#: Not before the rest of a longer domain.
_DONE = r"(?![\w-]|\.\w)"

#: High-recall generators: (kind, cues, pattern). A match holds one of its cues, and of kinds other than DIGITLESS an ASCII digit, so only
#: texts that do are searched: `candidates` gives what the bare patterns give. Addresses come with one loose dot (blanks around it) or
#: with all the tight ones that there are.
GENERATORS: list[tuple[str, tuple[str, ...], re.Pattern]] = [
    ("email", ("(at)", "[at]", " at ", "{at}"), re.compile(rf"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*+ ?{_AT} ?{_LABEL} ?{_DOT} ?[a-z]{{2,24}}{_DONE}")),
    ("email", ("(at)", "[at]", " at ", "{at}"), re.compile(rf"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*+ ?{_AT} ?{_LABEL}(?:{_TIGHT}{_LABEL})*{_TIGHT}[A-Za-z]{{2,24}}{_DONE}")),
    ("email", ("@",), re.compile(rf"(?<![\w.+-])[\w.+-]++ ?@ ?\w[\w-]*+ ?\. ?[a-z]{{2,24}}{_DONE}")),
    ("email", ("@",), re.compile(rf"(?<![\w.+-])[\w.+-]++ ?@ ?\w[\w-]*+(?:\.\w[\w-]*+)*\.[A-Za-z]{{2,24}}{_DONE}")),
    ("phone", _DIGITS, re.compile(r"(?<![\d+.])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ ./-][0-9]{3,4}(?![\d])")),
    ("phone", ("00",), re.compile(r"(?<![\d])00[1-9][0-9]{0,2}[ .-]?(?:[0-9][ .-]?){7,11}[0-9](?![\d])")),
    ("card", (".", "_", "/"), re.compile(r"(?<![\d])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{1,7}(?![\d])")),
    ("ip", ("::", ":"), re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){2,7}(?![\w:])")),
    ("secret", ("AKIA", "ASIA", "ghp_", "xoxb-", "sk-"), re.compile(r"(?<![\w-])(?:AKIA|ASIA|ghp_|xoxb-|sk-)[A-Za-z0-9_-]{14,}(?:\.+[A-Za-z0-9_-]+)*")),
    ("secret", ("=", ":"), re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_ -]?key|access[_ -]?key)[\"']? ?[=:] ?[\"']?(?=[^\s\"',;]{5,}?[^\s\"'.,;])[^\s\"'.,;]*(?:\.+[^\s\"'.,;]+)*[\"']?")),
    ("account", _DIGITS, re.compile(r"(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])")),
    ("national_id", ("-",), re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
]
DIGITLESS = ("email", "ip", "secret")
CUES: dict[str, tuple[str, ...]] = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "ping", "from"),
    "card": ("card", "visa", "credit", "payment", "charge"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "number"),
    "secret": ("password", "token", "secret", "key", "login"),
    "account": ("iban", "account", "bank", "transfer"),
    "national_id": ("ssn", "social", "security", "insurance"),
    "none": ("version", "order", "isbn", "page", "figure", "total", "score", "invoice", "date", "build", "part", "chapter", "tracking"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ outwards, in linear time."""
    done, p = 0, text.find("@")
    while p >= 0:
        s = p
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, p + 1) if s < p else None
        if m:
            yield s, m.end()
            done = m.end()
        else:
            done = max(done, p)
        p = text.find("@", max(done, p + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x) < 10 and int(x) <= 255 or int(x.lstrip("0")[:10] or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans of all generators, overlapping ones included."""
    digits = _DIGIT.search(text) is not None
    out = set()
    for kind, cues, pattern in GENERATORS:
        if (digits or kind in DIGITLESS) and any(c in text for c in cues):
            out.update((kind, m.start(), m.end()) for m in pattern.finditer(text))
    return sorted(out)


def features(text: str, kind: str, s: int, e: int) -> list[float]:
    """Format of the span and the words around it."""
    span, before, after = text[s:e], text[max(0, s - 40) : s].lower(), text[e : e + 24].lower()
    digits = [c for c in span if c.isdigit()]
    seps = [c for c in span if not c.isalnum()]
    counts = Counter(span)
    entropy = -sum(v / len(span) * math.log2(v / len(span)) for v in counts.values())
    groups = [len(g) for g in re.split(r"\D+", span) if g]
    letters = sum(c.isalpha() for c in span)
    d = "".join(digits)
    f = [len(span), len(d), len(d) / len(span), letters / len(span), len(seps), len(set(seps)), entropy, max(groups, default=0), min(groups, default=0), len(groups),
         float(luhn(d)) if d.isascii() and d else -1.0, sum(c.isupper() for c in span) / len(span), float(span[:1] in "([+"), float("@" in span), float("." in span), float(" " in span),
         float(bool(before[-1:].strip())), float(bool(after[:1].strip(" .,;\n"))), float(after[:1] in ".,;\n" or not after), len(counts) / len(span), float(d.startswith("000")), groups[0] if groups else 0, groups[-1] if groups else 0]
    f += [float(kind == k) for k in KINDS]
    f += [float(any(c in before or c in after for c in cues)) for cues in CUES.values()]
    return f


def _examples(n: int, seed: int, unseen: bool = False) -> Iterator[tuple[str, str, int, int, bool]]:
    """(text, kind, start, end, is personal) of generated candidates. ``unseen``: the templates that nothing is fitted on."""
    r = random.Random(seed)
    parts = ["an", "er", "in", "th", "on", "re", "la", "que", "ment", "sch", "ung", "ción", "os", "eau", "the", "of", "de", "und"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    grouped = lambda *sizes: r.choice(" -./").join(map(dig, sizes))
    alnum = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(k))

    def card(ok: bool) -> str:
        d = r.choice("3456") + dig(14)
        last = next(c for c in "0123456789" if luhn(d + c) == ok)
        sep = r.choice("._/")
        d += last if ok else r.choice([c for c in "0123456789" if not luhn(d + c)])
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    good = {
        "email": lambda: word() + r.choice([".", "", "_"]) + word() + r.choice([" (at) ", " [at] ", "(at)", "[at]", " at ", " @ "]) + "mail" + r.choice(["", "x", "1"]) + r.choice([" dot ", " [dot] ", "(dot)", "."]) + r.choice(["com", "org", "net", "de"]),
        "phone": lambda: r.choice([f"({dig(3)}) {dig(3)}{r.choice(' -./')}{dig(4)}", grouped(3, 3, 4), grouped(3, 3, 4), grouped(3, 4, 4), f"0049 {dig(3)} {dig(7)}", f"00{r.randint(1, 99)}{dig(10)}", f"00{r.randint(1, 99)} {dig(3)} {dig(3)} {dig(4)}"]),
        "card": lambda: card(True),
        "ip": lambda: ":".join(hexa(4) for _ in range(8)) if r.random() < 0.6 else f"fe80::{hexa(4)}:{hexa(4)}:{hexa(4)}:{hexa(4)}",
        "secret": lambda: r.choice([f"AKIA{alnum(16)}", f"password={hexa(18)}", f'token = "{hexa(40)}"', f"api_key: {hexa(32)}", f"secret={alnum(20)}", f"ghp_{hexa(36)}", f"pwd={word()}{dig(4)}!"]),
        "account": lambda: r.choice(["DE", "FR", "GB", "ES"]) + dig(2) + r.choice([" ", ""]).join(["", *[dig(4) for _ in range(4)]]) + dig(2),
        "national_id": lambda: f"{r.randint(100, 799)}-{r.randint(10, 99)}-{dig(4)}",
    }
    bad = {
        "email": lambda: r.choice([f"{word()} at {word()}. {word()}"[:60].replace(". ", ".", 1), f"looked at {word()} dot {r.choice(parts)[:4]}", f"met at {word()}.{r.choice(['the', 'and', 'then', 'it'])}"]),
        "phone": lambda: r.choice([f"20{dig(2)}-{dig(3)}-{dig(3)}", grouped(2, 4, 4), grouped(3, 3, 3), grouped(2, 3, 3), grouped(4, 4, 4), grouped(4, 3, 4), f"00{r.randint(1, 9)}{dig(r.choice([12, 13, 15]))}"]),
        "card": lambda: card(False),
        "ip": lambda: ":".join(dig(2) for _ in range(r.randint(3, 4))),
        "secret": lambda: r.choice([f"token: {word()}{word()}{word()}", f"password: {word()}{word()}{word()}", f"secret: {word()}{word()}{word()}", f"key: {word()}", f"sk-{word()}-{word()}-{word()}-{word()}-{word()}"]),
        "account": lambda: r.choice(["AB", "NR", "XY"]) + dig(2) + "".join(" " + r.choice([alnum(4), "PART", "UNIT", "TYPE"]) for _ in range(2)),
        "national_id": lambda: f"000-{dig(2)}-{dig(4)}",
    }
    if unseen:
        name = lambda: r.choice(["k", "m", "s", "t"]) + r.choice(["ova", "ilen", "urat", "ebbi", "ondo"])
        good = {
            "email": lambda: f"{name()}{dig(2)}{r.choice(['{at}', ' at ', '[at]'])}{name()}{r.choice(['[dot]', ' dot ', '.'])}{r.choice(['io', 'info', 'eu'])}",
            "phone": lambda: r.choice([f"{dig(3)}/{dig(3)}-{dig(4)}", f"({dig(3)}) {dig(3)} {dig(4)}", f"00{r.randint(30, 99)} {dig(2)} {dig(4)} {dig(4)}"]),
            "card": lambda: card(True),
            "ip": lambda: r.choice([f"2001:db8::{hexa(4)}:{hexa(4)}:{hexa(3)}", ":".join(hexa(4).upper() for _ in range(8))]),
            "secret": lambda: r.choice([f"ASIA{alnum(16)}", f"sk-{alnum(40)}", f"xoxb-{dig(12)}-{hexa(24)}", f"access_key={alnum(24)}", f"passwd: {hexa(12)}", f"API key: {alnum(30)}"]),
            "account": lambda: r.choice(["NL", "IT", "PT", "AT"]) + dig(2) + r.choice([" ", ""]).join(["", *[dig(4) for _ in range(r.randint(3, 5))]]),
            "national_id": lambda: f"{r.randint(100, 799)}-{dig(1)}{r.randint(1, 9)}-{dig(4)}",
        }
        bad = {
            "email": lambda: r.choice([f"{name()} at {name()}.{r.choice(['so', 'but', 'we'])}", f"stopped at {name()} dot {name()[:4]}"]),
            "phone": lambda: r.choice([f"19{dig(2)}-{dig(3)}-{dig(3)}", f"{dig(2)} {dig(3)} {dig(3)}", f"{dig(4)}/{dig(4)}/{dig(4)}", f"00{r.randint(1, 9)}{dig(14)}"]),
            "card": lambda: card(False),
            "ip": lambda: r.choice([f"{dig(2)}:{dig(2)}:{dig(2)}", f"{dig(1)}:{dig(2)}:{dig(3)}:{dig(2)}"]),
            "secret": lambda: r.choice([f"token: {name()}{name()}", f"secret: {name()}", f"password: {name()}{name()}"]),
            "account": lambda: r.choice(["QA", "ZZ"]) + dig(2) + "".join(" " + r.choice([alnum(4), "TEST", "CODE"]) for _ in range(2)),
            "national_id": lambda: f"000-{dig(2)}-{dig(4)}",
        }
        word = name
    made = 0
    while made < n:
        kind = r.choice(KINDS)
        personal = r.random() < 0.5
        cue = r.random()
        own, other = CUES[kind], CUES["none"]
        lead = r.choice(own if personal else other) if cue < 0.45 else (r.choice(other if personal else own) if cue < 0.5 else word())
        text = f"{word()} {word()} {lead}{r.choice([' ', ': ', ' is ', ' '])}" + (good if personal else bad)[kind]() + r.choice([" ", ". ", ", ", "\n"]) + f"{word()} {word()}"
        begin = len(text) - len(text.lstrip())
        for k, s, e in candidates(text):
            if k == kind and e - s >= 5 and s >= begin:
                yield text, k, s, e, personal
                made += 1
                break
        else:
            made += 0.1  # a made span that no generator proposes teaches nothing


class Scorer:
    """Trees, a calibration curve and a threshold per kind, trained on generated examples."""

    def __init__(self, examples: int = EXAMPLES, seed: int = 11, precision: float = PRECISION):
        import numpy as np

        from .boosting import Boosted, calibrated, isotonic

        rows = list(_examples(examples, seed))
        x = np.array([features(t, k, s, e) for t, k, s, e, _ in rows])
        y = np.array([float(p) for *_, p in rows])
        kinds = np.array([KINDS.index(k) for _, k, *_ in rows])
        turn = np.arange(len(rows)) % 10
        fit, curve, cuts = turn < 6, (turn == 6) | (turn == 7), turn > 7
        self.model = Boosted().fit(x[fit], y[fit])
        self.curve = isotonic(self.model.decision(x[curve]), y[curve])
        p, t, own = calibrated(self.model.decision(x[cuts]), self.curve), y[cuts], kinds[cuts]
        self.threshold = np.full(len(KINDS), 2.0)
        for k in range(len(KINDS)):
            for cut in np.unique(p[own == k]):
                if t[(own == k) & (p >= cut)].mean() >= precision:
                    self.threshold[k] = max(cut, 0.5)
                    break

    def held_out(self, examples: int = 3000, seed: int = 77) -> dict:
        """Precision and recall, in all and by kind, on examples of templates that nothing was fitted on."""
        import numpy as np

        rows = list(_examples(examples, seed, unseen=True))
        p = self.score([features(t, k, s, e) for t, k, s, e, _ in rows])
        kinds = np.array([KINDS.index(k) for _, k, *_ in rows])
        t, said = np.array([bool(r[4]) for r in rows]), p >= self.threshold[kinds]
        figures = lambda at: {"n": int(at.sum()), "precision": float(t[at & said].mean()) if (at & said).any() else 1.0, "recall": float(said[at & t].mean()) if (at & t).any() else 1.0}
        return {"all": figures(np.ones(len(rows), bool))} | {k: figures(kinds == j) for j, k in enumerate(KINDS)}

    def score(self, rows: list[list[float]]):
        import numpy as np

        from .boosting import calibrated

        return calibrated(self.model.decision(np.array(rows)), self.curve)


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint unions of spans, ascending."""
    starts, ends = [], []
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def found_spans(texts: list[str], scorer: Scorer) -> list[tuple[list, list]]:
    """For each text: (base spans, all spans), each by start and kind. One call of the trees for the whole batch."""
    base = [base_spans(t) for t in texts]
    cand = [[c for c in candidates(t) if c not in known] for t, known in zip(texts, map(set, base), strict=True)]
    flat = [features(t, *c) for t, cs in zip(texts, cand, strict=True) for c in cs]
    prob = iter(scorer.score(flat) if flat else ())
    place = lambda x: (x[1], KINDS.index(x[0]), x[2])
    out = []
    for b, cs in zip(base, cand, strict=True):
        scored = [(float(next(prob)), c) for c in cs]
        kept = list(b)
        starts, ends = _merged(b)
        for p, (kind, s, e) in sorted(scored, key=lambda x: (-x[0], place(x[1]))):
            k = bisect.bisect_left(starts, e)  # of the disjoint spans before it the last one ends last
            if p >= scorer.threshold[KINDS.index(kind)] and not (k and ends[k - 1] > s):
                kept.append((kind, s, e))
                starts.insert(k, s)
                ends.insert(k, e)
        out.append((sorted(b, key=place), sorted(kept, key=place)))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def report(docs: DataFrame, scorer: Scorer | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: base counts, digest of the base spans, all spans."""
    import pyarrow as pa

    scorer = scorer or Scorer()
    names = [x.split()[0] for x in REPORT.split(", ")]
    types = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            rows = []
            for doc_id, (base, every) in zip(b["doc_id"].to_pylist(), found_spans(b["text"].to_pylist(), scorer), strict=True):
                n = Counter(k for k, *_ in base)
                rows.append((doc_id, *(n[k] for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
        release()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, REPORT)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes the name of its first kind in angle brackets."""
    out, at, end = [], 0, -1
    for kind, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))):
        if s >= end:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = end = max(end, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, scorer: Scorer | None = None, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with all found spans masked in the text; null texts stay null; all other columns stay as they are.
    ``length_col``: a column that counts the text's characters and follows it."""
    import pyarrow as pa

    scorer = scorer or Scorer()
    names = docs.columns

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            texts = b.column(names.index(text_col)).to_pylist()
            spans = found_spans([t or "" for t in texts], scorer)
            new = [None if t is None else mask(t, every) if every else t for t, (_, every) in zip(texts, spans, strict=True)]
            k = names.index(text_col)
            yield pa.RecordBatch.from_arrays([pa.array(new, b.schema.field(k).type) if j == k else c for j, c in enumerate(b.columns)], schema=b.schema)
        release()

    bounded_batches(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    if length_col:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.char_length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out
