"""Token counts of every prefix of a text, by dynamic programming over its words.

For each text a table holds the number of tokens of every prefix (in code points), as differences of one byte each, so that budget
and truncation questions (`budgets`, `truncated`, `tokens_upto`) are sums over that column and never encode again. The
number that the whole text has is the last of them.

The encoding of a prefix is that of the words before plus that of a part of a word. Within a word the counts follow from each other:
of the byte pair encodings of all prefixes only the last token is kept, and the last token of s[:i] is the one vocabulary entry t
that ends there and is *compatible* with the last token before it (the pair a, t is what encoding the string a + t gives). A sequence
of tokens is an encoding exactly if all its neighbours are compatible, since a merge across a boundary would show in that pair
alone. So a word of m bytes takes m steps of at most as many look-ups as the longest token has bytes; pairs are tried with the
library's model once and remembered, and so are the prefixes of short words. The end of a word, which the vocabulary marks, is one more step.

What surrounds a word is the library's: normal form C, blanks, lower case, the splits between letters, digits, signs and contractions,
and strings of special tokens. Plain words in letters below U+0250 with a tail of signs take a short way; all other pieces go
through `_Exact`, character by character, where the tail since the last character that nothing can combine with is normalised
again for each prefix, and a contraction or a special string counts as what the library makes of it as far as it is there.

Defined cases: a null text is the empty text, which has no prefix and no token; repeated rows give a row each; a null id stays null;
an empty table gives none; other columns, whatever their names, are ignored. A run of k combining marks takes k * k steps.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, release
from .tokens import CACHE_PIECES, LONG_PIECE, _byte_letters

#: Words that a worker remembers, and compatible pairs; each memory is emptied when full.
CACHE_WORDS, CACHE_PAIRS = 700_000, 1_000_000

_PLAIN = re.compile(r"([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]+)([!-/:-@\[-^`{-~]*)")
#: What the vocabulary's pre-tokenizer takes as contractions, after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class WordPrefixes:
    """steps(text) -> differences of the token counts of all prefixes of a text, by code point, for vocabularies that mark the end
    of words, drop white space and lower the case."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tok = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        self.mark = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ended_model, self.open_model = self.tok.model, BPE(vocab=model["vocab"], merges=merges)
        # Only what encodes to itself is ever a token of an encoding.
        names = [t for t in model["vocab"] if [x.value for x in (self.ended_model if t.endswith(self.mark) else self.open_model).tokenize(t.removesuffix(self.mark))] == [t]]
        self.names = {k: t for k, t in enumerate(names)}
        self.mids = {t: k for k, t in self.names.items() if not t.endswith(self.mark)}
        self.ends = {t.removesuffix(self.mark): k for k, t in self.names.items() if t.endswith(self.mark)}
        self.most = max(map(len, self.ends | self.mids))
        self.finder = _finder(self.mids, self.ends)
        self.letters = _byte_letters()
        self.bytes_ = [self._byte(b) for b in range(256)]
        special = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.special]
        self.special = re.compile("(" + "|".join(sorted(map(re.escape, special), key=len, reverse=True)) + ")") if special else None
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | list[int]] = {}
        self.kinds: dict[str, str] = {}

    @staticmethod
    def _byte(b: int) -> str:
        """The letter of a byte in byte-level vocabularies: itself if it is shown, else the next free one from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return chr(b) if b in shown else chr(256 + [x for x in range(256) if x not in shown].index(b))

    def _fits(self, a: int, t: int) -> bool:
        """Whether token t may follow token a within a word."""
        fits = self.pairs.get(a << 20 | t)
        if fits is None:
            first, second = self.names[a], self.names[t]
            model = self.ended_model if second.endswith(self.mark) else self.open_model
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            fits = [x.value for x in model.tokenize(first + second.removesuffix(self.mark))] == [first, second]
            self.pairs[a << 20 | t] = fits
        return fits

    def word(self, s: str) -> list[int]:
        """Token counts of s[:0], s[:1], s[:2], ... as words, s in the letters of bytes."""
        m, pairs, done, told = len(s), self.pairs, 0, 0
        last, counts, ended = [0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
        for end, (mid, fin, n) in self.finder.iter(s):
            j = end + 1 - n
            if end == done and mid >= 0:  # else its token is found
                if not j or (fits if (fits := pairs.get(last[j] << 20 | mid)) is not None else self._fits(last[j], mid)):
                    done = end + 1
                    last[done], counts[done] = mid, counts[j] + 1
            if end == told and fin >= 0:
                if not j or (fits if (fits := pairs.get(last[j] << 20 | fin)) is not None else self._fits(last[j], fin)):
                    told = end + 1
                    ended[told] = counts[j] + 1
        if done != m or told != m:
            raise ValueError(f"no token ends at {min(done, told) + 1} of {s!r}")
        return ended

    def _word_steps(self, low: str) -> bytes:
        """Differences by code point of one pre-token in lower case."""
        got = self.words.get(low)
        if got is None:
            if low.isascii():
                counts = self.word(low)
            else:
                counts = self.word(low.translate(self.letters))
                counts = [counts[at] for at in (0, *accumulate(len(c.encode()) for c in low))]
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            got = bytes([b - a & 255 for a, b in pairwise(counts)])  # two's complement: none is larger than the longest token
            if len(low) <= LONG_PIECE:
                self.words[low] = got
        return got

    def piece(self, piece: str) -> bytes | list[int]:
        """Differences for text without blanks, tabs and line ends: bytes of int8, or a list where one does not fit."""
        if not piece:
            return b""
        if m := _PLAIN.fullmatch(piece):
            return self._word_steps(m[1].lower()) + (self._word_steps(m[2]) if m[2] else b"")
        counts = _Exact(self).every(piece)
        steps = [b - a for a, b in zip([0, *counts], counts, strict=False)]
        return np.array(steps, np.int8).tobytes() if all(-128 <= x < 128 for x in steps) else steps

    def steps(self, text: str) -> np.ndarray:
        """Differences by code point: int8, or int32 where one does not fit."""
        if not self.special or not self.special.search(text):
            return self._plain(text)
        parts, out = self.special.split(text), []
        for k in range(0, len(parts), 2):
            own = self._plain(parts[k])
            out.append(own)
            if k + 1 < len(parts):
                # Until it is whole, the string is text like any other, and joins the piece before it.
                head = re.split(r"[ \n\t\r]", parts[k])[-1] + parts[k + 1][:-1]
                before = np.array([0, *_Exact(self).every(head)][-len(parts[k + 1]) :], np.int64)
                out.append(np.append(np.diff(before), before[0] + 1 - before[-1]))
        out = np.concatenate(out)
        return out.astype(np.int8 if not len(out) or (out.min() >= -128 and out.max() < 128) else np.int32)

    def _plain(self, text: str) -> np.ndarray:
        pieces, out = self.pieces, []
        for p in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            got = pieces.get(p)
            if got is None:
                got = self.piece(p)
                if len(p) <= LONG_PIECE:
                    if len(pieces) >= CACHE_PIECES:
                        pieces.clear()
                    pieces[p] = got
            out.append(got)
        if all(type(x) is bytes for x in out):
            return np.frombuffer(b"\0".join(out), np.int8)
        wide = [np.frombuffer(x, np.int8) if type(x) is bytes else np.array(x, np.int32) for x in out]
        return np.concatenate([y for x in wide for y in (np.zeros(1, np.int32), x)][1:]).astype(np.int32)

    def kind(self, c: str) -> str:
        """L, N, S (sign) or blank of a normalised character, as the library's pre-tokenizer has it."""
        if c not in self.kinds:
            split = lambda s: len(self.tok.pre_tokenizer.pre_tokenize_str(s))
            self.kinds[c] = " " if not split(c) else "N" if split(c + c) == 2 else "L" if split("a" + c) == 1 else "S"
        return self.kinds[c]

    def normal(self, s: str) -> str:
        return self.tok.normalizer.normalize_str(s)


def _finder(mids: dict[str, int], ends: dict[str, int]):
    """An automaton that gives (end, (id within a word, id at its end, length)) of every token in a string, the longest of an end first;
    -1 where there is no such token."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for t in mids | ends:
        out.add_word(t, (mids.get(t, -1), ends.get(t, -1), len(t)))
    out.make_automaton()
    return out


_seconds: set[str] = set()


def _joins(c: str) -> bool:
    """Whether normal form C may join a character with what stands before it; characters unknown here are taken to."""
    if not _seconds:
        for x in map(chr, range(0x110000)):
            two = unicodedata.decomposition(x).split()
            if len(two) == 2 and not two[0].startswith("<"):
                _seconds.add(chr(int(two[1], 16)))
    return bool(unicodedata.combining(c)) or c in _seconds or "ᅠ" <= c <= "ᇿ" or unicodedata.category(c) == "Cn"


class _Exact:
    """Counts of every prefix of any piece without special strings, character by character."""

    def __init__(self, owner: WordPrefixes):
        self.o = owner
        self.closed = 0  # tokens of the pre-tokens that are finished
        self.kind = ""  # of the open pre-token: L, S or none
        self.text: list[str] = []  # its bytes' letters, and for each of its ends the last token and the counts
        self.last, self.mid, self.ended = [0], [0], [0]
        self.before = None  # (closed tokens before, letters) of a contraction that is not complete

    def _open(self, kind: str) -> None:
        self.closed += self.ended[-1]
        self.kind, self.text, self.last, self.mid, self.ended = kind, [], [0], [0], [0]

    def _letter(self, x: str) -> None:
        """One more byte of the open pre-token. Only as many bytes as the longest token has are looked at."""
        o = self.o
        self.text.append(x)
        i, s = len(self.text), "".join(self.text[-o.most :])
        t, j = self._ending(s, i, o.mids)
        _, k = self._ending(s, i, o.ends)
        self.last.append(t)
        self.mid.append(self.mid[j] + 1)
        self.ended.append(self.mid[k] + 1)

    def _ending(self, s: str, i: int, tokens: dict[str, int]) -> tuple[int, int]:
        """(last token, its start) of the encoding that ends at i, s being the text up to there as far as it matters."""
        for n in range(len(s), 0, -1):
            t = tokens.get(s[len(s) - n :])
            if t is not None and (n == i or self.o._fits(self.last[i - n], t)):
                return t, i - n
        raise ValueError(f"no token ends at {i} of ...{s!r}")

    def char(self, c: str) -> None:
        """Take in one normalised character."""
        o, kind = self.o, self.o.kind(c)
        if kind == " ":
            self.before = None
            return self._open("")
        if self.before is not None or (self.kind == "S" and self.text == ["'"]):
            base, had = self.before if self.before is not None else (self.closed, "")
            whole = had + c
            if whole in CONTRACTIONS:
                self.before = None
                self.closed, self.ended = base, [0]
                self._open("")
                self.closed += o.word("'" + whole)[-1]
                return None
            self.before = (base, whole) if not had and any(x.startswith(whole) for x in CONTRACTIONS) else None
        if kind != self.kind or kind == "N":
            self._open(kind)
        for b in c.encode():
            self._letter(o.bytes_[b])
        return None

    def now(self) -> int:
        return self.closed + self.ended[-1]

    def _mark(self) -> tuple:
        return self.closed, self.kind, len(self.text), self.text, self.last, self.mid, self.ended, self.before

    def _back(self, mark: tuple) -> None:
        self.closed, self.kind, n, self.text, self.last, self.mid, self.ended, self.before = mark
        del self.text[n:], self.last[n + 1 :], self.mid[n + 1 :], self.ended[n + 1 :]

    def _take(self, s: str) -> None:
        for c in self.o.normal(s):
            self.char(c)

    def _with(self, tail: str) -> int:
        """The count with ``tail`` added, which may still change."""
        mark = self._mark()
        self._take(tail)
        n = self.now()
        self._back(mark)
        return n

    def every(self, piece: str) -> list[int]:
        """The counts of all prefixes of a piece."""
        out, tail = [], ""
        for c in piece:
            if tail and not _joins(c):
                self._take(tail)
                tail = ""
            tail += c
            out.append(self._with(tail))
        return out


_counters: dict[str, WordPrefixes] = {}


def counter(path: str) -> WordPrefixes:
    """One counter per worker process and vocabulary."""
    if path not in _counters:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _counters[path] = WordPrefixes(path)
    return _counters[path]


TABLE = "doc_id long, n_bytes long, width int, steps binary"


def prefix_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write (doc_id, n_bytes, width, steps) of all texts to the shared folder: steps holds for every code point by how much it changes
    the number of tokens, as little-endian integers of ``width`` bytes."""
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def run(batches: Iterator) -> Iterator:
        count = counter(vocabulary)
        for b in batches:
            steps = [count.steps(t) for t in b["text"].to_pylist()]
            last = [pa.array([x.itemsize for x in steps], pa.int32()), pa.array([x.tobytes() for x in steps], pa.binary())]
            yield pa.record_batch([b["doc_id"], b["n_bytes"], *last], names=["doc_id", "n_bytes", "width", "steps"])
        release()

    path = fresh_path(spark, "prefixes")
    rows.mapInArrow(run, TABLE).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(TABLE).parquet(path)


def _counts(steps: bytes, width: int) -> np.ndarray:
    """Tokens of the prefixes of 1, 2, ... code points."""
    return np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64)


def _answers(table: DataFrame, ask, ddl: str) -> DataFrame:
    """One row per row of a prefix table: its other columns but the steps, and what ``ask(counts)`` gives."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "boolean": pa.bool_()}
    fields = [(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))]
    keep = ["doc_id", "n_bytes"]

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            rows = [ask(_counts(s, w)) for s, w in zip(b["steps"].to_pylist(), b["width"].to_pylist(), strict=True)]
            cols = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)]
            yield pa.record_batch([*[b[c] for c in keep], *cols], names=[*keep, *[n for n, _ in fields]])

    return table.select(*keep, "width", "steps").mapInArrow(run, f"doc_id long, n_bytes long, {ddl}")


def budgets(table: DataFrame, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fitting): tokens of the whole text, whether they are more than ``limit``, and the code points of
    the longest prefix of at most so many tokens."""

    def ask(counts):
        n = int(counts[-1]) if len(counts) else 0
        fits = np.flatnonzero(counts <= limit)
        return n, n > limit, int(fits[-1]) + 1 if len(fits) else 0

    return _answers(table, ask, "n_tokens long, over_limit boolean, fitting long")


def tokens_upto(table: DataFrame, places: str = "places") -> DataFrame:
    """A row's column ``places`` (array of code points) told as tokens of the prefixes that end there; a place beyond the text is its end."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            out = []
            for s, w, at in zip(b["steps"].to_pylist(), b["width"].to_pylist(), b[places].to_pylist(), strict=True):
                counts = np.concatenate(([0], _counts(s, w)))
                out.append(None if at is None else [None if a is None else int(counts[max(0, min(a, len(counts) - 1))]) for a in at])
            yield pa.record_batch([b["doc_id"], b[places], pa.array(out, pa.list_(pa.int64()))], names=["doc_id", places, "tokens"])

    kind = dict(table.dtypes)[places]
    return table.select("doc_id", places, "width", "steps").mapInArrow(run, f"doc_id long, `{places}` {kind}, tokens array<bigint>")


def truncated(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_tokens): each text cut to its longest prefix of at most ``limit`` tokens, in one pass over the texts."""
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        count = counter(vocabulary)
        for b in batches:
            cut, n = [], []
            for t in b["text"].to_pylist():
                counts = np.concatenate(([0], np.cumsum(count.steps(t), dtype=np.int64)))
                at = int(np.flatnonzero(counts <= limit)[-1])
                cut.append(t[:at])
                n.append(int(counts[at]))
            yield pa.record_batch([b["doc_id"], pa.array(cut, pa.string()), pa.array(n, pa.int64())], names=["doc_id", "text", "n_tokens"])
        release()

    return rows.mapInArrow(run, "doc_id long, text string, n_tokens long")


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """`budgets` of all documents, answered from their written prefix table."""
    return budgets(prefix_table(docs, vocabulary), limit)
