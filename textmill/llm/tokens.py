"""Tokenization with public vocabularies, shared by the record writer and the packer.

Ids are the tokenizers library's. A text is cut at places where no token and no pre-token can span (see
`PieceEncoder`); each distinct piece goes through the library once per worker and is then looked up, which is
faster than encoding whole texts and gives the same ids. Strings of special tokens in a text are what the library makes of
them: one special id each, unless ``special_as_text`` is set, which makes them ordinary text.
"""

from __future__ import annotations

import re
from array import array

#: Distinct pieces a worker remembers; the memory is emptied when full.
CACHE_PIECES = 350_000
#: Pieces longer than this are encoded, but not remembered.
LONG_PIECE = 100

_ODD = re.compile(r" (?!\S)")
_AT = re.compile(r" (?=\S)")
#: Letters below U+0250 (but the one whose lower case is two characters): in normal form C, with simple lower case.
_LETTERS = re.compile(r"[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]+")
_TAILED = re.compile(r"([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]+)([!-/:-@\[-^`{-~]+)")
_TWO_LINES = re.compile(r"([^\s']+)\n([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]+)([!-/:-@\[-^`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell the letters below U+0250, and their lower cases, in their own alphabet of 256 printable letters."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x2C70)}


class _Pieces(dict):
    """piece -> bytes of its ids; encodes what it does not hold."""

    def __init__(self, owner: PieceEncoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        ids = self.owner.learn(piece)
        if len(piece) <= LONG_PIECE and "\n" not in piece:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class PieceEncoder:
    """encode(text) -> bytes of little-endian ids of ``width`` bytes, equal to the library's ids.

    ``kind`` "byte": byte-level vocabularies that keep white space. The pre-tokenizer starts a new pre-token
    at each single blank that a non-space follows, so texts are cut there.
    ``kind`` "word": vocabularies that drop white space and lower the case; cut at blanks, tabs and line ends.
    Letters and a tail of ASCII symbols are always two pre-tokens, so they are looked up apart; plain letters go
    straight to the library's model. The library takes special tokens out of a text before anything else, so a text is first
    split at their strings; what lies between holds none, also once it is in lower case.
    """

    def __init__(self, path: str, kind: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        self.special = None if special_as_text or not special else re.compile("(" + "|".join(sorted(map(re.escape, special), key=len, reverse=True)) + ")")
        self.model = self.tok.model
        self.width = 2 if self.tok.get_vocab_size() <= 65536 else 4
        self.dtype, self.code = ("<u2", "H") if self.width == 2 else ("<u4", "I")
        self.special_ids = {s: i.to_bytes(self.width, "little") for s, i in special.items()}
        self.byte = kind == "byte"
        self.lead, self.model_lead = (" ", "Ġ") if self.byte else ("", "")
        self.letters = _byte_letters()
        self.pieces, self.tails = _Pieces(self), {"": b""}
        self.newline = self._ids("\n") if self.byte else b""

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, piece: str) -> bytes:
        if not piece:
            return self._ids(self.lead)
        if _LETTERS.fullmatch(piece):
            return self._model(self.model_lead, piece if self.byte else piece.lower())
        if m := _TAILED.fullmatch(piece):
            return self.pieces[m[1]] + self._tail(m[2])
        if self.byte and (m := _TWO_LINES.fullmatch(piece)):
            before, letters, tail = m.groups()
            return self.pieces[before] + self.newline + self._model("", letters) + self._tail(tail)
        return self._ids(self.lead + piece)

    def _model(self, lead: str, letters: str) -> bytes:
        spelled = lead + (letters if letters.isascii() else letters.translate(self.letters))
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {"": b""}
            self.tails[tail] = self._ids("a" + tail)[len(self._ids("a")) :]
        return self.tails[tail]

    def encode(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return b"".join(self.special_ids[x] if k % 2 else self._plain(x) for k, x in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.byte:
            parts = text.split(" ") if not _ODD.search(text) else _AT.split(text)
            return self._ids(parts[0]) + b"".join(map(self.pieces.__getitem__, parts[1:]))
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return b"".join(map(self.pieces.__getitem__, (text.lower() if text.isascii() else text).split(" ")))


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    if (path, kind) not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path, kind] = PieceEncoder(path, kind)
    return _encoders[path, kind]
