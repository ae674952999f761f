"""Errors of the text-corpus operators: a kind, a message, and where known the path and the index of an edit."""

from __future__ import annotations

KINDS = ("notFound", "invalidInput", "noMatch", "multipleMatches", "overlap", "noChange", "empty", "permission", "isDirectory", "io", "timeout", "indeterminate")


class CorpusError(Exception):
    def __init__(self, kind: str, message: str, path: str | None = None, edit_index: int | None = None):
        super().__init__(message)
        self.kind, self.path, self.edit_index = kind, path, edit_index


def invalid(message: str, **where) -> CorpusError:
    return CorpusError("invalidInput", message, **where)
