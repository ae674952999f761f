"""Arrow batches as Python workers take them: by pieces, so that a worker holds few rows as Python objects, whatever a batch has."""

from __future__ import annotations

from collections.abc import Iterator

#: Rows and bytes of a piece. A row of more bytes is a piece by itself.
PIECE_ROWS, PIECE_BYTES = 500, 4 << 20


def pieces(batches: Iterator, rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator:
    """The batches cut into slices of at most ``rows`` rows and, if there are more, of ``size`` bytes; empty batches stay."""
    for b in batches:
        todo = [b.slice(k, rows) for k in range(0, b.num_rows, rows)][::-1] or [b]
        while todo:
            p = todo.pop()
            if p.num_rows > 1 and p.nbytes > size:
                half = p.num_rows // 2
                todo += [p.slice(half), p.slice(0, half)]
            else:
                yield p
