"""Runs of equal tokens in sorted record batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], most: int | None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """(columns, large) of whole runs of ``names[0]``, by which the rows are sorted.

    A run's rows may come in several batches; they are held until the next run
    begins. Runs of more than ``most`` rows come apart, as large, in pieces.
    """
    def finished(rows: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], bool]]:
        token = rows[0]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(first, len(token)))
        large = np.repeat(size > (len(token) if most is None else most), size)
        if large.any():
            yield [r[large] for r in rows], True
        if not large.all():
            yield [r[~large] for r in rows], False

    held, passing = [], None  # rows of the last run; a run whose rows are being handed on
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy() for c in names]
        if passing is not None:
            more = int(np.searchsorted(rows[0], passing, side="right"))
            if more:
                yield [r[:more] for r in rows], True
            if more == len(rows[0]):
                continue
            rows, passing = [r[more:] for r in rows], None
        start = int(np.searchsorted(rows[0], rows[0][-1]))
        if held and held[0][0][0] != rows[0][-1] or not held and start:
            whole = [np.concatenate(x) for x in zip(*held, [r[:start] for r in rows])]
            yield from finished(whole)
            held = []
        held.append([r[start:] for r in rows])
        if most is not None and sum(len(h[0]) for h in held) > most:
            yield [np.concatenate(x) for x in zip(*held)], True
            held, passing = [], rows[0][-1]
    if held:
        yield from finished([np.concatenate(x) for x in zip(*held)])
