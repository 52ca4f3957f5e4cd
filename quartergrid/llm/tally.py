"""Counts that a task gathers in bounded memory before it hands them on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


class Tally:
    """Adds up rows of counts by an integer key; gives them out once ``most`` keys are held."""

    def __init__(self, width: int = 1, most: int = 500_000) -> None:
        self.width, self.most, self.held = width, most, 0
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take ``counts`` (one row of ``width`` numbers per key)."""
        self.keys.append(keys)
        self.counts.append(counts.reshape(len(keys), self.width))
        self.held += len(keys)
        if self.held > 2 * self.most:
            found, summed = self._merged()
            if len(found) > self.most:
                yield found, summed
                self.keys, self.counts, self.held = [], [], 0
            else:
                self.keys, self.counts, self.held = [found], [summed], len(found)

    def finish(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            yield self._merged()

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        return summed_by(np.concatenate(self.keys), np.concatenate(self.counts))


def summed_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their rows of counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts[order], first, axis=0) if len(keys) else counts


def as_batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array(values) for name, values in columns.items()})
