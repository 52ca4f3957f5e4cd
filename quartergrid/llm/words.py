"""Arrow helpers shared by the operators: bounded slices of a batch and its distinct words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the texts of ``column`` pass ``limit`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + limit, side="right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def give_back() -> None:
    """Return freed memory to the system; the driver and its workers live on after a fit or a task, and would keep it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the GNU C library has the call
        ctypes.CDLL(None).malloc_trim(0)


def factorize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Split at ASCII white space. Return a code per word, the words per text, and the distinct words.

    A text with outer white space also yields empty words; a null counts as an empty text.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(split).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return codes, counts, coded.dictionary


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[start:start + length]`` of all pairs."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return values[np.repeat(shift, lengths) + np.arange(total)]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum consecutive runs of ``counts`` values each; an empty run gives 0."""
    ends = np.concatenate([[0], np.cumsum(values)])
    stops = np.cumsum(counts)
    return ends[stops] - ends[stops - counts]


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal ``key``; one table is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key]
        starts = [0] + (np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))) + 1).tolist()
        if held and held[-1][key][-1].as_py() != keys[0].as_py():
            yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(starts, starts[1:]):
            yield pa.Table.from_batches([*held, batch.slice(start, end - start)])
            held = []
        held.append(batch.slice(starts[-1]))
    if held:
        yield pa.Table.from_batches(held)


def run_places(keys: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and the run of each row."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    new = np.ones(len(keys), bool)
    if len(keys) > 1:
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new), np.cumsum(new) - 1


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` in tables that hold all rows of their keys; about a batch is held besides the last run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(run_places(batch[key])[0][-1])
        if last or (held and held[-1][key][-1].as_py() != batch[key][0].as_py()):
            ready = [*held, batch.slice(0, last)] if last else held
            yield pa.Table.from_batches(ready)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)
