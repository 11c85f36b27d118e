"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text that a worker holds as Python objects at once; longer texts come one at a time, whole.
SLICE_BYTES = 4 << 20


def without_gc(f: Callable) -> Callable:
    """Python's search for cycles walks every list and cached string again and again; f makes many and no cycles."""

    @functools.wraps(f)
    def run(*args):
        gc.disable()
        try:
            return f(*args)
        finally:
            gc.enable()

    return run


@functools.cache
def _malloc_trim() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def trim() -> None:
    """Gives freed memory back to the system, as a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    if f := _malloc_trim():
        f(0)


def sliced(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that each piece holds at most about `most` bytes of text."""
    for batch in batches:
        size = byte_lengths(batch.column(text))
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop
    trim()


def gathered(batches: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """As sliced(), with small pieces that follow each other taken together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in sliced(batches, text, most):
        n = batch.column(text).nbytes
        if held and size + n > most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def byte_lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, 0 for null."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def numbered(lists: Iterable[list]) -> tuple[list, np.ndarray, np.ndarray]:
    """The distinct items of all lists in order, the place among them of each item, and where each list ends.

    Each list is dropped before the next is made, while its items are at hand: all of them at once would be several times the text.
    """
    at: defaultdict = defaultdict(count().__next__)
    parts = [np.fromiter(map(at.__getitem__, own), np.int64, len(own)) for own in lists]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return list(at), np.concatenate(parts) if parts else np.zeros(0, np.int64), ends


class Recent:
    """A cache of bounded size: `new` takes entries until it holds `most`, then serves as `old` for as long again.

    Lookups in bulk go to `new`, after `missing` has said what to add.
    """

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys) -> list:
        """Of the distinct keys, those in neither part; those in `old` move to `new`."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for key in set(keys).difference(new):
            if key in old:
                new[key] = old[key]
            else:
                out.append(key)
        return out
