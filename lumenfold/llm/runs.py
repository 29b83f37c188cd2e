"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches, keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """The rows of each key in turn, as one table; batches are sorted by keys, which hold no
    nulls. A run of more than most rows comes in several tables."""
    held, size, last = [], 0, None
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        cut = np.zeros(len(batch) - 1, bool)
        for c in columns:
            cut |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(cut) + 1).tolist(), len(batch)]
        for a, b in zip(starts[:-1], starts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            last = key
            while a < b:
                n = b - a if most is None else min(b - a, most - size)
                held.append(batch.slice(a, n))
                a, size = a + n, size + n
                if size == most:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
