"""Whole groups out of a task's sorted rows, as tables of many groups side by side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def bounds(*keys: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal keys begin, and the number of rows. Nulls are equal."""
    n = len(keys[0])
    new = np.zeros(max(n - 1, 0), bool)
    for key in keys:
        codes = pc.fill_null(key.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new |= np.diff(codes) != 0
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]]) if n else np.zeros(1, np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int, *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that hold all rows of their groups, with the groups' bounds. Equal keys stand together."""
    waiting, n, most = [], 0, rows
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= most:
            table = pa.Table.from_batches(waiting)
            found = bounds(*(table[k] for k in keys))
            if len(found) > 2:  # the last group may go on
                yield table.slice(0, found[-2]), found[:-1]
                table = table.slice(found[-2])
            waiting, n = table.to_batches(), table.num_rows
            most = max(rows, 2 * n)
    if n:
        table = pa.Table.from_batches(waiting)
        yield table, bounds(*(table[k] for k in keys))
