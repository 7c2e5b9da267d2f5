"""Whole texts of an Arrow batch as flat numpy arrays: words, lines, hashes and shingles.

All helpers work on the UTF-8 bytes of a few megabytes of text at a time, so a task's memory does
not depend on the batch; one text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

_BYTES = np.arange(256)
#: Bytes of words in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: Bytes of words in `[^\x20\x09-\x0D]+`.
SOLID = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes that begin a code point.
LEADS = (_BYTES & 0xC0) != 0x80

_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


_table: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    if name not in _table or len(_table[name]) < n:
        _table[name] = _powers(base, max(n, 1 << 16))
    return _table[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``offsets`` (one more than texts, from 0) and ``data`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def field(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A column, or ``struct.field``."""
    name, _, inner = column.partition(".")
    return batch.column(name).field(inner) if inner else batch.column(name)


#: What a worker keeps from task to task of a stage, as tokenizers.
kept: dict[type, tuple] = {}
_stage: int | None = None
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def fresh() -> None:
    """As a task begins: what was kept for another stage goes, and freed memory goes back, as a worker lives on from stage to stage."""
    global _stage
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _stage:
        kept.clear()
        _stage = stage
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batches: Iterator[pa.RecordBatch], *columns: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most ``most`` bytes in the given columns (``text``), or one row."""
    fresh()
    for batch in batches:
        offsets = sum(flat(field(batch, c))[0] for c in columns or ("text",))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Spans:
    """Maximal runs of the bytes that ``table`` marks, inside each text.

    ``start``, ``end``: byte offsets; ``first``: for each text the index of its first run, and the
    number of runs at last.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = table[data]
        n = len(data)
        begin, finish = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            finish[:-1] &= ~inside[1:]
            edge = offsets[(offsets > 0) & (offsets < n)]
            begin[edge] = inside[edge]
            finish[edge - 1] = inside[edge - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, offsets)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


class Rolling:
    """64-bit hashes of any byte ranges of ``data`` from one prefix sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table("up", _BASE, max(n, 1))[:n], out=self.prefix[1:])
        self.down = _power_table("down", pow(_BASE, -1, 1 << 64), n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` words in a row, and like ``first`` their bounds; a text of 1 to k-1 words has one of all it has."""
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts) + np.repeat(first[:-1], counts)
    room = np.repeat(first[1:], counts) - at
    out = np.zeros(len(at), np.uint64)
    factor = np.uint64(_STEP)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        out = np.where(room > j, out * factor + padded[at + j], out)
    return mix(out), bounds


def occurrence(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value how many equal ones stand before it in its group, and how many there are."""
    n = len(values)
    rank, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n:
        key = values ^ mix(group.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        run = key[order]
        begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        length = np.diff(np.append(begin, n))
        rank[order] = np.arange(n) - np.repeat(begin, length)
        size[order] = np.repeat(length, length)
    return rank, size


def sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` over ``bounds[i] .. bounds[i+1]``."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[bounds])
