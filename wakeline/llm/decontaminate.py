"""Benchmark decontamination by SimHash over windows of the items' own sizes.

A window of as many words as an item has (every start in every text) gets the 64-bit SimHash of its
five-word shingles. Items of a size are indexed by the eight bytes of their fingerprints: by the
pigeonhole principle two fingerprints within ``RADIUS`` = 23 bits agree up to 2 bits in at least one
byte, so eight tables that list for each byte value the items near it find all of them. A window looks
up its eight bytes, what it meets is judged by the whole distance, and what is within the radius is
verified: the weighted Jaccard similarity of window and item, shingles counted as often as they occur.

Windows in which too few shingles occur anywhere in the benchmark to reach the similarity with any
item at all are not fingerprinted; that loses none. (At the similarity of 0.8 the expected
distance is under 10 bits, 23 is more than four deviations off.)

A text of fewer words than an item (but five or more) is compared with it as a whole, by counting the
shingles that they share; only items of so many shingles that the similarity can be reached count.

Nothing of the documents is shuffled: the index goes to every task. It is built from at most about
``block_bytes`` of benchmark text at a time; a larger benchmark is split by item, written out once by
block, and the documents meet its blocks one after another.

Defined results
    null or wordless texts and items match nothing; an item of fewer than five words matches where
    all its words stand in a row; a null doc_id or item_id is kept; repeated rows or items give
    repeated matches; of several windows on one item the most similar counts, then the first; empty
    tables give no rows; other columns are ignored (or kept, in ``decontaminated``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, scratch, staged
from .text import ALNUM, LOWER, Rolling, Spans, flat, pieces, shingles, sums

RADIUS, BLOCKS, SPARE = 23, 8, 2
#: Which byte values are within SPARE bits of each other.
_NEAR = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :]) <= SPARE


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = flat(texts)
    data = LOWER[data]
    spans = Spans(data, offsets, ALNUM)
    return Rolling(data).of(spans.start, spans.end), spans.first


def _planes(grams: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle hash."""
    bits = np.unpackbits(grams.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _fingerprints(total: np.ndarray) -> np.ndarray:
    """Eight bytes for each row of plane sums."""
    return np.packbits(total > 0, axis=1, bitorder="little")


def _ranks(ids: np.ndarray) -> np.ndarray:
    """In each row, how many equal values stand before each value."""
    order = np.argsort(ids, axis=1, kind="stable")
    run = np.take_along_axis(ids, order, 1)
    at = np.arange(ids.shape[1])[None, :]
    begin = np.where(np.concatenate([np.ones((len(ids), 1), bool), run[:, 1:] != run[:, :-1]], axis=1), at, 0)
    rank = np.empty_like(ids)
    np.put_along_axis(rank, order, at - np.maximum.accumulate(begin, axis=1), 1)
    return rank


class Tables:
    """Fingerprints by each of their bytes: for every byte value the rows whose byte is within SPARE bits of it."""

    def __init__(self, prints: np.ndarray):
        self.prints = np.ascontiguousarray(prints).view("<u8").ravel()
        self.begin, self.rows = [], []
        for b in range(BLOCKS):
            value, row = np.nonzero(_NEAR[:, prints[:, b]])
            self.begin.append(np.searchsorted(value, np.arange(257)))
            self.rows.append(row.astype(np.int32))

    def within(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an asked fingerprint and a row that are within RADIUS bits, each once."""
        whole, n = np.ascontiguousarray(asked).view("<u8").ravel(), len(self.prints)
        found = []
        for b in range(BLOCKS):
            low = self.begin[b][asked[:, b]]
            count = self.begin[b][asked[:, b].astype(np.int64) + 1] - low
            who = np.repeat(np.arange(len(asked)), count)
            row = self.rows[b][np.arange(len(who)) + np.repeat(low - np.cumsum(count) + count, count)]
            near = np.bitwise_count(whole[who] ^ self.prints[row]) <= RADIUS
            found.append(who[near] * n + row[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // n, pairs % n


class Index:
    """Items by their size in words; picklable, so it can be broadcast."""

    def __init__(self, texts: list[str | None], k: int = 5, similarity: float = 0.8):
        self.k, self.similarity = k, similarity
        words, first = _words(pa.array(texts, pa.string()))
        n = np.diff(first)
        grams, bounds = shingles(words, first, k)
        self.known = np.unique(grams)  # every shingle of the benchmark; its place is its id
        self.sizes: dict[int, tuple[np.ndarray, Tables, list]] = {}
        for size in np.unique(n[n > 0]):
            rows = np.flatnonzero(n == size)
            ids = np.stack([np.searchsorted(self.known, grams[bounds[r] : bounds[r + 1]]) for r in rows])
            prints = np.stack([_fingerprints(_planes(grams[bounds[r] : bounds[r + 1]]).sum(axis=0, keepdims=True))[0] for r in rows])
            self.sizes[int(size)] = (rows, Tables(prints), [np.unique(i, return_counts=True) for i in ids])
        # For each shingle the items of k words or more that hold it, and how often.
        held = [(r, i, c) for size, (rows, _, counts) in self.sizes.items() if size >= k for r, count in zip(rows, counts, strict=True) for i, c in zip(*count, strict=True)]
        held = np.array(held, np.int64).reshape(-1, 3)
        held = held[np.argsort(held[:, 1], kind="stable")]
        self.held, self.held_from = held[:, [0, 2]], np.searchsorted(held[:, 1], np.arange(len(self.known) + 1))
        self.n_grams = np.diff(bounds)
        self.table = np.zeros(1 << 20, bool)
        self.table[self.known & np.uint64(len(self.table) - 1)] = True

    def least(self, n: int) -> int:
        """Shingles that two windows of ``n`` shingles share at the similarity."""
        return int(np.ceil(2 * self.similarity / (1 + self.similarity) * n - 1e-9))

    def ids_of(self, grams: np.ndarray) -> np.ndarray:
        """The id of each shingle, -1 for those that are not the benchmark's."""
        out = np.full(len(grams), -1, np.int64)
        maybe = np.flatnonzero(self.table[grams & np.uint64(len(self.table) - 1)])
        if len(maybe) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
            hit = self.known[at] == grams[maybe]
            out[maybe[hit]] = at[hit]
        return out

    def matches(self, texts: pa.Array) -> np.ndarray:
        """Rows ``text, item, start word, size, similarity`` of the best window of each text on each item."""
        words, first = _words(texts)
        found = []
        for k in sorted({min(self.k, size) for size in self.sizes}):
            grams, bounds = shingles(words, first, k)
            ids = self.ids_of(grams)
            if not (ids >= 0).any():
                continue
            here = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(ids >= 0, out=here[1:])
            text_of = np.repeat(np.arange(len(first) - 1), np.diff(bounds))
            # Shingles from which a window can reach one of the benchmark's.
            longest = max(size for size in self.sizes if min(self.k, size) == k) - k + 1
            ahead = np.minimum(np.arange(len(ids)) + longest, bounds[1:][text_of])
            starts = np.flatnonzero(here[ahead] > here[:-1])
            for size, (rows, tables, counts) in self.sizes.items():
                n = size - k + 1
                if min(self.k, size) != k:
                    continue
                whole = starts[starts + n <= bounds[1:][text_of[starts]]]
                whole = whole[np.diff(first)[text_of[whole]] >= size]
                whole = whole[here[whole + n] - here[whole] >= self.least(n)]
                for at in np.array_split(whole, max(1, -(-len(whole) * max(n, len(rows)) // 2_000_000))):
                    found += self._verified(at, n, grams, ids, rows, tables, counts, text_of, bounds, size)
            if k == self.k:
                found += self._shorter(ids, first, bounds)
        rows = np.concatenate([np.zeros((0, 5)), *found])
        if not len(rows):
            return rows
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 4], rows[:, 1], rows[:, 0]))]
        return rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]

    def _shorter(self, ids: np.ndarray, first: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Whole texts on items of more words."""
        found = []
        words, n = np.diff(first), np.diff(bounds)
        enough = sums(ids >= 0, bounds) >= np.ceil(2 * self.similarity / (1 + self.similarity) * n - 1e-9)
        for t in np.flatnonzero(enough & (words >= self.k) & (words < max(self.sizes))):
            own, often = np.unique(ids[bounds[t] : bounds[t + 1]], return_counts=True)
            own, often = own[own >= 0], often[own >= 0]
            if not len(own):
                continue
            held = np.concatenate([self.held[a:b] for a, b in zip(self.held_from[own], self.held_from[own + 1], strict=True)])
            least = np.minimum(held[:, 1], np.repeat(often, self.held_from[own + 1] - self.held_from[own]))
            size = self.n_grams[held[:, 0]]
            longer = (size > n[t]) & (size * self.similarity <= n[t] + 1e-9)
            item, of = np.unique(held[longer, 0], return_inverse=True)
            shared = np.bincount(of, least[longer], minlength=len(item))
            similarity = shared / (n[t] + self.n_grams[item] - shared)
            near = similarity >= self.similarity - 1e-12
            m = int(near.sum())
            found.append(np.stack([np.full(m, t), item[near], np.zeros(m), np.full(m, words[t]), similarity[near]], axis=1).astype(np.float64))
        return found

    def _verified(self, at, n, grams, ids, rows, tables, counts, text_of, bounds, size) -> list[np.ndarray]:
        if not len(at):
            return []
        inside = at[:, None] + np.arange(n)[None, :]
        total = np.zeros((len(at), 64), np.int32)
        for j in range(n):
            total += _planes(grams[inside[:, j]])
        window, item = tables.within(_fingerprints(total))
        order = np.argsort(item, kind="stable")
        window, item = window[order], item[order]
        found = []
        for i, w in zip(*np.unique(item, return_index=True), strict=True) if len(item) else ():
            w = window[w : w + np.searchsorted(item[w:], i, "right")]
            block = ids[inside[w]]
            held, often = counts[i]
            place = np.minimum(np.searchsorted(held, block), len(held) - 1)
            shared = (_ranks(block) < np.where(held[place] == block, often[place], 0)).sum(axis=1)
            similarity = shared / (2 * n - shared)
            w, similarity = w[similarity >= self.similarity - 1e-12], similarity[similarity >= self.similarity - 1e-12]
            s = at[w]
            found.append(np.stack([text_of[s], np.full(len(s), rows[i]), s - bounds[:-1][text_of[s]], np.full(len(s), size), similarity], axis=1).astype(np.float64))
        return found


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Item ids and texts, at most about ``block_bytes`` of text at a time."""
    items = lean(benchmark).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    if n > 1:
        path = scratch(items.sparkSession, "benchmark-blocks")
        items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")).write.partitionBy("block").parquet(path)
        items = items.sparkSession.read.parquet(path)
    for b in range(n):
        rows = (items.filter(F.col("block") == b) if n > 1 else items).select("item_id", "text").collect()
        yield [r.item_id for r in rows], [r.text for r in rows]


def find_leaks(documents: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, block_bytes: int = 32 << 20) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity``: a row for each document row and item that it holds."""
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    spark = documents.sparkSession
    out = None
    for item_ids, texts in _blocks(benchmark, block_bytes):
        index = spark.sparkContext.broadcast((item_ids, Index(texts, k, similarity)))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            names, items = index.value
            for part in pieces(batches):
                m = items.matches(part.column("text"))
                if len(m):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array(m[:, 0].astype(np.int64))), pa.array([names[int(i)] for i in m[:, 1]], pa.int64()),
                            pa.array(m[:, 2].astype(np.int64)), pa.array(m[:, 3].astype(np.int64)), pa.array(m[:, 4]),
                        ],
                        names=["doc_id", "item_id", "start_word", "n_words", "similarity"],
                    )

        part = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminated(documents: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no item.

    With one block of benchmark rows pass through the worker that judges them. With several the documents
    are written once with a row number; each block names the rows that hold an item of it, side by side, and those
    go by one anti join. So no task runs more than one Python worker, however many blocks there are.
    """
    spark = documents.sparkSession
    indexes = [spark.sparkContext.broadcast(Index(texts, k, similarity)) for _, texts in _blocks(benchmark, block_bytes)]

    def hit(part: pa.RecordBatch, index) -> np.ndarray:
        found = np.zeros(part.num_rows, bool)
        found[index.value.matches(part.column("text"))[:, 0].astype(np.int64)] = True
        return found

    if len(indexes) < 2:
        for index in indexes:

            def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
                for part in pieces(batches):
                    yield part.filter(pa.array(~hit(part, index)))

            documents = lean(documents).mapInArrow(run, documents.schema)
        return documents
    row = f"row_{uuid.uuid4().hex}"
    rows = staged(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    leaks = None
    for index in indexes:

        def marked(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches):
                yield part.select([row]).filter(pa.array(hit(part, index)))

        found = lean(rows).select(row, "text").mapInArrow(marked, f"`{row}` long")
        leaks = found if leaks is None else leaks.unionByName(found)
    return rows.join(leaks, row, "left_anti").drop(row)
