"""Packing of token pieces into fixed windows by non-negative least squares on the length histogram.

Every text is tokenized whole and ended with an end id, then cut into full windows and one rest. The
histogram of the rests' lengths (one number per length) is all that the driver plans with: all pairs
and triples of lengths that fill a window are enumerated, how often to use each is solved by
non-negative least squares to a stated tolerance, rounded by largest remainders and taken from what
there is; what is left is solved again. The residual is packed greedily, largest first, and where
nothing fits a gap a rest is cut to fill it. So all sequences but the last are full.

A rest's place follows from its rank among those of its length, which is its rank within the task that
made it plus the number of such rests in tasks before: no length's rows ever meet in one task. The
plan has at most a few rows per combination (87,893 of them for a window of 1024) and solve, whatever
the corpus, so it is broadcast.

Defined results
    null or empty text: the end id alone; texts are never shortened; a null doc_id is kept; repeated
    rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import lean, staged
from .text import Rolling, flat, fresh, kept, pieces

# --- tokens ------------------------------------------------------------------

_B = np.arange(256)
_SPACE = (_B == 0x20) | ((_B >= 0x09) & (_B <= 0x0D))
_VISIBLE = (_B >= 0x21) & (_B <= 0x7E)
_LETTER = ((_B >= 0x41) & (_B <= 0x5A)) | ((_B >= 0x61) & (_B <= 0x7A))
_DIGIT = (_B >= 0x30) & (_B <= 0x39)
_PUNCTUATION = _VISIBLE & ~_LETTER & ~_DIGIT


def chunks(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where texts may be split without changing their tokens.

    A byte-level vocabulary's splitting pattern always breaks before white space that follows a
    visible character, and between a letter or digit and punctuation. Breaks are placed where bytes
    alone show that: after ASCII and two-byte characters that cannot be white space.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        before = np.zeros(n, np.uint8)
        before[1:] = data[:-1]
        lead = np.zeros(n, np.uint8)
        lead[2:] = data[:-2]
        two = (before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
        latin = two & (lead == 0xC3) & (before != 0x97) & (before != 0xB7)
        cut[:n] = (_SPACE[data] & (_VISIBLE[before] | two)) | (_PUNCTUATION[data] & (_LETTER[before] | _DIGIT[before] | latin))
    cut[offsets] = True
    cut[n] = True
    return np.flatnonzero(cut)


class Memo:
    """Ids of chunks met lately, by 128-bit hashes: a slot for each of ``slots`` keys and a ring of ``room`` ids, so its size is fixed."""

    def __init__(self, slots: int, room: int):
        self.k1, self.k2 = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.begin, self.size = np.full(slots, -room - 1, np.int64), np.zeros(slots, np.int64)
        self.ring, self.head = np.zeros(room, np.uint32), 0

    def find(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which chunks are known, and the ids of those in a row with their sizes."""
        at = (k1 & np.uint64(len(self.k1) - 1)).astype(np.int64)
        known = (self.k1[at] == k1) & (self.k2[at] == k2) & (self.begin[at] >= self.head - len(self.ring))
        at = at[known]
        size = self.size[at]
        return known, self.ring[(np.arange(size.sum()) + np.repeat(self.begin[at] - np.cumsum(size) + size, size)) % len(self.ring)], size

    def keep(self, k1: np.ndarray, k2: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        some = np.cumsum(size) <= len(self.ring) // 2
        k1, k2, size = k1[some], k2[some], size[some]
        ids = ids[: size.sum()]
        at = (k1 & np.uint64(len(self.k1) - 1)).astype(np.int64)
        self.ring[(self.head + np.arange(len(ids))) % len(self.ring)] = ids
        self.k1[at], self.k2[at], self.size[at], self.begin[at] = k1, k2, size, self.head + np.cumsum(size) - size
        self.head += len(ids)


class Tokens:
    """Ids of texts by a tokenizer file; each distinct chunk is tokenized once while it is remembered.

    Texts that hold the string of a special token are tokenized whole, as the tokenizer does it.
    """

    def __init__(self, path: str, slots: int = 1 << 19, room: int = 1 << 22):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.memo = Memo(slots, room)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte-level vocabulary writes each byte as one character
            self.bytes_of[i] = len(token)

    @classmethod
    def of(cls, path: str, run: str = "") -> Tokens:
        """One for all tasks of a stage that a worker does; nothing is remembered from run to run, and a worker never holds two."""
        fresh()
        if kept.get(cls, (None,))[0] != (path, run):
            kept.pop(cls, None)  # before there is another
            kept[cls] = (path, run), cls(path)
        return kept[cls][1]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        found = [np.array(e.ids, np.uint32) for e in encode(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after the other, and how many each has.

        Chunks that begin with white space and end in what no white space can be are tokenized many in a
        row, as a text may be split between them; the bytes of the tokens tell where each ends.
        """
        offsets, data = flat(words)
        n = np.diff(offsets)
        last, lead = data[np.maximum(offsets[1:] - 1, 0)], data[np.maximum(offsets[1:] - 2, 0)]
        joined = (n > 2) & _SPACE[data[np.minimum(offsets[:-1], len(data) - 1)]] & (_VISIBLE[last] | ((last >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)))
        rows = np.flatnonzero(joined)
        ids, size = [], np.zeros(len(n), np.int64)
        if len(rows):
            some = words.take(pa.array(rows)).to_pylist()
            texts = ["".join(some[i : i + 200]) for i in range(0, len(some), 200)]
            got, _ = self._encoded(texts)
            end = np.cumsum(self.bytes_of[got])
            stop = np.searchsorted(end, np.cumsum(n[rows]))
            if len(end) and stop[-1] < len(end) and (end[stop] == np.cumsum(n[rows])).all() and stop[-1] == len(end) - 1:
                size[rows] = np.diff(stop, prepend=-1)
                ids.append((rows, got))
            else:
                joined[:] = False
        rows = np.flatnonzero(~joined)
        got, alone = self._encoded(words.take(pa.array(rows)).to_pylist())
        size[rows] = alone
        ids.append((rows, got))
        begin = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        for rows, got in ids:
            m = size[rows]
            out[np.arange(m.sum()) + np.repeat(begin[rows] - np.cumsum(m) + m, m)] = got
        return out, size

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and their bounds."""
        marked = np.zeros(len(texts), bool)
        for s in self.special:
            marked |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._in_chunks(texts, end)
        ids, bounds = self._in_chunks(pc.if_else(pa.array(marked), pa.scalar("", texts.type), texts), end)
        parts, rows = np.split(ids, bounds[1:-1]), np.flatnonzero(marked)
        for r, e in zip(rows.tolist(), self.tokenizer.encode_batch(texts.take(pa.array(rows)).to_pylist(), add_special_tokens=False), strict=True):
            parts[r] = np.array([*e.ids, end], np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _in_chunks(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        offsets, data = flat(texts)
        at = chunks(offsets, data)
        count = len(at) - 1 if len(data) else 0
        parts = pa.Array.from_buffers(pa.large_string(), count, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words = parts.dictionary
        bounds, own = flat(words)
        k1 = Rolling(own).of(bounds[:-1], bounds[1:])
        k2 = Rolling(np.bitwise_xor(own, 0x5A)).of(bounds[:-1], bounds[1:])
        known, old, old_size = self.memo.find(k1, k2)
        fresh = np.flatnonzero(~known)
        new, new_size = self._ids(words.take(pa.array(fresh)))
        self.memo.keep(k1[fresh], k2[fresh], new, new_size)
        flat_ids = np.concatenate([old, new])
        size, begin = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        size[known], size[fresh] = old_size, new_size
        begin[known], begin[fresh] = np.cumsum(old_size) - old_size, len(old) + np.cumsum(new_size) - new_size
        which = parts.indices.to_numpy() if count else np.zeros(0, np.int64)
        sizes = size[which]
        total = np.zeros(count + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        first = np.searchsorted(at[:count], offsets) if count else np.zeros(len(offsets), np.int64)
        bounds = total[first] + np.arange(len(offsets))  # an end id for each text before
        ids = np.full(int(bounds[-1]), end, np.uint32)
        text = np.searchsorted(first, np.arange(count), "right") - 1
        ids[np.arange(total[-1]) + np.repeat(text, sizes)] = flat_ids[np.arange(total[-1]) - np.repeat(total[:-1] - begin[which], sizes)]
        return ids, bounds


# --- the plan ----------------------------------------------------------------


def combinations(window: int) -> np.ndarray:
    """All ``i <= j <= k``, i from 0 (a pair), that fill the window and have no piece of its size."""
    i, j = np.meshgrid(np.arange(window // 3 + 1), np.arange(1, window // 2 + 1), indexing="ij")
    k = window - i - j
    ok = (i <= j) & (j <= k) & (k < window)
    return np.stack([i[ok], j[ok], k[ok]], axis=1)


def least_squares(counts: np.ndarray, combos: np.ndarray, tolerance: float = 0.01, steps: int = 600) -> np.ndarray:
    """Repeat counts ``x >= 0`` that make the combinations' lengths match ``counts`` best, by accelerated projected gradient.

    It ends where no step along the projected gradient would move more than ``tolerance`` of the
    steepest first one (or after ``steps``).
    """
    n = len(counts)
    cols = combos.T
    flat_cols = cols.ravel()

    def made(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat_cols, weights=np.tile(x, len(cols)), minlength=n)
        out[0] = 0
        return out

    def pulled(r: np.ndarray) -> np.ndarray:
        return sum(r[c] for c in cols)

    if not len(combos):
        return np.zeros(0)
    v = np.ones(len(combos))
    for _ in range(12):
        v = pulled(made(v))
        bound = np.linalg.norm(v)
        v /= bound
    bound *= 1.05
    x = y = np.zeros(len(combos))
    t = 1.0
    target = counts.astype(np.float64).copy()
    target[0] = 0
    enough = tolerance * np.abs(pulled(target)).max(initial=0.0) / bound
    for _ in range(steps):
        new = np.maximum(y - pulled(made(y) - target) / bound, 0)
        if np.abs(new - y).max(initial=0.0) <= enough:
            return new
        if (y - new) @ (new - x) > 0:  # momentum points uphill: start it anew
            t = 1.0
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / s * (new - x), s
    return x


@dataclass(frozen=True)
class Slot:
    """Ranks ``low <= rank < high`` of rests of ``length``: their ids from ``cut_at`` on, ``size`` of them.

    The x-th of them (from ``begins``) goes to sequence ``sequence + x // each`` at ``offset + x % each * size``.
    """

    length: int
    low: int
    high: int
    cut_at: int
    size: int
    begins: int
    each: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], window: int, solves: int = 60) -> tuple[list[Slot], int, int]:
    """Slots for all rests, the number of sequences, and how many rests the least-squares combinations hold.

    The histogram is solved, the repeats are rounded down, then up in order of their remainders as far
    as there are rests; what is left is solved again, up to ``solves`` times while that places any.
    """
    counts = np.zeros(window, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    stock: dict[int, list[list[int]]] = defaultdict(list)  # of size: source length, low, high, cut_at
    for length in np.flatnonzero(counts):
        stock[int(length)].append([int(length), 0, int(counts[length]), 0])
    slots: list[Slot] = []
    sequences = 0

    def take(size: int, n: int) -> Iterator[tuple[list[int], int]]:
        done = 0
        while done < n:
            piece = stock[size][-1]
            m = min(n - done, piece[2] - piece[1])
            yield [piece[0], piece[1], piece[1] + m, piece[3]], done
            piece[1] += m
            if piece[1] == piece[2]:
                stock[size].pop()
            done += m
        counts[size] -= n

    def lay(uses: list[tuple[int, int]], times: int, cut: int = 0) -> None:
        """``uses``: size and how many of it in each sequence; ``cut``: a size of which a part fills the gap."""
        nonlocal sequences
        offset = 0
        for size, each in uses:
            for (source, low, high, cut_at), begins in take(size, times * each):
                slots.append(Slot(source, low, high, cut_at, size, begins, each, sequences, offset))
            offset += size * each
        if cut:
            gap = window - offset
            for (source, low, high, cut_at), begins in list(take(cut, times)):
                slots.append(Slot(source, low, high, cut_at, gap, begins, 1, sequences, offset))
                stock[cut - gap].append([source, low, high, cut_at + gap])
            counts[cut - gap] += times
        sequences += times

    combos, rests = combinations(window), int(counts.sum())
    for _ in range(solves):
        if not counts.any():
            break
        before = counts.sum()
        # Only combinations that could be laid once more.
        i, j, k = combos.T
        some = combos[((i == 0) | (counts[i] > 0)) & (counts[j] > (i == j)) & (counts[k] > (j == k) * (1 + (i == j)))]
        repeats = least_squares(counts, some)
        whole = np.floor(repeats + 1e-6).astype(np.int64)
        part = repeats - whole
        order = np.argsort(-part, kind="stable")
        order = order[part[order] >= 0.5 * part.max(initial=0.0)]  # lesser remainders wait for the next solve
        for up, order in ((0, np.flatnonzero(whole)), (1, order)):
            for c in order.tolist():
                i, j, k = some[c].tolist()
                each: dict[int, int] = {}
                for size in (i, j, k):
                    if size:
                        each[size] = each.get(size, 0) + 1
                times = min(up or int(whole[c]), *(int(counts[m]) // e for m, e in each.items()))
                if times > 0:
                    lay(list(each.items()), times)
        if counts.sum() == before:
            break
    solved = rests - int(counts.sum())
    while counts.any():
        uses: list[tuple[int, int]] = []
        gap, top = window, window - 1
        while gap and (fit := np.flatnonzero(counts[: min(gap, top) + 1])).size:
            size = int(fit[-1])
            each = int(min(gap // size, counts[size]))
            uses.append((size, each))
            gap, top = gap - size * each, size - 1
        times = min(int(counts[s]) // e for s, e in uses)
        cut = 0
        if gap:
            used = dict(uses)
            free = [int(s) for s in np.flatnonzero(counts) if s > gap and counts[s] > used.get(int(s), 0)]
            if free:
                cut = free[-1]
                times = min(times, int(counts[cut]) // (used.get(cut, 0) + 1))
        lay(uses, times, cut)
    return slots, sequences, solved


# --- jobs --------------------------------------------------------------------

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, task long, nth long"
PLACED = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cut_texts(documents: DataFrame, tokenizer: str, window: int, end: int) -> DataFrame:
    """Full windows and rests with their ids (two bytes each where the vocabulary allows), written out.

    ``nth``: a rest's rank among those of its length that the same ``task`` made.
    """
    this = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = Tokens.of(tokenizer, this), TaskContext.get().partitionId()
        wide = np.uint16 if tokens.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        made: dict[int, int] = defaultdict(int)
        for part in pieces(batches):
            ids, bounds = tokens(part.column("text"), end)
            n = np.diff(bounds)
            parts = -(-n // window)
            owner = np.repeat(np.arange(len(n)), parts)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
            length = np.minimum(window, n[owner] - start)
            raw = ids.astype(wide)
            begin = bounds[:-1][owner] + start
            offsets = np.append(begin, bounds[-1]) * raw.itemsize  # pieces follow each other without a gap
            values = pa.Array.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            nth = np.full(len(owner), -1, np.int64)
            for r in np.flatnonzero(length < window).tolist():
                nth[r] = made[int(length[r])]
                made[int(length[r])] += 1
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()).take(pa.array(owner)), pa.array(start), pa.array(length), values, pa.array(n[owner]), pa.array(np.full(len(owner), task, np.int64)), pa.array(nth)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "task", "nth"],
            )

    return staged(lean(documents).select("doc_id", "text").mapInArrow(run, PIECE), "token-pieces")


class Table:
    """Slots as sorted arrays: layers, in each of which the slots of a length cover no rank twice."""

    def __init__(self, slots: list[Slot]):
        layers: list[list[Slot]] = []
        for slot in sorted(slots, key=lambda s: (s.length, s.low)):
            for layer in layers:
                if layer[-1].length < slot.length or layer[-1].high <= slot.low:
                    layer.append(slot)
                    break
            else:
                layers.append([slot])
        self.layers = [np.array([(s.length, s.low, s.high, s.cut_at, s.size, s.begins, s.each, s.sequence, s.offset) for s in layer], np.int64).T for layer in layers]

    def of(self, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For each layer: which rests have a slot there, ``cut_at``, ``size``, the sequence and the offset in it."""
        for lengths, low, high, cut_at, size, begins, each, sequence, offset in self.layers:
            key = lengths << 40 | low
            at = np.searchsorted(key, length << 40 | rank, "right") - 1
            hit = np.flatnonzero((at >= 0) & (lengths[at] == length) & (rank < high[at]))
            at = at[hit]
            x = begins[at] + rank[hit] - low[at]
            yield hit, cut_at[at], size[at], sequence[at] + x // each[at], offset[at] + x % each[at] * size[at]


def _sliced(batch: pa.RecordBatch, rows: np.ndarray, cut_at: np.ndarray, size: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """Pieces of the batch's rows from ``cut_at`` on, their ids 32 bits wide."""
    part = batch.take(pa.array(rows))
    ids = part.column("ids").to_pylist()
    out = [np.frombuffer(b, np.uint16 if len(b) == 2 * w else np.uint32)[a : a + s].astype("<u4").tobytes() for b, w, a, s in zip(ids, part.column("length").to_pylist(), cut_at.tolist(), size.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(part.column("start").to_numpy() + cut_at), pa.array(size), pa.array(out, pa.binary()), part.column("doc_tokens"), pa.array(sequence), pa.array(offset)],
        names=[f.split()[0] for f in PLACED.split(", ")],
    )


def pack_documents(documents: DataFrame, tokenizer: str, window: int = 1024, end: int = 0) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: a row per piece.

    ``ids``: the piece's ids, unsigned little-endian 32-bit.
    """
    made = cut_texts(documents, tokenizer, window, end)
    rests = made.filter(F.col("length") < window)
    by_task = staged(rests.groupBy("length", "task").agg(F.count("*").alias("n")), "rest-counts", narrow=True)
    histogram = {int(r.length): int(r.n) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most window - 1 rows
    slots, sequences, _ = plan(histogram, window)
    table = documents.sparkSession.sparkContext.broadcast(Table(slots))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rests.join(bases, ["length", "task"]).select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("base") + F.col("nth")).alias("place"))
    full = made.filter(F.col("length") == window).select("doc_id", "start", "length", "ids", "doc_tokens", (F.lit(sequences) + F.monotonically_increasing_id()).alias("place"))

    def place_rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("place").to_numpy()
            for found in table.value.of(length, rank):
                yield _sliced(batch, *found)

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            yield _sliced(batch, np.arange(n), np.zeros(n, np.int64), batch.column("length").to_numpy(), batch.column("place").to_numpy(), np.zeros(n, np.int64))

    return ranked.mapInArrow(place_rests, PLACED).unionByName(full.mapInArrow(widen, PLACED))


def packing_digests(packed: DataFrame) -> DataFrame:
    """With a checksum in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
