"""Alignment of two tokenizers on the same texts by byte-owner arrays.

Each byte of a text (with a space before it) belongs to one token of tokenizer A, a byte-level
vocabulary, and to one of B, a sentencepiece vocabulary. Repeating token indices over their bytes gives
two owner arrays; places where the pair of owners changes begin an overlap, places where both change at
once are cuts. Texts are tokenized whole; distinct chunks between which neither tokenizer can merge are
tokenized once while they are remembered. Owner arrays are made for a megabyte of text at a time.

``alignments`` gives ids, cuts and (on request) overlaps of every text. ``link_digests`` counts over the
corpus how often tokens of A and B end together. A text's links are counted by pair of ids where it was
tokenized, so no row of the corpus count is a single link. The pairs that hold more than one
65,536th of all links, at most 65,536, are looked up where they stand; the others are joined by a shuffle on the pair,
and no such pair can be hot. What is shuffled and broadcast so follows from shares, whatever the corpus' size.

Defined results
    null or empty text, or one that A or B does not give back byte by byte: no tokens, zeros and '';
    a text is never cut short; a null doc_id is kept; repeated rows are rows of their own and count each;
    an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import Memo, Tokens
from .shared import lean, staged
from .text import Rolling, flat, fresh, kept, pieces

BLOCK = 1 << 20
#: Bytes of texts that a task aligns at once; a longer text is one piece.
PIECE = 1 << 19
HOT_SHARE = 65_536


def _byte_level() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if visible, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Lengths:
    """The bytes of every id of a vocabulary, in one buffer."""

    def __init__(self, by_id: list[bytes]):
        self.size = np.array([len(b) for b in by_id], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(by_id), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.arange(size.sum()) + np.repeat(self.begin[ids] - np.cumsum(size) + size, size)]


class ByteTokens(Tokens):
    """Ids by a byte-level vocabulary, to which special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = []
        table = _byte_level()
        by_id = [b""] * (max(self.tokenizer.get_vocab().values(), default=-1) + 1)
        for token, i in self.tokenizer.get_vocab().items():
            by_id[i] = bytes(table[c] for c in token) if all(c in table for c in token) else b""
        self.lengths = Lengths(by_id)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and how many each has."""
        ids, bounds = self(texts, 0)
        inner = np.ones(len(ids), bool)
        inner[bounds[1:] - 1] = False  # the end ids that packing wants
        return ids[inner].astype(np.int64), np.diff(bounds) - 1


class PieceTokens:
    """Ids of texts that begin with a space, which the tokenizer adds itself, by a sentencepiece vocabulary.

    Where no piece holds a space behind another character, nothing is merged across the beginning of a
    run of spaces, so texts are cut there. Otherwise texts are tokenized as they are.
    """

    def __init__(self, path: str, slots: int = 1 << 18, room: int = 1 << 21):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.lengths = Lengths([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        self.in_chunks = not any("▁" in n.lstrip("▁") for n in names) and self.model.encode("a  b ") == [self.model.piece_to_id(p) for p in ("▁a", "▁", "▁b", "▁")]
        self.space = self.model.piece_to_id("▁")
        self.memo = Memo(slots, room)

    @classmethod
    def of(cls, path: str, run: str = "") -> PieceTokens:
        fresh()
        if kept.get(cls, (None,))[0] != (path, run):
            kept.pop(cls, None)  # before there is another
            kept[cls] = (path, run), cls(path)
        return kept[cls][1]

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode([c[1:] for c in chunks], num_threads=1)
        found = [[self.space] if c == " " and self.in_chunks else ids for c, ids in zip(chunks, found, strict=True)]
        size = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and how many each has."""
        if not self.in_chunks:
            ids, size = self._encoded(texts.to_pylist())
            return ids.astype(np.int64), size
        offsets, data = flat(texts)
        space = data == 0x20
        cut = np.append(space, True)
        cut[1:-1] &= ~space[:-1]
        cut[offsets] = True
        at = np.flatnonzero(cut)
        count = len(at) - 1
        parts = pa.Array.from_buffers(pa.large_string(), max(count, 0), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        bounds, own = flat(parts.dictionary)
        k1 = Rolling(own).of(bounds[:-1], bounds[1:])
        k2 = Rolling(np.bitwise_xor(own, 0x5A)).of(bounds[:-1], bounds[1:])
        known, old, old_size = self.memo.find(k1, k2)
        fresh = np.flatnonzero(~known)
        new, new_size = self._encoded(parts.dictionary.take(pa.array(fresh)).to_pylist())
        self.memo.keep(k1[fresh], k2[fresh], new, new_size)
        ids = np.concatenate([old, new])
        size, begin = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        size[known], size[fresh] = old_size, new_size
        begin[known], begin[fresh] = np.cumsum(old_size) - old_size, len(old) + np.cumsum(new_size) - new_size
        which = parts.indices.to_numpy() if count > 0 else np.zeros(0, np.int64)
        sizes = size[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        out = ids[np.arange(total[-1]) + np.repeat(begin[which] - total[:-1], sizes)].astype(np.int64)
        return out, np.diff(total[np.searchsorted(at[:-1] if count > 0 else at[:0], offsets)])


@dataclass(frozen=True)
class Owners:
    """Where owners of bytes change: tokens of A and B up to each cut, and overlapping pairs with their sizes in bytes."""

    a: np.ndarray
    b: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shared: np.ndarray


def owners(size_a: np.ndarray, size_b: np.ndarray, block: int = BLOCK) -> Owners:
    """From the sizes in bytes of the tokens of A and of B over the same bytes."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    n = int(end_a[-1]) if len(end_a) else 0
    a, b, left, right, starts = [], [], [], [], []
    last = (-1, -1)
    for low in range(0, n, block):
        high = min(n, low + block)
        pair = []
        for end in (end_a, end_b):
            i, j = np.searchsorted(end, low, "right"), np.searchsorted(end, high, "left") + 1
            held = np.minimum(end[i:j], high)
            pair.append(np.repeat(np.arange(i, j), np.diff(held, prepend=low)))
        own_a, own_b = pair
        new_a, new_b = np.diff(own_a, prepend=last[0]) != 0, np.diff(own_b, prepend=last[1]) != 0
        change = np.flatnonzero(new_a | new_b)
        starts.append(change + low)
        left.append(own_a[change])
        right.append(own_b[change])
        both = np.flatnonzero(new_a & new_b)
        a.append(own_a[both])
        b.append(own_b[both])
        last = (int(own_a[-1]), int(own_b[-1]))
    none = np.zeros(0, np.int64)
    # A cut is where both begin anew: so many tokens lie before it. The first byte is none, the end is one.
    cut_a, cut_b = np.concatenate([none, *a])[1:], np.concatenate([none, *b])[1:]
    if n:
        cut_a, cut_b = np.append(cut_a, len(size_a)), np.append(cut_b, len(size_b))
    begin = np.concatenate([none, *starts])
    return Owners(cut_a, cut_b, np.concatenate([none, *left]), np.concatenate([none, *right]), np.diff(begin, append=n))


def _same(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, count: np.ndarray, lengths: Lengths) -> np.ndarray:
    """Which texts the joined bytes of their ids give back."""
    bounds = np.concatenate([[0], np.cumsum(count)])
    ends = np.concatenate([[0], np.cumsum(lengths.size[ids])])[bounds]
    ok = np.diff(ends) == np.diff(offsets)
    part = np.repeat(ok, count)
    mine = data[np.repeat(ok, np.diff(offsets))]
    wrong = np.concatenate([[0], np.cumsum(lengths.bytes_of(ids[part]) != mine)])
    size = np.where(ok, np.diff(offsets), 0)
    to = np.cumsum(size)
    return ok & (wrong[to] == wrong[to - size])


def _lists(values: np.ndarray, count: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(values, kind))


def _alignment(text: pa.Array, a: ByteTokens, b: PieceTokens, overlaps: bool) -> list[pa.Array]:
    """Columns of ``alignments`` behind the id for the texts of a batch."""
    some = pc.fill_null(pc.greater(pc.binary_length(text), 0), False)
    spaced = pc.if_else(some, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(text.cast(pa.large_string()), ""), pa.scalar("", pa.large_string())), pa.scalar("", pa.large_string()))
    offsets, data = flat(spaced)
    (ids_a, n_a), (ids_b, n_b) = a.ids(spaced), b.ids(spaced)
    good = _same(data, offsets, ids_a, n_a, a.lengths) & _same(data, offsets, ids_b, n_b, b.lengths)
    ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
    n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
    # Tokens of all texts in a row: a text's end is a cut, and no token crosses it.
    found = owners(a.lengths.size[ids_a], b.lengths.size[ids_b])
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    of = np.searchsorted(end_a, found.a, "left")
    cuts = np.bincount(of, minlength=len(good))
    out = [
        _lists(ids_a, n_a, pa.int32()), _lists(ids_b, n_b, pa.int32()),
        _lists(found.a - (end_a - n_a)[of], cuts, pa.int32()), _lists(found.b - (end_b - n_b)[of], cuts, pa.int32()),
    ]
    if overlaps:
        of = np.searchsorted(end_a, found.left, "right")
        n = np.bincount(of, minlength=len(good))
        out += [_lists(found.left - (end_a - n_a)[of], n, pa.int32()), _lists(found.right - (end_b - n_b)[of], n, pa.int32()), _lists(found.shared, n, pa.int32())]
    return out


ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"
OVERLAPS = "a_at array<int>, b_at array<int>, n_bytes array<int>"


def alignments(documents: DataFrame, path_a: str, path_b: str, overlaps: bool = False) -> DataFrame:
    """Ids by A and B of every row of ``doc_id, text``, and how many tokens of each lie before every cut.

    ``overlaps``: also the places of tokens that share bytes, in order, and how many bytes they share.
    """
    return lean(documents).select("doc_id", "text").mapInArrow(_aligner(path_a, path_b, overlaps), f"{ALIGNED}, {OVERLAPS}" if overlaps else ALIGNED)


def _aligner(path_a: str, path_b: str, overlaps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of ``doc_id, text`` to batches of ``alignments``, a few texts at a time."""
    names = [f.split()[0] for f in (f"{ALIGNED}, {OVERLAPS}" if overlaps else ALIGNED).split(", ")]
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ByteTokens.of(path_a, run_id), PieceTokens.of(path_b, run_id)
        for part in pieces(batches, most=PIECE):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *_alignment(part.column("text"), a, b, overlaps)], names=names)

    return run


def _items(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and the number of each list."""
    count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), count


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. most as bytes with one place more, and their number."""
    width = len(str(most))
    n = np.arange(most + 1)
    size = np.ones(most + 1, np.int64)
    for k in range(1, width):
        size += n >= 10**k
    place = size[:, None] - 1 - np.arange(width + 1)[None, :]
    return (n[:, None] // 10 ** np.maximum(place, 0) % 10 + 48).astype(np.uint8), size


def group_texts(ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, n_cuts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for each text, from flat ids and the tokens before its cuts."""
    text = np.repeat(np.arange(len(n_cuts)), n_cuts)
    to_a, to_b = cut_a + (np.cumsum(n_a) - n_a)[text], cut_b + (np.cumsum(n_b) - n_b)[text]  # over all texts
    size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    total = len(ids_a) + len(ids_b)
    values, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    values[np.arange(len(ids_a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)] = ids_a
    values[np.arange(len(ids_b)) + np.repeat(np.cumsum(size_a), size_b)] = ids_b
    ends = to_a + to_b
    mark[ends - size_b - 1] = ord("|")
    mark[ends - 1] = ord(";")
    digits, size = table
    wide, size = digits[values], size[values]
    wide[np.arange(total), size] = mark
    written = wide[np.arange(wide.shape[1])[None, :] <= size[:, None]]
    until = np.concatenate([[0], np.cumsum(size + 1)])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    whole = written.tobytes()
    return [whole[s : e - 1] if e > s else b"" for s, e in zip(until[:-1].tolist(), until[1:].tolist(), strict=True)]


DIGESTS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _digest(batch: pa.RecordBatch, first: int, table: tuple[np.ndarray, np.ndarray] | None) -> tuple[list[pa.Array], int]:
    (ids_a, n_a), (ids_b, n_b), (cut_a, n_cuts), (cut_b, _) = (_items(batch.column(c)) for c in ("a_ids", "b_ids", "a_cuts", "b_cuts"))
    texts = group_texts(ids_a, n_a, ids_b, n_b, cut_a, cut_b, n_cuts, table)
    text = np.repeat(np.arange(len(n_cuts)), n_cuts)
    last_a, last_b = ids_a[cut_a - 1 + (np.cumsum(n_a) - n_a)[text]], ids_b[cut_b - 1 + (np.cumsum(n_b) - n_b)[text]]
    # Links of a text, counted by their pair of ids: sorted by text and pair.
    pair = (last_b << 32) | last_a
    order = np.lexsort((pair, text))
    pair, text = pair[order], text[order]
    begin = np.flatnonzero(np.diff(pair, prepend=-1).astype(bool) | np.diff(text, prepend=-1).astype(bool))
    counted = pa.StructArray.from_arrays([pa.array(pair[begin]), pa.array(np.diff(begin, append=len(pair)))], names=["pair", "n"])
    pairs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[begin], minlength=len(n_cuts)))]), pa.int32()), counted)
    hashes = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
    rows = pa.array(np.arange(len(n_cuts)) + first, pa.int64())
    return [rows, batch.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array(n_cuts), pa.array(n_cuts), pa.array(hashes, pa.string()), pairs], first + len(n_cuts)


def _digested(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Columns ``DIGESTS`` and ``pairs``, a text's links counted by pair (B's id times 2^32 plus A's). ``row`` is its own for every row.

    A worker derives them from its alignments as they are made, so ids never leave it.
    """
    names = [*(f.split()[0] for f in DIGESTS.split(", ")), "pairs"]
    aligned = _aligner(path_a, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = TaskContext.get().partitionId() << 33, _digits(0)
        for batch in aligned(batches):
            most = max((pc.max(batch.column(c).flatten()).as_py() or 0) for c in ("a_ids", "b_ids"))
            if most >= len(table[1]):
                table = _digits(2 * most)
            columns, at = _digest(batch, at, table)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return lean(documents).select("doc_id", "text").mapInArrow(run, DIGESTS + ", pairs array<struct<pair: long, n: long>>")


def link_digests(documents: DataFrame, path_a: str, path_b: str, hot_share: int = HOT_SHARE) -> DataFrame:
    """Counts, group digests and corpus-wide link counts, a row per row of ``doc_id, text``."""
    done = staged(_digested(documents, path_a, path_b), "aligned")
    links = done.select("row", F.explode("pairs").alias("link")).select("row", "link.pair", "link.n")
    count = links.groupBy("pair").agg(F.sum("n").alias("count"))
    of_b = F.shiftright("pair", 32)
    count = staged(count.withColumn("b", of_b), "pair-counts", narrow=True)
    best = count.groupBy("b").agg(F.max("count").alias("most"))
    count = count.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    count = staged(count, "best-pairs", narrow=True)
    total = count.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    often = F.col("count") * hot_share > total  # of fewer than hot_share pairs
    told = links.join(F.broadcast(count.filter(often)), "pair", "left")
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    hot = told.filter(F.col("count").isNotNull()).groupBy("row").agg(*sums)
    cold = told.filter(F.col("count").isNull()).select("row", "pair", "n").join(count.filter(~often), "pair").groupBy("row").agg(*sums)
    scores = hot.unionByName(cold).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return done.drop("pairs").join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
