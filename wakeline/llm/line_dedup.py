"""Line dedup over the whole corpus: equal lines by hash, near-equal ones by a segment-partition join.

Of lines that are equal or within ``edits`` insertions, deletions and substitutions of code points,
those that have an earlier one go. Order is by doc_id, row, line number. Lines without a word
(white space only) always stay.

Two lines within ``edits`` edits have at least one of ``edits + 1`` even segments of the shorter one
in common, near its place. So every distinct line of ``least_chars`` or more is indexed by its segments
(with its length and the segment's number) and probed by those substrings of it that can match a
segment of a line of its own or a slightly lesser length; equal keys are candidates, verified by a
banded bit-parallel edit distance.

A key that more than ``crowded`` lines are indexed by makes no pairs, so a probe meets at most that
many lines. Its lines are compared with the earliest of them, which settles near copies of one line in
a row each. For those still open the key is refined: outside the segment that two lines share they
differ by ``edits`` at most, so the rest of each is cut into segments and probed in the same way.
Refined keys that are crowded are settled by their earliest line too, and what is open then is
compared in blocks of bounded size inside tasks, open lines with all, where lengths and counts of
characters rule out nearly all pairs before the distance is taken.

Defined results
    null text: one empty line; a null doc_id comes last in the order; repeated rows: later ones lose
    all lines; ties in doc_id are ordered by row; lines of under ``least_chars`` code points are
    dropped only where equal; texts and lines are whole; an empty table gives no rows; all columns
    of the input are carried in ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean, staged
from .text import LEADS, SOLID, Rolling, field, flat, mix, pieces


@dataclass(frozen=True)
class LineDedup:
    edits: int = 2
    least_chars: int = 20
    crowded: int = 8  # indexed lines under one key, above which they are not paired
    block: int = 1500  # lines on either side of a block
    most_broadcast: int = 500_000  # keys sent to all tasks; more are joined by a shuffle

    def __post_init__(self) -> None:
        if self.least_chars < 4 * (self.edits + 1):
            raise ValueError("lines must be four times as long as they have segments")


class Strings:
    """Whole strings as byte and code point ranges with their rolling hash."""

    def __init__(self, texts: pa.Array):
        offsets, self.data = flat(texts)
        self.rolling = Rolling(self.data)
        self.point = np.append(np.flatnonzero(LEADS[self.data]), len(self.data))
        at = np.searchsorted(self.point, offsets)
        self.c0, self.chars = at[:-1], np.diff(at)


class Lines:
    """The lines of some texts that have a word: text, number, byte and code point ranges, keys."""

    def __init__(self, texts: pa.Array, whole_key: bool = True):
        offsets, data = flat(texts)
        self.data, n = data, len(offsets) - 1
        breaks = np.flatnonzero(data == 0x0A)
        begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
        of = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")
        number = np.arange(len(of)) - np.searchsorted(of, of)
        self.per_text = np.bincount(of, minlength=n)
        seen = np.zeros(len(data) + 1, np.int64)
        np.cumsum(SOLID[data], out=seen[1:])
        full = seen[end] > seen[begin]
        self.begin, self.end, self.of, self.number = begin[full], end[full], of[full], number[full]
        self.rolling = Rolling(data)
        key = self.rolling.of(self.begin, self.end)
        self.k1 = key.view(np.int64)
        if whole_key:  # the second half of the key: another function of the same bytes
            other = Rolling(np.bitwise_xor(data, 0x5A))
            self.k2 = mix(other.of(self.begin, self.end) + np.uint64(7)).view(np.int64)
        self.point = np.append(np.flatnonzero(LEADS[data]), len(data))
        self.c0, c1 = np.searchsorted(self.point, self.begin), np.searchsorted(self.point, self.end)
        self.chars = c1 - self.c0


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the i-th of even parts, the longer ones last."""
    base, extra = length // parts, length % parts
    longer = np.maximum(i - (parts - extra), 0)
    return i * base + longer, base + (i >= parts - extra)


def _cuts(length: np.ndarray, edits: int, probe: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """``valid, start, size, i, indexed length`` of the substrings that a line is indexed or probed by."""
    parts = edits + 1
    for i in range(parts):
        if not probe:
            start, size = segment(length, i, parts)
            yield size > 0, start, size, i, length
            continue
        for shorter in range(edits + 1):
            start, size = segment(np.maximum(length - shorter, 0), i, parts)
            low = max(-i, shorter - (edits - i))
            high = min(i, shorter + (edits - i))
            for shift in range(low, high + 1):
                at = start + shift
                yield (length >= shorter) & (size > 0) & (at >= 0) & (at + size <= length), at, size, i, length - shorter


def _keys(lines: Lines | Strings, which: np.ndarray, how: LineDedup, probe: bool, shorter: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each cut the segment keys of the lines ``which``, the places of those lines there, where in them the cut is, and by how much the indexed line is shorter.

    ``shorter``: by how much it is for each line, where that is known; other cuts can meet nothing.
    """
    length, c0 = lines.chars[which], lines.c0[which]
    for ok, at, size, i, indexed in _cuts(length, how.edits, probe):
        less = length - indexed
        if shorter is not None:
            ok = ok & (less == shorter)
        at, size, indexed, c = at[ok], size[ok], indexed[ok], c0[ok]
        key = mix(lines.rolling.of(lines.point[c + at], lines.point[c + at + size]) + mix(indexed.astype(np.uint64) * np.uint64(64) + np.uint64(i)))
        yield key.view(np.int64), np.flatnonzero(ok), at, size, less[ok]


class Recent:
    """Keys that a task has met lately: one to a slot, so its size is fixed."""

    def __init__(self, slots: int = 1 << 18):
        self.slots = np.zeros(slots, np.int64)

    def fresh(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys that are not known to have been met, each once; they are met then."""
        _, first = np.unique(keys, return_index=True)
        at = keys[first] & (len(self.slots) - 1)
        new = first[self.slots[at] != keys[first]]
        self.slots[keys[new] & (len(self.slots) - 1)] = keys[new]
        return np.sort(new)


def probe_rows(texts: DataFrame, how: LineDedup) -> DataFrame:
    """``seg, other`` of all lines long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Recent()
        for part in pieces(batches):
            lines = Lines(part.column("text"), whole_key=False)
            which = np.flatnonzero(lines.chars >= how.least_chars)
            which = which[met.fresh(lines.k1[which])]
            for seg, owner, *_ in _keys(lines, which, how, True):
                yield pa.RecordBatch.from_arrays([pa.array(seg), pa.array(lines.k1[which[owner]])], names=["seg", "other"])

    return texts.mapInArrow(run, "seg long, other long")


def rest_rows(crowd: DataFrame, how: LineDedup) -> DataFrame:
    """``seg, probe, line`` of what is left of ``seg, probe, line, said`` beside the segment that makes the key.

    A key tells how long the lines are that are indexed by it, so a probe is cut for rests of that length alone:
    at most ``edits + 1`` rows for an indexed line and, at two edits, five for a probe.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "said"):
            asked, probe = part.column("seg").to_numpy(), part.column("probe").to_numpy(zero_copy_only=False)
            said, line = part.column("said").to_pylist(), part.column("line").to_numpy()
            whole = Strings(part.column("said"))
            for kind in (False, True):
                which = np.flatnonzero(probe == kind)
                for seg, owner, at, size, less in _keys(whole, which, how, kind):
                    hit = seg == asked[which[owner]]
                    rows = which[owner[hit]]
                    if not len(rows):
                        continue
                    rest = Strings(pa.array([said[r][:a] + "\n" + said[r][a + n :] for r, a, n in zip(rows.tolist(), at[hit].tolist(), size[hit].tolist(), strict=True)], pa.string()))
                    for finer, of, *_ in _keys(rest, np.arange(len(rows)), how, kind, less[hit]):
                        of = rows[of]
                        key = mix(finer.view(np.uint64) + mix(asked[of].view(np.uint64))).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(of), kind)), pa.array(line[of])], names=["seg", "probe", "line"])

    return crowd.select("seg", "probe", "line", "said").mapInArrow(run, "seg long, probe boolean, line long").distinct()


_COUNTERS = 61


def _later(block: pa.Table, how: LineDedup) -> np.ndarray:
    """Which of the rows that are ``open`` have an earlier line within the edits among all rows of the block."""
    asks = block.column("open").to_numpy()
    k1, k2 = block.column("k1").to_numpy(), block.column("k2").to_numpy()
    order = np.lexsort([block.column(c).to_numpy() for c in ("number", "row", "doc", "none")])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    said = block.column("said").to_pylist()
    size = np.array([len(x) for x in said])
    counts = np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) % _COUNTERS, minlength=_COUNTERS) for x in said]).astype(np.int32)
    later = np.zeros(len(said), bool)
    others = np.flatnonzero(~asks)
    asked = np.flatnonzero(asks)
    for some in np.array_split(asked, max(1, len(asked) // 32)):
        p, i = np.nonzero((np.abs(size[some][:, None] - size[others][None, :]) <= how.edits) & (rank[others][None, :] < rank[some][:, None]))
        p, i = some[p], others[i]
        for at in np.array_split(np.arange(len(p)), len(p) // 20_000 + 1):
            x, y = p[at], i[at]
            ok = (np.abs(counts[x] - counts[y]).sum(axis=1) <= 2 * how.edits) & ((k1[x] != k1[y]) | (k2[x] != k2[y])) & ~later[x]
            x, y = x[ok], y[ok]
            if len(x):
                later[x[within([said[a] for a in x.tolist()], [said[b] for b in y.tolist()], how.edits)]] = True
    return later


_PLACE = ["none", "doc", "row", "number"]


def later_in_blocks(rows: DataFrame, how: LineDedup) -> DataFrame:
    """``k1, k2`` of those of ``seg, k1, k2, said, open`` and their places that are open and have an earlier line under a key."""
    rows = staged(rows, "crowded-lines")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(how.block))).cast("int")
    plan = rows.groupBy("seg").agg(blocks(F.count_if("open")).alias("no"), blocks(F.count("*")).alias("na"))
    placed = rows.join(plan, "seg")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda n: F.pmod(F.xxhash64("k1", "k2"), F.col(n)).cast("int")
    columns = ["seg", "k1", "k2", "said", *_PLACE]
    asking = placed.filter("open").select(slot("no").alias("o"), spread("na").alias("a"), *columns, F.lit(True).alias("open"))
    asked = placed.select(spread("no").alias("o"), slot("na").alias("a"), *columns, F.lit(False).alias("open"))

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        return block.select(["k1", "k2"]).filter(pa.array(_later(block, how)))

    return asking.unionByName(asked).groupBy("seg", "o", "a").applyInArrow(run, "k1 long, k2 long").distinct()


def _core(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """What two strings have between their common beginning and their common end, as code points."""
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    most = min(len(x), len(y))
    other = x[:most] != y[:most]
    head = int(other.argmax()) if other.any() else most
    x, y, most = x[head:], y[head:], most - head
    other = x[len(x) - most :][::-1] != y[len(y) - most :][::-1]
    tail = int(other.argmax()) if other.any() else most
    return x[: len(x) - tail], y[: len(y) - tail]


def within(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Which pairs are within ``edits`` edits: one bit per diagonal of the band, one word per number of errors.

    What the two have in common at either end takes no edits, so only what is between is compared.
    """
    out = np.zeros(len(a), bool)
    band = (1 << (2 * edits + 1)) - 1
    near = [p for p in range(len(a)) if abs(len(a[p]) - len(b[p])) <= edits]
    cores = {p: _core(a[p], b[p]) for p in near}
    la, lb = (np.array([len(cores[p][side]) for p in near], np.int64) for side in (0, 1))
    near = np.array(near, np.int64)
    order = np.argsort(la, kind="stable")
    # As many pairs at once as fit a bounded table, whose width is that of the longest.
    begin = 0
    while begin < len(order):
        end = len(order)
        while end > begin + 1 and (end - begin) * (la[order[end - 1]] + 2 * edits + 1) > 1 << 20:
            end = begin + (end - begin + 1) // 2
        at, begin = order[begin:end], end
        n, wide = la[at], int(la[at].max())
        x, y = np.zeros((wide, len(at)), np.uint32), np.zeros((wide + 2 * edits + 1, len(at)), np.uint32)
        for c, p in enumerate(at.tolist()):
            x[: la[p], c], y[edits : edits + lb[p], c] = cores[int(near[p])]
            y[edits : edits + lb[p], c] += 1
        x += 1  # 0 stands for no character
        reach = [np.full(len(at), 1 << edits, np.int64)]
        for _ in range(edits):
            reach.append((reach[-1] | (reach[-1] << 1)) & band)
        done = np.zeros((edits + 1, len(at)), np.int64)
        for i in range(wide + 1):
            stop = n == i
            if stop.any():
                for e in range(edits + 1):
                    done[e, stop] = reach[e][stop]
            if i == wide or not i % 32 and not any(r.any() for r in reach):
                break
            match = np.zeros(len(at), np.int64)
            for d in range(2 * edits + 1):
                match |= (x[i] == y[i + d]).astype(np.int64) << d
            now = [reach[0] & match]
            for e in range(1, edits + 1):
                now.append(((reach[e] & match) | reach[e - 1] | (reach[e - 1] >> 1) | (now[e - 1] << 1)) & band)
            reach = now
        goal = np.int64(1) << (lb[at] - n + edits)
        out[near[at]] = ((done & goal[None, :]) != 0).any(axis=0)
    return out


def line_table(numbered: DataFrame, how: LineDedup) -> DataFrame:
    """``row, doc_id, number, k1, k2, segs``: a row for each line with a word (``segs``: its segments' keys, if it is long enough).

    For each text there is a row of number -1 with its count of ``lines``.
    """
    schema = "row long, doc_id long, number long, k1 long, k2 long, lines long, segs array<long>"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            lines = Lines(part.column("text"))
            ids, n = part.select(["row", "doc_id"]), part.num_rows
            own = ids.take(pa.array(lines.of))
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(np.full(n, -1)), none, none, pa.array(lines.per_text, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=names)
            long = lines.chars >= how.least_chars
            segs = np.array([seg for seg, *_ in _keys(lines, np.flatnonzero(long), how, False)], np.int64).reshape(how.edits + 1, -1)
            bounds = np.concatenate([[0], np.cumsum(long * (how.edits + 1))]).astype(np.int32)
            segs = pa.ListArray.from_arrays(pa.array(bounds), pa.array(segs.T.ravel()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(lines.number, pa.int64()), pa.array(lines.k1), pa.array(lines.k2), pa.nulls(len(own), pa.int64()), segs], names=names)

    return staged(numbered.select("row", "doc_id", "text").mapInArrow(run, schema), "lines")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _met(index: DataFrame, probe: DataFrame, how: LineDedup) -> tuple[DataFrame, DataFrame]:
    """``a, b`` of the lines that meet under keys that are not crowded, and ``seg, probe, line`` under those that are.

    ``index``: ``seg, line``, ``probe``: ``seg, other``. A crowded key stands on the index side by one
    row without a line; no key has more than ``crowded`` rows there, so that side is hashed, not sorted.
    """
    crowds = staged(index.groupBy("seg").count().filter(F.col("count") > how.crowded).select("seg"), "crowded", narrow=True)
    few = index.join(crowds, "seg", "left_anti").unionByName(crowds.withColumn("line", F.lit(None).cast("long")))
    met = staged(probe.join(few.hint("shuffle_hash"), "seg").filter("line is null or line <> other").distinct(), "met", narrow=True)
    pairs = met.filter("line is not null").select(*_pair("line", "other"))
    crowd = met.filter("line is null").select("seg", F.lit(True).alias("probe"), F.col("other").alias("line"))
    return pairs, crowd.unionByName(index.join(crowds, "seg").select("seg", F.lit(False).alias("probe"), "line"))


def later_lines(texts: DataFrame, firsts: DataFrame, how: LineDedup) -> DataFrame:
    """``k1, k2`` of the lines that have an earlier one within ``edits``; ``firsts``: where each line stands first, and its segments."""
    place = firsts.select("k1", "k2", F.col("first.none").cast("int").alias("none"), F.coalesce("first.doc_id", F.lit(0)).alias("doc"), "first.row", "first.number")
    order = F.struct(*_PLACE)

    def earliest(crowd: DataFrame) -> DataFrame:
        """``seg, k1, k2, none, doc, row, number``, and ``e``, the earliest line's k1, of the lines under crowded keys."""
        rows = crowd.select("seg", F.col("line").alias("k1")).distinct().join(place, "k1")
        rows = staged(rows, "crowds", narrow=True)
        return rows.join(rows.groupBy("seg").agg(F.min_by("k1", order).alias("e")), "seg")

    def settled(rows: DataFrame, links: DataFrame) -> DataFrame:
        """Keys and ``open`` lines: those that no link says are later, and that are not the earliest; keys without any go."""
        done = links.select("k1", "k2", F.lit(True).alias("done"))
        rows = rows.join(done, ["k1", "k2"], "left").withColumn("open", F.col("done").isNull() & (F.col("k1") != F.col("e"))).drop("done")
        return staged(rows.join(rows.filter("open").select("seg").distinct(), "seg", "left_semi"), "open-keys", narrow=True)

    def asked(crowd: DataFrame, rows: DataFrame) -> DataFrame:
        """``seg, probe, line`` of what can tell that an open line is later: open lines, and those that stand before one of the other side."""
        sides = crowd.join(rows.select("seg", F.col("k1").alias("line"), "open", order.alias("place")), ["seg", "line"])
        last = lambda probe: F.max(F.when(F.col("open") & (F.col("probe") == probe), F.col("place")))
        ends = sides.groupBy("seg").agg(last(False).alias("indexed"), last(True).alias("probed"))
        before = F.when(F.col("probe"), F.col("place") < F.col("indexed")).otherwise(F.col("place") < F.col("probed"))
        return sides.join(ends, "seg").filter(F.col("open") | before).select("seg", "probe", "line").distinct()

    def later(links: DataFrame) -> DataFrame:
        fa, fb = firsts.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("first").alias("fa")), firsts.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("first").alias("fb"))
        both = links.join(fa, ["a1", "a2"]).join(fb, ["b1", "b2"])
        key = F.when(F.col("fa") < F.col("fb"), F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2"))).otherwise(F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2")))
        return both.select(key.alias("k")).select("k.*").distinct()

    index = firsts.filter("segs is not null").select(F.explode("segs").alias("seg"), F.col("k1").alias("line"))
    pairs, crowd = _met(index, probe_rows(texts, how), how)
    crowd = staged(crowd, "crowd", narrow=True)
    rows = earliest(crowd)
    stars = lambda rows: rows.filter("k1 <> e").select(*_pair("k1", "e"))
    pairs = staged(pairs.unionByName(stars(rows)).distinct(), "line-pairs", narrow=True)
    said = said_by(texts, pairs, how)
    found = staged(later(near_links(said, pairs, how)), "later", narrow=True)

    rows = settled(rows, found)
    if rows.isEmpty():
        return found
    # Finer keys for what is open under crowded ones.
    finer = asked(crowd, rows).join(said.select(F.col("k1").alias("line"), F.col("line").alias("said")), "line")
    finer = staged(rest_rows(finer, how), "finer-keys", narrow=True)
    pairs, crowd = _met(finer.filter("not probe").select("seg", "line"), finer.filter("probe").select("seg", F.col("line").alias("other")), how)
    rows = earliest(crowd)
    pairs = staged(pairs.unionByName(stars(rows)).distinct(), "line-pairs", narrow=True)
    found = staged(found.unionByName(later(near_links(said, pairs, how))).distinct(), "later", narrow=True)
    rows = settled(rows, found)
    if rows.isEmpty():
        return found
    rows = rows.join(said.withColumnRenamed("line", "said"), ["k1", "k2"]).select("seg", "k1", "k2", "said", "open", *_PLACE)
    return found.unionByName(later_in_blocks(rows, how)).distinct()


def said_by(texts: DataFrame, pairs: DataFrame, how: LineDedup) -> DataFrame:
    """``k1, k2, line`` of the lines that stand in ``pairs``."""
    keys = staged(pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct(), "line-keys", narrow=True)
    few = keys.count() <= how.most_broadcast
    wanted = texts.sparkSession.sparkContext.broadcast(np.sort(keys.toPandas()["k1"].to_numpy(np.int64))) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Recent()
        for part in pieces(batches):
            lines = Lines(part.column("text"))
            which = np.flatnonzero(lines.chars >= how.least_chars)
            if wanted is not None and len(wanted.value):
                at = np.minimum(np.searchsorted(wanted.value, lines.k1[which]), len(wanted.value) - 1)
                which = which[wanted.value[at] == lines.k1[which]]
            which = which[met.fresh(lines.k1[which] ^ lines.k2[which])]
            data = lines.data.tobytes()
            words = [data[b:e] for b, e in zip(lines.begin[which].tolist(), lines.end[which].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lines.k1[which]), pa.array(lines.k2[which]), pa.array(words, pa.binary()).cast(pa.string())], names=["k1", "k2", "line"])

    said = texts.mapInArrow(run, "k1 long, k2 long, line string")
    said = said if few else said.join(keys, "k1", "left_semi")
    return staged(said.groupBy("k1", "k2").agg(F.first("line").alias("line")), "candidate-lines")


def near_links(said: DataFrame, pairs: DataFrame, how: LineDedup) -> DataFrame:
    """``a1, a2, b1, b2``: keys of those of the pairs ``a, b`` of lines that are within ``edits``."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "la", "lb"):
            ok = within(part.column("la").to_pylist(), part.column("lb").to_pylist(), how.edits)
            yield part.select(["a1", "a2", "b1", "b2"]).filter(pa.array(ok))

    left = said.toDF("a1", "a2", "la")
    right = said.toDF("b1", "b2", "lb")
    both = pairs.join(left, pairs["a"] == left["a1"]).join(right, pairs["b"] == right["b1"])
    return both.select("a1", "a2", "b1", "b2", "la", "lb").mapInArrow(verify, "a1 long, a2 long, b1 long, b2 long")


def dropped_lines(numbered: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:
    """``row, doc_id, text`` to ``row, doc_id, n_lines, n_equal, n_near, dropped`` (array of line numbers), a row per row."""
    lines = line_table(lean(numbered), how)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "number")
    long = F.size("segs") > 0
    firsts = lines.filter("number >= 0").groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first(F.when(long, F.col("segs"))).alias("segs"))
    firsts = staged(firsts, "first-lines")
    later = later_lines(numbered.select("text"), firsts, how).withColumn("near", F.lit(True))
    fate = staged(firsts.drop("segs").join(later, ["k1", "k2"], "left").filter("n > 1 or near").drop("n"), "fates", narrow=True)
    each = lines.filter("number >= 0").select("row", "doc_id", "number", "k1", "k2").join(fate, ["k1", "k2"])
    equal = F.col("first.row").eqNullSafe(F.col("row")) & (F.col("first.number") == F.col("number"))
    each = each.select("row", "doc_id", "number", (~equal).alias("equal"), (equal & F.col("near").isNotNull()).alias("near"), F.lit(None).cast("long").alias("lines"))
    marks = lines.filter("number < 0").select("row", "doc_id", "number", F.lit(False).alias("equal"), F.lit(False).alias("near"), "lines")
    return each.filter("equal or near").unionByName(marks).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("lines").alias("n_lines"), F.count_if("equal").alias("n_equal"), F.count_if("near").alias("n_near"),
        F.array_sort(F.collect_list(F.when(F.col("equal") | F.col("near"), F.col("number")))).alias("dropped"),
    )


def line_report(documents: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:
    """What goes of every row of ``doc_id, text``."""
    numbered = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return dropped_lines(numbered, how).drop("row")


def without_repeated_lines(documents: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:
    """``documents``, all columns, with what stays of ``text`` and ``n_chars`` to match; a text that loses all its lines with words goes."""
    source = documents.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))
    source = staged(source, "numbered")
    gone = dropped_lines(source.select("row", "doc.doc_id", "doc.text"), how).filter("size(dropped) > 0").select("row", "dropped")
    joined = source.join(gone, "row", "left").select("doc", "dropped")
    schema = T.StructType([T.StructField("text_", T.StringType()), *joined.schema.fields[:1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "doc.text"):
            texts, keep = [], []
            for text, dropped in zip(field(part, "doc.text").to_pylist(), part.column("dropped").to_pylist(), strict=True):
                if dropped:
                    out = set(dropped)
                    text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in out)
                keep.append(not dropped or bool(text.strip("\x20\t\n\x0b\x0c\r")))
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), part.column("doc")], names=["text_", "doc"]).filter(pa.array(keep, pa.bool_()))

    rows = joined.mapInArrow(run, schema)
    changed = {"text": F.col("text_")} | ({"n_chars": F.length("text_").cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {})
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"doc.`{c}`").alias(c) for c in documents.columns])
