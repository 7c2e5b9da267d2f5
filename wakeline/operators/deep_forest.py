"""Forests grown to full depth by all tasks, without a model that has to fit one place.

A tree that grows until its leaves are pure is as large as its table. So large nodes are split level by
level: every task adds up the class counts by bin of its rows in each open node, and a row per node comes
back. A node of few rows is handed on: its rows meet in one task, which grows the rest of that tree
there. What is asked of the forest (votes for rows that a tree did not see, or importances) is
answered in that task, so only votes leave it.

Rows are numbered once by block and place there, and stored in strips of a few hundred. A block's rows of a node travel
as one row that holds their bins, and its votes come back as one, so no row of Spark's stands for a ping and a tree.

As in Spark's forests, splits are by Gini impurity between 32 bins of about equally many rows, among
features that are drawn for each node, and samples are Poisson; draws are by hashes and seeded
by tree and node, so a result does not depend on how rows are dealt. Rows whose label is null are not learnt from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import staged

#: Thresholds of a feature and one.
BINS = 32
#: Rows of a node that one task grows.
SMALL = 100_000
#: Trees grow until their nodes are pure or small, or so deep.
DEEPEST = 30
#: Rows of a block at most, and rows times trees.
BLOCK, BLOCK_VOTES = 1 << 16, 1 << 23
#: Rows that are stored together, which divides a block.
STRIP = 512
#: Rows that a task looks at together, so that they stay in the cache.
FEWER = 1 << 14
#: Rows times trees that a task of the last step is to hold.
TASK = 1_000_000
#: Nodes whose cells are summed up in one task, and those whose splits are compared at once.
SLICE, FEW = 64, 256
#: Below which a uniform number draws a row 0, 1, 2 times and so on.
OFTEN = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(9)]).tolist()


def drawn(key: str, seed: int, tree: Column) -> Column:
    """How often a bootstrap sample as large as the table holds a row: Poisson with mean 1, by a hash of row and tree."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed), tree), F.lit(1 << 53)) / F.lit(float(1 << 53))
    out = F.lit(0)
    for below in OFTEN:
        out = out + (u >= below).cast("int")
    return out.cast("byte")


def _drawn(hashes: np.ndarray) -> np.ndarray:
    """The same from the hashes of row and tree."""
    u = hashes & ((1 << 53) - 1)
    out = np.zeros(u.shape, np.int8)
    for below in OFTEN:
        out += u >= below * (1 << 53)
    return out


# --- splits ------------------------------------------------------------------


def _cells(flat: np.ndarray, start: np.ndarray, label: np.ndarray, weight: np.ndarray, node: np.ndarray, chosen: np.ndarray, classes: int) -> np.ndarray:
    """Weights by class, node, chosen feature and bin. ``start``: where in ``flat`` a row's bins begin."""
    n, tries = chosen.shape
    at = (label * n + node) * BINS
    out = np.empty((classes, n, tries, BINS))
    for s in range(tries):
        out[:, :, s] = np.bincount(at + flat.take(chosen[:, s].take(node) + start), weight, classes * n * BINS).reshape(classes, n, BINS)
    return out


def _best(cells: np.ndarray, chosen: np.ndarray, min_node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each node's feature, last bin on the left, fall of impurity times weight (0: no split), and class weights on the left. A few nodes at a time, whose cells stay in the cache."""
    if len(chosen) > FEW:
        found = [_best(cells[:, a : a + FEW], chosen[a : a + FEW], min_node) for a in range(0, len(chosen), FEW)]
        return tuple(np.concatenate(f) for f in zip(*found, strict=True))
    left = cells.cumsum(axis=3)
    whole = left[:, :, 0, -1]
    total = whole.sum(axis=0)
    n = left.sum(axis=0)
    m = total[:, None, None] - n
    fits = (n >= max(min_node, 1)) & (m >= max(min_node, 1))
    right = whole[:, :, None, None] - left
    fall = np.square(left).sum(axis=0) / np.maximum(n, 1.0)
    fall += np.square(right).sum(axis=0) / np.maximum(m, 1.0)
    fall -= (np.square(whole).sum(axis=0) / np.maximum(total, 1.0))[:, None, None]
    fall = np.where(fits, fall, 0.0).reshape(len(chosen), -1)
    at = np.rint(fall * 1e9).argmax(axis=1)
    every, slot, cut = np.arange(len(chosen)), at // BINS, at % BINS
    fall = fall[every, at]
    return chosen[every, slot], cut, np.where(fall > 1e-9 * total, fall, 0.0), left[:, every, slot, cut].T


def _chosen(rng: np.random.Generator, nodes: int, features: int, tries: int) -> np.ndarray:
    """Features drawn for each node, in order, so that ties go to the first."""
    return np.sort(rng.random((nodes, features)).argsort(axis=1)[:, :tries], axis=1)


def _grown(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, tries: int, min_node: int, depth: int, rng: np.random.Generator, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """A tree from the rows of ``weight`` over 0: the shares of classes in each row's leaf, and the falls of impurity by feature.

    Nodes of a level are those that are not pure; a row that meets a leaf takes its number and is not looked at again.
    """
    width = bins.shape[1]
    flat, falls = np.ascontiguousarray(bins).ravel(), np.zeros(width)
    counts = np.bincount(label, weight, classes)[None, :]
    leaves, leaf, closed = [], np.zeros(len(bins), np.int64), 0

    def close(nodes: np.ndarray) -> np.ndarray:
        """Numbers of new leaves, from -1 downwards."""
        nonlocal closed
        leaves.append(nodes)
        closed += len(nodes)
        return len(nodes) - closed - 1 - np.arange(len(nodes))

    mixed = lambda nodes: nodes.max(axis=1) < nodes.sum(axis=1)
    if depth <= 0 or not mixed(counts)[0]:
        return np.tile(counts / max(counts.sum(), 1e-300), (len(bins), 1)), falls
    learnt = weight > 0
    sides = [(rows, rows * width, np.zeros(len(rows), np.int64)) for rows in (np.flatnonzero(learnt), np.flatnonzero(~learnt))]
    label, weight = label[learnt], weight[learnt]
    for level in range(1, depth + 1):
        n = len(counts)
        chosen = _chosen(rng, n, width, tries)
        _, start, node = sides[0]
        if n <= block:
            feature, cut, fall, left = _best(_cells(flat, start, label, weight, node, chosen, classes), chosen, min_node)
        else:
            order, found = np.argsort(node, kind="stable"), []
            for a in range(0, n, block):
                some, few = order[slice(*np.searchsorted(node, [a, a + block], sorter=order))], chosen[a : a + block]
                found.append(_best(_cells(flat, start[some], label[some], weight[some], node[some] - a, few, classes), few, min_node))
            feature, cut, fall, left = (np.concatenate(f) for f in zip(*found, strict=True))
        falls += np.bincount(feature, fall, width)
        split = fall > 0
        below = np.stack([left, counts - left], axis=1)[split].reshape(-1, classes)
        open_ = mixed(below) & (level < depth)
        child = np.cumsum(open_) - 1
        child[~open_] = close(below[~open_])
        to = np.zeros((n, 2), np.int64)
        to[split] = child.reshape(-1, 2)
        to[~split] = close(counts[~split])[:, None]
        to, counts = to.ravel(), below[open_]
        for i, (rows, start, node) in enumerate(sides):
            node = to.take(2 * node + (flat.take(feature.take(node) + start) > cut.take(node)))
            if to.min() < 0:
                goes = node >= 0
                leaf[rows[~goes]] = node[~goes]
                rows, start, node = rows[goes], start[goes], node[goes]
                if i == 0:
                    label, weight = label[goes], weight[goes]
            sides[i] = rows, start, node
        if not len(counts):
            break
    leaves = np.concatenate(leaves)
    return (leaves / leaves.sum(axis=1)[:, None]).take(-1 - leaf, axis=0), falls


# --- large nodes, by all tasks -----------------------------------------------


class _Top:
    """The large nodes of a tree: feature, last bin on the left, children (a leaf is its own), class weights."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.depth, self.counts = [], [], [], [], [], []

    def add(self, depth: int, counts: np.ndarray | None) -> int:
        here = len(self.feature)
        for held, value in ((self.feature, 0), (self.cut, 0), (self.left, here), (self.right, here), (self.depth, depth), (self.counts, counts)):
            held.append(value)
        return here

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(a) for a in (self.feature, self.cut, self.left, self.right))


def _at(tree: tuple[np.ndarray, ...], flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The large tree's leaf that each row stands in. ``start``: where in ``flat`` its bins begin."""
    feature, cut, left, right = tree
    below = np.stack([left, right], axis=1).ravel()
    at = np.zeros(len(start), np.int64)
    going, here = None, at
    while len(here):
        to = below.take(2 * here + (flat.take(feature.take(here) + start) > cut.take(here)))
        goes = to != here
        if going is not None:
            at[going] = to
        else:
            at = to
        if goes.all():
            here = to
        else:
            going = np.flatnonzero(goes) if going is None else going[goes]
            here, start = to[goes], start[goes]
    return at


def _boxes(top: _Top, nodes: list[int], width: int) -> np.ndarray:
    """The first and last bin of each feature (by side, node, feature) that rows of the nodes have, by the splits above."""
    above = {}
    for v, (left, right) in enumerate(zip(top.left, top.right, strict=True)):
        if left != v:
            above |= {left: (v, 1), right: (v, 0)}
    out = np.stack([np.zeros((len(nodes), width), np.int64), np.full((len(nodes), width), BINS - 1)])
    for i, v in enumerate(nodes):
        while v in above:
            v, side = above[v]
            f, cut = top.feature[v], top.cut[v]
            out[side, i, f] = min(out[1, i, f], cut) if side else max(out[0, i, f], cut + 1)
    return out


def _pairs(bins: np.ndarray) -> list[np.ndarray]:
    """The bins of two features as one number, for the first two, the next and so on."""
    bins = bins.astype(np.int64)
    return [bins[:, f] * BINS + (bins[:, f + 1] if f + 1 < bins.shape[1] else 0) for f in range(0, bins.shape[1], 2)]


def _masks(boxes: np.ndarray) -> list[list[np.ndarray | None]]:
    """For each 64 nodes: for each pair of features which nodes each pair of bins allows, as bits; nothing where it allows all."""
    out = []
    for a in range(0, boxes.shape[1], 64):
        first, last = boxes[:, a : a + 64]
        bit, bins = np.uint64(1) << np.arange(len(first), dtype=np.uint64), np.arange(BINS)
        may = (first[:, :, None] <= bins) & (bins <= last[:, :, None])
        may = np.where(may, bit[:, None, None], np.uint64(0)).sum(axis=0, dtype=np.uint64)
        may = np.concatenate([may, np.full((1, BINS), bit.sum(), np.uint64)])
        both = [(may[f][:, None] & may[f + 1][None, :]).ravel() for f in range(0, first.shape[1], 2)]
        out.append([bit.sum(), *(None if (m == bit.sum()).all() else m for m in both)])
    return out


def _met(masks: list, pairs: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``rows`` that stand in a node, and the node's number; nodes do not overlap, so a row has one bit at most."""
    found = []
    for i, (every, *tables) in enumerate(masks):
        mask = np.full(len(rows), every)
        for table, pair in zip(tables, pairs, strict=True):
            if table is not None:
                mask &= table.take(pair.take(rows))
        hits = np.flatnonzero(mask)
        found.append((rows.take(hits), np.frexp(mask.take(hits).astype(float))[1].astype(np.int64) - 1 + 64 * i))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _held(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """All that the strings of a binary column hold, one behind the other."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)


def _binary(rows: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """A string for each row of an array, or for the rows up to each of ``ends``."""
    rows = np.ascontiguousarray(rows)
    each = rows.dtype.itemsize * math.prod(rows.shape[1:])
    ends = np.arange(1, len(rows) + 1) if ends is None else ends
    offsets = np.concatenate([[0], ends]).astype(np.int32) * np.int32(each)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _blocks(batches: Iterator[pa.RecordBatch], trees: int, width: int, mixed: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Block, places, labels, how often each tree sees a row and bins, of about ``FEWER`` rows that come behind each other, of one block unless ``mixed``."""

    def joined() -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        block, first, label, seen, bins = zip(*held, strict=True)
        label = [np.frombuffer(x, np.int32) for x in label]
        place = np.concatenate([np.arange(a, a + len(x), dtype=np.int32) for a, x in zip(first, label, strict=True)])
        seen = np.concatenate([np.frombuffer(x, np.int8).reshape(trees, -1) for x in seen], axis=1)
        return block[0], place, np.concatenate(label).astype(np.int64), seen, np.frombuffer(b"".join(bins), np.uint8).reshape(-1, width)

    held, n = [], 0
    for batch in batches:
        for strip in zip(*(batch.column(c).to_pylist() for c in ("block", "first", "label", "seen", "bins")), strict=True):
            if held and (n >= FEWER or not mixed and held[0][0] != strip[0]):
                yield joined()
                held, n = [], 0
            held.append(strip)
            n += len(strip[2]) // 4
    if held:
        yield joined()


class DeepForest:
    """A forest over ``df``, grown anew by each question. ``label_values`` are the classes.

    ``fold``: a column of folds 1 to ``folds``; then there are ``trees`` trees for each, which learn from the other
    folds and are asked about their own. Without it trees are asked about the rows that they did not draw.
    """

    def __init__(self, df: DataFrame, features: list[str], label: str = "behaviour", key: str = "rec_id", trees: int = 500, min_node: int = 1, mtry: int | None = None, seed: int = 1, depth: int = DEEPEST, fold: str | None = None, folds: int = 1, small: int = SMALL):
        self.label_values = [r[0] for r in df.filter(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]
        self.features, self.key, self.trees, self.min_node, self.seed, self.depth, self.small = features, key, trees * folds, min_node, seed, depth, small
        self.classes, self.tries = max(1, len(self.label_values)), mtry or max(1, math.isqrt(len(features)))
        code = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in self.label_values] or [F.lit("")]), F.col(label)) - 1, F.lit(-1)).cast("int")
        shares = [i / BINS for i in range(1, BINS)]
        cuts = df.agg(*[F.percentile_approx(f, shares).alias(f"q{i}") for i, f in enumerate(features)]).first()
        cuts = [np.unique(np.array(q or [], float)) for q in cuts]
        hashes = F.array(*[F.xxhash64(F.col(key), F.lit(seed), F.lit(t)) for t in range(self.trees)])
        rows = df.select(F.col(key).alias("key"), code.alias("label"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), hashes.alias("hashes"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
        n, whose = self.trees, np.arange(self.trees) // trees + 1
        block = max(1, min(BLOCK, BLOCK_VOTES // n) // STRIP) * STRIP

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, done = TaskContext.get().partitionId() << 40, 0
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
                seen = _drawn(batch.column("hashes").flatten().to_numpy().reshape(-1, n))
                label = batch.column("label").to_numpy()
                seen[label < 0] = 0  # not learnt from
                seen[batch.column("fold").to_numpy(zero_copy_only=False)[:, None] == whose if fold else seen == 0] = -1  # the tree is asked about the row
                label = np.maximum(label, 0)
                edges = np.unique([0, *range(STRIP - done % STRIP, len(label), STRIP), len(label)])
                strips = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                first = done + edges[:-1]
                done += len(label)
                arrays = [pa.array(task + first // block), pa.array((first % block).astype(np.int32)), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), batch.column("key"))]
                arrays += [pa.array([x[at].T.tobytes() for at in strips], pa.binary()) for x in (label, seen)] + [pa.array([bins[at].tobytes() for at in strips], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "first", "key", "label", "seen", "bins"])

        self.kind, self.said = rows.schema["key"].dataType, df.schema[label].dataType
        schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("key", T.ArrayType(self.kind)), *[T.StructField(c, T.BinaryType()) for c in ("label", "seen", "bins")]])
        self.data = staged(rows.mapInArrow(binned, schema), "binned")
        self.small_label = np.uint8 if self.classes <= 256 else np.int32
        self.rows = self.data.agg(F.sum(F.size("key"))).first()[0] or 0
        self.falls: list[tuple[int, int, float]] = []
        self.top = self._large()

    def _rng(self, tree: int, node: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, tree, node])

    def _large(self) -> list[_Top]:
        tops = [_Top() for _ in range(self.trees)]
        for top in tops:
            top.add(0, None)
        if self.rows <= self.small:
            return tops
        dealt = self._dealt("block", "first").persist(StorageLevel.DISK_ONLY)  # read for each level
        going = [(t, 0) for t in range(self.trees)]
        while going:
            open_ = {}
            for t, node in going:
                open_.setdefault(t, []).append(node)
            found = self._level(dealt, tops, open_)
            going = []
            for r in found:
                top, node = tops[r["tree"]], r["node"]
                whole, left = np.array(r["whole"]), np.array(r["left"])
                top.counts[node] = whole
                if r["fall"] <= 0:
                    continue
                self.falls.append((r["tree"], r["feature"], r["fall"]))
                top.feature[node], top.cut[node] = r["feature"], r["cut"]
                depth = top.depth[node] + 1
                top.left[node], top.right[node] = (top.add(depth, c) for c in (left, whole - left))
                for child in (top.left[node], top.right[node]):
                    c = top.counts[child]
                    if c.sum() > self.small and c.max() < c.sum() and depth < self.depth:
                        going.append((r["tree"], child))
        dealt.unpersist()
        return tops

    def _dealt(self, *by: str | Column) -> DataFrame:
        """The strips without their keys, over a few tasks for each core: files are read by too few, and not evenly."""
        return self.data.drop("key").repartition(4 * self.data.sparkSession.sparkContext.defaultParallelism, *by)

    def _level(self, dealt: DataFrame, tops: list[_Top], open_: dict[int, list[int]]) -> list:
        """The best split of each open node: a row for each."""
        width, n, classes, tries, least = len(self.features), self.trees, self.classes, self.tries, self.min_node
        trees = {t: (_boxes(tops[t], nodes, width), np.array(nodes), np.concatenate([_chosen(self._rng(t, v), 1, width, tries) for v in nodes])) for t, nodes in open_.items()}
        sent = self.data.sparkSession.sparkContext.broadcast(trees)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, masks = {}, {t: _masks(boxes) for t, (boxes, _, _) in sent.value.items()}
            for _, _, label, seen, bins in _blocks(batches, n, width, True):
                flat, pairs = bins.ravel(), _pairs(bins)
                for t, (_, _, chosen) in sent.value.items():
                    rows, at = _met(masks[t], pairs, np.flatnonzero(seen[t] > 0))
                    more = _cells(flat, rows * width, label.take(rows), seen[t].take(rows), at, chosen, classes)
                    if t in cells:
                        cells[t] += more
                    else:
                        cells[t] = more
            for t, found in cells.items():
                slices = range(0, found.shape[1], SLICE)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slices), t)), pa.array(np.array(slices)), pa.array([found[:, a : a + SLICE].tobytes() for a in slices], pa.binary())], names=["tree", "first", "cells"])

        def split(key: tuple, table: pa.Table) -> pa.Table:
            t, a = (k.as_py() for k in key)
            _, nodes, chosen = sent.value[t]
            nodes, chosen = nodes[a : a + SLICE], chosen[a : a + SLICE]
            cells = _held(table["cells"], np.float64).reshape(-1, classes, len(nodes), tries, BINS).sum(axis=0)
            feature, cut, fall, left = _best(cells, chosen, least)
            return pa.table({"tree": np.full(len(nodes), t), "node": nodes, "feature": feature, "cut": cut, "fall": fall, "left": left.tolist(), "whole": cells[:, :, 0].sum(axis=2).T.tolist()})

        parts = dealt.mapInArrow(counted, "tree long, first long, cells binary")
        found = parts.groupBy("tree", "first").applyInArrow(split, "tree long, node long, feature long, cut long, fall double, left array<double>, whole array<double>")
        return sorted(found.collect(), key=lambda r: (r["tree"], r["node"]))

    def _handed(self, sent, asked: bool) -> DataFrame:
        """A row for each piece of a block and each large tree's leaf in it, with the bins, labels and draws of the piece's rows there.

        Rows that are only ``asked`` about come along or not. A leaf that has nothing to grow gets no others, which are dealt over many tasks.
        """
        width, n, kind = len(self.features), self.trees, self.small_label

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ended = [np.isin(np.arange(len(tree[0])), list(closed)) for tree, _, closed in sent.value]
            for number, place, label, seen, bins in _blocks(batches, n, width):
                flat, label = bins.ravel(), label.astype(kind)
                for t, (tree, _, _) in enumerate(sent.value):
                    rows = np.flatnonzero(seen[t] != 0 if asked else seen[t] > 0)
                    node = _at(tree, flat, rows * width)
                    often = seen[t].take(rows)
                    needed = (often < 0) | ~ended[t].take(node)
                    rows, node, often = rows[needed], node[needed], often[needed]
                    if not len(rows):
                        continue
                    order = np.argsort(node.astype(np.min_scalar_type(len(ended[t]))), kind="stable")
                    rows, node, often = rows[order], node[order], often[order]
                    last = np.append(np.flatnonzero(np.diff(node)), len(node) - 1)
                    of = node[last]
                    part = np.where(ended[t].take(of), (number + int(place[0]) // FEWER) % 256, 0)
                    names = {"tree": pa.array(np.full(len(of), t, np.int32)), "node": pa.array(of), "part": pa.array(part), "block": pa.array(np.full(len(of), number))}
                    names |= {"often": _binary(often, last + 1), "label": _binary(label.take(rows), last + 1), "bins": _binary(bins.take(rows, axis=0), last + 1)}
                    names["place"] = _binary(place.take(rows[often < 0]), np.cumsum(often < 0)[last])
                    yield pa.RecordBatch.from_pydict(names)

        return self._dealt("block", F.expr(f"first div {FEWER}")).mapInArrow(placed, "tree int, node long, part long, block long, often binary, label binary, bins binary, place binary")

    def _rest(self, answer, schema: T.StructType, asked: bool) -> DataFrame:
        """``answer(tree, table, shares, falls)`` of the rest of every tree, each in one task.

        The table has a row for each piece of a block: the block, ``place`` of the rows asked about, and how many they are; ``shares`` are theirs.
        """
        width, n, classes, tries, least, deepest, seed = len(self.features), self.trees, self.classes, self.tries, self.min_node, self.depth, self.seed
        small, kind = self.small, self.small_label
        ends = [{v: c for v, c in enumerate(top.counts) if c is not None and top.left[v] == v and (c.max() == c.sum() or c.sum() > small or top.depth[v] >= deepest)} for top in self.top]
        sent = self.data.sparkSession.sparkContext.broadcast([(top.arrays(), np.array(top.depth), e) for top, e in zip(self.top, ends, strict=True)])

        def grown(key: tuple, table: pa.Table) -> pa.Table:
            t, node = key[0].as_py(), key[1].as_py()
            _, depth, closed = sent.value[t]
            often = _held(table["often"], np.int8)
            if node in closed:
                shares, falls = np.tile(closed[node] / closed[node].sum(), (len(often), 1)), np.zeros(width)
            else:
                shares, falls = _grown(_held(table["bins"], np.uint8).reshape(-1, width), _held(table["label"], kind).astype(np.int64), np.maximum(often, 0).astype(float), classes, tries, least, deepest - int(depth[node]), np.random.default_rng([seed, t, int(node), 1]))
            asks = table.select(["block", "place"]).append_column("n", pa.array(pc.binary_length(table["place"]).to_numpy() // 4))
            return answer(t, asks, shares[often < 0], falls)

        spark = self.data.sparkSession
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, self.rows * n // TASK)
        return self._handed(sent, asked).repartition(tasks, "tree", "node", "part").groupBy("tree", "node", "part").applyInArrow(grown, schema)

    def votes(self, soft: bool = False) -> DataFrame:
        """The key, ``predicted`` and ``n_votes`` of the rows that a tree is asked about: by the majority of those trees, or by the sum of their leaves' shares (``soft``). Ties go to the first class."""
        classes, key = self.classes, self.key
        named = pa.array(self.label_values or [None], to_arrow_type(self.said))

        def answer(_: int, asks: pa.Table, shares: np.ndarray, falls: np.ndarray) -> pa.Table:
            if not soft:
                shares = np.eye(classes)[shares.argmax(axis=1)] * (shares.sum(axis=1) > 0)[:, None]
            ends = np.cumsum(asks["n"].to_numpy())
            said = asks.select(["block", "place"]).append_column("shares", _binary(shares, ends))
            return said.filter(pa.array(asks["n"].to_numpy() > 0))

        def summed(rows: pa.Table, said: pa.Table) -> pa.Table:
            at, shares = _held(said["place"], np.int32), _held(said["shares"], np.float64).reshape(-1, classes)
            keys, sizes = rows["key"].combine_chunks().flatten(), pc.list_value_length(rows["key"]).to_numpy()
            place = np.repeat(rows["first"].to_numpy() - np.cumsum(sizes) + sizes, sizes) + np.arange(len(keys))
            n = int(place.max(initial=-1)) + 1
            sums = np.stack([np.bincount(at, shares[:, c], n) for c in range(classes)], axis=1).round(9)[place]
            votes = np.bincount(at, shares.sum(axis=1) > 0, n).astype(np.int64)[place]
            found = pa.table([keys, named.take(pa.array(sums.argmax(axis=1))), pa.array(votes)], names=[key, "predicted", "n_votes"])
            return found.filter(pa.array(votes > 0))

        said = self._rest(answer, T.StructType([T.StructField("block", T.LongType()), T.StructField("place", T.BinaryType()), T.StructField("shares", T.BinaryType())]), True)
        kind = T.StructType([T.StructField(key, self.kind), T.StructField("predicted", self.said), T.StructField("n_votes", T.LongType())])
        return self.data.select("block", "first", "key").groupBy("block").cogroup(said.groupBy("block")).applyInArrow(summed, kind)

    def importance(self) -> DataFrame:
        """``feature, importance``: falls of impurity by feature, each tree's to a sum of 1, and theirs too."""

        def answer(t: int, _: pa.Table, shares: np.ndarray, falls: np.ndarray) -> pa.Table:
            return pa.table({"tree": np.full(len(falls), t), "place": np.arange(len(falls)), "fall": falls})  # trees of nothing but large leaves have none

        spark = self.data.sparkSession
        schema = T.StructType([T.StructField("tree", T.LongType()), T.StructField("place", T.LongType()), T.StructField("fall", T.DoubleType())])
        each = self._rest(answer, schema, False).unionByName(spark.createDataFrame([*self.falls, *((0, i, 0.0) for i in range(len(self.features)))], schema)).groupBy("tree", "place").agg(F.sum("fall").alias("fall"))
        each = staged(each, "falls", narrow=True)  # a row per tree and feature
        share = each.join(F.broadcast(each.groupBy("tree").agg(F.sum("fall").alias("all"))), "tree").groupBy("place").agg(F.sum(F.coalesce(F.try_divide("fall", "all"), F.lit(0.0))).alias("share"))
        whole = F.broadcast(share.agg(F.sum("share").alias("all")))
        named = spark.createDataFrame(list(enumerate(self.features)), "place long, feature string")
        return named.join(share, "place").join(whole).select("feature", F.coalesce(F.try_divide("share", "all"), F.lit(0.0)).alias("importance")).orderBy(F.desc("importance"), "feature")
