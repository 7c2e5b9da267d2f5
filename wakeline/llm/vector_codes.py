"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

A vantage-point tree is built over the entries of each part position. All parts of a batch go down the
tree together: at a node the exact integer distance to the vantage entry is taken, and a child is left
out for those parts whose distance cannot come below the best one so far. Bounds are roots rounded
outwards, and a child whose bound equals the best distance is visited too, so ties are found; what
decides is the integer distance, then the lower index. A round is one pass over the vectors: every task
sums up its parts by position and entry, so what is shuffled and what reaches the driver is a row per
entry and task, and per entry.

``codebooks`` fits the entries, ``encode`` assigns, ``decode`` gives the approximated components back.

Defined results
    Null vectors and those with null, infinite or undefined components are left out. The first entries are
    those of the smallest vec_ids (nulls last, rows of equal ids by components); fewer rows than entries
    give fewer entries. All vectors must have one length that is a multiple of the number of parts, and
    components below 2^26 / 4096 in size, else an error is raised; a null vec_id or label is kept; repeated rows are rows of their own;
    an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Squared distances of parts of up to 32 components of that size stay exact in 64 bits.
LARGEST = 1 << 26
LEAF = 4
#: Labels that hold more than this share of all rows, so at most as many, are looked up by broadcast.
HOT_SHARE = 1000


@dataclass
class Node:
    """A vantage entry, or a leaf's entries. Distances of what is inside and outside lie within closed ranges."""

    entries: np.ndarray
    vantage: int = -1
    inner: tuple[float, float] = (0.0, 0.0)
    outer: tuple[float, float] = (0.0, 0.0)
    children: list[Node] = field(default_factory=list)


def _low(squared: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(squared.astype(np.float64)), -1.0), 0.0)


def _high(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(np.float64)), np.inf)


def _squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    apart = points - entry
    return np.einsum("ij,ij->i", apart, apart)


def grown(book: np.ndarray, entries: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """The tree over entries of one part position. The vantage entry is the one furthest from their mean."""
    entries = np.arange(len(book)) if entries is None else entries
    if len(entries) <= leaf:
        return Node(entries)
    far = _squared(book[entries] * len(entries), book[entries].sum(axis=0)[None, :])
    vantage = int(entries[int(far.argmax())])
    rest = entries[entries != vantage]
    apart = _squared(book[rest], book[vantage])
    order = np.argsort(apart, kind="stable")
    near, away = order[: len(rest) // 2], order[len(rest) // 2 :]
    node = Node(entries, vantage)
    node.inner = (float(_low(apart[near].min())), float(_high(apart[near].max())))
    node.outer = (float(_low(apart[away].min())), float(_high(apart[away].max())))
    node.children = [grown(book, rest[np.sort(near)], leaf), grown(book, rest[np.sort(away)], leaf)]
    return node


class Search:
    """Nearest entries of many points by one tree; ``visited`` counts the distances that were taken."""

    def __init__(self, book: np.ndarray, tree: Node | None = None):
        self.book, self.tree, self.visited = book, tree or grown(book), 0

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, ties to the lower one, and its squared distance."""
        self.points = points
        self.best = np.full(len(points), np.iinfo(np.int64).max)
        self.index = np.full(len(points), len(self.book))
        self._visit(self.tree, np.arange(len(points)))
        return self.index, self.best

    def _measure(self, entry: int, rows: np.ndarray) -> np.ndarray:
        apart = _squared(self.points[rows], self.book[entry])
        self.visited += len(rows)
        nearer = (apart < self.best[rows]) | ((apart == self.best[rows]) & (entry < self.index[rows]))
        won = rows[nearer]
        self.best[won], self.index[won] = apart[nearer], entry
        return apart

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.vantage < 0:
            for entry in node.entries:
                self._measure(int(entry), rows)
            return
        apart = self._measure(node.vantage, rows)
        low, high = _low(apart), _high(apart)
        # The least distance an entry of a child can have: how far the point lies outside the child's ring.
        bounds = [np.maximum(np.maximum(ring[0] - high, low - ring[1]), 0.0) for ring in (node.inner, node.outer)]
        inside = bounds[0] <= bounds[1]
        for first, second, part in ((0, 1, inside), (1, 0, ~inside)):
            for child in (first, second):
                # Non-strict, with the bound's own rounding taken off.
                reach = np.nextafter(bounds[child][part], -1.0) <= _high(self.best[rows[part]])
                self._visit(node.children[child], rows[part][reach])


def kept_vectors(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, label, whole``: integer components of the vectors that have only finite ones."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.filter(v.isNotNull() & finite).select("vec_id", "label", whole.alias("whole"))


def _checked(whole: DataFrame, parts: int) -> int:
    """The vectors' common length; 0 without rows."""
    found = whole.agg(F.min(F.size("whole")), F.max(F.size("whole")), F.max(F.aggregate("whole", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x))))).first()
    if found[0] is None:
        return 0
    if found[0] != found[1] or found[0] % parts:
        raise ValueError(f"vectors have {found[0]} to {found[1]} components: one length that {parts} divides is needed")
    if found[2] > LARGEST or found[0] // parts > 512:
        raise ValueError("components or parts are too large for exact squared distances")
    return found[0]


def _matrix(column: pa.ListArray, parts: int) -> np.ndarray:
    """Rows, parts, components."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), parts, len(flat) // max(len(column), 1) // parts)


def _sums(whole: DataFrame, books: np.ndarray) -> list:
    """How many parts fall to each entry and their sums: ``part, entry, n, total``. A task hands out one row per entry."""
    parts, entries, width = books.shape
    shared = whole.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(book) for book in shared.value]
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            rows = _matrix(batch.column("whole"), parts)
            for p, search in enumerate(searches):
                points = np.ascontiguousarray(rows[:, p])
                index, _ = search(points)
                order = np.argsort(index, kind="stable")
                used, begin = np.unique(index[order], return_index=True)
                n[p] += np.bincount(index, minlength=entries)
                if len(used):
                    total[p, used] += np.add.reduceat(points[order], begin, axis=0)
        part, entry = np.nonzero(n)
        values = total[part, entry]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(values.ravel()))],
            names=["part", "entry", "n", "total"],
        )

    found = whole.select("whole").mapInArrow(run, "part int, entry int, n long, total array<long>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(width))).alias("total")).collect()  # at most parts x entries rows


def codebooks(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Entries by part position: ``parts, entries, components``. ``whole`` is read once a round."""
    size = _checked(whole, parts)
    if not size:
        return np.zeros((parts, 0, 0), np.int64)
    first = whole.select("vec_id", "whole").orderBy(F.asc_nulls_last("vec_id"), "whole").limit(entries).collect()
    books = np.array([r["whole"] for r in first], np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(whole, books):
            books[r["part"], r["entry"]] = np.array(r["total"], np.int64) // r["n"]  # floors
    return books


def encode(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code`` (an index per part) and ``error``, the squared distances summed over parts."""
    parts = len(books)
    shared = whole.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(book) for book in shared.value]
        for batch in batches:
            rows = _matrix(batch.column("whole"), parts)
            found = [search(np.ascontiguousarray(rows[:, p])) for p, search in enumerate(searches)]
            code = np.stack([f[0] for f in found], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1) * parts, pa.int32()), pa.array(code.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists, pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "code", "error"])

    kinds = dict(whole.dtypes)
    return whole.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``vector``: the entries' components, scaled back to the middle of their steps."""
    table = F.array(*(F.array(*(F.array(*(F.lit((int(x) + 0.5) / scale) for x in entry)) for entry in book)) for book in books))
    whole = F.flatten(F.transform("code", lambda c, i: F.get(F.get(table, i), c)))
    return codes.withColumn("vector", whole)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """``codes`` with ``label_error``, the error summed over rows of an equal label, nulls together.

    Labels of more than one in ``hot_share`` rows, which are fewer than that, are looked up where the rows
    stand; the rest, none of which can be hot, are joined by a shuffle.
    """
    sums = staged(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors", narrow=True)
    total = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    often = F.col("_n") * hot_share > total
    hot, rest = (sums.filter(f).select(F.col("label").alias("_label"), "label_error") for f in (often, ~often))
    told = codes.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    others = told.filter("label_error is null").drop("label_error").join(rest, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return told.filter("label_error is not null").unionByName(others)


def compressed(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes and errors of all kept vectors, and the codebooks."""
    whole = staged(kept_vectors(vectors, vector), "whole-vectors")
    books = codebooks(whole, parts, entries, rounds)
    return staged(encode(whole, books), "vector-codes"), books


def code_digests(codes: DataFrame, books: np.ndarray) -> DataFrame:
    text = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return with_label_error(codes).select("vec_id", text.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
