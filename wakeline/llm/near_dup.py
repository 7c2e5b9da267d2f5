"""Near-duplicate documents by Order MinHash and banded alignment.

Words are lower-cased; the k-mers are five-word shingles, each labelled with how often it stood in
the text before, so that a text is a sequence of distinct labelled shingles. For each of ``bands``
random orders a text's ``several`` lowest labelled shingles are taken and put back in text order;
texts that agree on one such tuple are candidates. Unlike plain MinHash this needs the shared
shingles in one order, so it follows edit similarity.

Candidates are verified by aligning the two sequences: the longest common subsequence inside the
band of diagonals that the similarity allows. ``aligned / (a + b - aligned)`` >= 0.8 is a link.

Texts with the same words are one class from the start and only its first row takes part. In a
bucket of candidates the members are compared with one pivot, not with each other; members that the
pivot does not reach meet other pivots in further rounds. What is then still apart in a bucket is
compared in blocks of a bounded size: shared shingles of all texts outside the largest component
with all texts of the bucket's neighbourhood are counted at once, and only pairs whose shared
shingles allow the similarity are aligned. So no link between different texts is lost for the sake
of a large group, no pairs are written out, and a group of n near copies takes about n alignments.

Defined results
    null and wordless texts have no shingles: such rows are copies of each other; a text of one to
    four words has one shingle; a null doc_id is kept and never the id of a class with others;
    repeated rows are copies; of a group the lowest doc_id stays, of its rows the first; an empty
    table gives no rows; all columns of the input are carried in ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import lean, staged
from .text import ALNUM, LOWER, Rolling, Spans, field, flat, mix, occurrence, pieces, shingles


@dataclass(frozen=True)
class OrderMinHash:
    k: int = 5
    several: int = 4
    bands: int = 20
    similarity: float = 0.8
    rounds: int = 2
    block_bytes: int = 6 << 20
    block_rows: int = 512
    seed: int = 11


def labelled(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labelled shingle hashes in text order, their bounds, and the word hashes with theirs."""
    offsets, data = flat(texts)
    data = LOWER[data]
    spans = Spans(data, offsets, ALNUM)
    words = Rolling(data).of(spans.start, spans.end)
    grams, bounds = shingles(words, spans.first, k)
    rank, _ = occurrence(grams, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
    return mix(grams + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), bounds, words, spans.first


def _sequence_hash(words: np.ndarray, first: np.ndarray, base: int) -> np.ndarray:
    """A hash of each text's whole word sequence."""
    out = np.zeros(len(first) - 1, np.uint64)
    n = np.diff(first)
    if len(words):
        at = (np.arange(len(words)) - np.repeat(first[:-1], n)).astype(np.uint64)
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + mix(at + np.uint64(base))), out=total[1:])
        out = total[first[1:]] - total[first[:-1]]
    return mix(out + n.astype(np.uint64))


def sketches(grams: np.ndarray, bounds: np.ndarray, how: OrderMinHash) -> np.ndarray:
    """A hash for each text and band, of its lowest shingles in text order."""
    n = np.diff(bounds)
    text_of = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), how.bands), np.uint64)
    rng = np.random.default_rng(how.seed)
    # Only values below a limit are sorted: about 32 for each text, all of them for a short one.
    share = np.minimum(1.0, (8 * how.several) / np.maximum(n, 1))
    limit = np.where(share < 1, (share * 2.0**64).clip(0, 2.0**63 * 1.99), 0).astype(np.uint64)
    limit[share >= 1] = np.uint64(2**64 - 1)
    for band in range(how.bands):
        a, b = (np.uint64(int(x) | 1) for x in rng.integers(0, 2**63, 2))
        h = (grams ^ b) * a
        h ^= h >> np.uint64(32)
        h *= b
        few = np.flatnonzero(h <= limit[text_of])
        short = np.bincount(text_of[few], minlength=len(n)) < np.minimum(n, how.several)
        if short.any():
            few = np.flatnonzero((h <= limit[text_of]) | short[text_of])
        owner = text_of[few]
        order = np.lexsort((h[few], owner))
        owner = owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        lowest = np.sort(few[order[rank < how.several]])  # back in text order
        owner = text_of[lowest]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        np.add.at(out[:, band], owner, mix(grams[lowest] + mix(place.astype(np.uint64) + np.uint64(band * how.several))))
    return mix(out + np.arange(how.bands, dtype=np.uint64)[None, :])


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Similarity of two sequences of distinct values; 0 where it cannot reach ``similarity``."""
    most = min(len(a), len(b))
    need = int(np.ceil(similarity / (1 + similarity) * (len(a) + len(b)) - 1e-9))
    if most < need or not most:
        return 0.0
    band = len(a) + len(b) - 2 * need  # insertions and deletions in all
    head = 0
    same = a[:most] == b[:most]
    head = most if same.all() else int(np.argmin(same))
    a, b, left = a[head:], b[head:], most - head
    same = a[len(a) - left :][::-1] == b[len(b) - left :][::-1]
    tail = left if same.all() else int(np.argmin(same))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    count = head + tail
    if len(a) and len(b):
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        near = np.abs(i - j) <= band
        j = j[near][np.argsort(i[near])]
        count += len(j) if (np.diff(j) > 0).all() else _increasing(j)
    total = 2 * need + band
    return count / (total - count) if count >= need else 0.0


def _increasing(values: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    from bisect import bisect_left

    ends: list[int] = []
    for v in values.tolist():
        at = bisect_left(ends, v)
        ends[at : at + 1] = [v]
    return len(ends)


def sketched(documents: DataFrame, how: OrderMinHash = OrderMinHash()) -> DataFrame:
    """``row, doc`` (all columns of the input), ``same`` (hash of the words), ``n`` shingles, ``sketch``; written out."""
    source = lean(documents).select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))
    schema = T.StructType([*source.schema.fields, T.StructField("same", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "doc.text"):
            grams, bounds, words, first = labelled(field(part, "doc.text"), how.k)
            same = np.stack([_sequence_hash(words, first, 1), _sequence_hash(words, first, 2)], axis=1)
            sketch = sketches(grams, bounds, how).view(np.int64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, sketch.size + 1, how.bands), pa.int32()), pa.array(sketch.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in same], pa.binary()), pa.array(np.diff(bounds), pa.int64()), values], names=[*part.schema.names, "same", "n", "sketch"])

    return staged(source.mapInArrow(run, schema), "sketches")


def verified(pairs: DataFrame, texts: DataFrame, how: OrderMinHash) -> DataFrame:
    """Those of the pairs ``a, b`` of rows whose texts align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "ta", "tb"):
            ga, ba, *_ = labelled(part.column("ta"), how.k)
            gb, bb, *_ = labelled(part.column("tb"), how.k)
            ok = [aligned(ga[ba[i] : ba[i + 1]], gb[bb[i] : bb[i + 1]], how.similarity) >= how.similarity - 1e-12 for i in range(part.num_rows)]
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _block_links(rows: list[pa.RecordBatch] | pa.Table, how: OrderMinHash) -> tuple[list[int], list[int]]:
    """Links between components among the ``probe`` rows and the others of one block."""
    probe = rows.column("probe").to_numpy()
    ids, component = rows.column("row").to_numpy(), rows.column("component").to_numpy()
    grams, bounds, *_ = labelled(rows.column("text"), how.k)
    n = np.diff(bounds)
    asked = np.flatnonzero(probe)
    known = np.concatenate([grams[bounds[i] : bounds[i + 1]] for i in asked]) if len(asked) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(asked)), n[asked])
    order = np.argsort(known, kind="stable")
    known, owner = known[order], owner[order]
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    a, b = [], []
    for m in np.flatnonzero(~probe).tolist():
        mine = grams[bounds[m] : bounds[m + 1]]
        low, high = np.searchsorted(known, mine, "left"), np.searchsorted(known, mine, "right")
        count = high - low
        at = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
        shared = np.bincount(owner[at], minlength=len(asked))
        for p in np.flatnonzero(shared >= how.similarity * (n[asked] + n[m] - shared) - 1e-9).tolist():
            i = int(asked[p])
            x, y = find(int(component[i])), find(int(component[m]))
            if x != y and aligned(grams[bounds[i] : bounds[i + 1]], mine, how.similarity) >= how.similarity - 1e-12:
                root[max(x, y)] = min(x, y)
                a.append(int(min(ids[i], ids[m])))
                b.append(int(max(ids[i], ids[m])))
    return a, b


def links_in_blocks(apart: DataFrame, texts: DataFrame, how: OrderMinHash) -> DataFrame:
    """Links ``a, b`` between components that meet in a bucket: ``bucket, row, component`` of the buckets with several.

    The buckets' neighbourhoods (rows that buckets connect) are cut into blocks of probes, which are
    the rows outside the largest component, times blocks of all rows; each pair of blocks is a task's
    group, no larger than two blocks in text and in rows.
    """
    star = apart.join(apart.groupBy("bucket").agg(F.min("row").alias("hub")), "bucket").select("row", "hub").distinct()
    near = components(star, "row", "hub").select(F.col("node").alias("row"), F.col("component").alias("around"))
    rows = staged(apart.select("row", "component").distinct().join(near, "row").join(texts, "row"), "apart-rows")
    sizes = rows.groupBy("around", "component").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    plan = sizes.groupBy("around").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("bytes").alias("all"), F.max_by("bytes", F.struct("n", "component")).alias("most"), F.sum("n").alias("rows"), F.max("n").alias("inner"))
    blocks = lambda b, n: F.greatest(F.lit(1), F.ceil(b / F.lit(how.block_bytes)), F.ceil(n / F.lit(how.block_rows))).cast("int")
    plan = staged(plan.select("around", "largest", blocks(F.col("all") - F.col("most"), F.col("rows") - F.col("inner")).alias("np"), blocks(F.col("all"), F.col("rows")).alias("nm")), "block-plan", narrow=True)
    placed = rows.join(plan, "around")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slot = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    probes = placed.filter("component <> largest").select("around", slot("np").alias("p"), spread("nm").alias("m"), "row", "component", "text", F.lit(True).alias("probe"))
    others = placed.select("around", spread("np").alias("p"), slot("nm").alias("m"), "row", "component", "text", F.lit(False).alias("probe"))

    def run(group: pa.Table) -> pa.Table:
        a, b = _block_links(group.combine_chunks(), how)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return probes.unionByName(others).groupBy("around", "p", "m").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(found: DataFrame, how: OrderMinHash = OrderMinHash()) -> DataFrame:
    """``row, doc_id, class_row, class_id`` of ``sketched`` rows: the row that stays of a row's group and its doc_id."""
    classes = staged(found.groupBy("same").agg(F.min("row").alias("row")), "classes", narrow=True)
    first = found.filter("n > 0").select("row", "n", "sketch").join(classes.select("row"), "row", "left_semi")
    member = first.select("row", "n", F.posexplode("sketch").alias("band", "value"))
    crowd = member.groupBy("band", "value").agg(F.count("*").alias("size"), F.min("row").alias("pivot")).filter("size > 1").drop("size")
    buckets = staged(member.join(crowd, ["band", "value"]).select("row", "n", F.xxhash64("band", "value").alias("bucket"), "pivot"), "buckets", narrow=True)
    texts = staged(found.select("row", F.col("doc.text").alias("text")).join(buckets.select("row").distinct(), "row", "left_semi"), "candidate-texts")
    fits = lambda a, b: F.least(a, b) >= how.similarity * F.greatest(a, b)

    def pair(x: str, y: str):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    tried = staged(buckets.filter("row <> pivot").select(*pair("row", "pivot")).distinct(), "pairs", narrow=True)
    links = staged(verified(tried, texts, how), "links", narrow=True)
    for turn in range(1, how.rounds + 1):
        group = staged(components(links, "a", "b"), "groups", narrow=True)
        now = buckets.join(group.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
        apart = now.groupBy("bucket").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(F.struct("row", "n", "component"), F.xxhash64("row", F.lit(turn))).alias("p")
        ).filter("low < high")
        now = staged(now.drop("pivot").join(apart.select("bucket", "p"), "bucket"), "apart", narrow=True)
        if now.isEmpty():
            break
        if turn < how.rounds:
            pairs = now.filter((F.col("component") != F.col("p.component")) & fits(F.col("n"), F.col("p.n"))).select(*pair("row", "p.row"))
            pairs = staged(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs", narrow=True)
            tried = tried.unionByName(pairs)
            links = staged(links.unionByName(verified(pairs, texts, how)), "links", narrow=True)
        else:
            links = staged(links.unionByName(links_in_blocks(now.drop("p", "n"), texts, how)), "links", narrow=True)
    group = staged(components(links, "a", "b"), "groups", narrow=True)
    of_class = classes.join(group, classes["row"] == group["node"], "left").select("same", F.coalesce("component", "row").alias("component"))
    rows = found.select("row", "same", F.col("doc.doc_id").alias("doc_id")).join(of_class, "same")
    stays = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("s"))
    return rows.join(stays.select("component", F.col("s.row").alias("class_row"), F.col("s.doc_id").alias("class_id")), "component").select("row", "doc_id", "class_row", "class_id")


def duplicate_classes(documents: DataFrame, how: OrderMinHash = OrderMinHash()) -> DataFrame:
    """``doc_id, class_id`` (the lowest doc_id of its group) and ``kept`` (one row of each group) for every row."""
    rows = near_duplicates(sketched(documents.select("doc_id", "text"), how), how)
    return rows.select("doc_id", "class_id", (F.col("row") == F.col("class_row")).alias("kept"))


def without_duplicates(documents: DataFrame, how: OrderMinHash = OrderMinHash()) -> DataFrame:
    """One row of each group, all columns."""
    found = sketched(documents, how)
    gone = near_duplicates(found, how).filter("row <> class_row").select("row")
    return found.join(gone, "row", "left_anti").select("doc.*")
