"""Quality rules: exact statistics of every text, judged by fixed limits and an isolation forest.

The forest is grown on a bounded sample of rows (that is what an isolation forest is: each tree
splits ``per_tree`` rows at random); its anomaly score is taken of every document. The sample is drawn
by a hash of a row's id and statistics, with a limit that follows from the number of rows, so every
row has the same chance; rows equal in both count once. The score above which a document goes is
calibrated on all labelled rows: of the scores that cost at most ``most_good_lost`` of the good ones,
the one with the largest share of bad ones caught less that of good ones lost.

Defined results
    null or wordless text: all statistics 0, fails the base rules; texts are read whole; a null
    doc_id is kept but has no label; repeated rows give repeated rows; a document with several
    labels counts with the lowest; rows of equal statistics are judged alike, and a score at the threshold
    goes; without labelled rows of both kinds, or where no threshold parts them (one row, or equal rows
    only), nothing is anomalous; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, staged
from .text import LEADS, SOLID, Rolling, Spans, flat, occurrence, pieces, shingles, sums

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
WINDOW = 5


def text_stats(offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """The five statistics of each text."""
    words = Spans(data, offsets, SOLID)
    solid = SOLID[data]
    rolling = Rolling(data)
    text = np.arange(len(offsets) - 1)
    # Lines: a break ends one, as does the end of a text.
    breaks = np.flatnonzero(data == 0x0A)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    of = np.sort(np.concatenate([text, owner]), kind="stable")
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=seen[1:])
    full = seen[end] > seen[begin]
    begin, end, of = begin[full], end[full], of[full]
    again = occurrence(rolling.of(begin, end), of)[0] > 0
    # Windows that occur twice or more cover words.
    hashes = rolling.of(words.start, words.end)
    grams, bounds = shingles(hashes, words.first, WINDOW)
    whole = np.diff(words.first) >= WINDOW
    gram_of = np.repeat(text, np.diff(bounds))
    repeated = (occurrence(grams, gram_of)[1] > 1) & whole[gram_of]
    covered = np.zeros(len(hashes) + WINDOW, bool)
    at = (np.flatnonzero(repeated) - bounds[:-1][gram_of[repeated]]) + words.first[:-1][gram_of[repeated]]
    for j in range(WINDOW):
        covered[at + j] = True
    return [
        np.diff(words.first), sums(solid & LEADS[data], offsets), sums(_SYMBOL[data], offsets),
        np.bincount(of[again], minlength=len(text)), sums(covered[: len(hashes)], words.first),
    ]


def rule_stats(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics, a row per row of ``doc_id, text``."""
    schema = pa.schema([(f.split()[0], pa.int64()) for f in STATS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            found = text_stats(*flat(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in found)], schema=schema)

    return lean(documents).select("doc_id", "text").mapInArrow(run, STATS)


def features(words, chars, symbols, lines, repeats) -> np.ndarray:
    n = np.maximum(words, 1)
    return np.stack([np.log1p(words), chars / n, np.log1p(symbols) - np.log1p(n), symbols / n, lines / n, repeats / n], axis=1).astype(np.float64)


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, trees: int, per_tree: int, seed: int) -> dict[str, np.ndarray]:
    """Trees as arrays: feature, threshold, children; a leaf is its own child and holds its path length."""
    rng = np.random.default_rng(seed)
    deepest = int(np.ceil(np.log2(max(per_tree, 2))))
    feature, cut, left, right, path, roots = [], [], [], [], [], []

    def node(x: np.ndarray, depth: int) -> int:
        here = len(feature)
        for column, value in ((feature, 0), (cut, 0.0), (left, here), (right, here), (path, depth + float(_mean_path(len(x))))):
            column.append(value)
        wide = np.flatnonzero(np.ptp(x, axis=0) > 0) if len(x) > 1 else []
        if depth < deepest and len(wide):
            feature[here] = int(rng.choice(wide))
            values = x[:, feature[here]]
            cut[here] = float(rng.uniform(values.min(), values.max()))
            below = values <= cut[here]
            left[here] = node(x[below], depth + 1)
            right[here] = node(x[~below], depth + 1)
        return here

    for _ in range(trees):
        roots.append(node(rows[rng.choice(len(rows), min(per_tree, len(rows)), replace=False)], 0))
    return {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left), "right": np.array(right), "path": np.array(path), "roots": np.array(roots), "depth": deepest, "norm": float(_mean_path(min(per_tree, len(rows)))) or 1.0}


def anomaly(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """2 to the power of minus the mean path length over its expectation."""
    total = np.zeros(len(x))
    for root in forest["roots"]:
        at = np.full(len(x), root)
        for _ in range(forest["depth"]):
            below = x[np.arange(len(x)), forest["feature"][at]] <= forest["cut"][at]
            at = np.where(below, forest["left"][at], forest["right"][at])
        total += forest["path"][at]
    return np.exp2(-total / len(forest["roots"]) / forest["norm"])


def scored(stats: DataFrame, trees: int = 100, per_tree: int = 256, sample_rows: int = 20_000, seed: int = 7) -> DataFrame:
    """``stats`` with ``anomaly``. The driver grows trees on about ``sample_rows`` rows at most."""
    names = [f.split()[0] for f in STATS.split(", ")][1:]
    drawn = stats.filter("n_words > 0").select("doc_id", *names)
    n = drawn.count()
    if n > sample_rows:
        drawn = drawn.filter(F.pmod(F.xxhash64("doc_id", *names, F.lit(seed)), F.lit(1 << 32)) < int(sample_rows / n * (1 << 32)))
    drawn = drawn.distinct().toPandas().sort_values(["doc_id", *names], kind="stable")
    if not len(drawn):
        return stats.withColumn("anomaly", F.lit(0.0))
    forest = stats.sparkSession.sparkContext.broadcast(grow(features(*(drawn[c].to_numpy(np.float64) for c in names)), trees, per_tree, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anomaly(forest.value, x))], names=[*batch.schema.names, "anomaly"])

    return stats.select("doc_id", *names).mapInArrow(run, STATS + ", anomaly double")


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def calibrated(rows: DataFrame, labels: DataFrame, most_good_lost: float = 0.02, bins: int = 2000) -> float:
    """The score that parts labelled rows best and loses no more than that share of the good ones (the lowest of equal ones); infinite where none does."""
    quality = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = rows.filter(~base_failed()).join(quality, "doc_id").groupBy(F.floor(F.col("anomaly") * bins).alias("bin"), "quality").count().toPandas()
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for b, q, n in counts.dropna().itertuples(index=False):
        (good if q == 1 else bad)[int(b)] += n
    if not good.sum() or not bad.sum():
        return float("inf")
    lost = good[::-1].cumsum()[::-1] / good.sum()
    caught = bad[::-1].cumsum()[::-1] / bad.sum()
    gain = np.where(lost <= most_good_lost, caught - lost, -1.0)
    return float(np.argmax(gain)) / bins if gain.max() > 0 else float("inf")


def judge_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, ``base_failed``, ``anomaly`` and ``kept`` for every row of ``doc_id, text``."""
    stats = staged(rule_stats(documents), "rule-stats")
    rows = staged(scored(stats), "anomalies")
    limit = calibrated(rows, labels)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))
