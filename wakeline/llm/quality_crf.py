"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good (1) or bad (0). Its features are rates of its own characters and
words and those of the lines beside it; neighbouring labels are tied by transition weights. Only
documents are labelled, lines are not: a document's label says that the share of good lines, weighted
by their lengths, is at least ``good_share`` or at most ``bad_share``. The fit starts without the
chain, with every line by itself labelled as its document, then takes turns (expectation-maximisation):
its own marginals, pulled no further than each document's share asks, are the labels that the whole
chain is fitted to next. So a bad footer in a good document is learnt as bad.

Every drawn document takes part: a long one gives a run of its lines, and where all together are more
than the fit can hold, all give up to the same number. A document's score is the mean of its lines'
marginal probabilities of good, weighted by their lengths; forward-backward passes run over all
documents of a slice of the input at once.

Defined results
    null, empty or wordless text: the training rows' share of good documents; texts are scored
    whole; a null doc_id is scored, not held out; repeated rows give repeated rows; a doc_id trains
    with one of its rows (of those with a word, the lowest by the text's hash); a document with
    several labels counts with the lowest; without labels of both kinds every score is that share
    (1.0 without any label); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, staged
from .text import LEADS, LOWER, SOLID, Rolling, Spans, flat, occurrence, pieces

_B = np.arange(256)
_SYMBOL = np.isin(_B, np.frombuffer(b"#*$%&<>^~{}[]\\_@=+", np.uint8))
_UPPER = (_B >= 0x41) & (_B <= 0x5A)
_LOWER = (_B >= 0x61) & (_B <= 0x7A)
_OWN = 12  # features of a line itself


@dataclass(frozen=True)
class Training:
    """What bounds the fit: at most ``rows`` labelled documents, in hash order, of at most ``lines`` lines in all (or one of each) and ``run`` of each."""

    rows: int = 4000
    lines: int = 100_000
    run: int = 500
    steps: int = 120
    turns: int = 3
    turn_steps: int = 30
    good_share: float = 0.8
    bad_share: float = 0.2
    rate: float = 0.08
    ridge: float = 1e-4
    folds: int = 5


def line_features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``x`` (a row per line that has a word), ``length`` in code points and ``first`` line of each text."""
    n_texts = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    of = np.sort(np.concatenate([np.arange(n_texts), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[end] - total[begin]

    solid = count(SOLID[data])
    full = solid > 0
    begin, end, of, solid = begin[full], end[full], of[full], solid[full]
    chars = count(LEADS[data] & SOLID[data])
    rolling = Rolling(LOWER[data])
    words = Spans(data, offsets, SOLID)
    hashes = rolling.of(words.start, words.end)
    lo, hi = np.searchsorted(words.start, begin), np.searchsorted(words.start, end)
    n = np.maximum(hi - lo, 1)

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[hi] - total[lo]

    twin = np.zeros(len(hashes), bool)
    twin[1:] = hashes[1:] == hashes[:-1]
    line_of = np.repeat(np.arange(len(lo)), hi - lo)
    repeated = occurrence(hashes, line_of)[0] > 0 if len(hashes) else np.zeros(0, bool)
    upper, lower = count(_UPPER[data]), count(_LOWER[data])
    again = occurrence(rolling.of(begin, end), of)[0] > 0
    own = np.stack([
        np.minimum(1, 6 * count(_SYMBOL[data]) / chars), np.minimum(1, 3 * count(data == 0x7C) / n), np.minimum(1, 2 * count(data == 0x21) / n),
        upper / np.maximum(upper + lower, 1), (upper > 2 * lower).astype(float), within(twin) / n, within(repeated) / n, again.astype(float),
        np.minimum(chars / n, 20) / 10, np.log1p(n) / 5, count((data >= 0x30) & (data <= 0x39)) / chars, (data[end - 1] == 0x2E).astype(float) if len(end) else np.zeros(0),
    ], axis=1) if len(of) else np.zeros((0, _OWN))
    first = np.searchsorted(of, np.arange(n_texts + 1))
    same_before = np.zeros(len(of), bool)
    same_before[1:] = of[1:] == of[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1] * same_before[1:, None]
    after[:-1] = own[1:] * same_before[1:, None]
    ends = np.stack([~same_before, ~np.append(same_before[1:], False)[: len(of)], np.ones(len(of))], axis=1).astype(float)
    return np.concatenate([own, before, after, ends], axis=1), chars, first


N_FEATURES = 3 * _OWN + 3


class Chain:
    """Weights of good against bad by feature, and of pairs of labels."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def passes(self, x: np.ndarray, first: np.ndarray, pull: np.ndarray | float = 0.0):
        """Log forward and backward sums, all texts in step: at step t only those with more than t lines."""
        unary = np.zeros((len(x), 2))
        unary[:, 1] = x @ self.weights + pull
        forward, backward = unary.copy(), np.zeros_like(unary)
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        head, longest = first[:-1][order], int(n.max(initial=0))
        active = [int(np.searchsorted(-n[order], -t, "left")) for t in range(longest + 1)]
        for t in range(1, longest):
            at = head[: active[t]] + t
            was = forward[at - 1]
            forward[at] += np.logaddexp(was[:, :1] + self.pairs[0], was[:, 1:] + self.pairs[1])
        for t in range(longest - 2, -1, -1):
            at = head[: active[t + 1]] + t
            to = unary[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(to[:, :1] + self.pairs[:, 0], to[:, 1:] + self.pairs[:, 1])
        return unary, forward, backward

    def marginals(self, x: np.ndarray, first: np.ndarray, pull: np.ndarray | float = 0.0) -> np.ndarray:
        _, forward, backward = self.passes(x, first, pull)
        log = forward + backward
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))

    def expected(self, x: np.ndarray, first: np.ndarray, pull: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probability of good, and how often each pair of labels is expected."""
        unary, forward, backward = self.passes(x, first, pull)
        n = np.diff(first)
        last = np.repeat(first[1:] - 1, n)
        total = np.logaddexp(forward[last, 0], forward[last, 1])
        inner = np.ones(len(x), bool)
        inner[first[:-1][n > 0]] = False
        inner = np.flatnonzero(inner)
        pairs = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] = np.exp(forward[inner - 1, i] + self.pairs[i, j] + unary[inner, j] + backward[inner, j] - total[inner]).sum()
        return np.exp(forward[:, 1] + backward[:, 1] - total), pairs


class Lines:
    """Training lines: features, lengths, the first line of each text and whether the text is good."""

    def __init__(self, x: np.ndarray, length: np.ndarray, first: np.ndarray, good: np.ndarray):
        self.x, self.first, self.good = x, first, good
        self.n, self.of = np.diff(first), np.repeat(np.arange(len(good)), np.diff(first))
        whole = np.bincount(self.of, length, len(good))
        self.share_of = length / np.maximum(whole, 1)[self.of]

    def share(self, p: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, p * self.share_of, len(self.good))

    def as_documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Every line labelled as its text: labels and pairs."""
        pairs = np.maximum(self.n - 1, 0)
        return self.good[self.of].astype(float), np.diag([pairs[~self.good].sum(), pairs[self.good].sum()]).astype(float)

    def pulled(self, chain: Chain, how: Training) -> tuple[np.ndarray, np.ndarray]:
        """The chain's labels and pairs under the least pull that gives each text its share."""
        weight = self.share_of * self.n[self.of]
        sign = np.where(self.good, 1.0, -1.0)
        low, high = np.zeros(len(self.good)), np.full(len(self.good), 40.0)
        kept = lambda p: np.where(self.good, self.share(p) >= how.good_share, self.share(p) <= how.bad_share)
        high[kept(chain.marginals(self.x, self.first))] = 0.0
        for _ in range(10 if high.any() else 0):
            middle = (low + high) / 2
            enough = kept(chain.marginals(self.x, self.first, (sign * middle)[self.of] * weight))
            high, low = np.where(enough, middle, high), np.where(enough, low, middle)
        return chain.expected(self.x, self.first, (sign * high)[self.of] * weight)


def fit(lines: Lines, how: Training) -> Chain:
    """Maximises the mean log-likelihood per text by Adam steps: of the documents' labels by lines alone first, then of the lines' own."""
    theta = np.zeros(N_FEATURES + 4)
    alone = np.isin(np.arange(len(theta)), [*range(_OWN), N_FEATURES - 1])  # a line's own features and the constant
    texts = max(len(lines.good), 1)
    for turn in range(how.turns + 1):
        chain = Chain(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))
        label, seen = lines.pulled(chain, how) if turn else lines.as_documents()
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, (how.steps if turn < 2 else how.turn_steps) + 1):
            chain = Chain(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))
            p, pairs = chain.expected(lines.x, lines.first)
            gradient = np.concatenate([lines.x.T @ (label - p), (seen - pairs).ravel()]) / texts - how.ridge * theta
            gradient = gradient if turn else gradient * alone
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            theta = theta + how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def line_share(lines: np.ndarray, most: int) -> int:
    """How many lines each text may give so that all together give at most ``most``; one at least."""
    n = np.sort(lines)
    if n.sum() <= most:
        return max(1, int(n.max(initial=0)))
    share = (most - (np.cumsum(n) - n)) // np.arange(len(n), 0, -1)
    return max(1, int(share[np.argmax(share < n)]))


def trained(documents: DataFrame, labels: DataFrame, how: Training = Training()) -> tuple[Chain | None, float]:
    """The chain and the share of good rows, from labelled rows that are not held out."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_held_out(F.col("doc_id"), how.folds))
    rows = rows.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    drawn = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(how.rows)

    worded = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    found = lean(documents).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    one = found.groupBy("doc_id", "h", "quality").agg(F.min_by("text", F.struct(~worded, F.xxhash64("text"))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            x, length, first = line_features(*flat(part.column("text")))
            x = np.concatenate([x, length[:, None]], axis=1)
            n = np.diff(first)
            held = np.minimum(n, how.run)
            begin = first[:-1] + part.column("h").to_numpy() % (n - held + 1)
            yield pa.RecordBatch.from_arrays(
                [part.column("h"), part.column("quality"), pa.array(held, pa.int64()), pa.array([x[a : a + m].tobytes() for a, m in zip(begin, held, strict=True)], pa.binary())],
                names=["h", "quality", "lines", "x"],
            )

    known = staged(one.select("h", "quality", "text").mapInArrow(run, "h long, quality int, lines long, x binary"), "training-lines", narrow=True)
    size = known.select("lines", "quality").toPandas()
    if not len(size):
        return None, 1.0
    share = float((size["quality"] == 1).mean())
    size = size[size["lines"] > 0]
    if size["quality"].nunique() < 2:
        return None, share
    wide = N_FEATURES + 1
    given = F.least("lines", F.lit(line_share(size["lines"].to_numpy(), how.lines)))
    run_of = F.substring("x", (F.pmod("h", F.col("lines") - given + 1) * 8 * wide + 1).cast("int"), (given * 8 * wide).cast("int"))
    got = known.filter("lines > 0").select("h", "quality", given.alias("lines"), run_of.alias("x")).toPandas().sort_values("h", kind="stable")
    x = np.concatenate([np.frombuffer(b, np.float64).reshape(-1, wide) for b in got["x"]])
    first = np.concatenate([[0], np.cumsum(got["lines"])])
    return fit(Lines(x[:, :-1], x[:, -1], first, (got["quality"] == 1).to_numpy()), how), share


def text_scores(model: tuple[Chain | None, float], texts: pa.Array) -> np.ndarray:
    """Marginals of good, weighted by the lengths of the lines."""
    chain, share = model
    if chain is None:
        return np.full(len(texts), share)
    x, length, first = line_features(*flat(texts))
    total = np.concatenate([[0.0], np.cumsum(length)])
    good = np.concatenate([[0.0], np.cumsum(length * chain.marginals(x, first))])
    weight = total[first[1:]] - total[first[:-1]]
    return np.clip(np.where(weight > 0, (good[first[1:]] - good[first[:-1]]) / np.maximum(weight, 1), share), 0.0, 1.0)


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, how: Training = Training()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``doc_id, text``."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(trained(documents, labels, how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(text_scores(model.value, part.column("text")))], names=["doc_id", "score"])

    rows = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", is_held_out(F.col("doc_id"), how.folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, how: Training = Training()) -> DataFrame:
    """The rows of ``documents``, all columns, that score ``threshold`` or more."""
    model = documents.sparkSession.sparkContext.broadcast(trained(documents, labels, how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            yield part.filter(pa.array(text_scores(model.value, part.column("text")) >= threshold))

    return documents.mapInArrow(run, documents.schema)
