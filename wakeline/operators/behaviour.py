"""Fishing or not from speed: thresholds, mixtures, hidden Markov models and clusters, fitted per vessel.

The fits are small iterations on one vessel's pings. A task takes its vessels' rows in track order and
fits many vessels at once, as arrays with a column per vessel; rows pass through whole, so nothing is
joined back. Fits end when the log-likelihood changes by under ``STOP``, or after ``PASSES``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import ms2kn
from ..functions.order import micros, track
from ..functions.runs import whole_groups
from ..sources.scratch import staged
from . import long_tracks
from .chains import PASSES, STOP, Chains, hidden_markov
from .track import step_turn

#: Pings of a vessel up to which its hidden Markov model is fitted in one task.
MOST = 200_000
#: Pings of vessels whose models are fitted side by side: few vessels need many passes, so a pass over a few costs little if they come from many.
TOGETHER = 200_000


def classify_speed(df: DataFrame, lo: float = 1.0, hi: float = 5.0) -> DataFrame:
    return df.withColumn("fishing", F.when(F.col("speed").isNotNull(), F.col("speed").between(lo, hi)))


# --- vessels side by side ----------------------------------------------------


def whole_vessels(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that hold all rows of their vessels, with the vessels' bounds."""
    return whole_groups(batches, rows, "vessel_id")


def like_lengths(n: np.ndarray) -> Iterator[np.ndarray]:
    """Vessels in groups, in each of which none has more than twice the rows of another."""
    kind = np.floor(np.log2(np.maximum(n, 1))).astype(int)
    for k in np.unique(kind):
        yield np.flatnonzero(kind == k)


def padded(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A column for each vessel, nan below its end."""
    out = np.full((int(n.max(initial=0)), len(n)), np.nan)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[at, np.repeat(np.arange(len(n)), n)] = values[at + np.repeat(begin, n)]
    return out


def _fitted(d: DataFrame, fit: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType, rows: int = 50_000) -> DataFrame:
    """``fit(table, bounds)`` on all vessels' rows in track order, about ``rows`` at a time. ``d`` is partitioned by vessel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_vessels(batches, rows):
            yield from fit(table, bounds).to_batches()

    return d.sortWithinPartitions("vessel_id", "time_stamp", "rec_id").mapInArrow(run, schema)


def _steps(df: DataFrame) -> DataFrame:
    """Steps, turns, seconds and knots to the next ping."""
    d = step_turn(df)
    w = track()
    sec = (F.lead(micros("time_stamp")).over(w) - micros("time_stamp")) / F.lit(1e6)
    d = d.withColumn("dura", sec)
    return d.withColumn("step_speed", ms2kn(F.try_divide(F.col("step") * 1000, F.col("dura"))))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)


# --- mixtures ----------------------------------------------------------------


def normal_mixtures(x: np.ndarray, often: np.ndarray, mu, sigma) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for each column's values, counted ``often``, with equal weights at the start: weights, means, deviations, a row for each."""
    v = x.shape[1]
    mu, sigma = (np.broadcast_to(np.array(a, float), (v, np.shape(a)[-1])).copy() for a in (mu, sigma))
    weight, last = np.full(mu.shape, 1 / mu.shape[1]), np.full(v, -np.inf)
    x = np.where(often > 0, x, 0.0)
    live = np.arange(v)
    for _ in range(PASSES):
        if not len(live):
            break
        value, count = x[:, None, live], often[:, live]
        z = (value - mu[live].T) / sigma[live].T
        log = np.log(weight[live]).T - z * z / 2 - np.log(sigma[live] * math.sqrt(2 * math.pi)).T
        top = log.max(axis=1)
        share = np.exp(log - top[:, None])
        total = share.sum(axis=1)
        share *= (count / total)[:, None]
        n = share.sum(axis=0).T + 1e-12
        weight[live], mu[live] = n / n.sum(axis=1, keepdims=True), (share * value).sum(axis=0).T / n
        sigma[live] = np.maximum(np.sqrt((share * (value - mu[live].T) ** 2).sum(axis=0).T / n), 1e-3)
        fit = (count * (np.log(total) + top)).sum(axis=0)
        going = np.abs(fit - last[live]) >= STOP
        last[live] = fit
        live = live[going]
    return weight, mu, sigma


_MODES = T.StructType([T.StructField("vessel_id", T.StringType()), T.StructField("mode", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("lambda", "mu", "sigma")]])


def _mixtures_of(steps: DataFrame, mu, sigma, unit: float) -> DataFrame:
    """Speeds are counted by vessel first, in steps of ``unit`` knots, so a vessel's fit is no larger for more pings."""
    counted = steps.filter("step_speed is not null").groupBy("vessel_id", F.round(F.col("step_speed") / unit).alias("value")).agg(F.count("*").alias("n"))
    each = counted.groupBy("vessel_id").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("values"), F.sum("n").alias("n")).filter(F.col("n") >= len(mu))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("values")
            value, n = held.flatten().field("value").to_numpy() * unit, held.flatten().field("n").to_numpy().astype(float)
            size = held.value_lengths().to_numpy()
            begin = np.cumsum(size) - size
            for some in like_lengths(size):
                found = normal_mixtures(padded(value, begin[some], size[some]), np.nan_to_num(padded(n, begin[some], size[some])), mu, sigma)
                order = np.argsort(found[1], axis=1, kind="stable")
                ids = batch.column("vessel_id").take(pa.array(np.repeat(some, len(mu))))
                modes = pa.array(np.tile(np.arange(1, len(mu) + 1), len(some)), pa.int32())
                yield pa.RecordBatch.from_arrays([ids, modes, *(pa.array(np.take_along_axis(a, order, 1).ravel()) for a in found)], names=_MODES.names)

    return each.select("vessel_id", "values").mapInArrow(run, _MODES)


def mixture_params(df: DataFrame, mu=(1.0, 4.0, 8.0), sigma=(1.0, 1.0, 1.0), unit: float = 0.001) -> DataFrame:
    """``vessel_id, mode, lambda, mu, sigma`` of the mixture of each vessel's step speeds; modes by mean."""
    return _mixtures_of(_steps(df), mu, sigma, unit)


def gaussian_speed(df: DataFrame, mu=(1.0, 4.0, 8.0), sigma=(1.0, 1.0, 1.0), cs: float = 1.96, unit: float = 0.001) -> DataFrame:
    """Pings with ``step, angle, dura, step_speed`` and the thresholds ``lower, upper``: the first mode's mean and cs deviations."""
    d = staged(_steps(df), "steps")
    limits = _mixtures_of(d, mu, sigma, unit).filter("mode = 1").select("vessel_id", (F.col("mu") - cs * F.col("sigma")).alias("lower"), (F.col("mu") + cs * F.col("sigma")).alias("upper"))
    return d.join(limits, "vessel_id", "left")


# --- hidden Markov models ----------------------------------------------------


def _start(x: np.ndarray, often: np.ndarray, mu, sigma) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations from a mixture of values counted ``often``, started at ``mu, sigma``, the second deviation less a quarter, the third and two.

    A vessel whose steps are of another size, so that the mixture leaves a mode with under a thousandth of
    them, starts again with both scaled to its mean and deviation.
    """
    weight, m, s = normal_mixtures(x, often, mu, sigma)
    poor = np.flatnonzero(weight.min(axis=1) < 1e-3)
    if len(poor):
        value, n = np.where(often[:, poor] > 0, x[:, poor], 0.0), often[:, poor].sum(axis=0)
        mean = (value * often[:, poor]).sum(axis=0) / n
        deviation = np.sqrt(((value - mean) ** 2 * often[:, poor]).sum(axis=0) / n)
        up = np.maximum(1e-3, mean / np.mean(mu))[:, None]
        wide = np.maximum(1e-3, deviation / np.mean(sigma) / 2)[:, None]
        _, m[poor], s[poor] = normal_mixtures(x[:, poor], often[:, poor], np.array(mu) * up, np.array(sigma) * wide)
    order = np.argsort(m, axis=1, kind="stable")
    m, s = np.maximum(np.take_along_axis(m, order, 1), 1.0), np.take_along_axis(s, order, 1)
    return m, np.maximum(s * np.array([1, 0.75, 1]) + np.array([0, 0, 2.0]), 1.0)


def _chains_of(table: pa.Table, bounds: np.ndarray, mu, sigma, turns, passes: int = PASSES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Chains]]:
    """For groups of vessels with enough known steps: which they are, the rows of their steps, the states there and the chains."""
    metres, angle = _column(table, "step") * 1000, _column(table, "angle")
    known = np.flatnonzero(~np.isnan(metres))
    begin = np.searchsorted(known, bounds[:-1])
    n = np.searchsorted(known, bounds[1:]) - begin
    enough = np.flatnonzero(n >= 3 * len(mu))
    for some in like_lengths(n[enough]):
        some = enough[some]
        x = padded(metres[known], begin[some], n[some])
        on = np.arange(len(x))[:, None] < n[some][None, :]
        states, chains = hidden_markov(x, padded(angle[known], begin[some], n[some]) if turns else None, on, *_start(x, on.astype(float), mu, sigma), *(turns or (None, None)), passes=passes)
        rows = known[np.concatenate([np.arange(a, a + m) for a, m in zip(begin[some], n[some], strict=True)])]
        yield some, rows, states.T[on.T], chains


def _long_vessels(df: DataFrame, most: int) -> DataFrame | None:
    """Vessels of more than ``most`` pings, if there are any: a table with a row for each."""
    long = staged(df.filter("vessel_id is not null").groupBy("vessel_id").count().filter(F.col("count") > most).select("vessel_id"), "long-vessels", narrow=True)
    return None if long.isEmpty() else long


def _long_fits(steps: DataFrame, mu, sigma, turns, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """Chunks of the vessels' tracks, and ``vessel_id, theta`` of the models fitted on them, started at steps counted by 0.1 m."""
    chunks = staged(long_tracks.chunked(steps), "chunks")
    counted = chunks.select("vessel_id", F.explode("step").alias("step")).groupBy("vessel_id", F.round(F.col("step") * 10).alias("value")).agg(F.count("*").alias("n"))
    each = counted.groupBy("vessel_id").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("values"))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = batch.column("values").slice(i, 1).flatten()
                value, n = (held.field(f).to_numpy(zero_copy_only=False).astype(float)[:, None] for f in ("value", "n"))
                theta = Chains(*_start(value / 10, n, mu, sigma), *(turns or (None, None))).packed()
                yield pa.RecordBatch.from_arrays([batch.column("vessel_id").slice(i, 1), pa.array(theta.tolist(), pa.list_(pa.float64()))], names=["vessel_id", "theta"])

    start = staged(each.mapInArrow(begin, "vessel_id string, theta array<double>"), "models", narrow=True)
    return chunks, long_tracks.fitted(chunks, start, len(mu), bool(turns), passes)


def _hmm(df: DataFrame, mu, sigma, turns, most: int, passes: int = PASSES) -> DataFrame:
    known = df.filter("vessel_id is not null")
    long = _long_vessels(known, most)
    short = known if long is None else known.join(long, "vessel_id", "left_anti").select(*df.columns)
    d = _steps(short.repartition("vessel_id"))

    def fit(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        states = np.zeros(table.num_rows, np.int64)
        for _, rows, found, _ in _chains_of(table, bounds, mu, sigma, turns, passes):
            states[rows] = found
        return table.append_column("state", pa.array(states, mask=states == 0))

    out = _fitted(d, fit, T.StructType([*d.schema.fields, T.StructField("state", T.LongType())]), TOGETHER)
    if long is not None:
        steps = _steps(known.join(long, "vessel_id", "left_semi").select(*df.columns))
        chunks, theta = _long_fits(steps, mu, sigma, turns, passes)
        paths = long_tracks.best_paths(chunks, theta, len(mu), bool(turns))
        out = out.unionByName(long_tracks.with_states(chunks, paths, d.columns)).unionByName(steps.filter("step is null"), allowMissingColumns=True)
    return out.unionByName(df.filter("vessel_id is null"), allowMissingColumns=True)


def hmm_step(df: DataFrame, mu=(20.0, 150.0, 300.0), sigma=(20.0, 20.0, 20.0), most: int = MOST) -> DataFrame:
    """``state`` 1 to 3 by mean step, from a gamma model of steps in metres started at a mixture fit; null for vessels of under nine steps and for pings of none.

    Vessels of more than ``most`` pings are fitted in chunks by all tasks (see ``long_tracks``), others many at a time in one.
    """
    return _hmm(df, mu, sigma, None, most)


TURN_MEAN, KAPPA = (math.pi, math.pi / 2, 0.0), (0.1, 0.2, 0.8)


def hmm_step_turn(df: DataFrame, mu=(20.0, 150.0, 300.0), sigma=(20.0, 20.0, 20.0), turn_mean=TURN_MEAN, kappa=KAPPA, most: int = MOST) -> DataFrame:
    """As ``hmm_step``, with turning angles by a wrapped Cauchy distribution."""
    return _hmm(df, mu, sigma, (turn_mean, kappa), most)


_PARAMS = T.StructType([T.StructField("vessel_id", T.StringType()), T.StructField("par", T.StringType()), T.StructField("value", T.DoubleType())])


def _params_of(ids: pa.Array, c: Chains) -> pa.Table:
    """``vessel_id, par, value`` rows of chains whose states are in order."""
    k, turns = c.mean.shape[1], c.kappa is not None
    named = [("step_mean", c.mean), ("step_sd", c.sd), *([("angle_mean", c.turn_mean), ("angle_kappa", c.kappa)] if turns else []), ("delta", c.first)]
    names = [f"{name}_{i + 1}" for name, _ in named for i in range(k)] + [f"gamma_{i + 1}_{j + 1}" for i in range(k) for j in range(k)]
    values = np.concatenate([*(a for _, a in named), c.move.reshape(len(ids), -1)], axis=1)
    return pa.table([ids.take(pa.array(np.repeat(np.arange(len(ids)), len(names)))), pa.array(names * len(ids)), pa.array(values.ravel())], names=_PARAMS.names)


def hmm_params(df: DataFrame, mu=(20.0, 150.0, 300.0), sigma=(20.0, 20.0, 20.0), turns=(TURN_MEAN, KAPPA), most: int = MOST, passes: int = PASSES) -> DataFrame:
    """The fitted hidden Markov model as ``vessel_id, par, value`` rows: steps, turns (if any), transitions and start, states by mean step."""
    known = df.filter("vessel_id is not null")
    long = _long_vessels(known, most)

    def fit(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        ids = table["vessel_id"].combine_chunks()
        parts = [_params_of(ids.take(pa.array(bounds[some])), c) for some, _, _, c in _chains_of(table, bounds, mu, sigma, turns, passes)]
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())], names=_PARAMS.names)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = Chains.unpacked(np.array(batch.column("theta").to_pylist()), len(mu))
                c.by_mean()
                yield from _params_of(batch.column("vessel_id"), c).to_batches()

    short = known if long is None else known.join(long, "vessel_id", "left_anti")
    wanted = ("vessel_id", "time_stamp", "rec_id", "step", "angle")
    out = _fitted(_steps(short.repartition("vessel_id")).select(*wanted), fit, _PARAMS, TOGETHER)
    if long is not None:
        _, theta = _long_fits(_steps(known.join(long, "vessel_id", "left_semi")).select(*wanted), mu, sigma, turns, passes)
        out = out.unionByName(theta.mapInArrow(named, _PARAMS))
    return out


# --- clusters ----------------------------------------------------------------


def binary_fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Four bivariate normal clusters of each column, started from the low and high halves of both variables; 1: low-low to 4: high-high."""
    on = ~np.isnan(x)
    label = (x > np.nanmedian(x, axis=0)) * 2 + (y > np.nanmedian(y, axis=0)) * 1
    share = np.where(on[:, :, None], np.eye(4)[label] * 0.9 + 0.025, 0.0)
    ridge = 1e-6 * ((np.nanvar(x, axis=0) + np.nanvar(y, axis=0)) / 2 + 1e-9) + 1e-12
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    last, live = np.full(x.shape[1], -np.inf), np.arange(x.shape[1])
    for _ in range(PASSES):
        if not len(live):
            break
        s, u, v, here = share[:, live], x[:, live, None], y[:, live, None], on[:, live]
        n = s.sum(axis=0) + 1e-12
        mu, mv = (s * u).sum(axis=0) / n, (s * v).sum(axis=0) / n
        du, dv = u - mu, v - mv
        a, c = ((s * d * d).sum(axis=0) / n + ridge[live, None] for d in (du, dv))
        b = (s * du * dv).sum(axis=0) / n
        det = np.maximum(a * c - b * b, 1e-300)
        log = np.log(n / n.sum(axis=1, keepdims=True)) - 0.5 * (c * du * du - 2 * b * du * dv + a * dv * dv) / det - 0.5 * np.log(det)
        top = log.max(axis=2, keepdims=True)
        total = np.exp(log - top).sum(axis=2, keepdims=True)
        share[:, live] = np.where(here[:, :, None], np.exp(log - top) / total, 0.0)
        fit = np.where(here, (np.log(total) + top)[:, :, 0], 0.0).sum(axis=0)
        going = np.abs(fit - last[live]) >= STOP
        last[live] = fit
        live = live[going]
    return share.argmax(axis=2) + 1


def binary_clusters(df: DataFrame) -> DataFrame:
    """``cluster`` 1 to 4 of (speed, absolute turn) for each vessel's pings that have both; null for vessels with under eight."""
    d = _steps(df.repartition("vessel_id"))

    def fit(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        speed, turn = _column(table, "step_speed"), np.abs(_column(table, "angle"))
        known = np.flatnonzero(~np.isnan(speed + turn))
        begin = np.searchsorted(known, bounds[:-1])
        n = np.searchsorted(known, bounds[1:]) - begin
        enough, out = np.flatnonzero(n >= 8), np.zeros(table.num_rows, np.int64)
        for some in like_lengths(n[enough]):
            some = enough[some]
            x, y = (padded(c[known], begin[some], n[some]) for c in (speed, turn))
            rows = known[np.concatenate([np.arange(a, a + m) for a, m in zip(begin[some], n[some], strict=True)])]
            out[rows] = binary_fits(x, y).T[~np.isnan(x).T]
        return table.append_column("cluster", pa.array(out, mask=out == 0))

    return _fitted(d, fit, T.StructType([*d.schema.fields, T.StructField("cluster", T.LongType())]))


def model_params_long(params: DataFrame) -> DataFrame:
    """Mixture parameters as ``vessel_id, par, value`` rows."""
    names = ("lambda", "mu", "sigma")
    rows = F.explode(F.array(*[F.struct(F.concat_ws("_", F.lit(n), F.col("mode").cast("string")).alias("par"), F.col(n).cast(T.DoubleType()).alias("value")) for n in names]))
    return params.select("vessel_id", rows.alias("r")).select("vessel_id", "r.*")
