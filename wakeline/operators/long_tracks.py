"""Hidden Markov fits of vessels whose steps are too many for one task: a track is cut into chunks by time.

A pass is three steps. Every chunk multiplies its matrices (products of k x k, one row a chunk). A
vessel's products are passed over once forwards and once backwards, which gives the states before and
the weights behind each chunk; that is a thousandth of its steps. Every chunk then adds up its part of the M
step's sums, which meet by vessel, map-side first. Chunks stay where they were written; which side of a
join moves is the optimizer's choice by size. The best path goes the same way with maxima for sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import micros
from ..functions.runs import whole_groups
from ..sources.scratch import staged
from .chains import PASSES, SHORTEST, Chains, Sums, settled

CHUNK = 2000
_KEY = "vessel_id string, chunk long"


def _rows(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def _side_by_side(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of any lengths, a column for each with nan below its end, and where they reach."""
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    on = np.arange(n.max(initial=0))[:, None] < n[None, :]
    out = np.full(on.shape, np.nan)
    out.T[on.T] = column.flatten().to_numpy(zero_copy_only=False)
    return out, on


def _of_chunks(df: DataFrame, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray | None, np.ndarray], list[pa.Array]], schema: str, turns: bool, most: int = 128) -> DataFrame:
    """``work(batch, step, angle, on)`` on some ``most`` chunks at a time."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                step, on = _side_by_side(part.column("step"))
                step = np.where(on, np.maximum(np.nan_to_num(step), SHORTEST), 1.0)
                angle = _side_by_side(part.column("angle"))[0] if turns else None
                yield pa.RecordBatch.from_arrays(work(part, step, angle, on), names=names)

    return df.mapInArrow(run, schema)


def _every(batch: pa.RecordBatch) -> np.ndarray:
    return np.arange(batch.num_rows)


def _begins(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("chunk").to_numpy() == 0


def _scanned(products: DataFrame, scan: Callable[[pa.Table], list[pa.Array]], schema: str) -> DataFrame:
    """``scan`` on all chunks of each vessel in order."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, 10_000, "vessel_id"):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield pa.RecordBatch.from_arrays(scan(table.slice(a, b - a).combine_chunks()), names=names)

    return products.repartition("vessel_id").sortWithinPartitions("vessel_id", "chunk").mapInArrow(run, schema)


def _key(table: pa.Table | pa.RecordBatch) -> list[pa.Array]:
    return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column("vessel_id"), table.column("chunk"))]


def _one_pass(chunks: DataFrame, theta: DataFrame, k: int, turns: bool) -> DataFrame:
    """``vessel_id, theta, fit`` after a pass; ``theta`` has the vessels that still move."""

    def multiplied(batch, step, angle, on):
        c = Chains.unpacked(_rows(batch.column("theta")), k)
        p, top = c.emission(step, angle, _every(batch))
        m, log = c.products(p, on, _begins(batch), _every(batch))
        return [*_key(batch), _lists(m.reshape(len(m), -1)), pa.array(log + np.where(on, top, 0.0).sum(axis=0)), _lists(c.first)]

    def spread(table: pa.Table) -> list[pa.Array]:
        m = _rows(table["m"]).reshape(-1, k, k)
        n = len(m)
        before, after, fit = np.empty((n, k)), np.ones((n, k)), float(np.sum(table["log"].to_numpy()))
        now = _rows(table["first"])[0]
        for i in range(n):
            before[i] = now
            now = now @ m[i]
            fit += np.log(now.sum())
            now = now / now.sum()
        for i in range(n - 1, 0, -1):
            w = m[i] @ after[i]
            after[i - 1] = w / w.sum()
        return [*_key(table), _lists(before), _lists(after), pa.array(np.where(np.arange(n) == 0, fit, 0.0))]

    def added(batch, step, angle, on):
        c = Chains.unpacked(_rows(batch.column("theta")), k)
        p, _ = c.emission(step, angle, _every(batch))
        found, _ = c.sums(step, angle, p, on, _begins(batch), _rows(batch.column("before")), _rows(batch.column("after")), _every(batch))
        return [batch.column("vessel_id"), _lists(found.packed()), batch.column("fit")]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Chains.unpacked(_rows(batch.column("theta")), k)
            c.maximise(Sums.unpacked(_rows(batch.column("sums")), k), _every(batch))
            yield pa.RecordBatch.from_arrays([batch.column("vessel_id"), _lists(c.packed()), batch.column("fit")], names=["vessel_id", "theta", "fit"])

    now = chunks.join(theta.select("vessel_id", "theta"), "vessel_id")
    products = _of_chunks(now, multiplied, f"{_KEY}, m array<double>, log double, first array<double>", turns)
    ends = _scanned(products, spread, f"{_KEY}, before array<double>, after array<double>, fit double")
    parts = _of_chunks(now.join(ends, ["vessel_id", "chunk"]), added, "vessel_id string, sums array<double>, fit double", turns)
    width = 5 * k + k * k + 3 * k * turns
    total = parts.groupBy("vessel_id").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"), F.sum("fit").alias("fit"))
    return total.join(theta.select("vessel_id", "theta"), "vessel_id").mapInArrow(moved, "vessel_id string, theta array<double>, fit double")


def fitted(chunks: DataFrame, start: DataFrame, k: int, turns: bool, passes: int = PASSES) -> DataFrame:
    """``vessel_id, theta`` of the settled models. ``start``: ``vessel_id, theta``; a small table is written each pass."""
    live = start.withColumn("last", F.lit(float("-inf")))
    done: list[DataFrame] = []
    for _ in range(passes):
        new = _one_pass(chunks, live, k, turns).join(live.select("vessel_id", "last"), "vessel_id")
        change, least = F.abs(F.col("fit") - F.col("last")), F.lit(1e-8) * F.greatest(F.lit(1.0), F.lit(1e-5) * F.abs(F.col("fit")))
        new = staged(new.select("vessel_id", "theta", F.col("fit").alias("last"), (change < least).alias("settled")), "models", narrow=True)
        if not new.filter("settled").isEmpty():
            done.append(new.filter("settled").select("vessel_id", "theta"))
        live = new.filter("not settled").drop("settled")
        if live.isEmpty():
            break
    out = live.select("vessel_id", "theta")
    for d in done:
        out = out.unionByName(d)
    return staged(out, "models", narrow=True)


def best_paths(chunks: DataFrame, theta: DataFrame, k: int, turns: bool) -> DataFrame:
    """``vessel_id, chunk, states``: 1 to k by mean, a list for each chunk."""

    def multiplied(batch, step, angle, on):
        c = Chains.unpacked(_rows(batch.column("theta")), k)
        log = c.log_emission(step, angle, _every(batch))
        return [*_key(batch), _lists(c.best_products(log, on, _begins(batch), _every(batch)).reshape(batch.num_rows, -1)), _lists(np.log(c.first + 1e-300))]

    def spread(table: pa.Table) -> list[pa.Array]:
        m = _rows(table["m"]).reshape(-1, k, k)
        n = len(m)
        before, last = np.empty((n, k)), np.empty(n, np.int64)
        now = _rows(table["first"])[0]
        for i in range(n):
            before[i] = now
            now = (now[:, None] + m[i]).max(axis=0)
            now = now - now.max()
        last[-1] = now.argmax()
        for i in range(n - 1, 0, -1):
            last[i - 1] = (before[i] + m[i][:, last[i]]).argmax()
        return [*_key(table), _lists(before), pa.array(last)]

    def walked(batch, step, angle, on):
        c = Chains.unpacked(_rows(batch.column("theta")), k)
        of = _every(batch)
        path = c.paths(c.log_emission(step, angle, of), on, _begins(batch), _rows(batch.column("before")), batch.column("last").to_numpy(), of)
        states = c.by_mean()[of[None, :], path] + 1
        n = on.sum(axis=0)
        return [*_key(batch), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(states.T[on.T]))]

    now = chunks.join(theta, "vessel_id")
    products = _of_chunks(now, multiplied, f"{_KEY}, m array<double>, first array<double>", turns)
    ends = _scanned(products, spread, f"{_KEY}, before array<double>, last long")
    return _of_chunks(now.join(ends, ["vessel_id", "chunk"]), walked, f"{_KEY}, states array<long>", turns)


def chunked(steps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of known ``step`` by vessel and chunk: ``vessel_id, chunk, rows, step, angle``, in track order; steps in metres.

    A chunk is a stretch of time that holds ``chunk`` steps on an average; the first of a vessel is 0 and
    chunks without steps do not occur.
    """
    known = steps.filter("step is not null and vessel_id is not null").withColumn("_at", micros("time_stamp"))
    span = known.groupBy("vessel_id").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count("*").alias("_n"))
    span = span.select("vessel_id", "_first", F.greatest(F.lit(1), F.ceil((F.col("_last") - F.col("_first") + 1) * chunk / F.col("_n"))).alias("_long"))
    placed = known.join(span, "vessel_id").withColumn("chunk", F.floor((F.col("_at") - F.col("_first")) / F.col("_long")).cast("long")).drop("_at", "_first", "_long")
    rest = [c for c in steps.columns if c not in ("vessel_id", "time_stamp", "rec_id")]
    rows = placed.groupBy("vessel_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("time_stamp", "rec_id", *rest))).alias("rows"))
    return rows.select("vessel_id", "chunk", "rows", F.transform("rows.step", lambda s: s * 1000).alias("step"), F.col("rows.angle").alias("angle"))


def with_states(chunks: DataFrame, paths: DataFrame, columns: list[str]) -> DataFrame:
    """The chunks' rows again, with ``state``."""
    both = chunks.select("vessel_id", "chunk", "rows").join(paths, ["vessel_id", "chunk"])
    each = both.select("vessel_id", F.explode(F.arrays_zip("rows", "states")).alias("r"))
    return each.select(*("vessel_id" if c == "vessel_id" else f"r.rows.{c}" for c in columns), F.col("r.states").alias("state"))
