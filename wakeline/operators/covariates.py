"""Features of pings within trips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import transverse_mercator
from ..functions.runs import whole_groups
from ..sources.scratch import staged
from .clean import complete_cases, null_bad_course
from .track import calc_acceleration, calc_heading, calc_straightness


def local_projection(df: DataFrame, key: str = "trip_id") -> DataFrame:
    """``x``, ``y`` metres from the middle of each trip's bounding box."""
    mid = lambda c: ((F.min(c) + F.max(c)) / 2).alias(f"_{c}0")
    middles = df.groupBy(F.col(key).alias("_key")).agg(mid("lon"), mid("lat"))
    d = df.join(middles, F.col(key).eqNullSafe(F.col("_key")))
    x, y = transverse_mercator(F.col("lon"), F.col("lat"), F.col("_lon0"))
    _, y0 = transverse_mercator(F.col("_lon0"), F.col("_lat0"), F.col("_lon0"))
    return d.select(*df.columns, x.alias("x"), (y - y0).alias("y"))


def nearest(x: np.ndarray, y: np.ndarray, often: np.ndarray, k: int, of: tuple[np.ndarray, np.ndarray] | None = None, chunk: int = 1024) -> np.ndarray:
    """Distances to the k nearest pings at positions that stand for ``often`` of them each; nan where there are fewer.

    ``of``: positions to look from, which are not among those looked at; else each looks at the others and
    at the other pings of its own. A chunk of positions at a time.
    """
    from_x, from_y = of or (x, y)
    n, most = len(from_x), min(k, len(x) - (of is None))
    out = np.full((n, k), np.nan)
    for a in range(0, n, chunk):
        d = np.hypot(from_x[a : a + chunk, None] - x[None, :], from_y[a : a + chunk, None] - y[None, :])
        own = np.zeros(len(d), np.int64)
        if of is None:
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            own = often[a : a + chunk] - 1
        # Of other positions the k nearest are enough, as each has a ping or more.
        at = np.argpartition(d, most - 1, axis=1)[:, :most] if most else np.zeros((len(d), 0), np.int64)
        near = np.take_along_axis(d, at, 1)
        order = np.argsort(near, axis=1, kind="stable")
        near, until = np.take_along_axis(near, order, 1), np.cumsum(often[np.take_along_axis(at, order, 1)], axis=1)
        place = np.arange(k)[None, :] - own[:, None]
        which = (until[:, None, :] <= place[:, :, None]).sum(axis=2)
        there = np.take_along_axis(np.concatenate([near, np.full((len(d), 1), np.nan)], axis=1), np.minimum(which, most), 1)
        out[a : a + chunk] = np.where(place < 0, 0.0, there)
    return out


#: Quantiles of a trip's positions along each axis: what tiles can be cut by.
CUTS = 128


def _cut(df: DataFrame, by: list[str], axis: str, out: str, pieces: Column) -> DataFrame:
    """``out``: in which of ``pieces`` (of the group's size ``_n``) stretches of ``axis`` of about equally many rows of its group a row lies."""
    shares = F.percentile_approx(axis, [i / CUTS for i in range(1, CUTS)]).alias("_q")
    edges = df.groupBy(*by).agg(F.count("*").alias("_n"), shares).withColumn("_pieces", F.least(F.lit(CUTS), F.greatest(F.lit(1), pieces)).cast("int"))
    at = F.when(F.col("_pieces") > 1, F.transform(F.sequence(F.lit(1), F.col("_pieces") - 1), lambda i: F.col("_q")[F.floor(i * CUTS / F.col("_pieces")).cast("int") - 1])).otherwise(F.array())
    return df.join(edges.select(*by, at.alias("_edges")), by).withColumn(out, F.size(F.filter("_edges", lambda e: e <= F.col(axis)))).drop("_edges")


def _in_tiles(rows: DataFrame, key: str, k: int, batch_rows: int = 20_000) -> DataFrame:
    """``x, y, _d`` for the rows that look (``_looks``), else for all, of each tile; ``_d`` has k distances or nan."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, batch_rows, key, "_strip", "_tile"):
            x, y, often = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("x", "y", "_m"))
            looks = table["_looks"].combine_chunks().to_numpy(zero_copy_only=False)
            out = np.full((len(x), k), np.nan)
            asked = np.ones(len(x), bool)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                far = looks[a:b]
                if far.any():
                    asked[a:b] = far
                    held = a + np.flatnonzero(~far)
                    at = a + np.flatnonzero(far)
                    out[at] = nearest(x[held], y[held], often[held], k, (x[at], y[at]))
                else:
                    out[a:b] = nearest(x[a:b], y[a:b], often[a:b], k)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(out.ravel()))
            found = table.select([key, "x", "y", "_m", "_strip", "_tile"]).append_column("_d", lists)
            yield from found.filter(pa.array(asked)).to_batches()

    ordered = rows.select(key, "x", "y", "_m", "_strip", "_tile", "_looks").repartition(key, "_strip", "_tile").sortWithinPartitions(key, "_strip", "_tile")
    return ordered.mapInArrow(run, f"`{key}` {kinds[key]}, x double, y double, _m long, _strip int, _tile int, _d array<double>")


def knn_distances(df: DataFrame, k: int = 9, key: str = "trip_id", tile: int = 2000) -> DataFrame:
    """``dist_neighbour_1`` to ``_k``: planar distances to the nearest pings of the trip, null where there are too few, without a place or a trip.

    Equal positions of a trip are one row with a count, so moored vessels are no hot group. A trip of many
    positions is cut into tiles of about ``tile`` of them, by quantiles of x and then of y. Each position finds its k nearest in
    its tile; the last of these bounds how far others can be, and only tiles of its trip that begin within that
    are searched too. So neither all pairs of a trip nor its rows meet in one task.
    """
    planar = staged(local_projection(df, key), "planar")  # read twice, and the projection is long
    here = planar.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(key).isNotNull())
    spots = staged(here.groupBy(key, "x", "y").agg(F.count("*").alias("_m")), "positions", narrow=True)
    large = staged(spots.groupBy(key).count().filter(F.col("count") > 2 * tile).select(key), "large-trips", narrow=True)
    whole = spots.withColumns({"_strip": F.lit(0), "_tile": F.lit(0)})
    if large.isEmpty():
        found = _in_tiles(whole.withColumn("_looks", F.lit(False)), key, k).select(key, "x", "y", "_d")
    else:
        cut = _cut(spots.join(large, key, "left_semi"), [key], "x", "_strip", F.ceil(F.sqrt(F.col("_n") / tile)))
        cut = staged(_cut(cut, [key, "_strip"], "y", "_tile", F.ceil(F.col("_n") / tile)), "tiles", narrow=True)
        near = staged(_in_tiles(cut.withColumn("_looks", F.lit(False)), key, k), "near", narrow=True)
        away = lambda axis: F.greatest(F.lit(0.0), F.col(f"{axis}1") - F.col(axis), F.col(axis) - F.col(f"{axis}2"))
        last = F.element_at("_d", -1)
        reach = F.when(F.isnan(last), F.lit(float("inf"))).otherwise(last)
        strips = cut.groupBy(key, F.col("_strip").alias("_s")).agg(F.min("x").alias("x1"), F.max("x").alias("x2"))
        tiles = cut.groupBy(key, F.col("_strip").alias("_s"), F.col("_tile").alias("_t")).agg(*(f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((1, F.min), (2, F.max))))
        asks = near.withColumn("_reach", reach).join(strips, key).filter(away("x") < F.col("_reach")).drop("x1", "x2")
        asks = asks.join(tiles, [key, "_s"]).filter((F.hypot(away("x"), away("y")) < F.col("_reach")) & ((F.col("_s") != F.col("_strip")) | (F.col("_t") != F.col("_tile"))))
        asks = asks.select(key, "x", "y", "_m", F.col("_s").alias("_strip"), F.col("_t").alias("_tile"), F.lit(True).alias("_looks"))
        # Only tiles that are asked; the others' positions need not move.
        asked = cut.join(asks.select(key, "_strip", "_tile").distinct(), [key, "_strip", "_tile"], "left_semi").withColumn("_looks", F.lit(False))
        more = _in_tiles(asked.select(*asks.columns).unionByName(asks), key, k)
        both = near.select(key, "x", "y", "_d").unionByName(more.select(key, "x", "y", "_d"))
        found = both.groupBy(key, "x", "y").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_d"))), 1, k).alias("_d"))
        small = whole.join(large, key, "left_anti").withColumn("_looks", F.lit(False))
        found = found.unionByName(_in_tiles(small, key, k).select(key, "x", "y", "_d"))
    names = [f"dist_neighbour_{i}" for i in range(1, k + 1)]
    joined = planar.join(found, [key, "x", "y"], "left")
    return joined.select(*df.columns, *(F.nanvl(F.col("_d")[i], F.lit(None).cast("double")).alias(n) for i, n in enumerate(names)))


def trip_covariates(df: DataFrame, k: int = 9) -> DataFrame:
    """Per trip: heading, straightness of course, distances to neighbours, acceleration. Pings without speed, course or behaviour go first."""
    d = complete_cases(null_bad_course(df), ["speed", "course", "behaviour", "trip_id"])
    d = calc_acceleration(calc_straightness(calc_heading(d, ("trip_id",)), "course", ("trip_id",)), keys=("trip_id",))
    return knn_distances(staged(d, "covariates"), k)
