"""Joins of pings with registries, polygons, trip times and time grids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import MIDDLE, edges, haversine_m, in_cell_ring, segment_distance, to_utm
from ..functions.order import micros, track

CELL_DEGREES = 0.1
CELL_METRES = 1000.0


def attach_registry(tracks: DataFrame, trips: DataFrame, devices: DataFrame) -> DataFrame:
    """Device and vessel of each ping, null where unknown. Sides small enough are broadcast by the optimizer."""
    return tracks.join(trips, "trip_id", "left").join(devices, "device_id", "left")


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("long")


def _by_cell(shapes: DataFrame, low: list[Column], high: list[Column], size: float, keep: Column) -> DataFrame:
    """``cx, cy, shapes``: what overlaps each grid cell, one row per cell."""
    span = lambda a, b: F.explode(F.sequence(_cell(a, size), _cell(b, size)))
    cells = shapes.select(keep.alias("shape"), span(low[0], high[0]).alias("cx"), low[1].alias("lo"), high[1].alias("hi"))
    return cells.select("shape", "cx", span(F.col("lo"), F.col("hi")).alias("cy")).groupBy("cx", "cy").agg(F.collect_list("shape").alias("shapes"))


def _span(a: Column, b: Column, size: float) -> Column:
    return F.explode(F.sequence(_cell(a, size), _cell(b, size)))


def _least(axis: str) -> Column:
    return F.least(f"{axis}1", f"{axis}2")


def _most(axis: str) -> Column:
    return F.greatest(f"{axis}1", f"{axis}2")


def _sides(features: DataFrame) -> DataFrame:
    """``shape, x1, y1, x2, y2``: every side of the ``rings`` (or the one ``ring``) of each feature. Equal features are one."""
    rings = F.col("rings") if "rings" in features.columns else F.array("ring")
    each = features.select(rings.alias("rings")).distinct().select(F.xxhash64("rings").alias("shape"), F.explode("rings").alias("ring"))
    sides = each.select("shape", F.explode(edges(F.col("ring"))).alias("e"))
    return sides.select("shape", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def _passed(sides: DataFrame, size: float, near: float) -> DataFrame:
    """``shape, cx, cy, side``: the grid cells that each side, or what is ``near`` it, passes."""
    # A side in each column of cells, then in the cells that its part over the column passes.
    over = sides.withColumn("cx", _span(_least("x") - near, _most("x") + near, size))
    at = lambda x: F.coalesce(F.col("y1") + (F.col("y2") - F.col("y1")) * (x - F.col("x1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)), F.col("y1"))
    ends = at(F.greatest(_least("x"), F.col("cx") * size - near)), at(F.least(_most("x"), (F.col("cx") + 1) * size + near))
    upright = F.col("x1") == F.col("x2")
    bottom, top = F.when(upright, _least("y")).otherwise(F.least(*ends)), F.when(upright, _most("y")).otherwise(F.greatest(*ends))
    return over.withColumn("cy", _span(bottom - near, top + near, size)).select("shape", "cx", "cy", F.struct("x1", "y1", "x2", "y2").alias("side"))


def _inner(sides: DataFrame, size: float, within: DataFrame | None = None, factor: int = 1) -> DataFrame:
    """``shape, cx, cy``: grid cells whose middle is inside, all or those in the blocks ``shape, bx, by`` of ``factor`` cells each way."""
    # Where a feature crosses the middle line of a row of cells: inside is what lies between odd and even crossings.
    middle = lambda c: (F.col(c) + MIDDLE) * size
    rows = sides.withColumn("cy", _span(_least("y"), _most("y"), size)).filter((F.col("y1") > middle("cy")) != (F.col("y2") > middle("cy")))
    crossed = F.col("x1") + (F.col("x2") - F.col("x1")) * (middle("cy") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    rows = rows.groupBy("shape", "cy").agg(F.array_sort(F.collect_list(crossed)).alias("xs")).filter("size(xs) > 1")
    rows = rows.select("shape", "cy", "xs", F.explode(F.expr("sequence(0, cast(size(xs) div 2 as int) - 1)")).alias("i")).select("shape", "cy", F.col("xs")[2 * F.col("i")].alias("a"), F.col("xs")[2 * F.col("i") + 1].alias("b"))
    low, high = _cell(F.col("a"), size), _cell(F.col("b"), size)
    if within is not None:
        rows = rows.withColumn("by", F.floor(F.col("cy") / factor)).join(within, ["shape", "by"])
        low, high = F.greatest(low, F.col("bx") * factor), F.least(high, F.col("bx") * factor + factor - 1)
    found = rows.withColumns({"low": low, "high": high}).filter("low <= high").withColumn("cx", F.explode(F.sequence("low", "high")))
    return found.filter((F.col("a") < middle("cx")) & (middle("cx") <= F.col("b"))).select("shape", "cx", "cy")


def ring_cells(features: DataFrame, size: float, buffer: float = 0.0, within: DataFrame | None = None, factor: int = 1) -> DataFrame:
    """``cx, cy, shapes``: a row per grid cell that a feature, or its buffer, reaches (of its inside only cells in the blocks ``within``, if given).

    A feature has one ``ring`` of x, y points or several ``rings``: parts, holes, islands in holes; inside
    is what an odd number of them goes round. For each feature there a cell holds the sides that come
    near it and whether the cell's middle is inside. So a ring of very many sides is spread over its cells, each side in
    those it passes, and a point is judged by its own cell alone.
    """
    sides = _sides(features)
    passed = _passed(sides, size, buffer + size * 1e-9).withColumn("inside", F.lit(False))
    inner = _inner(sides, size, within, factor).select("shape", "cx", "cy", F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>").alias("side"), F.lit(True).alias("inside"))
    each = passed.unionByName(inner).groupBy("shape", "cx", "cy").agg(F.collect_list("side").alias("sides"), F.max("inside").alias("inside"))
    return each.groupBy("cx", "cy").agg(F.collect_list(F.struct("sides", "inside")).alias("shapes"))


#: Cells of a block, and blocks of a region, each way.
FACTOR = 32


def cover(features: DataFrame, size: float, buffer: float = 0.0, factor: int = FACTOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``bx, by`` of regions and of blocks that lie inside whole, and ``ring_cells`` of the rest.

    Blocks are ``factor`` cells wide, regions as many blocks. Inside cells are listed only in blocks that a side
    passes, inside blocks only in regions that one passes, so their number grows with the length of the
    sides and not with the area (with cells of 1 km the Earth has some 500 regions).
    """
    sides = _sides(features)
    near = buffer + size * 1e-9
    passed = [_passed(sides, size * f, near).select("shape", F.col("cx").alias("bx"), F.col("cy").alias("by")).distinct() for f in (factor, factor**2)]
    blocks = _inner(sides, size * factor, passed[1], factor)
    regions = _inner(sides, size * factor**2)
    whole = [t.select("shape", F.col("cx").alias("bx"), F.col("cy").alias("by")).join(p, ["shape", "bx", "by"], "left_anti").select("bx", "by").distinct() for t, p in ((regions, passed[1]), (blocks, passed[0]))]
    return whole[0], whole[1], ring_cells(features, size, buffer, passed[0], factor)


def _planar(polys: DataFrame, point: Callable[[Column], Column]) -> DataFrame:
    """``rings`` of features that have ``rings`` or one ``ring`` of lon, lat points."""
    rings = F.col("rings") if "rings" in polys.columns else F.array("ring")
    return polys.select(F.transform(rings, lambda r: F.transform(r, point)).alias("rings"))


def add_harbours(df: DataFrame, polys: DataFrame) -> DataFrame:
    """``SI_HARB``: 1 inside or on the border of a polygon (one ``ring``, or ``rings`` with holes and parts), else 0; one row per ping.

    A ping meets one row, that of its grid cell with the sides there, so overlaps multiply nothing.
    """
    planar = _planar(polys, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    at = df.withColumns({"cx": _cell(F.col("lon"), CELL_DEGREES), "cy": _cell(F.col("lat"), CELL_DEGREES)}).join(ring_cells(planar, CELL_DEGREES), ["cx", "cy"], "left")
    inside = F.exists("shapes", lambda r: in_cell_ring(F.col("lon"), F.col("lat"), F.col("cx"), F.col("cy"), CELL_DEGREES, r))
    return at.withColumn("SI_HARB", F.coalesce(inside, F.lit(False)).cast("int")).drop("cx", "cy", "shapes")


def near_harbour(df: DataFrame, points: DataFrame, dist_m: float) -> DataFrame:
    """Pings within ``dist_m`` of a point ``lon, lat``."""
    reach = F.lit(dist_m / 111_000 * 1.01)
    wide = reach / F.greatest(F.cos(F.radians(F.abs(F.col("lat")) + reach)), F.lit(0.01))
    cells = _by_cell(points, [F.col("lon") - wide, F.col("lat") - reach], [F.col("lon") + wide, F.col("lat") + reach], CELL_DEGREES, F.struct("lon", "lat"))
    at = df.withColumns({"cx": _cell(F.col("lon"), CELL_DEGREES), "cy": _cell(F.col("lat"), CELL_DEGREES)}).join(cells, ["cx", "cy"])
    return at.filter(F.exists("shapes", lambda p: haversine_m(F.col("lon"), F.col("lat"), p["lon"], p["lat"]) <= dist_m)).drop("cx", "cy", "shapes")


def remove_land(df: DataFrame, coast: DataFrame, zone: int, buffer_m: float = 10.0) -> DataFrame:
    """Pings that are neither in a coast polygon (one ``ring``, or ``rings`` with lakes and islands) nor within the buffer of its sides, in planar UTM.

    Pings in regions and blocks that are land throughout go first, by two small anti joins; the others meet
    the row of their cell.
    """
    planar = _planar(coast, lambda p: F.struct(*[c.alias(n) for c, n in zip(to_utm(p["lon"], p["lat"], zone), "xy", strict=True)]))
    x, y = to_utm(F.col("lon"), F.col("lat"), zone)
    at = df.withColumns({"_x": x, "_y": y}).withColumns({"cx": _cell(F.col("_x"), CELL_METRES), "cy": _cell(F.col("_y"), CELL_METRES)})
    regions, blocks, cells = cover(planar, CELL_METRES, buffer_m)
    for whole, size in ((regions, FACTOR**2), (blocks, FACTOR)):
        at = at.withColumns({"bx": F.floor(F.col("cx") / size), "by": F.floor(F.col("cy") / size)}).join(whole, ["bx", "by"], "left_anti")
    at = at.join(cells, ["cx", "cy"], "left")
    px, py = F.col("_x"), F.col("_y")
    ashore = F.exists("shapes", lambda r: in_cell_ring(px, py, F.col("cx"), F.col("cy"), CELL_METRES, r) | F.exists(r["sides"], lambda e: segment_distance(px, py, e) <= buffer_m))
    return at.filter(~F.coalesce(ashore, F.lit(False))).select(*df.columns)


def remove_harbour(df: DataFrame) -> DataFrame:
    return df.filter("SI_HARB = 0")


def _met(pings: DataFrame, trips: DataFrame, levels: int) -> DataFrame:
    """Pings with the trips that are filed under a block of theirs."""
    t = trips.select("vessel_id", "depart", "return", "trip_id").filter(F.col("depart") <= F.col("return"))
    took = micros("return") - micros("depart")
    shortest = 600_000_000
    level = F.lit(levels - 1)
    for i in range(levels - 2, -1, -1):
        level = F.when(took <= shortest * 4**i, F.lit(i)).otherwise(level)

    def block(time: str, at: Column) -> Column:
        return F.floor(micros(time) / (F.pow(F.lit(4.0), at) * shortest)).cast("long")

    filed = t.withColumn("_level", level).withColumn("_block", F.explode(F.sequence(block("depart", F.col("_level")), block("return", F.col("_level")))))
    used = filed.groupBy("vessel_id").agg(F.collect_set("_level").alias("_levels"))  # at most ``levels`` a vessel
    looking = pings.join(used, "vessel_id").withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_block", block("time_stamp", F.col("_level")))
    return looking.join(filed, ["vessel_id", "_level", "_block"]).drop("_level", "_block")


def assign_trips(pings: DataFrame, trips: DataFrame, levels: int = 12) -> DataFrame:
    """Pings in ``[depart, return]`` of their vessel's trips, both ends included; a ping for each trip it lies in.

    A trip is filed under one or two blocks of time: those it touches of the least length, out of ``levels``
    lengths from ten minutes on, each four times the one before, that is no shorter than the trip (longer
    trips under all blocks of the greatest length that they touch). A ping looks into its block of each length
    that the vessel has trips of, so what is compared are trips near it, not all of the vessel's; a pair
    is met once, as a ping lies in one block of each length.
    """
    return _met(pings, trips, levels).filter(F.col("time_stamp").between(F.col("depart"), F.col("return")))


def anti_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def semi_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def mixture_density(obs: DataFrame, comps: DataFrame, value: str = "value") -> DataFrame:
    """``density``: each component's share at each observation. Components are a handful, kept as one array."""
    few = comps.agg(F.array_sort(F.collect_list(F.struct("mode", "lambda", "mu", "sigma"))).alias("c"))
    rows = obs.join(F.broadcast(few)).select(*obs.columns, F.explode("c").alias("c")).select(*obs.columns, "c.*")
    z = (F.col(value) - F.col("mu")) / F.col("sigma")
    return rows.withColumn("density", F.col("lambda") * F.exp(-z * z / 2) / (F.col("sigma") * F.sqrt(2 * F.pi())))


_UNIT_MICROS = {"sec": 1_000_000, "min": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def downsample_ais_timestep(df: DataFrame, unit: str = "min", length: int = 1) -> DataFrame:
    """``keep``: 1 for pings nearest to a point of a regular grid over the vessel's time span (ties: the earlier), else 0.

    Without a join: a ping owns the times nearer to it than to its neighbours, and is kept if a grid
    point is among them. Doubled integers keep midpoints exact.
    """
    one = _UNIT_MICROS[unit]
    step = 2 * one * length
    t = micros("time_stamp")
    by = track()
    df = df.withColumn("_t", t)
    whole = W.partitionBy("vessel_id")
    first, last = F.min("_t").over(whole), F.max("_t").over(whole)
    half_up = lambda v: 2 * one * F.floor((2 * v + one) / F.lit(2 * one)).cast("long")
    df = df.withColumns({"_start": half_up(first), "_end": half_up(last), "_same": F.lag("_t").over(by).eqNullSafe(F.col("_t"))})
    # The neighbours at other times: of equal times the first knows the one before, the last the one after.
    back = W.partitionBy("vessel_id").orderBy(F.desc("time_stamp"), F.desc("rec_id"))
    earlier = F.last(F.when(~F.col("_same"), F.col("_before")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    later = F.last(F.when(F.col("_next") != F.col("_t"), F.col("_next")), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumns({"_before": F.lag("_t").over(by), "_next": F.lead("_t").over(by)}).withColumn("_before", earlier).withColumn("_next", later)
    floor_div = lambda a: F.floor(a / F.lit(float(step))).cast("long")
    low = F.when(F.col("_before").isNull(), F.lit(-1)).otherwise(F.greatest(F.lit(-1), floor_div(F.col("_before") + F.col("_t") - F.col("_start"))))
    high = F.when(F.col("_next").isNull(), F.col("_end")).otherwise(F.least(F.col("_end"), F.col("_t") + F.col("_next")))
    df = df.withColumn("keep", ((~F.col("_same")) & (floor_div(high - F.col("_start")) > low)).cast("int"))
    return df.drop("_t", "_start", "_end", "_same", "_before", "_next")

