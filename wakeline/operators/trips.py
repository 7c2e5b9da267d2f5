"""Cutting tracks into trips, and what is summed up per trip."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import arcdist, trip_key
from ..functions.order import micros, seconds_between, so_far, track
from ..functions.runs import whole_groups
from ..sources.scratch import staged


def trips_by_day(df: DataFrame) -> DataFrame:
    return df.withColumn("burst", F.concat_ws(" ", "vessel_id", F.to_date("time_stamp").cast("string")))


def trips_by_gap(df: DataFrame, gap_sec: int = 10_800) -> DataFrame:
    """``vessel_trip``: a new one after a gap of that many seconds or more."""
    gap = seconds_between(F.lag("time_stamp").over(track()), F.col("time_stamp"))
    df = df.withColumn("_cut", F.coalesce((gap >= gap_sec).cast("int"), F.lit(0)))
    n = F.sum("_cut").over(so_far()) + 1
    return df.withColumn("vessel_trip", trip_key(F.col("vessel_id"), n)).drop("_cut")


def segments_by_distance(df: DataFrame, max_m: float = 1000.0) -> DataFrame:
    """``segment``: a new one where the step from the previous ping is longer."""
    w = track()
    step = arcdist(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"), "km") * 1000
    df = df.withColumn("_cut", F.coalesce((step > max_m).cast("int"), F.lit(0)))
    return df.withColumn("segment", (F.sum("_cut").over(so_far()) + 1).cast("long")).drop("_cut")


def _cuts(before: np.ndarray, after: np.ndarray, first: int, last: int, max_dur: float) -> list[tuple[int, str]]:
    """Where a trip from ``first`` to ``last`` (microseconds) is cut among its gaps ``before .. after``, and the name endings of its parts.

    A part over ``max_dur`` hours is cut at its longest gap, the earliest of equal ones. So a gap is a
    cut if the stretch between the nearest gap before it that is as long and the nearest behind it
    that is longer takes over ``max_dur``: then so do all stretches around it. One walk with a stack
    of falling gaps finds those neighbours. Returns ``(index of the gap, ending of the part behind it)``,
    first -1 for the part before all cuts.
    """
    gap = (after - before).tolist()
    n = len(gap)
    left, right, falling = [-1] * n, [n] * n, []
    for i in range(n):
        while falling and gap[falling[-1]] < gap[i]:
            right[falling.pop()] = i
        left[i] = falling[-1] if falling else -1
        falling.append(i)
    begin, end = np.append(after, first)[left], np.append(before, last)[right]
    cut = np.flatnonzero((end - begin) / 3.6e9 > max_dur).tolist()
    # The tree of the cuts by falling gaps: what lies in front of a cut ends in _1, behind it in _2.
    under: list[list[int]] = [[-1, -1] for _ in cut]
    falling = []
    for i, at in enumerate(cut):
        below = -1
        while falling and gap[cut[falling[-1]]] < gap[at]:
            below = falling.pop()
        under[i][0] = below
        if falling:
            under[falling[-1]][1] = i
        falling.append(i)
    endings, todo = [""] * (len(cut) + 1), [(falling[0], "")] if cut else []
    while todo:
        i, ending = todo.pop()
        for side, child in enumerate(under[i]):
            if child >= 0:
                todo.append((child, f"{ending}_{side + 1}"))
            else:
                endings[i + side] = f"{ending}_{side + 1}"
    return list(zip([-1, *cut], endings, strict=True))


def _labelled(df: DataFrame) -> DataFrame:
    """``_trip``, the number of a vessel's departure, for the pings of its trips; each vessel in order in one partition."""
    w = track()
    d = df.withColumn("_prev", F.lag("SI_HARB").over(w))
    d = d.withColumn("_dep", ((F.col("SI_HARB") == 0) & (F.coalesce("_prev", F.lit(1)) == 1)).cast("int"))
    d = d.withColumns({"_n": F.sum("_dep").over(so_far()), "_moves": F.coalesce(F.max(F.col("SI_HARB") != F.col("_prev")).over(W.partitionBy("vessel_id")), F.lit(False))})
    labelled = F.col("_moves") & ((F.col("SI_HARB") == 0) | (F.coalesce("_prev", F.lit(1)) == 0))
    return d.withColumn("_trip", F.when(labelled, F.col("_n"))).drop("_prev", "_dep", "_n", "_moves")


def _micros(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)


def define_trips_pol(df: DataFrame, min_dur: float = 0.5, max_dur: float = 72.0, split_trips: bool = True, preserve_all: bool = False, least_gap_min: float = 3.0, rows: int = 100_000) -> DataFrame:
    """``trip_id`` of harbour-to-harbour trips; needs ``SI_HARB`` without nulls.

    A trip runs from the first ping out of harbour to the first back in it, which belongs to it; the
    end of the track ends one too. Ids count a vessel's departures, before trips of up to ``min_dur``
    hours are dropped. Longer ones than ``max_dur`` are cut at their longest gap (if that has
    ``least_gap_min`` minutes), and their parts again. A vessel that never changes state has no trip.
    ``preserve_all`` keeps the other pings, without a trip.

    With ``split_trips`` a task streams its vessels in order and names the parts of some ``rows`` pings'
    trips at once; a trip must fit a task. Where only the trips' times are wanted ``trip_intervals`` needs no pings.
    """
    d = _labelled(df)
    if not split_trips:
        one = W.partitionBy("vessel_id", "_trip")
        hours = (F.max(micros("time_stamp")).over(one) - F.min(micros("time_stamp")).over(one)) / F.lit(3.6e9)
        out = d.withColumn("trip_id", F.when(F.col("_trip").isNotNull() & (hours > min_dur), trip_key(F.col("vessel_id"), F.col("_trip")))).drop("_trip")
        return out if preserve_all else out.filter("trip_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, found in whole_groups(batches, rows, "vessel_id", "_trip"):
            t, name = _micros(table, "time_stamp"), table["trip_id"].combine_chunks()
            first, last = t[found[:-1]], t[found[1:] - 1]
            hours = (last - first) / 3.6e9
            keep = np.repeat((hours > min_dur) & name.is_valid().to_numpy(zero_copy_only=False)[found[:-1]], np.diff(found))
            endings = np.full(len(t), "", object)
            for i in np.flatnonzero((hours > max_dur) & keep[found[:-1]]):
                a, b = found[i], found[i + 1]
                gaps = np.flatnonzero(np.diff(t[a:b]) / 6e7 >= least_gap_min) + a + 1
                parts = _cuts(t[gaps - 1], t[gaps], first[i], last[i], max_dur)
                starts = [a, *(gaps[g] for g, _ in parts[1:]), b]
                for (_, ending), low, high in zip(parts, starts[:-1], starts[1:], strict=True):
                    endings[low:high] = ending
                    keep[low:high] = (t[high - 1] - t[low]) / 3.6e9 > max(min_dur, 0.0)
            named = pc.if_else(pa.array(keep), pc.binary_join_element_wise(name, pa.array(endings, pa.string()), ""), pa.scalar(None, pa.string()))
            table = table.drop_columns(["_trip", "trip_id"]).append_column("trip_id", named)
            yield from (table if preserve_all else table.filter(pa.array(keep))).to_batches()

    d = d.withColumn("trip_id", F.when(F.col("_trip").isNotNull(), trip_key(F.col("vessel_id"), F.col("_trip"))))
    return d.sortWithinPartitions("vessel_id", "time_stamp", "rec_id").mapInArrow(run, d.drop("_trip").schema)


def trip_intervals(df: DataFrame, min_dur: float = 0.5, max_dur: float = 72.0, least_gap_min: float = 3.0, rows: int = 100_000) -> DataFrame:
    """``vessel_id, trip_id, depart, return`` of the trips that ``define_trips_pol`` gives pings to; needs no other column than it does.

    Of a trip only its first and last ping and those behind a gap of ``least_gap_min`` minutes leave the
    windows, which is what can bound a part.
    """
    w = track()
    d = _labelled(df.select("vessel_id", "time_stamp", "rec_id", "SI_HARB"))
    d = d.withColumns({"_before": F.lag("_trip").over(w), "_behind": F.lead("_trip").over(w), "_since": F.lag("time_stamp").over(w)})
    first, last = ~F.col("_before").eqNullSafe(F.col("_trip")), ~F.col("_behind").eqNullSafe(F.col("_trip"))
    gap = ~first & (seconds_between(F.col("_since"), F.col("time_stamp")) / 60 >= least_gap_min)
    d = d.filter(F.col("_trip").isNotNull() & (first | last | gap)).select("vessel_id", "_trip", "time_stamp", "rec_id", F.when(gap, F.col("_since")).alias("_since"))
    kind = df.schema["time_stamp"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, found in whole_groups(batches, rows, "vessel_id", "_trip"):
            t = _micros(table, "time_stamp")
            since = table["_since"].combine_chunks()
            gaps, since = since.is_valid().to_numpy(zero_copy_only=False), _micros(table.set_column(table.schema.get_field_index("_since"), "_since", pc.coalesce(since, pa.scalar(0, since.type))), "_since")
            first, last = t[found[:-1]], t[found[1:] - 1]
            hours = (last - first) / 3.6e9
            whole = (hours > min_dur) & (hours <= max_dur)
            of, ending, depart, back = [np.flatnonzero(whole)], [""] * int(whole.sum()), [first[whole]], [last[whole]]
            for i in np.flatnonzero((hours > min_dur) & (hours > max_dur)):
                at = np.flatnonzero(gaps[found[i] : found[i + 1]]) + found[i]
                parts = _cuts(since[at], t[at], first[i], last[i], max_dur)
                cut = at[[g for g, _ in parts[1:]]] if len(parts) > 1 else at[:0]
                begin, end = np.append(first[i], t[cut]), np.append(since[cut], last[i])
                good = np.flatnonzero((end - begin) / 3.6e9 > max(min_dur, 0.0))
                of.append(np.full(len(good), i))
                ending += [parts[g][1] for g in good]
                depart.append(begin[good])
                back.append(end[good])
            rows_of = pa.array(found[:-1][np.concatenate(of)])
            ids, number = table["vessel_id"].combine_chunks().take(rows_of), table["_trip"].combine_chunks().take(rows_of)
            # As trip_key writes it: a null vessel adds nothing.
            lead = pc.if_else(ids.is_valid(), pc.binary_join_element_wise(pc.fill_null(ids, ""), "", "_"), "")
            name = pc.binary_join_element_wise(lead, number.cast(pa.string()), pa.array(ending, pa.string()), "")
            time = table.schema.field("time_stamp").type
            yield pa.RecordBatch.from_arrays([ids, name, *(pa.array(np.concatenate(x), pa.int64()).view(time) for x in (depart, back))], names=["vessel_id", "trip_id", "depart", "return"])

    return d.sortWithinPartitions("vessel_id", "time_stamp", "rec_id").mapInArrow(run, f"vessel_id string, trip_id string, depart {kind}, return {kind}")


def harbour_offsets(df: DataFrame, blocks: int = 200) -> DataFrame:
    """``vessel_id, _base``: the number of pings in harbour of all vessels before.

    Vessels' totals are summed up over blocks of vessels first, so no table-wide window is needed: a
    vessel's offset is its block's plus that within the block. A block is a range of vessels of about
    equal size, whatever their ids look like.
    """
    inside = df.groupBy("vessel_id").agg(F.sum("SI_HARB").alias("n"))
    inside = staged(inside.repartitionByRange(blocks, "vessel_id").withColumn("part", F.spark_partition_id()), "vessel-totals", narrow=True)
    parts = inside.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row per block
    inner = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("vessel_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return inside.withColumn("inner", inner).join(before, "part").select("vessel_id", (F.col("inner") + F.col("base")).alias("_base"))


def trips_cumulative(df: DataFrame, blocks: int = 200) -> DataFrame:
    """``trip``: for pings at sea the number of pings in harbour before them in the whole table, by vessel and time; 1 in harbour.

    Vessels' totals are written while the plan is built.
    """
    d = df.withColumn("_own", F.sum("SI_HARB").over(so_far())).join(harbour_offsets(df, blocks), "vessel_id")
    return d.withColumn("trip", F.when(F.col("SI_HARB") == 1, F.lit(1)).otherwise(F.col("_base") + F.col("_own")).cast("long")).drop("_own", "_base")


def compare_trip_counts(by_harbour: DataFrame, cumulative: DataFrame) -> DataFrame:
    """Number of trips by either rule, in one row."""
    a = by_harbour.agg(F.count_distinct("trip_id").alias("n_harbour"))
    b = cumulative.filter("SI_HARB = 0").agg(F.count_distinct("trip").alias("n_cumulative"))
    return a.join(F.broadcast(b)).withColumn("more", F.col("n_cumulative") - F.col("n_harbour"))


def trip_schedule(df: DataFrame) -> DataFrame:
    """``depart``, ``return``, ``duration_hrs`` of each trip."""
    return with_hours(df.filter("trip_id is not null").groupBy("vessel_id", "trip_id").agg(F.min("time_stamp").alias("depart"), F.max("time_stamp").alias("return")))


def with_hours(intervals: DataFrame) -> DataFrame:
    """``duration_hrs`` of ``depart, return``."""
    return intervals.withColumn("duration_hrs", F.round(seconds_between(F.col("depart"), F.col("return")) / 3600, 6))


def trip_duration_filter(df: DataFrame, min_min: int = 99, key: str = "vessel_trip") -> DataFrame:
    """Pings of trips of more than that many minutes, rounded half to even."""
    w = W.partitionBy(key)
    minutes = F.bround((F.max(micros("time_stamp")).over(w) - F.min(micros("time_stamp")).over(w)) / F.lit(6e7), 0)
    return df.withColumn("duration_min", minutes).filter(F.col("duration_min") > min_min)


def trip_summary(df: DataFrame, burst: str = "burst") -> DataFrame:
    """Distance and hours travelled and number of days; needs ``dist`` and ``dt``."""
    return df.groupBy(burst).agg(F.sum("dist").alias("dist_travelled"), F.sum(F.col("dt") / 3600).alias("time_travelled"), F.count_distinct(F.to_date("time_stamp")).alias("n_days"))


def drop_short_trips(df: DataFrame, hours: float = 1.0, burst: str = "burst") -> DataFrame:
    """Pings of bursts of that many hours or more, by a sum over the burst."""
    travelled = F.coalesce(F.sum(F.col("dt") / 3600).over(W.partitionBy(burst)), F.lit(0.0))
    return df.withColumn("_hours", travelled).filter(F.col("_hours") >= hours).drop("_hours")


def trip_lines(df: DataFrame, key: str = "vessel_trip") -> DataFrame:
    """``wkt``: each trip's points as one line, in time order."""
    points = F.array_sort(F.collect_list(F.struct("time_stamp", "rec_id", "lon", "lat")))
    text = F.array_join(F.transform("points", lambda p: F.format_string("%.6f %.6f", p["lon"], p["lat"])), ", ")
    return df.groupBy(key).agg(points.alias("points")).select(key, F.concat(F.lit("LINESTRING ("), text, F.lit(")")).alias("wkt"), F.size("points").cast("long").alias("n_points"))


def close_ring(df: DataFrame, key: str, order: str) -> DataFrame:
    """``ring``: vertices in order, repeats left out, the first one once more at the end."""
    first = df.withColumn("_n", F.row_number().over(W.partitionBy(key, "lon", "lat").orderBy(order))).filter("_n = 1")
    ring = F.transform(F.array_sort(F.collect_list(F.struct(order, "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return first.groupBy(key).agg(ring.alias("ring")).withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))


def segment_features(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Mean, quartiles, skewness and kurtosis of the columns, per trip or event."""
    out = []
    for c in cols:
        out += [F.avg(c).alias(f"{c}_mean"), *[F.percentile(c, F.lit(q)).alias(f"{c}_q{int(q * 100)}") for q in (0.25, 0.5, 0.75)], F.skewness(c).alias(f"{c}_skewness"), F.kurtosis(c).alias(f"{c}_kurtosis")]
    return df.groupBy(key).agg(*out)
