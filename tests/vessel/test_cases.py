"""Hand-made cases of the track operators."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wakeline.functions import geo
from wakeline.operators import behaviour, clean, covariates, interpolate, joins, ml, quality, track, trips
from wakeline.sources import tables

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *cols, order="rec_id"):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.orderBy(order).select(*cols).collect()]


def pings(spark, rows):
    """``(vessel, minutes, lon, lat)`` rows."""
    full = [(i, v, at(m), float(x), float(y)) for i, (v, m, x, y) in enumerate(rows)]
    return frame(spark, full, "rec_id long, vessel_id string, time_stamp timestamp, lon double, lat double")


def test_trip_runs_and_events(spark):
    one = [None, None, 202, None, None, 202, 202]
    two = [202, *[None] * 8, 202]
    rows = [(i, v, at(i), h) for i, (v, h) in enumerate([("1", h) for h in one] + [("2", h) for h in two])]
    df = frame(spark, rows, "rec_id long, vessel_id string, time_stamp timestamp, hid int")
    assert values(track.rb_define_trips(df), "trip") == [1, 1, -1, 2, 2, -2, -2, -1, *[1] * 8, -2]
    assert values(track.rb_event(df.filter("vessel_id = '1'"), "hid"), "event") == [1, 2, 3, 4, 5, 6, 6]


def test_scalars(spark):
    df = frame(spark, [(-24.0, 65.0, -24.0, 66.0), (1.0, 2.0, 1.0, 2.0), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    got = df.select(F.round(geo.arcdist(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 6), F.round(geo.arcdist(F.col("a"), F.col("b"), F.col("c"), F.col("d"), "km"), 6)).collect()
    assert [tuple(r) for r in got] == [(60.028691, 111.125113), (0.0, 0.0), (None, None)]
    one = spark.range(1).select(geo.ms2kn(F.lit(1.0)), geo.kn2ms(geo.ms2kn(F.lit(3.5))), geo.zero_pad(F.lit(42), 5), tables.excel_date(F.lit(45292)).cast("string"), tables.parse_time(F.lit("bad"))).first()
    assert one[0] == 1.94384449 and one[1] == pytest.approx(3.5) and one[2:4] == ("000", "2024-01-01") and one[4] is None
    x, y = geo.to_utm(F.lit(9.0), F.lit(0.0), 32)
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((500000.0, 0.0))
    x, y = geo.to_utm(F.lit(12.5), F.lit(55.7), 32)
    back = geo.from_utm(x, y, 32)
    assert tuple(spark.range(1).select(*back).first()) == pytest.approx((12.5, 55.7), abs=1e-8)


def test_short_arcs_have_the_last_bits_of_the_c_library(spark):
    """The JVM's cosine of the second latitude is one bit off, which over 600 m is in the eighth digit of the arc."""
    spots = [(0, 14.023462, 57.499310, 14.013616, 57.499768), (1, None, 1.0, 2.0, 3.0), (2, math.inf, 1.0, 2.0, 3.0), (3, math.nan, 1.0, 2.0, 3.0)]
    df = frame(spark, spots, "rec_id long, a double, b double, c double, d double")
    a, b, c, d = map(math.radians, spots[0][1:])
    angle = math.acos(math.sin(b) * math.sin(d) + math.cos(b) * math.cos(d) * math.cos(a - c))
    assert values(df.withColumn("km", geo.arcdist(*map(F.col, "abcd"), "km")), "km") == [6367.0 * angle, None, 0.0, 0.0]


def test_gap_filling(spark):
    def count(gap, h=(0, 0)):
        df = pings(spark, [("V", 0, 0, 50), ("V", gap, 3, 50)]).withColumns({"speed": F.lit(17.5), "course": F.lit(None).cast("double"), "SI_HARB": F.when(F.col("rec_id") == 0, h[0]).otherwise(h[1])})
        return interpolate.interpolate_ais(df).filter("source = 'INT'").orderBy("time_stamp").collect()

    assert len(count(2)) == 0 and len(count(120.5)) == 0 and len(count(10, (1, 1))) == 0
    assert [(r.time_stamp - T0).total_seconds() / 60 for r in count(2.5)] == [1.25]
    assert [r.lon for r in count(3)] == [1.5] and len(count(120)) == 118
    curve = pings(spark, [("V", 0, 0, 0), ("V", 3, 3, 0)]).withColumns({"speed": F.lit(17.5), "SI_HARB": F.lit(0)})
    bent = interpolate.interpolate_ais(curve.withColumn("course", F.when(F.col("rec_id") == 0, 90.0).otherwise(270.0))).filter("source = 'INT'").first()
    assert bent.lon == pytest.approx(1.505) and bent.SI_HARB == 0
    same = interpolate.interpolate_ais(curve.withColumn("course", F.lit(90.0))).filter("source = 'INT'").first()
    assert same.lon == pytest.approx(1.5)


def harbour(spark, pairs):
    rows = [(i, "V", at(m), h) for i, (m, h) in enumerate(pairs)]
    return frame(spark, rows, "rec_id long, vessel_id string, time_stamp timestamp, SI_HARB int")


CASE = [(0, 1), (60, 0), (120, 0), (180, 1), (240, 0), (250, 1), (300, 0), (400, 0)]


def test_harbour_trips(spark):
    got = values(trips.define_trips_pol(harbour(spark, CASE), 0.5, 72), "rec_id", "trip_id")
    assert got == [(1, "V_1"), (2, "V_1"), (3, "V_1"), (6, "V_3"), (7, "V_3")]
    assert trips.define_trips_pol(harbour(spark, [(0, 0), (60, 0)]), 0.5, 72).count() == 0
    kept = trips.define_trips_pol(harbour(spark, [(0, 0), (60, 0)]), 0.5, 72, preserve_all=True)
    assert values(kept, "trip_id") == [None, None]
    long = harbour(spark, [(-60, 1), (0, 0), (60, 0), (120, 0), (360, 0), (420, 0), (480, 1)])
    cut = trips.define_trips_pol(long, 0.5, 5)
    assert values(cut, "rec_id", "trip_id") == [(1, "V_1_1"), (2, "V_1_1"), (3, "V_1_1"), (4, "V_1_2"), (5, "V_1_2"), (6, "V_1_2")]
    cumulative = trips.trips_cumulative(harbour(spark, CASE))
    assert values(cumulative.filter("SI_HARB = 0"), "trip") == [1, 1, 2, 3, 3]


def plain_parts(times, name, max_dur, least):
    """Name of each ping's part, cut at the longest gap again and again."""
    if (times[-1] - times[0]) / 3600 > max_dur and len(times) > 1:
        gaps = np.diff(times)
        if gaps.max() / 60 >= least:
            at = int(gaps.argmax()) + 1
            return plain_parts(times[:at], name + "_1", max_dur, least) + plain_parts(times[at:], name + "_2", max_dur, least)
    return [(name, (times[-1] - times[0]) / 3600)] * len(times)


def test_split_trips_equal_plain_ones(spark):
    draw, rows, want = random.Random(8), [], []
    for v in range(60):
        sec, harb = 0, draw.randint(0, 1)
        track = []
        for _ in range(draw.choice([1, 2, 5, 60, 300])):
            sec += draw.choice([0, 60, 60, 179, 180, 600, 600, 3600])
            harb = harb if draw.random() < 0.97 else 1 - harb
            track.append((len(rows), f"V{v}" if v else None, T0 + dt.timedelta(seconds=sec), harb, sec))
            rows.append(track[-1][:4])
        trip, n, open_ = [], 0, False
        for i, r in enumerate(track):
            if r[3] == 0 and (i == 0 or track[i - 1][3] == 1):
                n, open_ = n + 1, True
            if open_:
                trip.append((n, r))
            if r[3] == 1:
                open_ = False
        if len({r[3] for r in track}) < 2:
            continue
        for k in range(1, n + 1):
            of = [r for m, r in trip if m == k]
            times = [r[4] for r in of]
            if (times[-1] - times[0]) / 3600 <= 0.5:
                continue
            for r, (name, hours) in zip(of, plain_parts(times, f"V{v}_{k}" if v else f"{k}", 2.0, 3.0), strict=True):
                if hours > 0.5:
                    want.append((r[0], name))
    df = frame(spark, rows, "rec_id long, vessel_id string, time_stamp timestamp, SI_HARB int").withColumn("extra", F.lit("x"))
    for size in (10, 100_000):
        got = trips.define_trips_pol(df, 0.5, 2.0, rows=size)
        assert sorted(values(got, "rec_id", "trip_id")) == sorted(want) and got.columns == [*df.columns, "trip_id"]
        every = values(trips.define_trips_pol(df, 0.5, 2.0, preserve_all=True, rows=size), "rec_id", "trip_id")
        assert len(every) == len(rows) and sorted(r for r in every if r[1]) == sorted(want)
        assert Counter(map(tuple, trips.with_hours(trips.trip_intervals(df, 0.5, 2.0, rows=size)).collect())) == Counter(map(tuple, trips.trip_schedule(got).collect()))
    assert len({n for _, n in want}) > 100 and max(n.count("_") for _, n in want) > 5
    plan = trips.define_trips_pol(df, 0.5, 2.0)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and plan.count("Exchange hashpartitioning") <= 2 * plan.count("== ")
    assert trips.trip_intervals(df.limit(0)).count() == trips.define_trips_pol(df.limit(0)).count() == 0


def test_gap_trips_and_downsampling(spark):
    rows = [(0, "V", T0), (1, "V", T0 + dt.timedelta(seconds=10799)), (2, "V", T0 + dt.timedelta(seconds=21599))]
    df = frame(spark, rows, "rec_id long, vessel_id string, time_stamp timestamp")
    assert values(trips.trips_by_gap(df), "vessel_trip") == ["V_1", "V_1", "V_2"]
    rows = [(i, "V", T0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 50, 70, 130])]
    df = frame(spark, rows, "rec_id long, vessel_id string, time_stamp timestamp")
    assert values(joins.downsample_ais_timestep(df, "min", 1), "keep") == [1, 1, 0, 1]


def test_downsampling_equals_nearest(spark):
    rng, rows, expected = random.Random(1), [], {}
    for v in range(60):
        times = sorted(rng.randrange(0, 900) for _ in range(rng.randint(1, 14)))
        first = len(rows)
        rows += [(first + i, f"V{v}", T0 + dt.timedelta(seconds=s)) for i, s in enumerate(times)]
        a, b = ((t + 30) // 60 * 60 for t in (times[0], times[-1]))
        chosen = {min(range(len(times)), key=lambda i: (abs(times[i] - g), times[i], i)) for g in range(a, b + 1, 60)}
        expected |= {first + i: int(i in chosen) for i in range(len(times))}
    df = frame(spark, rows, "rec_id long, vessel_id string, time_stamp timestamp")
    assert dict(values(joins.downsample_ais_timestep(df), "rec_id", "keep")) == expected


def test_features_of_steps(spark):
    df = pings(spark, [("V", 0, 0, 0), ("V", 1 / 6, 0, 0), ("V", 1 / 6, 0, 0)]).withColumns({"speed": F.lit(10.0), "course": F.element_at(F.array(F.lit(350.0), F.lit(10.0), F.lit(20.0)), (F.col("rec_id") + 1).cast("int"))})
    assert values(track.calc_straightness(df), "abs_heading_change") == [1.0, 340.0, 10.0]
    got = values(track.calc_acceleration(df), "acceleration")
    assert got[0] == 0.0 and got[1] == pytest.approx(0.514444, abs=1e-6) and got[2] is None


def test_fast_steps(spark):
    x = [0, 100, 1e6, 200, 300]
    df = frame(spark, [(i, "V", at(i), float(v), 0.0, "b") for i, v in enumerate(x)], "rec_id long, vessel_id string, time_stamp timestamp, x double, y double, burst string")
    assert values(clean.remove_fast_steps(df), "rec_id") == [0, 3, 4]


def test_fast_steps_of_many_bursts_equal_plain_passes(spark):
    draw, rows, want = random.Random(4), [], set()
    for b in range(80):
        sec, burst = 0, []
        for _ in range(draw.choice([1, 2, 3, 40, 200])):
            sec += draw.choice([0, 1, 10, 10, 60])
            burst.append((len(rows), f"V{b % 7}", at(sec), draw.choice([0.0, 50.0, draw.uniform(0, 2000)]), draw.uniform(0, 100), f"b{b}" if b else None))
            rows.append(burst[-1])
        while len(burst) > 1:
            with np.errstate(divide="ignore", invalid="ignore"):
                step = [np.float64(np.hypot(q[3] - p[3], q[4] - p[4])) / np.float64((q[2] - p[2]).total_seconds()) * 1.94384449 for p, q in zip(burst, burst[1:], strict=False)]
            if not any(s > 25 for s in step):
                break
            burst = [r for r, s in zip(burst, [*step, 0], strict=True) if not s > 25]
        want |= {r[0] for r in burst}
    df = frame(spark, rows, "rec_id long, vessel_id string, time_stamp timestamp, x double, y double, burst string")
    for size in (7, 100_000):
        assert set(values(clean.remove_fast_steps(df, rows=size), "rec_id")) == want
    assert clean.remove_fast_steps(df.limit(0)).count() == 0 and 100 < len(want) < len(rows) - 100


def test_rings(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    polys = frame(spark, [(1, [{"lon": a, "lat": b} for a, b in square]), (2, [{"lon": a + 0.5, "lat": b} for a, b in square])], "harbour_id long, ring array<struct<lon:double,lat:double>>")
    df = pings(spark, [("V", 0, 0.5, 0.5), ("V", 1, 0, 0.3), ("V", 2, 1.6, 0.5), ("V", 3, 0.7, 1.0001), ("V", 4, 1.2, 0.2)])
    got = joins.add_harbours(df, polys)
    assert values(got, "SI_HARB") == [1, 1, 0, 0, 1] and got.count() == 5
    corners = frame(spark, [(1, i, a, b) for i, (a, b) in enumerate(square)], "k int, i int, lon double, lat double")
    assert len(trips.close_ring(corners, "k", "i").first().ring) == 5
    assert len(trips.close_ring(corners.filter("i < 4"), "k", "i").first().ring) == 5


def test_points_in_line_with_a_side_but_off_its_end(spark):
    """A ping at the very longitude of an upright side and just past its end is outside; on the end it is inside."""
    x1, x2, y1, y2 = (12 + 0.2 - 0.08, 12 + 0.2 + 0.08, 58.2 - 0.08, 58.2 + 0.08)
    square = [{"lon": a, "lat": b} for a, b in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))]
    polys = frame(spark, [(1, square)], "harbour_id long, ring array<struct<lon:double,lat:double>>")
    off = [(x, float(np.nextafter(y, y + d))) for x in (x1, x2) for y, d in ((y1, -1), (y2, 1))] + [(x, y + d) for x in (x1, x2) for y, d in ((y1, -0.01), (y2, 0.01))]
    spots = off + [(x, y) for x in (x1, x2) for y in (y1, y2)]
    df = pings(spark, [("V", m, x, y) for m, (x, y) in enumerate(spots)])
    assert values(joins.add_harbours(df, polys), "SI_HARB") == [0] * len(off) + [1] * 4


def test_folds(spark):
    df = spark.range(60).select(F.col("id").alias("rec_id"), F.concat(F.lit("t"), F.col("id") % 12).alias("trip_id"))
    got = ml.trip_folds(df).select("trip_id", "fold").distinct().collect()
    assert len(got) == 12 and sorted(sum(r.fold == f for r in got) for f in range(1, 6)) == [2, 2, 2, 2, 4]
    assert sum(r.fold == 5 for r in got) == 4


def test_neighbours_equal_plain_ones(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=37), rng.normal(size=37)
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    np.fill_diagonal(d, np.inf)
    once = np.ones(37, np.int64)
    assert np.allclose(covariates.nearest(x, y, once, 5, chunk=8), np.sort(d, axis=1)[:, :5])
    assert np.allclose(covariates.nearest(x[:30], y[:30], once[:30], 5, (x[30:], y[30:])), np.sort(d[30:, :30], axis=1)[:, :5])
    assert np.isnan(covariates.nearest(x[:2], y[:2], once[:2], 3)[:, 1:]).all() and np.isnan(covariates.nearest(x[:0], y[:0], once[:0], 2, (x, y))).all()
    # Positions that stand for several pings.
    often = rng.integers(1, 4, 37)
    every = np.repeat(np.arange(37), often)
    d = np.hypot(x[every][:, None] - x[every], y[every][:, None] - y[every])
    np.fill_diagonal(d, np.inf)
    first = np.searchsorted(every, np.arange(37))
    assert np.allclose(covariates.nearest(x, y, often, 6), np.sort(d, axis=1)[first, :6])
    few = covariates.knn_distances(pings(spark, [("V", 0, 10, 55), ("V", 1, 10, 55.001)]).withColumn("trip_id", F.lit("t")), 3).first()
    assert few.dist_neighbour_1 == pytest.approx(111.3, abs=0.5) and few.dist_neighbour_2 is None


def test_neighbours_in_tiles_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for trip, n in (("a", 1500), ("b", 300), ("c", 30), ("d", 3), (None, 5)):
        walk = np.cumsum(rng.normal(0, 0.0005, (n, 2)), axis=0) + [10, 55]
        walk[: n // 3] = walk[0]  # moored
        walk[n // 2 : n // 2 + n // 10, 0] = walk[n // 2, 0]  # due north
        rows += [(trip, float(x), float(y)) for x, y in walk]
    rows += [("a", None, 55.0), ("a", 11.5, 54.0), ("a", 11.5, 54.0)]
    df = frame(spark, [(i, *r, "s") for i, r in enumerate(rows)], "rec_id long, trip_id string, lon double, lat double, _m string").repartition(3)
    flat = {r.rec_id: (r.trip_id, r.x, r.y) for r in covariates.local_projection(df).collect()}
    want = {}
    for trip in "abcd":
        ids = np.array([i for i, (t, x, _) in flat.items() if t == trip and x is not None])
        x, y = (np.array([flat[i][j] for i in ids]) for j in (1, 2))
        d = np.hypot(x[:, None] - x, y[:, None] - y)
        np.fill_diagonal(d, np.inf)
        want |= dict(zip(ids.tolist(), np.sort(d, axis=1)[:, :4].tolist(), strict=True))
    for tile in (40, 2000):
        got = covariates.knn_distances(df, 4, tile=tile)
        assert got.columns == [*df.columns, *(f"dist_neighbour_{i}" for i in range(1, 5))]
        got = {r.rec_id: [r[f"dist_neighbour_{i}"] for i in range(1, 5)] for r in got.collect()}
        assert len(got) == len(rows)
        for i, d in got.items():
            expected = [None if v == np.inf else v for v in want.get(i, [])] + [None] * (4 - len(want.get(i, [])))
            assert d == [None if v is None else pytest.approx(v, abs=1e-9) for v in expected]
    spots = df.filter("lon is not null and trip_id = 'a'").groupBy("trip_id", F.col("lon").alias("x"), F.col("lat").alias("y")).agg(F.count("*").alias("_m"))
    tiles = covariates._cut(covariates._cut(spots, ["trip_id"], "x", "_strip", F.ceil(F.sqrt(F.col("_n") / 40))), ["trip_id", "_strip"], "y", "_tile", F.ceil(F.col("_n") / 40))
    sizes = [r["count"] for r in tiles.groupBy("trip_id", "_strip", "_tile").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 120
    assert covariates.knn_distances(df.limit(0)).count() == 0


def test_mixture_and_states():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(1, 0.3, 300), rng.normal(4, 0.5, 300), rng.normal(8, 0.6, 300)])
    weight, mu, _ = behaviour.normal_mixtures(x[:, None], np.ones((900, 1)), (1, 4, 8), (1, 1, 1))
    assert np.allclose(mu, [[1, 4, 8]], atol=0.15) and np.allclose(weight, 1 / 3, atol=0.05)
    truth = np.repeat([1, 2, 3, 1, 3], 60)
    step = rng.gamma(25, np.array([0, 20, 150, 300])[truth] / 25)
    turn = np.where(truth == 3, rng.normal(0, 0.2, 300), rng.uniform(-3.1, 3.1, 300))
    # A shorter track beside it: each is fitted as if alone.
    both, on = np.full((300, 2), np.nan), np.ones((300, 2), bool)
    both[:, 0], both[:200, 1], on[200:, 1] = step, step[:200] * 2, False
    start = (np.array([[20.0, 150, 300], [40, 300, 600]]), np.array([[5.0, 30, 60], [10, 60, 120]]))
    states, chains = behaviour.hidden_markov(both, None, on, *start)
    assert (states[:, 0] == truth).mean() > 0.95 and (states[:200, 1] == truth[:200]).mean() > 0.95
    one, alone = behaviour.hidden_markov(both[:200, 1:], None, on[:200, 1:], start[0][1:], start[1][1:])
    assert (one[:, 0] == states[:200, 1]).all() and np.allclose(alone.mean[0], chains.mean[1]) and np.allclose(alone.move[0], chains.move[1])
    turned, chains = behaviour.hidden_markov(step[:, None], turn[:, None], on[:, :1], start[0][:1], start[1][:1], behaviour.TURN_MEAN, behaviour.KAPPA)
    assert (turned[:, 0] == truth).mean() > 0.95 and chains.kappa[0].argmax() == 2 and abs(chains.turn_mean[0, 2]) < 0.1


def test_vessels_stay_whole_across_batches():
    ids = ["a"] * 5 + ["b"] * 1 + [None] * 3 + ["c"] * 40 + ["d"] * 2
    table = pa.table({"vessel_id": ids, "n": range(len(ids))})
    got = [(t["vessel_id"].to_pylist(), b.tolist(), t["n"].to_pylist()) for t, b in behaviour.whole_vessels(iter(table.to_batches(max_chunksize=4)), 6)]
    assert [i for x, _, _ in got for i in x] == ids and [n for *_, ns in got for n in ns] == list(range(len(ids)))
    assert [[x[a] for a in b[:-1]] for x, b, _ in got] == [["a"], ["b", None], ["c", "d"]] or sum(len(b) - 1 for _, b, _ in got) == 5


def test_behaviour_of_tracks(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for v, few in (("A", 0), ("B", 0), ("C", 4)):
        lon = 0.0
        for i in range(few or 200):
            lon += rng.gauss((0.0002, 0.0015, 0.003)[i // 70], 0.00005)
            rows.append((n, v, at(i), lon, 0.0))
            n += 1
    df = frame(spark, rows, "rec_id long, vessel_id string, time_stamp timestamp, lon double, lat double").repartition(3)
    got = {r.rec_id: r for r in behaviour.hmm_step(df).collect()}
    assert len(got) == n and all(got[i].state is None for i in range(400, n))
    for first in (0, 200):
        assert sum(got[first + i].state == i // 70 + 1 for i in range(200)) > 190
    assert sum(r.state is not None for r in behaviour.hmm_step_turn(df).collect()) == 400
    params = {(r.vessel_id, r.par): r.value for r in behaviour.hmm_params(df).collect()}
    assert len(params) == 2 * 24 and 15 < params["A", "step_mean_1"] < 30 and 280 < params["B", "step_mean_3"] < 380
    for v in "AB":
        assert abs(sum(params[v, f"gamma_2_{j}"] for j in (1, 2, 3)) - 1) < 1e-6
    clusters = behaviour.binary_clusters(df).collect()
    assert len(clusters) == n and {r.cluster for r in clusters if r.vessel_id == "C"} == {None} and {r.cluster for r in clusters} <= {None, 1, 2, 3, 4} and len({r.cluster for r in clusters}) > 2
    speeds = {r.vessel_id: r for r in behaviour.gaussian_speed(df).collect()}
    modes = behaviour.mixture_params(df).filter("mode = 1").collect()
    assert {r.vessel_id for r in modes} == {"A", "B", "C"}
    for r in modes:
        assert speeds[r.vessel_id].upper == pytest.approx(r.mu + 1.96 * r.sigma)


def circle(cx, cy, r, sides, wobble=0.0):
    turn = np.linspace(0, 2 * np.pi, sides, endpoint=False)
    reach = r * (1 + wobble * np.sin(turn * 37))
    ring = [(float(x), float(y)) for x, y in zip(cx + reach * np.cos(turn), cy + reach * np.sin(turn), strict=True)]
    return [*ring, ring[0]]


def plain_inside(x, y, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
        if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def test_points_in_rings_of_any_shape(spark):
    rings = [circle(10, 55, 0.7, 500, 0.2), circle(11.5, 55, 0.031, 7), [(9.0, 54.0), (9.3, 54.0), (9.3, 54.3), (9.2, 54.3), (9.2, 54.1), (9.1, 54.1), (9.1, 54.3), (9.0, 54.3), (9.0, 54.0)], circle(10.1, 55.1, 0.3, 40)]
    rng = random.Random(6)
    points = [(rng.uniform(8.9, 11.6), rng.uniform(53.9, 55.9)) for _ in range(3000)] + [(9.0 + i / 20, 54.0 + j / 20) for i in range(8) for j in range(8)] + [rings[0][3], rings[3][0]]
    polys = frame(spark, [([{"lon": a, "lat": b} for a, b in r],) for r in rings] + [(None,)], "ring array<struct<lon:double,lat:double>>")
    df = pings(spark, [("V", i, *p) for i, p in enumerate(points)])
    assert values(joins.add_harbours(df, polys.unionByName(polys)), "SI_HARB") == [int(any(plain_inside(x, y, r) for r in rings)) for x, y in points]
    dry = joins.remove_land(df.limit(800), frame(spark, [([{"lon": a, "lat": b} for a, b in rings[3]],)], polys.schema), 32, 3000.0)
    utm = lambda p: tuple(p)
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), 32)
    planar = [utm(r) for r in frame(spark, rings[3], "lon double, lat double").select(x, y).collect()]
    at_sea = set()
    for i, (px, py) in enumerate(frame(spark, points[:800], "lon double, lat double").select(x, y).collect()):
        a, b = np.array(planar[:-1]), np.array(planar[1:])
        t = np.clip((((px, py) - a) * (b - a)).sum(axis=1) / ((b - a) ** 2).sum(axis=1), 0, 1)[:, None]
        if not plain_inside(px, py, planar) and np.hypot(*((px, py) - a - t * (b - a)).T).min() > 3000:
            at_sea.add(i)
    assert {r.rec_id for r in dry.collect()} == at_sea and 0 < len(at_sea) < 800


def test_a_coast_of_very_many_sides_is_spread_over_cells(spark):
    ring = circle(10, 55, 3.0, 100_000, 0.1)
    polys = spark.createDataFrame([([{"x": a, "y": b} for a, b in ring],)], "ring array<struct<x:double,y:double>>")
    held = joins.ring_cells(polys, 0.1).agg(F.count("*").alias("cells"), F.sum(F.aggregate("shapes", F.lit(0), lambda n, r: n + F.size(r["sides"]))).alias("sides"), F.max(F.aggregate("shapes", F.lit(0), lambda n, r: n + F.size(r["sides"]))).alias("most")).first()
    assert held.cells < 4000 and held.sides < 120_000 and held.most < 2000


def crossings(x, y, rings):
    """Whether an odd number of rings goes round the point, or it is on one."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


RINGS = "id int, rings array<array<struct<lon: double, lat: double>>>"


def test_lakes_islands_and_parts(spark):
    draw = random.Random(6)
    # A coast with a lake, an island in it, a second part; another that overlaps the first one's lake.
    shapes = [[circle(10, 55, 1.0, 300, 0.1), circle(10.1, 55.1, 0.5, 200, 0.05), circle(10.1, 55.1, 0.2, 50), circle(12.5, 55, 0.3, 40)], [circle(10.4, 55.2, 0.15, 30)]]
    polys = spark.createDataFrame([(i, rings) for i, rings in enumerate(shapes)], RINGS)
    spots = [(draw.uniform(8.5, 13), draw.uniform(53.5, 56.5)) for _ in range(3000)] + [shapes[0][1][7], shapes[0][2][3], (10.1, 55.1), (10.1, 55.45)]
    df = frame(spark, [(i, x, y) for i, (x, y) in enumerate(spots)], "rec_id long, lon double, lat double")
    want = [any(crossings(x, y, rings) for rings in shapes) for x, y in spots]
    assert values(joins.add_harbours(df, polys), "SI_HARB") == [int(w) for w in want] and 0.1 < np.mean(want) < 0.6
    # At sea: neither on land nor within 500 m of a side, both in metres.
    e, n = geo.to_utm(F.col("lon"), F.col("lat"), 32)
    metres = lambda points: [tuple(r) for r in frame(spark, points, "lon double, lat double").select(e, n).collect()]
    flat = [[metres(ring) for ring in rings] for rings in shapes]
    sides = np.array([(*a, *b) for rings in flat for ring in rings for a, b in zip(ring[:-1], ring[1:], strict=True)])
    dx, dy = sides[:, 2] - sides[:, 0], sides[:, 3] - sides[:, 1]
    sea = []
    for i, (x, y) in enumerate(metres(spots)):
        t = np.clip(((x - sides[:, 0]) * dx + (y - sides[:, 1]) * dy) / np.maximum(dx * dx + dy * dy, 1e-9), 0, 1)
        near = np.hypot(x - sides[:, 0] - t * dx, y - sides[:, 1] - t * dy).min()
        if near > 500 and not any(crossings(x, y, rings) for rings in flat):
            sea.append(i)
    assert values(joins.remove_land(df, polys, 32, 500.0), "rec_id") == sea and 0.3 < len(sea) / len(spots) < 0.9


def test_a_cover_grows_with_the_length_of_the_coast(spark):
    rows = []
    for side in (400, 800, 1600):
        square = [(3.0, 5.0), (3.0 + side, 5.0), (3.0 + side, 5.0 + side), (3.0, 5.0 + side), (3.0, 5.0)]
        coast = spark.createDataFrame([([[{"x": x, "y": y} for x, y in square]],)], "rings array<array<struct<x: double, y: double>>>")
        regions, blocks, cells = joins.cover(coast, 1.0, 0.0, 8)
        rows.append([regions.count(), blocks.count(), cells.count()])
        found = cells.select(F.explode("shapes").alias("s"))
        assert found.filter("size(s.sides) > 0").count() >= 4 * side
        # What lies inside: cells of blocks and regions that lie inside whole are left out, and no others.
        inner = found.filter("s.inside and size(s.sides) = 0").count()
        assert abs(rows[-1][0] * 64**2 + rows[-1][1] * 8**2 + inner - side**2) <= 8 * side
    assert sum(rows[2]) < 4.5 * sum(rows[0]) and sum(rows[2]) < 0.1 * 1600**2


def test_interval_join_equals_all_pairs(spark):
    draw = random.Random(9)
    trip_rows = []
    for i in range(300):
        begin = draw.uniform(0, 50_000)
        trip_rows.append((draw.choice(["A", "B", None]), at(begin), at(begin + draw.choice([0, 5, 10, 40, 200, 3000, 40_000])), f"t{i}"))
    trip_rows += trip_rows[:3] + [("C", at(0), at(10**7), "long"), ("A", at(9), at(5), "none")]  # repeats; longer than the greatest block; ends before it begins
    ping_rows = [(i, draw.choice(["A", "B", "C", "D", None]), at(draw.uniform(-10, 60_000))) for i in range(800)]
    ping_rows += [(1000 + i, t[0], t[1 + i % 2]) for i, t in enumerate(trip_rows)]  # on both ends
    p = frame(spark, ping_rows, "rec_id long, vessel_id string, time_stamp timestamp")
    t = frame(spark, trip_rows, "vessel_id string, depart timestamp, return timestamp, trip_id string")
    want = Counter((r[0], x[3]) for r in ping_rows for x in trip_rows if r[1] is not None and r[1] == x[0] and x[1] <= r[2] <= x[2])
    for levels in (1, 3, 12):
        got = joins.assign_trips(p, t, levels)
        assert Counter((r.rec_id, r.trip_id) for r in got.collect()) == want
    assert got.columns == ["vessel_id", "rec_id", "time_stamp", "depart", "return", "trip_id"]


def test_interval_join_meets_few_trips(spark):
    n = 1000
    t = frame(spark, [("A", at(600 * i), at(600 * i + 500), f"t{i}") for i in range(n)], "vessel_id string, depart timestamp, return timestamp, trip_id string")
    p = frame(spark, [(i, "A", at(15 * i)) for i in range(40 * n)], "rec_id long, vessel_id string, time_stamp timestamp")
    rows = joins.assign_trips(p, t).count()
    assert rows == sum(15 * i % 600 <= 500 for i in range(40 * n)) and joins._met(p, t, 12).count() < 3 * rows


def test_downsampling_of_one_long_track(spark):
    """About linear: the frames do not look at the rest of the track for each ping."""
    import time

    def took(n):
        df = spark.range(n).select(F.col("id").alias("rec_id"), F.lit("V").alias("vessel_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7).alias("time_stamp"))
        began = time.time()
        joins.downsample_ais_timestep(df, "min", 1).write.format("noop").mode("overwrite").save()
        return time.time() - began

    took(20_000)
    assert took(160_000) < 8 * max(took(20_000), 1.0)


def test_pings_and_models_are_written_and_read(spark, tmp_path):
    df = pings(spark, [("V", 0, 0, 50), ("W", 600_000, 3, 50), ("V", -1, 2, 51)]).withColumns({"speed": F.lit(1.5), "course": F.lit(None).cast("double"), "gear": F.lit("net"), "behaviour": F.lit("Fishing")})
    tables.write_pings(df, f"{tmp_path}/pings")
    back = tables.read_pings(spark, f"{tmp_path}/pings")
    key = lambda d: sorted(map(tuple, d.select(*df.columns).collect()))
    assert key(back) == key(df) and {p.name for p in (tmp_path / "pings").glob("year=*")} == {"year=2023", "year=2024", "year=2025"}
    for name, sep in (("a.csv", ","), ("b.txt", "\t")):
        df.coalesce(1).write.option("header", True).option("sep", sep).csv(f"{tmp_path}/{name}")
        assert key(tables.read_pings(spark, f"{tmp_path}/{name}", sep=sep)) == key(df)
    guessed = tables.read_pings(spark, f"{tmp_path}/a.csv", schema=None)
    assert dict(guessed.dtypes)["lon"] == "double" and dict(guessed.dtypes)["rec_id"] == "int"
    rows = spark.range(60).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("behaviour"), (F.col("id") % 2 + F.rand(1) / 2).alias("u"), F.rand(2).alias("v"))
    model = ml.train_forest(rows, ["u", "v"], trees=5)
    tables.save_model(model, f"{tmp_path}/model")
    again = tables.load_model(f"{tmp_path}/model")
    assert ml.predict(again, rows).select("predicted").collect() == ml.predict(model, rows).select("predicted").collect()


def test_dedupe_and_checks(spark):
    df = pings(spark, [("V", 0, 1, 1), ("V", 0, 2, 1), ("V", 5, 1, 1), ("W", 0, 1, 1)])
    once = clean.dedupe_time(df)
    assert values(once, "rec_id") == [0, 2, 3] and values(clean.dedupe_time(once), "rec_id") == [0, 2, 3]
    assert values(clean.dedupe_position(df), "rec_id") == [0, 1, 3]
    assert quality.duplicate_counts(df, ["vessel_id", "time_stamp"]).first().n == 2
    bins = quality.histogram(spark.range(11).select(F.col("id").cast("double").alias("v")), "v", 5).orderBy("bin").collect()
    assert [(r.bin, r.n) for r in bins] == [(1, 2), (2, 2), (3, 2), (4, 2), (5, 3)]


def test_discriminant_parts_classes(spark):
    rng = random.Random(2)
    rows = [(c, rng.gauss(m, 1.0), rng.gauss(-m, 1.0)) for c, m in (("a", 0.0), ("b", 5.0)) for _ in range(200)]
    df = frame(spark, rows, "behaviour string, u double, v double")
    for classes in (ml.train_lda(df, ["u", "v"]), ml.train_qda(df, ["u", "v"])):
        assert ml.predict_discriminant(classes, df, ["u", "v"]).filter("predicted = behaviour").count() > 390


def test_discriminant_moments_with_nulls(spark):
    """Moments equal Spark's, far from 0, where features are null and in a class of one row; the plan does not hold a term for each pair of features."""
    names = [f"f{i}" for i in range(12)]
    rng = np.random.default_rng(5)
    rows = [("a" if i < 200 else "b" if i < 400 else "c", *(None if (i + j) % 17 == 0 and i < 400 else float(v) for j, v in enumerate(1e7 + rng.normal(size=12)))) for i in range(401)]
    df = frame(spark, rows, "behaviour string, " + ", ".join(f"{n} double" for n in names)).repartition(7)
    classes = ml.train_qda(df, names)
    assert [(c["label"], c["n"]) for c in classes] == [("a", 200), ("b", 200), ("c", 1)]
    for c in classes:
        own = df.filter(F.col("behaviour") == c["label"])
        assert np.allclose(c["mean"], own.agg(*[F.avg(n) for n in names]).first(), rtol=1e-14)
        assert np.allclose(c["cov"], np.reshape([v or 0.0 for v in own.agg(*[F.covar_samp(a, b) for a in names for b in names]).first()], (12, 12)), atol=1e-7)
    said = ml.predict_discriminant(classes[:2], df, names)
    assert {r.predicted for r in said.filter("f0 is null").collect()} == {"b"}
    assert said._jdf.queryExecution().executedPlan().toString().count("f11") < 30


def test_boosted_trees_are_fitted_once(spark, monkeypatch):
    """With one depth there is nothing to choose, so folds would be fitted for nothing."""
    rng = np.random.default_rng(6)
    df = frame(spark, [(i, float(u), float(v), "a" if u + v > 0 else "b") for i, (u, v) in enumerate(rng.normal(size=(200, 2)))], "rec_id long, u double, v double, behaviour string")
    fits, fit = [], ml.GBTClassifier._fit
    monkeypatch.setattr(ml.GBTClassifier, "_fit", lambda self, data: fits.append(1) or fit(self, data))
    model = ml.train_other(df, ["u", "v"], kind="boosted", folds=3)
    assert len(fits) == 1
    assert ml.predict(model, df).filter("predicted = behaviour").count() > 180
