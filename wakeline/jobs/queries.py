"""A query for each operator over the derived tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import behaviour, blocks, clean, covariates, interpolate, joins, ml, quality, sketches, track, trips
from ..sources import tables
from ..sources.scratch import scratch, staged
from . import workflows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PINGS_SQL = """
e AS (SELECT event_id, user_id, event_type, value, props, c_nationkey AS n, c_mktsegment, ((epoch_us(ts) - 1704067200000000) // 100000000) * 10 AS sec
      FROM events JOIN customer ON user_id = c_custkey),
pings AS (SELECT CAST(event_id AS BIGINT) AS rec_id, 'EX_' || user_id AS vessel_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(sec) AS time_stamp,
  round(10 + n % 5 + 0.2e0 * cos(2 * pi() * (sec / 60.0e0) / 720 + user_id), 6) AS lon,
  round(55 + (n // 5) * 0.8e0 + 0.1e0 * sin(2 * pi() * (sec / 60.0e0) / 720 + user_id), 6) AS lat,
  CASE WHEN event_id % 17 <> 0 THEN value / 20.0e0 END AS speed,
  CASE WHEN event_id % 101 = 0 THEN 511.0e0 WHEN event_id % 11 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) * 3.6e0 END AS course,
  c_mktsegment AS gear,
  CASE WHEN event_type <> 'signup' THEN CASE WHEN (value / 20.0e0 BETWEEN 1 AND 5) <> (event_type = 'error') THEN 'Fishing' ELSE 'Steaming' END END AS behaviour,
  epoch_us(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(sec)) AS us FROM e),
harb AS (SELECT 10 + n_nationkey % 5 + 0.2e0 AS x, 55 + (n_nationkey // 5) * 0.8e0 AS y FROM nation),
once AS (SELECT * FROM pings QUALIFY row_number() OVER (PARTITION BY vessel_id, time_stamp ORDER BY rec_id) = 1),
flagged AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM harb WHERE lon BETWEEN x - 0.08e0 AND x + 0.08e0 AND lat BETWEEN y - 0.08e0 AND y + 0.08e0) THEN 1 ELSE 0 END AS "SI_HARB" FROM once)
"""
COLUMNS = "rec_id, vessel_id, time_stamp, lon, lat, speed, course, gear, behaviour"
TRACK = "OVER (PARTITION BY vessel_id ORDER BY time_stamp, rec_id)"


def add(name: str, run: Query, sql: str | None = None, more: str = "") -> None:
    """``sql``: a SELECT over pings, once (deduplicated) and flagged (with SI_HARB); ``more``: further CTEs."""
    QUERIES[name] = run
    if sql:
        SQL[name] = f"WITH RECURSIVE {PINGS_SQL}{', ' + more if more else ''} {sql}"


def on_pings(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None, more: str = "") -> None:
    add(name, lambda spark, d: f(tables.pings(spark, d)), sql, more)


def on_flagged(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None, more: str = "") -> None:
    add(name, lambda spark, d: f(joins.add_harbours(clean.dedupe_time(tables.pings(spark, d)), tables.harbours(spark, d))), sql, more)


def rounded(df: DataFrame, *cols: str, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """``nudge`` parts decimal ties, which engines round by different rules."""
    return df.withColumns({c: F.round(F.col(c) + nudge if nudge else F.col(c), digits) for c in cols})


def arc_km(a: str, b: str, c: str, d: str) -> str:
    inner = f"sin(radians({b})) * sin(radians({d})) + cos(radians({b})) * cos(radians({d})) * cos(radians({a}) - radians({c}))"
    return f"(CASE WHEN {a} + {b} + {c} + {d} IS NOT NULL THEN 6367.0e0 * acos(greatest(-1.0e0, least(1.0e0, {inner}))) END)"


def metres(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin((radians({c}) - radians({a})) / 2), 2))"
    return f"(CASE WHEN {a} + {c} IS NOT NULL THEN 2 * 6371010.0e0 * asin(least(1.0e0, sqrt({h}))) END)"


def course_to(a: str, b: str, c: str, d: str) -> str:
    dl = f"(radians({c}) - radians({a}))"
    deg = f"degrees(atan2(sin({dl}) * cos(radians({d})), cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos({dl})))"
    return f"(({deg} % 360.0e0 + 360.0e0) % 360.0e0)"


def mercator_sql(lon: str, lat: str, lon0: str) -> tuple[str, str]:
    """Metres east of ``lon0`` and north of the equator, at scale 1."""
    radius, e, alpha, _, _ = geo._series()
    s = f"sin(radians({lat}))"
    t = f"sinh(atanh({s}) - {e!r} * atanh({e!r} * {s}))"
    d = f"radians({lon} - {lon0})"
    xi, eta = f"atan2({t}, cos({d}))", f"atanh(sin({d}) / sqrt(1 + {t} * {t}))"
    x = " + ".join([eta, *[f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)]])
    y = " + ".join([xi, *[f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(alpha, 1)]])
    return f"({radius!r} * ({x}))", f"({radius!r} * ({y}))"


def utm_sql(lon: str, lat: str, zone: int) -> tuple[str, str]:
    x, y = mercator_sql(lon, lat, repr(geo._meridian(zone)))
    return f"({geo.UTM_SCALE!r} * {x} + 500000.0e0)", f"({geo.UTM_SCALE!r} * {y})"


# Sources and scalar functions.
on_pings("pings", lambda p: p, f"SELECT {COLUMNS} FROM pings")
on_pings(
    "s2_s3_times",
    lambda p: p.select("rec_id", tables.parse_time(F.when(F.col("rec_id") % 7 == 0, F.lit("no time")).otherwise(F.date_format("time_stamp", "yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz").alias("parsed"), tables.excel_date(45292 + F.col("rec_id") % 400).alias("day")),
    "SELECT rec_id, CASE WHEN rec_id % 7 <> 0 THEN time_stamp END AS parsed, CAST(DATE '1899-12-30' + CAST(45292 + rec_id % 400 AS INTEGER) AS DATE) AS day FROM pings",
)
_x, _y = utm_sql("lon", "lat", 32)


def _scalars(p: DataFrame) -> DataFrame:
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), 32)
    back = [F.round(c, 6) for c in geo.from_utm(F.col("x"), F.col("y"), 32)]
    lon, lat, at = F.col("lon"), F.col("lat"), (F.lit(12.0), F.lit(56.0))
    out = p.withColumns({"x": x, "y": y}).withColumns({"lon_back": back[0], "lat_back": back[1]}).select(
        "rec_id", geo.arcdist(lon, lat, *at).alias("nmi"), geo.arcdist(lon, lat, *at, "km").alias("km"), geo.haversine_m(lon, lat, *at).alias("m"), geo.bearing(lon, lat, *at).alias("bearing"),
        geo.ms2kn(F.col("speed")).alias("kn"), geo.kn2ms(F.col("speed")).alias("ms"), geo.lon_lat_ratio(lat).alias("ratio"), "x", "y", "lon_back", "lat_back",
        geo.zero_pad(F.col("rec_id"), 8).alias("zeros"), geo.trip_key(F.col("vessel_id"), F.col("rec_id") % 3).alias("key"),
    )
    return rounded(rounded(out, "nmi", "km", "m", "bearing", "kn", "ms", "ratio", digits=5), "x", "y", digits=3)


on_pings(
    "x_scalars",
    _scalars,
    f"""SELECT rec_id, round({arc_km("lon", "lat", "12.0e0", "56.0e0")} / 1.8512e0, 5) AS nmi, round({arc_km("lon", "lat", "12.0e0", "56.0e0")}, 5) AS km,
    round({metres("lon", "lat", "12.0e0", "56.0e0")}, 5) AS m, round({course_to("lon", "lat", "12.0e0", "56.0e0")}, 5) AS bearing,
    round(speed * 1.94384449e0, 5) AS kn, round(speed / 1.94384449e0, 5) AS ms,
    round(2 * atan2(sqrt(pow(cos(radians(lat)), 2) * pow(sin(radians(0.1e0) / 2), 2)), sqrt(1 - pow(cos(radians(lat)), 2) * pow(sin(radians(0.1e0) / 2), 2))) * 6371.0e0 / 11.12e0, 5) AS ratio,
    round({_x}, 3) AS x, round({_y}, 3) AS y, lon AS lon_back, lat AS lat_back,
    repeat('0', CAST(greatest(0, 8 - length(CAST(rec_id AS VARCHAR))) AS BIGINT)) AS zeros, vessel_id || '_' || (rec_id % 3) AS key FROM pings""",
)

# Quality checks.
on_pings("q1_value_counts", lambda p: quality.value_counts(p, "behaviour"), "SELECT behaviour, count(*) AS n FROM pings GROUP BY 1")
on_pings("q2_crosstab", lambda p: quality.crosstab(p, "vessel_id", "behaviour"), "SELECT vessel_id, behaviour, count(*) AS n FROM pings GROUP BY 1, 2")
on_pings("q3_extent", quality.extent, "SELECT min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat, min(time_stamp) AS min_time_stamp, max(time_stamp) AS max_time_stamp FROM pings")
on_pings(
    "q4_summary_stats",
    lambda p: rounded(quality.summary_stats(p, "speed"), "min", "q1", "median", "mean", "q3", "max"),
    """SELECT round(min(speed), 6) AS "min", round(quantile_cont(speed, 0.25), 6) AS q1, round(quantile_cont(speed, 0.5), 6) AS median, round(avg(speed), 6) AS mean,
    round(quantile_cont(speed, 0.75), 6) AS q3, round(max(speed), 6) AS "max", count(*) - count(speed) AS n_null FROM pings""",
)
on_pings("q5_distinct_gaps", quality.distinct_gaps, f"SELECT DISTINCT vessel_id, gap_sec FROM (SELECT vessel_id, (us - lag(us) {TRACK}) / 1e6 AS gap_sec FROM pings) WHERE gap_sec IS NOT NULL")
on_pings("q6_duplicate_counts", lambda p: quality.duplicate_counts(p, ["vessel_id", "time_stamp"]), "SELECT vessel_id, time_stamp, count(*) AS n FROM pings GROUP BY 1, 2 HAVING count(*) > 1")
on_pings(
    "q7_histogram",
    lambda p: quality.histogram(p, "speed", 50),
    """SELECT CAST(least(50, floor((speed - lo) * 50 / (hi - lo)) + 1) AS BIGINT) AS bin, count(*) AS n
    FROM pings, (SELECT min(speed) AS lo, max(speed) AS hi FROM pings) WHERE speed IS NOT NULL GROUP BY 1""",
)
on_pings("q8_sample", lambda p: quality.sample_pings(p, 500).select("rec_id", "lon", "lat"), "SELECT rec_id, lon, lat FROM pings ORDER BY md5(rec_id || '|1'), rec_id LIMIT 500")
on_pings("q9_count_distinct", lambda p: quality.count_distinct(p, "vessel_id"), "SELECT count(DISTINCT vessel_id) AS n FROM pings")

# Filters and dedupe.
on_pings("f1_filter_extent", lambda p: clean.filter_extent(p, 55, 57, 10, 13), f"SELECT {COLUMNS} FROM pings WHERE lat > 55 AND lat < 57 AND lon > 10 AND lon < 13")
on_pings("f2_filter_behaviour", clean.filter_behaviour, f"SELECT {COLUMNS} FROM pings WHERE behaviour = 'Fishing'")
on_pings("f3_dedupe_first", clean.dedupe_time, f"SELECT {COLUMNS} FROM once")
on_pings(
    "f4_dedupe_mean",
    lambda p: rounded(clean.dedupe_time(p, "mean"), "lon", "lat", "speed"),
    """SELECT vessel_id, time_stamp, min(rec_id) AS rec_id, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, round(avg(speed), 6) AS speed,
    arg_min_null(course, rec_id) AS course, arg_min_null(gear, rec_id) AS gear, arg_min_null(behaviour, rec_id) AS behaviour FROM pings GROUP BY 1, 2""",
)
on_pings("f5_dedupe_position", clean.dedupe_position, f"SELECT {COLUMNS} FROM pings QUALIFY row_number() OVER (PARTITION BY vessel_id, lon, lat ORDER BY time_stamp, rec_id) = 1")
on_pings(
    "f6_dedupe_exact", lambda p: clean.dedupe_exact(p.unionByName(p)), f"SELECT {COLUMNS} FROM (SELECT DISTINCT {COLUMNS} FROM pings) QUALIFY row_number() OVER (PARTITION BY vessel_id, time_stamp, lon, lat ORDER BY rec_id) = 1"
)
on_pings("f7_filter_speed", clean.filter_speed, f"SELECT {COLUMNS} FROM pings WHERE speed BETWEEN 0.1 AND 12")
on_pings(
    "f8_flag_speed_sd",
    lambda p: clean.flag_speed_sd(p, 2.0).select("rec_id", "speed_outlier"),
    "SELECT rec_id, coalesce(speed > lim, false) AS speed_outlier FROM pings, (SELECT avg(speed) + 2 * stddev_samp(speed) AS lim FROM pings)",
)
on_pings(
    "f9_smooth_speed",
    lambda p: rounded(clean.smooth_speed(p, 5, 1.0, 8.0), "speed").select("rec_id", "speed"),
    """SELECT rec_id, round(coalesce(CASE WHEN speed BETWEEN 1 AND 8 THEN speed END,
    avg(CASE WHEN speed BETWEEN 1 AND 8 THEN speed END) OVER (PARTITION BY vessel_id ORDER BY time_stamp, rec_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), 6) AS speed FROM pings""",
)
on_pings("f10_null_bad_course", lambda p: clean.null_bad_course(p).select("rec_id", "course"), "SELECT rec_id, CASE WHEN course <= 360 THEN course END AS course FROM pings")
on_pings("f11_complete_cases", lambda p: clean.complete_cases(p, ["speed", "course", "behaviour"]), f"SELECT {COLUMNS} FROM pings WHERE speed IS NOT NULL AND course IS NOT NULL AND behaviour IS NOT NULL")
on_pings("f12_rename_select", clean.rename_select, "SELECT vessel_id AS vid, time_stamp AS time, lon, lat, speed, rec_id FROM pings")


def _projected(p: DataFrame) -> DataFrame:
    x, y = geo.to_utm(F.col("lon"), F.col("lat"), 32)
    return trips.trips_by_day(p.withColumns({"x": x, "y": y}))


def slow_sql(source: str, vmax: float) -> str:
    """``slow``: rows of ``source`` (burst, rec_id, us, x, y) left when fast steps go again and again."""
    return f"""thinned AS (SELECT burst, rec_id, us, x, y, 0 AS pass FROM {source} UNION ALL
  SELECT burst, rec_id, us, x, y, pass + 1 FROM (SELECT *, bool_or(fast) OVER (PARTITION BY burst) AS again FROM
    (SELECT *, coalesce(sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) / ((lead(us) OVER w - us) / 1e6) * 1.94384449e0 > {vmax!r}, false) AS fast
     FROM thinned WINDOW w AS (PARTITION BY burst ORDER BY us, rec_id))) WHERE again AND NOT fast),
slow AS (SELECT * FROM thinned QUALIFY pass = max(pass) OVER (PARTITION BY burst))"""


DAYS_SQL = f"p AS (SELECT *, {_x} AS x, {_y} AS y, vessel_id || ' ' || CAST(CAST(time_stamp AS DATE) AS VARCHAR) AS burst FROM once)"
on_pings("f13_remove_fast_steps", lambda p: clean.remove_fast_steps(_projected(clean.dedupe_time(p)), vmax=6.0).select("rec_id", "burst"), "SELECT rec_id, burst FROM slow", f"{DAYS_SQL}, {slow_sql('p', 6.0)}")
on_pings("f14_filter_part", lambda p: clean.filter_part(p, day=2), f"SELECT {COLUMNS} FROM pings WHERE day(time_stamp) = 2")

# Joins.
add(
    "j1_attach_registry",
    lambda s, d: joins.attach_registry(*tables.registry(s, d)).select("rec_id", "trip_id", "device_id", "vessel_id"),
    "SELECT rec_id, CAST(substr(vessel_id, 4) AS BIGINT) * 100 + day(time_stamp) AS trip_id, CAST(substr(vessel_id, 4) AS BIGINT) AS device_id, vessel_id FROM pings",
)
on_flagged("j2_add_harbours", lambda f: f, f'SELECT {COLUMNS}, "SI_HARB" FROM flagged')
add(
    "j3_near_harbour",
    lambda s, d: joins.near_harbour(tables.pings(s, d), tables.harbours(s, d).select(((F.col("ring")[0]["lon"] + F.col("ring")[2]["lon"]) / 2).alias("lon"), ((F.col("ring")[0]["lat"] + F.col("ring")[2]["lat"]) / 2).alias("lat")), 6000.0).select("rec_id"),
    f"SELECT rec_id FROM pings WHERE EXISTS (SELECT 1 FROM harb WHERE {metres('lon', 'lat', 'x', 'y')} <= 6000)",
)
def land_sql(pings: str, buffer: float) -> str:
    """``land``: rec_id of rows of ``pings`` in a coast square or within the buffer of its sides."""
    return f"""planed AS (SELECT rec_id, {_x} AS x, {_y} AS y, lon, lat FROM {pings}),
corner AS (SELECT n_nationkey AS k, i, 10 + n_nationkey % 5 - 0.2e0 + sx * 0.03e0 AS lon, 55 + (n_nationkey // 5) * 0.8e0 + sy * 0.03e0 AS lat
  FROM nation, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) v(i, sx, sy)),
planar AS (SELECT k, i, {_x} AS x, {_y} AS y FROM corner),
side AS (SELECT a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM planar a JOIN planar b ON a.k = b.k AND b.i = a.i + 1),
pair AS (SELECT rec_id, k, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM planed, side),
land AS (SELECT rec_id FROM pair GROUP BY rec_id, k
  HAVING min(sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2))) <= {buffer} OR sum(CASE WHEN ((y1 > y) <> (y2 > y)) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1)"""


add("j4_remove_land", lambda s, d: joins.remove_land(tables.pings(s, d), tables.coast(s, d), workflows.ZONE, 500.0).select("rec_id"), "SELECT rec_id FROM planed EXCEPT SELECT rec_id FROM land", land_sql("pings", 500))
on_flagged("j5_remove_harbour", lambda f: joins.remove_harbour(f).select("rec_id"), 'SELECT rec_id FROM flagged WHERE "SI_HARB" = 0')



def trips_sql(source: str, min_dur: float) -> str:
    """``trip``: rows of ``source`` in whole trips; ``schedule``: the trips."""
    return f"""lagged AS (SELECT *, lag("SI_HARB") OVER w AS prev FROM {source} WINDOW w AS (PARTITION BY vessel_id ORDER BY us, rec_id)),
dep AS (SELECT *, sum(CASE WHEN "SI_HARB" = 0 AND coalesce(prev, 1) = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY vessel_id ORDER BY us, rec_id ROWS UNBOUNDED PRECEDING) AS n,
  coalesce(bool_or("SI_HARB" <> prev) OVER (PARTITION BY vessel_id), false) AS moves FROM lagged),
labelled AS (SELECT *, CASE WHEN moves AND ("SI_HARB" = 0 OR coalesce(prev, 1) = 0) THEN n END AS k FROM dep),
timed AS (SELECT *, (max(us) OVER (PARTITION BY vessel_id, k) - min(us) OVER (PARTITION BY vessel_id, k)) / 3.6e9 AS hours FROM labelled),
trip AS (SELECT *, vessel_id || '_' || k AS trip_id FROM timed WHERE k IS NOT NULL AND hours > {min_dur}),
schedule AS (SELECT vessel_id, trip_id, min(time_stamp) AS depart, max(time_stamp) AS "return", round((max(us) - min(us)) / 1e6 / 3600, 6) AS duration_hrs FROM trip GROUP BY 1, 2)"""


def split_sql(min_dur: float, max_dur: float) -> str:
    """``leaf``: the parts ``name`` of ``trip``, from a to b, cut at their longest gaps; those of under ``min_dur`` left out."""
    return f"""gap AS (SELECT trip_id, us, us - lag(us) OVER (PARTITION BY trip_id ORDER BY us, rec_id) AS g, lag(us) OVER (PARTITION BY trip_id ORDER BY us, rec_id) AS prior FROM trip),
part AS (SELECT vessel_id, trip_id AS root, trip_id AS name, min(us) AS a, max(us) AS b FROM trip GROUP BY 1, 2 UNION ALL
  SELECT vessel_id, root, name || '_' || side, CASE WHEN side = 1 THEN a ELSE cut END, CASE WHEN side = 1 THEN prior ELSE b END FROM
    (SELECT vessel_id, root, name, a, b, first(us ORDER BY g DESC, us) AS cut, first(prior ORDER BY g DESC, us) AS prior, max(g) AS g
     FROM part JOIN gap ON trip_id = root AND us > a AND us <= b WHERE (b - a) / 3.6e9 > {max_dur} GROUP BY ALL), (VALUES (1), (2)) v(side) WHERE g >= 180000000),
leaf AS (SELECT * FROM part p WHERE (b - a) / 3.6e9 > {min_dur} AND NOT EXISTS (SELECT 1 FROM part c WHERE c.name = p.name || '_1'))"""


TRIPS_SQL = trips_sql("flagged", 0.5)


def _whole_trips(f: DataFrame) -> DataFrame:
    return trips.define_trips_pol(f, 0.5, 72.0, split_trips=False)


on_flagged("j6_assign_trips", lambda f: joins.assign_trips(f.select("rec_id", "vessel_id", "time_stamp"), trips.trip_schedule(_whole_trips(f))).select("rec_id", "trip_id"), "SELECT rec_id, trip_id FROM flagged JOIN schedule USING (vessel_id) WHERE time_stamp BETWEEN depart AND \"return\"", TRIPS_SQL)
on_pings("j7_anti_semi", lambda p: joins.anti_keys(p, p.filter("speed > 9"), ["vessel_id"]).select("rec_id").unionByName(joins.semi_keys(p, p.filter("speed > 9.5"), ["vessel_id"]).select("rec_id")),
         "SELECT rec_id FROM pings WHERE vessel_id NOT IN (SELECT vessel_id FROM pings WHERE speed > 9) UNION ALL SELECT rec_id FROM pings WHERE vessel_id IN (SELECT vessel_id FROM pings WHERE speed > 9.5)")
on_pings(
    "j8_downsample", lambda p: joins.downsample_ais_timestep(p, "hour", 1).select("rec_id", "keep"),
    """SELECT rec_id, CASE WHEN rec_id IN (SELECT rec_id FROM best) THEN 1 ELSE 0 END AS keep FROM pings""",
    """ends AS (SELECT vessel_id, 3600000000 * CAST(floor((2 * min(us) + 3600000000) / 7200000000) AS BIGINT) AS a, 3600000000 * CAST(floor((2 * max(us) + 3600000000) / 7200000000) AS BIGINT) AS b FROM pings GROUP BY 1),
    grid AS (SELECT vessel_id, unnest(generate_series(a, b, 3600000000)) AS g FROM ends),
    best AS (SELECT DISTINCT first(rec_id ORDER BY abs(us - g), us, rec_id) OVER (PARTITION BY vessel_id, g ORDER BY abs(us - g), us, rec_id) AS rec_id FROM grid JOIN pings USING (vessel_id))""",
)
SQL["j8_downsample"] = SQL["j8_downsample"].replace("SELECT DISTINCT first(rec_id ORDER BY abs(us - g), us, rec_id) OVER", "SELECT DISTINCT first_value(rec_id) OVER")
add(
    "j9_mixture_density",
    lambda s, d: rounded(joins.mixture_density(tables.pings(s, d).filter("speed is not null").select("rec_id", "speed"), s.createDataFrame([(1, 0.3, 1.0, 0.5), (2, 0.7, 6.0, 2.0)], "mode int, lambda double, mu double, sigma double"), "speed").select("rec_id", "mode", "density"), "density"),
    "SELECT rec_id, mode, round(l * exp(-((speed - mu) / sigma) * ((speed - mu) / sigma) / 2) / (sigma * sqrt(2 * pi())), 6) AS density FROM pings, (VALUES (1, 0.3e0, 1.0e0, 0.5e0), (2, 0.7e0, 6.0e0, 2.0e0)) v(mode, l, mu, sigma) WHERE speed IS NOT NULL",
)

# Window functions. PREV and NEXT: the positions before and after.
PREV = ("lag(lon) OVER w", "lag(lat) OVER w", "lon", "lat")
NEXT = ("lon", "lat", "lead(lon) OVER w", "lead(lat) OVER w")
WINDOW = "FROM once WINDOW w AS (PARTITION BY vessel_id ORDER BY time_stamp, rec_id)"
BEFORE, AFTER = "((us - lag(us) OVER w) / 1e6)", "((lead(us) OVER w - us) / 1e6)"


def on_once(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None, more: str = "") -> None:
    add(name, lambda spark, d: f(clean.dedupe_time(tables.pings(spark, d))), sql, more)


on_once("w1_ping_interval", lambda p: track.ping_interval(p).select("rec_id", "gap_sec"), f"SELECT rec_id, {BEFORE} AS gap_sec {WINDOW}")
on_once(
    "w2_speed2", lambda p: rounded(track.duration_distance_speed2(p).select("rec_id", "duration", "distance", "speed2"), "distance", "speed2", digits=1),
    f"SELECT rec_id, {BEFORE} AS duration, round({arc_km(*PREV)} * 1000, 1) AS distance, round({arc_km(*PREV)} * 1000 / {BEFORE}, 1) AS speed2 {WINDOW}",
)
on_once(
    "w3_rb_event", lambda p: track.rb_event(p, "behaviour").select("rec_id", "event"),
    "SELECT rec_id, CAST(sum(c) OVER (PARTITION BY vessel_id ORDER BY time_stamp, rec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event FROM x",
    f"x AS (SELECT *, coalesce(CAST(behaviour <> lag(behaviour) {TRACK} AS INTEGER), 1) AS c FROM once)",
)
on_flagged(
    "w4_rb_define_trips", lambda f: track.rb_define_trips(f, "SI_HARB").select("rec_id", "trip"),
    'SELECT rec_id, CAST(CASE WHEN "SI_HARB" <> 0 THEN -((r + 1) // 2) ELSE (r + 1) // 2 END AS BIGINT) AS trip FROM y',
    f'x AS (SELECT *, coalesce(CAST("SI_HARB" <> lag("SI_HARB") {TRACK} AS INTEGER), 1) AS c FROM flagged), y AS (SELECT *, CAST(sum(c) OVER (PARTITION BY vessel_id ORDER BY time_stamp, rec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS r FROM x)',
)
on_once("w5_rb_speed", lambda p: rounded(track.rb_speed(p).select("rec_id", "speed_next"), "speed_next", digits=2), f"SELECT rec_id, round({arc_km(*NEXT)} * 1000 / {AFTER} * 1.94384449e0, 2) AS speed_next {WINDOW}")
on_once(
    "w6_step_turn", lambda p: rounded(track.step_turn(p).select("rec_id", "step", "angle"), "step", "angle", digits=5),
    """SELECT rec_id, round(coalesce(s, last_value(s IGNORE NULLS) OVER (PARTITION BY vessel_id ORDER BY time_stamp, rec_id ROWS UNBOUNDED PRECEDING)), 5) AS step,
    round(radians((((o - i) + 180.0e0) % 360.0e0 + 360.0e0) % 360.0e0 - 180.0e0), 5) AS angle FROM x""",
    f"x AS (SELECT *, {metres(*NEXT)} / 1000 AS s, {course_to(*PREV)} AS i, {course_to(*NEXT)} AS o {WINDOW})",
)
on_once("w7_calc_dist", lambda p: rounded(track.calc_dist(p).select("rec_id", "distance_nm"), "distance_nm"), f"SELECT rec_id, round(coalesce({metres(*PREV)} * (0.539957e0 / 1000), 0), 6) AS distance_nm {WINDOW}")
on_once(
    "w8_calc_speed", lambda p: rounded(track.calc_speed(p).select("rec_id", "difftime_secs", "speed_kn"), "speed_kn", digits=4),
    f"SELECT rec_id, coalesce({BEFORE}, 0.0e0) AS difftime_secs, round(coalesce({metres(*PREV)} * (0.539957e0 / 1000) * 3600 / {BEFORE}, 0.0e0), 4) AS speed_kn {WINDOW}",
)
on_pings(
    "w9_calc_acceleration", lambda p: rounded(track.calc_acceleration(p).select("rec_id", "acceleration"), "acceleration"),
    f"SELECT rec_id, round(CASE WHEN lag(us) {TRACK} IS NULL THEN 0.0e0 ELSE speed * (1852.0e0 / 3600) / nullif((us - lag(us) {TRACK}) / 1e6, 0) END, 6) AS acceleration FROM pings",
)
on_once("w10_straightness", lambda p: rounded(track.calc_straightness(p).select("rec_id", "abs_heading_change"), "abs_heading_change"), f"SELECT rec_id, round(CASE WHEN lag(us) OVER w IS NULL THEN 1.0e0 ELSE abs(course - lag(course) OVER w) END, 6) AS abs_heading_change {WINDOW}")
on_once("w11_heading", lambda p: rounded(track.calc_heading(p).select("rec_id", "heading_deg"), "heading_deg", digits=4), f"SELECT rec_id, round(coalesce({course_to(*PREV)}, 0.0e0), 4) AS heading_deg {WINDOW}")
on_once(
    "w12_ltraj_steps", lambda p: rounded(track.ltraj_steps(_projected(p)).select("rec_id", "dist", "dt", "step_speed"), "dist", "step_speed", digits=2),
    """SELECT rec_id, round(d, 2) AS dist, t AS dt, round(d / t * 1.94384449e0, 2) AS step_speed FROM
    (SELECT rec_id, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS d, (lead(us) OVER w - us) / 1e6 AS t FROM p WINDOW w AS (PARTITION BY vessel_id, CAST(time_stamp AS DATE) ORDER BY time_stamp, rec_id))""",
    f"p AS (SELECT *, {_x} AS x, {_y} AS y FROM once)",
)
on_pings("w13_sort_track", lambda p: track.sort_track(p), f"SELECT {COLUMNS} FROM pings ORDER BY vessel_id, time_stamp, rec_id")
on_pings("w14_row_ids", lambda p: track.row_ids(p).select("rec_id", "id", "year"), f"SELECT rec_id, row_number() {TRACK} AS id, CAST(year(time_stamp) AS BIGINT) AS year FROM pings")
on_pings("w15_fill_forward", lambda p: track.fill_forward(p, "speed").select("rec_id", "speed"), "SELECT rec_id, last_value(speed IGNORE NULLS) OVER (PARTITION BY vessel_id ORDER BY time_stamp, rec_id ROWS UNBOUNDED PRECEDING) AS speed FROM pings")

# Trips.
GAP_SQL = f"cuts AS (SELECT *, CASE WHEN (us - lag(us) {TRACK}) >= 10800000000 THEN 1 ELSE 0 END AS c FROM once), gaps AS (SELECT *, vessel_id || '_' || CAST(1 + sum(c) OVER (PARTITION BY vessel_id ORDER BY time_stamp, rec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS vessel_trip FROM cuts)"
on_pings("t1_trips_by_day", lambda p: trips.trips_by_day(p).select("rec_id", "burst"), "SELECT rec_id, vessel_id || ' ' || CAST(CAST(time_stamp AS DATE) AS VARCHAR) AS burst FROM pings")
on_once("t2_trips_by_gap", lambda p: trips.trips_by_gap(p).select("rec_id", "vessel_trip"), "SELECT rec_id, vessel_trip FROM gaps", GAP_SQL)
on_once(
    "t3_segments", lambda p: trips.segments_by_distance(p, 5000.0).select("rec_id", "segment"),
    "SELECT rec_id, CAST(1 + sum(c) OVER (PARTITION BY vessel_id ORDER BY time_stamp, rec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM x",
    f"x AS (SELECT *, CASE WHEN {arc_km(*PREV)} * 1000 > 5000 THEN 1 ELSE 0 END AS c {WINDOW})",
)
on_flagged("t4_define_trips", lambda f: _whole_trips(f).select("rec_id", "trip_id"), "SELECT rec_id, trip_id FROM trip", TRIPS_SQL)
on_flagged(
    "t4_split_trips", lambda f: trips.define_trips_pol(f.select("rec_id", "vessel_id", "time_stamp", "SI_HARB"), 0.5, 4.0, preserve_all=True).select("rec_id", "trip_id"),
    "SELECT rec_id, name AS trip_id FROM flagged LEFT JOIN (SELECT rec_id, name FROM trip JOIN leaf ON trip_id = root AND us BETWEEN a AND b) USING (rec_id)", f"{TRIPS_SQL}, {split_sql(0.5, 4.0)}",
)
CUMULATIVE_SQL = 'cumul AS (SELECT *, CASE WHEN "SI_HARB" = 1 THEN 1 ELSE CAST(sum("SI_HARB") OVER (ORDER BY vessel_id, time_stamp, rec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS t FROM flagged)'
on_flagged("t5_trips_cumulative", lambda f: trips.trips_cumulative(f).select("rec_id", "trip"), "SELECT rec_id, CAST(t AS BIGINT) AS trip FROM cumul", CUMULATIVE_SQL)
on_flagged(
    "t6_compare_trip_counts", lambda f: trips.compare_trip_counts(_whole_trips(f), trips.trips_cumulative(f)),
    'SELECT a AS n_harbour, b AS n_cumulative, b - a AS more FROM (SELECT count(DISTINCT trip_id) AS a FROM trip), (SELECT count(DISTINCT t) AS b FROM cumul WHERE "SI_HARB" = 0)', TRIPS_SQL + ", " + CUMULATIVE_SQL,
)

# Aggregations.
on_flagged("a1_trip_schedule", lambda f: trips.trip_schedule(_whole_trips(f)), "SELECT * FROM schedule", TRIPS_SQL)
on_once(
    "a2_trip_duration_filter", lambda p: trips.trip_duration_filter(trips.trips_by_gap(p)).select("rec_id", "vessel_trip", "duration_min"),
    "SELECT rec_id, vessel_trip, duration_min FROM (SELECT *, round_even((max(us) OVER (PARTITION BY vessel_trip) - min(us) OVER (PARTITION BY vessel_trip)) / 6e7, 0) AS duration_min FROM gaps) WHERE duration_min > 99", GAP_SQL,
)
STEPS_SQL = f"""{DAYS_SQL},
steps AS (SELECT *, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS dist, (lead(us) OVER w - us) / 1e6 AS dt FROM p WINDOW w AS (PARTITION BY burst ORDER BY time_stamp, rec_id)),
totals AS (SELECT burst, sum(dist) AS d, sum(dt / 3600) AS h, count(DISTINCT CAST(time_stamp AS DATE)) AS n_days FROM steps GROUP BY burst)"""
on_once(
    "a3_trip_summary", lambda p: rounded(trips.trip_summary(track.ltraj_steps(_projected(p))), "dist_travelled", "time_travelled", digits=2),
    "SELECT burst, round(d, 2) AS dist_travelled, round(h, 2) AS time_travelled, n_days FROM totals", STEPS_SQL,
)
on_once("a4_drop_short_trips", lambda p: trips.drop_short_trips(track.ltraj_steps(_projected(p)), 10.0).select("rec_id", "burst"), "SELECT rec_id, burst FROM steps WHERE burst NOT IN (SELECT burst FROM totals WHERE coalesce(h, 0) < 10)", STEPS_SQL)
on_once(
    "a5_trip_lines", lambda p: trips.trip_lines(trips.trips_by_gap(p)),
    "SELECT vessel_trip, 'LINESTRING (' || string_agg(format('{:.6f}', lon) || ' ' || format('{:.6f}', lat), ', ' ORDER BY time_stamp, rec_id) || ')' AS wkt, count(*) AS n_points FROM gaps GROUP BY 1", GAP_SQL,
)


def _rings(p: DataFrame) -> DataFrame:
    few = trips.trips_by_gap(p).withColumns({"lon": F.round("lon", 1), "lat": F.round("lat", 1)})
    ring = trips.close_ring(few, "vessel_trip", "rec_id")
    return ring.select("vessel_trip", F.array_join(F.transform("ring", lambda v: F.format_string("%.1f %.1f", v["lon"], v["lat"])), ", ").alias("ring"))


on_once(
    "a6_close_ring", _rings,
    """SELECT vessel_trip, string_agg(v, ', ' ORDER BY rec_id) || ', ' || first(v ORDER BY rec_id) AS ring FROM
    (SELECT vessel_trip, format('{:.1f}', round(lon, 1)) || ' ' || format('{:.1f}', round(lat, 1)) AS v, min(rec_id) AS rec_id FROM gaps GROUP BY 1, 2) GROUP BY 1""", GAP_SQL,
)
on_pings(
    "a7_segment_features",
    lambda p: (lambda f: rounded(f, *[c for c in f.columns if c != "vessel_id"], digits=5, nudge=1e-9))(trips.segment_features(p, "vessel_id", ["speed"])),
    """SELECT vessel_id, round(avg(speed) + 1e-9, 5) AS speed_mean, round(quantile_cont(speed, 0.25) + 1e-9, 5) AS speed_q25, round(quantile_cont(speed, 0.5) + 1e-9, 5) AS speed_q50, round(quantile_cont(speed, 0.75) + 1e-9, 5) AS speed_q75,
    round((sum(d * d * d) / count(d)) / pow(sum(d * d) / count(d), 1.5) + 1e-9, 5) AS speed_skewness, round((sum(d * d * d * d) / count(d)) / pow(sum(d * d) / count(d), 2) - 3 + 1e-9, 5) AS speed_kurtosis
    FROM (SELECT *, speed - avg(speed) OVER (PARTITION BY vessel_id) AS d FROM pings) GROUP BY 1""",
)

# Gap filling.
_ratio = lambda lat: f"(2 * atan2(sqrt(pow(cos(radians({lat})), 2) * pow(sin(radians(0.1e0) / 2), 2)), sqrt(1 - pow(cos(radians({lat})), 2) * pow(sin(radians(0.1e0) / 2), 2))) * 6371.0e0 / 11.12e0)"
_curve = lambda a, b, ta, tb: f"((2*t*t*t - 3*t*t + 1) * {a} + (3*t*t - 2*t*t*t) * {b} + (t*t*t - 2*t*t + t) * {ta} + (t*t*t - t*t) * {tb})"
GAPS_SQL = f"""seg AS (SELECT *, lead(us) OVER w AS us2, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(speed) OVER w AS sp2, lead(course) OVER w AS co2, lead("SI_HARB") OVER w AS h2 FROM flagged WINDOW w AS (PARTITION BY vessel_id ORDER BY time_stamp, rec_id)),
g AS (SELECT *, (us2 - us) / 6e7 AS gap FROM seg),
fills AS (SELECT *, coalesce(gap > 2 AND gap <= 120 AND NOT ("SI_HARB" = 1 AND h2 = 1), false) AS fill, {arc_km("lon", "lat", "lon2", "lat2")} / gap * 60 / 1.852e0 AS whole FROM g),
s AS (SELECT * REPLACE (CASE WHEN fill THEN coalesce(speed, whole) ELSE speed END AS speed, coalesce(sp2, whole) AS sp2) FROM fills),
made AS (SELECT *, unnest(generate_series(1, CAST(ceil(gap) AS BIGINT) - 2)) AS i FROM s WHERE fill AND ceil(gap) > 2),
ti AS (SELECT *, i / (ceil(gap) - 1) AS t, gap / 150.0e0 * speed / 17.5e0 AS v1, gap / 150.0e0 * sp2 / 17.5e0 AS v2 FROM made)"""
on_flagged(
    "g1_interpolate",
    lambda f: rounded(interpolate.interpolate_ais(f).select("rec_id", "vessel_id", "time_stamp", "lon", "lat", "speed", "course", "SI_HARB", "source"), "lon", "lat", "speed", digits=5, nudge=1e-9),
    f"""SELECT rec_id, vessel_id, time_stamp, round(lon + 1e-9, 5) AS lon, round(lat + 1e-9, 5) AS lat, round(speed + 1e-9, 5) AS speed, course, "SI_HARB", 'AIS' AS source FROM s UNION ALL
    SELECT NULL, vessel_id, make_timestamp(us + CAST(round((us2 - us) * t) AS BIGINT)),
    round(CASE WHEN course IS NOT NULL AND co2 IS NOT NULL THEN {_curve("lon", "lon2", "sin(radians(course)) * v1", "sin(radians(co2)) * v2")} ELSE lon + (lon2 - lon) * t END + 1e-9, 5),
    round(CASE WHEN course IS NOT NULL AND co2 IS NOT NULL THEN {_curve("lat", "lat2", f"cos(radians(course)) * v1 * {_ratio('lat')}", f"cos(radians(co2)) * v2 * {_ratio('lat2')}")} ELSE lat + (lat2 - lat) * t END + 1e-9, 5),
    round(speed + (sp2 - speed) * t + 1e-9, 5), NULL, 0, 'INT' FROM ti""",
    GAPS_SQL,
)
on_pings("u1_union_fill", lambda p: interpolate.union_fill(p.select("rec_id", "lon"), p.select("rec_id", "lat")), "SELECT rec_id, lon, NULL::DOUBLE AS lat FROM pings UNION ALL SELECT rec_id, NULL, lat FROM pings")

# Behaviour: thresholds in SQL, fits by rows.
on_pings("b1_classify_speed", lambda p: behaviour.classify_speed(p).select("rec_id", "fishing"), "SELECT rec_id, CASE WHEN speed IS NOT NULL THEN speed BETWEEN 1 AND 5 END AS fishing FROM pings")
on_once("b2_gaussian_speed", lambda p: behaviour.gaussian_speed(p).select("rec_id", "step", "angle", "dura", "step_speed", "lower", "upper"))
on_once("b3_mixture_params", behaviour.mixture_params)
on_once("b4_hmm_step", lambda p: behaviour.hmm_step(p.select("rec_id", "vessel_id", "time_stamp", "lon", "lat")).select("rec_id", "state"))
on_once("b5_hmm_step_turn", lambda p: behaviour.hmm_step_turn(p.select("rec_id", "vessel_id", "time_stamp", "lon", "lat")).select("rec_id", "state"))
on_once("b6_binary_clusters", lambda p: behaviour.binary_clusters(p.select("rec_id", "vessel_id", "time_stamp", "lon", "lat")).select("rec_id", "cluster"))
on_once("b7_model_params_long", lambda p: behaviour.model_params_long(behaviour.mixture_params(p)))
on_once("b7_hmm_params", behaviour.hmm_params)


def near_sql(source: str, k: int) -> str:
    """``near``: rec_id and the distances ``d`` to the k nearest rows of the trip, in metres around the middle of its bounding box; ``placed``: x, y there."""
    x, y = mercator_sql("lon", "lat", "lon0")
    _, y0 = mercator_sql("lon0", "lat0", "lon0")
    return f"""boxed AS (SELECT *, (min(lon) OVER w + max(lon) OVER w) / 2 AS lon0, (min(lat) OVER w + max(lat) OVER w) / 2 AS lat0 FROM {source} WINDOW w AS (PARTITION BY trip_id)),
placed AS (SELECT *, {x} AS x, {y} - {y0} AS y FROM boxed),
near AS (SELECT a.rec_id, list_sort(list(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) FILTER (b.rec_id IS NOT NULL))[1:{k}] AS d FROM placed a LEFT JOIN placed b ON a.trip_id = b.trip_id AND a.rec_id <> b.rec_id GROUP BY 1)"""


NEAR = [f"dist_neighbour_{i}" for i in range(1, 10)]
NEAR_SQL = ", ".join(f"round(d[{i}] + 1e-9, 3) AS {c}" for i, c in enumerate(NEAR, 1))
BY_DAY_SQL = "daily AS (SELECT *, vessel_id || '_' || day(time_stamp) AS trip_id FROM once)"


def _by_day(p: DataFrame) -> DataFrame:
    return p.withColumn("trip_id", F.concat_ws("_", "vessel_id", F.dayofmonth("time_stamp").cast("string")))


_lx, _ly = mercator_sql("lon", "lat", "lon0")
on_once("x7_local_projection", lambda p: rounded(covariates.local_projection(_by_day(p)).select("rec_id", "x", "y"), "x", "y", digits=3, nudge=1e-9), "SELECT rec_id, round(x + 1e-9, 3) AS x, round(y + 1e-9, 3) AS y FROM placed", f"{BY_DAY_SQL}, {near_sql('daily', 9)}")
on_once("b8_knn_distances", lambda p: rounded(covariates.knn_distances(_by_day(p)).select("rec_id", *NEAR), *NEAR, digits=3, nudge=1e-9), f"SELECT rec_id, {NEAR_SQL} FROM near", f"{BY_DAY_SQL}, {near_sql('daily', 9)}")
USABLE_SQL = f"""{BY_DAY_SQL},
usable AS (SELECT * REPLACE (CASE WHEN course <= 360 THEN course END AS course) FROM daily WHERE speed IS NOT NULL AND course <= 360 AND behaviour IS NOT NULL),
felt AS (SELECT *, coalesce({course_to("lag(lon) OVER w", "lag(lat) OVER w", "lon", "lat")}, 0.0e0) AS heading_deg, CASE WHEN lag(us) OVER w IS NULL THEN 1.0e0 ELSE abs(course - lag(course) OVER w) END AS abs_heading_change,
  CASE WHEN lag(us) OVER w IS NULL THEN 0.0e0 ELSE speed * (1852.0e0 / 3600) / nullif((us - lag(us) OVER w) / 1e6, 0) END AS acceleration FROM usable WINDOW w AS (PARTITION BY trip_id ORDER BY time_stamp, rec_id))"""
add(
    "b9_trip_covariates", lambda s, d: rounded(workflows.covariate_table(s, d).select("rec_id", "trip_id", *workflows.FEATURES), *workflows.FEATURES, digits=3, nudge=1e-9),
    f"SELECT rec_id, trip_id, {', '.join(f'round({c} + 1e-9, 3) AS {c}' for c in workflows.FEATURES[:5])}, {NEAR_SQL} FROM felt JOIN near USING (rec_id)", f"{USABLE_SQL}, {near_sql('usable', 9)}",
)

# Models.
FOLD_SQL = """keys AS (SELECT DISTINCT vessel_id FROM pings), ranked AS (SELECT vessel_id, row_number() OVER (ORDER BY md5(vessel_id || '|1'), vessel_id) - 1 AS r, count(*) OVER () AS n FROM keys),
folds AS (SELECT vessel_id, CAST(least(5, r // greatest(1, n // 5) + 1) AS INTEGER) AS fold FROM ranked)"""
on_pings("m5_trip_folds", lambda p: ml.trip_folds(p, 5, "vessel_id").select("rec_id", "fold"), "SELECT rec_id, fold FROM pings JOIN folds USING (vessel_id)", FOLD_SQL)


def _guessed(p: DataFrame) -> DataFrame:
    return p.withColumn("predicted", F.when(F.col("speed").between(1, 5), "Fishing").otherwise("Steaming"))


GUESS_SQL = "guess AS (SELECT *, CASE WHEN speed BETWEEN 1 AND 5 THEN 'Fishing' ELSE 'Steaming' END AS predicted FROM pings)"
on_pings("m7_confusion", lambda p: ml.confusion(_guessed(p), by=["gear"]), "SELECT gear, predicted, behaviour AS actual, count(*) AS n FROM guess GROUP BY 1, 2, 3", GUESS_SQL)
on_pings(
    "m8_overall", lambda p: ml.overall(ml.confusion(_guessed(p))),
    """SELECT round(acc, 6) AS accuracy, round((acc - pe) / (1 - pe), 6) AS kappa, round(most, 6) AS no_information_rate FROM (SELECT
    (SELECT avg(CASE WHEN predicted = behaviour THEN 1.0e0 ELSE 0.0e0 END) FROM k) AS acc,
    (SELECT sum(p * a) FROM (SELECT predicted AS c, count(*) / (SELECT count(*) FROM k)::DOUBLE AS p FROM k GROUP BY 1) JOIN (SELECT behaviour AS c, count(*) / (SELECT count(*) FROM k)::DOUBLE AS a FROM k GROUP BY 1) USING (c)) AS pe,
    (SELECT max(a) FROM (SELECT count(*) / (SELECT count(*) FROM k)::DOUBLE AS a FROM k GROUP BY behaviour)) AS most)""",
    GUESS_SQL + ", k AS (SELECT * FROM guess WHERE behaviour IS NOT NULL)",
)
on_pings(
    "m9_split_train_test", lambda p: ml.split_train_test(p).select("rec_id", "part"),
    f"SELECT rec_id, CASE WHEN CAST('0x' || substr(md5(rec_id || '|1'), 1, 8) AS BIGINT) < {int(0.7 * (1 << 32))} THEN 'train' ELSE 'test' END AS part FROM pings",
)


def discriminant_sql(features: list[str], quadratic: bool) -> str:
    """``best``: the class of the highest discriminant score of each row of ``felt`` with enough neighbours, by Cholesky factors of the covariances."""
    n = range(len(features))
    pairs = [(i, j) for i in n for j in range(i + 1)]
    mean = ", ".join(f"avg(f{i}) AS m{i}" for i in n)
    own = ", ".join(f"covar_samp(f{i}, f{j}) AS c{i}_{j}" for i, j in pairs)
    pooled = ", ".join(f"sum((n - 1) * c{i}_{j}) OVER () / sum(n - 1) OVER () AS c{i}_{j}" for i, j in pairs)
    steps, last = [], "cov"
    for j in n:  # a column of the factor after the other
        square = " - ".join([f"c{j}_{j} + 1e-9", *[f"l{j}_{k} * l{j}_{k}" for k in range(j)]])
        below = "".join(f", (" + " - ".join([f"c{i}_{j}", *[f"l{i}_{k} * l{j}_{k}" for k in range(j)]]) + f") / sqrt({square}) AS l{i}_{j}" for i in n if i > j)
        steps.append(f"chol{j} AS (SELECT *, sqrt({square}) AS l{j}_{j}{below} FROM {last})")
        last = f"chol{j}"
    solved, at = [], "pairs_"
    for i in n:
        rest = " - ".join([f"f{i} - m{i}", *[f"l{i}_{k} * z{k}" for k in range(i)]])
        solved.append(f"solve{i} AS (SELECT *, ({rest}) / l{i}_{i} AS z{i} FROM {at})")
        at = f"solve{i}"
    named = ", ".join(f"{f} AS f{i}" for i, f in enumerate(features))
    score = "ln(n * 1.0e0 / total) - " + " - ".join([f"ln(l{i}_{i})" for i in n]) + " - 0.5e0 * (" + " + ".join(f"z{i} * z{i}" for i in n) + ")"
    return f"""known AS (SELECT rec_id, behaviour, {named} FROM (SELECT felt.*, {", ".join(f"d[{i}] AS {c}" for i, c in enumerate(NEAR, 1))} FROM felt JOIN near USING (rec_id)) WHERE {" AND ".join(f"{f} IS NOT NULL" for f in features)}),
class AS (SELECT behaviour AS label, count(*) AS n, {mean}, {own} FROM known GROUP BY 1),
cov AS (SELECT label, n, sum(n) OVER () AS total, {", ".join(f"m{i}" for i in n)}, {pooled if not quadratic else ", ".join(f"c{i}_{j}" for i, j in pairs)} FROM class),
{", ".join(steps)},
pairs_ AS (SELECT * FROM known, {last}),
{", ".join(solved)},
best AS (SELECT rec_id, behaviour, arg_max(label, {score}) AS predicted FROM {at} GROUP BY 1, 2)"""


#: The registered model queries fit fewer trees and folds than the operators' defaults, which are the method's own: they are to run with all others.
TREES = 20


def _importance(spark: SparkSession, d: str) -> DataFrame:
    f = staged(workflows.features(spark, d))
    return ml.forest_importance(f, workflows.FEATURES, trees=TREES)


def _discriminant(spark: SparkSession, d: str, quadratic: bool) -> DataFrame:
    f = staged(workflows.features(spark, d))
    return ml.predict_discriminant(ml.train_discriminant(f, workflows.FEATURES, quadratic=quadratic), f, workflows.FEATURES).select("rec_id", "behaviour", "predicted")


def _other(spark: SparkSession, d: str) -> DataFrame:
    f = staged(workflows.features(spark, d))
    kinds = ("forest", "boosted", "bagged")
    said = [ml.predict(ml.train_other(f, workflows.FEATURES, kind=k, folds=3, trees=TREES), f).select(F.lit(k).alias("model"), "rec_id", "behaviour", "predicted") for k in kinds]
    return said[0].unionByName(said[1]).unionByName(said[2])


add("m1_m2_forest_importance", _importance)
add("m1_out_of_bag", lambda s, d: workflows.forest_out_of_bag(s, d, TREES))
add("m3_tune_forest", lambda s, d: ml.tune_forest(workflows.features(s, d), workflows.FEATURES, trees=TREES, n=3))
for _name, _q in (("m4_lda", False), ("m4_qda", True)):
    add(_name, lambda s, d, q=_q: _discriminant(s, d, q), "SELECT rec_id, behaviour, predicted FROM best", f"{USABLE_SQL}, {near_sql('usable', 9)}, {discriminant_sql(workflows.FEATURES, _q)}")
add("m6_cross_validate", lambda s, d: workflows.behaviour_folds(s, d, TREES))
add("m10_other_models", _other)

# The same by blocks of time, for vessels too long for one task; the stored layout; sketches that roll up.
_flagged = lambda s, d: joins.add_harbours(clean.dedupe_time(tables.pings(s, d)), tables.harbours(s, d))
for _name, _like, _run in (
    ("w3_event_blocks", "w3_rb_event", lambda s, d: blocks.events(clean.dedupe_time(tables.pings(s, d)), "behaviour").select("rec_id", "event")),
    ("w4_trips_blocks", "w4_rb_define_trips", lambda s, d: blocks.define_trips(_flagged(s, d), "SI_HARB").select("rec_id", "trip")),
    ("t2_gap_blocks", "t2_trips_by_gap", lambda s, d: blocks.trips_by_gap(clean.dedupe_time(tables.pings(s, d))).select("rec_id", "vessel_trip")),
    ("t3_segment_blocks", "t3_segments", lambda s, d: blocks.segments_by_distance(clean.dedupe_time(tables.pings(s, d)), 5000.0).select("rec_id", "segment")),
    ("t5_cumulative_blocks", "t5_trips_cumulative", lambda s, d: blocks.trips_cumulative(_flagged(s, d)).select("rec_id", "trip")),
):
    QUERIES[_name], SQL[_name] = _run, SQL[_like]


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Intervals on pings stored by vessel."""
    path = scratch(spark, "track")
    stored = tables.store_track(clean.dedupe_time(tables.pings(spark, d)), path.rsplit("/", 1)[-1].replace("-", "_"), path, 16)
    return track.ping_interval(stored).select("rec_id", "gap_sec")


QUERIES["s4_stored_track"] = _stored
SQL["s4_stored_track"] = SQL["w1_ping_interval"]


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """Speeds and vessels by gear, out of sketches by vessel and day."""
    p = tables.pings(spark, d).withColumn("day", F.to_date("time_stamp"))
    small = sketches.sketched(p, ["gear", "vessel_id", "day"], ["speed"], ["vessel_id"])
    return sketches.read_off(sketches.rolled_up(small, ["gear"]), ["gear"])


QUERIES["q4_q9_sketches"] = _daily

# Whole workloads.
FILLED_SQL = """filled AS (SELECT vessel_id, us, time_stamp, rec_id, "SI_HARB" FROM s UNION ALL
  SELECT vessel_id, us + CAST(round((us2 - us) * t) AS BIGINT), make_timestamp(us + CAST(round((us2 - us) * t) AS BIGINT)), NULL, 0 FROM ti)"""
add(
    "harbour_trips", workflows.harbour_trips,
    """SELECT vessel_id, name AS trip_id, make_timestamp(a) AS depart, make_timestamp(b) AS "return", round((b - a) / 1e6 / 3600, 6) AS duration_hrs FROM leaf""",
    f"{GAPS_SQL}, {FILLED_SQL}, {trips_sql('filled', 0.8)}, {split_sql(0.8, 8.0)}",
)
add(
    "day_trips", lambda s, d: rounded(workflows.day_trips(s, d), "dist_travelled", "time_travelled", digits=2, nudge=1e-9),
    """SELECT burst, round(sum(dist) + 1e-9, 2) AS dist_travelled, round(sum(dt / 3600) + 1e-9, 2) AS time_travelled, count(DISTINCT CAST(make_timestamp(us) AS DATE)) AS n_days FROM
    (SELECT *, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS dist, (lead(us) OVER w - us) / 1e6 AS dt FROM slow WINDOW w AS (PARTITION BY burst ORDER BY us, rec_id)) GROUP BY 1 HAVING coalesce(sum(dt / 3600), 0) >= 1""",
    f"""inside AS (SELECT * FROM once WHERE lat > 54 AND lat < 60 AND lon > 9 AND lon < 16),
spots AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY vessel_id, lon, lat ORDER BY time_stamp, rec_id) = 1), {land_sql("spots", 10)},
wet AS (SELECT *, {_x} AS x, {_y} AS y, vessel_id || ' ' || CAST(CAST(time_stamp AS DATE) AS VARCHAR) AS burst FROM spots WHERE rec_id NOT IN (SELECT rec_id FROM land)), {slow_sql("wet", 25.0)}""",
)
add("model_comparison", lambda s, d: ml.compare_models(staged(workflows.features(s, d)), workflows.FEATURES, folds=3, trees=TREES))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
