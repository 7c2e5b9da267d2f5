"""Registered queries run; those with SQL agree with it."""

import duckdb
import pytest

import __spark_entry__ as entry
from wakeline.jobs import queries, workflows
from wakeline.operators import ml
from wakeline.sources.scratch import staged

SF = "/root/testdata/sf0.001"
QUICK = ["pings", "x_scalars", "q7_histogram", "f3_dedupe_first", "j2_add_harbours", "j4_remove_land", "j8_downsample", "w4_rb_define_trips", "w6_step_turn", "t4_define_trips", "t5_trips_cumulative", "a1_trip_schedule", "g1_interpolate", "m5_trip_folds", "m8_overall", "t4_split_trips", "f13_remove_fast_steps", "x7_local_projection", "b8_knn_distances", "b9_trip_covariates", "m4_lda", "m4_qda", "m9_split_train_test", "harbour_trips", "day_trips"]


def text(v):
    return "null" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(text(v) for v in r) for r in df.select(*columns).collect())
    assert got == sorted(tuple(text(v) for v in r) for r in cursor.fetchall())


#: Vessel and nation: of two vessels one ping each lies in line with an upright side of a harbour just off its end; a third has a short gap whose start lacks a speed.
VESSELS = {30566: 5, 390361: 22, 210644: 19}
OFF_END = {30566: 190840, 390361: 171490}
ON_SIDES = ["g1_interpolate", "harbour_trips", "j2_add_harbours", "j5_remove_harbour", "j6_assign_trips", "t4_define_trips", "t4_split_trips", "t5_cumulative_blocks", "t5_trips_cumulative", "w4_rb_define_trips"]


@pytest.fixture(scope="module")
def few_vessels(tmp_path_factory):
    """Tables with a ping each half an hour and those named above; the times of events are ten times those of pings."""
    folder = tmp_path_factory.mktemp("few")
    sea = [(v, s) for v, s in OFF_END.items()] + [(v, s) for v in OFF_END for s in range(0, 259200, 1800)]
    rows = [(17 * i + 1, v, s, 20.0, 50) for i, (v, s) in enumerate(sea)] + [(1403299, 210644, 8530, 27.09, 50), (1403412, 210644, 8870, 1.62, 72)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (event_id BIGINT, user_id BIGINT, s BIGINT, value DOUBLE, k BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY (SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(10 * s) AS ts, user_id, 'view' AS event_type, value, '{{\"k\": ' || k || '}}' AS props FROM t) TO '{folder}/events.parquet'")
    con.execute("CREATE TABLE c (c_custkey BIGINT, c_nationkey INTEGER)")
    con.executemany("INSERT INTO c VALUES (?, ?)", list(VESSELS.items()))
    con.execute(f"COPY (SELECT *, 'BUILDING' AS c_mktsegment FROM c) TO '{folder}/customer.parquet'")
    con.execute(f"COPY (SELECT * FROM '{SF}/nation.parquet') TO '{folder}/nation.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ON_SIDES)
def test_query_agrees_with_sql_on_sides_and_short_ways(spark, few_vessels, name):
    con = duckdb.connect()
    for t in ("events", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{few_vessels}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    got = sorted(tuple(text(v) for v in r) for r in queries.queries()[name](spark, few_vessels).select(*columns).collect())
    assert got == sorted(tuple(text(v) for v in r) for r in cursor.fetchall())


def test_trip_covariates_keep_every_usable_ping(spark):
    p = queries.QUERIES["f3_dedupe_first"](spark, SF).select("rec_id")
    usable = queries.QUERIES["pings"](spark, SF).join(p, "rec_id").filter("speed IS NOT NULL AND course <= 360 AND behaviour IS NOT NULL")
    got = queries.QUERIES["b9_trip_covariates"](spark, SF).collect()
    assert sorted(r.rec_id for r in got) == sorted(r.rec_id for r in usable.collect())
    trips = {}
    for r in got:
        trips[r.trip_id] = trips.get(r.trip_id, 0) + 1
    for r in got:
        assert [r[f"dist_neighbour_{i}"] is not None for i in range(1, 10)] == [i < trips[r.trip_id] for i in range(1, 10)]


def test_a_track_is_scanned_and_exchanged_once(spark):
    """Filling gaps unions nothing; splitting trips reads the pings once and stages nothing."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    filled = queries.QUERIES["g1_interpolate"](spark, SF)
    assert plan(filled).count("Relation [event_id") == 1
    assert filled._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(vessel_id") <= 2
    cut = queries.QUERIES["harbour_trips"](spark, SF)
    assert plan(cut).count("Relation [event_id") == 1 and plan(cut).count("MapInArrow") == 1
    assert cut._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(vessel_id") <= 2


def test_models_are_compared_and_tuned(spark):
    f = staged(workflows.features(spark, SF))
    got = {r.model: r for r in ml.compare_models(f, workflows.FEATURES, folds=2, trees=5).collect()}
    assert set(got) == {"forest", "boosted", "bagged"} and all(0.5 < r.accuracy <= 1 and -0.2 < r.kappa <= 1 and 0.5 <= r.no_information_rate < 1 for r in got.values())
    tuned = ml.tune_forest(f, workflows.FEATURES, trees=2, n=2).collect()
    n = f.count()
    assert len(tuned) == (n // 3) * len(workflows.FEATURES) and 4 <= sum(r.error is not None for r in tuned) <= 12
    best = min(r.error for r in tuned if r.error is not None)
    assert tuned[0].predicted_error <= tuned[-1].predicted_error and tuned[0].predicted_error < best + 0.2


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
