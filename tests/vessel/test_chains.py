"""Hidden Markov models in chunks and whole; the M step; long vessels."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import behaviour, long_tracks
from wakeline.operators.chains import Chains, Sums, digamma, gamma_shape, hidden_markov, trigamma


def walked(n, seed):
    rng = np.random.default_rng(seed)
    truth = np.zeros(n, int)
    for i in range(1, n):
        truth[i] = truth[i - 1] if rng.random() < 0.95 else rng.integers(0, 3)
    step = rng.gamma(9, np.array([20.0, 150, 300])[truth] / 9)
    turn = np.where(truth == 2, rng.normal(0, 0.2, n), rng.uniform(-math.pi, math.pi, n))
    turn[rng.random(n) < 0.05] = np.nan
    return truth, step, turn


def test_digamma_and_shape():
    assert digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12) and trigamma(np.array([1.0, 0.5])) == pytest.approx([math.pi**2 / 6, math.pi**2 / 2], abs=1e-11)
    shape = np.array([1e-2, 0.3, 1.0, 7.5, 400.0, 1e5])
    assert gamma_shape(np.log(shape) - digamma(shape)) == pytest.approx(shape, rel=1e-5)


@pytest.mark.parametrize("turns", [False, True])
def test_chunks_add_up_to_whole_tracks(turns):
    _, step, turn = walked(300, 1)
    angle = turn[:, None] if turns else None
    whole = Chains(np.array([[20.0, 150, 300]]), np.array([[10.0, 40, 90]]), *((behaviour.TURN_MEAN, behaviour.KAPPA) if turns else (None, None)))
    one, on = np.zeros(1, int), np.ones((300, 1), bool)
    p, top = whole.emission(step[:, None], angle, one)
    want, log = whole.sums(step[:, None], angle, p, on, np.array([True]), whole.first, np.ones((1, 3)), one)
    logs = whole.log_emission(step[:, None], angle, one)
    best = whole.paths(logs, on, np.array([True]), np.log(whole.first), None, one)[:, 0]
    # The same in chunks of 1 to 120 steps, side by side.
    cut = np.array([0, 1, 40, 160, 161, 300])
    n = np.diff(cut)
    of = np.zeros(len(n), int)
    held = np.arange(n.max())[:, None] < n[None, :]
    parts = [np.ones(held.shape), None]
    parts[0].T[held.T] = step
    if turns:
        parts[1] = np.full(held.shape, np.nan)
        parts[1].T[held.T] = turn
    begins = np.arange(len(n)) == 0
    q, _ = whole.emission(parts[0], parts[1], of)
    m, scale = whole.products(q, held, begins, of)
    before, after, now, total = np.empty((len(n), 3)), np.ones((len(n), 3)), whole.first[0], scale.sum()
    for i in range(len(n)):
        before[i], now = now, now @ m[i]
        total, now = total + np.log(now.sum()), now / now.sum()
    for i in range(len(n) - 1, 0, -1):
        after[i - 1] = m[i] @ after[i]
    got, _ = whole.sums(parts[0], parts[1], q, held, begins, before, after, of)
    assert total == pytest.approx(log[0], rel=1e-12)
    assert got.packed().sum(axis=0) == pytest.approx(want.packed()[0], rel=1e-9, abs=1e-9)
    assert np.allclose(Sums.unpacked(want.packed(), 3).pair, want.pair) and np.array_equal(Chains.unpacked(whole.packed(), 3).packed(), whole.packed())
    best_m = whole.best_products(whole.log_emission(parts[0], parts[1], of), held, begins, of)
    before, now, last = np.empty((len(n), 3)), np.log(whole.first[0]), np.zeros(len(n), int)
    for i in range(len(n)):
        before[i], now = now, (now[:, None] + best_m[i]).max(axis=0)
    last[-1] = now.argmax()
    for i in range(len(n) - 1, 0, -1):
        last[i - 1] = (before[i] + best_m[i][:, last[i]]).argmax()
    path = whole.paths(whole.log_emission(parts[0], parts[1], of), held, begins, before, last, of)
    assert np.array_equal(path.T[held.T], best)


def plain_forward(step, chains):
    """Log-likelihood of one track by its definition."""
    shape, rate = (chains.mean[0] / chains.sd[0]) ** 2, chains.mean[0] / chains.sd[0] ** 2
    density = np.array([[math.exp(a * math.log(r) - math.lgamma(a) + (a - 1) * math.log(x) - r * x) for a, r in zip(shape, rate, strict=True)] for x in step])
    f, log = chains.first[0] * density[0], 0.0
    for row in density[1:]:
        log, f = log + math.log(f.sum()), (f / f.sum()) @ chains.move[0] * row
    return log + math.log(f.sum())


def test_passes_raise_the_likelihood_above_moments():
    _, step, _ = walked(400, 2)
    chains, one, on = Chains(np.array([[30.0, 120, 350]]), np.array([[25.0, 60, 60]])), np.zeros(1, int), np.ones((400, 1), bool)
    fits = [chains.passed(step[:, None], None, on, one)[0] for _ in range(60)]
    assert all(b >= a - 1e-7 for a, b in zip(fits, fits[1:], strict=False))
    before = Chains.unpacked(chains.packed(), 3)
    assert chains.passed(step[:, None], None, on, one)[0] == pytest.approx(plain_forward(step, before), rel=1e-10)
    # From there one step by moments is no better.
    p, _ = before.emission(step[:, None], None, one)
    s, _ = before.sums(step[:, None], None, p, on, np.array([True]), before.first, np.ones((1, 3)), one)
    moments = Chains.unpacked(chains.packed(), 3)
    moments.mean = before.mean + s.step / s.weight
    moments.sd = np.sqrt(s.square / s.weight - (s.step / s.weight) ** 2)
    assert plain_forward(step, moments) <= plain_forward(step, chains) + 1e-6


def tracks(spark, sizes):
    """A vessel for each size, moving east by the steps of a walk; one ping without a place and one without a vessel."""
    rows = []
    for v, n in enumerate(sizes):
        _, step, _ = walked(n, 10 + v)
        lon = np.concatenate([[0.0], np.cumsum(step)]) / 111_194.9
        gaps = np.random.default_rng(v).choice([30, 60, 60, 900], n + 1)
        rows += [(len(rows) + i, f"V{v}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(t)), float(x), 0.0) for i, (x, t) in enumerate(zip(lon, np.cumsum(gaps), strict=True))]
    rows += [(len(rows), "V0", dt.datetime(2024, 1, 1), None, None), (len(rows) + 1, None, dt.datetime(2024, 1, 1), 0.0, 0.0)]
    return spark.createDataFrame(rows, "rec_id long, vessel_id string, time_stamp timestamp, lon double, lat double").repartition(3), rows


@pytest.mark.parametrize("turns", [None, (behaviour.TURN_MEAN, behaviour.KAPPA)])
def test_chunks_are_fitted_as_whole_tracks(spark, turns):
    df, _ = tracks(spark, (700, 40, 5))
    chunks = long_tracks.chunked(behaviour._steps(df), 60).persist()
    start = Chains(np.array([[25.0, 140, 290]]), np.array([[10.0, 50, 80]]), *(turns or (None, None)))
    begin = spark.createDataFrame([(v, start.packed()[0].tolist()) for v in ("V0", "V1", "V2")], "vessel_id string, theta array<double>")
    theta = long_tracks.fitted(chunks, begin, 3, bool(turns), passes=6)
    got = {r.vessel_id: np.array([r.theta]) for r in theta.collect()}
    held = {v: sorted((r for r in chunks.collect() if r.vessel_id == v), key=lambda r: r.chunk) for v in got}
    states = {(r.vessel_id, r.chunk): r.states for r in long_tracks.best_paths(chunks, theta, 3, bool(turns)).collect()}
    assert len(held["V0"]) > 8 and len(got) == 3
    for v, theta in got.items():
        step, angle = (np.array([x for r in held[v] for x in r[c]], float)[:, None] for c in ("step", "angle"))
        want, whole = hidden_markov(step, angle if turns else None, np.ones(step.shape, bool), start.mean, start.sd, *(turns or (None, None)), passes=6)
        parts = Chains.unpacked(theta, 3)
        parts.by_mean()
        assert parts.packed() == pytest.approx(whole.packed(), rel=1e-9, abs=1e-9)
        assert [s for r in held[v] for s in states[v, r.chunk]] == want[:, 0].tolist()


def test_long_vessels_get_the_states_of_short_ones(spark):
    df, rows = tracks(spark, (700, 40, 5))
    mu, sigma = (20.0, 150.0, 300.0), (20.0, 20.0, 20.0)
    a, b = behaviour._hmm(df, mu, sigma, None, 10**9, 30), behaviour._hmm(df, mu, sigma, None, 100, 30)
    assert a.columns == b.columns
    a, b = ({r.rec_id: r for r in d.collect()} for d in (a, b))
    assert len(a) == len(b) == len(rows) and all(a[i].lon == b[i].lon and (a[i].state is None) == (b[i].state is None) for i in a)
    assert np.mean([a[i].state == b[i].state for i in a]) > 0.99  # they start at steps counted by 0.1 m
    assert b[len(rows) - 1].state is None and b[len(rows) - 2].state is None and sum(r.state is not None for r in b.values()) > 740
    params = [{(r.vessel_id, r.par): r.value for r in behaviour.hmm_params(df, turns=None, most=m, passes=30).collect()} for m in (10**9, 100)]
    assert params[0].keys() == params[1].keys() and all(params[1][k] == pytest.approx(x, rel=0.05, abs=0.02) for k, x in params[0].items())


def test_settled_fits_find_the_states(spark):
    df, _ = tracks(spark, (400,))
    truth, _, _ = walked(400, 10)
    got = {r.rec_id: r.state for r in behaviour._hmm(df, (20.0, 150.0, 300.0), (20.0, 20.0, 20.0), None, 100, 40).collect()}
    assert np.mean([got[i] == truth[i] + 1 for i in range(400)]) > 0.95


def test_a_long_vessel_is_spread_over_tasks(spark):
    df, _ = tracks(spark, (900,))
    chunks = long_tracks.chunked(behaviour._steps(df), 50)
    assert chunks.count() > 15 and chunks.agg(F.max(F.size("step"))).first()[0] < 200
    assert {r.part for r in chunks.select(F.spark_partition_id().alias("part")).distinct().collect()} != {0} or chunks.rdd.getNumPartitions() == 1
    assert chunks.select(F.explode("step")).count() == 901


def test_whole_tracks_of_one_state():
    step = np.full((30, 1), 50.0)
    states, chains = hidden_markov(step, None, np.ones((30, 1), bool), np.array([[20.0, 150, 300]]), np.array([[20.0, 20, 20]]))
    assert np.isfinite(chains.packed()).all() and len(set(states[:, 0])) == 1


@pytest.mark.parametrize("turns", [None, (behaviour.TURN_MEAN, behaviour.KAPPA)])
def test_chains_side_by_side_equal_each_by_itself(monkeypatch, turns):
    """Tracks of several lengths in blocks of two chains; arrays run along the chains, not along the states."""
    sizes = [40, 70, 55, 64, 41]
    on = np.arange(max(sizes))[:, None] < np.array(sizes)[None, :]
    step, angle = np.full(on.shape, np.nan), np.full(on.shape, np.nan)
    for v, n in enumerate(sizes):
        _, step[:n, v], angle[:n, v] = walked(n, 50 + v)
    mean, sd = np.tile([25.0, 140, 290], (5, 1)), np.tile([10.0, 50, 80], (5, 1))
    monkeypatch.setattr("wakeline.operators.chains.BLOCK", 2)
    states, chains = hidden_markov(step, angle if turns else None, on, mean, sd, *(turns or (None, None)))
    p, top = chains.emission(np.where(on, step, 1.0), angle if turns else None, np.arange(5))
    assert p.shape == (70, 3, 5) and top.shape == (70, 5)
    for v, n in enumerate(sizes):
        alone, one = hidden_markov(step[:n, v : v + 1], angle[:n, v : v + 1] if turns else None, on[:n, v : v + 1], mean[:1], sd[:1], *(turns or (None, None)))
        assert np.array_equal(alone[:, 0], states[:n, v])
        assert chains.packed()[v] == pytest.approx(one.packed()[0], rel=1e-6, abs=1e-6)
