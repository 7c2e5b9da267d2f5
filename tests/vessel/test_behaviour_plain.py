"""The registered behaviour models over the whole smallest tables against plain, slow loops, one vessel at a time."""

import math
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from wakeline.operators import behaviour, clean
from wakeline.sources import tables

SF = "/root/testdata/sf0.001"
MU, SIGMA = (20.0, 150.0, 300.0), (20.0, 20.0, 20.0)


def settled(new, old):
    return abs(new - old) < 1e-8 * max(1.0, 1e-5 * abs(new))


def mixture(counted, mu, sigma):
    """Weights, means and deviations of three normal modes of ``(value, count)`` pairs."""
    k = len(mu)
    w, mu, sigma, last = [1 / k] * k, list(mu), list(sigma), -math.inf
    for _ in range(1000):
        n, s, ss, fit, shares = [0.0] * k, [0.0] * k, [0.0] * k, 0.0, []
        for x, c in counted:
            log = [math.log(w[j]) - ((x - mu[j]) / sigma[j]) ** 2 / 2 - math.log(sigma[j] * math.sqrt(2 * math.pi)) for j in range(k)]
            top = max(log)
            p = [math.exp(v - top) for v in log]
            total = sum(p)
            fit += c * (math.log(total) + top)
            shares.append([v / total * c for v in p])
            for j in range(k):
                n[j] += shares[-1][j]
                s[j] += shares[-1][j] * x
        n = [v + 1e-12 for v in n]
        mu = [s[j] / n[j] for j in range(k)]
        for (x, _), share in zip(counted, shares, strict=True):
            for j in range(k):
                ss[j] += share[j] * (x - mu[j]) ** 2
        w, sigma = [v / sum(n) for v in n], [max(math.sqrt(ss[j] / n[j]), 1e-3) for j in range(k)]
        if abs(fit - last) < 1e-8:
            break
        last = fit
    return w, mu, sigma


def started(steps):
    """Means and deviations that a vessel's hidden Markov model starts at."""
    counted = [(x, 1) for x in steps]
    w, mu, sigma = mixture(counted, MU, SIGMA)
    if min(w) < 1e-3:
        mean = sum(steps) / len(steps)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in steps) / len(steps))
        up, wide = max(1e-3, mean / (sum(MU) / 3)), max(1e-3, deviation / (sum(SIGMA) / 3) / 2)
        _, mu, sigma = mixture(counted, [m * up for m in MU], [s * wide for s in SIGMA])
    order = sorted(range(3), key=lambda j: mu[j])
    mu, sigma = [max(mu[j], 1.0) for j in order], [sigma[j] for j in order]
    return mu, [max(sigma[0], 1.0), max(sigma[1] * 0.75, 1.0), max(sigma[2] + 2, 1.0)]


def shape_of(spread):
    """By halving, with the digamma function as the slope of the log gamma function."""
    spread = max(spread, 1e-9)

    def over(log_a):
        a = math.exp(log_a)
        h = 1e-5 * a
        return math.log(a) - (math.lgamma(a + h) - math.lgamma(a - h)) / (2 * h) > spread

    low, high = -20.0, 16.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if over(middle) else (low, middle)
    return math.exp(low)


def states(steps, angles):
    """States 1 to 3 by mean step."""
    k, n = 3, len(steps)
    mean, sd = started(steps)
    x = [max(s, 1e-3) for s in steps]
    turn, kappa = [math.pi, math.pi / 2, 0.0], [0.1, 0.2, 0.8]
    first, move, last = [1 / k] * k, [[0.9 if i == j else 0.05 for j in range(k)] for i in range(k)], -math.inf

    def densities():
        shape, rate = [(m / s) ** 2 for m, s in zip(mean, sd, strict=True)], [m / s**2 for m, s in zip(mean, sd, strict=True)]
        logs = []
        for t in range(n):
            log = [shape[j] * math.log(rate[j]) - math.lgamma(shape[j]) + (shape[j] - 1) * math.log(x[t]) - rate[j] * x[t] for j in range(k)]
            if angles and angles[t] is not None:
                log = [v + math.log((1 - c * c) / (2 * math.pi * (1 + c * c - 2 * c * math.cos(angles[t] - m)))) for v, m, c in zip(log, turn, kappa, strict=True)]
            logs.append(log)
        return logs

    for _ in range(1000):
        logs = densities()
        p = [[math.exp(v - max(row)) + 1e-300 for v in row] for row in logs]
        forward, scale = [], []
        for t in range(n):
            f = [(first[j] if t == 0 else sum(forward[-1][i] * move[i][j] for i in range(k))) * p[t][j] for j in range(k)]
            scale.append(sum(f))
            forward.append([v / scale[-1] for v in f])
        backward = [[1.0] * k]
        for t in range(n - 1, 0, -1):
            backward.append([sum(move[i][j] * p[t][j] * backward[-1][j] for j in range(k)) / scale[t] for i in range(k)])
        backward.reverse()
        pair, state = [[1e-9] * k for _ in range(k)], []
        for t in range(n):
            s = [forward[t][j] * backward[t][j] for j in range(k)]
            state.append([v / sum(s) for v in s])
            if t:
                both = [[forward[t - 1][i] * move[i][j] * p[t][j] * backward[t][j] for j in range(k)] for i in range(k)]
                total = sum(map(sum, both))
                for i in range(k):
                    for j in range(k):
                        pair[i][j] += both[i][j] / total
        move, first = [[v / sum(row) for v in row] for row in pair], state[0]
        for j in range(k):
            weight = sum(s[j] for s in state)
            if weight > 1e-6:
                m = max(sum(s[j] * v for s, v in zip(state, x, strict=True)) / weight, 1e-6)
                a = shape_of(math.log(m) - sum(s[j] * math.log(v) for s, v in zip(state, x, strict=True)) / weight)
                mean[j], sd[j] = m, max(m / math.sqrt(a), 1e-6 + 1e-3 * m)
            if angles:
                known = [(s[j], a) for s, a in zip(state, angles, strict=True) if a is not None]
                c, d, e = sum(w * math.cos(a) for w, a in known), sum(w * math.sin(a) for w, a in known), sum(w for w, _ in known) + 1e-9
                turn[j], kappa[j] = math.atan2(d / e, c / e), min(max(math.hypot(c / e, d / e), 1e-3), 0.99)
        fit = sum(math.log(s) + max(row) for s, row in zip(scale, logs, strict=True))
        if settled(fit, last):
            break
        last = fit
    logs = densities()
    best, back = [math.log(first[j] + 1e-300) + logs[0][j] for j in range(k)], []
    for t in range(1, n):
        origin = [max(range(k), key=lambda i, j=j: (best[i] + math.log(move[i][j] + 1e-300), -i)) for j in range(k)]
        best = [best[origin[j]] + math.log(move[origin[j]][j] + 1e-300) + logs[t][j] for j in range(k)]
        back.append(origin)
    path = [max(range(k), key=lambda j: (best[j], -j))]
    for origin in reversed(back):
        path.append(origin[path[-1]])
    rank = {j: r + 1 for r, j in enumerate(sorted(range(k), key=lambda j: (mean[j], j)))}
    return [rank[j] for j in reversed(path)]


def clusters(points):
    """1 (low, low) to 4 (high, high) of (speed, turn) points."""
    n = len(points)
    half = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    low = [half([p[d] for p in points]) for d in (0, 1)]
    share = [[0.925 if (p[0] > low[0]) * 2 + (p[1] > low[1]) == j else 0.025 for j in range(4)] for p in points]
    mean = [sum(p[d] for p in points) / n for d in (0, 1)]
    ridge = 1e-6 * (sum(sum((p[d] - mean[d]) ** 2 for p in points) / n for d in (0, 1)) / 2 + 1e-9) + 1e-12
    last = -math.inf
    for _ in range(1000):
        models = []
        for j in range(4):
            w = sum(s[j] for s in share) + 1e-12
            m = [sum(s[j] * p[d] for s, p in zip(share, points, strict=True)) / w for d in (0, 1)]
            a, c, b = (sum(s[j] * (p[d] - m[d]) * (p[e] - m[e]) for s, p in zip(share, points, strict=True)) / w for d, e in ((0, 0), (1, 1), (0, 1)))
            models.append((w, m, a + ridge, b, c + ridge))
        total, fit, share = sum(m[0] for m in models), 0.0, []
        for p in points:
            log = []
            for w, m, a, b, c in models:
                u, v, det = p[0] - m[0], p[1] - m[1], max(a * c - b * b, 1e-300)
                log.append(math.log(w / total) - 0.5 * (c * u * u - 2 * b * u * v + a * v * v) / det - 0.5 * math.log(det))
            e = [math.exp(v - max(log)) for v in log]
            share.append([v / sum(e) for v in e])
            fit += math.log(sum(e)) + max(log)
        if abs(fit - last) < 1e-8:
            break
        last = fit
    return [max(range(4), key=lambda j: (s[j], -j)) + 1 for s in share]


@pytest.fixture(scope="module")
def vessels(spark):
    rows = behaviour._steps(clean.dedupe_time(tables.pings(spark, SF))).select("vessel_id", "rec_id", "time_stamp", "step", "angle", "step_speed").collect()
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.vessel_id, r.time_stamp, r.rec_id)):
        out[r.vessel_id].append(r)
    assert len(out) == 15
    return out


def test_speed_thresholds(spark, vessels):
    got = {r.rec_id: (r.lower, r.upper) for r in entry.queries()["b2_gaussian_speed"](spark, SF).collect()}
    params = {(r.vessel_id, r.mode): r for r in entry.queries()["b3_mixture_params"](spark, SF).collect()}
    for v, rows in vessels.items():
        counted = defaultdict(int)
        for r in rows:
            if r.step_speed is not None:
                counted[math.floor(r.step_speed / 0.001 + 0.5)] += 1
        w, mu, sigma = mixture([(x * 0.001, n) for x, n in sorted(counted.items())], (1, 4, 8), (1, 1, 1))
        for mode, j in enumerate(sorted(range(3), key=lambda j: mu[j]), 1):
            p = params[v, mode]
            assert (p["lambda"], p.mu, p.sigma) == pytest.approx((w[j], mu[j], sigma[j]), rel=1e-5, abs=1e-6)
        low = min(range(3), key=lambda j: mu[j])
        assert all(got[r.rec_id] == pytest.approx((mu[low] - 1.96 * sigma[low], mu[low] + 1.96 * sigma[low]), rel=1e-5, abs=1e-6) for r in rows)


@pytest.mark.parametrize("name", ["b4_hmm_step", "b5_hmm_step_turn"])
def test_states(spark, vessels, name):
    got = {r.rec_id: r.state for r in entry.queries()[name](spark, SF).collect()}
    for rows in vessels.values():
        known = [r for r in rows if r.step is not None]
        want = states([r.step * 1000 for r in known], [r.angle for r in known] if "turn" in name else None)
        assert [got[r.rec_id] for r in known] == want


def test_clusters(spark, vessels):
    got = {r.rec_id: r.cluster for r in entry.queries()["b6_binary_clusters"](spark, SF).collect()}
    for rows in vessels.values():
        known = [r for r in rows if r.step_speed is not None and r.angle is not None]
        want = clusters([(r.step_speed, abs(r.angle)) for r in known])
        assert [got[r.rec_id] for r in known] == want
        assert all(got[r.rec_id] is None for r in rows if r not in known)
