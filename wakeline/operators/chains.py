"""Hidden Markov models of many tracks side by side, whole or in chunks.

Parameters have a row per chain; arrays over tracks a row per step, in it one for each state, and a column per chain
(or chunk of one), so that all arithmetic runs along the chains. A chunk is a
product of transition and emission matrices; given what comes before it (a distribution over states)
and after it (weights of its last states) its part of all sums follows from its own steps. A track in
one piece is a chunk with nothing before or after it, so both ways are one.

The M step of step lengths is the gamma distribution's maximum likelihood, by Newton steps on its shape.
"""

from __future__ import annotations

import math

import numpy as np

STOP, PASSES = 1e-8, 1000
#: Chains of a pass at a time, so that a track's arrays stay in a processor's cache.
BLOCK = 256
#: Shorter steps in metres count as this long: a gamma density may have no bound at 0.
SHORTEST = 1e-3


def settled(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Whether log-likelihoods changed by under ``STOP``, or under what sums of so many terms can tell."""
    with np.errstate(invalid="ignore"):
        return np.abs(new - old) < STOP * np.maximum(1.0, 1e-5 * np.abs(new))


def _raised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``x`` raised to 8 or more, and what that adds to the digamma and the trigamma function."""
    x, first, second = np.array(x, float), np.zeros(np.shape(x)), np.zeros(np.shape(x))
    for _ in range(8):
        small = x < 8
        if not small.any():
            break
        part = np.where(small, 1 / x, 0.0)
        first, second, x = first - part, second + part * part, x + small
    return x, first, second


def _digamma(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    y = 1 / x**2
    return more + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _trigamma(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    y = 1 / x**2
    return more + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))


def digamma(x: np.ndarray) -> np.ndarray:
    x, more, _ = _raised(x)
    return _digamma(x, more)


def trigamma(x: np.ndarray) -> np.ndarray:
    x, _, more = _raised(x)
    return _trigamma(x, more)


def gamma_shape(spread: np.ndarray) -> np.ndarray:
    """The shape whose log less digamma is ``spread``, the log of the mean less the mean of the logs."""
    s = np.maximum(spread, 1e-9)
    a = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(6):
        x, first, second = _raised(a)
        a = np.maximum(a - (np.log(a) - _digamma(x, first) - s) / (1 / a - _trigamma(x, second)), a / 10)
    return a


def _log_gamma_density(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    shape, rate = ((mean / sd) ** 2).T, (mean / sd**2).T
    norm = np.vectorize(math.lgamma, otypes=[float])(shape)
    x = x[:, None]
    return shape * np.log(rate) - norm + (shape - 1) * np.log(x) - rate * x


def _log_wrapped_cauchy(angle: np.ndarray, mean: np.ndarray, kappa: np.ndarray) -> np.ndarray:
    a, kappa = np.nan_to_num(angle)[:, None], kappa.T
    out = np.log((1 - kappa**2) / (2 * math.pi * (1 + kappa**2 - 2 * kappa * np.cos(a - mean.T))))
    return np.where(np.isnan(angle)[:, None], 0.0, out)


class Sums:
    """What an M step needs, a row per chain: states at the start, pairs of states, and by state weights, moments of steps and turns."""

    def __init__(self, first, pair, weight, step, square, log, turns=None):
        self.first, self.pair, self.weight, self.step, self.square, self.log, self.turns = first, pair, weight, step, square, log, turns

    def packed(self) -> np.ndarray:
        v = len(self.first)
        return np.concatenate([a.reshape(v, -1) for a in (self.first, self.pair, self.weight, self.step, self.square, self.log, *(self.turns or ()))], axis=1)

    @classmethod
    def unpacked(cls, rows: np.ndarray, k: int) -> Sums:
        parts = np.split(rows, np.cumsum([k, k * k] + [k] * ((rows.shape[1] - k - k * k) // k))[:-1], axis=1)
        return cls(parts[0], parts[1].reshape(-1, k, k), *parts[2:6], tuple(parts[6:]) or None)


class Chains:
    """Hidden Markov models of several vessels: a row for each in every parameter."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, turn_mean=None, kappa=None):
        v, k = mean.shape
        self.mean, self.sd = mean.copy(), sd.copy()
        self.turn_mean = None if turn_mean is None else np.tile(np.array(turn_mean, float), (v, 1))
        self.kappa = None if kappa is None else np.tile(np.array(kappa, float), (v, 1))
        self.first = np.full((v, k), 1 / k)
        self.move = np.tile(np.full((k, k), 0.1 / (k - 1)) + np.eye(k) * (0.9 - 0.1 / (k - 1)), (v, 1, 1))

    def packed(self) -> np.ndarray:
        v = len(self.mean)
        return np.concatenate([a.reshape(v, -1) for a in (self.first, self.move, self.mean, self.sd, self.turn_mean, self.kappa) if a is not None], axis=1)

    @classmethod
    def unpacked(cls, rows: np.ndarray, k: int) -> Chains:
        parts = np.split(rows, np.cumsum([k, k * k] + [k] * ((rows.shape[1] - k - k * k) // k))[:-1], axis=1)
        out = cls(parts[2], parts[3])
        out.first, out.move = parts[0].copy(), parts[1].reshape(-1, k, k).copy()
        if len(parts) > 4:
            out.turn_mean, out.kappa = parts[4].copy(), parts[5].copy()
        return out

    def log_emission(self, step: np.ndarray, angle: np.ndarray | None, of) -> np.ndarray:
        out = _log_gamma_density(step, self.mean[of], self.sd[of])
        return out if angle is None else out + _log_wrapped_cauchy(angle, self.turn_mean[of], self.kappa[of])

    def emission(self, step: np.ndarray, angle: np.ndarray | None, of) -> tuple[np.ndarray, np.ndarray]:
        """Densities over the largest one of each step, and the log of that."""
        log = self.log_emission(step, angle, of)
        top = log.max(axis=1)
        return np.exp(log - top[:, None]) + 1e-300, top

    def products(self, p: np.ndarray, on: np.ndarray, begins: np.ndarray, of) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk the product of its matrices, scaled to a sum of 1, and the log of the scale. A chunk that ``begins`` a track has no move first."""
        k, v = p.shape[1:]
        move = self.move[of]
        m, log = np.tile(np.eye(k), (v, 1, 1)), np.zeros(v)
        for t in range(len(p)):
            new = (np.where(begins[:, None, None], m, m @ move) if t == 0 else m @ move) * p[t].T[:, None, :]
            new = np.where(on[t][:, None, None], new, m)
            total = new.sum(axis=(1, 2))
            m, log = new / total[:, None, None], log + np.log(total)
        return m, log

    def sums(self, step, angle, p, on, begins: np.ndarray, before: np.ndarray, after: np.ndarray, of) -> tuple[Sums, np.ndarray]:
        """A chunk's part of the sums, with states ``before`` it and weights ``after`` it; and the log of the scale of its forward pass."""
        move, long = np.ascontiguousarray(self.move[of].transpose(1, 2, 0)), len(p)
        moved, forward, backward, scale = np.empty_like(p), np.empty_like(p), np.empty_like(p), np.ones(on.shape)
        whole, product = on.all(axis=1), np.empty_like(move)
        before = last = np.ascontiguousarray(before.T)
        for t in range(long):
            np.multiply(last[:, None], move, out=product)
            np.add.reduce(product, axis=0, out=moved[t])
            f = (np.where(begins, before, moved[t]) if t == 0 else moved[t]) * p[t]
            np.add.reduce(f, axis=0, out=scale[t])
            if whole[t]:
                last = np.divide(f, scale[t], out=forward[t])
            else:
                scale[t][~on[t]] = 1.0
                forward[t] = np.where(on[t], f / scale[t], last)
                last = forward[t]
        ahead = np.empty_like(p)
        weights = (after / after.sum(axis=1, keepdims=True)).T
        for t in range(long - 1, -1, -1):
            backward[t] = weights
            np.multiply(p[t], weights, out=ahead[t])
            np.multiply(move, ahead[t], out=product)
            b = np.add.reduce(product, axis=1)
            b /= np.add.reduce(b, axis=0)
            weights = b if whole[t] else np.where(on[t], b, weights)
        state = np.where(on[:, None], forward * backward, 0.0)
        state /= np.maximum(state.sum(axis=1, keepdims=True), 1e-300)
        # Pairs of a step and the one before it; the first step of a track has none.
        both = (moved * ahead).sum(axis=1)
        paired = on.copy()
        paired[0] &= ~begins
        ahead *= np.where(paired, 1 / np.maximum(both, 1e-300), 0.0)[:, None]
        pair = np.einsum("iv,jv->ijv", before, ahead[0]) + np.einsum("tiv,tjv->ijv", forward[:-1], ahead[1:])
        pair = (pair * move).transpose(2, 0, 1)
        first = np.where(begins[:, None], state[0].T, 0.0)
        length = np.where(on, step, 1.0)
        apart = length[:, None] - self.mean[of].T
        turns = None
        if angle is not None:
            known = np.where(np.isnan(angle)[:, None], 0.0, state)
            a = np.nan_to_num(angle)[:, None]
            turns = (known.sum(axis=0).T, (known * np.cos(a)).sum(axis=0).T, (known * np.sin(a)).sum(axis=0).T)
        weighed = state * apart
        found = Sums(first, pair, state.sum(axis=0).T, weighed.sum(axis=0).T, (weighed * apart).sum(axis=0).T, (state * np.log(length)[:, None]).sum(axis=0).T, turns)
        return found, np.where(on, np.log(scale), 0.0).sum(axis=0)

    def maximise(self, s: Sums, of) -> None:
        """The M step. A state without weight stays as it is."""
        pair = s.pair + 1e-9
        self.move[of], self.first[of] = pair / pair.sum(axis=2, keepdims=True), s.first / s.first.sum(axis=1, keepdims=True)
        some, n = s.weight > 1e-6, np.maximum(s.weight, 1e-6)
        mean = np.maximum(self.mean[of] + s.step / n, 1e-6)
        with np.errstate(divide="ignore"):
            shape = gamma_shape(np.log(mean) - s.log / n)
        sd = np.maximum(mean / np.sqrt(shape), 1e-6 + 1e-3 * mean)
        self.mean[of], self.sd[of] = np.where(some, mean, self.mean[of]), np.where(some, sd, self.sd[of])
        if s.turns is not None:
            turn = (s.turns[1] + 1j * s.turns[2]) / (s.turns[0] + 1e-9)
            self.turn_mean[of], self.kappa[of] = np.angle(turn), np.clip(np.abs(turn), 1e-3, 0.99)

    def passed(self, step: np.ndarray, angle: np.ndarray | None, on: np.ndarray, of: np.ndarray) -> np.ndarray:
        """One forward-backward pass over whole tracks and the M step, for the vessels ``of``; their log-likelihoods."""
        p, top = self.emission(step, angle, of)
        found, log = self.sums(step, angle, p, on, np.ones(len(of), bool), self.first[of], np.ones(self.first[of].shape), of)
        self.maximise(found, of)
        return log + np.where(on, top, 0.0).sum(axis=0)

    def best_products(self, log: np.ndarray, on: np.ndarray, begins: np.ndarray, of) -> np.ndarray:
        """For each chunk the best log-likelihood from a state before it to its last state, over the largest one."""
        k, v = log.shape[1:]
        log_move = np.log(self.move[of] + 1e-300)
        m = np.tile(np.where(np.eye(k) > 0, 0.0, -np.inf), (v, 1, 1))
        for t in range(len(log)):
            moved = (m[:, :, :, None] + log_move[:, None]).max(axis=2)
            new = (np.where(begins[:, None, None], m, moved) if t == 0 else moved) + log[t].T[:, None, :]
            m = np.where(on[t][:, None, None], new - new.max(axis=(1, 2), keepdims=True), m)
        return m

    def paths(self, log: np.ndarray, on: np.ndarray, begins: np.ndarray, before: np.ndarray, last: np.ndarray | None, of) -> np.ndarray:
        """Each chunk's best path to its ``last`` state (none: the best one) given log-likelihoods of states ``before`` it; below its end its last state."""
        k, v = log.shape[1], np.arange(log.shape[2])
        log_move = np.ascontiguousarray(np.log(self.move[of] + 1e-300).transpose(1, 2, 0))
        stay, back = np.arange(k)[:, None], np.empty(log.shape, np.int8)
        before = best = before.T
        for t in range(len(log)):
            from_ = best[:, None] + log_move
            origin, value = from_.argmax(axis=0), from_.max(axis=0)
            if t == 0:
                origin, value = np.where(begins, stay, origin), np.where(begins, before, value)
            back[t] = np.where(on[t], origin, stay)
            best = np.where(on[t], value + log[t], best)
        path = np.empty(on.shape, np.int64)
        path[-1] = best.argmax(axis=0) if last is None else last
        for t in range(len(log) - 1, 0, -1):
            path[t - 1] = back[t, path[t], v]
        return path

    def by_mean(self) -> np.ndarray:
        """Puts states in order of their means; the rank of each former state."""
        order = np.argsort(self.mean, axis=1, kind="stable")
        for name in ("mean", "sd", "first", "turn_mean", "kappa"):
            if (a := getattr(self, name)) is not None:
                setattr(self, name, np.take_along_axis(a, order, 1))
        self.move = np.take_along_axis(np.take_along_axis(self.move, order[:, :, None], 1), order[:, None, :], 2)
        return np.argsort(order, axis=1, kind="stable")


def hidden_markov(step: np.ndarray, angle: np.ndarray | None, on: np.ndarray, mean: np.ndarray, sd: np.ndarray, turn_mean=None, kappa=None, passes: int = PASSES) -> tuple[np.ndarray, Chains]:
    """States 1 to k by mean, for the columns of ``step`` (metres) where ``on``, and the fitted chains in that order.

    Forward-backward passes until the log-likelihood settles; then the best path.
    """
    chains = Chains(mean, sd, turn_mean, kappa)
    step = np.where(on, np.maximum(np.where(on, step, 1.0), SHORTEST), 1.0)
    last, live = np.full(step.shape[1], -np.inf), np.arange(step.shape[1])
    for _ in range(passes):
        if not len(live):
            break
        fit = np.empty(len(live))
        for a in range(0, len(live), BLOCK):
            some = live[a : a + BLOCK]
            fit[a : a + BLOCK] = chains.passed(step[:, some], None if angle is None else angle[:, some], on[:, some], some)
        going = ~settled(fit, last[live])
        last[live] = fit
        live = live[going]
    every = np.arange(step.shape[1])
    path = chains.paths(chains.log_emission(step, angle, every), on, np.ones(len(every), bool), np.log(chains.first + 1e-300), None, every)
    rank = chains.by_mean()
    return rank[every[None, :], path] + 1, chains
