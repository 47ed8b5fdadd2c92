"""Likelihood kernels over packed blocks: value, gradient, Hessian and information in one pass.

A block holds whole groups (observations, or mixing units for the mixed model), rows of a
group together.  Kernels know nothing of Spark; the same code fits on the driver, inside a
bootstrap task and over a cluster's partitions, where the results simply add up.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from choicelake.functions import transforms as T
from choicelake.operators.spec import Layout

TINY = 1e-300


@dataclass
class Block:
    """x: rows x terms; obs: group starts' running number per row; alt: position among all alternatives.

    times: how many observations each of those held stands for, if it is not one.
    """

    x: np.ndarray
    obs: np.ndarray
    alt: np.ndarray
    y: np.ndarray
    w: np.ndarray
    mix: np.ndarray | None = None
    draws: np.ndarray | None = None  # units x draws x mixing variables
    times: np.ndarray | None = None
    reps: np.ndarray | None = None  # samples x observations: how often each is drawn

    @property
    def n_obs(self) -> int:
        return int(self.obs[-1]) + 1 if len(self.obs) else 0

    @property
    def starts(self) -> np.ndarray:
        """Where each observation's rows begin."""
        return np.flatnonzero(np.append(True, self.obs[1:] != self.obs[:-1])[: len(self.obs)])

    @property
    def weights(self) -> np.ndarray:
        """Of the rows, for all the observations that they stand for."""
        return self.w if self.times is None else self.w * self.times[self.obs]

    @property
    def top(self) -> np.ndarray:
        """The weight of each observation: its rows' largest."""
        top = np.zeros(self.n_obs)
        np.maximum.at(top, self.obs, self.weights)
        return top

    def chi_square(self, p: np.ndarray) -> float:
        cells = (self.y - p) ** 2 / p
        return float(cells.sum() if self.times is None else cells @ self.times[self.obs])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums per observation, of a vector or of each column."""
        return grouped(self.obs, values, self.n_obs)


def grouped(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    if values.ndim == 1:
        return np.bincount(key, values, minlength=n)
    return np.stack([np.bincount(key, column, minlength=n) for column in values.T], axis=1) if values.shape[1] else np.zeros((n, 0))


@dataclass
class Totals:
    """What blocks contribute; adds up over blocks."""

    value: float
    gradient: np.ndarray | None = None
    hessian: np.ndarray | None = None
    information: np.ndarray | None = None
    chi_square: float = 0.0

    def __add__(self, other: Totals) -> Totals:
        add = lambda a, b: None if a is None or b is None else a + b
        return Totals(
            self.value + other.value, add(self.gradient, other.gradient), add(self.hessian, other.hessian),
            add(self.information, other.information), self.chi_square + other.chi_square,
        )


def softmax(block: Block, h: np.ndarray) -> np.ndarray:
    e = np.exp(np.clip(np.nan_to_num(h, nan=0.0), -T.CLIP, T.CLIP))
    p = e / block.sums(e)[block.obs]
    return np.where(p == 0, TINY, p)


@dataclass
class Family:
    """A model's mathematics: subclasses fill in transform and derivatives."""

    layout: Layout
    n_alternatives: int
    intercept_ref: int | None = None
    shape_ref: int | None = None

    def intercept_columns(self, alt: np.ndarray) -> np.ndarray:
        """One-hot of the alternatives without the reference."""
        return np.delete(np.eye(self.n_alternatives), self.intercept_ref, axis=1)[alt]

    def h(self, v: np.ndarray, alt: np.ndarray, shapes) -> np.ndarray:
        return v

    def dv(self, v: np.ndarray, alt: np.ndarray, shapes) -> np.ndarray:
        return np.ones_like(v)

    def dshape(self, v: np.ndarray, alt: np.ndarray, shapes) -> np.ndarray | None:
        return None

    def _parts(self, theta: np.ndarray, block: Block):
        _, shapes, intercepts, beta = self.layout.split(np.asarray(theta, float))
        v = block.x @ beta
        h = self.h(v, block.alt, shapes)
        if intercepts is not None:
            h = h + self.intercept_columns(block.alt) @ intercepts
        return v, h, shapes

    def probabilities(self, theta: np.ndarray, block: Block) -> np.ndarray:
        return softmax(block, self._parts(theta, block)[1])

    def evaluate(self, theta: np.ndarray, block: Block, second: bool = False) -> Totals:
        v, h, shapes = self._parts(theta, block)
        p = softmax(block, h)
        w = block.weights
        value = float(w @ (block.y * np.log(p)))
        d = [self.dv(v, block.alt, shapes)[:, None] * block.x]
        if self.layout.intercepts:
            d.insert(0, self.intercept_columns(block.alt))
        if self.layout.shapes:
            d.insert(0, self.dshape(v, block.alt, shapes))
        d = np.hstack(d)
        gradient = d.T @ (w * (block.y - p))
        if not second:
            return Totals(value, gradient)
        wp = w * p
        hessian = -((d * wp[:, None]).T @ d - block.sums(d * wp[:, None]).T @ block.sums(d * p[:, None]))
        scores = block.sums(d * (block.y - p)[:, None])
        return Totals(value, gradient, hessian, (scores * block.top[:, None]).T @ scores, block.chi_square(p))

    def penalised(self, theta: np.ndarray, totals: Totals, ridge: float | None) -> Totals:
        """With ridge times the squared norm taken off; the second-order terms follow."""
        if ridge is None:
            return totals
        eye = np.eye(len(theta))
        return Totals(
            totals.value - ridge * float(theta @ theta), totals.gradient - 2 * ridge * theta,
            None if totals.hessian is None else totals.hessian - 2 * ridge * eye,
            None if totals.information is None else totals.information - 2 * ridge * eye, totals.chi_square,
        )


class Cloglog(Family):
    def h(self, v, alt, shapes):
        return T.cloglog(v)

    def dv(self, v, alt, shapes):
        return T.cloglog_dv(v)


class _Gamma(Family):
    """A shape per alternative, exp of its parameter."""

    def _gamma(self, alt, shapes):
        return np.exp(np.clip(shapes, -T.CLIP, T.CLIP))[alt]

    def _hot(self, column, alt):
        return np.eye(self.n_alternatives)[alt] * column[:, None]


class Scobit(_Gamma):
    def h(self, v, alt, shapes):
        return T.scobit(v, self._gamma(alt, shapes))

    def dv(self, v, alt, shapes):
        return T.scobit_dv(v, self._gamma(alt, shapes))

    def dshape(self, v, alt, shapes):
        return self._hot(T.scobit_dshape(v, self._gamma(alt, shapes)), alt)


class Uneven(_Gamma):
    def h(self, v, alt, shapes):
        return T.uneven(v, self._gamma(alt, shapes))

    def dv(self, v, alt, shapes):
        return T.uneven_dv(v, self._gamma(alt, shapes))

    def dshape(self, v, alt, shapes):
        return self._hot(T.uneven_dshape(v, self._gamma(alt, shapes)), alt)


class Asym(Family):
    def h(self, v, alt, shapes):
        return T.asym(v, T.natural_asym(shapes, self.shape_ref)[alt], self.n_alternatives)

    def dv(self, v, alt, shapes):
        return T.asym_dv(v, T.natural_asym(shapes, self.shape_ref)[alt], self.n_alternatives)

    def dshape(self, v, alt, shapes):
        c = T.natural_asym(shapes, self.shape_ref)
        return T.asym_dc(v, c[alt])[:, None] * T.dc_deta(c, self.shape_ref)[alt]


@dataclass
class Nested(Family):
    """Parameters: an unconstrained number per nest (its natural one is the logistic), then the index."""

    nest_of_alt: np.ndarray = field(default_factory=lambda: np.zeros(0, int))

    def _levels(self, theta, block):
        theta = np.asarray(theta, float)
        lam_all = T.natural_nest(theta[: self.layout.nests])
        nest = self.nest_of_alt[block.alt]
        lam = lam_all[nest]
        with np.errstate(over="ignore"):
            s = np.exp(np.clip((block.x @ theta[self.layout.nests :]) / lam, -T.CLIP, T.CLIP))
        cell = block.obs * self.layout.nests + nest
        inclusive = np.bincount(cell, s, minlength=block.n_obs * self.layout.nests).reshape(block.n_obs, -1)
        with np.errstate(divide="ignore"):
            log_i = np.where(inclusive > 0, np.log(np.where(inclusive > 0, inclusive, 1.0)), -np.inf)
        # shares of the nests in each observation, through the largest exponent
        power = lam_all * log_i
        top = power.max(1, keepdims=True)
        e = np.exp(power - top)
        nest_p = e / e.sum(1, keepdims=True)
        q = s / inclusive.ravel()[cell]
        p = q * nest_p.ravel()[cell]
        return lam_all, nest, lam, cell, log_i, nest_p, q, np.where(p == 0, TINY, p)

    def probabilities(self, theta, block):
        return self._levels(theta, block)[-1]

    def components(self, theta, block):
        """(probability, probability given the nest, probability of the nest) per row."""
        *_, cell, _, nest_p, q, p = self._levels(theta, block)
        return p, q, nest_p.ravel()[cell]

    def evaluate(self, theta, block, second=False):
        theta = np.asarray(theta, float)
        n = self.layout.nests
        lam_all, nest, lam, cell, log_i, nest_p, q, p = self._levels(theta, block)
        value = float(block.weights @ (block.y * np.log(p)))
        chosen = np.bincount(cell, block.y, minlength=block.n_obs * n).reshape(block.n_obs, n)
        in_chosen = chosen.ravel()[cell]
        top = block.top
        u = (block.x @ theta[n:]) / lam
        # per observation: scores of the nests' natural parameters, through the logistic, then of the index
        first = (chosen - nest_p) * np.where(np.isfinite(log_i), log_i, 0.0)
        rows = (p - in_chosen * q) * u - (block.y - in_chosen * q) * u / lam
        nest_scores = first + np.bincount(cell, rows, minlength=block.n_obs * n).reshape(block.n_obs, n)
        nest_scores = nest_scores * lam_all * (1 - lam_all)
        index = (block.y / lam - q * in_chosen / lam + q * in_chosen - p)[:, None] * block.x
        scores = np.hstack([nest_scores, block.sums(index)])
        gradient = scores.T @ top
        if not second:
            return Totals(value, gradient)
        outer = (scores * top[:, None]).T @ scores
        return Totals(value, gradient, -outer, np.full_like(outer, np.nan), block.chi_square(p))

    def penalised(self, theta, totals, ridge):
        """The penalty is on natural nest parameters' distance from 1 and on the index."""
        if ridge is None:
            return totals
        n = self.layout.nests
        lam = T.natural_nest(theta[:n])
        slope = np.concatenate([2 * ridge * (lam - 1) * lam * (1 - lam), 2 * ridge * theta[n:]])
        penalty = ridge * (((lam - 1) ** 2).sum() + (theta[n:] ** 2).sum())
        hessian = None if totals.hessian is None else totals.hessian - 2 * ridge * np.eye(len(theta))
        return Totals(totals.value - penalty, totals.gradient - slope, hessian, totals.information, totals.chi_square)


@dataclass
class Mixed(Family):
    """Normally mixed coefficients: index, then a sigma per mixing variable.

    A block's draws are consumed a few at a time, so rows x draws is never held whole.
    """

    mixing: tuple[int, ...] = ()
    chunk: int = 1 << 21

    def _per_draw(self, theta, block):
        """(draws' slice, rows x draws probabilities, rows x draws x sigmas deviations' covariates)."""
        k = self.layout.index
        base = block.x @ theta[:k]
        z = block.x[:, list(self.mixing)]
        n_draws = block.draws.shape[1]
        step = max(1, self.chunk // max(1, len(base) * max(1, z.shape[1])))
        for a in range(0, n_draws, step):
            eta = block.draws[block.mix, a : a + step, :]
            terms = z[:, None, :] * eta
            v = base[:, None] + terms @ theta[k:]
            e = np.exp(np.clip(v, -T.CLIP, T.CLIP))
            p = e / grouped(block.obs, e, block.n_obs)[block.obs]
            yield slice(a, a + step), np.where(p == 0, TINY, p), terms

    def probabilities(self, theta, block):
        total = np.zeros(len(block.y))
        for _, p, _ in self._per_draw(np.asarray(theta, float), block):
            total += p.sum(1)
        return total / block.draws.shape[1]

    def _sequences(self, theta, block, parts=None):
        units = len(block.draws)
        logs = np.zeros((units, block.draws.shape[1]))
        mean_p = np.zeros(len(block.y))
        for part, p, _ in parts or self._per_draw(theta, block):
            logs[:, part] = grouped(block.mix, block.y[:, None] * np.log(p), units)
            mean_p += p.sum(1)
        return logs, mean_p / block.draws.shape[1]

    def sequence_probabilities(self, theta, block):
        """(units x draws) probabilities of all that each unit chose."""
        s = np.exp(self._sequences(np.asarray(theta, float), block)[0])
        return np.where(s == 0, TINY, s)

    def evaluate(self, theta, block, second=False):
        theta = np.asarray(theta, float)
        units, n_draws = block.draws.shape[:2]
        # draws that are used all at once serve both passes
        parts = list(self._per_draw(theta, block)) if block.draws.size * len(block.y) <= self.chunk * len(block.draws) else None
        logs, mean_p = self._sequences(theta, block, parts)
        top = logs.max(1, keepdims=True)
        e = np.exp(logs - top)
        total = e.sum(1, keepdims=True)
        log_mean = (top + np.log(total / n_draws)).ravel()
        share = e / total
        w = np.zeros(units)
        np.maximum.at(w, block.mix, block.w)
        scores = np.zeros((units, self.layout.size))
        for part, p, terms in parts or self._per_draw(theta, block):
            r = (block.y[:, None] - p) * share[block.mix, part]
            own = np.hstack([r.sum(1)[:, None] * block.x, np.einsum("nr,nrm->nm", r, terms)])
            scores += grouped(block.mix, own, units)
        value, gradient = float(w @ log_mean), scores.T @ w
        if not second:
            return Totals(value, gradient)
        outer = (scores * w[:, None]).T @ scores
        chi = float(((block.y - mean_p) ** 2 / np.where(mean_p == 0, TINY, mean_p)).sum())
        return Totals(value, gradient, -outer, np.full_like(outer, np.nan), chi)
