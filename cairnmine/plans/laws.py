"""Laws of cell counts: normals over the cells of a histogram, whole or truncated below, alone or mixed.

A cell is a box [left, left + 1). Probabilities of boxes come from Gauss-Legendre quadrature, one dimension after the
other by conditioning. All of it works on cells, whose number the bins of a histogram bound.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from ..operators.stats import elias_bits, universal_length

REACH, LEAST_MASS, FLOAT_BITS = 8.0, 8e-3, 32
_NODES = {m: np.polynomial.legendre.leggauss(m) for m in (8, 64)}
_erf = np.vectorize(math.erf, otypes=[float])


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(z, float) / math.sqrt(2)))


def rectangle(low: np.ndarray, high: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Probability of each box (rows of ``low`` and ``high``, which may be infinite) under a normal."""
    low, high, cov = np.atleast_2d(np.asarray(low, float)), np.atleast_2d(np.asarray(high, float)), np.atleast_2d(np.asarray(cov, float))
    mean = np.broadcast_to(np.asarray(mean, float), low.shape)
    std = math.sqrt(cov[0, 0])
    a = np.clip((low[:, 0] - mean[:, 0]) / std, -REACH, REACH)
    b = np.clip((high[:, 0] - mean[:, 0]) / std, -REACH, REACH)
    if low.shape[1] == 1:
        return np.maximum(normal_cdf(b) - normal_cdf(a), 0)
    x, w = _NODES[8 if (b - a).max(initial=0) <= 1.5 else 64]
    z = (a[:, None] + b[:, None]) / 2 + (b - a)[:, None] / 2 * x
    slope = cov[0, 1:] / std
    rest = (mean[:, None, 1:] + z[:, :, None] * slope).reshape(-1, low.shape[1] - 1)
    wide = lambda t: np.repeat(t[:, 1:], len(x), axis=0)
    inner = rectangle(wide(low), wide(high), rest, cov[1:, 1:] - np.outer(slope, slope)).reshape(len(low), -1)
    return np.maximum((inner * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * w).sum(axis=1) * (b - a) / 2, 0)


@dataclass
class Law:
    means: np.ndarray  # (k, d)
    covs: np.ndarray  # (k, d, d)
    weights: np.ndarray  # (k,)
    lower: np.ndarray | None = None  # of each dimension, if truncated

    def components(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """(boxes, k): each component's probability, as a part of what it has above ``lower``."""
        out = []
        for m, c in zip(self.means, self.covs):
            p = rectangle(left, right, m, c)
            if self.lower is not None:
                p = p / max(LEAST_MASS, float(rectangle(self.lower, np.full(len(m), np.inf), m, c)[0]))
            out.append(p)
        return np.stack(out, axis=1)

    def probability(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.components(left, right) @ self.weights

    def loss(self, left: np.ndarray, n: np.ndarray) -> float:
        """Minus the log-likelihood of cells (unit boxes from ``left``) with ``n`` points each."""
        return -float((n * np.log(np.maximum(self.probability(left, left + 1), 1e-10))).sum())

    def parameters(self) -> list[float]:
        """The free ones: means, upper triangles of covariances, all weights but one."""
        up = np.triu_indices(self.means.shape[1])
        return [*self.means.reshape(-1).tolist(), *[float(x) for c in self.covs for x in c[up]], *self.weights[:-1].tolist()]


def minimise(f: Callable[[np.ndarray], float], x: np.ndarray, step: np.ndarray, tol: float = 1e-4, most: int = 400) -> np.ndarray:
    """Downhill simplex search; ``most`` evaluations bound it."""
    points = np.vstack([x, x + np.diag(step)])
    values = np.array([f(p) for p in points])
    used = len(values)
    while used < most:
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if abs(values[-1] - values[0]) <= tol * (abs(values[0]) + tol):
            break
        centre = points[:-1].mean(axis=0)

        def tried(t: float) -> tuple[float, np.ndarray]:
            p = centre + t * (points[-1] - centre)
            return f(p), p

        v, p = tried(-1.0)
        used += 1
        if v < values[0]:
            further = tried(-2.0)
            used += 1
            v, p = min((v, p), further, key=lambda c: c[0])
        elif v >= values[-2]:
            v, p = min((v, p), tried(0.5 if v >= values[-1] else -0.5), key=lambda c: c[0])
            used += 1
        if v < values[-1]:
            points[-1], values[-1] = p, v
        else:
            points[1:] = points[0] + 0.5 * (points[1:] - points[0])
            values[1:] = [f(q) for q in points[1:]]
            used += len(values) - 1
    return points[int(np.argmin(values))]


def moments(left: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of counted cells; a cell's own extent counts as variance."""
    x = np.asarray(left, float) + 0.5
    mean = (n[:, None] * x).sum(axis=0) / n.sum()
    return mean, (n[:, None] * (x - mean)).T @ (x - mean) / n.sum() + np.eye(x.shape[1]) / 12


def fit_normal(left: np.ndarray, n: np.ndarray) -> Law:
    m, c = moments(left, n)
    return Law(m[None], c[None], np.ones(1))


def fit_truncated(left: np.ndarray, n: np.ndarray, lower: np.ndarray | float = 0.0) -> Law:
    """The likeliest normal truncated below ``lower``, searched from the moments. Covariances stay positive: the search moves
    their Cholesky factors."""
    left = np.asarray(left, float)
    d = left.shape[1]
    lower = np.broadcast_to(np.asarray(lower, float), (d,))
    m, c = moments(left, n)
    at, diag = np.tril_indices(d), np.arange(d)
    factor = np.linalg.cholesky(c)

    def law(x: np.ndarray) -> Law:
        f = np.zeros((d, d))
        f[at] = x[d:]
        f[diag, diag] = np.exp(np.clip(f[diag, diag], -5, 5))
        return Law(x[None, :d], (f @ f.T)[None], np.ones(1), lower)

    start = factor.copy()
    start[diag, diag] = np.log(factor[diag, diag])
    x = np.r_[m, start[at]]
    return law(minimise(lambda v: law(v).loss(left, n), x, np.r_[np.diag(factor) / 2, np.full(len(at[0]), 0.2)]))


def fit_mixture(left: np.ndarray, n: np.ndarray, k: int = 2, lower: np.ndarray | float | None = None, rounds: int = 60) -> Law:
    """A mixture of k normals by expectation maximisation from centres that are far apart; if ``lower`` is given, of truncated ones,
    whose components are searched in turn at the end."""
    left = np.asarray(left, float)
    x, d = left + 0.5, left.shape[1]
    m, c = moments(left, n)
    own = np.linalg.inv(c)
    far = lambda p: ((x - p) @ own * (x - p)).sum(axis=1)
    centres = [x[int(np.argmax(n * np.maximum(far(m), 1e-9)))]]
    while len(centres) < k:
        centres.append(x[int(np.argmax(n * np.min([far(p) for p in centres], axis=0)))])
    law = Law(np.array(centres), np.repeat((c / k)[None], k, axis=0), np.full(k, 1 / k))
    before = np.inf
    for _ in range(rounds):
        p = law.components(left, left + 1) * law.weights + 1e-300
        share = p / p.sum(axis=1, keepdims=True) * n[:, None]
        fits = [moments(left, share[:, j] + 1e-9) for j in range(k)]
        law = Law(np.array([f[0] for f in fits]), np.array([f[1] for f in fits]), share.sum(axis=0) / n.sum())
        loss = law.loss(left, n)
        if before - loss < 1e-6 * abs(loss):
            break
        before = loss
    if lower is None:
        return law
    low = np.broadcast_to(np.asarray(lower, float), (d,))
    p = law.components(left, left + 1) * law.weights + 1e-300
    share = p / p.sum(axis=1, keepdims=True) * n[:, None]
    parts = [fit_truncated(left, share[:, j] + 1e-9, low) for j in range(k)]
    return Law(np.array([f.means[0] for f in parts]), np.array([f.covs[0] for f in parts]), law.weights, low)


def _empirical(z: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    n = len(z)
    z = np.clip(np.sort(z), h + 1e-12, 1 - 1e-12)
    return z, h + (1 - h) * np.arange(1, n + 1) / n, h + (1 - h) * np.arange(n) / n, math.sqrt(n)


def supremum_ad(z: np.ndarray, h: float = 0.0, side: str = "both", upper_tail: bool = False) -> float:
    """Largest weighted distance of the empirical law from ``z``, probabilities of a sample under a law that has ``h`` below the
    truncation. Weight: 1 / sqrt((F - h)(1 - F)), or 1 / (1 - F) for the upper tail. side: both, greater or less."""
    z, upto, below, root = _empirical(z, h)
    w = 1 / (1 - z) if upper_tail else 1 / np.sqrt((z - h) * (1 - z))
    above, under = float((w * (upto - z)).max()), float((w * (z - below)).max())
    return root * {"greater": above, "less": under, "both": max(above, under)}[side]


def quadratic_ad(z: np.ndarray, h: float = 0.0, upper_tail: bool = False) -> float:
    """The integrated squared distance with weight 1 / ((F - h)(1 - F)), or 1 / (1 - F)^2 for the upper tail."""
    n = len(z)
    z = np.clip(np.sort(z), h + 1e-12, 1 - 1e-12)
    k = np.arange(1, n + 1)
    after = 1 + 2 * (n - k)
    if upper_tail:
        return float(-2 * n * math.log(1 - h) + 2 * np.log(1 - z).sum() + (1 - h) / n * (after / (1 - z)).sum())
    return float(-n + 2 * n * math.log(1 - h) - (after * np.log(1 - z) + (2 * k - 1) * np.log(z - h)).sum() / n)


def truncated_p(x: np.ndarray, mean: float, std: float, low: float = -np.inf, statistic: Callable[[np.ndarray, float], float] | None = None, sims: int = 100, seed: int = 0) -> float:
    """p-value of a sample under a normal truncated below ``low``, by simulation of that law."""
    statistic = statistic or (lambda z, h: quadratic_ad(z, h, True))
    h = float(normal_cdf(np.array([(low - mean) / std]))[0]) if np.isfinite(low) else 0.0
    own, rng = statistic(normal_cdf((np.asarray(x, float) - mean) / std), h), np.random.RandomState(seed)
    return float(np.mean([statistic(h + (1 - h) * rng.uniform(size=len(x)), h) >= own for _ in range(sims)]))


def is_truncated(left: np.ndarray, n: np.ndarray, law: Law, alpha: float = 0.1, most: int = 400, seed: int = 0) -> bool:
    """Whether every dimension of every component passes the upper-tail test. Points lie evenly inside their cells; samples are drawn
    down to ``most`` points, as counts without end reject any law of cells."""
    rng = np.random.RandomState(seed)
    owner = (law.components(left, left + 1) * law.weights).argmax(axis=1)
    for j in range(len(law.weights)):
        cells, c = np.asarray(left, float)[owner == j], n[owner == j]
        if not c.sum():
            continue
        x = cells[rng.choice(len(cells), int(min(most, max(2, c.sum()))), p=c / c.sum())]
        x = x + rng.uniform(size=x.shape)
        for k in range(x.shape[1]):
            low = -np.inf if law.lower is None else law.lower[k]
            if truncated_p(x[:, k], law.means[j, k], math.sqrt(law.covs[j, k, k]), low, seed=seed) < alpha:
                return False
    return True


def description_length(n: np.ndarray, label: np.ndarray, p: np.ndarray, laws: list[Law], shape: tuple[int, ...]) -> float:
    """Bits of a labelled histogram: the clusters' number and parameters, sizes, and the differences of counts from what the
    clusters expect; -1 labels outliers, which are coded as they are."""
    bits = universal_length(len(laws)) + sum(universal_length(s) for s in shape)
    code = lambda expected, counts: sum(len(elias_bits(int(c) - int(e))) for e, c in zip(expected, counts))
    for k, law in enumerate(laws):
        own = label == k
        bits += code(p[own] * n[own].sum(), n[own]) + FLOAT_BITS * (len(law.parameters()) + 1) + 1
    out = label == -1
    return bits + code(np.zeros(out.sum()), n[out])
