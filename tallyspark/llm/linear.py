"""Logistic regression with L2, and Platt calibration, by Newton steps on conjugate gradients (numpy)."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Sparse:
    """Blocks of (row, feature) pairs, and a value per feature, with the two products that a fit needs."""

    def __init__(self, value: np.ndarray, rows: int):
        self.value, self.shape, self.blocks = value, (rows, len(value)), []

    def add(self, row: np.ndarray, col: np.ndarray, n: np.ndarray) -> None:
        """Distinct pairs by feature: col is in n rows, which stand one after another in row."""
        if len(row):
            self.blocks.append((row, col, np.cumsum(n) - n, n))

    def dot(self, w: np.ndarray) -> np.ndarray:
        w, out = w * self.value, np.zeros(self.shape[0])
        for row, col, _, n in self.blocks:
            out += np.bincount(row, weights=np.repeat(w[col], n), minlength=len(out))
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[1])
        for row, col, at, _ in self.blocks:
            out[col] += np.add.reduceat(r[row], at)
        return out * self.value


class Dense:
    def __init__(self, x: np.ndarray):
        self.x, self.shape = x, x.shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, r: np.ndarray) -> np.ndarray:
        return r @ self.x


def fit_logistic(x: Sparse | Dense, y: np.ndarray, l2: float = 1.0, steps: int = 25, weight: np.ndarray | None = None,
                 rest: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and intercept.  With one class (or no row) the weights are 0 and the intercept is the smoothed log odds.

    The equations of a Newton step are solved until ``rest`` of the squared gradient is left.
    """
    n, m = x.shape
    q = np.ones(n) if weight is None else weight
    pos, neg = float((q * y).sum()), float((q * (1 - y)).sum())
    w, b = np.zeros(m), float(np.log((pos + 1) / (neg + 1)))
    if pos == 0 or neg == 0:
        return w, b

    def loss(w, b):
        z = x.dot(w) + b
        return float((q * (np.logaddexp(0, z) - y * z)).sum()) + l2 / 2 * float(w @ w)

    now = loss(w, b)
    for _ in range(steps):
        p = sigmoid(x.dot(w) + b)
        r, h = q * (p - y), q * p * (1 - p) + 1e-6
        g = np.append(x.back(r) + l2 * w, r.sum())
        if not g.any():
            break
        d, res = np.zeros(m + 1), -g
        c, rs = res.copy(), float(res @ res)
        for _ in range(40):
            t = h * (x.dot(c[:m]) + c[m])
            hc = np.append(x.back(t) + l2 * c[:m], t.sum())
            a = rs / max(float(c @ hc), 1e-12)
            d, res = d + a * c, res - a * hc
            new = float(res @ res)
            if new < rest * float(g @ g):
                break
            c, rs = res + new / rs * c, new
        size = 1.0
        while size > 1e-4 and (after := loss(w + size * d[:m], b + size * d[m])) > now:
            size /= 2
        if size <= 1e-4 or now - after < 1e-6 * max(1.0, now):
            break
        w, b, now = w + size * d[:m], b + size * float(d[m]), after
    return w, b


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the calibrated log odds a * z + b (smoothed; without both classes: 0 and the log odds)."""
    w, b = fit_logistic(Dense(z[:, None]), y, l2=1e-3)
    return float(w[0]), b
