"""Linear models on sparse rows, fitted on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse rows: those of row r are at first[r]:first[r + 1]."""

    first: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> Rows:
        first = np.concatenate(([0], np.cumsum([len(c) for c, _ in rows]))).astype(np.int64)
        none = (np.zeros(0, np.int64), np.zeros(0))
        return cls(first, *(np.concatenate([x[k] for x in rows] or [none[k]]) for k in (0, 1)), width)

    def __len__(self) -> int:
        return len(self.first) - 1

    def take(self, rows: np.ndarray) -> Rows:
        return Rows.of([(self.column[a:b], self.value[a:b]) for a, b in zip(self.first[rows], self.first[rows + 1], strict=True)], self.width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0.0], np.cumsum(w[self.column] * self.value)))
        return upto[self.first[1:]] - upto[self.first[:-1]]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * np.repeat(r, np.diff(self.first)), self.width)


def minimize(loss, w: np.ndarray, steps: int = 100, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; loss gives (value, gradient)."""
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, kept = grad.copy(), []
        for s, y, rho in reversed(past):
            a = rho * (s @ q)
            q -= a * y
            kept.append(a)
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(past, reversed(kept), strict=True):
            q += (a - rho * (y @ q)) * s
        slope, t = -(grad @ q), 1.0 if past else min(1.0, 1.0 / (np.abs(grad).sum() + 1e-12))
        if slope >= 0 or -slope < 1e-12:
            break
        while True:
            new, g = loss(w - t * q)
            if new <= value + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = -t * q, g - grad
        done = value - new < 1e-9 * max(1.0, abs(value))
        w, value, grad = w + s, new, g
        if (sy := s @ y) > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / sy)]
        if done:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def svm(x: Rows, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge; y is -1 or 1, classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))

    def loss(w):
        gap = np.maximum(0, 1 - y * (x.dot(w[:-1]) + w[-1]))
        r = -2 * weight * y * gap
        return weight @ gap**2 + ridge / 2 * (w[:-1] @ w[:-1]), np.append(x.back(r) + ridge * w[:-1], r.sum())

    return minimize(loss, np.zeros(x.width + 1))


def logistic(x: Rows, q: np.ndarray, ridge: float = 1e-4, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (bias last) of a logistic regression on soft labels q; rows count by ``weight``."""
    part = np.full(len(q), 1 / max(1, len(q))) if weight is None else weight / weight.sum()

    def loss(w):
        z = x.dot(w[:-1]) + w[-1]
        r = (sigmoid(z) - q) * part
        return part @ (np.logaddexp(0, z) - q * z) + ridge / 2 * (w[:-1] @ w[:-1]), np.append(x.back(r) + ridge * w[:-1], r.sum())

    return minimize(loss, np.zeros(x.width + 1))


def slope(margin: np.ndarray, y: np.ndarray) -> float:
    """a > 0 for which sigmoid(a * margin) fits y (-1 or 1) best."""
    grid = 2.0 ** np.arange(-3, 6)
    return float(grid[np.argmin([np.mean(np.logaddexp(0, -a * y * margin)) for a in grid])]) if len(y) else 1.0
