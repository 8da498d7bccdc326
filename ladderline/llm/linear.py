"""Sparse linear models on hashed features, trained with follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for a softmax over classes, with L1 and L2 penalties (elastic net)."""

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features + 1, classes))  # the last row is the bias
        self.n = np.zeros((features + 1, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def fit(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int, seed: int) -> np.ndarray:
        """rows: (features, values); target: shares of the classes. Returns weights, bias last."""
        rng, bias = np.random.default_rng(seed), len(self.z) - 1
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                at, x = np.append(rows[k][0], bias), np.append(rows[k][1], 1.0)
                w = self.weights(at)
                g = np.outer(x, softmax(x @ w) - target[k])
                n = self.n[at]
                sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
                self.z[at] += g - sigma * w
                self.n[at] = n + g * g
        return self.weights()


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits with the smallest log loss on held-back rows."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
