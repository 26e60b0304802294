"""Follow-the-regularised-leader with elastic-net penalties, per coordinate, for sparse examples."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Binary (classes=1) or multinomial logistic regression. The last row of the weights is the bias."""

    def __init__(self, size: int, classes: int = 1, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((size + 1, classes))
        self.n = np.zeros((size + 1, classes))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, idx: np.ndarray, val: np.ndarray, y: int, weight: float = 1.0) -> None:
        rows = np.append(idx, len(self.z) - 1)
        x = np.append(val, 1.0)
        w = self.weights(rows)
        s = x @ w
        if w.shape[1] == 1:
            g = 1 / (1 + np.exp(-np.clip(s, -40, 40))) - y
        else:
            g = np.exp(s - s.max())
            g /= g.sum()
            g[y] -= 1
        grad = weight * x[:, None] * g[None, :]
        n = self.n[rows]
        more = n + grad * grad
        self.z[rows] += grad - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = more


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int = 1, epochs: int = 5, seed: int = 0, **penalties) -> np.ndarray:
    """Weights (size + 1, classes). Examples are taken in an order that depends on the seed only."""
    model, rng = Ftrl(size, classes, **penalties), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            model.learn(*examples[i])
    return model.weights()
