"""Hashed byte n-grams and linear support vector machines fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np


def ngram_ids(data: bytes, orders: range, bits: int) -> np.ndarray:
    """Hashed ids (below 2**bits) of all n-grams of `data`, n in `orders`, repeats included."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out, h = [], None
    for n in range(1, orders.stop):
        if len(b) < n:
            break
        h = b if h is None else h[:-1] * np.uint32(16777619) + b[n - 1:]
        if n in orders:
            out.append((h * np.uint32(2654435761) + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) >> np.uint32(32 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, c: float = 1.0,
              epochs: int = 30, weights: np.ndarray | None = None, seed: int = 0,
              tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear SVM (hinge loss, L2) by dual coordinate descent over sparse rows.

    rows: (ids, values) of each example; y: +1 / -1; weights: cost factor of each
    example. The bias is a constant feature of value 1. Stops when the largest
    projected gradient of an epoch is under `tol`."""
    w, bias = np.zeros(dims), 0.0
    alpha = np.zeros(len(rows))
    cost = c * (np.ones(len(rows)) if weights is None else weights)
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            ids, v = rows[i]
            g = y[i] * (w[ids] @ v + bias) - 1.0
            projected = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= cost[i] else g
            if projected:
                worst = max(worst, abs(projected))
                new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[ids] += step * v
                bias += step
        if worst < tol:
            break
    return w, bias


def fit_sigmoid(margins: np.ndarray, positive: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of P(positive) = 1 / (1 + exp(-(a * margin + b))), by Newton steps with smoothed targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    t = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    p = np.array([1.0, 0.0])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (t - q))
        p = p + step
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0]), float(p[1])


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))
