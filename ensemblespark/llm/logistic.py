"""Weighted logistic regression on a few bounded columns."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Newton steps from zero; the first column of x is the constant and isn't shrunk."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    z, b = x / scale, np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge * weight.sum()] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        slope = z.T @ (weight * (p - y)) + penalty @ b
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(b))
        step = np.clip(np.linalg.solve(curve, slope), -3, 3)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return b / scale
