"""Calibration of scores to probabilities, fitted on the driver from a bounded sample
(the callers' documented parameter): logistic for a few features, isotonic for one."""

from __future__ import annotations

import numpy as np


def expand(x: np.ndarray) -> np.ndarray:
    """A constant, the features, their squares and products."""
    k = x.shape[1]
    pairs = [x[:, i] * x[:, j] for i in range(k) for j in range(i, k)]
    return np.column_stack([np.ones(len(x)), x, *pairs])


def plain(x: np.ndarray) -> np.ndarray:
    """A constant and the features."""
    return np.column_stack([np.ones(len(x)), x])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50, products: bool = True) -> dict:
    """Ridge-penalised logistic regression of ``y`` (0 or 1) on standardised
    features (with squares and products unless told otherwise) by Newton's method.
    One class alone gives a constant."""
    form = expand if products else plain
    if not len(y):
        return {"mean": np.zeros(x.shape[1]), "sd": np.ones(x.shape[1]), "beta": None, "constant": 0.5}
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 1e-12, sd, 1.0)
    if y.min() == y.max():
        return {"mean": mean, "sd": sd, "beta": None, "constant": float((y.sum() + 0.5) / (len(y) + 1))}
    low, high = x.min(axis=0), x.max(axis=0)
    z = form((x - mean) / sd)
    beta, pull = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        move = np.linalg.solve((z * w[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * beta)
        beta = beta + move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return {"mean": mean, "sd": sd, "beta": beta, "constant": 0.5, "products": products, "low": low, "high": high}


def apply_logistic(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1.  Features are held within the range seen when
    fitting: nothing is extrapolated."""
    if model["beta"] is None:
        return np.full(len(x), model["constant"])
    form = expand if model["products"] else plain
    z = form((np.clip(x, model["low"], model["high"]) - model["mean"]) / model["sd"])
    return 1 / (1 + np.exp(-np.clip(z @ model["beta"], -30, 30)))


def fit_isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """The never falling curve through weighted ``y`` (0 or 1) over ``x``, by pooling
    neighbours that fall; each pool is drawn to the common share by half a row."""
    if not len(y):
        return {"at": np.zeros(1), "share": np.full(1, 0.5)}
    common, half = float(np.average(y, weights=weight)), 0.5 * float(np.mean(weight))
    order = np.lexsort((-y, x))
    pools: list[list[float]] = []  # first x, last x, weighted sum, weight
    for k in order:
        pools.append([x[k], x[k], weight[k] * y[k], weight[k]])
        while len(pools) > 1 and (pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]):
            _, last, total, heavy = pools.pop()
            pools[-1] = [pools[-1][0], last, pools[-1][2] + total, pools[-1][3] + heavy]
    share = np.maximum.accumulate([(p[2] + half * common) / (p[3] + half) for p in pools])
    return {"at": np.array([a for p in pools for a in p[:2]]), "share": np.repeat(share, 2)}


def apply_isotonic(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of label 1, straight lines between the pools."""
    return np.interp(x, model["at"], model["share"])
