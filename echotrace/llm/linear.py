"""Linear classifiers on standardised features, fitted on the driver on bounded samples."""

from __future__ import annotations

import numpy as np


def fit_svm(xb: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 80) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine with squared hinge loss; `y` is -1 or 1, the last column of `xb` is one.

    Minimises |w|^2 / 2 + c / n * sum of max(0, 1 - y (x w + b))^2 * class balance, by
    Nesterov's method with the Lipschitz constant of the loss as inverse step.
    """
    x, d = xb, xb.shape[1] - 1
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    weight, y = weight.astype(x.dtype), y.astype(x.dtype)
    v = np.ones(d + 1, x.dtype)
    for _ in range(12):  # largest eigenvalue of the weighted Gram matrix
        v = xb.T @ (weight * (xb @ v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-300)
    step = x.dtype.type(1.0 / (1.0 + 2.0 * top))
    w, ahead, t = np.zeros(d + 1, x.dtype), np.zeros(d + 1, x.dtype), 1.0
    ridge = np.append(np.ones(d), 0.0).astype(x.dtype)
    for _ in range(steps):
        slack = np.maximum(0.0, 1.0 - y * (xb @ ahead))
        new = ahead - step * (ridge * ahead - 2.0 * (xb.T @ (weight * slack * y)))
        t_new = (1 + float(np.sqrt(1 + 4 * t * t))) / 2
        ahead = new + x.dtype.type((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])


def fit_slope(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope a of sigmoid(a * margin) that fits labels -1 or 1 best, among a fixed ladder."""
    ladder = np.geomspace(0.5, 32, 25)
    loss = [np.logaddexp(0, -a * y * margin).mean() + 0.001 * a for a in ladder]
    return float(ladder[int(np.argmin(loss))])


def fit_logistic(rows: list[np.ndarray], target: np.ndarray, size: int, ridge: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sets of features, to soft labels in 0..1.

    `rows` has the feature numbers that each sample holds. Both labels weigh the same in all.
    Minimises the weighted loss plus ridge * |w|^2 / 2 by Nesterov's method, with a step for
    each feature from a diagonal bound of the curvature, begun anew where the loss rises.
    """
    n = len(rows)
    lens = np.array([len(r) for r in rows], np.int64)
    cols = np.concatenate(rows).astype(np.int64) if n else np.empty(0, np.int64)
    rown = np.repeat(np.arange(n), lens)
    weight = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    weight *= n / 2
    # |sum of a row's weights|^2 <= (features of the row + 1) * sum of their squares
    bound = 0.25 * weight * (lens + 1)
    step = 1 / (np.bincount(cols, bound[rown], minlength=size) + ridge)
    step_b = 1 / max(bound.sum(), 1e-9)
    w, b = np.zeros(size), 0.0
    at, at_b, t, last = w, b, 1.0, np.inf
    for _ in range(steps):
        z = at_b + np.bincount(rown, at[cols], minlength=n)
        err = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target)
        new = at - step * (np.bincount(cols, err[rown], minlength=size) + ridge * at)
        new_b = at_b - step_b * err.sum()
        loss = float((weight * (np.logaddexp(0, z) - target * z)).sum() + ridge * (at @ at) / 2)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2 if loss <= last else 1.0
        push = (t - 1) / t_new if loss <= last else 0.0
        at, at_b = new + push * (new - w), new_b + push * (new_b - b)
        w, b, t, last = new, new_b, t_new, loss
    return w, float(b)
