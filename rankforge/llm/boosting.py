"""Boosted decision trees for small, bounded training sets.

Logistic loss, second-order leaf values, features cut into at most 32 bins.
Fitting runs on the rows given (the callers bound them); scoring is array
code that runs inside tasks on any number of rows.
"""

from __future__ import annotations

import numpy as np

BINS = 32


def _split(codes, gradient, hessian, rows, ridge):
    """Best (gain, feature, bin) for the rows of one node."""
    best = (1e-6, -1, 0)
    g, h = gradient[rows], hessian[rows]
    all_g, all_h = g.sum(), h.sum()
    for j in range(codes.shape[1]):
        left_g = np.cumsum(np.bincount(codes[rows, j], g, BINS))[:-1]
        left_h = np.cumsum(np.bincount(codes[rows, j], h, BINS))[:-1]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
        gain[(left_h < 1e-3) | (right_h < 1e-3)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, k)
    return best


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x, y, trees=40, depth=3, rate=0.2, ridge=1.0):
    """Model for a feature matrix and 0/1 labels: plain values, safe to broadcast."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1])) for column in x.T]
    codes = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, forest = np.full(len(y), start), []
    for _ in range(trees):
        p = sigmoid(score)
        gradient, hessian = p - y, p * (1 - p)
        # a tree is a full binary heap of (feature, threshold), then its leaves
        nodes, leaves = [(-1, 0.0)] * (2**depth - 1), np.zeros(2**depth)
        parts = {0: np.arange(len(y))}
        for node in range(2**depth - 1):
            rows = parts.pop(node)
            gain, j, k = _split(codes, gradient, hessian, rows, ridge) if len(rows) > 1 else (0, -1, 0)
            right = codes[rows, j] > k if j >= 0 else np.zeros(len(rows), dtype=bool)
            if j >= 0:
                nodes[node] = (j, float(cuts[j][k]) if k < len(cuts[j]) else np.inf)
            parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]
        for node, rows in parts.items():
            value = -rate * gradient[rows].sum() / (hessian[rows].sum() + ridge)
            leaves[node - (2**depth - 1)] = value
            score[rows] += value
        forest.append((nodes, leaves))
    return {"start": start, "depth": depth, "forest": forest}


def decision(model, x):
    """Log odds per row."""
    score = np.full(len(x), model["start"])
    for nodes, leaves in model["forest"]:
        feature = np.array([j for j, _ in nodes])
        limit = np.array([t for _, t in nodes])
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(model["depth"]):
            j = feature[at]
            right = (j >= 0) & (x[np.arange(len(x)), np.maximum(j, 0)] > limit[at])
            at = 2 * at + 1 + right
        score += leaves[at - len(nodes)]
    return score


def calibrate(score, y, steps=60):
    """(a, b) of the sigmoid a * score + b that fits held-out labels, by Newton steps."""
    a, b = 1.0, 0.0
    # smoothed targets keep the fit finite where the classes separate
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    for _ in range(steps):
        p = sigmoid(a * score + b)
        # a weak pull to the identity keeps separable classes finite
        g = np.array([((p - target) * score).sum() + (a - 1), (p - target).sum() + b])
        w = p * (1 - p) + 1e-9
        hess = np.array([[(w * score * score).sum(), (w * score).sum()], [(w * score).sum(), w.sum()]])
        step = np.linalg.solve(hess + np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
