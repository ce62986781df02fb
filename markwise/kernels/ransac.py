"""Robust affine and projective fits between two point sets."""

from __future__ import annotations

import math

import numpy as np

SAMPLE = {"affine": 3, "homography": 4}


def fit(model: str, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Least squares of b on a; None for points that don't determine it."""
    if model == "affine":
        x = np.column_stack([a, np.ones(len(a))])
        if np.linalg.matrix_rank(x) < 3:
            return None
        return np.linalg.lstsq(x, b, rcond=None)[0].T
    norm = []
    for p in (a, b):
        center, size = p.mean(0), np.sqrt(((p - p.mean(0)) ** 2).sum(1).mean()) or 1.0
        norm.append(np.array([[1 / size, 0, -center[0] / size], [0, 1 / size, -center[1] / size], [0, 0, 1]]))
    pa, pb = (np.column_stack([p, np.ones(len(p))]) @ n.T for p, n in zip((a, b), norm, strict=True))
    rows = np.concatenate([np.column_stack([pa, np.zeros_like(pa), -pb[:, :1] * pa]), np.column_stack([np.zeros_like(pa), pa, -pb[:, 1:2] * pa])])
    _, s, vt = np.linalg.svd(rows)
    if len(s) < 8 or s[7] < 1e-9 * s[0]:
        return None
    h = np.linalg.inv(norm[1]) @ vt[-1].reshape(3, 3) @ norm[0]
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def apply(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.column_stack([p, np.ones(len(p))]) @ m.T
    if m.shape[0] == 2:
        return out
    with np.errstate(divide="ignore", invalid="ignore"):
        return out[:, :2] / out[:, 2:]


def ransac(a: np.ndarray, b: np.ndarray, model: str = "homography", threshold: float = 5.0, confidence: float = 0.99, most: int = 2000, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """The transform of the largest consensus, refitted to it, and the mask of its inliers."""
    if model not in SAMPLE:
        raise ValueError(f"unknown model {model!r}")
    k, n = SAMPLE[model], len(a)
    best, mask = None, np.zeros(n, bool)
    if n < k:
        return None, mask
    rng = np.random.default_rng(seed)
    turns, done = most, 0
    while done < turns:
        done += 1
        pick = rng.choice(n, k, replace=False)
        m = fit(model, a[pick], b[pick])
        if m is None:
            continue
        near = (((apply(m, a) - b) ** 2).sum(1) <= threshold**2)
        if near.sum() > mask.sum():
            best, mask = m, near
            share = near.mean()
            if share == 1:
                break
            turns = min(most, math.ceil(math.log(1 - confidence) / math.log(1 - share**k)) if share**k > 1e-12 else most)
    if best is not None and mask.sum() >= k:
        again = fit(model, a[mask], b[mask])
        if again is not None:
            near = ((apply(again, a) - b) ** 2).sum(1) <= threshold**2
            if near.sum() >= mask.sum():
                best, mask = again, near
    return best, mask
