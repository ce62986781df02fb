"""Scale-invariant key points and 128-number descriptors of gray images."""

from __future__ import annotations

import math

import numpy as np

from .signals import gaussian

SCALES = 3


def _blur(x: np.ndarray, sigma: float) -> np.ndarray:
    return gaussian(gaussian(x, sigma, 0), sigma, 1)


def octaves(gray: np.ndarray, sigma: float) -> list[np.ndarray]:
    """Stacks of SCALES + 3 blurred images, each octave at half the size."""
    base, out = _blur(gray.astype(float) / 255, math.sqrt(max(sigma**2 - 0.25, 0.01))), []
    while min(base.shape) >= 16:
        stack = [base]
        for i in range(1, SCALES + 3):
            before, now = sigma * 2 ** ((i - 1) / SCALES), sigma * 2 ** (i / SCALES)
            stack.append(_blur(stack[-1], math.sqrt(now**2 - before**2)))
        out.append(np.stack(stack))
        base = stack[SCALES][::2, ::2]
    return out


def _extrema(d: np.ndarray, contrast: float, edge: float) -> list[tuple[int, int, int]]:
    """Places of d, a stack of differences, that are largest or least among their 26 neighbours, and neither flat nor edges."""
    inner = d[1:-1, 1:-1, 1:-1]
    top, low = np.ones(inner.shape, bool), np.ones(inner.shape, bool)
    for s in range(3):
        for y in range(3):
            for x in range(3):
                if (s, y, x) != (1, 1, 1):
                    other = d[s : s + inner.shape[0], y : y + inner.shape[1], x : x + inner.shape[2]]
                    top &= inner > other
                    low &= inner < other
    out = []
    for s, y, x in np.argwhere((top | low) & (np.abs(inner) > contrast / SCALES)) + 1:
        p = d[s]
        dxx, dyy = p[y, x + 1] + p[y, x - 1] - 2 * p[y, x], p[y + 1, x] + p[y - 1, x] - 2 * p[y, x]
        dxy = (p[y + 1, x + 1] - p[y + 1, x - 1] - p[y - 1, x + 1] + p[y - 1, x - 1]) / 4
        det = dxx * dyy - dxy * dxy
        if det > 0 and (dxx + dyy) ** 2 * edge < (edge + 1) ** 2 * det:
            out.append((int(s), int(y), int(x)))
    return out


def _directions(size: np.ndarray, turn: np.ndarray, y: int, x: int, sigma: float) -> list[float]:
    reach = int(round(4.5 * sigma))
    y0, y1, x0, x1 = max(0, y - reach), min(size.shape[0], y + reach + 1), max(0, x - reach), min(size.shape[1], x + reach + 1)
    yy, xx = np.mgrid[y0:y1, x0:x1]
    w = size[y0:y1, x0:x1] * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * (1.5 * sigma) ** 2))
    bins = np.bincount((turn[y0:y1, x0:x1] / (2 * math.pi) * 36).astype(int).ravel() % 36, w.ravel(), 36)
    bins = (np.roll(bins, 1) + 2 * bins + np.roll(bins, -1)) / 4
    before, after = np.roll(bins, 1), np.roll(bins, -1)
    at = np.flatnonzero((bins > before) & (bins > after) & (bins >= 0.8 * bins.max()))
    return [float((i + 0.5 + 0.5 * (before[i] - after[i]) / (before[i] - 2 * bins[i] + after[i])) * 2 * math.pi / 36) for i in at]


def _describe(size: np.ndarray, turn: np.ndarray, y: int, x: int, sigma: float, angle: float) -> np.ndarray:
    width = 3 * sigma
    reach = int(round(width * math.sqrt(2) * 2.5))
    yy, xx = np.mgrid[max(1, y - reach) : min(size.shape[0] - 1, y + reach + 1), max(1, x - reach) : min(size.shape[1] - 1, x + reach + 1)]
    c, s = math.cos(angle), math.sin(angle)
    u, v = ((xx - x) * c + (yy - y) * s) / width, (-(xx - x) * s + (yy - y) * c) / width
    w = size[yy, xx] * np.exp(-(u * u + v * v) / 8)
    o = ((turn[yy, xx] - angle) / (2 * math.pi) * 8) % 8
    bx, by = u + 1.5, v + 1.5
    ok = (bx > -1) & (bx < 4) & (by > -1) & (by < 4)
    bx, by, o, w = bx[ok], by[ok], o[ok], w[ok]
    out = np.zeros((6, 6, 8))
    ix, iy, io = np.floor(bx).astype(int), np.floor(by).astype(int), np.floor(o).astype(int)
    for dy in (0, 1):
        for dx in (0, 1):
            for do in (0, 1):
                share = np.abs(1 - dx - (bx - ix)) * np.abs(1 - dy - (by - iy)) * np.abs(1 - do - (o - io))
                np.add.at(out, (iy + dy + 1, ix + dx + 1, (io + do) % 8), w * share)
    d = out[1:5, 1:5].ravel()
    d = np.minimum(d, 0.2 * np.linalg.norm(d))
    n = np.linalg.norm(d)
    return np.minimum(255, np.rint(512 * d / n)) if n > 0 else d


def detect(gray: np.ndarray, mask: np.ndarray | None = None, n_features: int = 0, contrast: float = 0.04, edge: float = 10.0, sigma: float = 1.6) -> tuple[list[tuple[float, float, float, float, float, int]], np.ndarray]:
    """Key points (x, y, size, angle in degrees, response, octave) and their descriptors; n_features: the strongest only."""
    points, rows = [], []
    for o, stack in enumerate(octaves(gray, sigma)):
        d = np.diff(stack, axis=0)
        for s, y, x in _extrema(d, contrast, edge):
            if mask is not None and not mask[min(mask.shape[0] - 1, y << o), min(mask.shape[1] - 1, x << o)]:
                continue
            own = sigma * 2 ** (s / SCALES)
            dy, dx = np.gradient(stack[s])
            size, turn = np.hypot(dx, dy), np.arctan2(dy, dx) % (2 * math.pi)
            for angle in _directions(size, turn, y, x, own):
                points.append((float(x << o), float(y << o), 2 * own * 2**o, math.degrees(angle) % 360, float(abs(d[s, y, x])), o))
                rows.append(_describe(size, turn, y, x, own, angle))
    order = sorted(range(len(points)), key=lambda i: -points[i][4])[: n_features or None]
    order.sort()
    return [points[i] for i in order], np.array([rows[i] for i in order], np.float32).reshape(-1, 128)
