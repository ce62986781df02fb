"""The ellipse of least algebraic distance from the power sums of its points."""

from __future__ import annotations

import math

import numpy as np

#: Exponents of x and y in the sums of an ellipse's scatter matrix.
POWERS = [(i, j) for total in range(5) for i in range(total, -1, -1) for j in (total - i,)]
_QUADRATIC, _LINEAR = [(2, 0), (1, 1), (0, 2)], [(1, 0), (0, 1), (0, 0)]


def conic(sums: dict[tuple[int, int], float]) -> np.ndarray | None:
    """Coefficients (x^2, xy, y^2, x, y, 1) of the ellipse of least algebraic distance, or None where no ellipse fits."""
    block = lambda rows, cols: np.array([[sums[a + c, b + d] for c, d in cols] for a, b in rows])
    s1, s2, s3 = block(_QUADRATIC, _QUADRATIC), block(_QUADRATIC, _LINEAR), block(_LINEAR, _LINEAR)
    if sums[0, 0] < 5 or np.linalg.cond(s3) > 1e12:
        return None
    t = -np.linalg.solve(s3, s2.T)
    m = s1 + s2 @ t
    values, vectors = np.linalg.eig(np.array([m[2] / 2, -m[1], m[0] / 2]))
    vectors = vectors.real
    good = np.flatnonzero((4 * vectors[0] * vectors[2] - vectors[1] ** 2 > 1e-9) & (np.abs(values.imag) < 1e-9))
    if not len(good):
        return None
    top = vectors[:, good[np.argmin(np.abs(values.real[good]))]]
    return np.concatenate([top, t @ top])


def axes_of(c: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """Middle, longer and shorter axis and the longer one's angle in degrees, in [0, 180), of a conic."""
    a = np.array([[c[0], c[1] / 2], [c[1] / 2, c[2]]])
    middle = np.linalg.solve(2 * a, -c[3:5])
    level = -(c[5] + middle @ c[3:5] / 2)
    values, vectors = np.linalg.eigh(a)
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.sqrt(level / values)
    if not np.isfinite(half).all():
        return None
    k = int(np.argmax(half))
    return float(middle[0]), float(middle[1]), float(2 * half[k]), float(2 * half[1 - k]), math.degrees(math.atan2(vectors[1, k], vectors[0, k])) % 180
