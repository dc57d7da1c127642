"""Kernels on one series whose cost grows with its length: systems of five bands, and pairs in order."""

from __future__ import annotations

import numpy as np

Bands = tuple[np.ndarray, np.ndarray, np.ndarray]


def second_differences(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (a, b, c) of neighbouring points in the change of slope at each inner point, for steps ``h``."""
    a, c = 1 / h[:-1], 1 / h[1:]
    return a, -(a + c), c


def gram(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> Bands:
    """Diagonal and two upper bands of Q'Q, where column j of Q holds (a_j, b_j, c_j) from row j on."""
    return a * a + b * b + c * c, b[:-1] * a[1:] + c[:-1] * b[1:], c[:-2] * a[2:]


def times(bands: Bands, x: np.ndarray) -> np.ndarray:
    """Symmetric matrix of ``bands`` times ``x``."""
    out = bands[0] * x
    for k in (1, 2):
        band = bands[k]
        if len(band):
            out[:-k] += band * x[k:]
            out[k:] += band * x[:-k]
    return out


def factor(bands: Bands) -> tuple[list[float], list[float], list[float]]:
    """LDL' of a positive definite matrix: D and the two lower bands of L, padded with zeros to its size."""
    d, e, f = (b.tolist() for b in bands)
    n = len(d)
    e, f = e + [0.0], f + [0.0, 0.0]
    one, two = [0.0] * n, [0.0] * n
    for i in range(n):
        if i > 1:
            d[i] -= d[i - 2] * two[i - 2] * two[i - 2]
        if i > 0:
            before = d[i - 1] * one[i - 1]
            d[i] -= before * one[i - 1]
            e[i] -= before * two[i - 1]
        d[i] = d[i] or 1e-300
        one[i], two[i] = e[i] / d[i], f[i] / d[i]
    return d, one, two


def solve(factors: tuple[list[float], list[float], list[float]], right: np.ndarray) -> np.ndarray:
    d, one, two = factors
    x = right.tolist()
    n = len(x)
    for i in range(n - 1):
        x[i + 1] -= one[i] * x[i]
        if i + 2 < n:
            x[i + 2] -= two[i] * x[i]
    ahead = further = 0.0
    for i in range(n - 1, -1, -1):
        x[i] = x[i] / d[i] - one[i] * ahead - two[i] * further
        ahead, further = x[i], ahead
    return np.array(x)


def inverse_bands(factors: tuple[list[float], list[float], list[float]]) -> Bands:
    """Diagonal and two upper bands of the inverse, from the last row back."""
    d, one, two = factors
    n = len(d)
    s0, s1, s2 = [0.0] * (n + 2), [0.0] * (n + 2), [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        s1[i] = -one[i] * s0[i + 1] - two[i] * s1[i + 1]
        s2[i] = -one[i] * s1[i + 1] - two[i] * s0[i + 2]
        s0[i] = 1 / d[i] - one[i] * s1[i] - two[i] * s2[i]
    return np.array(s0[:n]), np.array(s1[: n - 1]), np.array(s2[: max(n - 2, 0)])


def least_turning(y: np.ndarray, h: np.ndarray, weight: float, rounds: int = 80, tolerance: float = 1e-13) -> np.ndarray:
    """x with x_0 = y_0 that minimises |y - x|^2 / 2 + weight * (sum of the sizes of all changes of slope).

    An interior-point method on the dual, whose variables stay within +-weight: each round is one
    solve with five bands. It ends when the duality gap is below ``tolerance`` times |y|^2 / 2.
    """
    if weight <= 0 or len(y) < 3:
        return y.copy()
    unit = h.mean()
    a, b, c = second_differences(h / unit)
    weight = weight / unit
    rest = y - y[0]
    diagonal, near, far = gram(a, b, c)
    diagonal[0] -= a[0] * a[0]  # the first point is fixed
    turns = (diagonal, near, far)
    q = a * rest[:-2] + b * rest[1:-1] + c * rest[2:]
    m, size = len(q), float(rest @ rest) / 2
    z, up, down = np.zeros(m), np.full(m, 1.0), np.full(m, 1.0)
    high, low = np.full(m, weight), np.full(m, weight)  # distances to the bounds, kept apart as they get small
    best = (np.inf, z)
    for _ in range(rounds):
        sz = times(turns, z)
        left = q - sz
        gap = float(weight * np.abs(left).sum() - left @ z)
        if gap < best[0]:
            best = (gap, z)
        if not gap > tolerance * size:
            break
        centre = 0.1 * float(high @ up + low @ down) / (2 * m)
        system = (diagonal + up / high + down / low, near, far)
        dz = solve(factor(system), left - centre / high + centre / low)
        dup = centre / high - up + up / high * dz
        ddown = centre / low - down - down / low * dz
        step = 1.0
        for value, move in ((high, -dz), (low, dz), (up, dup), (down, ddown)):
            falling = move < 0
            if falling.any():
                step = min(step, 0.99 * float((-value[falling] / move[falling]).min()))
        z, up, down, high, low = z + step * dz, up + step * dup, down + step * ddown, high - step * dz, low + step * dz
    z = best[1]
    back = np.zeros(len(y))
    back[:-2] += a * z
    back[1:-1] += b * z
    back[2:] += c * z
    back[0] = 0.0
    return y - back


def order_balance(v: np.ndarray) -> int:
    """Pairs whose later value is larger, less pairs whose later value is smaller: merge counting, n log^2 n."""
    if len(v) <= 64:
        return int(np.sign(v[None, :] - v[:, None])[np.triu_indices(len(v), 1)].sum())
    half = len(v) // 2
    before, after = np.sort(v[:half]), v[half:]
    smaller, not_larger = np.searchsorted(before, after, "left"), np.searchsorted(before, after, "right")
    return int((smaller + not_larger - half).sum()) + order_balance(v[:half]) + order_balance(after)
