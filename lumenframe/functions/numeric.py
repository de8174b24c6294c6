"""Numerical kernels on numpy arrays, from textbook definitions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(np.asarray(x, dtype=float))


def normal_upper_quantile(p: float, mu: float = 0.0, sigma: float = 1.0) -> float:
    from statistics import NormalDist

    return mu + sigma * NormalDist().inv_cdf(1.0 - p)


def chi2_quantile(p: float, dof: int) -> float:
    """By bisection on the regularised incomplete gamma function."""
    lo, hi = 0.0, dof + 100.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if lower_gamma(dof / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its power series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    n = a
    while abs(term) > 1e-16 * abs(total):
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def least_squares(residuals: Callable[[np.ndarray], np.ndarray], start: np.ndarray, tolerance: float = 1e-8, rounds: int = 200) -> tuple[np.ndarray, np.ndarray | None]:
    """Levenberg-Marquardt with a forward-difference Jacobian: parameters and (J^T J)^-1."""
    p = np.asarray(start, dtype=float).copy()
    r = residuals(p)
    cost, damping, jtj = float(r @ r), 1e-3, None
    for _ in range(rounds):
        j = np.empty((len(r), len(p)))
        for i in range(len(p)):
            h = 1.5e-8 * max(1.0, abs(p[i]))
            q = p.copy()
            q[i] += h
            j[:, i] = (residuals(q) - r) / h
        jtj, g = j.T @ j, j.T @ r
        moved = False
        for _ in range(12):
            try:
                step = np.linalg.solve(jtj + damping * np.diag(np.maximum(np.diag(jtj), 1e-6 * np.diag(jtj).max() + 1e-300)), -g)
            except np.linalg.LinAlgError:
                damping *= 10
                continue
            new = residuals(p + step)
            new_cost = float(new @ new)
            if np.isfinite(new_cost) and new_cost <= cost:
                gain = cost - new_cost
                p, r, cost, damping, moved = p + step, new, new_cost, max(damping / 5, 1e-12), True
                break
            damping *= 5
        if not moved or gain <= tolerance * max(cost, 1e-300) or np.linalg.norm(step) <= tolerance * (np.linalg.norm(p) + tolerance):
            break
    try:
        return p, np.linalg.inv(jtj)
    except (np.linalg.LinAlgError, TypeError):
        return p, None


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, order: int = 3) -> np.ndarray:
    """Interpolating spline: not-a-knot cubic from four points on, else linear; ends extrapolate the last piece."""
    x, y, at = (np.asarray(v, dtype=float) for v in (x, y, at))
    n = len(x)
    if n == 0:
        return np.zeros_like(at)
    if n == 1:
        return np.full_like(at, y[0])
    if n < 4 or order == 1:
        return np.interp(at, x, y)
    h = np.diff(x)
    a = np.zeros((n, n))
    b = np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1], a[i, i], a[i, i + 1] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, hi = at - x[i], h[i]
    slope = (y[i + 1] - y[i]) / hi - hi * (2 * m[i] + m[i + 1]) / 6
    return y[i] + t * (slope + t * (m[i] / 2 + t * (m[i + 1] - m[i]) / (6 * hi)))


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The threshold that maximises the variance between two classes."""
    counts, edges = np.histogram(values, bins=bins)
    centres = (edges[:-1] + edges[1:]) / 2
    w0 = np.cumsum(counts)
    w1 = w0[-1] - w0
    s = np.cumsum(counts * centres)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w0 * w1 * (s / w0 - (s[-1] - s) / w1) ** 2
    return float(centres[int(np.nanargmax(between[:-1]))])


def li(values: np.ndarray, tolerance: float | None = None) -> float:
    """Minimum cross-entropy threshold, by its fixed-point iteration."""
    low = values.min()
    v = values - low
    tolerance = tolerance or max(np.min(np.diff(np.unique(v)), initial=1.0) / 2, 1e-9)
    t, old = float(v.mean()), -1.0
    for _ in range(1000):
        if abs(t - old) <= tolerance:
            break
        old = t
        above, below = v[v > t], v[v <= t]
        if not len(above) or below.mean() <= 0:
            break
        f, b = above.mean(), below.mean()
        t = float((b - f) / (np.log(b) - np.log(f)))
    return t + float(low)


def convolve_axis(image: np.ndarray, kernel: np.ndarray, axis: int, mode: str = "symmetric") -> np.ndarray:
    """Correlation along one axis; the border mirrors, repeats ("edge") or is 0 ("constant")."""
    half = len(kernel) // 2
    pad = [(0, 0)] * image.ndim
    pad[axis] = (half, len(kernel) - 1 - half)
    wide = np.pad(image.astype(float), pad, mode=mode)
    out = np.zeros(image.shape)
    for i, k in enumerate(kernel):
        cut = [slice(None)] * image.ndim
        cut[axis] = slice(i, i + image.shape[axis])
        out += k * wide[tuple(cut)]
    return out


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2) if sigma > 0 else np.ones(1)
    return k / k.sum()


def gaussian_filter(image: np.ndarray, sigma: float, mode: str = "symmetric") -> np.ndarray:
    k = gaussian_kernel(sigma)
    return convolve_axis(convolve_axis(image, k, -2, mode), k, -1, mode)


def uniform_filter(image: np.ndarray, size: int, mode: str = "symmetric") -> np.ndarray:
    k = np.full(size, 1.0 / size)
    return convolve_axis(convolve_axis(image, k, -2, mode), k, -1, mode)


def correlate(image: np.ndarray, kernel: np.ndarray, mode: str = "symmetric") -> np.ndarray:
    hy, hx = kernel.shape[0] // 2, kernel.shape[1] // 2
    wide = np.pad(image.astype(float), [(hy, kernel.shape[0] - 1 - hy), (hx, kernel.shape[1] - 1 - hx)], mode=mode)
    return np.einsum("ijkl,kl->ij", np.lib.stride_tricks.sliding_window_view(wide, kernel.shape), kernel)


def window_extreme(image: np.ndarray, size: int, largest: bool = True) -> np.ndarray:
    """Largest (or median) value of the square window around each pixel."""
    wide = np.pad(image.astype(float), [(size // 2, size - 1 - size // 2)] * 2, mode="symmetric")
    view = np.lib.stride_tricks.sliding_window_view(wide, (size, size))
    return view.max(axis=(2, 3)) if largest else np.median(view, axis=(2, 3))


def label_regions(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Connected regions of a mask, numbered from 1 in reading order."""
    labels = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    while True:
        old = labels.copy()
        for dy, dx in steps:
            a = (slice(0, mask.shape[0] - dy), slice(max(0, -dx), mask.shape[1] - max(0, dx)))
            b = (slice(dy, None), slice(max(0, dx), mask.shape[1] + min(0, dx)))
            both = mask[a] & mask[b]
            least = np.minimum(labels[a], labels[b])
            labels[a] = np.where(both, least, labels[a])
            labels[b] = np.where(both, np.minimum(least, labels[b]), labels[b])
        # pointer jumping: a label is a place in reading order
        flat = labels.ravel()
        inside = flat > 0
        flat[inside] = flat[flat[inside] - 1]
        labels = flat.reshape(mask.shape)
        if (labels == old).all():
            break
    used, out = np.unique(labels, return_inverse=True)
    out = out.reshape(mask.shape)
    return out if used[0] == 0 else out + 1


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Optimal assignment of rows to columns by shortest augmenting paths."""
    cost = np.asarray(cost, dtype=float)
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, back = np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        slack, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j] = True
            r = row_of[j]
            free = ~used
            free[0] = False
            d = c[r - 1] - u[r] - v[1:]
            closer = free[1:] & (d < slack[1:])
            slack[1:][closer] = d[closer]
            back[1:][closer] = j
            k = int(np.argmin(np.where(free, slack, np.inf)))
            delta = slack[k]
            u[row_of[used]] += delta
            v[used] -= delta
            slack[~used] -= delta
            j = k
            if row_of[j] == 0:
                break
        while j:
            row_of[j] = row_of[back[j]]
            j = back[j]
    cols = np.flatnonzero(row_of[1:])
    rows = row_of[1:][cols] - 1
    order = np.argsort(rows)
    rows, cols = rows[order], cols[order]
    return (np.sort(cols), rows[np.argsort(cols)]) if flip else (rows, cols)


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Unbiased autocorrelation of a series by FFT."""
    n = len(x)
    f = np.fft.fft(x, n=2 * n)
    return np.fft.ifft(f * f.conjugate())[:n].real / (n - np.arange(n))


def msd_fft(r: np.ndarray) -> np.ndarray:
    """Mean square displacement at all lags of positions (n, dims)."""
    n = len(r)
    square = np.append((r * r).sum(axis=1), 0.0)
    cross = sum(autocorrelation(r[:, i]) for i in range(r.shape[1]))
    total, out = 2 * square[:n].sum(), np.empty(n)
    for m in range(n):
        total -= (square[m - 1] if m else 0.0) + (square[n - m] if m else 0.0)
        out[m] = total / (n - m)
    return out - 2 * cross


def pelt(signal: np.ndarray, cost: Callable[[int, int], float], penalty: float, least: int = 1) -> list[int]:
    """Optimal segmentation with pruning; change points end with the length."""
    n = len(signal)
    best, last, open_ = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), [0]
    best[0] = -penalty
    for t in range(least, n + 1):
        tries = [(best[s] + cost(s, t) + penalty, s) for s in open_ if t - s >= least]
        if tries:
            best[t], last[t] = min(tries)
        open_ = [s for s in open_ if t - s < least or best[s] + cost(s, t) <= best[t]] + [t - least + 1] * (t - least + 1 > 0)
    out, t = [], n
    while t > 0:
        out.append(t)
        t = int(last[t])
    return sorted(set(out)) if n else [0]


def poisson_cost(signal: np.ndarray) -> Callable[[int, int], float]:
    """-S ln(S / n) of a segment, 0 if it has no counts."""
    run = np.concatenate([[0.0], np.cumsum(signal)])

    def cost(a: int, b: int) -> float:
        s = run[b] - run[a]
        return 0.0 if s <= 0 else float(-s * math.log(s / (b - a)))

    return cost


def l2_cost(signal: np.ndarray) -> Callable[[int, int], float]:
    run, square = (np.concatenate([[0.0], np.cumsum(x)]) for x in (signal, np.asarray(signal, dtype=float) ** 2))
    return lambda a, b: float(square[b] - square[a] - (run[b] - run[a]) ** 2 / (b - a))


def kmeans(x: np.ndarray, k: int, starts: int = 10, seed: int = 42, rounds: int = 100) -> np.ndarray:
    """Centres of the best of several seeded starts."""
    rng, best, found = np.random.default_rng(seed), np.inf, None
    for _ in range(starts):
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            near = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        cost = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum()
        if cost < best:
            best, found = cost, centres
    return found


def bisect(f: Callable[[float], float], lo: float, hi: float, rounds: int = 200) -> float:
    """A root between two points of different sign."""
    a = f(lo)
    for _ in range(rounds):
        mid = (lo + hi) / 2
        b = f(mid)
        if (a < 0) == (b < 0):
            lo, a = mid, b
        else:
            hi = mid
    return (lo + hi) / 2
