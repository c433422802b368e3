"""One-dimensional signals: resampling, centring, gap filling, baseline removal, smoothing.

The JVM expressions work on arrays; the numpy functions take and give one array and are meant for array UDFs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLES = 1250
#: Image widths to millimetres of paper.
PAPER_MM = 29.7


def resample(c: str | Column, n: int = SAMPLES) -> Column:
    """Linear interpolation at n even points, the ends kept; an array of one value gives it n times, an empty one null."""
    a = F.col(c) if isinstance(c, str) else c
    a = a.cast("array<double>")
    m = F.size(a)

    def at(i: Column) -> Column:
        pos = i * (m - 1) / F.lit(float(max(n - 1, 1)))
        lo = F.least(F.floor(pos).cast("int"), m - 1)
        hi = F.least(lo + 1, m - 1)
        return F.get(a, lo) + (pos - lo) * (F.get(a, hi) - F.get(a, lo))

    return F.when(m > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def median(c: Column) -> Column:
    """The exact median of an array, of the two middle values their mean."""
    s, n = F.array_sort(c), F.size(c)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def to_millivolts(c: str | Column, width: Column) -> Column:
    """Centred on the median, divided by pixels per millivolt; fewer than 5 samples give zeros."""
    a = F.col(c) if isinstance(c, str) else c
    a = F.transform(a.cast("array<double>"), lambda x: F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0)))
    mid, scale = median(a), width / F.lit(PAPER_MM)
    return F.when(F.size(a) < 5, F.transform(a, lambda x: F.lit(0.0))).otherwise(F.transform(a, lambda x: (x - mid) / scale))


def lead_name(c: str | Column) -> Column:
    return F.regexp_replace(F.upper(F.col(c) if isinstance(c, str) else c), "LEAD_", "")


def pchip_fill(y: np.ndarray) -> np.ndarray:
    """NaN within the valid stretch by monotone cubic interpolation, outside it 0."""
    y = np.asarray(y, float)
    x = np.flatnonzero(np.isfinite(y))
    out = np.where(np.isfinite(y), y, 0.0)
    if len(x) < 2:
        return out
    v, h = y[x], np.diff(x).astype(float)
    d = np.diff(v) / h
    m = np.zeros(len(x))
    if len(x) == 2:
        m[:] = d[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = d[:-1] * d[1:] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)
        for end, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
            s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            if s * d0 <= 0:
                s = 0.0
            elif d0 * d1 < 0 and abs(s) > 3 * abs(d0):
                s = 3 * d0
            m[end] = s
    gaps = np.flatnonzero(~np.isfinite(y))
    gaps = gaps[(gaps > x[0]) & (gaps < x[-1])]
    k = np.searchsorted(x, gaps) - 1
    t, hk = (gaps - x[k]) / h[k], h[k]
    out[gaps] = (2 * t**3 - 3 * t**2 + 1) * v[k] + (t**3 - 2 * t**2 + t) * hk * m[k] + (3 * t**2 - 2 * t**3) * v[k + 1] + (t**3 - t**2) * hk * m[k + 1]
    return out


def _penta_solve(diag: np.ndarray, off1: np.ndarray, off2: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Symmetric positive pentadiagonal systems by LDL', many at once: diag and rhs (n, systems), the off diagonals (n,)."""
    n = len(diag)
    d, l1, l2, z = (np.zeros_like(rhs) for _ in range(4))
    for i in range(n):
        d[i], z[i] = diag[i], rhs[i]
        if i > 1:
            l2[i] = off2[i - 2] / d[i - 2]
            d[i] -= l2[i] ** 2 * d[i - 2]
            z[i] -= l2[i] * z[i - 2]
        if i:
            l1[i] = (off1[i - 1] - (l2[i] * d[i - 2] * l1[i - 1] if i > 1 else 0.0)) / d[i - 1]
            d[i] -= l1[i] ** 2 * d[i - 1]
            z[i] -= l1[i] * z[i - 1]
    z /= d
    for i in range(n - 2, -1, -1):
        z[i] -= l1[i + 1] * z[i + 1]
        if i + 2 < n:
            z[i] -= l2[i + 2] * z[i + 2]
    return z


def als_baseline(y: np.ndarray, lam: float = 1e5, p: float = 0.01, rounds: int = 10) -> np.ndarray:
    """Asymmetric least squares baseline of a signal, or of many as rows of a matrix: weight p above, 1 - p below, 0 where equal."""
    y = np.asarray(y, float)
    n = y.shape[-1]
    if n < 3:
        return np.zeros_like(y)
    d2 = np.zeros((3, n))
    for k, c in enumerate((1.0, -2.0, 1.0)):
        for j, e in enumerate((1.0, -2.0, 1.0)):
            if j >= k:
                d2[j - k, k : n - 2 + k] += c * e
    t = np.ascontiguousarray(np.atleast_2d(y).T)  # samples first, so that a step takes all signals
    w, z = np.ones_like(t), t
    for _ in range(rounds):
        z = _penta_solve(w + lam * d2[0][:, None], lam * d2[1], lam * d2[2], w * t)
        w = p * (t > z) + (1 - p) * (t < z)
    return z.T.reshape(y.shape)


def by_length(signals: list[np.ndarray], function) -> list[np.ndarray]:
    """function (matrix to matrix, a signal a row) applied to the signals of each length at once."""
    length, out = np.array([len(x) for x in signals], int), [np.empty(0)] * len(signals)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        for i, row in zip(at, function(np.stack([signals[i] for i in at])), strict=True):
            out[i] = row
    return out


def savgol(y: np.ndarray, window: int = 7, order: int = 3) -> np.ndarray:
    """Least-squares polynomial smoothing; the ends take the fit of the first and last window."""
    y = np.asarray(y, float)
    n = len(y)
    window = min(window, n if n % 2 else n - 1)
    if window <= order:
        return y.copy()
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    fit = np.linalg.pinv(basis)
    out = np.convolve(y, fit[0][::-1], "same")
    out[:half] = (basis @ (fit @ y[:window]))[:half]
    out[-half:] = (basis @ (fit @ y[-window:]))[-half:]
    return out
