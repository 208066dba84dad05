"""Distribution functions for the few scalars that tests end in, and small-sample statistics; numpy only."""

from __future__ import annotations

import math

import numpy as np


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + n * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + n / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def f_upper(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def _inversions(v: np.ndarray) -> tuple[np.ndarray, int]:
    """(sorted values, pairs in falling order)."""
    if len(v) <= 32:
        return np.sort(v), int((v[:, None] > v[None])[np.triu_indices(len(v), 1)].sum())
    a, m = _inversions(v[:len(v) // 2])
    b, n = _inversions(v[len(v) // 2:])
    across = int((len(a) - np.searchsorted(a, b, "right")).sum())
    return np.sort(np.concatenate([a, b]), kind="stable"), m + n + across


def kendall(x, y) -> float:
    """Kendall's tau-b of two series, by merging; no spread gives 0."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    pairs = lambda c: int((c.astype(np.int64) * (c - 1) // 2).sum())
    tied = lambda *v: pairs(np.unique(np.stack(v), axis=1, return_counts=True)[1]) if len(x) else 0
    order = np.lexsort((y, x))
    discordant, every = _inversions(y[order])[1], len(x) * (len(x) - 1) // 2
    tx, ty, both = tied(x), tied(y), tied(x, y)
    den = math.sqrt((every - tx) * (every - ty))
    return (every - tx - ty + both - 2 * discordant) / den if den else 0.0


def fit_curve(f, x, y, start, low=None, high=None, rounds: int = 200, counts=None, within: float = 0.0):
    """Bounded Levenberg-Marquardt least squares: (parameters, standard errors, r squared, rmse); numeric derivatives.

    With ``counts``, each y is the mean of so many rows and ``within`` the sum
    of squares of all rows around these means; the result is that of the rows.
    """
    x, y, p = np.asarray(x, float), np.asarray(y, float), np.asarray(start, float)
    w = np.ones(len(x)) if counts is None else np.asarray(counts, float)
    n, root = w.sum(), np.sqrt(w)
    low = np.full(len(p), -np.inf) if low is None else np.asarray(low, float)
    high = np.full(len(p), np.inf) if high is None else np.asarray(high, float)
    p, damp = np.clip(p, low, high), 1e-3
    with np.errstate(all="ignore"):
        r = root * np.nan_to_num(y - f(x, *p), nan=1e9, posinf=1e9, neginf=-1e9)

        def slopes(p):
            out = np.empty((len(x), len(p)))
            for k in range(len(p)):
                h = 1e-6 * max(1.0, abs(p[k]))
                q = p.copy()
                q[k] = q[k] + h if q[k] + h <= high[k] else q[k] - h
                out[:, k] = (f(x, *q) - f(x, *p)) / (q[k] - p[k])
            return root[:, None] * np.nan_to_num(out)

        for _ in range(rounds):
            j = slopes(p)
            a, g = j.T @ j, j.T @ r
            step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0]
            q = np.clip(p + step, low, high)
            rq = root * np.nan_to_num(y - f(x, *q), nan=1e9, posinf=1e9, neginf=-1e9)
            if rq @ rq < r @ r:
                done = r @ r - rq @ rq < 1e-14 * (1 + r @ r)
                p, r, damp = q, rq, max(damp / 5, 1e-12)
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
        j = slopes(p)
    dof, left = max(1, n - len(p)), r @ r + within
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(j.T @ j)) * left / dof, 0))
    total = (w * (y - (w @ y) / n) ** 2).sum() + within
    return p, errors, float(1 - left / total) if total > 0 else 0.0, float(np.sqrt(left / n))
