"""Numerical kernels in NumPy: special functions, a simplex search, extreme-value fits."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def norm_cdf(x):
    return 0.5 * np.vectorize(math.erfc)(-np.asarray(x, float) / math.sqrt(2))


def norm_ppf(p):
    """Inverse normal distribution, by Newton steps on a logistic first guess."""
    p = np.asarray(p, float)
    x = np.clip(np.log(p / (1 - p)) * 0.6, -8, 8)
    for _ in range(60):
        x = x - np.clip((norm_cdf(x) - p) / (np.exp(-x * x / 2) / math.sqrt(2 * math.pi)), -1, 1)
    return x


def bivariate_norm_cdf(a: float, b: float, rho: float, points: int = 64) -> float:
    """P(X <= a, Y <= b): the integral of the density over the correlation from 0."""
    t, w = np.polynomial.legendre.leggauss(points)
    s = np.sin((t + 1) / 2 * math.asin(rho))
    f = np.exp(-(a * a - 2 * s * a * b + b * b) / (2 * (1 - s * s)))
    return float(norm_cdf(a) * norm_cdf(b) + math.asin(rho) / (4 * math.pi) * (w * f).sum())


def poisson_ppf(q: float, mean: float) -> int:
    k, p = 0, math.exp(-mean)
    total = p
    while total < q and k < 10_000:
        k += 1
        p *= mean / k
        total += p
    return k


def bivariate_norm_cdf_many(a: float, b: float, rho: np.ndarray, points: int = 64) -> np.ndarray:
    """``bivariate_norm_cdf`` for many correlations, with the nodes as a second axis."""
    t, w = np.polynomial.legendre.leggauss(points)
    s = np.sin((t + 1) / 2 * np.arcsin(rho)[:, None])
    f = np.exp(-(a * a - 2 * s * a * b + b * b) / (2 * (1 - s * s)))
    return norm_cdf(a) * norm_cdf(b) + np.arcsin(rho) / (4 * math.pi) * (f @ w)


def poisson_ppf_many(q: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The least number whose distribution function reaches ``q``, for every mean."""
    k, term = np.zeros(len(q), np.int64), np.exp(-mean)
    total = term.copy()
    for _ in range(100_000):
        low = total < q
        if not low.any():
            break
        k[low] += 1
        term[low] *= mean[low] / k[low]
        total[low] += term[low]
    return k


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or 1e-300)
        c = 1 + n / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def student_p(t: float, df: float) -> float:
    """Two-sided p-value."""
    return betainc(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def nelder_mead(f: Callable[[np.ndarray], float], x0, steps: int = 2000, tol: float = 1e-9) -> tuple[np.ndarray, float, bool]:
    """Simplex search: the point, its value, and whether it settled."""
    x0 = np.asarray(x0, float)
    n = len(x0)
    s = [x0] + [x0 + np.eye(n)[i] * (0.1 * abs(x0[i]) or 0.05) for i in range(n)]
    v = [f(x) for x in s]
    for _ in range(steps):
        o = np.argsort(v, kind="stable")
        s, v = [s[i] for i in o], [v[i] for i in o]
        if abs(v[-1] - v[0]) <= tol * (1 + abs(v[0])) and max(np.abs(x - s[0]).max() for x in s) < 1e-6:
            return s[0], v[0], True
        c = np.mean(s[:-1], 0)
        r = 2 * c - s[-1]
        fr = f(r)
        if fr < v[0]:
            e = 3 * c - 2 * s[-1]
            fe = f(e)
            s[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            s[-1], v[-1] = r, fr
        else:
            k = (c + r) / 2 if fr < v[-1] else (c + s[-1]) / 2
            fk = f(k)
            if fk < min(fr, v[-1]):
                s[-1], v[-1] = k, fk
            else:
                s = [s[0]] + [(x + s[0]) / 2 for x in s[1:]]
                v = [v[0]] + [f(x) for x in s[1:]]
    return s[int(np.argmin(v))], min(v), False


def hessian(f: Callable[[np.ndarray], float], x: np.ndarray) -> np.ndarray:
    n = len(x)
    h = 1e-4 * np.maximum(np.abs(x), 0.1)
    e = np.diag(h)
    return np.array([[(f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])) / (4 * h[i] * h[j]) for j in range(n)] for i in range(n)])


def gpd_nll(y: np.ndarray, sigma, xi: float) -> float:
    """Negative log likelihood of excesses under a generalised Pareto law."""
    sigma = np.broadcast_to(np.asarray(sigma, float), y.shape)
    if (sigma <= 0).any():
        return 1e12
    z = y / sigma
    if abs(xi) < 1e-7:
        return float((np.log(sigma) + z).sum())
    w = 1 + xi * z
    return 1e12 if (w <= 0).any() else float((np.log(sigma) + (1 + 1 / xi) * np.log(w)).sum())


def fit_gpd(y) -> dict:
    """Maximum likelihood with standard errors from the observed information."""
    y = np.asarray(y, float)
    if len(y) < 5 or y.std() == 0:
        return {"xi": None, "sigma": None, "se_xi": None, "se_sigma": None, "nll": None, "converged": False}
    f = lambda p: gpd_nll(y, math.exp(p[0]), p[1])
    p, v, ok = min((nelder_mead(f, [math.log(y.mean()), s]) for s in (-0.2, 0.1)), key=lambda r: r[1])
    try:
        c = np.linalg.inv(hessian(f, p))
        se = np.sqrt(np.diag(c))
    except np.linalg.LinAlgError:
        se = np.array([np.nan, np.nan])
    sigma = math.exp(p[0])
    good = bool(ok and np.isfinite(se).all())
    return {"xi": float(p[1]), "sigma": sigma, "se_xi": float(se[1]) if good else None, "se_sigma": float(se[0] * sigma) if good else None, "nll": float(v), "converged": good}


def fit_gpd_scale(y, x) -> dict:
    """A generalised Pareto law whose log scale is linear in the columns of ``x``."""
    y, x = np.asarray(y, float), np.column_stack([np.ones(len(y)), np.asarray(x, float)])
    f = lambda p: gpd_nll(y, np.exp(np.clip(x @ p[:-1], -30, 30)), p[-1])
    p, v, ok = nelder_mead(f, [math.log(max(y.mean(), 1e-9)), *[0.0] * (x.shape[1] - 1), 0.05], 4000)
    return {"beta": p[:-1].tolist(), "xi": float(p[-1]), "nll": float(v), "converged": bool(ok)}


def return_level(u: float, sigma: float, xi: float, rate: float, years: float) -> float:
    n = max(rate * years, 1e-12)
    return u + sigma * (math.log(n) if abs(xi) < 1e-6 else (n**xi - 1) / xi)


def ferro_segers(gaps) -> float:
    """Extremal index by the intervals estimator."""
    t = np.asarray(gaps, float)
    if len(t) < 4 or t.sum() == 0:
        return 1.0
    if t.max() <= 2:
        num, den = 2 * t.sum() ** 2, len(t) * (t * t).sum()
    else:
        num, den = 2 * (t - 1).sum() ** 2, len(t) * ((t - 1) * (t - 2)).sum()
    return float(np.clip(num / den, 0, 1)) if den > 0 else 1.0


def decluster(times, sizes, run: float) -> np.ndarray:
    """Indices of the largest member (the first on ties) of each run of gaps up to ``run``."""
    if not len(times):
        return np.zeros(0, int)
    cluster = np.concatenate(([0], np.cumsum(np.diff(times) > run)))
    order = np.lexsort((np.arange(len(times)), -np.asarray(sizes), cluster))
    first = np.concatenate(([True], np.diff(cluster[order]) > 0))
    return np.sort(order[first])


def swinging_doors(v: np.ndarray, first: np.ndarray, eps: float, few: int = 16) -> np.ndarray:
    """Marks the break points of many runs, which begin at ``first`` (and the end), in ``v``.

    All runs take a step at once, the longest first, until only a ``few`` are left; those
    go on one by one.
    """
    out = np.zeros(len(v), bool)
    start, size = first[:-1], np.diff(first)
    out[start[size > 0]] = True
    out[(first[1:] - 1)[size > 0]] = True
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    longest = int(size.max(initial=0))
    live = np.searchsorted(-size, -np.arange(longest), "left")  # runs of more than k samples
    pivot, low, high = start.copy(), np.full(len(start), -np.inf), np.full(len(start), np.inf)
    k = 1
    while k < longest and live[k] >= few:
        m = live[k]
        at, p = start[:m] + k, pivot[:m]
        a = np.maximum(low[:m], (v[at] - eps - v[p]) / (at - p))
        b = np.minimum(high[:m], (v[at] + eps - v[p]) / (at - p))
        shut = np.flatnonzero(b < a)
        if len(shut):
            now = at[shut]
            out[now - 1] = True
            p[shut] = now - 1
            a[shut], b[shut] = v[now] - eps - v[now - 1], v[now] + eps - v[now - 1]
        low[:m], high[:m] = a, b
        k += 1
    for r in range(live[k] if k < longest else 0):
        p, a, b = int(pivot[r]), float(low[r]), float(high[r])
        for at in range(int(start[r]) + k, int(start[r] + size[r])):
            a, b = max(a, (v[at] - eps - v[p]) / (at - p)), min(b, (v[at] + eps - v[p]) / (at - p))
            if b < a:
                p = at - 1
                out[p] = True
                a, b = v[at] - eps - v[p], v[at] + eps - v[p]
    return out


def swinging_door(v, eps: float) -> list[int]:
    """Break points, the ends included, of a piecewise linear line within ``eps`` of the samples."""
    v = np.asarray(v, float)
    if len(v) < 2:
        return list(range(len(v)))
    out, pivot, low, high = [0], 0, -math.inf, math.inf
    for k in range(1, len(v)):
        span = k - pivot
        low, high = max(low, (v[k] - eps - v[pivot]) / span), min(high, (v[k] + eps - v[pivot]) / span)
        if high < low:
            pivot = k - 1
            out.append(pivot)
            low, high = v[k] - eps - v[pivot], v[k] + eps - v[pivot]
    out.append(len(v) - 1)
    return out


def fit_decay(d, y, form: str) -> tuple[float, float, float]:
    """Least squares of ``a exp(-d/L)`` or ``a (1+d)^-L``: (a, L, squared error)."""
    d, y = np.asarray(d, float), np.asarray(y, float)
    g = (lambda p: p[0] * np.exp(-d / max(abs(p[1]), 1e-6))) if form == "exp" else (lambda p: p[0] * (1 + d) ** -p[1])
    p, v, _ = nelder_mead(lambda p: float(((y - g(p)) ** 2).sum()), [max(y.max(initial=0), 1e-3), 1.0 if form == "pow" else max(np.median(d), 0.1)])
    return float(p[0]), float(abs(p[1])), float(v)


def heffernan_tawn_nll(p, x, y, d, form: str) -> float:
    """y = alpha(d) x + x^beta (mu + sigma z) with normal z."""
    a0, scale, beta, mu, log_s = p
    if not -1 <= a0 <= 1 or scale <= 0 or not -2 < beta < 1 or abs(log_s) > 20:
        return 1e12
    alpha = a0 * (np.exp(-d / scale) if form == "exp" else (1 + d) ** -scale)
    xb = x**beta
    s = xb * math.exp(log_s)
    return float((np.log(s) + 0.5 * ((y - alpha * x - xb * mu) / s) ** 2).sum())


def fit_heffernan_tawn(x, y, d, form: str) -> dict:
    x, y, d = (np.asarray(v, float) for v in (x, y, d))
    p, v, ok = nelder_mead(lambda p: heffernan_tawn_nll(p, x, y, d, form), [0.3, 2.0, 0.1, 0.0, 0.0], 6000)
    return {"alpha0": float(p[0]), "decay": float(p[1]), "beta": float(p[2]), "mu": float(p[3]), "sigma": math.exp(p[4]), "nll": float(v), "aic": 2 * 5 + 2 * float(v), "converged": bool(ok)}
