"""Distribution functions for small tables of test statistics.

Plain Python on scalars: they finish statistics that Spark has already
aggregated, one call per result row, never per input row.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
_TINY = 1e-300


def _bad(*xs) -> bool:
    return any(x is None or x != x for x in xs)


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_reg(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    total = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + num / c
            c = c if abs(c) > _TINY else _TINY
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return min(1.0, front * total)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - scale * total)
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 100_000):
        num = -i * (i - a)
        b += 2.0
        d = num * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + num / c
        c = c if abs(c) > _TINY else _TINY
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return min(1.0, scale * h)


def t_sf(t: float, df: float) -> float:
    if _bad(t, df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    tail = 0.5 * beta_reg(df / 2.0, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1.0 - tail


def t_p(t: float, df: float, alternative: str = "two-sided") -> float:
    if _bad(t, df) or df <= 0:
        return float("nan")
    if alternative == "less":
        return 1.0 - t_sf(t, df)
    if alternative == "greater":
        return t_sf(t, df)
    return min(1.0, 2.0 * t_sf(abs(t), df))


def z_p(z: float, alternative: str = "two-sided") -> float:
    if _bad(z):
        return float("nan")
    if alternative == "less":
        return norm_cdf(z)
    if alternative == "greater":
        return norm_sf(z)
    return min(1.0, 2.0 * norm_sf(abs(z)))


def f_sf(f: float, d1: float, d2: float) -> float:
    if _bad(f, d1, d2) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return beta_reg(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    if _bad(x, df) or df <= 0:
        return float("nan")
    return gamma_upper(df / 2.0, x / 2.0)


def _bisect(fn, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if fn(mid) > 0:
            hi = mid
        else:
            lo = mid
        if hi - lo <= 1e-14 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)


def t_ppf(p: float, df: float) -> float:
    if _bad(p, df) or df <= 0:
        return float("nan")
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    hi = 2.0
    while t_sf(hi, df) > 1.0 - p and hi < 1e12:
        hi *= 2.0
    return _bisect(lambda x: (1.0 - p) - t_sf(x, df), 0.0, hi)


_erf = np.frompyfunc(math.erf, 1, 1)


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + _erf(x / math.sqrt(2.0)).astype(float))


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """Upper tail of the studentized range, by two nested Gauss rules."""
    if _bad(q, k, df) or k < 2 or df <= 0:
        return float("nan")
    if q <= 0:
        return 1.0
    zx, zw = np.polynomial.legendre.leggauss(96)
    z, zw = 8.0 * zx, 8.0 * zw
    pdf, cdf = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi), _phi(z)

    def range_cdf(w: np.ndarray) -> np.ndarray:
        inner = np.clip(cdf[None, :] - _phi(z[None, :] - w[:, None]), 0.0, 1.0)
        return k * (inner ** (k - 1) * (pdf * zw)[None, :]).sum(axis=1)

    if df > 20_000:
        return float(min(1.0, max(0.0, 1.0 - range_cdf(np.array([q]))[0])))
    spread = 8.0 / math.sqrt(2.0 * df)
    lo, hi = max(1e-8, 1.0 - spread), 1.0 + spread + (3.0 if df < 4 else 0.0)
    sx, sw = np.polynomial.legendre.leggauss(80)
    s = 0.5 * (hi - lo) * sx + 0.5 * (hi + lo)
    sw = 0.5 * (hi - lo) * sw
    log_norm = (df / 2.0) * math.log(df) - math.lgamma(df / 2.0) - (df / 2.0 - 1.0) * math.log(2.0)
    dens = np.exp(log_norm + (df - 1.0) * np.log(s) - df * s * s / 2.0)
    cdf_q = float((range_cdf(q * s) * dens * sw).sum() / (dens * sw).sum())
    return min(1.0, max(0.0, 1.0 - cdf_q))


def kolmogorov_p(d: float, n: int) -> float:
    """Two-sided p of the one-sample KS distance: exact below 140 rows, from there on the limit law with Stephens' shift."""
    if _bad(d, n) or n <= 0:
        return float("nan")
    if n < 140:
        return 1.0 - kolmogorov_cdf(d, int(n))
    root = math.sqrt(n)
    x = d * root + 1.0 / (6.0 * root)
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (j - 1) * math.exp(-2.0 * j * j * x * x) for j in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


def kolmogorov_cdf(d: float, n: int) -> float:
    """P(D_n < d), exactly: n! / n^n times the middle of the n-th power of a matrix (Marsaglia, Tsang and Wang 2003)."""
    if d <= 0.5 / n:
        return 0.0
    if d >= 1:
        return 1.0
    k = int(n * d) + 1
    h, m = k - n * d, 2 * k - 1
    gap = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    a = (gap >= 0).astype(float)
    edge = h ** np.arange(1, m + 1)
    a[:, 0] -= edge
    a[-1, :] -= edge[::-1]
    a[-1, 0] += max(0.0, 2 * h - 1) ** m
    a *= np.array([math.exp(-math.lgamma(max(0, g) + 1)) for g in range(-m + 2, m + 2)])[gap + m - 2]
    power, shift, base, base_shift, left = np.eye(m), 0, a, 0, n
    while left:                                       # powers with a common factor 10^shift taken out
        if left & 1:
            power, shift = power @ base, shift + base_shift
        base, base_shift, left = base @ base, 2 * base_shift, left >> 1
        for matrix in (power, base):
            if matrix[k - 1, k - 1] > 1e140:
                matrix *= 1e-140
                if matrix is power:
                    shift += 140
                else:
                    base_shift += 140
    out = math.log(power[k - 1, k - 1]) + shift * math.log(10) + math.lgamma(n + 1) - n * math.log(n)
    return min(1.0, max(0.0, math.exp(out)))


# Royston's polynomials (1995) in 1 / sqrt(n) for the two outer coefficients, in n or log n for the law of log(1 - W).
SW_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SW_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SW_BOUND = (-2.273, 0.459)
SW_MEAN_SMALL, SW_SD_SMALL = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
SW_MEAN, SW_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def shapiro_wilk(values) -> tuple[float, float]:
    """W and p of 3 to 5,000 values; missing for fewer, more or constant ones."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not 3 <= n <= 5000 or not np.isfinite(x).all() or x[0] == x[-1]:
        return float("nan"), float("nan")
    poly = lambda c, at: sum(v * at ** i for i, v in enumerate(c))
    m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    square, root = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(square)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        outer = [a[-1] + poly(SW_LAST, root)] + ([a[-2] + poly(SW_NEXT, root)] if n > 5 else [])
        k = len(outer)
        inner = math.sqrt((square - 2 * (m[-k:] ** 2).sum()) / (1 - 2 * sum(v * v for v in outer)))
        a = m / inner
        for j, v in enumerate(outer):
            a[j], a[-1 - j] = -v, v
    centred = x - x.mean()
    w = min(1.0, float(a @ x) ** 2 / float(centred @ centred))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1:
        return w, 1.0
    y = math.log1p(-w)
    if n <= 11:
        bound = poly(SW_BOUND, n)
        if y >= bound:
            return w, 0.0
        return w, norm_sf((-math.log(bound - y) - poly(SW_MEAN_SMALL, n)) / math.exp(poly(SW_SD_SMALL, n)))
    return w, norm_sf((y - poly(SW_MEAN, math.log(n))) / math.exp(poly(SW_SD, math.log(n))))


def most_likely_rank(values, n: int) -> int:
    """Number of principal components with the largest evidence, from all eigenvalues of the covariance and the rows (Minka 2000)."""
    values = np.sort(np.asarray(values, float))[::-1]
    p = len(values)
    tiny = np.finfo(float).eps

    def evidence(k: int) -> float:
        if values[k - 1] <= tiny * values[0]:
            return -math.inf
        noise = max(tiny * values[0], float(values[k:].mean()))
        prior = -k * math.log(2) + sum(math.lgamma((p - i) / 2) - (p - i) / 2 * math.log(math.pi) for i in range(k))
        free = p * k - k * (k + 1) / 2
        kept = np.r_[values[:k], np.full(p - k, noise)]
        volume = 0.0
        for i in range(k):
            apart = (1 / kept[i + 1:] - 1 / kept[i]) * (values[i] - values[i + 1:])
            if (apart <= 0).any():
                return -math.inf
            volume += np.log(apart).sum() + math.log(n) * len(apart)
        return (prior - n / 2 * np.log(values[:k]).sum() - n * (p - k) / 2 * math.log(noise) + (free + k) / 2 * math.log(2 * math.pi)
                - volume / 2 - k / 2 * math.log(n))

    return max(range(1, p), key=lambda k: (evidence(k), -k)) if p > 1 else 1


def k2_normality(n, g1, g2) -> tuple[float, float]:
    """D'Agostino-Pearson K² and p from n, population skewness and excess kurtosis."""
    if _bad(n, g1, g2) or n < 8:
        return float("nan"), float("nan")
    n = float(n)
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta2 - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / math.sqrt(var)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(
        6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / (s * s)))
    denom = 1 + x * math.sqrt(2 / (a - 4))
    term = math.copysign(abs((1 - 2 / a) / denom) ** (1 / 3), denom) if denom else 0.0
    z2 = (1 - 2 / (9 * a) - term) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, math.exp(-k2 / 2)


# MacKinnon response surfaces, regression with constant, one series.
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_SWITCH, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.04),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def adf_p(tau: float) -> float:
    if _bad(tau):
        return float("nan")
    if tau < ADF_MIN:
        return 0.0
    if tau > ADF_MAX:
        return 1.0
    coef = ADF_SMALL_P if tau <= ADF_SWITCH else ADF_LARGE_P
    return norm_cdf(sum(c * tau**i for i, c in enumerate(coef)))


def adf_critical(n: int) -> dict[str, float]:
    return {k: sum(c / n**i for i, c in enumerate(v)) for k, v in ADF_CRITICAL.items()}


def fisher_2x2(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p: all tables at most as likely as the seen one."""
    r1, c1, n = a + b, a + c, a + b + c + d

    def log_p(x: int) -> float:
        return sum(math.lgamma(v + 1) for v in (r1, n - r1, c1, n - c1)) - sum(
            math.lgamma(v + 1) for v in (n, x, r1 - x, c1 - x, n - r1 - c1 + x))

    seen = log_p(a)
    lo, hi = max(0, r1 + c1 - n), min(r1, c1)
    return min(1.0, sum(math.exp(p) for p in map(log_p, range(lo, hi + 1)) if p <= seen + 1e-7))


def u_exact_sf(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, by counting subsets of the rank sum."""
    ways = {(0, 0): 1}
    for rank in range(1, n1 + n2 + 1):
        for (k, total), w in list(ways.items()):
            if k < n1:
                key = (k + 1, total + rank)
                ways[key] = ways.get(key, 0) + w
    base = n1 * (n1 + 1) // 2
    sums = {t - base: w for (k, t), w in ways.items() if k == n1}
    return sum(w for t, w in sums.items() if t >= u) / sum(sums.values())


def wilcoxon_exact_cdf(w: float, n: int) -> float:
    """P(W <= w) without ties or zeros."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r]
    return float(ways[: int(math.floor(w)) + 1].sum() / 2.0**n)
