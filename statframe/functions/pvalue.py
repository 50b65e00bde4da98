"""Vectorised p-value columns for result tables.

Each column runs one ``dist`` function over the rows of an aggregated table
(one row per test), never over the raw data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from statframe.functions import dist


def _column(fn, *cols) -> Column:
    def apply(*series: pd.Series) -> pd.Series:
        out = []
        for args in zip(*series):
            if any(a is None or a != a for a in args):
                out.append(None)
                continue
            p = fn(*args)
            out.append(None if p != p else p)
        return pd.Series(out, dtype="float64")

    if len(cols) == 1:
        def run(a: pd.Series) -> pd.Series:
            return apply(a)
    elif len(cols) == 2:
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return apply(a, b)
    elif len(cols) == 3:
        def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return apply(a, b, c)
    else:
        def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            return apply(a, b, c, d)
    return F.nanvl(F.pandas_udf(run, "double")(*cols), F.lit(None).cast("double"))


def t_p(t, df, alternative: str = "two-sided") -> Column:
    return _column(lambda a, b: dist.t_p(a, b, alternative), t, df)


def t_quantile(p, df) -> Column:
    return _column(dist.t_ppf, p, df)


def z_p(z, alternative: str = "two-sided") -> Column:
    return _column(lambda a: dist.z_p(a, alternative), z)


def f_p(f, d1, d2) -> Column:
    return _column(dist.f_sf, f, d1, d2)


def chi2_p(x, df) -> Column:
    return _column(dist.chi2_sf, x, df)


def tukey_p(q, k, df) -> Column:
    return _column(lambda a, b, c: dist.studentized_range_sf(a, int(b), c), q, k, df)


def fisher_p(a, b, c, d) -> Column:
    return _column(lambda *v: dist.fisher_2x2(*(int(x) for x in v)), a, b, c, d)


def ks_p(d, n) -> Column:
    return _column(lambda a, b: dist.kolmogorov_p(a, int(b)), d, n)


def k2_statistic(n, g1, g2) -> Column:
    """K² as a plain expression, so it stays in generated code."""
    n, g1, g2 = n.cast("double"), g1, g2
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.ln(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / F.sqrt(var)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(
        6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    denom = 1 + x * F.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - F.signum(denom) * F.pow(F.abs((1 - 2 / a) / denom), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return F.when(n >= 8, z1 * z1 + z2 * z2)


def k2_p(k2) -> Column:
    return F.exp(-k2 / 2)


def shapiro_wilk(values) -> Column:
    """``struct<statistic, p_value>`` of an array of a few values."""
    @F.pandas_udf("statistic double, p_value double")
    def run(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dist.shapiro_wilk([] if a is None else a) for a in v], columns=["statistic", "p_value"], dtype="float64")

    return run(values)
