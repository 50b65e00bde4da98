"""Panel time-series operators: every function takes series keys ``by`` and works on all series at once.

Row windows run over blocks of bounded size with overlapping rows at the seams
(``core.blocks``), so one very long series is spread over many tasks.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statframe.functions import dist, pvalue
from statframe.operators import core
from statframe.operators.core import div, num
from statframe.operators.quality import join_null_safe


def _series(df: DataFrame, ts: str, value: str, by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    core.require(df, [ts, value, *by])
    return df.select(*by, ts, num(value).alias(value), *keep)


def _period_unit(freq: str) -> str:
    # Calendar codes and their truncation unit.
    units = {"YE": "year", "Y": "year", "QE": "quarter", "Q": "quarter", "ME": "month", "M": "month",
             "W": "week", "D": "day", "H": "hour", "h": "hour"}
    return units.get(freq, freq.lower())


# ------------------------------------------------------------------ preparing
def regular_grid(df: DataFrame, ts: str, step: str, by: Sequence[str] = ()) -> DataFrame:
    """Every step between a series' first and last time stamp, NULL where data is missing."""
    by = list(by)
    parsed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    span = parsed.groupBy(*by).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    grid = span.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr(f"interval {step}"))).alias(ts))
    return join_null_safe(grid, parsed, [*by, ts], "left")


def split_report(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), size: int = 3) -> DataFrame:
    """Equal row blocks (remainder dropped): start, end, count, mean, std, cv."""
    by = list(by)
    pos = core.positions(_series(df, ts, value, by), by, [ts])
    n = pos.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    length = F.floor(F.col("_n") / size)
    cut = _attach(pos, n, by)
    cut = cut.withColumn("part", (F.floor((F.col("_pos") - 1) / length) + 1).cast("int")).where(
        F.col("_pos") <= length * size)
    return cut.groupBy(*by, "part").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std")).withColumn("cv", div(F.col("std"), F.col("mean")))


def variation(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), freq: str = "YE") -> DataFrame:
    """Mean, std (3 digits) and cv per calendar period; cv comes from the rounded values."""
    by = list(by)
    g = _series(df, ts, value, by).groupBy(*by, F.date_trunc(_period_unit(freq), F.col(ts)).alias("period")).agg(
        F.round(F.avg(value), 3).alias("mean"), F.round(F.stddev_samp(value), 3).alias("std"))
    return g.withColumn("cv", F.round(div(F.col("std"), F.col("mean")), 4)).dropna(subset=["mean", "std", "cv"])


def variation_verdict(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Log (multiplicative) when the cv varies less than the std."""
    g = table.groupBy(*by).agg(div(F.max("std"), F.min("std")).alias("std_ratio"), div(F.max("cv"), F.min("cv")).alias("cv_ratio"))
    return g.withColumn("model", F.when(F.col("cv_ratio") < F.col("std_ratio"), "multiplicative").otherwise("additive"))


def transform(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), log: bool = False, diff: int = 0,
              seasonal_diff: int = 0, period: int | None = None, drop: bool = True) -> DataFrame:
    """Log, then ``diff`` differences, then ``seasonal_diff`` differences of lag ``period``."""
    by = list(by)
    out = _series(df, ts, value, by)
    if log:
        out = out.withColumn(value, F.ln(value))
    reach = diff + seasonal_diff * (period or 0)
    if reach:
        b = core.blocks(out, by, [ts], before=reach)
        out = b.df
        for lag in [1] * diff + [period or 0] * seasonal_diff:
            out = out.withColumn(value, F.col(value) - F.lag(value, lag).over(b.window))
        out = out.where("_own").select(*by, ts, value)
    return out.where(F.col(value).isNotNull()) if drop else out


# ------------------------------------------------------------------ smoothing
def rolling(df: DataFrame, ts: str, value: str, window: int, by: Sequence[str] = ()) -> DataFrame:
    """Rolling mean and std; NULL until the window is full."""
    by = list(by)
    b = core.blocks(_series(df, ts, value, by), by, [ts], before=window - 1)
    w = b.window.rowsBetween(-window + 1, 0)
    full = F.count(value).over(w) == window
    return b.df.withColumns({"rolling_mean": F.when(full, F.avg(value).over(w)),
                             "rolling_std": F.when(full, F.stddev_samp(value).over(w))}).where("_own").select(
        *by, ts, value, "rolling_mean", "rolling_std")


def smooth(df: DataFrame, ts: str, value: str, sizes: Sequence[int], by: Sequence[str] = (), method: str = "ma") -> DataFrame:
    """Several moving averages (``ma``) or exponentially weighted means (``ewm``, by span) side by side."""
    by, sizes = list(by), list(sizes)
    if method not in ("ma", "ewm"):
        raise ValueError(f"unknown method: {method}")
    data = _series(df, ts, value, by)
    if method == "ma":
        b = core.blocks(data, by, [ts], before=max(sizes) - 1)
        cols = {}
        for s in sizes:
            w = b.window.rowsBetween(-s + 1, 0)
            cols[f"ma_{s}"] = F.when(F.count(value).over(w) == s, F.avg(value).over(w))
        return b.df.withColumns(cols).where("_own").select(*by, ts, value, *cols)
    # weights older than this reach are below 1e-14 of the newest one
    reach = max(math.ceil(math.log(1e-14) / math.log(1 - 2 / (s + 1))) if s > 1 else 1 for s in sizes)
    b = core.blocks(data, by, [ts], before=reach)
    names = [*by, ts, value, *[f"ewm_{s}" for s in sizes]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        for s in sizes:
            pdf[f"ewm_{s}"] = pdf[value].ewm(span=s).mean()
        return pdf.loc[pdf["_own"], names]

    schema = data.schema
    for s in sizes:
        schema = schema.add(f"ewm_{s}", "double")
    return b.df.groupBy(*by, "_blk").applyInPandas(run, schema)


# -------------------------------------------------------------- decomposition
def seasonal_model(df: DataFrame, ts: str, value: str, period: int, by: Sequence[str] = ()) -> DataFrame:
    """Per series: multiplicative if the cv over blocks of one period varies less than the std."""
    by = list(by)
    pos = core.positions(_series(df, ts, value, by), by, [ts])
    blocks = pos.groupBy(*by, F.floor((F.col("_pos") - 1) / period).alias("_b")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).withColumn("cv", div(F.col("std"), F.col("mean")))
    return variation_verdict(blocks, by)


def decompose(df: DataFrame, ts: str, value: str, period: int, by: Sequence[str] = (), model: str | None = None) -> DataFrame:
    """Trend (centred moving average), seasonal (normalised position mean), residual."""
    by = list(by)
    if model not in (None, "additive", "multiplicative"):
        raise ValueError(f"unknown model: {model}")
    data = core.positions(_series(df, ts, value, by), by, [ts])
    half = period // 2
    b = core.blocks(data, by, [ts], before=half, after=half)
    inner = half if period % 2 else half - 1
    w = b.window.rowsBetween(-inner, inner)
    total, count = F.sum(value).over(w), F.count(value).over(w)
    if period % 2 == 0:
        total = total + (F.lag(value, half).over(b.window) + F.lead(value, half).over(b.window)) / 2
    trend = F.when(count == 2 * inner + 1, total / period)
    out = b.df.withColumn("trend", trend).where("_own").select(*by, ts, value, "_pos", "trend")
    if model is None:
        kind = seasonal_model(df, ts, value, period, by).select(*by, "model")
        out = _attach(out, kind, by)
    else:
        out = out.withColumn("model", F.lit(model))
    times = F.col("model") == "multiplicative"
    out = out.withColumn("position", (F.pmod(F.col("_pos") - 1, F.lit(period)) + 1).cast("int"))
    bare = F.when(times, div(F.col(value), F.col("trend"))).otherwise(F.col(value) - F.col("trend"))
    means = out.withColumn("_bare", bare).groupBy(*by, "model", "position").agg(F.avg("_bare").alias("_m"))
    level = F.avg("_m").over(Window.partitionBy(*by, "model"))
    means = means.select(*by, "position", F.when(times, div(F.col("_m"), level)).otherwise(F.col("_m") - level).alias("seasonal"))
    out = core.attach(out, means, [*by, "position"])
    resid = F.when(times, div(div(F.col(value), F.col("seasonal")), F.col("trend"))).otherwise(
        F.col(value) - F.col("trend") - F.col("seasonal"))
    return out.select(*by, ts, value, "trend", "seasonal", resid.alias("residual"), "model", "position")


def _attach(df: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-series numbers back; without keys the table is one row and becomes literals."""
    if by:
        return core.attach(df, table, by)
    row = table.first()

    def literal(v, kind):
        return (F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).cast(kind)

    return df.withColumns({f.name: literal(row[f.name], f.dataType) for f in table.schema})


def seasonal_index(df: DataFrame, ts: str, value: str, period: int, by: Sequence[str] = (), model: str | None = None) -> DataFrame:
    """Seasonal index per position with its distance from the base (percent or difference) and the extremes."""
    by = list(by)
    d = decompose(df, ts, value, period, by, model)
    g = d.groupBy(*by, "model", "position").agg(F.first("seasonal").alias("index"))
    w = Window.partitionBy(*by, "model")
    base = F.when(F.col("model") == "multiplicative", (F.col("index") - 1) * 100).otherwise(F.col("index"))
    return g.select(*by, "model", "position", "index", F.avg("index").over(w).alias("mean_index"), base.alias("from_base"),
                    (F.col("index") == F.max("index").over(w)).alias("is_peak"),
                    (F.col("index") == F.min("index").over(w)).alias("is_trough"))


def adjust(df: DataFrame, ts: str, value: str, period: int, by: Sequence[str] = (), model: str | None = None) -> DataFrame:
    """Observed divided by, or minus, the seasonal part."""
    d = decompose(df, ts, value, period, by, model)
    adj = F.when(F.col("model") == "multiplicative", div(F.col(value), F.col("seasonal"))).otherwise(
        F.col(value) - F.col("seasonal"))
    return d.select(*by, ts, value, "seasonal", adj.alias("adjusted"), "model")


# ------------------------------------------------------------ autocorrelation
def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def lag_products(df: DataFrame, ts: str, value: str, lags: int, by: Sequence[str] = ()) -> DataFrame:
    """Per series: n and the array of centred products sum((x_t - m)(x_{t+k} - m)), k = 0..lags."""
    by = list(by)
    data = _series(df, ts, value, by).where(F.col(value).isNotNull())
    centred = _attach(data, data.groupBy(*by).agg(F.avg(value).alias("_m")), by).withColumn("_x", F.col(value) - F.col("_m"))
    b = core.blocks(centred.select(*by, ts, "_x"), by, [ts], before=lags)
    wide = b.df.select("*", *[F.lag("_x", k).over(b.window).alias(f"_l{k}") for k in range(1, lags + 1)]).where("_own")
    return wide.groupBy(*by).agg(F.count("_x").alias("n"), F.array(
        F.sum(F.col("_x") * F.col("_x")),
        *[F.coalesce(F.sum(F.col("_x") * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, lags + 1)]).alias("products"))


def _pacf(products: np.ndarray, n: int, lags: int) -> np.ndarray:
    """Partial autocorrelations by Levinson-Durbin on lag-adjusted autocovariances."""
    r = products[: lags + 1] / (n - np.arange(lags + 1))
    out, phi, var = np.zeros(lags), np.zeros(lags + 1), r[0]
    for k in range(1, lags + 1):
        a = (r[k] - sum(phi[j] * r[k - j] for j in range(1, k))) / var if var else np.nan
        prev = phi.copy()
        phi[k] = a
        for j in range(1, k):
            phi[j] = prev[j] - a * prev[k - j]
        var *= 1 - a * a
        out[k - 1] = a
    return out


def _lag_limit(n: int, period: int | None) -> int:
    limit = n // 4
    if period is None:
        return max(1, min(int(10 * math.log10(n)) if n > 1 else 1, limit))
    return max(min(3 * period, limit), 2 * period)


def acf(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), period: int | None = None) -> DataFrame:
    """ACF and PACF per lag with significance (2/√n) and the cut-off orders p, q (and P, Q)."""
    data = _series(df, ts, value, by).where(F.col(value).isNotNull())
    longest = data.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    table, keys = _keyed(lag_products(data, ts, value, min(_lag_limit(longest, period), max(longest - 1, 1)), by), by)
    schema = (_key_schema(table, keys) + ", lag int, n long, acf double, acf_sig boolean, pacf double, pacf_sig boolean, "
              "bound double, p int, q int, sp int, sq int")

    def lead(flags) -> int:
        return next((i for i, f in enumerate(flags) if not f), len(flags))

    def run(frames):
        for pdf in frames:
            rows = []
            for rec in pdf.to_dict("records"):
                n, prod = int(rec["n"]), np.asarray(rec["products"], dtype=float)
                lags = min(_lag_limit(n, period), len(prod) - 1, n - 1)
                if lags < 1 or prod[0] == 0:
                    continue
                a, pa, bound = prod[1:lags + 1] / prod[0], _pacf(prod, n, lags), 2 / math.sqrt(n)
                sa, sp = np.abs(a) > bound, np.abs(pa) > bound
                season = list(range(period, lags + 1, period)) if period else []
                orders = (lead(sp), lead(sa), lead([sp[i - 1] for i in season]), lead([sa[i - 1] for i in season]))
                rows += [(*[rec[k] for k in keys], k + 1, n, a[k], bool(sa[k]), pa[k], bool(sp[k]), bound, *orders)
                         for k in range(lags)]
            yield pd.DataFrame(rows, columns=[*keys, "lag", "n", "acf", "acf_sig", "pacf", "pacf_sig", "bound", "p", "q", "sp", "sq"])

    out = table.mapInPandas(run, schema)
    return out if by else out.drop("_all")


# --------------------------------------------------------------- stationarity
def _adf_lags(n: int) -> int:
    return max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))


def _design(x: np.ndarray, lags: int, start: int, stop: int) -> np.ndarray:
    """Rows t = start..stop-1 of [dx_t, 1, x_{t-1}, dx_{t-1} … dx_{t-lags}] (0-based t)."""
    d = np.diff(x, prepend=np.nan)
    t = np.arange(start, stop)
    return np.column_stack([d[t], np.ones(len(t)), x[t - 1], *[d[t - k] for k in range(1, lags + 1)]])


def _solve(g: np.ndarray, idx: list[int]) -> tuple[np.ndarray, float, np.ndarray]:
    """Least squares of column 0 on ``idx`` from a cross-product matrix: beta, rss, inverse."""
    inv = core.inverse(g[np.ix_(idx, idx)])
    beta = inv @ g[idx, 0]
    return beta, max(float(g[0, 0] - beta @ g[idx, 0]), 1e-300), inv


def adf(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Augmented Dickey-Fuller with constant, lag length by AIC, for every series in one plan.

    Each block returns its cross-product matrix over the common sample and the
    head of the series; all lag lengths are sub-blocks of the summed matrix,
    and the head rows complete the refit on the chosen length.
    """
    data = _series(df, ts, value, by).where(F.col(value).isNotNull())
    stats = data.groupBy(*by).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    longest = stats.agg(F.max("_n")).first()[0] or 0
    top = _adf_lags(longest)
    full, keys = _keyed(_attach(data, stats, by), by)
    b = core.blocks(full, keys, [ts], before=top + 1)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        n, s, pos = int(pdf["_n"].iloc[0]), pdf["_s"].iloc[0], pdf["_pos"].to_numpy()
        lags = _adf_lags(n)
        x = (pdf[value].to_numpy() - pdf["_m"].iloc[0]) / (s if s and s == s else 1.0)
        own = pdf["_own"].to_numpy()
        first = int(np.argmax(own)) if own.any() else len(x)
        start = max(first, lags + 1 - (int(pos[0]) - 1), lags + 1 if pos[0] == 1 else first)
        m = _design(x, lags, start, len(x)) if start < len(x) else np.zeros((0, lags + 3))
        head = x[: lags + 1] if pos[0] == 1 else np.zeros(0)
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], n, s, len(m), (m.T @ m).ravel().tolist(), head.tolist()]],
                            columns=[*keys, "n", "std", "rows", "g", "head"])

    parts = b.df.groupBy(*keys, "_blk").applyInPandas(
        part, _key_schema(full, keys) + ", n long, std double, rows long, g array<double>, head array<double>")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        n, std = int(pdf["n"].iloc[0]), pdf["std"].iloc[0]
        lags = _adf_lags(n)
        out = [*[pdf[k].iloc[0] for k in keys], n]
        rows = int(pdf["rows"].sum())
        if n < 6 or not std or std != std or rows < lags + 3:
            out += [None, None, None, None, None, None, std, None]
        else:
            g = np.sum([np.asarray(v) for v in pdf["g"]], axis=0).reshape(lags + 3, lags + 3)
            head = np.concatenate([np.asarray(v, dtype=float) for v in pdf["head"]])
            best = min(range(lags + 1), key=lambda k: rows * math.log(_solve(g, list(range(1, k + 3)))[1] / rows) + 2 * (k + 2))
            if best < lags:
                extra = _design(head, best, best + 1, len(head))
                size = best + 3
                g = g[:size, :size] + extra.T @ extra
                rows += len(extra)
            beta, rss, inv = _solve(g, list(range(1, best + 3)))
            tau = beta[1] / math.sqrt(rss / (rows - best - 2) * inv[1, 1])
            p, crit = dist.adf_p(tau), dist.adf_critical(rows)
            out += [tau, p, best, crit["1%"], crit["5%"], crit["10%"], std, bool(p < alpha)]
        return pd.DataFrame([out], columns=[*keys, "n", "statistic", "p_value", "used_lag", "crit_1", "crit_5", "crit_10",
                                            "std", "stationary"])

    res = parts.groupBy(*keys).applyInPandas(
        finish, _key_schema(full, keys) + ", n long, statistic double, p_value double, used_lag int, crit_1 double, "
        "crit_5 double, crit_10 double, std double, stationary boolean")
    return res if by else res.drop("_all")


def adf_variants(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), period: int | None = None, max_diff: int = 2,
                 log: bool = True, alpha: float = 0.05) -> DataFrame:
    """ADF of every log × difference × seasonal-difference combination, ranked: stationary first, then std."""
    variants = None
    for use_log, d, sd in itertools.product([False, True] if log else [False], range(max_diff + 1), [0, 1] if period else [0]):
        one = transform(df, ts, value, by, use_log, d, sd, period).withColumns(
            {"log": F.lit(use_log), "diff": F.lit(d), "seasonal_diff": F.lit(sd)})
        variants = one if variants is None else variants.unionByName(one)
    keys = [*by, "log", "diff", "seasonal_diff"]
    table = adf(core.checkpoint(variants), ts, value, keys, alpha)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("stationary").desc(), F.col("std"), "diff", "seasonal_diff", "log")
    least = F.min("std").over(Window.partitionBy(*(by or [F.lit(0)])))
    return table.withColumn("place", F.row_number().over(w)).withColumn(
        "over_differenced", (F.col("place") == 1) & (F.col("std") > least))


def adf_transform(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), **kw) -> tuple[DataFrame, DataFrame]:
    """The series after its best combination, and the ranking table."""
    table = core.checkpoint(adf_variants(df, ts, value, by, **kw))
    best = table.where("place = 1").select(*by, "log", "diff", "seasonal_diff")
    out = None
    for c in best.select("log", "diff", "seasonal_diff").distinct().collect():   # at most 12 combinations
        keys = best.where((F.col("log") == c["log"]) & (F.col("diff") == c["diff"]) & (F.col("seasonal_diff") == c["seasonal_diff"]))
        own = _attach(df, keys.select(*by), by) if by else df
        one = transform(own, ts, value, by, c["log"], c["diff"], c["seasonal_diff"], kw.get("period"))
        out = one if out is None else out.unionByName(one)
    return out, table


#: Difference orders whose spread is measured in one pass.
ORDERS_AT_ONCE = 4


def _spreads(data: DataFrame, ts: str, value: str, first: int, last: int) -> list[tuple[int, int, float | None]]:
    """(order, rows, standard deviation) of the differences of these orders, from one pass: a difference is a binomial sum of lags."""
    b = core.blocks(data, [], [ts], before=last)
    lagged = [F.col(value), *[F.lag(value, k).over(b.window) for k in range(1, last + 1)]]
    sums = {j: sum(((-1) ** k * math.comb(j, k) * lagged[k] for k in range(1, j + 1)), lagged[0]) for j in range(first, last + 1)}
    row = b.df.select("_own", *[c.alias(f"_d{j}") for j, c in sums.items()]).where("_own").agg(
        *[F.count(f"_d{j}").alias(f"n{j}") for j in sums], *[F.stddev_samp(f"_d{j}").alias(f"s{j}") for j in sums]).first()
    return [(j, row[f"n{j}"], row[f"s{j}"]) for j in sums]


def adf_differences(df: DataFrame, ts: str, value: str, max_diff: int = -1, alpha: float = 0.05) -> DataFrame:
    """One series: ADF of its differences, and which order has the least spread.

    Shown are the orders up to ``max_diff``, or without it up to the first whose standard deviation exceeds the one before; orders that
    leave fewer than 10 rows are not. The spreads come first, several orders a pass; the tests of all shown orders are one plan.
    """
    data = _series(df, ts, value, []).where(F.col(value).isNotNull())
    spread: list[tuple[int, int, float | None]] = []
    rises = lambda: [j for (_, _, a), (j, _, b) in zip(spread, spread[1:]) if a is not None and b is not None and b > a]
    while True:
        spread += _spreads(data, ts, value, len(spread), len(spread) + ORDERS_AT_ONCE - 1)
        stop = max_diff if max_diff >= 0 else min(rises(), default=None)
        if spread[-1][1] < 10 or stop is not None and stop < len(spread):
            break
    shown = [j for j, n, _ in spread if (stop is None or j <= stop) and (j == 0 or n >= 10)]
    least = min(shown, key=lambda j: (math.inf if spread[j][2] is None else spread[j][2], j))
    series = [transform(data, ts, value, (), diff=j).withColumn("diff", F.lit(j)) for j in shown]
    tests = adf(functools.reduce(DataFrame.unionByName, series), ts, value, ["diff"], alpha)
    advice = F.when(F.col("diff") == least, "stop here").when(F.col("diff") > least, "over-differenced").otherwise("")
    return tests.withColumn("advice", advice).orderBy("diff")


# ---------------------------------------------------------------------- ARIMA
def _lag_sets(p: int, q: int, sp: int, sq: int, s: int) -> tuple[list[int], list[int]]:
    """Lags of the product of a plain and a seasonal polynomial; the cross lags have free coefficients (and count as parameters)."""
    product = lambda plain, seasonal: sorted({i + s * j for i in range(plain + 1) for j in range(seasonal + 1)} - {0})
    return product(p, sp), product(q, sq)


def _long_ar(n: int, s: int) -> int:
    return max(1, min(int(10 * math.log10(max(n, 2))) if not s else max(int(10 * math.log10(max(n, 2))), s + 1), n // 4))


def _innovations(w: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Residuals of the long autoregression; the first rows stay NaN."""
    m = len(phi)
    out = np.full(len(w), np.nan)
    if len(w) > m:
        lagged = np.lib.stride_tricks.sliding_window_view(w, m + 1)
        out[m:] = lagged[:, m] - lagged[:, :m][:, ::-1] @ phi
    return out


def _long_ar_fit(full: DataFrame, keys: list[str], ts: str, value: str, top: int, s: int) -> DataFrame:
    """Stage one: coefficients of a long autoregression per series."""
    b = core.blocks(full, keys, [ts], before=top)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        n = int(pdf["_n"].iloc[0])
        m, x = _long_ar(n, s), pdf[value].to_numpy() / (pdf["_s"].iloc[0] or 1.0)
        ok = pdf["_own"].to_numpy() & (pdf["_pos"].to_numpy() > m)
        t = np.flatnonzero(ok)
        t = t[t >= m]
        z = np.column_stack([x[t - k] for k in range(m + 1)]) if len(t) else np.zeros((0, m + 1))
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], n, (z.T @ z).ravel().tolist()]], columns=[*keys, "n", "g"])

    parts = b.df.groupBy(*keys, "_blk").applyInPandas(part, _key_schema(full, keys) + ", n long, g array<double>")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _long_ar(int(pdf["n"].iloc[0]), s)
        g = np.sum([np.asarray(v) for v in pdf["g"]], axis=0).reshape(m + 1, m + 1)
        phi = _solve(g, list(range(1, m + 1)))[0]
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], phi.tolist()]], columns=[*keys, "_phi"])

    return parts.groupBy(*keys).applyInPandas(finish, _key_schema(full, keys) + ", _phi array<double>")


def arima_grid(df: DataFrame, ts: str, value: str, by: Sequence[str] = (), p: int = 1, d: int = 1, q: int = 1,
               sp: int = 1, sd: int = 1, sq: int = 1, s: int | None = None, log: bool = False,
               search_diff: bool = False) -> DataFrame:
    """Ranked order grid per series by two-stage least squares (Hannan-Rissanen).

    All orders that share differences come from one cross-product matrix per
    series: lags of the series and of the long-autoregression residuals.
    Coefficients and AIC therefore differ from an exact likelihood; ranking is
    comparable.  ``place`` is the AIC rank.
    """
    s = s or 0
    if not s:
        sp = sd = sq = 0
    out = None
    for dd, sdd in itertools.product(range(d + 1) if search_diff else [d], range(sd + 1) if search_diff else [sd]):
        one = _grid_fixed(df, ts, value, list(by), (p, dd, q), (sp, sdd, sq), s, log)
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("aic", "params", "p", "q", "sp", "sq", "d", "sd")
    return out.withColumn("place", F.row_number().over(w))


def _grid_fixed(df, ts, value, by, order, seasonal, s, log) -> DataFrame:
    (p, d, q), (sp, sd, sq) = order, seasonal
    w = transform(df, ts, value, by, log, d, sd, s or None)
    stats = w.groupBy(*by).agg(F.count(value).alias("_n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("_s"))
    longest = stats.agg(F.max("_n")).first()[0] or 0
    full, keys = _keyed(_attach(w, stats, by), by)
    full = core.checkpoint(full)
    phi = _long_ar_fit(full, keys, ts, value, _long_ar(longest, s), s)
    ar, ma = _lag_sets(p, q, sp, sq, s)
    reach = max([0, *ar, *ma])
    b = core.blocks(core.attach(full, phi, keys), keys, [ts], before=reach + _long_ar(longest, s))
    width = 1 + len(ar) + len(ma)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        scale = pdf["_s"].iloc[0] or 1.0
        x, coef = pdf[value].to_numpy() / scale, np.asarray(pdf["_phi"].iloc[0], dtype=float)
        e = _innovations(x, coef)
        skip = len(coef) + reach
        t = np.flatnonzero(pdf["_own"].to_numpy() & (pdf["_pos"].to_numpy() > skip))
        t = t[t >= skip]
        z = np.column_stack([x[t], *[x[t - k] for k in ar], *[e[t - k] for k in ma]]) if len(t) else np.zeros((0, width))
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], scale, len(t), (z.T @ z).ravel().tolist(), coef.tolist()]],
                            columns=[*keys, "scale", "rows", "g", "phi"])

    parts = b.df.groupBy(*keys, "_blk").applyInPandas(
        part, _key_schema(full, keys) + ", scale double, rows long, g array<double>, phi array<double>")
    grid = list(itertools.product(range(p + 1), range(q + 1), range(sp + 1), range(sq + 1)))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.sum([np.asarray(v) for v in pdf["g"]], axis=0).reshape(width, width)
        n, scale, rows = int(pdf["rows"].sum()), pdf["scale"].iloc[0], []
        for op, oq, osp, osq in grid:
            a, m = _lag_sets(op, oq, osp, osq, s)
            idx = [1 + ar.index(k) for k in a] + [1 + len(ar) + ma.index(k) for k in m]
            if n <= len(idx) + 1:
                continue
            beta, rss, _ = _solve(g, idx) if idx else (np.zeros(0), max(float(g[0, 0]), 1e-300), None)
            k, sigma2 = len(idx) + 1, rss / n * scale**2
            base = n * math.log(sigma2)
            rows.append([*[pdf[c].iloc[0] for c in keys], op, d, oq, osp, sd, osq, s, k, n, sigma2, base + 2 * k,
                         base + math.log(n) * k, a, beta[:len(a)].tolist(), m, beta[len(a):].tolist(), pdf["phi"].iloc[0]])
        return pd.DataFrame(rows, columns=[*keys, "p", "d", "q", "sp", "sd", "sq", "s", "params", "n", "sigma2", "aic", "bic",
                                           "ar_lags", "ar", "ma_lags", "ma", "long_ar"])

    res = parts.groupBy(*keys).applyInPandas(finish, _key_schema(full, keys) + (
        ", p int, d int, q int, sp int, sd int, sq int, s int, params int, n long, sigma2 double, aic double, bic double, "
        "ar_lags array<int>, ar array<double>, ma_lags array<int>, ma array<double>, long_ar array<double>"))
    return (res if by else res.drop("_all")).withColumn("log", F.lit(log))


def best_orders(grid: DataFrame) -> DataFrame:
    return grid.where("place = 1").drop("place")


def _orders(best: DataFrame) -> list:
    """The distinct differencing settings among the chosen models (a handful)."""
    return best.select("d", "sd", "s", "log").distinct().collect()


def _one_step(keys: list[str], ts: str, value: str, log: bool):
    """Block function: predictions and residuals of one differencing setting."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        x = pdf["_w"].to_numpy()
        e = _innovations(x, np.asarray(pdf["long_ar"].iloc[0], dtype=float))
        hat = np.zeros(len(x))
        for lags, coef, src in (("ar_lags", "ar", x), ("ma_lags", "ma", e)):
            for k, c in zip(pdf[lags].iloc[0], pdf[coef].iloc[0]):
                moved = np.full(len(x), np.nan)
                moved[k:] = src[:-k]
                hat = hat + c * moved
        resid = x - hat
        y = pdf[value].to_numpy()
        pdf["pred"] = np.exp(np.log(y) - resid) if log else y - resid
        pdf["resid"] = resid
        return pdf.loc[pdf["_own"] & pdf["resid"].notna(), [*keys, ts, value, "pred", "resid"]]
    return run


def fitted(df: DataFrame, ts: str, value: str, best: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-step predictions and residuals of each series under its chosen model."""
    out, by = None, list(by)
    for o in _orders(best):
        same = [F.col(c) == o[c] for c in ("d", "sd", "s", "log")]
        mine = best.where(functools.reduce(lambda a, b: a & b, same)).select(*by, "ar_lags", "ar", "ma_lags", "ma", "long_ar")
        own = _attach(df.select(*by, ts, value), mine.select(*by), by) if by else df.select(ts, value)
        w = transform(own, ts, value, by, o["log"], o["d"], o["sd"], o["s"] or None).withColumnRenamed(value, "_w")
        both = join_null_safe(w, _series(own, ts, value, by), [*by, ts])
        longest = mine.select(F.max(F.size("long_ar") + F.greatest(F.coalesce(F.array_max("ar_lags"), F.lit(0)),
                                                                   F.coalesce(F.array_max("ma_lags"), F.lit(0))))).first()[0]
        full, keys = _keyed(_attach(both, mine, by), by)
        b = core.blocks(full, keys, [ts], before=longest or 1)
        one = b.df.groupBy(*keys, "_blk").applyInPandas(
            _one_step(keys, ts, value, o["log"]), _key_schema(full, [*keys, ts]) + f", `{value}` double, pred double, resid double")
        one = one if by else one.drop("_all")
        out = one if out is None else out.unionByName(one)
    return out


def forecast(df: DataFrame, ts: str, value: str, best: DataFrame, steps: int, by: Sequence[str] = (),
             alpha: float = 0.05) -> DataFrame:
    """h-step forecasts with intervals, from the last rows of each series (bounded input per series)."""
    by = list(by)
    reach = best.select(F.max(F.size("long_ar") + F.col("d") + F.col("sd") * F.col("s") + 2 * F.greatest(
        F.coalesce(F.array_max("ar_lags"), F.lit(0)), F.coalesce(F.array_max("ma_lags"), F.lit(0))))).first()[0] + 50
    data = core.positions(_series(df, ts, value, by).where(F.col(value).isNotNull()), by, [ts])
    size = data.groupBy(*by).agg(F.max("_pos").alias("_n"))
    tail = _attach(data, size, by).where(F.col("_pos") > F.col("_n") - reach)
    full, keys = _keyed(_attach(tail, best.select(*by, "d", "sd", "s", "log", "sigma2", "ar_lags", "ar", "ma_lags", "ma", "long_ar"), by), by)
    z = dist.norm_ppf(1 - alpha / 2)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        r = pdf.iloc[0]
        y = np.log(pdf[value].to_numpy()) if r["log"] else pdf[value].to_numpy()
        d, sd, s = int(r["d"]), int(r["sd"]), int(r["s"])
        dpoly = np.array([1.0])
        for lag in [1] * d + [s] * sd:
            step = np.zeros(lag + 1)
            step[0], step[lag] = 1.0, -1.0
            dpoly = np.convolve(dpoly, step)
        w = np.convolve(y, dpoly)[len(dpoly) - 1: len(y)]
        e = list(np.nan_to_num(_innovations(w, np.asarray(r["long_ar"], dtype=float))))
        ar = np.zeros(max([0, *r["ar_lags"]]) + 1)
        ar[0] = 1.0
        for k, c in zip(r["ar_lags"], r["ar"]):
            ar[k] = -c
        poly = np.convolve(ar, dpoly)              # whole autoregressive side
        ma = np.zeros(max([0, *r["ma_lags"]]) + 1)
        ma[0] = 1.0
        for k, c in zip(r["ma_lags"], r["ma"]):
            ma[k] = c
        hist, psi, rows, var = list(y), [], [], 0.0
        for h in range(steps):
            mean = -sum(poly[k] * hist[-k] for k in range(1, len(poly)) if k <= len(hist))
            mean += sum(ma[k] * e[-k] for k in range(1, len(ma)) if k <= len(e))
            psi.append((ma[h] if h < len(ma) else 0.0) - sum(poly[k] * psi[h - k] for k in range(1, min(h, len(poly) - 1) + 1)))
            hist.append(mean)
            e.append(0.0)
            var += psi[h] ** 2 * r["sigma2"]
            band = z * math.sqrt(var)
            vals = np.array([mean, mean - band, mean + band])
            rows.append([*[r[k] for k in keys], h + 1, *(np.exp(vals) if r["log"] else vals)])
        return pd.DataFrame(rows, columns=[*keys, "step", "pred", "lower", "upper"])

    res = full.groupBy(*keys).applyInPandas(run, _key_schema(full, keys) + ", step int, pred double, lower double, upper double")
    return res if by else res.drop("_all")


# -------------------------------------------------------- residuals and score
def residual_report(df: DataFrame, ts: str, resid: str, by: Sequence[str] = (), lags: Sequence[int] = (10,),
                    model_df: int = 0, burn: int = 0, alpha: float = 0.05, orders: DataFrame | None = None) -> DataFrame:
    """Ljung-Box, Jarque-Bera and break-in-variance tests per series.

    ``orders`` (one row per series, as ``best_orders`` returns) takes the place of ``lags``, ``model_df`` and ``burn``: the rows that
    differencing used up are left out, a seasonal model is tested at one and two seasons, and its coefficients count as degrees of
    freedom. Every series has its own lags: those above its degrees of freedom and up to a fifth of its length, or else the larger of both.
    """
    by = list(by)
    data = _series(df, ts, resid, by).where(F.col(resid).isNotNull())
    if orders is None:
        plan = data.select(*by).distinct() if by else data.sparkSession.range(1).select()
        plan = plan.select(*by, F.array(*[F.lit(int(k)) for k in lags]).alias("_wanted"), F.lit(model_df).alias("_free"), F.lit(burn).alias("_burn"))
    else:
        season = F.col("s") > 0
        plan = orders.select(*by, F.when(season, F.array("s", 2 * F.col("s"))).otherwise(F.array(*[F.lit(int(k)) for k in lags])).alias("_wanted"),
                             (F.col("p") + F.col("q") + F.col("sp") + F.col("sq")).alias("_free"), (F.col("d") + F.col("sd") * F.col("s")).alias("_burn"))
    data = _attach(core.positions(data, by, [ts]), plan, by).where(F.col("_pos") > F.col("_burn")).withColumn("_pos", F.col("_pos") - F.col("_burn"))
    fifth = F.floor(F.col("_n") / 5).cast("int")
    kept = F.filter("_wanted", lambda k: (k > F.col("_free")) & (k <= fifth))
    sizes = _attach(data.groupBy(*by).agg(F.max("_pos").alias("_n")), plan, by).withColumn(
        "_lags", F.when(F.size(kept) > 0, kept).otherwise(F.array(F.greatest(F.col("_free") + 1, fifth))))
    most = sizes.agg(F.max(F.array_max("_lags"))).first()[0] or 1
    prods = _attach(lag_products(data.select(*by, ts, resid), ts, resid, most, by), sizes.select(*by, "_lags", "_free"), by)
    rho = lambda j: div(F.element_at("products", j + 1), F.element_at("products", 1))
    box = prods.select(*by, "n", "products", "_free", F.explode("_lags").alias("_k")).withColumn("_sum", F.aggregate(
        F.sequence(F.lit(1), F.col("_k")), F.lit(0.0), lambda total, j: total + div(rho(j) * rho(j), F.col("n") - j)))
    box = box.select(*by, F.concat(F.lit("Ljung-Box ("), F.col("_k"), F.lit(")")).alias("test"), "n",
                     (F.col("n") * (F.col("n") + 2) * F.col("_sum")).alias("statistic"), (F.col("_k") - F.col("_free")).cast("double").alias("df"))
    tests = [box.withColumn("p_value", pvalue.chi2_p(F.col("statistic"), F.col("df")))]
    m = core.moments(data, [resid], by)
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    tests.append(m.select(*by, F.lit("Jarque-Bera").alias("test"), "n", jb.alias("statistic"), F.lit(2.0).alias("df"))
                 .withColumn("p_value", F.exp(-F.col("statistic") / 2)))
    third = F.round(F.col("_n") / 3)
    sq = F.col(resid) * F.col(resid)
    h = _attach(data, sizes.select(*by, "_n"), by).groupBy(*by).agg(
        F.max("_n").alias("n"), F.max(third).alias("_h"),
        div(F.sum(F.when(F.col("_pos") > F.col("_n") - third, sq)), F.sum(F.when(F.col("_pos") <= third, sq))).alias("statistic"))
    h = h.select(*by, F.lit("Break in variance").alias("test"), "n", "statistic", F.col("_h").cast("double").alias("df"))
    upper = pvalue.f_p(F.col("statistic"), F.col("df"), F.col("df"))
    tests.append(h.withColumn("_u", upper).withColumn("p_value", 2 * F.least(F.col("_u"), 1 - F.col("_u"))).drop("_u"))
    out = tests[0]
    for t in tests[1:]:
        out = out.unionByName(t)
    return out.withColumn("passed", F.col("p_value") >= alpha)


def score(df: DataFrame, ts: str, actual: str, pred: str, by: Sequence[str] = (), period: int = 1) -> DataFrame:
    """MAE, RMSE, MAPE (zeros skipped) of the model and of the (seasonal) naive forecast on the common rows."""
    by = list(by)
    b = core.blocks(df.select(*by, ts, num(actual).alias("_a"), num(pred).alias("_p")), by, [ts], before=period)
    rows = b.df.withColumn("_naive", F.lag("_a", period).over(b.window)).where("_own").dropna(subset=["_a", "_p", "_naive"])
    long = rows.select(*by, "_a", F.inline(F.array(
        F.struct(F.lit("model").alias("target"), F.col("_p").alias("_f")),
        F.struct(F.lit("naive").alias("target"), F.col("_naive").alias("_f")))))
    e = F.col("_a") - F.col("_f")
    return long.groupBy(*by, "target").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.when(F.col("_a") != 0, F.abs(e / F.col("_a")))) * 100).alias("mape"))


