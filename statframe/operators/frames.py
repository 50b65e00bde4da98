"""The small aggregated frames behind the usual charts."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statframe.operators import core
from statframe.operators.core import col_of, div, num

# Aggregate names accepted where a caller may also pass a function of a column.
ESTIMATORS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_samp, "count": F.count}


def _estimator(e: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    if callable(e):
        return e
    if e not in ESTIMATORS:
        raise ValueError(f"unknown estimator: {e}")
    return ESTIMATORS[e]


def _keys(*names: str | None) -> list[str]:
    return list(dict.fromkeys(n for n in names if n is not None))


def _present(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys)) if keys else df


# -------------------------------------------------------------- distributions
def bin_edges(df: DataFrame, x: str, bins: int | str = "auto") -> tuple[float, float, int]:
    """(first edge, width, number): ``auto`` is the narrower of the Sturges and Freedman-Diaconis widths."""
    r = core.moments_dict(df, [x])[x]
    lo, hi, n = r["min"], r["max"], r["n"]
    if not n:
        raise ValueError(f"{x} has no values")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    if bins == "auto":
        width = (hi - lo) / (math.log2(n) + 1)
        a, b = core.quantiles(df, [x], [.25, .75])[x]
        fd = 2 * (b - a) / n ** (1 / 3)
        width = min(width, fd) if fd > 0 else width
        bins = max(1, math.ceil((hi - lo) / width))
    return lo, (hi - lo) / bins, int(bins)


def histogram(df: DataFrame, x: str, bins: int | str = "auto", hue: str | None = None) -> DataFrame:
    """``[hue], bin, left, right, count`` with empty bins kept; the last bin is closed."""
    lo, width, n = bin_edges(df, x, bins)
    keys = _keys(hue)
    place = F.least(F.floor((num(x) - F.lit(lo)) / F.lit(width)), F.lit(n - 1)).cast("int")
    counts = _present(df, keys).where(num(x).isNotNull()).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    groups = counts.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    every = groups.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    return every.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.lit(lo) + F.col("bin") * width).alias("left"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("right"),
        F.coalesce("count", F.lit(0)).alias("count"))


#: Bins per bandwidth, and how many bandwidths a kernel reaches.
BINS_PER_WIDTH, KERNEL_REACH = 32, 9


def _density(df: DataFrame, x: str, keys: list[str], grid: int, widen: float, cut: float) -> DataFrame:
    """Gaussian kernel density of all rows per group: ``keys…, i, x, density`` on ``grid`` points.

    Rows are shared linearly between the neighbouring bins, which are a fixed part of the group's own bandwidth (whatever its range), only
    filled bins exist, and each adds its kernel to the points in reach. No step brings bins or groups to the driver. Groups with fewer
    than two distinct values have no curve.
    """
    keys = list(keys) or ["_whole"]
    data = (df if keys != ["_whole"] else df.withColumn("_whole", F.lit(0))).dropna(subset=keys).select(*keys, num(x).alias("_v")).where(F.col("_v").isNotNull())
    stats = core.moments(data, ["_v"], keys).where((F.col("n") >= 2) & (F.col("max") > F.col("min")))
    width = F.sqrt("var") * F.pow(F.col("n").cast("double"), F.lit(-0.2)) * widen
    scales = stats.select(*keys, "n", width.alias("_bw"), (F.col("min") - cut * width).alias("_lo"),
                          ((F.col("max") - F.col("min") + 2 * cut * width) / (grid - 1)).alias("_step"))
    placed = core.attach(data, scales.select(*keys, "_bw"), keys)
    spot = F.col("_v") * BINS_PER_WIDTH / F.col("_bw")
    low, share = F.floor(spot), spot - F.floor(spot)
    bins = placed.select(*keys, F.inline(F.array(F.struct(low.alias("_b"), (1 - share).alias("_w")), F.struct((low + 1).alias("_b"), share.alias("_w")))))
    bins = core.attach(bins.groupBy(*keys, "_b").agg(F.sum("_w").alias("_w")), scales, keys).withColumn("_c", F.col("_b") * F.col("_bw") / BINS_PER_WIDTH)
    reach = KERNEL_REACH * F.col("_bw")
    first = F.greatest(F.ceil((F.col("_c") - reach - F.col("_lo")) / F.col("_step")), F.lit(0))
    last = F.least(F.floor((F.col("_c") + reach - F.col("_lo")) / F.col("_step")), F.lit(grid - 1))
    near = bins.where(first <= last).select(*keys, "_w", "_c", "_bw", "_lo", "_step", F.explode(F.sequence(first, last)).alias("i"))
    z = (F.col("_lo") + F.col("i") * F.col("_step") - F.col("_c")) / F.col("_bw")
    sums = near.groupBy(*keys, "i").agg(F.sum(F.col("_w") * F.exp(-0.5 * z * z)).alias("_sum"))
    points = scales.select(*keys, "n", "_bw", "_lo", "_step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))).alias("i"))
    out = points.join(sums, [*keys, "i"], "left").select(
        *keys, "i", (F.col("_lo") + F.col("i") * F.col("_step")).alias("x"),
        (F.coalesce("_sum", F.lit(0.0)) / (F.col("n") * F.col("_bw") * math.sqrt(2 * math.pi))).alias("density"))
    return out.drop("_whole")


def kde(df: DataFrame, x: str, hue: str | None = None, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Density curve per group (Scott bandwidth)."""
    out = _density(df.withColumn(hue, col_of(hue).cast("string")) if hue else df, x, _keys(hue), grid, 1.0, cut)
    return out.drop("i").orderBy(*_keys(hue), "x")


def kde_lines(df: DataFrame, x: str, hue: str | None = None, level: float = 0.95) -> DataFrame:
    """Mean line and t interval that go with the density curve."""
    from statframe.operators.quality import mean_interval

    keys = _keys(hue)
    return mean_interval(_present(df, keys), [x], keys, level)


# Fixed values of the peak rule: bandwidth factor, grid points, least prominence against the top.
PEAK_WIDEN, PEAK_GRID, PEAK_PROMINENCE = 2.0, 512, 0.05


def peaks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number and places of density peaks per column, from all rows: all columns are groups of one plan."""
    cols = list(cols)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), num(c).alias("_x")) for c in cols])))
    curves: dict[str, list] = {c: [] for c in cols}
    for r in _density(long, "_x", ["_column"], PEAK_GRID, PEAK_WIDEN, 0.0).orderBy("_column", "i").collect():   # a grid per column
        curves[r["_column"]].append((r["x"], r["density"]))
    rows = []
    for c, curve in curves.items():
        dens = np.array([d for _, d in curve])
        found = [i for i in _local_maxima(dens) if _prominence(dens, i) >= PEAK_PROMINENCE * dens.max()] if curve else []
        rows.append({"variable": c, "peaks": len(found) if curve else None, "positions": [float(curve[i][0]) for i in found]})
    return core.rows_frame(df.sparkSession, rows, "variable string, peaks int, positions array<double>")


def _local_maxima(y: np.ndarray) -> list[int]:
    out, i = [], 1
    while i < len(y) - 1:
        if y[i] > y[i - 1]:
            j = i
            while j < len(y) - 1 and y[j + 1] == y[i]:
                j += 1
            if j < len(y) - 1 and y[j + 1] < y[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return out


def _prominence(y: np.ndarray, i: int) -> float:
    left = right = y[i]
    for v in y[:i][::-1]:
        if v > y[i]:
            break
        left = min(left, v)
    for v in y[i + 1:]:
        if v > y[i]:
            break
        right = min(right, v)
    return y[i] - max(left, right)


def box(df: DataFrame, y: str, x: str | None = None, hue: str | None = None) -> DataFrame:
    """Quartiles, whiskers (last values inside 1.5 IQR) and outlier count per group."""
    keys = _keys(x, hue)
    data = _present(df, keys).select(*keys, num(y).alias("_y")).where(F.col("_y").isNotNull())
    if keys:
        q = core.group_quantiles(data, ["_y"], [.25, .5, .75], keys).select(
            *keys, F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))
        both = core.attach(data, q, keys)
    else:
        a, b, c = core.quantiles(data, ["_y"], [.25, .5, .75])["_y"]
        both = data.withColumns({"q25": F.lit(a), "q50": F.lit(b), "q75": F.lit(c)})
    iqr = F.col("q75") - F.col("q25")
    inside = (F.col("_y") >= F.col("q25") - 1.5 * iqr) & (F.col("_y") <= F.col("q75") + 1.5 * iqr)
    return both.groupBy(*keys, "q25", "q50", "q75").agg(
        F.count(F.lit(1)).alias("n"), F.min("_y").alias("min"), F.max("_y").alias("max"),
        F.min(F.when(inside, F.col("_y"))).alias("whisker_low"), F.max(F.when(inside, F.col("_y"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


# ----------------------------------------------------------------- aggregates
def bar(df: DataFrame, x: str, y: str, hue: str | None = None, estimator: str | Callable = "mean") -> DataFrame:
    keys = _keys(x, hue)
    return _present(df, keys).groupBy(*keys).agg(_estimator(estimator)(num(y)).alias("value"))


def count(df: DataFrame, x: str, hue: str | None = None) -> DataFrame:
    keys = _keys(x, hue)
    return _present(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def pie(df: DataFrame, x: str) -> DataFrame:
    """Counts and shares; the total is one number, so no window gathers the levels."""
    g = count(df, x)
    total = g.agg(F.sum("count")).first()[0] or 0
    return g.withColumn("share", div(F.col("count"), F.lit(total)))


def stack_cells(df: DataFrame, x: str, y: str, hue: str, aggregate: str | Callable = "sum", ratio: bool = False) -> DataFrame:
    """The filled cells of ``stack`` as rows ``x, hue, value``, for any number of levels."""
    cells = _present(df, [x, hue]).groupBy(x, hue).agg(_estimator(aggregate)(num(y)).alias("value"))
    if not ratio:
        return cells
    totals = cells.groupBy(x).agg(F.sum("value").alias("_total"))
    return core.attach(cells, totals, [x]).select(x, hue, (div(F.col("value"), F.col("_total")) * 100).alias("value"))


def stack(df: DataFrame, x: str, y: str, hue: str, aggregate: str | Callable = "sum", ratio: bool = False,
          levels: Sequence | None = None) -> DataFrame:
    """One column per hue level (all of them, or those asked for), missing cells 0, optionally as percent of the row."""
    cells = stack_cells(df, x, y, hue, aggregate, ratio)
    levels = list(levels) if levels is not None else sorted(r[0] for r in cells.select(hue).distinct().collect())   # they become columns
    return cells.groupBy(x).pivot(hue, levels).agg(F.first("value")).fillna(0)


def point(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Mean and standard error per group."""
    keys = _keys(x, hue)
    return _present(df, keys).groupBy(*keys).agg(
        F.avg(num(y)).alias("mean"), div(F.stddev_samp(num(y)), F.sqrt(F.count(num(y)))).alias("se"), F.count(num(y)).alias("n"))


def line(df: DataFrame, x: str, y: str, hue: str | None = None, level: float | None = None) -> DataFrame:
    """Mean per x (and hue); with ``level`` also its t interval ``lower, upper``."""
    keys = _keys(x, hue)
    data = _present(df, keys)
    out = data.groupBy(*keys).agg(F.avg(num(y)).alias("mean"), F.count(num(y)).alias("n"))
    if level is None:
        return out
    from statframe.operators.quality import mean_interval

    bounds = mean_interval(data, [y], keys, level).select(*keys, F.col("low").alias("lower"), F.col("high").alias("upper"))
    return core.attach(out, bounds, keys, "left")


def matrix(df: DataFrame, row: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A wide table as ``row, column, value`` cells."""
    cols = list(cols or [c for c in core.numeric_columns(df) if c != row])
    return df.select(F.col(row).alias("row"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), num(c).alias("value")) for c in cols])))


def lm(df: DataFrame, x: str, y: str, hue: str | None = None, col: str | None = None, row: str | None = None) -> DataFrame:
    """Slope, intercept and r² per facet."""
    keys = _keys(hue, col, row)
    a, b = num(y), num(x)
    return _present(df, keys).groupBy(*keys).agg(
        F.regr_count(a, b).alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"),
        F.regr_r2(a, b).alias("r2"))


# -------------------------------------------------------------------- scatter
def scatter(df: DataFrame, x: str, y: str, hue: str | None = None, cells: int = 200) -> DataFrame:
    """All rows as counts on a ``cells`` × ``cells`` lattice with the mean position of each cell."""
    keys = _keys(hue)
    r = core.moments_dict(df, [x, y])
    def place(c):
        lo, hi = r[c]["min"], r[c]["max"]
        return F.least(F.floor((num(c) - F.lit(lo)) / F.lit((hi - lo) / cells or 1.0)), F.lit(cells - 1)).cast("int")
    data = _present(df, keys).where(num(x).isNotNull() & num(y).isNotNull())
    return data.groupBy(*keys, place(x).alias("cell_x"), place(y).alias("cell_y")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(num(x)).alias("x"), F.avg(num(y)).alias("y"))


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of 2-D points, counter-clockwise, without collinear points."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def hull(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """Convex hull per group with at least 3 points.

    Every task reduces its rows to the hull of each group first; the hull of
    those few vertices is the hull of all rows.
    """
    data = _present(df, _keys(hue)).select(
        (col_of(hue).cast("string") if hue else F.lit("all")).alias("hue"), num(x).alias("x"), num(y).alias("y")).dropna()

    def shrink(frames):
        best: dict[str, np.ndarray] = {}
        for pdf in frames:
            for g, part in pdf.groupby("hue"):
                pts = part[["x", "y"]].to_numpy()
                best[g] = _hull(np.vstack([best[g], pts]) if g in best else pts)
        for g, pts in best.items():
            yield pd.DataFrame({"hue": g, "x": pts[:, 0], "y": pts[:, 1]})

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = _hull(pdf[["x", "y"]].to_numpy())
        if len(pts) < 3:
            return pd.DataFrame({"hue": [], "vertex": [], "x": [], "y": []})
        return pd.DataFrame({"hue": pdf["hue"].iloc[0], "vertex": range(len(pts)), "x": pts[:, 0], "y": pts[:, 1]})

    few = data.mapInPandas(shrink, "hue string, x double, y double")
    return few.groupBy("hue").applyInPandas(close, "hue string, vertex int, x double, y double")


def pair(df: DataFrame, cols: Sequence[str] | None = None, hue: str | None = None, cells: int = 50) -> DataFrame:
    """``x_var, y_var, [hue], cell_x, cell_y, count`` for every pair of columns; a diagonal pair is a histogram."""
    cols = list(cols or core.numeric_columns(df))
    keys = _keys(hue)
    r = core.moments_dict(df, cols)
    def place(c):
        lo, hi = r[c]["min"], r[c]["max"]
        return F.least(F.floor((num(c) - F.lit(lo)) / F.lit((hi - lo) / cells or 1.0)), F.lit(cells - 1)).cast("int")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    placed = _present(df, keys).select(*keys, *[place(c).alias(f"_p{i}") for i, c in enumerate(cols)])
    spot = {c: F.col(f"_p{i}") for i, c in enumerate(cols)}
    long = placed.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(a).alias("x_var"), F.lit(b).alias("y_var"), spot[a].alias("cell_x"), spot[b].alias("cell_y")) for a, b in pairs])))
    return long.where(F.col("cell_x").isNotNull() & F.col("cell_y").isNotNull()).groupBy(
        "x_var", "y_var", *keys, "cell_x", "cell_y").agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------- model coefficients
def beta_bars(coefficients: DataFrame, value: str = "beta") -> DataFrame:
    """Coefficients sorted by size with their sign (``beta`` of OLS, ``odds_ratio`` of logit)."""
    base = 1.0 if value == "odds_ratio" else 0.0
    out = coefficients.where(F.col(value).isNotNull()).select(
        "variable", value, F.when(F.col(value) > base, "+").otherwise("-").alias("sign"))
    return out.orderBy(F.abs(F.col(value)).desc(), "variable")


