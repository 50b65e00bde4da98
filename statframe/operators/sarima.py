"""Seasonal ARIMA in product form by the conditional sum of squares.

phi(B) Phi(B^s) w_t = theta(B) Theta(B^s) e_t for the differenced series w: the residuals before the first max lag are taken as 0, the others
follow from the recursion e_t = u_t - sum of m_k e_{t-k}. Gauss-Newton steps with a damping factor (Levenberg-Marquardt) lower their sum of squares.

A series of one block is fitted by one task. A longer one is cut into blocks: each block's recursion is an affine map of the residuals before it
(its last K ones), maps are composed along the series from one small row per block, and every block then runs from its true state and returns
sums of products. A step is two passes, however long the series.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statframe.operators import core
from statframe.operators.timeseries import _attach, _key_schema, _keyed, _orders, transform

#: Steps at most, and the relative fall of the sum of squares below which they end.
STEPS = 60
TOLERANCE = 1e-10
#: Half the step of the difference quotients by which residuals are derived.
NUDGE = 1e-6
#: Weights of the inverted model kept for residuals of forecasts, and the size at which they end.
WEIGHTS, LEAST_WEIGHT = 400, 1e-10


def polynomial(plain: Sequence[float], seasonal: Sequence[float], s: int) -> np.ndarray:
    """Coefficients of (1 + sum of plain_i B^i)(1 + sum of seasonal_j B^(s j)), the first 1."""
    spread = np.zeros(len(seasonal) * s + 1)
    spread[0] = 1.0
    if len(seasonal):
        spread[s::s] = seasonal
    return np.convolve(np.r_[1.0, plain], spread)


class Model:
    """Orders and the two sides of the equation for parameters phi, theta, Phi, Theta in a row."""

    def __init__(self, p: int, q: int, sp: int, sq: int, s: int):
        self.cuts = np.cumsum([p, q, sp, sq])
        self.s, self.size = s, p + q + sp + sq
        self.reach, self.state = p + sp * s, q + sq * s      # rows before the first residual, residuals that matter later

    def sides(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        phi, theta, sphi, stheta = np.split(np.asarray(beta, float), self.cuts[:-1])
        return polynomial(-phi, -sphi, self.s), polynomial(theta, stheta, self.s)

    def nudged(self, beta: np.ndarray) -> np.ndarray:
        """The parameters themselves, then each moved up and down a little."""
        step = NUDGE * np.eye(self.size)
        return np.concatenate([beta[None], beta + step, beta - step])

    def invertible(self, beta: np.ndarray) -> bool:
        ma = self.sides(beta)[1]
        roots = np.roots(ma[::-1]) if len(ma) > 1 and np.any(ma[1:]) else np.zeros(0)
        return bool(np.isfinite(beta).all() and (np.abs(roots) > 1.0 + 1e-6).all())

    def residuals(self, x: np.ndarray, betas: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Residuals of ``x`` from row ``reach`` on, a column for each row of ``betas``; ``before``: the ``state`` residuals before, oldest first."""
        sides = [self.sides(b) for b in betas]
        n = len(x) - self.reach
        u = np.column_stack([sum(c * x[self.reach - k:len(x) - k] for k, c in enumerate(ar) if c or not k) for ar, _ in sides])
        ma = np.stack([m for _, m in sides])
        lags = np.flatnonzero(np.abs(ma[:, 1:]).sum(axis=0)) + 1
        if not len(lags) or not n:
            return u
        e = np.zeros((self.state + n, len(betas)))
        if before is not None:
            e[:self.state] = before
        weight = ma[:, lags].T
        for t in range(n):
            e[self.state + t] = u[t] - (weight * e[self.state + t - lags]).sum(axis=0)
        return e[self.state:]

    def homogeneous(self, betas: np.ndarray, n: int) -> np.ndarray:
        """What ``n`` rows make of the states before them: a matrix for each row of ``betas``."""
        out = []
        for b in betas:
            step = np.zeros((self.state, self.state))
            step[:-1, 1:] = np.eye(self.state - 1)
            step[-1, ::-1] = -self.sides(b)[1][1:]
            out.append(np.linalg.matrix_power(step, n))
        return np.stack(out)

    def products(self, e: np.ndarray) -> np.ndarray:
        """Cross products of the residuals and their derivatives: the residuals first."""
        k = self.size
        d = (e[:, 1:1 + k] - e[:, 1 + k:]) / (2 * NUDGE)
        z = np.column_stack([e[:, 0], d])
        return z.T @ z


class Search:
    """The damped steps of one series; what it knows is a flat list of numbers, so it travels as a column."""

    def __init__(self, model: Model, state: Sequence[float] | None = None):
        self.model, k = model, model.size
        if state is None:
            self.trial, self.best, self.lam, self.low = self.first(), self.first(), 1e-2, math.inf
            self.g, self.done = np.zeros((k + 1, k + 1)), 0.0
        else:
            v = np.asarray(state, float)
            self.trial, self.best, (self.lam, self.low, self.done), self.g = v[:k], v[k:2 * k], v[2 * k:2 * k + 3], v[2 * k + 3:].reshape(k + 1, k + 1)

    def first(self) -> np.ndarray:
        """Starts apart from each other, as equal lags on both sides would cancel out."""
        c = self.model.cuts
        return np.r_[np.full(c[0], 0.3), np.full(c[1] - c[0], -0.1), np.full(c[2] - c[1], 0.3), np.full(c[3] - c[2], -0.1)] / max(1, self.model.size)

    def flat(self) -> list[float]:
        return [float(v) for v in np.concatenate([self.trial, self.best, [self.lam, self.low, self.done], self.g.ravel()])]

    def take(self, g: np.ndarray) -> None:
        """Judge the trial by its products, then set the next one."""
        total = float(g[0, 0])
        if math.isfinite(total) and total < self.low:
            fell = (self.low - total) / max(total, 1e-300)
            self.best, self.low, self.g, self.lam = self.trial, total, g, max(self.lam / 5, 1e-12)
            if fell < TOLERANCE:
                self.done = 1.0
        else:
            self.lam *= 8
        if not self.model.size or self.lam > 1e10:
            self.done = 1.0
        while not self.done:
            own = self.g[1:, 1:]
            damped = own + self.lam * np.diag(np.maximum(np.diag(own), 1e-12))
            self.trial = self.best - np.linalg.lstsq(damped, self.g[1:, 0], rcond=None)[0]
            if self.model.invertible(self.trial):
                break
            self.lam *= 8
            self.done = float(self.lam > 1e10)


def css(x: np.ndarray, model: Model, beta: np.ndarray) -> float:
    """Conditional sum of squares."""
    e = model.residuals(np.asarray(x, float), np.asarray(beta, float)[None])
    return float(e[:, 0] @ e[:, 0])


def fit_one(x: np.ndarray, model: Model) -> Search:
    """All steps over one series."""
    search = Search(model)
    for _ in range(STEPS):
        if search.done:
            break
        with np.errstate(all="ignore"):
            search.take(model.products(model.residuals(x, model.nudged(search.trial))))
    return search


def _row(model: Model, beta: np.ndarray, low: float, n: int, scale: float) -> list:
    ar, ma = model.sides(beta)
    weights = np.zeros(WEIGHTS + 1)                          # ar / ma as a power series: residuals from the series alone
    for t in range(WEIGHTS + 1):
        weights[t] = (ar[t] if t < len(ar) else 0.0) - sum(ma[k] * weights[t - k] for k in range(1, min(t, len(ma) - 1) + 1))
    big = np.flatnonzero(np.abs(weights) > LEAST_WEIGHT)
    weights = -weights[1:max(2, int(big[-1]) + 1)]
    sigma2, k = low / max(n, 1) * scale ** 2, model.size + 1
    base = n * math.log(sigma2) if sigma2 > 0 and n else float("nan")
    a, m = np.flatnonzero(ar[1:]) + 1, np.flatnonzero(ma[1:]) + 1
    parts = [v.tolist() for v in np.split(np.asarray(beta, float), model.cuts[:-1])]
    return [k, n, sigma2, base + 2 * k, base + math.log(max(n, 1)) * k, a.tolist(), (-ar[a]).tolist(), m.tolist(), ma[m].tolist(), weights.tolist(), *parts]


_OUT = ("p int, d int, q int, sp int, sd int, sq int, s int, params int, n long, sigma2 double, aic double, bic double, ar_lags array<int>, ar array<double>, "
        "ma_lags array<int>, ma array<double>, long_ar array<double>, phi array<double>, theta array<double>, seasonal_phi array<double>, seasonal_theta array<double>")
_ORDERS = ["p", "d", "q", "sp", "sd", "sq", "s"]


def refine(df: DataFrame, ts: str, value: str, orders: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Orders (``p, d, q, sp, sd, sq, s, log`` per series, as ``best_orders`` gives them) with the fitted product form.

    Columns: the orders, ``params, n`` (residuals), ``sigma2, aic, bic``, the coefficients ``phi, theta, seasonal_phi, seasonal_theta`` (signs:
    1 - phi B, 1 + theta B), and the expanded lags with ``long_ar``, so ``fitted``, ``forecast`` and ``score`` take the result as it is. No constant:
    difference or centre a series first. Missing values are left out before differencing; series shorter than the model are left out.
    """
    by, out = list(by), None
    for o in _orders(orders):
        same = functools.reduce(lambda a, b: a & b, [F.col(c) == o[c] for c in ("d", "sd", "s", "log")])
        mine = orders.where(same).select(*by, *_ORDERS)
        own = _attach(df.select(*by, ts, value), mine.select(*by), by) if by else df.select(ts, value)
        w = transform(own, ts, value, by, o["log"], o["d"], o["sd"], o["s"] or None)
        stats = w.groupBy(*by).agg(F.count(value).alias("_n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("_s"))
        full, keys = _keyed(_attach(_attach(w, stats, by), mine, by), by)
        full = core.checkpoint(full)
        one = _refine_short(full.where(F.col("_n") <= core.LIMITS.block_rows), keys, ts, value)
        if not (long := full.where(F.col("_n") > core.LIMITS.block_rows)).isEmpty():
            one = one.unionByName(_refine_long(core.checkpoint(long), keys, ts, value))
        one = (one if by else one.drop("_all")).withColumn("log", F.lit(o["log"]))
        out = one if out is None else out.unionByName(one)
    return out


def _model(r) -> Model:
    return Model(*(int(r[c]) for c in ("p", "q", "sp", "sq", "s")))


def _refine_short(full: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        r = pdf.iloc[0]
        model, scale = _model(r), r["_s"] or 1.0
        x = pdf[value].to_numpy(float) / scale
        n = len(x) - model.reach
        rows = []
        if n > model.size + 1:
            search = fit_one(x, model)
            rows.append([*[r[k] for k in keys], *[int(r[c]) for c in _ORDERS], *_row(model, search.best, search.low, n, scale)])
        return pd.DataFrame(rows, columns=[*keys, *[part.split()[0] for part in _OUT.split(", ")]])

    return full.groupBy(*keys).applyInPandas(run, _key_schema(full, keys) + ", " + _OUT)


def _products(cut: DataFrame, state: DataFrame, keys: list[str], schema: str, value: str) -> DataFrame:
    """``keys, g`` per block: products at each series' trial, from maps of the blocks and states composed along the series."""
    def part(pdf: pd.DataFrame):
        """The block's rows with their context, and the search."""
        pdf = pdf.sort_values("_pos")
        r = pdf.iloc[0]
        model = _model(r)
        x = pdf[value].to_numpy(float) / (r["_s"] or 1.0)
        own = np.flatnonzero(pdf["_own"].to_numpy() & (pdf["_pos"].to_numpy() > model.reach))
        search = Search(model, r["search"])
        return r, model, x[own[0] - model.reach:] if len(own) else x[:0], search, len(own)

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        r, model, x, search, n = part(pdf)
        betas = model.nudged(search.trial)
        with np.errstate(all="ignore"):
            e = model.residuals(x, betas) if n else np.zeros((0, len(betas)))
            tail = np.concatenate([np.zeros((max(0, model.state - n), len(betas))), e[len(e) - min(n, model.state):]])
            a = model.homogeneous(betas, n)
        return pd.DataFrame({**{k: [r[k]] for k in keys}, "_blk": [r["_blk"]], "a": [a.tobytes()], "v": [tail.tobytes()]})

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        now, out = None, []
        for a, v in zip(pdf["a"], pdf["v"]):
            tail = np.frombuffer(v)
            a = np.frombuffer(a)
            width = len(a) // max(1, len(tail)) if len(tail) else 0
            v, a = tail.reshape(width, -1), a.reshape(-1, width, width)
            now = np.zeros_like(v) if now is None else now
            out.append(now.tobytes())
            now = np.einsum("fij,jf->if", a, now) + v
        return pdf[[*keys, "_blk"]].assign(before=out)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        r, model, x, search, n = part(pdf)
        betas = model.nudged(search.trial)
        with np.errstate(all="ignore"):
            before = np.frombuffer(r["before"]).reshape(model.state, len(betas)) if model.state else None
            g = model.products(model.residuals(x, betas, before)) if n else np.zeros((model.size + 1,) * 2)
        return pd.DataFrame({**{k: [r[k]] for k in keys}, "g": [g.ravel().tolist()]})

    rows = core.attach(cut, state.select(*keys, "p", "q", "sp", "sq", "s", "_s", "search"), keys)
    found = rows.groupBy(*keys, "_blk").applyInPandas(maps, f"{schema}, _blk long, a binary, v binary")
    entered = core.checkpoint(found.groupBy(*keys).applyInPandas(states, f"{schema}, _blk long, before binary"))
    return core.attach(rows, entered, [*keys, "_blk"]).groupBy(*keys, "_blk").applyInPandas(products, f"{schema}, g array<double>")


def _refine_long(full: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Steps over series of several blocks: maps of the blocks, states composed along the series, products from the true states."""
    schema = _key_schema(full, keys)
    heads = core.checkpoint(full.groupBy(*keys).agg(*[F.first(c).alias(c) for c in (*_ORDERS, "_n", "_s")]))
    reach = heads.agg(F.max(F.col("p") + F.col("sp") * F.col("s"))).first()[0]
    cut = core.checkpoint(core.blocks(full.select(*keys, ts, value), keys, [ts], before=reach).df)

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(search=[Search(_model(r)).flat() for _, r in pdf.iterrows()])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in heads.schema if f.name not in keys)
    state = core.checkpoint(heads.groupBy(*keys).applyInPandas(start, f"{schema}, {kinds}, search array<double>"))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        search = Search(_model(r), r["search"])
        if not search.done:
            search.take(np.sum([np.asarray(g) for g in pdf["g"]], axis=0).reshape(search.g.shape))
        return pdf.iloc[:1].drop(columns="g").assign(search=[search.flat()])

    for _ in range(STEPS):
        size = F.col("p") + F.col("q") + F.col("sp") + F.col("sq")
        if state.where(F.get("search", 2 * size + 2) == 0).isEmpty():
            break
        summed = _products(cut, state, keys, schema, value)
        state = core.checkpoint(core.attach(summed, state, keys).groupBy(*keys).applyInPandas(step, f"{schema}, {kinds}, search array<double>"))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        model = _model(r)
        search = Search(model, r["search"])
        return pd.DataFrame([[*[r[k] for k in keys], *[int(r[c]) for c in _ORDERS], *_row(model, search.best, search.low, int(r["_n"]) - model.reach, r["_s"] or 1.0)]],
                            columns=[*keys, *[part.split()[0] for part in _OUT.split(", ")]])

    return state.groupBy(*keys).applyInPandas(finish, f"{schema}, {_OUT}")


def residual_sums(df: DataFrame, ts: str, value: str, beta: Sequence[float], order: Sequence[int], seasonal: Sequence[int] = (0, 0), s: int = 0,
                  by: Sequence[str] = ()) -> DataFrame:
    """``by…, n, css``: residuals and their conditional sum of squares of series as they are, for given coefficients phi, theta, Phi, Theta.

    ``order`` is (p, q), ``seasonal`` (P, Q). Any length: blocks are run from composed states.
    """
    by = list(by)
    model = Model(*order, *seasonal, s)
    if len(beta) != model.size:
        raise ValueError(f"{model.size} coefficients are needed")
    full, keys = _keyed(df.select(*by, ts, core.num(value).alias(value)).where(F.col(value).isNotNull()), by)
    schema = _key_schema(full, keys)
    search = Search(model)
    search.trial = np.asarray(beta, float)
    state = full.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, "n", *[F.lit(v).alias(c) for c, v in zip(("p", "q", "sp", "sq", "s"), (*order, *seasonal, s))],
                                                                     F.lit(1.0).alias("_s"), F.array(*[F.lit(v) for v in search.flat()]).alias("search"))
    state = core.checkpoint(state)
    cut = core.checkpoint(core.blocks(full, keys, [ts], before=model.reach).df)
    sums = _products(cut, state, keys, schema, value).groupBy(*keys).agg(F.sum(F.col("g")[0]).alias("css"))
    out = core.attach(state.select(*keys, F.greatest(F.col("n") - model.reach, F.lit(0)).alias("n")), sums, keys)
    return out if by else out.drop("_all")
