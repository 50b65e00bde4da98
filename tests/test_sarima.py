"""Product-form seasonal ARIMA: simulated series, long series in blocks, forecasts."""

import numpy as np
import pandas as pd
import pytest

from statframe.operators import core, sarima
from statframe.operators import timeseries as ts

TRUE = [0.6, 0.4, 0.5, -0.3]


def simulated(n, beta=TRUE, orders=(1, 1, 1, 1, 12), seed=1):
    model, r = sarima.Model(*orders), np.random.default_rng(seed)
    ar, ma = model.sides(np.array(beta))
    e = r.normal(size=n + 300)
    w = np.zeros(n + 300)
    for t in range(n + 300):
        w[t] = sum(ma[k] * e[t - k] for k in range(min(t, len(ma) - 1) + 1)) - sum(ar[k] * w[t - k] for k in range(1, min(t, len(ar) - 1) + 1))
    return w[300:]


def orders(spark, rows):
    return spark.createDataFrame([(*r, False) for r in rows], "k string, p int, d int, q int, sp int, sd int, sq int, s int, log boolean")


def test_coefficients_of_simulated_series_come_back(spark):
    w = simulated(3000)
    fit = sarima.fit_one(w, sarima.Model(1, 1, 1, 1, 12))
    assert np.abs(fit.best - TRUE).max() < 0.09 and fit.low <= sarima.css(w, fit.model, TRUE) and fit.done
    for j in range(4):                                       # no small move lowers the sum
        for step in (-1e-3, 1e-3):
            assert sarima.css(w, fit.model, fit.best + step * np.eye(4)[j]) >= fit.low - 1e-9


def test_polynomials_multiply():
    assert sarima.polynomial([-0.5], [-0.2], 4).tolist() == [1, -0.5, 0, 0, -0.2, 0.1] and sarima.polynomial([], [], 0).tolist() == [1]


def test_blocks_give_what_one_series_gives(spark, monkeypatch):
    pdf = pd.concat([pd.DataFrame({"k": k, "t": range(n), "v": simulated(n, seed=i)}) for i, (k, n) in enumerate((("long", 400), ("short", 90), ("tiny", 12)))])
    df = spark.createDataFrame(pdf)
    want = [("long", 1, 0, 1, 1, 0, 1, 12), ("short", 1, 0, 1, 0, 0, 0, 12), ("tiny", 1, 0, 1, 1, 0, 1, 12)]
    whole = sarima.refine(df, "t", "v", orders(spark, want), ["k"]).toPandas().set_index("k")
    sums = {r["k"]: (r["n"], r["css"]) for r in sarima.residual_sums(df, "t", "v", TRUE, (1, 1), (1, 1), 12, ["k"]).collect()}
    monkeypatch.setattr(core.LIMITS, "block_rows", 130)
    cut = sarima.refine(df, "t", "v", orders(spark, want), ["k"]).toPandas().set_index("k")
    again = {r["k"]: (r["n"], r["css"]) for r in sarima.residual_sums(df, "t", "v", TRUE, (1, 1), (1, 1), 12, ["k"]).collect()}
    assert set(whole.index) == set(cut.index) == {"long", "short"}
    for k in whole.index:
        for c in ("phi", "theta", "seasonal_phi", "seasonal_theta"):
            np.testing.assert_allclose(whole.loc[k, c], cut.loc[k, c], atol=1e-5)
        assert cut.loc[k, "sigma2"] == pytest.approx(whole.loc[k, "sigma2"], rel=1e-9)
    model = sarima.Model(1, 1, 1, 1, 12)
    for k, (n, total) in sums.items():
        x = pdf[pdf.k == k].v.to_numpy()
        assert n == max(0, len(x) - 13) == again[k][0]
        if n:
            assert total == pytest.approx(sarima.css(x, model, TRUE)) and again[k][1] == pytest.approx(total)


def test_the_fit_feeds_residuals_and_forecasts(spark):
    w = simulated(600, [0.7, 0.3], (1, 1, 0, 0, 0), 5)
    df = spark.createDataFrame(pd.DataFrame({"t": range(600), "v": 50 + np.cumsum(w)}))
    best = sarima.refine(df, "t", "v", orders(spark, [("x", 1, 1, 1, 0, 0, 0, 0)]).drop("k"))
    row = best.first()
    assert abs(row["phi"][0] - 0.7) < 0.12 and abs(row["theta"][0] - 0.3) < 0.15 and row["ar_lags"] == [1] and row["sigma2"] == pytest.approx(1, abs=0.15)
    resid = ts.fitted(df, "t", "v", best).toPandas()["resid"]
    assert resid.var() == pytest.approx(row["sigma2"], rel=0.05) and abs(np.corrcoef(resid[1:], resid[:-1])[0, 1]) < 0.1
    ahead = ts.forecast(df, "t", "v", best, 5).orderBy("step").toPandas()
    assert (ahead["lower"] < ahead["pred"]).all() and (ahead["pred"] < ahead["upper"]).all()
