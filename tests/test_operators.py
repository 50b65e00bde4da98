import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statframe.functions import dist
from statframe.operators import cluster, core, correlation, frames, hypothesis, logit, neighbours, ols, prep, quality
from statframe.operators import timeseries as ts
from statframe.plans import eda
from statframe.sources import io


def sdf(spark, pdf):
    return spark.createDataFrame(pdf)


# ----------------------------------------------------------------- quality
def test_summary_edges(spark):
    df = spark.createDataFrame([(5.0, 1.0, None)] * 9 + [(5.0, float("nan"), None)], "c double, v double, z double")
    r = {x["variable"]: x for x in quality.numerical_summary(df).collect()}
    assert r["c"]["std"] == 0 and r["c"]["skew"] is None and r["c"]["outliers"] == 0 and r["c"]["log_need"] == "none"
    assert r["v"]["count"] == 9 and r["z"]["count"] == 0 and r["z"]["mean"] is None
    by = quality.numerical_summary(df.withColumn("g", F.lit("a")), ["c"], by=["g"]).first()
    assert by["q50"] == 5.0 and by["outliers"] == 0


def test_categorical_ties_and_duplicates(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "s string")
    r = quality.categorical_summary(df, ["s"]).first()
    assert (r["count"], r["unique"], r["top"], r["freq"]) == (4, 2, "a", 2)
    assert quality.duplicate_report(df).first()["duplicates"] == 2
    with pytest.raises(KeyError):
        quality.categorical_summary(df, ["nope"])


def test_types_and_fill(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (None, "x")], "i int, s string")
    assert quality.set_type(df, as_category=["s"]).schema["s"].metadata == {"nominal": True}
    assert [r["i"] for r in prep.fill_missing(df, ["i"], "mean").collect()] == [1.0, 2.0, 1.5]
    assert [r["s"] for r in prep.fill_missing(df, ["s"], "mode").collect()] == ["x"] * 3
    assert prep.fill_missing(df, ["i", "s"], "drop").count() == 1
    with pytest.raises(ValueError):
        prep.fill_missing(df, ["i"], "guess")


# -------------------------------------------------------------- preparation
def test_log_round_trip_and_errors(spark):
    df = spark.createDataFrame([(1.0, 0.0, -3.0), (2.5, 4.0, 7.0)], "a double, b double, c double")
    out, recipe = prep.log_transform(df, ["a"], ["b"], ["c"])
    back = prep.inverse_log(out, recipe["log"], recipe["log1p"], recipe["reflect"]).collect()
    np.testing.assert_allclose([tuple(r) for r in back], [(1.0, 0.0, -3.0), (2.5, 4.0, 7.0)], atol=1e-12)
    with pytest.raises(ValueError):
        prep.log_transform(df, ["b"])


def test_fitted_models_save_load_and_stream(spark, tmp_path):
    pdf = pd.DataFrame({"a": np.arange(20.0), "b": np.r_[np.arange(19.0), 400.0]})
    df = sdf(spark, pdf)
    for model in (prep.Scaler(method="robust", inputCols=["a", "b"]).fit(df), prep.OutlierClipper(inputCols=["b"]).fit(df),
                  prep.fit_pca(df), prep.VifSelector(threshold=5.0).fit(df)):
        path = str(tmp_path / type(model).__name__)
        model.write().overwrite().save(path)
        again = type(model).load(path)
        assert again.transform(df).collect() == model.transform(df).collect()
    df.write.parquet(str(tmp_path / "in"))
    clip = prep.OutlierClipper(inputCols=["b"]).fit(df)
    q = (clip.transform(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
         .writeStream.format("memory").queryName("clipped").trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(spark.table("clipped").collect()) == sorted(clip.transform(df).collect())


def test_dummies_and_label(spark, tight):
    df = spark.createDataFrame([("b", "u"), ("a", "v"), ("c", "u"), (None, "v")], "s string, t string")
    out = prep.dummies(df, ["s", "t"])
    assert out.columns == ["t", "s_b", "s_c"]
    assert [(r["s_b"], r["s_c"]) for r in out.collect()] == [(1, 0), (0, 0), (0, 1), (0, 0)]
    assert sorted((r["s"] is None, r["s"]) for r in prep.label_encode(df, "s").where("s is not null").collect()) == [
        (False, 0), (False, 1), (False, 2)]


def test_vif_prunes_collinear(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=100)
    df = sdf(spark, pd.DataFrame({"a": a, "b": 2 * a, "c": rng.normal(size=100)}))
    out, dropped = prep.reduce_vif(df)
    assert out.columns == ["b", "c"] and dropped[0][0] == "a"
    assert correlation.vif(df).first()["vif"] == math.inf


# --------------------------------------------------------------------- tests
def test_two_samples_all_branches(spark):
    rng = np.random.default_rng(8)
    a, b, c = rng.normal(0, 1, 60), rng.normal(0.8, 1, 40), rng.normal(0.5, 4, 50)
    def frame(x, y):
        return sdf(spark, pd.DataFrame({"y": np.r_[x, y], "g": ["a"] * len(x) + ["b"] * len(y)}))
    r = hypothesis.two_sample(frame(a, b), "y", "g").first()
    sp = ((59 * a.var(ddof=1) + 39 * b.var(ddof=1)) / 98 * (1 / 60 + 1 / 40)) ** 0.5
    assert r["test"] == "Student t-test" and r["statistic"] == round((a.mean() - b.mean()) / sp, 4)
    assert hypothesis.two_sample(frame(a, c), "y", "g").first()["test"] == "Welch t-test"
    r = hypothesis.two_sample(frame(np.exp(3 * a), np.exp(3 * b)), "y", "g").first()
    u = sum((np.exp(3 * x) > np.exp(3 * b)).sum() for x in a)
    assert r["test"] == "Mann-Whitney U test" and r["statistic"] == u
    with pytest.raises(ValueError):
        hypothesis.two_sample(frame(a, []), "y", "g")


def test_paired_and_one_sample(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(5, 1, 30)
    df = sdf(spark, pd.DataFrame({"x": x, "z": x + rng.normal(.5, .3, 30)}))
    r = hypothesis.one_sample(df, "x", 4.5).first()
    assert r["test"] == "One-sample t-test" and r["statistic"] == round((x.mean() - 4.5) / (x.std(ddof=1) / 30 ** .5), 4)
    assert hypothesis.paired(df, "x", "z").first()["test"] == "Paired t-test"
    few = sdf(spark, pd.DataFrame({"x": [0.0] * 6, "z": [1.0, 2.0, -3.0, 4.0, 5.0, 60.0]}))
    r = hypothesis.paired(few, "x", "z").first()
    assert r["test"].startswith("Wilcoxon") and r["statistic"] == 3.0 and r["p_value"] == round(2 * 5 / 64, 4)


def test_anova_two_way_unbalanced(spark):
    rng = np.random.default_rng(2)
    rows = [(a, b, rng.normal() + (a == "y") * 1.5 + (b == "q") * .5) for a, b, n in
            (("x", "p", 5), ("x", "q", 9), ("y", "p", 12), ("y", "q", 7)) for _ in range(n)]
    pdf = pd.DataFrame(rows, columns=["a", "b", "v"])
    got = {r["source"]: r for r in hypothesis.anova2(sdf(spark, pdf), "v", ["a", "b"]).collect()}
    one, A, B = np.ones(len(pdf)), (pdf.a == "y").to_numpy(float), (pdf.b == "q").to_numpy(float)
    def rss(*cols):
        x = np.column_stack(cols)
        return ((pdf.v - x @ np.linalg.lstsq(x, pdf.v, rcond=None)[0]) ** 2).sum()
    full, both = rss(one, A, B, A * B), rss(one, A, B)
    assert got["a"]["ss"] == pytest.approx(rss(one, B) - both)        # type II
    assert got["b"]["ss"] == pytest.approx(rss(one, A) - both)
    assert got["a:b"]["ss"] == pytest.approx(both - full)
    assert got["Residual"]["ss"] == pytest.approx(full)


def _two_way_by_matrix(pdf, a, b, hc3):
    """Type II statistics by one matrix over rows: the additive model's contrasts, in units of the residual variance or by HC3."""
    x = [pd.get_dummies(pdf[c], dtype=float).to_numpy() for c in (a, b)]
    cell = pd.get_dummies(pdf[a].astype(str) + "|" + pdf[b].astype(str), dtype=float).to_numpy()
    y, n = pdf.v.to_numpy(float), cell.sum(axis=0)
    mean = cell.T @ y / n
    e = y - cell @ mean
    rss, free = e @ e, len(y) - cell.shape[1]
    var = (cell.T @ (e / (1 - 1 / (cell @ n))) ** 2) / n ** 2 if hc3 else rss / free / n
    rows = [c.argmax(axis=0) for c in (cell, x[0], x[1])]
    za, zb = (np.stack([z[r] for r in rows[0]]) for z in x)

    def chi2(*parts):
        z = np.column_stack(parts) / np.sqrt(var)[:, None]
        m = mean / np.sqrt(var)
        return ((m - z @ np.linalg.lstsq(z, m, rcond=None)[0]) ** 2).sum(), np.linalg.matrix_rank(z)

    (sa, ra), (sb, rb), (sab, rab) = chi2(za), chi2(zb), chi2(za, zb)
    out = {a: (sb - sab, rab - rb), b: (sa - sab, rab - ra), f"{a}:{b}": (sab, cell.shape[1] - rab)}
    return {k: (s * rss / free, d) for k, (s, d) in out.items() if d}, rss, free


@pytest.mark.parametrize("wide", [0.0, 3.0])
@pytest.mark.parametrize("design", ["full", "gaps", "two parts"])
def test_anova_two_way_is_one_rule_at_every_size(spark, monkeypatch, wide, design):
    rng = np.random.default_rng(12)
    cells = [(i, j) for i in range(6) for j in range(4) if design == "full" or design == "gaps" and (i * j) % 5 != 4 or design == "two parts" and (i < 3) == (j < 2)]
    pdf = pd.DataFrame([(f"a{i}", j, i * .1 + j * .2 + rng.normal() * (1 + wide * i)) for i, j in cells for _ in range(rng.integers(8, 30))], columns=["a", "b", "v"])
    for between in (["a", "b"], ["b", "a"]):
        want, rss, free = _two_way_by_matrix(pdf, *between, wide > 0)
        for most in (200_000, 0):                            # on arrays, and with every vector a table
            monkeypatch.setattr(core.LIMITS, "collect_rows", most)
            got = hypothesis.anova2(sdf(spark, pdf), "v", between).toPandas().set_index("source")
            assert ("HC3" in got["test"].iloc[0]) == (wide > 0) and list(got.index) == [*want, "Residual"]
            assert got.loc["Residual", "ss"] == pytest.approx(rss) and got.loc["Residual", "df"] == free
            for k, (ss, df) in want.items():
                assert got.loc[k, "df"] == df and got.loc[k, "ss"] == pytest.approx(ss, rel=1e-6) and got.loc[k, "f"] == pytest.approx(ss / df / (rss / free), rel=1e-6)


def test_anova_two_way_hc3_needs_spread_in_every_cell(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame([(i, j, rng.normal() * (1 + 4 * i)) for i in range(3) for j in range(3) for _ in range(20)] + [(3, j, 1.0 + j) for j in range(3)], columns=["a", "b", "v"])
    got = hypothesis.anova2(sdf(spark, pdf), "v", ["a", "b"]).toPandas().set_index("source")
    assert "HC3" in got["test"].iloc[0] and got.loc[["a", "b", "a:b"], "f"].isna().all() and got.loc["a:b", "df"] == 6 and got.loc["Residual", "df"] == 171


def test_anova_two_way_of_two_thousand_by_two_thousand_levels(spark, monkeypatch):
    monkeypatch.setattr(core.LIMITS, "collect_rows", 1000)     # every vector is a table
    df = spark.range(60_000).selectExpr("pmod(xxhash64(id, 1), 2000) as a", "pmod(xxhash64(id, 2), 2000) as b").distinct()
    df = df.crossJoin(spark.range(3).withColumnRenamed("id", "k")).selectExpr("a", "b", "pmod(xxhash64(a, b, k), 1000) / 100 + a * 0.001 as v")
    got = hypothesis.anova2(df, "v", ["a", "b"]).toPandas().set_index("source")
    pdf = df.toPandas()
    cell = pdf.groupby(["a", "b"]).v.agg(["size", "mean"]).reset_index()
    parts = 1                                                # 60,000 random cells link all levels
    assert list(got["df"]) == [cell.a.nunique() - parts, cell.b.nunique() - parts, len(cell) - cell.a.nunique() - cell.b.nunique() + parts, len(pdf) - len(cell)]
    fit = np.zeros(len(cell))                                # the additive fit by alternating means
    for _ in range(200):
        fit += (cell["mean"] - fit).groupby(cell.a).transform("mean")
        fit += (cell["mean"] - fit).groupby(cell.b).transform("mean")
    if "HC3" not in got["test"].iloc[0]:
        assert got.loc["a:b", "ss"] == pytest.approx(3 * ((cell["mean"] - fit) ** 2).sum(), rel=1e-8)
        only_b = cell["mean"] - cell.groupby("b")["mean"].transform("mean")
        assert got.loc["a", "ss"] == pytest.approx(3 * (only_b ** 2).sum() - got.loc["a:b", "ss"], rel=1e-8)


def test_anova_two_way_of_many_cells(spark):
    df = spark.range(4 * 200 * 60).selectExpr("id % 200 as a", "floor(id / 200) % 60 as b", "cast(xxhash64(id) % 1000 as double) / 100 + (id % 200) * 0.01 as v")
    got = {r["source"]: r for r in hypothesis.anova2(df, "v", ["a", "b"]).collect()}
    pdf = df.toPandas()
    m, ga, gb = pdf.v.mean(), pdf.groupby("a").v.mean(), pdf.groupby("b").v.mean()      # balanced: sums of squares of the margins
    assert got["a"]["ss"] == pytest.approx(240 * ((ga - m) ** 2).sum()) if "HC3" not in got["a"]["test"] else got["a"]["ss"] > 0
    assert got["b"]["df"] == 59 and got["a:b"]["df"] == 199 * 59 and got["Residual"]["df"] == 36000
    assert got["Residual"]["ss"] == pytest.approx(((pdf.v - pdf.groupby(["a", "b"]).v.transform("mean")) ** 2).sum())
    assert "HC3" in got["a"]["test"] or got["b"]["ss"] == pytest.approx(800 * ((gb - m) ** 2).sum())


def test_posthoc_by_segment_equals_single(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"s": np.repeat(["m", "n"], 60), "g": list("abc") * 40, "y": rng.normal(size=120)})
    by = {(r["s"], r["a"], r["b"]): r["t"] for r in hypothesis.posthoc(sdf(spark, pdf), "y", "g", ["s"]).collect()}
    for s in "mn":
        for r in hypothesis.posthoc(sdf(spark, pdf[pdf.s == s]), "y", "g").collect():
            assert by[s, r["a"], r["b"]] == pytest.approx(r["t"])


def test_chi_square_branches(spark):
    def table(cells):
        return spark.createDataFrame([(i, j) for (i, j), n in cells.items() for _ in range(n)], "x int, y int")
    r = hypothesis.chi2_table(table({(0, 0): 2, (0, 1): 18, (1, 0): 2}), "x", "y").first()
    assert r["test"] == "Fisher's exact test" and r["p_value"] == pytest.approx(0.025974) and r["chi2"] is None
    r = hypothesis.chi2_table(table({(0, 0): 30, (0, 1): 25, (1, 0): 29, (1, 1): 40}), "x", "y").first()
    assert r["dof"] == 1 and r["test"].startswith("Chi-square")
    g = hypothesis.chi2_gof(table({(0, 0): 30, (1, 0): 10, (2, 0): 20}), "x", [.5, .25, .25]).first()
    assert g["chi2"] == pytest.approx(0 + 25 / 15 + 25 / 15, abs=1e-4)


def test_correlation_pearson_branch_and_ranks(spark, tight):
    rng = np.random.default_rng(10)
    x = rng.normal(size=120)
    pdf = pd.DataFrame({"x": x, "y": x + rng.normal(size=120), "z": np.round(np.exp(2 * x), 1)})
    got = {(r["x"], r["y"]): r for r in correlation.correlation_pairs(sdf(spark, pdf)).collect()}
    assert got["x", "y"]["method"] == "Pearson" and got["x", "y"]["coef"] == round(pdf.x.corr(pdf.y), 4)
    assert got["x", "z"]["method"] == "Spearman" and got["x", "z"]["coef"] == round(pdf.x.rank().corr(pdf.z.rank()), 4)
    s = correlation.correlation_summary(correlation.correlation_pairs(sdf(spark, pdf)), ["Strong"]).collect()
    assert s[0]["count"] >= 1 and {r["variable"] for r in s} == {"x", "y", "z"}


# ---------------------------------------------------------------- regression
@pytest.fixture(scope="module")
def reg():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(150, 3)) + [10, 0, -5]
    return pd.DataFrame({"y": 4 + x @ [2.0, -1.0, 0.0] + rng.normal(size=150) * (1 + np.abs(x[:, 1])), "a": x[:, 0],
                         "b": x[:, 1], "c": x[:, 2], "i": np.arange(150)})


def test_ols_against_numpy(spark, reg):
    m = ols.fit(sdf(spark, reg), "y", ["a", "b", "c"])
    x = np.column_stack([np.ones(150), reg[["a", "b", "c"]]])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ reg.y
    e = reg.y - x @ beta
    np.testing.assert_allclose(m.beta, beta, rtol=1e-9)
    np.testing.assert_allclose(np.sqrt(np.diag(m.cov)), np.sqrt(np.diag(inv) * (e @ e) / 146), rtol=1e-8)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    meat = (x * ((e / (1 - h)) ** 2).to_numpy()[:, None]).T @ x
    np.testing.assert_allclose(m.hc3_cov(), inv @ meat @ inv, rtol=1e-7)
    fitted = x @ beta
    x2 = np.column_stack([x, fitted ** 2])
    rss1 = ((reg.y - x2 @ np.linalg.lstsq(x2, reg.y, rcond=None)[0]) ** 2).sum()
    assert m.reset()["statistic"] == pytest.approx((e @ e - rss1) / (rss1 / 145), rel=1e-5)
    e2 = e ** 2
    r2 = 1 - ((e2 - x @ (inv @ x.T @ e2)) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum()
    assert m.breusch_pagan()["lm"] == pytest.approx(150 * r2)
    assert m.durbin_watson(["i"])["statistic"] == pytest.approx((np.diff(e) ** 2).sum() / (e @ e))
    z = np.sort((e - e.mean()) / e.std(ddof=1))
    cdf = np.array([dist.norm_cdf(v) for v in z])
    d = max((np.arange(1, 151) / 150 - cdf).max(), (cdf - np.arange(150) / 150).max())
    assert m.normality()["statistic"] == pytest.approx(d)
    assert [r["variable"] for r in ols.backward(sdf(spark, reg), "y", ["a", "b", "c"]).coefficients(intercept=False).collect()] == ["a", "b"]


def test_ols_edges(spark, reg):
    with pytest.raises(ValueError):
        ols.fit(spark.createDataFrame([(1.0, None), (2.0, 3.0), (3.0, 4.0)], "y double, x double"), "y")
    line = ols.fit(spark.createDataFrame([(2.0 * i + 1, float(i)) for i in range(9)], "y double, x double"), "y")
    assert line.r2 == pytest.approx(1.0) and line.beta == pytest.approx([1.0, 2.0])
    table, best = ols.compare({"full": ols.fit(sdf(spark, reg), "y", ["a", "b", "c"]), "short": ols.fit(sdf(spark, reg), "y", ["c"])})
    assert best.x == ["a", "b", "c"] and table.first()["gap_pct"] == 0.0


def test_prepared_ols_inverts_log(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(1, 4, 200)
    df = sdf(spark, pd.DataFrame({"y": np.exp(x + rng.normal(0, .1, 200)), "x": x, "k": np.tile(["u", "v", "w", "u"], 50)}))
    m = ols.prepared_fit(df, "y", log=True)
    assert m.transform["y"] == "log" and ols.original_errors(m)["R2_ORIGINAL"] > 0.9
    assert {r["unit"] for r in m.effects().collect()} == {"%"}


def test_logit_against_numpy(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(300, 2)) * [1, 50] + [0, 1000]
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.3 + x[:, 0] - 0.02 * (x[:, 1] - 1000))))).astype(int)
    df = sdf(spark, pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1]}))
    m = logit.fit(df, "y")
    X, beta = np.column_stack([np.ones(300), x]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ beta))
        beta = beta + np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X, X.T @ (y - p))
    np.testing.assert_allclose(m.beta, beta, rtol=1e-6)
    info = (X * (p * (1 - p))[:, None]).T @ X
    np.testing.assert_allclose(m.se, np.sqrt(np.diag(np.linalg.inv(info))), rtol=1e-5)
    assert m.llf == pytest.approx((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
    old, core.LIMITS.product_sums = core.LIMITS.product_sums, 2      # the sums of products in several jobs are the same sums
    np.testing.assert_allclose(logit.fit(df, "y").beta, m.beta, rtol=1e-12)
    core.LIMITS.product_sums = old
    with pytest.raises(ValueError, match="separation"):
        logit.fit(spark.createDataFrame([(int(v > 0), float(v)) for v in range(-10, 11)], "y int, x double"), "y")
    auc = np.mean([(p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])])
    assert logit.performance(m.scored(), "y", "p").first()["auc"] == pytest.approx(auc)


def test_fix_linearity_finds_square(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0.5, 6, 3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(2 - (x - 3) ** 2)))).astype(int)
    m = logit.fix_linearity(sdf(spark, pd.DataFrame({"y": y, "x": x})), "y")
    assert m.recipe["x"]["method"] == "square" and m.history[0]["adopted"]


# --------------------------------------------------------------- time series
def panel(n=90, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for k in ("one", "two"):
        t = pd.date_range("2020-01-01", periods=n, freq="D")
        v = 50 + 0.3 * np.arange(n) + 5 * np.sin(2 * np.pi * np.arange(n) / 12) + rng.normal(size=n)
        rows.append(pd.DataFrame({"k": k, "t": t, "v": v}))
    return pd.concat(rows, ignore_index=True)


@pytest.mark.parametrize("small", [10_000, 20])
def test_series_windows_in_blocks(spark, tight, small):
    tight.small_rows = small
    tight.block_rows = 10_000 if small > 20 else 30
    pdf = panel()
    df = sdf(spark, pdf).repartition(4)
    roll = ts.rolling(df, "t", "v", 7, ["k"]).toPandas()
    ew = ts.smooth(df, "t", "v", [3], ["k"], "ewm").toPandas()
    tr = ts.transform(df, "t", "v", ["k"], diff=1, seasonal_diff=1, period=12).toPandas()
    ac = ts.acf(df, "t", "v", ["k"], 12).toPandas()
    ad = ts.adf(df, "t", "v", ["k"]).toPandas()
    dec = ts.decompose(df, "t", "v", 12, ["k"], "additive").toPandas()
    for k, part in pdf.groupby("k"):
        v = part["v"].reset_index(drop=True)
        get = lambda d, c: d[d["k"] == k].sort_values("t")[c].to_numpy()
        np.testing.assert_allclose(get(roll, "rolling_std"), v.rolling(7).std(), rtol=1e-9)
        np.testing.assert_allclose(get(ew, "ewm_3"), v.ewm(span=3).mean(), rtol=1e-9)
        np.testing.assert_allclose(get(tr, "v"), v.diff().diff(12).dropna(), rtol=1e-9, atol=1e-9)
        x = v - v.mean()
        want = [(x[:-j] * x.shift(-j)[:-j]).sum() / (x * x).sum() for j in range(1, 5)]
        np.testing.assert_allclose(ac[ac.k == k].sort_values("lag")["acf"][:4], want, rtol=1e-9)
        w = np.r_[0.5, np.ones(11), 0.5] / 12
        np.testing.assert_allclose(get(dec, "trend")[6:-6], np.convolve(v, w, "valid"), rtol=1e-9)
        tau, lag = adf_reference(v.to_numpy())
        row = ad[ad.k == k].iloc[0]
        assert row["used_lag"] == lag and row["statistic"] == pytest.approx(tau, rel=1e-6)


def adf_reference(x):
    top = min(int(np.ceil(12 * (len(x) / 100) ** .25)), len(x) // 2 - 2)
    d = np.diff(x)
    def fit(k, skip):
        t = np.arange(skip, len(d))
        X = np.column_stack([x[t], *[d[t - j] for j in range(1, k + 1)], np.ones(len(t))])
        b, *_ = np.linalg.lstsq(X, d[t], rcond=None)
        e = d[t] - X @ b
        return b, e @ e, X
    aic = [len(d[top:]) * np.log(fit(k, top)[1] / len(d[top:])) + 2 * (k + 2) for k in range(top + 1)]
    k = int(np.argmin(aic))
    b, rss, X = fit(k, k)
    return b[0] / np.sqrt(rss / (len(X) - X.shape[1]) * np.linalg.inv(X.T @ X)[0, 0]), k


def test_adf_verdicts(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(size=500)
    walk, ar = np.cumsum(e), np.zeros(500)
    for i in range(1, 500):
        ar[i] = 0.5 * ar[i - 1] + e[i]
    df = sdf(spark, pd.DataFrame({"k": ["walk"] * 500 + ["ar"] * 500, "t": list(range(500)) * 2, "v": np.r_[walk, ar]}))
    got = {r["k"]: r["stationary"] for r in ts.adf(df, "t", "v", ["k"]).collect()}
    assert got == {"walk": False, "ar": True}
    steps = ts.adf_differences(df.where("k = 'walk'").select("t", "v"), "t", "v").collect()
    assert [r["advice"] for r in steps] == ["", "stop here", "over-differenced"]


def test_pacf_of_ar1(spark):
    rng = np.random.default_rng(7)
    v = np.zeros(2000)
    for i in range(1, 2000):
        v[i] = 0.7 * v[i - 1] + rng.normal()
    got = ts.acf(sdf(spark, pd.DataFrame({"t": np.arange(2000), "v": v})), "t", "v").orderBy("lag").collect()
    assert got[0]["pacf"] == pytest.approx(0.7, abs=0.05) and abs(got[1]["pacf"]) < 0.06 and got[0]["p"] == 1


@pytest.mark.parametrize("block", [10_000, 60])
def test_arima_flow(spark, tight, block):
    tight.block_rows, tight.small_rows = block, 10_000
    rng = np.random.default_rng(9)
    v = np.zeros(400)
    for i in range(1, 400):
        v[i] = 0.8 * v[i - 1] + rng.normal()
    df = sdf(spark, pd.DataFrame({"t": np.arange(400), "v": v}))
    grid = ts.arima_grid(df, "t", "v", p=2, d=0, q=1).orderBy("place").collect()
    assert grid[0]["p"] >= 1 and grid[0]["sigma2"] == pytest.approx(1.0, abs=0.2)
    one = ts.arima_grid(df, "t", "v", p=1, d=0, q=0).where("p = 1").drop("place")
    phi = one.first()["ar"][0]
    assert phi == pytest.approx(0.8, abs=0.07)
    f = ts.forecast(df, "t", "v", one, 3).orderBy("step").collect()
    np.testing.assert_allclose([r["pred"] for r in f], [v[-1] * phi ** h for h in (1, 2, 3)], rtol=1e-6)
    assert f[2]["upper"] - f[2]["lower"] > f[0]["upper"] - f[0]["lower"]
    s = {r["target"]: r["rmse"] for r in ts.score(ts.fitted(df, "t", "v", one), "t", "v", "pred").collect()}
    assert s["model"] < s["naive"]


def test_regular_grid_and_split(spark):
    df = sdf(spark, pd.DataFrame({"t": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-05"]), "v": [1.0, 2.0, 3.0]}))
    assert [r["v"] for r in ts.regular_grid(df, "t", "1 day").orderBy("t").collect()] == [1.0, 2.0, None, None, 3.0]
    assert [r["n"] for r in ts.split_report(sdf(spark, pd.DataFrame({"t": range(11), "v": range(11)})), "t", "v").collect()] == [3, 3, 3]


# ---------------------------------------------------------------- clustering
def blobs(seed=0):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, .3, (50, 2)) for c in ((0, 0), (5, 0), (0, 5))] + [[[9, 9], [-9, 9], [9, -9], [-9, -9], [4, 12]]])
    x = np.vstack([x, np.repeat([[0.0, 0.0]], 80, axis=0)])          # a hot point
    return pd.DataFrame({"id": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1]})


def brute_dbscan(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = (d <= eps).sum(1) >= m
    label, n = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] >= 0:
                    continue
                label[j] = n
                if core[j]:
                    todo += [q for q in np.flatnonzero(d[j] <= eps) if label[q] < 0]
            n += 1
    return label, core


@pytest.mark.parametrize("eps", [0.12, 0.3, 0.6])
def test_dbscan_equals_sequential_scan(spark, eps, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 20)
    pdf = blobs()
    got = cluster.dbscan(sdf(spark, pdf), "id", eps, 5, ["x", "y"], None).toPandas().sort_values("id")
    label, core = brute_dbscan(pdf[["x", "y"]].to_numpy(), eps, 5)
    assert (got["cluster"].to_numpy() == label).all()
    assert ((got["vector"] == "core").to_numpy() == core).all()


def test_neighbours_visit_other_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 10)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7)
    pdf = blobs(3)
    x = pdf[["x", "y"]].to_numpy()
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)
    for k in (1, 4, 30):
        got = cluster.knn_distance(sdf(spark, pdf), "id", k, ["x", "y"], None).toPandas().sort_values("id")
        np.testing.assert_allclose(got["distance"], d[:, k - 1], atol=1e-12)


def test_components_both_plans(spark, tight):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (11, 12)] + [(20, 20 + i) for i in range(1, 30)]
    nodes = spark.createDataFrame([(n,) for n in sorted({v for e in edges for v in e} | {99})], "node long")
    e = spark.createDataFrame(edges, "a long, b long")
    want = {n: 1 if n <= 5 else 10 if n <= 12 else 20 if n < 60 else 99 for n in [r["node"] for r in nodes.collect()]}
    for cap in (4, 10_000):
        tight.collect_rows = cap
        assert {r["node"]: r["root"] for r in neighbours.components(e, nodes).collect()} == want


def test_silhouette_and_k(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SILHOUETTE_BLOCK", 40)
    pdf = blobs().iloc[:150]
    pdf = pdf.assign(c=np.repeat([0, 1, 2], 50))
    s = cluster.silhouette(sdf(spark, pdf), ["x", "y"], "c", "euclidean").toPandas().sort_values("id")["silhouette"].to_numpy()
    x = pdf[["x", "y"]].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in (0, 77, 149):
        a = d[i][pdf.c == pdf.c[i]].sum() / 49
        b = min(d[i][pdf.c == g].mean() for g in range(3) if g != pdf.c[i])
        assert s[i] == pytest.approx((b - a) / max(a, b))
    chosen, _ = cluster.best_k(sdf(spark, pdf), [2, 3, 4], ["x", "y"], n_init=2)
    assert chosen["k"] == 3
    fit = cluster.kmeans(sdf(spark, pdf), 3, ["x", "y"], scaling=None, n_init=2)
    np.testing.assert_allclose(fit.data.groupBy("cluster").agg(F.avg("x")).orderBy("cluster").toPandas().iloc[:, 1], fit.centers[:, 0], atol=1e-6)


def test_merge_tree_is_exact_for_few_rows(spark):
    pdf = pd.DataFrame({"x": [0.0, 1.0, 10.0, 11.0, 30.0], "y": [0.0] * 5})
    labelled, tree, cut = cluster.agglomerative(sdf(spark, pdf), k=3, columns=["x", "y"], scaling=None, linkage="single")
    assert [r["distance"] for r in tree.orderBy("step").collect()] == [1.0, 1.0, 9.0, 19.0] and cut == 5.0
    assert len({r["cluster"] for r in labelled.collect()}) == 3
    w = cluster._merge_tree(np.array([[0.0], [2.0], [10.0]]), np.ones(3), "ward")
    assert w[1][2] == pytest.approx(math.sqrt(2 * 2 * 1 / 3) * 9)     # ward: sqrt(2 nm/(n+m)) times the centre distance


def test_knee():
    assert cluster.knee([2, 3, 4, 5, 6], [100, 30, 25, 22, 20], "decreasing", 0.01) == 1
    assert cluster.knee([0, 1, 2], [5, 5, 5], "decreasing", 1) is None


# -------------------------------------------------------------------- frames
def test_hull_and_density(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    h = frames.hull(sdf(spark, pd.DataFrame(x, columns=["x", "y"])).repartition(6), "x", "y").toPandas()
    whole = frames._hull(x)
    assert {tuple(v) for v in h[["x", "y"]].to_numpy()} == {tuple(v) for v in whole}
    v = np.r_[rng.normal(0, 1, 400), rng.normal(8, 1, 400)]
    df = sdf(spark, pd.DataFrame({"v": v}))
    curve = frames.kde(df, "v").toPandas()
    bw = v.std(ddof=1) * 800 ** -0.2
    want = np.exp(-.5 * ((curve.x.to_numpy()[:, None] - v) / bw) ** 2).sum(1) / (800 * bw * math.sqrt(2 * math.pi))
    np.testing.assert_allclose(curve.density, want, atol=1e-5)
    assert frames.peaks(df, ["v"]).first()["peaks"] == 2


# ------------------------------------------------------------------------ EDA
def test_selection_prunes_collinear_and_noise(spark):
    rng = np.random.default_rng(33)
    a = rng.normal(size=400)
    pdf = pd.DataFrame({"a": a, "twin": a * 2 + rng.normal(0, .01, 400), "noise": rng.normal(size=400),
                        "g": np.where(a + rng.normal(size=400) > 0, "hi", "lo"), "y": 3 * a + rng.normal(size=400)})
    got = {r["variable"]: r for r in eda.selection_table(sdf(spark, pdf), "y").collect()}
    assert sorted([got["a"]["verdict"], got["twin"]["verdict"]]) == ["accept", "candidate"]
    assert got["noise"]["verdict"] == "reject" and got["g"]["verdict"] == "accept"
    assert got["a"]["collinear_group"] == got["twin"]["collinear_group"] == 1
    clf = {r["variable"]: r["verdict"] for r in eda.target_tests(sdf(spark, pdf), "g").collect()}
    assert clf["a"] == "accept" and set(clf) == {"a", "twin", "noise", "y"}


def test_quality_check(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (None, "b")], "v double, s string")
    out = eda.quality_check(df, save_path=str(tmp_path / "out.parquet"))
    assert out["data"].count() == 2 and spark.read.parquet(str(tmp_path / "out.parquet")).count() == 2
    report = {r["item"]: r["value"] for r in out["report"].where("variable is null").collect()}
    assert report == {"numeric columns": 1.0, "nominal columns": 1.0, "duplicate rows": 1.0, "missing values": 1.0}


# ------------------------------------------------------------------------- IO
def test_catalogue_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    io.save(df, str(tmp_path / "t.parquet"))
    io.save(df, str(tmp_path / "t.csv"))
    (tmp_path / "catalog.json").write_text('{"Tiny": {"url": "t.parquet", "desc": "two rows", "metadata": {"i": "number"}}}')
    cat = str(tmp_path / "catalog.json")
    assert io.load(spark, "TINY", cat).count() == 2
    assert io.load(spark, "tiny", cat).schema["i"].metadata == {"comment": "number"}
    assert io.load(spark, str(tmp_path / "t.csv")).count() == 2
    assert [r["desc"] for r in io.list_datasets(spark, cat, "tin").collect()] == ["two rows"]
    assert io.list_datasets(spark, cat, "zzz").count() == 0
    with pytest.raises(KeyError):
        io.load(spark, "other", cat)
    with pytest.raises(ValueError):
        io.read_path(spark, "a.xyz")


def test_generated_noise(spark):
    df = io.normal_frame(spark, [0, 10], [1, 2], [100, 50])
    assert df.count() == 100 and df.where("X2 is not null").count() == 50
    with pytest.raises(ValueError):
        io.normal_frame(spark, [0], [1, 2], [10])


def test_invariance_to_partitioning_and_scale(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=list("abc")).assign(g=np.tile(list("uv"), 100))
    one, many = sdf(spark, pdf).repartition(1), sdf(spark, pdf.assign(a=pdf.a * 1000)).repartition(17)
    t = [hypothesis.t_statistics(d, "a", "g").first()["t_welch"] for d in (one, many)]
    assert t[0] == pytest.approx(t[1])
    v = [[r["vif"] for r in correlation.vif(d, list("abc")).orderBy("variable").collect()] for d in (one, many)]
    assert v[0] == pytest.approx(v[1])


def test_predictions_on_a_stream(spark, tmp_path):
    from statframe.streaming.apply import predict_stream, transform_stream

    df = sdf(spark, pd.DataFrame({"y": np.arange(12.0) * 2 + 1, "x": np.arange(12.0)}))
    df.write.parquet(str(tmp_path / "s"))
    scaler = prep.Scaler(inputCols=["x"]).fit(df)
    m = ols.fit(scaler.transform(df), "y")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    q = (predict_stream(transform_stream(stream, [scaler]), m).writeStream.format("memory").queryName("preds")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("preds").orderBy("y").collect()
    np.testing.assert_allclose([r["pred"] for r in got], [r["y"] for r in got], rtol=1e-9)
