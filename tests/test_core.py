import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statframe.operators import core


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def skewed(n=600, seed=1):
    """A third of all rows share one value, the rest is spread."""
    rng = np.random.default_rng(seed)
    v = np.round(rng.lognormal(0, 2, n), 2)
    v[: n // 3] = 1.0
    return rng.permutation(v)


def test_quantiles_direct_and_bracketed(spark, tight):
    v, w = skewed(), np.arange(600.0)
    df = frame(spark, v=v, w=w).repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = core.quantiles(df, ["v", "w"], probs)
    np.testing.assert_allclose(got["v"], np.quantile(v, probs), rtol=1e-12)
    np.testing.assert_allclose(got["w"], np.quantile(w, probs), rtol=1e-12)


def test_quantiles_missing_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (None, None)], "a double, b double")
    assert core.quantiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}


def test_group_quantiles_three_plans(spark, tight):
    v = skewed()
    g = np.where(np.arange(600) % 3 < 2, "hot", "cold")
    df = frame(spark, v=v, g=g)

    def run():
        return {r["g"]: r["q"] for r in core.group_quantiles(df, ["v"], [.25, .5], ["g"]).collect()}

    bracketed = run()
    core.LIMITS.agg_columns = 1
    ranked = run()
    core.LIMITS.map_rows = 10_000
    plain = run()
    for k in ("hot", "cold"):
        want = np.quantile(v[g == k], [.25, .5])
        for got in (bracketed, ranked, plain):
            np.testing.assert_allclose(got[k], want)


@pytest.mark.parametrize("small", [10_000, 20])
def test_average_ranks(spark, tight, small):
    core.LIMITS.small_rows = small
    v = skewed(300)
    df = frame(spark, v=v, g=np.where(np.arange(300) % 2 == 0, "a", "b"))
    got = {(r["g"], r["value"]): r["rank"] for r in core.value_ranks(df, "v", ["g"]).collect()}
    pdf = pd.DataFrame({"g": np.where(np.arange(300) % 2 == 0, "a", "b"), "v": v})
    pdf["rank"] = pdf.groupby("g")["v"].rank()
    for r in pdf.itertuples():
        assert got[r.g, r.v] == r.rank


@pytest.mark.parametrize("small", [10_000, 20])
def test_positions_previous_and_blocks(spark, tight, small):
    core.LIMITS.small_rows = small
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.where(np.arange(200) < 140, "long", "short"), "t": rng.permutation(200), "v": rng.normal(size=200)})
    df = spark.createDataFrame(pdf).repartition(5)
    pos = core.positions(df, ["k"], ["t"]).toPandas()
    want = pdf.sort_values("t").groupby("k").cumcount() + 1
    assert dict(zip(pos["t"], pos["_pos"])) == dict(zip(pdf["t"].loc[want.index], want))
    prev = core.previous(df, ["t"], ["v"]).toPandas().sort_values("t")
    np.testing.assert_allclose(prev["prev_v"].to_numpy()[1:], pdf.sort_values("t")["v"].to_numpy()[:-1])
    b = core.blocks(df, ["k"], ["t"], before=5, after=2)
    w = b.window.rowsBetween(-5, 2)
    got = b.df.withColumn("s", F.sum("v").over(w)).where("_own").toPandas()
    assert len(got) == 200
    for k, part in pdf.sort_values("t").groupby("k"):
        v = part["v"].to_numpy()
        ref = [v[max(0, i - 5): i + 3].sum() for i in range(len(v))]
        np.testing.assert_allclose(got[got["k"] == k].sort_values("t")["s"], ref, atol=1e-9)


def test_gram_narrow_and_wide(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)) * [1, 10, 0.1, 1e4] + [0, 5, 1e6, 3]
    names = list("abcd")
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    want = np.cov(x.T) * 199
    g = core.gram(df, names)
    np.testing.assert_allclose(g.cross, want, rtol=1e-8)


def test_gram_of_two_hundred_columns_with_holes_in_one_scan(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 200)) @ rng.normal(size=(200, 200)) + rng.normal(size=200) * 1e4
    x[::7, 3] = np.nan
    x[5, 199] = np.nan
    names = [f"c{k}" for k in range(200)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).withColumn("same", F.lit(0.1)).repartition(90)      # more tasks than merge keys
    g = core.gram(df, [*names, "same"])
    whole = x[~np.isnan(x).any(axis=1)]
    assert (g.rows, g.n) == (3000, len(whole)) and (g.cross[-1] == 0).all() and g.mean[-1] == 0.1
    np.testing.assert_allclose(g.mean[:-1], whole.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(g.cross[:-1, :-1], np.cov(whole.T) * (len(whole) - 1), rtol=1e-7, atol=1e-5)
    none = core.gram(df.where("false"), names)
    assert none.n == 0 and none.rows == 0 and np.isnan(none.mean).all()


def test_moments_edges(spark):
    df = spark.createDataFrame([(5.0, None)] * 10, "c double, n double")
    m = core.moments_dict(df, ["c", "n"])
    assert m["c"]["n"] == 10 and m["c"]["var"] == 0 and m["c"]["skew"] is None
    assert m["n"]["n"] == 0 and m["n"]["mean"] is None and m["n"]["rows"] == 10
    assert core.moments_dict(df.limit(0), ["c"])["c"]["n"] == 0
    assert core.moments_dict(df.limit(1), ["c"])["c"]["var"] is None


def test_no_single_partition_window_above_limit(spark, tight):
    df = spark.range(500).withColumn("v", F.col("id") * 1.0)
    plan = core.value_ranks(df, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "_pid" in plan
    assert core.value_ranks(df, "v").agg(F.max("rank")).first()[0] == 500


def test_vif_limits(spark):
    r = np.array([[1, .5, 0], [.5, 1, 0], [0, 0, 1.0]])
    np.testing.assert_allclose(core.vif_from_corr(r), [4 / 3, 4 / 3, 1])
    assert np.isinf(core.vif_from_corr(np.ones((2, 2)))).all()
