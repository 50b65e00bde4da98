"""Rules that hold at every size and on awkward rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statframe.functions import dist
from statframe.operators import cluster, core, frames, hypothesis, logit, neighbours, ols, quality
from statframe.operators import timeseries as ts
from statframe.plans import eda


def sdf(spark, pdf):
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ties_have_one_order(spark, parts):
    pdf = pd.DataFrame({"k": [1, 2, 2, 2, 3, 3], "e": [0.1, 0.9, -0.4, 0.2, 0.5, -0.7]})
    want = pdf.sort_values(["k", "e"])["e"].to_numpy()
    dw = (np.diff(want) ** 2).sum() / (want ** 2).sum()
    got = ols.durbin_watson(sdf(spark, pdf).orderBy(F.rand(parts)).repartition(parts), "e", ["k"])
    assert got["statistic"] == pytest.approx(dw)


def test_two_factor_levels_keep_the_first_factor(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": np.repeat(["p", "p, q"], 60), "b": np.tile(["x", "q, x", "z"], 40)})
    pdf["y"] = rng.normal(size=120) + 5 * (pdf["b"] == "z") * (pdf["a"] == "p")
    pairs = hypothesis.posthoc2(sdf(spark, pdf), "y", ["a", "b"])
    assert pairs.count() == 15                                          # six cells, though two of them read "p, q, x"
    got = {r["level"]: (r["pairs"], r["significant_pairs"]) for r in hypothesis.posthoc2_levels(pairs).collect()}
    assert got["p"] == (3, 2) and got["p, q"][0] == 3 and set(got) == {"p", "p, q"}


def test_residual_lags_belong_to_each_series(spark):
    rng = np.random.default_rng(2)
    long = pd.DataFrame({"k": "long", "t": range(200), "e": rng.normal(size=200)})
    short = pd.DataFrame({"k": "short", "t": range(15), "e": rng.normal(size=15)})
    alone = {r["test"]: r["statistic"] for r in ts.residual_report(sdf(spark, long), "t", "e").collect()}
    both = ts.residual_report(sdf(spark, pd.concat([long, short])), "t", "e", ["k"]).collect()
    assert {r["test"]: r["statistic"] for r in both if r["k"] == "long"} == pytest.approx(alone)
    assert "Ljung-Box (3)" in {r["test"] for r in both if r["k"] == "short"}
    orders = spark.createDataFrame([("long", 1, 1, 0, 0, 1, 1, 12), ("short", 0, 0, 0, 0, 0, 0, 0)], "k string, p int, d int, q int, sp int, sd int, sq int, s int")
    fit = {(r["k"], r["test"]): r for r in ts.residual_report(sdf(spark, pd.concat([long, short])), "t", "e", ["k"], orders=orders).collect()}
    assert fit["long", "Ljung-Box (12)"]["n"] == 187 and fit["long", "Ljung-Box (24)"]["df"] == 22.0 and ("short", "Ljung-Box (3)") in fit


def test_difference_orders(spark):
    rng = np.random.default_rng(3)
    v = np.cumsum(rng.normal(size=120))
    got = ts.adf_differences(sdf(spark, pd.DataFrame({"t": range(120), "v": v})), "t", "v").collect()
    assert [r["diff"] for r in got] == [0, 1, 2] and [r["advice"] for r in got] == ["", "stop here", "over-differenced"]
    assert got[1]["std"] == pytest.approx(np.diff(v).std(ddof=1))
    assert [r["diff"] for r in ts.adf_differences(sdf(spark, pd.DataFrame({"t": range(120), "v": v})), "t", "v", max_diff=1).collect()] == [0, 1]


def test_seasonal_lags_are_a_product():
    assert ts._lag_sets(1, 1, 1, 1, 12) == ([1, 12, 13], [1, 12, 13])
    assert ts._lag_sets(2, 0, 0, 1, 4) == ([1, 2], [4])


def test_missing_points_stay_and_count_for_nothing(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, .2, (30, 2)), rng.normal(5, .2, (30, 2))])
    pdf = pd.DataFrame({"id": range(60), "x": x[:, 0], "y": x[:, 1], "c": np.repeat([0, 1], 30)})
    whole = sdf(spark, pdf)
    more = whole.unionByName(spark.createDataFrame([(99, None, 1.0, 0), (98, 1.0, 1.0, None)], "id long, x double, y double, c long"))
    for method in ("squared", "euclidean"):
        a, b = (cluster.silhouette(d, ["x", "y"], "c", method).select("id", "silhouette").toPandas().set_index("id")["silhouette"] for d in (whole, more))
        assert np.allclose(a.sort_index(), b.loc[a.index].sort_index()) and b[[98, 99]].isna().all()
    d = cluster.knn_distance(more.drop("c"), "id", 3, ["x", "y"], None).toPandas().set_index("id")["distance"]
    assert len(d) == 62 and np.isnan(d[99])
    labels = {r["id"]: (r["cluster"], r["vector"]) for r in cluster.dbscan(more.drop("c"), "id", 0.5, 4, ["x", "y"], None).collect()}
    assert labels[99] == (None, None) and labels[98] == (-1, "noise") and len(labels) == 62


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_metrics(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4))
    d = {"euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum(-1)), "manhattan": lambda a, b: np.abs(a - b).sum(-1),
         "cosine": lambda a, b: 1 - (a * b).sum(-1) / np.sqrt((a * a).sum(-1) * (b * b).sum(-1))}[metric](x[:, None], x[None])
    df = sdf(spark, pd.DataFrame(x, columns=list("abcd")).assign(id=range(80)))
    got = cluster.knn_distance(df, "id", 5, list("abcd"), None, metric).toPandas().sort_values("id")["distance"]
    np.testing.assert_allclose(got, np.sort(d, axis=1)[:, 4], atol=1e-9)
    eps = float(np.quantile(np.sort(d, axis=1)[:, 4], 0.4)) + 1e-6
    out = cluster.dbscan(df, "id", eps, 5, list("abcd"), None, metric=metric).toPandas().sort_values("id")
    near = d <= eps
    assert ((out["vector"] == "core").to_numpy() == (near.sum(1) >= 5)).all()
    core_ids = np.flatnonzero(near.sum(1) >= 5)
    same = out["cluster"].to_numpy()[core_ids][:, None] == out["cluster"].to_numpy()[core_ids][None]
    reach = np.linalg.matrix_power((near[np.ix_(core_ids, core_ids)]).astype(float), len(core_ids)) > 0
    assert (same == reach).all()


def test_cells_two_zones_apart_are_linked(spark):
    df = spark.createDataFrame([(0, 0.75, 0.0), (1, 1.40, 0.0), (2, 2.35, 0.0)], "id long, x double, y double")
    assert {r["cluster"] for r in cluster.dbscan(df, "id", 1.0, 2, ["x", "y"], None).collect()} == {0}


def test_the_bend_does_not_depend_on_the_number_of_rows(spark):
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(0, 1, 300), rng.uniform(-30, 30, 60)]
    one = sdf(spark, pd.DataFrame({"id": range(360), "x": x}))
    eps, curve = cluster.best_eps(one, "id", 5, ["x"], None)
    fine, _ = cluster.best_eps(one, "id", 5, ["x"], None, points=cluster.CURVE_POINTS)
    assert eps == fine and curve.agg(F.sum("cnt")).first()[0] == 360
    d = np.sort(np.sort(np.abs(x[:, None] - x[None]), axis=1)[:, 4])
    marks = np.interp(np.arange(1000) * 359 / 999, np.arange(360), d)
    assert eps == pytest.approx(marks[cluster.knee(range(1000), marks, "increasing", 1.0)])


def test_one_logit_for_any_number_of_columns(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 26))
    y = (rng.random(400) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    names = [f"x{i}" for i in range(26)]
    m = logit.fit(sdf(spark, pd.DataFrame(x, columns=names).assign(y=y)), "y", names)
    z, beta = np.column_stack([np.ones(400), x]), np.zeros(27)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p))
    np.testing.assert_allclose(m.beta, beta, rtol=1e-6, atol=1e-9)
    with pytest.raises(ValueError, match="separation"):
        logit.fit(sdf(spark, pd.DataFrame(x, columns=names).assign(y=(x[:, 3] > 0).astype(int))), "y", names)


def test_density_is_right_whatever_the_range(spark):
    rng = np.random.default_rng(8)
    v = np.r_[rng.normal(0, 1, 500), 1e6]
    curve = frames.kde(sdf(spark, pd.DataFrame({"v": v[:500]})), "v").toPandas()
    bw = v[:500].std(ddof=1) * 500 ** -0.2
    want = np.exp(-.5 * ((curve["x"].to_numpy()[:, None] - v[:500]) / bw) ** 2).sum(1) / (500 * bw * math.sqrt(2 * math.pi))
    np.testing.assert_allclose(curve["density"], want, atol=2e-5)
    far = frames.kde(sdf(spark, pd.DataFrame({"v": v, "g": ["a"] * 500 + ["b"]})).unionByName(sdf(spark, pd.DataFrame({"v": [1e6 + 1], "g": ["b"]}))), "v", "g").toPandas()
    np.testing.assert_allclose(far[far["g"] == "a"]["density"], curve["density"], rtol=1e-9)


def test_many_levels_have_long_forms(spark):
    df = spark.range(1500).select(F.col("id"), F.concat(F.lit("h"), F.col("id")).alias("h"), (F.col("id") % 3).alias("x"), F.lit(1.0).alias("y"))
    cells = frames.stack_cells(df, "x", "y", "h", ratio=True)
    assert cells.count() == 1500 and cells.agg(F.round(F.sum("value"), 6)).first()[0] == 300.0
    from statframe.operators import prep
    assert prep.dummies_long(df, ["id"], ["h"]).count() == 1500


def test_interval_of_a_line(spark):
    df = spark.createDataFrame([(x, float(x + e)) for x in (1, 2) for e in (-1, 0, 1, 2)], "x int, y double")
    got = frames.line(df, "x", "y", level=0.95).orderBy("x").first()
    assert got["mean"] == 1.5 and got["lower"] < 1.5 < got["upper"] and frames.line(df, "x", "y").columns == ["x", "mean", "n"]


def test_sums_in_several_jobs_are_the_same(spark):
    rng = np.random.default_rng(9)
    df = sdf(spark, pd.DataFrame(rng.normal(size=(60, 30)), columns=[f"c{i}" for i in range(30)]))
    g = core.gram(df, df.columns)
    np.testing.assert_allclose(g.cross, np.cov(df.toPandas().to_numpy().T) * 59, atol=1e-9)


def test_sketches_merge_and_keep_their_ranks(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 20_000), "x": rng.exponential(size=20_000), "none": np.nan, "late": np.r_[np.full(19_000, np.nan), rng.normal(size=1000)]})
    df = sdf(spark, pdf).repartition(7)
    halves = [quality.sketch(df.where(f"g = {k}"), ["x", "none", "late"]) for k in (0, 1)]
    probs = [0.01, 0.25, 0.5, 0.9, 0.999]
    got = {r["variable"]: r for r in quality.sketch_quantiles(quality.merge_sketches(*halves), probs).collect()}
    assert set(got) == {"x", "late"} and got["x"]["n"] == 20_000 and got["late"]["n"] == 1000 and got["x"]["max"] == pdf.x.max()
    for p, q in zip(probs, got["x"]["q"]):
        assert abs((pdf.x <= q).mean() - p) < 0.004
    by = quality.merge_sketches(quality.sketch(df, ["x"], ["g"]), quality.sketch(df, ["x"], ["g"]), by=["g"]).collect()
    assert sorted((r["g"], r["n"]) for r in by) == sorted((g, 2 * int((pdf.g == g).sum())) for g in (0, 1))
    exact, rough = (quality.numerical_summary(df, ["x", "none"], approx=a).toPandas().set_index("variable") for a in (False, True))
    for c in ("count", "mean", "std", "min", "max", "skew", "kurt"):
        np.testing.assert_allclose(rough.loc["x", c], exact.loc["x", c], rtol=1e-9)
    for c in ("q25", "q50", "q75"):
        assert abs((pdf.x <= rough.loc["x", c]).mean() - int(c[1:]) / 100) < 0.004
    assert abs(rough.loc["x", "upper_outliers"] - exact.loc["x", "upper_outliers"]) < 0.004 * 20_000 and rough.loc["none", "count"] == 0
    assert quality.numerical_summary(df, ["x"], by=["g"], approx=True).count() == 2


def test_shapiro_of_small_groups_only(spark):
    rng = np.random.default_rng(4)
    pdf = pd.concat([pd.DataFrame({"g": g, "x": rng.normal(size=n)}) for g, n in (("few", 12), ("many", 40), ("two", 2), ("same", 0))] + [pd.DataFrame({"g": "same", "x": [1.0] * 5})])
    got = quality.shapiro(sdf(spark, pdf), ["x"], ["g"]).toPandas().set_index("g")
    w, p = dist.shapiro_wilk(pdf[pdf.g == "few"].x)
    assert got.loc["few", "statistic"] == pytest.approx(w) and got.loc["few", "p_value"] == pytest.approx(p)
    assert got.loc[["many", "two", "same"], "statistic"].isna().all() and got.loc["many", "n"] == 40


def test_leaves_keep_their_size_beyond_the_zones(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 10)
    monkeypatch.setattr(neighbours, "ZONES", 3)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 50)
    rng = np.random.default_rng(8)
    x = np.concatenate([c + rng.normal(size=(60, 5)) * 0.2 for c in rng.normal(size=(6, 5)) * 5])
    df = sdf(spark, pd.DataFrame(x, columns=list("abcde")).assign(id=range(len(x))))
    points = neighbours.distinct_points(df.select("id", F.array(*"abcde").alias("x")), "x", "id")
    index = neighbours.Index.of(points, 2)
    sizes = [r["n"] for r in index.placed.groupBy("zone", "leaf").agg(F.count("*").alias("n")).collect()]
    assert index.placed.select("zone").distinct().count() <= 3 and max(sizes) <= 40 and sum(sizes) == len(x)
    got = neighbours.neighbours(points, 4, 2, index).select("pid", "kdist", "visits").toPandas().sort_values("pid")
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 3]
    np.testing.assert_allclose(got["kdist"], d, atol=1e-9)
    assert got["visits"].mean() < 0.6 * len(sizes)              # most leaves are never searched


def test_spanning_tree_over_leaves_is_the_tree_point_by_point(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(70, 3)), 40 + rng.normal(size=(50, 3)), [[100.0, 0, 0]], np.round(rng.normal(size=(30, 3)))])
    df = sdf(spark, pd.DataFrame(x, columns=list("abc")))
    want = sorted(e[2] for e in neighbours._grown_tree(np.arange(len(np.unique(x, axis=0))), np.unique(x, axis=0), 2))
    labelled, tree, cut = cluster.single_linkage(df, list("abc"), k=3)
    monkeypatch.setattr(neighbours, "SMALL_TREE", 10)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 25)
    again, tree2, cut2 = cluster.single_linkage(df, list("abc"), k=3)
    for t in (tree, tree2):
        rows = t.orderBy("step").toPandas()
        np.testing.assert_allclose(rows["distance"], want, atol=1e-12)
    assert cut == pytest.approx(cut2) and sorted(r["count"] for r in labelled.groupBy("cluster").count().collect()) == sorted(r["count"] for r in again.groupBy("cluster").count().collect()) == [1, 50, 100]
    assert {tuple(r) for r in labelled.collect()} == {tuple(r) for r in again.collect()}


@pytest.mark.parametrize("p", [2, 1])
def test_points_that_reach_everywhere_are_scanned_in_blocks(spark, monkeypatch, p):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 40)
    monkeypatch.setattr(neighbours, "SCAN_ROWS", 10)
    monkeypatch.setattr(neighbours, "TILE", 32)
    rng = np.random.default_rng(12)
    x = 1e6 + np.concatenate([rng.normal(size=(500, 12)), np.round(rng.normal(size=(60, 12)) / 3)])
    x = np.concatenate([x, x[:9], x[:3], x[:3]])
    df = sdf(spark, pd.DataFrame({"id": range(len(x)), "x": x.tolist()}))
    points = neighbours.distinct_points(df, "x", "id")
    index, calls, scan = neighbours.Index.of(points, p), [], neighbours.Index.scan
    monkeypatch.setattr(neighbours.Index, "scan", lambda self, *a, **k: calls.append(1) or scan(self, *a, **k))
    got = neighbours.neighbours(points, 4, p, index).toPandas().set_index("pid").sort_index()
    assert calls                                               # no visits of one leaf after another
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if p == 2 else np.abs(x[:, None] - x[None]).sum(2)
    np.testing.assert_allclose(got["kdist"], np.sort(d, axis=1)[got.index, 3], atol=1e-9)
    first = {tuple(v): i for i, v in reversed(list(enumerate(x)))}
    own = np.array([first[tuple(v)] for v in x])
    for pid, near in got["near"].items():
        want, total = [], 0
        for i in sorted(set(own), key=lambda i: (d[pid, i], i)):
            if total < 4:
                want.append(i)
                total += int((own == i).sum())
        assert [r["pid"] for r in near] == want
    flat = points.select("pid", "x").toPandas().sort_values("pid")
    tree = sorted(neighbours._grown_tree(flat["pid"].to_numpy(), np.stack(flat["x"]), p))
    monkeypatch.setattr(neighbours, "SMALL_TREE", 10)
    calls.clear()
    assert sorted(tuple(r) for r in neighbours.spanning_tree(points, p, 3).select("a", "b", "d").collect()) == tree
    assert len(calls) > 1                                      # for the lists, and for components whose lists do not tell


@pytest.mark.parametrize("p", [2, 1])
def test_tiles_in_single_precision_or_whole_steps_miss_no_neighbour(p):
    rng = np.random.default_rng(14)
    x = 1e3 + rng.normal(size=(400, 64))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if p == 2 else np.abs(x[:, None] - x[None]).sum(2)
    kth = np.sort(d, axis=1)[:, 4]
    radius = neighbours._radii(x, 5, p)
    assert (radius >= kth).all() and (radius <= 1.001 * kth).all() and np.isinf(neighbours._radii(x[:4], 5, p)).all()
    tiles, seen = neighbours.Tiles(x, p, kth), 0
    for at, to, rough, base, slack in tiles.over(x):
        assert rough.dtype == np.float32 and (slack < 0.05 * kth[at] ** p).all()
        assert (np.abs(rough + base[:, None] - d[at, to] ** p) <= slack[:, None]).all()
        i, j = tiles.reached(rough, tiles.bound(kth[at], base, slack))
        assert {(a, b) for a, b in zip(*np.nonzero(d[at, to] <= kth[at, None]))} <= set(zip(i.tolist(), j.tolist()))
        seen += len(i)
    assert seen < 400 * 40                                      # and few others
    wide = np.concatenate([x, x + 1e9])                         # too far apart for either
    assert all(r.dtype == float or p == 1 and (s >= 0).all() for _, _, r, _, s in neighbours.Tiles(wide, p, kth).over(wide))
    assert neighbours._Steps.of(wide, wide, float(np.median(kth)), 0.0) is None


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_points_are_packed_once(spark, metric):
    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def same(v):
        met.add(1)
        return v

    rng = np.random.default_rng(15)
    x = pd.DataFrame(rng.normal(size=(60, 2)), columns=list("ab")).assign(id=range(60))
    df = sdf(spark, x).withColumn("a", same("a"))
    got = cluster.knn_distance(df, "id", 3, ["a", "b"], None, metric).toPandas().set_index("id")["distance"].sort_index()
    v = x[["a", "b"]].to_numpy()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) if metric == "euclidean" else 1 - u @ u.T
    np.testing.assert_allclose(got, np.sort(d, axis=1)[:, 2], atol=1e-9)
    assert met.value == 60


def test_rounds_of_the_spanning_tree_leave_out_inner_edges(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SMALL_TREE", 10)
    rng = np.random.default_rng(16)
    x = np.concatenate([rng.normal(size=(40, 2)), 30 + rng.normal(size=(40, 2))])
    points = sdf(spark, pd.DataFrame({"pid": range(80), "x": x.tolist()})).select(F.col("pid").cast("long").alias("pid"), "x")
    kept, checkpoint = [], core.checkpoint
    monkeypatch.setattr(core, "checkpoint", lambda df: checkpoint(df) if "pa" not in df.columns else kept.append(df.count()) or checkpoint(df))
    tree = sorted(tuple(r) for r in neighbours.spanning_tree(points, 2, 6).select("a", "b", "d").collect())
    assert tree == sorted(neighbours._grown_tree(np.arange(80), x, 2))
    assert len(kept) > 1 and kept == sorted(kept, reverse=True) and kept[-1] == 0


def test_mean_distance_silhouette_streams_points_past_blocks(spark, monkeypatch):
    monkeypatch.setattr(cluster, "SILHOUETTE_BLOCK", 30)
    monkeypatch.setattr(neighbours, "TILE", 16)
    rng = np.random.default_rng(13)
    x = 1e5 + np.concatenate([rng.normal(size=(60, 3)), 5 + rng.normal(size=(50, 3)), rng.normal(size=(1, 3))])
    x = np.concatenate([x, x[:20], x[:20], x[60:63] + 1e-7])
    own = np.r_[[0] * 60, [1] * 50, [2], [0] * 10, [1] * 10, [0] * 20, [1] * 3]
    df = sdf(spark, pd.DataFrame(x, columns=list("abc")).assign(id=range(len(x)), own=own))
    calls, stream = [], cluster.stream
    monkeypatch.setattr(cluster, "stream", lambda *a: calls.append(a[0].where("kind = 0").select("pid").distinct().count()) or stream(*a))
    got = cluster.silhouette(df, list("abc"), "own", "euclidean").select("id", "silhouette").toPandas().set_index("id")["silhouette"].sort_index()
    assert calls == [len(np.unique(x, axis=0))]                # copies are held once
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i, c in enumerate(own):
        a = d[i, own == c].sum() / max((own == c).sum() - 1, 1)
        b = min(d[i, own == o].mean() for o in set(own) - {c})
        want.append(0.0 if (own == c).sum() <= 1 else (b - a) / max(a, b))
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_the_driver_gets_one_vector_however_many_tasks(spark, monkeypatch):
    from pyspark.sql import DataFrame

    got, fetch = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: got.append(fetch(self)) or got[-1])
    df = spark.range(0, 400, 1, 100)
    total = core.sum_vectors(df, lambda batch: np.arange(10_000.0) * np.asarray(batch.column(0)).sum(), 10_000)
    np.testing.assert_array_equal(total, np.arange(10_000.0) * (399 * 200))
    assert sum(t.nbytes for t in got) < 2 * total.nbytes
    assert not core.sum_vectors(df.where("id < 0"), lambda batch: np.ones(5), 5).any()


def test_all_runs_of_k_means_share_their_passes(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([c + rng.normal(size=(80, 2)) * 0.3 for c in ([0, 0], [5, 0], [0, 6])])
    df = sdf(spark, pd.DataFrame(x, columns=["x", "y"]))
    data = cluster._vectors(df.select("x", "y"), ["x", "y"])
    found, passes = cluster._runs(data, [1, 2, 3], 1, 4)
    own = np.repeat([0, 1, 2], 80)
    assert passes <= 60 and found[1][1] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())
    assert found[3][1] == pytest.approx(sum(((x[own == k] - x[own == k].mean(axis=0)) ** 2).sum() for k in range(3)))
    table = cluster.best_k(df, [2, 3], ["x", "y"], None, n_init=2)[1].toPandas().set_index("k")
    for k in (2, 3):
        fit = cluster.kmeans(df, k, ["x", "y"], None, n_init=2)
        s = cluster.silhouette_summary(cluster.silhouette(fit.data, ["x", "y"], "cluster"), "cluster").first()
        assert fit.passes < 60 and all(table.loc[k, c] == pytest.approx(s[c], abs=1e-4) for c in ("score", "total_area", "thickness", "min_relative_area", "balance"))


def test_goodness_of_fit_for_given_shares_and_any_number_of_levels(spark):
    df = spark.createDataFrame([(v,) for v, n in (("a", 18), ("b", 30), ("c", 12)) for _ in range(n)] + [(None,)], "v string")
    assert hypothesis.chi2_gof(df, "v").first()["chi2"] == pytest.approx(((18 - 20) ** 2 + 100 + 64) / 20, abs=1e-4)
    r = hypothesis.chi2_gof(df, "v", [0.5, 0.25, 0.25], ["b", "a", "c"]).first()
    assert r["chi2"] == pytest.approx(0 + 9 / 15 + 9 / 15, abs=1e-4) and r["dof"] == 2 and r["assumption"]
    assert hypothesis.chi2_gof(df, "v", [15, 30, 15]).first()["chi2"] == pytest.approx(0.6 + 0.6, abs=1e-4)
    many = spark.range(30_000).selectExpr("id % 10000 as v")
    assert hypothesis.chi2_gof(many, "v").first()["chi2"] == 0 and hypothesis.chi2_gof(many, "v").first()["dof"] == 9999


def test_knn_distance_packs_points_once_and_joins_by_hash(spark, monkeypatch):
    plans, pin = [], core.checkpoint
    monkeypatch.setattr(core, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or pin(df))
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 3.0, 4.0), (4, None, 1.0), (5, float("nan"), 1.0), (6, -0.0, 0.0), (7, 6.0, 8.0)], "id long, a double, b double")
    out = cluster.knn_distance(df, "id", 3, ["a", "b"], None)
    assert plans[0].count("array(nanvl") == 1               # the point is packed once
    assert "xxhash64" in out._jdf.queryExecution().optimizedPlan().toString()
    assert dict(out.collect()) == {1: 5.0, 2: 5.0, 3: 5.0, 4: None, 5: None, 6: 5.0, 7: 5.0}


@pytest.mark.parametrize("p", [1, 2])
def test_zones_reached_by_any_point(p):
    rng = np.random.default_rng(4)
    groups = [rng.normal(size=(30, 3)) * 0.3 + c for c in rng.normal(size=(20, 3)) * 3]
    bounds = neighbours.Bounds(pd.concat([pd.DataFrame({"zone": [z], **neighbours._bound(x, p)}) for z, x in enumerate(groups)]), ["zone"], p)
    x, radius = rng.normal(size=(600, 3)) * 2, rng.uniform(0, 0.4, 600)
    want = np.unique(np.concatenate(list(bounds.within(x, radius))))
    assert 0 < len(want) and bounds.reached(x, radius, np.arange(20)).tolist() == want.tolist()
    assert bounds.reached(x[:0], radius[:0], np.arange(20)).tolist() == []
    assert bounds.reached(x, radius, want[1:]).tolist() == want[1:].tolist()


def test_selection_table_takes_quartiles_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    pdf = pd.DataFrame({"y": x[:, 0] + 0.2 * rng.normal(size=300), "a": x[:, 0], "b": np.exp(x[:, 1]), "c": np.where(x[:, 1] > 0, "u", "v")})
    df = spark.createDataFrame(pdf)
    pairs, with_target = eda.shared_pairs(df, "y")
    want = eda.selection_table(df, "y", description=quality.numerical_summary(df, ["a", "b"]), pairs=pairs, rows=eda.target_rows(df, "y", pairs=with_target)).collect()
    calls, own = [], core.quantiles
    monkeypatch.setattr(core, "quantiles", lambda data, cols, *rest: calls.append(list(cols)) or own(data, cols, *rest))
    assert eda.selection_table(df, "y").collect() == want
    assert calls.count(["a", "b"]) == 0 and sum("a" in c for c in calls) == 1
