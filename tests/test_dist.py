import math

import numpy as np
import pytest

from statframe.functions import dist


@pytest.fixture(scope="module")
def jvm(spark):
    return spark._jvm.org.apache.commons.math3.distribution


def test_against_commons_math(jvm):
    for df in (1, 2.5, 7, 40, 1e5):
        t = jvm.TDistribution(float(df))
        for x in (-3.0, -0.5, 0.0, 1.3, 4.0):
            assert dist.t_sf(x, df) == pytest.approx(1 - t.cumulativeProbability(x), abs=1e-10)
    for a, b in ((1, 5), (3, 60), (10, 2.5)):
        f = jvm.FDistribution(float(a), float(b))
        for x in (0.2, 1.0, 3.7):
            assert dist.f_sf(x, a, b) == pytest.approx(1 - f.cumulativeProbability(x), abs=1e-9)
    for k in (1, 4, 33):
        c = jvm.ChiSquaredDistribution(float(k))
        for x in (0.5, 3.84, 40.0):
            assert dist.chi2_sf(x, k) == pytest.approx(1 - c.cumulativeProbability(x), abs=1e-10)


def test_published_points():
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    # studentized range, 5 % points
    for q, k, df in ((3.151, 2, 10), (3.877, 3, 10), (4.654, 5, 10), (3.486, 3, 30), (3.314, 3, 1e9)):
        assert dist.studentized_range_sf(q, k, df) == pytest.approx(0.05, abs=2e-4)
    assert dist.kolmogorov_p(1.358 / math.sqrt(1e6), 10**6) == pytest.approx(0.05, abs=1e-3)
    assert dist.adf_p(-2.86) == pytest.approx(0.0502, abs=2e-4)
    assert dist.adf_critical(250)["5%"] == pytest.approx(-2.873, abs=1e-3)
    # lady tasting tea
    assert dist.fisher_2x2(3, 1, 1, 3) == pytest.approx(0.4857, abs=1e-4)
    assert dist.fisher_2x2(2, 18, 2, 0) == pytest.approx(0.02597, abs=1e-4)
    assert dist.wilcoxon_exact_cdf(0, 5) == pytest.approx(1 / 32)
    assert dist.u_exact_sf(9, 3, 3) == pytest.approx(1 / 20)


def test_normal_expression_matches(spark):
    from pyspark.sql import functions as F

    from statframe.functions.normal import norm_cdf

    xs = [-40.0, -8.0, -2.5, -0.1, 0.0, 0.7, 3.0, 7.5, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", norm_cdf(F.col("x")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(dist.norm_cdf(r["x"]), abs=1e-14)


def test_shapiro_wilk_published_examples():
    # weights of eleven men (Shapiro and Wilk 1965), as the usual programs give them
    w, p = dist.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.78881, abs=5e-5) and p == pytest.approx(0.006704, rel=2e-3)
    w, p = dist.shapiro_wilk([1.0, 2.0, 4.0])
    assert w == pytest.approx(27 / 28) and p == pytest.approx(6 / math.pi * (math.asin(math.sqrt(27 / 28)) - math.pi / 3))      # closed forms of three values
    assert all(v != v for v in dist.shapiro_wilk([1, 2])) and all(v != v for v in dist.shapiro_wilk([3.0] * 9))


@pytest.mark.parametrize("n", [5, 8, 11, 12, 25])
def test_shapiro_wilk_p_is_uniform_for_normal_samples(n):
    r = np.random.default_rng(n)
    p = np.array([dist.shapiro_wilk(r.normal(size=n))[1] for _ in range(1500)])
    assert abs((p < 0.05).mean() - 0.05) < 0.02 and abs(p.mean() - 0.5) < 0.03
    assert np.mean([dist.shapiro_wilk(r.exponential(size=n))[1] for _ in range(300)]) < p.mean() - 0.05


def test_kolmogorov_tabulated_values():
    # critical values of the table for 5 % and 1 %
    for n, five, one in ((1, 0.975, 0.995), (5, 0.563, 0.669), (10, 0.409, 0.489), (20, 0.294, 0.352), (40, 0.210, 0.252), (100, 0.134, 0.161)):
        assert dist.kolmogorov_p(five, n) == pytest.approx(0.05, abs=2.5e-3) and dist.kolmogorov_p(one, n) == pytest.approx(0.01, abs=1.2e-3)
    assert 1 - dist.kolmogorov_p(0.274, 10) == pytest.approx(0.6284796154565, abs=1e-11)
    assert dist.kolmogorov_p(0.1, 3) == 1.0 and dist.kolmogorov_p(0.99999, 139) == pytest.approx(0, abs=1e-12)
    assert dist.kolmogorov_p(0.08, 139) == pytest.approx(dist.kolmogorov_p(0.08, 140), abs=0.01)


@pytest.mark.parametrize("rank", [1, 3, 6])
def test_the_planted_rank_has_the_largest_evidence(rank):
    r = np.random.default_rng(rank)
    x = r.normal(size=(400, rank)) @ r.normal(size=(rank, 10)) * 2 + r.normal(size=(400, 10)) * 0.2
    assert dist.most_likely_rank(np.linalg.eigvalsh(np.cov(x.T)), 400) == rank
