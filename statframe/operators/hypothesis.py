"""Hypothesis tests that check their own assumptions and pick the method.

Raw data is touched by group moments, exact group medians and rank tables only.
Every numeric test takes ``by``: the same test for all segments in one plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statframe.functions import dist, pvalue
from statframe.operators import core, neighbours
from statframe.operators.core import col_of, div, num
from statframe.operators.quality import normality

ALTERNATIVES = ("two-sided", "less", "greater")

# Effect-size bounds (largest first) and their labels.
ETA_BOUNDS = ((0.14, "Large"), (0.06, "Medium"), (0.01, "Small"))
HEDGES_BOUNDS = ((0.8, "Large"), (0.5, "Medium"), (0.2, "Small"))
CHI2_BOUNDS = ((0.1, "Negligible"), (0.3, "Weak"), (0.5, "Moderate"))


def grade(x: Column, bounds, otherwise: str = "Negligible") -> Column:
    out = F.when(x.isNull(), None)
    for limit, label in bounds:
        out = out.when(x >= limit, label)
    return out.otherwise(otherwise)


def _grade_below(v: float, bounds, over: str) -> str | None:
    if v is None or v != v:
        return None
    return next((label for limit, label in bounds if v < limit), over)


def _present(df: DataFrame, value: str, group: Sequence[str], by: Sequence[str]) -> DataFrame:
    core.require_numeric(df, [value])
    core.require(df, [*group, *by])
    out = df.select(*by, *group, num(value).alias(value)).where(col_of(value).isNotNull())
    for g in group:
        out = out.where(col_of(g).isNotNull())
    return out


def group_stats(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """``by…, group, n, mean, var, skew, kurt, min, max``: all the parametric tests need."""
    return core.moments(_present(df, value, [group], by), [value], [*by, group]).drop("variable", "rows")


def _over(by: Sequence[str]) -> Window:
    return Window.partitionBy(*(by or [F.lit(0)]))


def _oneway(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Classic one-way F from group rows (one row per segment)."""
    w = _over(list(by))
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    parts = cells.where(F.col("n") > 0).withColumn("_grand", grand)
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * (F.col("mean") - F.col("_grand")) * (F.col("mean") - F.col("_grand"))).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ss_within"),
    ).select(*by, "n", "k", "ss_between", "ss_within",
             (F.col("k") - 1).cast("double").alias("df1"), (F.col("n") - F.col("k")).cast("double").alias("df2"),
             div(div(F.col("ss_between"), F.col("k") - 1), div(F.col("ss_within"), F.col("n") - F.col("k"))).alias("f"))


def levene(df: DataFrame, value: str, group: str, by: Sequence[str] = (), center: str = "median") -> DataFrame:
    """One-way F of the distances from each group's centre."""
    by = list(by)
    data = _present(df, value, [group], by)
    if center == "mean":
        mid = data.groupBy(*by, group).agg(F.avg(value).alias("_mid"))
    else:
        mid = core.group_quantiles(data, [value], [0.5], [*by, group]).select(*by, group, F.col("q")[0].alias("_mid"))
    away = core.attach(data, mid, [*by, group]).select(*by, group, F.abs(F.col(value) - F.col("_mid")).alias("_d"))
    return _oneway(group_stats(away, "_d", group, by), by)


def bartlett(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bartlett's statistic from group variances."""
    c = cells.where(F.col("n") > 1)
    m = F.col("n") - 1
    agg = c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum(m).alias("m"), F.sum(m * F.col("var")).alias("pooled"),
        F.sum(m * F.ln(F.when(F.col("var") > 0, F.col("var")))).alias("logs"), F.sum(div(F.lit(1.0), m)).alias("inv"),
        F.count_if(F.col("var") <= 0).alias("flat"))
    top = F.col("m") * F.ln(div(F.col("pooled"), F.col("m"))) - F.col("logs")
    correction = 1 + div(F.col("inv") - div(F.lit(1.0), F.col("m")), 3 * (F.col("k") - 1))
    return agg.select(*by, F.when(F.col("flat") == 0, div(top, correction)).alias("statistic"),
                      (F.col("k") - 1).cast("double").alias("df"))


def equal_variance(df: DataFrame, value: str, group: str, by: Sequence[str] = (), alpha: float = 0.05,
                   center: str = "median") -> DataFrame:
    """Bartlett if every group passes K², else Levene: one row per segment."""
    by = list(by)
    cells = group_stats(df, value, group, by)
    k2 = pvalue.k2_p(pvalue.k2_statistic(F.col("n"), F.col("skew"), F.col("kurt")))
    normal = cells.groupBy(*by).agg(F.min(F.coalesce(k2 >= alpha, F.lit(False))).alias("all_normal"))
    b = bartlett(cells, by).select(*by, F.col("statistic").alias("bartlett"), F.col("df").alias("b_df"))
    lev = levene(df, value, group, by, center).select(*by, F.col("f").alias("levene"), "df1", "df2")
    out = _join(_join(normal, b, by), lev, by)
    out = out.withColumn("p_value", F.when(F.col("all_normal"), pvalue.chi2_p(F.col("bartlett"), F.col("b_df")))
                         .otherwise(pvalue.f_p(F.col("levene"), F.col("df1"), F.col("df2"))))
    return out.select(*by, "all_normal", "bartlett", "levene",
                      F.when(F.col("all_normal"), "Bartlett").otherwise("Levene").alias("test"),
                      F.when(F.col("all_normal"), F.col("bartlett")).otherwise(F.col("levene")).alias("statistic"),
                      "p_value", (F.col("p_value") >= alpha).alias("equal_var"))


def _join(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join two result tables on the segment keys (one row each without keys)."""
    from statframe.operators.quality import join_null_safe

    return join_null_safe(a, b, by)


def assumptions(df: DataFrame, value: str, group: str, by: Sequence[str] = (), alpha: float = 0.05,
                center: str = "median") -> DataFrame:
    """Normality row per group plus the equal-variance row."""
    norm = normality(_present(df, value, [group], by), [value], [*by, group], alpha).select(
        *by, F.lit("normality").alias("check"), F.col(group).cast("string").alias("target"),
        F.lit("K2").alias("test"), "statistic", "p_value", F.col("normal").alias("passed"))
    var = equal_variance(df, value, group, by, alpha, center).select(
        *by, F.lit("equal_var").alias("check"), F.lit("all groups").alias("target"), "test", "statistic",
        "p_value", F.col("equal_var").alias("passed"))
    return norm.unionByName(var)


# --------------------------------------------------------------- two samples
def _directions(test: str, statistics: dict[str, float], p: dict[str, float], alpha: float) -> list[dict]:
    """Statistic and p rounded to 4 digits, as the result tables are defined."""
    return [{"test": test, "alternative": a, "statistic": round(statistics[a], 4), "p_value": round(p[a], 4),
             "significant": p[a] < alpha} for a in ALTERNATIVES]


_DIRECTION_SCHEMA = "test string, alternative string, statistic double, p_value double, significant boolean"


def wilcoxon_sums(df: DataFrame, d: Column) -> dict:
    """Signed-rank sums of a difference column; zeros dropped, ties averaged."""
    data = df.select(d.alias("_d")).where((F.col("_d") != 0) & F.col("_d").isNotNull())
    ranked = core.value_ranks(data, F.abs(F.col("_d")), weights={"pos": (F.col("_d") > 0).cast("long")})
    c = F.col("cnt").cast("double")
    row = ranked.agg(F.sum(c).alias("n"), F.sum(F.col("rank") * F.col("pos")).alias("r_plus"),
                     F.sum(F.col("rank") * c).alias("total"), F.sum(c * c * c - c).alias("ties")).first()
    return {k: row[k] or 0.0 for k in ("n", "r_plus", "total", "ties")}


def _signed_rank(df: DataFrame, d: Column, alpha: float) -> list[dict]:
    s = wilcoxon_sums(df, d)
    n, plus, minus = s["n"], s["r_plus"], s["total"] - s["r_plus"]
    stat = {"two-sided": min(plus, minus), "less": plus, "greater": plus}
    if 0 < n <= 50 and s["ties"] == 0:
        low, high = (dist.wilcoxon_exact_cdf(v, int(n)) for v in (plus, minus))
        p = {"two-sided": min(1.0, 2 * min(low, high)), "less": low, "greater": high}
    else:
        se = math.sqrt((n * (n + 1) * (2 * n + 1) - s["ties"] / 2) / 24)
        z = (plus - n * (n + 1) / 4) / se if se else float("nan")
        p = {a: dist.z_p(z, a) for a in ALTERNATIVES}
    return _directions("Wilcoxon signed-rank test", stat, p, alpha)


def _difference_test(df: DataFrame, d: Column, alpha: float, name: str) -> DataFrame:
    data = df.select(d.alias("_d")).where(F.col("_d").isNotNull())
    r = core.moments_dict(data, ["_d"])["_d"]
    _, p_norm = dist.k2_normality(r["n"], r["skew"], r["kurt"])
    if p_norm >= alpha:
        se = math.sqrt(r["var"] / r["n"])
        t = r["mean"] / se if se else float("nan")
        rows = _directions(name, dict.fromkeys(ALTERNATIVES, t),
                           {a: dist.t_p(t, r["n"] - 1, a) for a in ALTERNATIVES}, alpha)
    else:
        rows = _signed_rank(data, F.col("_d"), alpha)
    return core.rows_frame(df.sparkSession, rows, _DIRECTION_SCHEMA)


def one_sample(df: DataFrame, column: str, popmean: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """t if normal, else Wilcoxon on the shifted values; three alternatives."""
    core.require_numeric(df, [column])
    return _difference_test(df, num(column) - F.lit(float(popmean)), alpha, "One-sample t-test")


def paired(df: DataFrame, before: str, after: str, alpha: float = 0.05) -> DataFrame:
    """Test of after - before."""
    core.require_numeric(df, [before, after])
    return _difference_test(df, num(after) - num(before), alpha, "Paired t-test")


def t_statistics(df: DataFrame, value: str, group: str, levels: Sequence | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Student and Welch t of level 1 minus level 2 with their degrees of freedom, per segment."""
    a, b = levels or _two_levels(df, value, group)
    cells = group_stats(df, value, group, by)
    pick = [F.max(F.when(F.col(group) == F.lit(v), F.col(f))).alias(f"{f}{i}")
            for i, v in ((1, a), (2, b)) for f in ("n", "mean", "var")]
    g = cells.groupBy(*by).agg(*pick)
    n1, n2, v1, v2 = (F.col(c).cast("double") for c in ("n1", "n2", "var1", "var2"))
    d = F.col("mean1") - F.col("mean2")
    pooled = div((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    e1, e2 = div(v1, n1), div(v2, n2)
    return g.select(*by, "n1", "n2", "mean1", "mean2",
                    div(d, F.sqrt(pooled * (div(F.lit(1.0), n1) + div(F.lit(1.0), n2)))).alias("t_student"),
                    (n1 + n2 - 2).alias("df_student"), div(d, F.sqrt(e1 + e2)).alias("t_welch"),
                    div((e1 + e2) * (e1 + e2), div(e1 * e1, n1 - 1) + div(e2 * e2, n2 - 1)).alias("df_welch"))


def _two_levels(df: DataFrame, value: str, group: str) -> list:
    found = sorted(r[0] for r in _present(df, value, [group], ()).select(group).distinct().limit(3).collect())
    if len(found) != 2:
        raise ValueError(f"{group} must have exactly two levels")
    return found


def u_statistics(df: DataFrame, value: str, group: str, levels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney U of level 1, z pieces with tie correction, per segment."""
    data = _present(df, value, [group], by).where(F.col(group).isin(*levels))
    ranked = core.value_ranks(data, value, by, {"c1": (F.col(group) == F.lit(levels[0])).cast("long")})
    c = F.col("cnt").cast("double")
    agg = ranked.groupBy(*by).agg(
        F.sum("c1").cast("double").alias("n1"), F.sum(c).alias("n"),
        F.sum(F.col("rank") * F.col("c1")).alias("r1"), F.sum(c * c * c - c).alias("ties"))
    n1, n2, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    return agg.select(*by, n1.cast("long").alias("n1"), n2.cast("long").alias("n2"),
                      (F.col("r1") - n1 * (n1 + 1) / 2).alias("u"), "ties",
                      (n1 * n2 / 2).alias("mean_u"),
                      F.sqrt(n1 * n2 / 12 * (n + 1 - div(F.col("ties"), n * (n - 1)))).alias("sd_u"))


def _u_p(u: float, r, alternative: str) -> float:
    n1, n2 = r["n1"], r["n2"]
    other = n1 * n2 - u
    target = {"two-sided": max(u, other), "greater": u, "less": other}[alternative]
    factor = 2.0 if alternative == "two-sided" else 1.0
    if min(n1, n2) <= 8 and r["ties"] == 0 and n1 + n2 <= 60:
        return min(1.0, factor * dist.u_exact_sf(target, n1, n2))
    if not r["sd_u"]:
        return float("nan")
    return min(1.0, factor * dist.norm_sf((target - r["mean_u"] - 0.5) / r["sd_u"]))


def two_sample(df: DataFrame, value: str, group: str, levels: Sequence | None = None, alpha: float = 0.05) -> DataFrame:
    """Student, Welch or Mann-Whitney by the assumption checks; three alternatives."""
    levels = list(levels or _two_levels(df, value, group))
    data = _present(df, value, [group], ()).where(F.col(group).isin(*levels))
    check = equal_variance(data, value, group, (), alpha).first()
    if not check["all_normal"]:
        r = u_statistics(data, value, group, levels).first()
        rows = _directions("Mann-Whitney U test", dict.fromkeys(ALTERNATIVES, r["u"]),
                           {a: _u_p(r["u"], r, a) for a in ALTERNATIVES}, alpha)
    else:
        r = t_statistics(data, value, group, levels).first()
        kind = "student" if check["equal_var"] else "welch"
        t, free = r[f"t_{kind}"], r[f"df_{kind}"]
        rows = _directions(f"{kind.title()} t-test", dict.fromkeys(ALTERNATIVES, t),
                           {a: dist.t_p(t, free, a) for a in ALTERNATIVES}, alpha)
    return core.rows_frame(df.sparkSession, rows, _DIRECTION_SCHEMA)


# --------------------------------------------------------------------- anova
def welch_f(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    w = _over(list(by))
    weight = div(F.col("n"), F.col("var"))
    base = cells.where(F.col("n") > 1).withColumn("_w", weight)
    base = base.withColumn("_sw", F.sum("_w").over(w)).withColumn(
        "_m", F.sum(F.col("_w") * F.col("mean")).over(w) / F.col("_sw"))
    share = 1 - div(F.col("_w"), F.col("_sw"))
    agg = base.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("k"),
        F.sum(F.col("_w") * (F.col("mean") - F.col("_m")) * (F.col("mean") - F.col("_m"))).alias("top"),
        F.sum(div(share * share, F.col("n") - 1)).alias("lam"))
    k = F.col("k")
    lam = div(3 * F.col("lam"), k * k - 1)
    return agg.select(*by, div(div(F.col("top"), k - 1), 1 + 2 * lam * (k - 2) / 3).alias("welch_f"),
                      (k - 1).alias("welch_df1"), div(F.lit(1.0), lam).alias("welch_df2"))


def anova(df: DataFrame, value: str, group: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """One-way ANOVA, Welch's form when the variances differ, with partial eta squared."""
    by = list(by)
    cells = group_stats(df, value, group, by)
    classic = _oneway(cells, by)
    var = equal_variance(df, value, group, by, alpha).select(*by, "equal_var")
    both = _join(_join(classic, welch_f(cells, by), by), var, by)
    pick = lambda a, b: F.when(F.col("equal_var"), F.col(a)).otherwise(F.col(b))
    out = both.select(*by, F.lit(group).alias("source"),
                      F.when(F.col("equal_var"), "ANOVA").otherwise("Welch ANOVA").alias("test"), "n", "k",
                      pick("df1", "welch_df1").alias("df1"), pick("df2", "welch_df2").alias("df2"),
                      pick("f", "welch_f").alias("f"),
                      div(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")).alias("np2"), "equal_var")
    return (out.withColumn("p_value", pvalue.f_p(F.col("f"), F.col("df1"), F.col("df2")))
            .withColumn("significant", F.col("p_value") < alpha)
            .withColumn("effect_size", grade(F.col("np2"), ETA_BOUNDS)))


def pair_statistics(cells: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Every pair of groups A < B from the (small) group table: Tukey and Games-Howell pieces, Hedges g."""
    by = list(by)
    w = _over(by)
    base = cells.select(*by, F.col(group).cast("string").alias("g"), "n", "mean", "var",
                        F.sum((F.col("n") - 1) * F.col("var")).over(w).alias("_ssw"),
                        F.sum("n").over(w).alias("_n"), F.count(F.lit(1)).over(w).alias("k"))
    a = base.select(*by, "k", "_ssw", "_n", F.col("g").alias("a"),
                    *[F.col(c).alias(f"{c}_a") for c in ("n", "mean", "var")])
    b = base.select(*[F.col(k).alias(f"_b_{k}") for k in by], F.col("g").alias("b"),
                    *[F.col(c).alias(f"{c}_b") for c in ("n", "mean", "var")])
    on = F.col("a") < F.col("b")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    p = a.join(b, on)
    na, nb, va, vb = (F.col(c).cast("double") for c in ("n_a", "n_b", "var_a", "var_b"))
    diff = F.col("mean_a") - F.col("mean_b")
    mse = div(F.col("_ssw"), F.col("_n") - F.col("k"))
    se_t = F.sqrt(div(mse, na) + div(mse, nb))
    ea, eb = div(va, na), div(vb, nb)
    se_g = F.sqrt(ea + eb)
    pooled = F.sqrt(div((na - 1) * va + (nb - 1) * vb, na + nb - 2))
    return p.select(*by, "a", "b", "mean_a", "mean_b", diff.alias("diff"), "k",
                    se_t.alias("se_tukey"), div(diff, se_t).alias("t_tukey"),
                    (F.col("_n") - F.col("k")).cast("double").alias("df_tukey"),
                    se_g.alias("se_gh"), div(diff, se_g).alias("t_gh"),
                    div((ea + eb) * (ea + eb), div(ea * ea, na - 1) + div(eb * eb, nb - 1)).alias("df_gh"),
                    (div(diff, pooled) * (1 - 3 / (4 * (na + nb) - 9))).alias("hedges"))


def posthoc(df: DataFrame, value: str, group: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Tukey HSD, or Games-Howell when the variances differ, for all pairs of groups."""
    by = list(by)
    pairs = pair_statistics(group_stats(df, value, group, by), group, by)
    both = _join(pairs, equal_variance(df, value, group, by, alpha).select(*by, "equal_var"), by)
    pick = lambda a, b: F.when(F.col("equal_var"), F.col(a)).otherwise(F.col(b))
    out = both.select(*by, "a", "b", "mean_a", "mean_b", "diff", pick("se_tukey", "se_gh").alias("se"),
                      pick("t_tukey", "t_gh").alias("t"), pick("df_tukey", "df_gh").alias("df"),
                      "k", "hedges", F.when(F.col("equal_var"), "Tukey HSD").otherwise("Games-Howell").alias("test"))
    return (out.withColumn("p_value", pvalue.tukey_p(F.abs(F.col("t")) * math.sqrt(2), F.col("k").cast("double"), F.col("df")))
            .withColumn("significant", F.col("p_value") < alpha)
            .withColumn("effect_size", grade(F.abs(F.col("hedges")), HEDGES_BOUNDS)).drop("k"))


def posthoc_extremes(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The pairs with the largest and the smallest absolute difference."""
    key = lambda sign: F.struct(sign * F.abs(F.col("diff")), F.col("a"), F.col("b"))
    row = F.struct("a", "b", "diff", "p_value", "significant")
    return pairs.groupBy(*by).agg(F.min_by(row, key(-1)).alias("largest"), F.min_by(row, key(1)).alias("smallest"))


# ----------------------------------------------------------- two-way analysis
def _with_margin(c: DataFrame, vector: DataFrame, key: str) -> DataFrame:
    """Cells with a margin's numbers: the margin has a row per level, so a hot level only repeats it."""
    return c.join(vector.withColumnRenamed(key, f"_{key}"), F.col(key) == F.col(f"_{key}")).drop(f"_{key}")


def _shared_part(c: DataFrame, tolerance: float = 1e-11, most: int = 1000) -> float:
    """r' x for S x = r, where S = diag(w_j) - W' diag(1 / w_i) W and r_j = sum of w d_i; ``c`` has ``i, j, w, w_i, d_i``.

    Conjugate gradients with the margin's weights as preconditioner. S is singular along constants, r is orthogonal to them. Every vector is a
    table with a row per level of j; a step is two joins of the cells with a margin and two sums. Up to ``Limits.collect_rows`` cells the
    same steps run on arrays.
    """
    if c.count() <= core.LIMITS.collect_rows:
        return _shared_part_local(c.select("i", "j", "w", "w_i", "d_i").toPandas(), tolerance, most)
    side = c.groupBy("j").agg(F.sum("w").alias("d"), F.sum(F.col("w") * F.col("d_i")).alias("r"))
    state = core.checkpoint(side.select("j", "d", F.lit(0.0).alias("x"), "r", (F.col("r") / F.col("d")).alias("p"), F.col("r").alias("r0")))
    square = F.sum(F.col("r") * F.col("r") / F.col("d"))
    left = first = state.agg(square).first()[0]
    for _ in range(most):
        if left <= tolerance ** 2 * first:
            break
        u = _with_margin(c, state.select("j", "p"), "j").groupBy("i").agg((F.sum(F.col("w") * F.col("p")) / F.first("w_i")).alias("u"))
        q = _with_margin(c, u, "i").groupBy("j").agg(F.sum(F.col("w") * F.col("u")).alias("q"))
        step = core.checkpoint(state.join(q, "j").withColumn("q", F.col("d") * F.col("p") - F.col("q")))
        curve = step.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if curve <= 0:
            break
        moved = step.select("j", "d", (F.col("x") + left / curve * F.col("p")).alias("x"), (F.col("r") - left / curve * F.col("q")).alias("r"), "p", "r0")
        before, left = left, moved.agg(square).first()[0]
        state = moved.select("j", "d", "x", "r", (F.col("r") / F.col("d") + left / before * F.col("p")).alias("p"), "r0")
    return float(state.agg(F.sum(F.col("r0") * F.col("x"))).first()[0])


def _shared_part_local(c, tolerance: float, most: int) -> float:
    i, j = c["i"].factorize()[0], c["j"].factorize()[0]
    w, w_i = c["w"].to_numpy(float), np.zeros(i.max() + 1)
    w_i[i] = c["w_i"]
    d, r0 = np.bincount(j, w), np.bincount(j, w * c["d_i"].to_numpy(float))
    x, r, p = np.zeros(len(d)), r0, r0 / d
    left = first = (r * r / d).sum()
    for _ in range(most):
        if left <= tolerance ** 2 * first:
            break
        q = d * p - np.bincount(j, w * (np.bincount(i, w * p[j]) / w_i)[i])
        if (p * q).sum() <= 0:
            break
        size = left / (p * q).sum()
        x, r, before = x + size * p, r - size * q, left
        left = (r * r / d).sum()
        p = r / d + left / before * p
    return float((r0 * x).sum())


def _parts(cells: DataFrame, a: str, b: str) -> int:
    """Connected parts of the design: levels of either factor that are linked by cells."""
    level = lambda side, c: F.xxhash64(F.lit(side), F.col(c))
    edges = cells.select(level(0, a).alias("a"), level(1, b).alias("b"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return neighbours.components(edges, nodes).agg(F.countDistinct("root")).first()[0]


def _two_way_sums(cells: DataFrame, a: str, b: str, na: int, nb: int, equal: bool, variance: float) -> tuple[float, float, float]:
    """Numerators (chi-squares) of a, b and a:b from cell moments and their margins.

    Contrasts of cell means whose variances are v have the statistic by which the sum of (mean - fit)^2 / v rises when the contrasts are
    forced to 0; fits are those of one factor and of both without interaction.
    """
    big, small = (a, b) if na >= nb else (b, a)
    n = F.col("n").cast("double")
    w = n / F.lit(variance) if equal else n * n * (1 - 1 / n) ** 2 / ((n - 1) * F.col("var"))
    c = cells.select(F.col(big).alias("i"), F.col(small).alias("j"), "mean", w.alias("w"))
    by = lambda k: c.groupBy(k).agg((F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias(f"m_{k}"), F.sum("w").alias(f"w_{k}"))
    c = core.checkpoint(_with_margin(_with_margin(c, by("i"), "i"), by("j"), "j")
                        .select("i", "j", "w", "w_i", (F.col("mean") - F.col("m_i")).alias("d_i"), (F.col("mean") - F.col("m_j")).alias("d_j")))
    only = c.agg(F.sum(F.col("w") * F.col("d_i") ** 2).alias("i"), F.sum(F.col("w") * F.col("d_j") ** 2).alias("j")).first()
    of_small = _shared_part(c)
    of_big, both = only["j"] - only["i"] + of_small, only["i"] - of_small
    return (of_big, of_small, both) if big == a else (of_small, of_big, both)


def anova2(df: DataFrame, value: str, between: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Two-way ANOVA with interaction, type II; HC3 covariance when the cells' variances differ.

    In the saturated cell model a row's leverage is 1/n of its cell, so counts, means and variances per cell are sufficient for both forms;
    cells and margins stay on Spark, whatever the number of levels. Degrees of freedom are the ranks: with p connected parts of the design a has
    its levels - p, b likewise, and a:b the rest of cells - p (a source without any has no row); without empty cells that is (levels of a - 1) times
    (levels of b - 1). HC3 needs spread in every cell: where one has none its statistics are missing, as they are without residual spread.
    """
    a, b = between
    cells = core.checkpoint(core.moments(_present(df, value, [a, b], ()), [value], [a, b]).select(a, b, "n", "mean", "var"))
    t = cells.agg(F.count("*").alias("cells"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"), F.sum("n").alias("n"),
                  F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("rss"),
                  F.sum(F.when(F.coalesce("var", F.lit(0.0)) <= 0, 1).otherwise(0)).alias("flat")).first()
    if not t["cells"]:
        raise ValueError("no complete rows")
    label = F.concat_ws(", ", col_of(a), col_of(b))
    equal = equal_variance(df.where(col_of(a).isNotNull() & col_of(b).isNotNull()).withColumn("_cell", label),
                           value, "_cell", (), alpha).first()["equal_var"]
    rss, free, rows = float(t["rss"]), float(t["n"] - t["cells"]), []
    parts = 1 if t["cells"] == t["ka"] * t["kb"] else _parts(cells, a, b)
    known = free > 0 and rss > 0 and (equal or not t["flat"])
    sums = _two_way_sums(cells, a, b, t["ka"], t["kb"], equal, rss / free) if known else (None,) * 3
    for name, chi2, k in zip((a, b, f"{a}:{b}"), sums, (t["ka"] - parts, t["kb"] - parts, t["cells"] - t["ka"] - t["kb"] + parts)):
        if k > 0:
            ss = chi2 * rss / free if known else None
            rows.append({"source": name, "ss": ss, "df": float(k), "f": chi2 / k if known else None,
                         "p_value": dist.f_sf(chi2 / k, k, free) if known else None, "np2": ss / (ss + rss) if known else None})
    for r in rows:
        if r["p_value"] is not None:
            r["significant"] = r["p_value"] < alpha
            r["effect_size"] = next((lab for lim, lab in ETA_BOUNDS if r["np2"] >= lim), "Negligible")
    rows.append({"source": "Residual", "ss": rss, "df": free, "effect_size": "-"})
    for r in rows:
        r["test"] = "Two-way ANOVA" if equal else "Two-way ANOVA (HC3)"
    return core.rows_frame(df.sparkSession, rows, "source string, test string, ss double, df double, f double, "
                           "p_value double, np2 double, significant boolean, effect_size string")


def posthoc2(df: DataFrame, value: str, between: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Post-hoc pairs of the cells, shown as "a, b"; ``a1, a2`` and ``b1, b2`` are the factor levels of either side.

    Cells are told apart by both levels, whatever their text; a pair is turned so that its labels are in order.
    """
    one, two = (col_of(c).cast("string") for c in between)
    cell = df.where(one.isNotNull() & two.isNotNull()).withColumn("_cell", F.to_json(F.struct(one.alias("p"), two.alias("q"))))
    pairs = posthoc(cell, value, "_cell", (), alpha)
    level = lambda c, k: F.get_json_object(F.col(c), f"$.{k}")
    label = lambda c: F.concat_ws(", ", level(c, "p"), level(c, "q"))
    turned = label("a") > label("b")
    first, second = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    out = pairs.withColumns({"_a": first, "_b": second} | {c: F.when(turned, -F.col(c)).otherwise(F.col(c)) for c in ("diff", "t", "hedges")} | {
        "mean_a": F.when(turned, F.col("mean_b")).otherwise(F.col("mean_a")), "mean_b": F.when(turned, F.col("mean_a")).otherwise(F.col("mean_b"))})
    out = out.withColumns({"a": label("_a"), "b": label("_b"), "a1": level("_a", "p"), "a2": level("_a", "q"),
                           "b1": level("_b", "p"), "b2": level("_b", "q")})
    return out.drop("_a", "_b").orderBy("a", "b", "a1", "b1")


def posthoc2_levels(pairs: DataFrame) -> DataFrame:
    """Per level of the first factor: pairs that hold it fixed on both sides, and how many are significant."""
    same = F.col("a1") == F.col("b1")
    seen = pairs.select(F.explode(F.array_distinct(F.array("a1", "b1"))).alias("level"), same.alias("_same"), "significant")
    return seen.groupBy("level").agg(F.count_if("_same").alias("pairs"), F.count_if(F.col("_same") & F.col("significant")).alias("significant_pairs"))


# ----------------------------------------------------------------- chi-square
def chi2_gof(df: DataFrame, column: str, expected=None, order: Sequence | None = None, alpha: float = 0.05) -> DataFrame:
    """Counts against uniform, ratios (sum <= 1.0001) or counts; Cohen w."""
    counts = df.where(col_of(column).isNotNull()).groupBy(col_of(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("o").cast("double").alias("n")
    if expected is None and not order:                       # any number of levels: one row leaves Spark
        counts = core.checkpoint(counts)
        t = counts.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
        n, k = float(t["n"] or 0), t["k"]
        if not n:
            raise ValueError("no complete rows")
        least, ok = n / k, n / k >= 5
        stat = float(counts.agg(F.sum((F.col("n") - n / k) ** 2)).first()[0] / least)
    else:
        if order is None:                                    # ``expected`` names a value for every level
            order = sorted(r["v"] for r in counts.select("v").limit(len(expected) + 1).collect())
        keys, k = list(order), len(order)
        if expected is not None and len(expected) != k:
            raise ValueError(f"expected needs {k} entries")
        exp = [1 / k] * k if expected is None else [float(v) for v in expected]
        shares = expected is None or sum(exp) <= 1.0001
        names = core.rows_frame(df.sparkSession, [{"v": v, "e": e} for v, e in zip(keys, exp)], f"v {counts.schema['v'].dataType.simpleString()}, e double")
        cells = core.checkpoint(names.join(counts.withColumnRenamed("n", "o"), "v", "left").select("e", F.coalesce("o", F.lit(0)).alias("o")))
        n = cells.agg(total).first()["n"]
        e = F.col("e") * n if shares else F.col("e")
        t = cells.agg(F.sum((F.col("o") - e) ** 2 / e).alias("stat"), F.avg((e >= 5).cast("double")).alias("five"), F.min(e).alias("least")).first()
        stat, least, ok = float(t["stat"]), float(t["least"]), bool(t["five"] >= 0.8 and t["least"] >= 1)
    p, w = dist.chi2_sf(stat, k - 1), math.sqrt(stat / n)
    row = {"test": "Chi-square goodness-of-fit", "chi2": round(stat, 4), "dof": k - 1, "p_value": round(p, 6),
           "significant": p < alpha, "effect_w": round(w, 4), "strength": _grade_below(w, CHI2_BOUNDS, "Strong"),
           "min_expected": round(float(least), 2), "assumption": ok,
           "recommend": "Chi-square goodness-of-fit" if ok else "category merge"}
    return core.rows_frame(df.sparkSession, [row], "test string, chi2 double, dof int, p_value double, "
                           "significant boolean, effect_w double, strength string, min_expected double, "
                           "assumption boolean, recommend string")


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """Non-empty cells ``x, y, n``."""
    return (df.where(col_of(x).isNotNull() & col_of(y).isNotNull())
            .groupBy(col_of(x).cast("string").alias("x"), col_of(y).cast("string").alias("y"))
            .agg(F.count(F.lit(1)).alias("n")))


def _cells_at_least(row: dict[int, int], col: dict[int, int], limit: float) -> int:
    """How many (row, column) pairs of margins have a product of at least ``limit``."""
    sizes = np.array(sorted(col), dtype=float)
    tail = np.concatenate([np.cumsum([col[v] for v in sorted(col)][::-1])[::-1], [0]])
    return int(sum(m * tail[int(np.searchsorted(sizes, limit / v, side="left"))] for v, m in row.items()))


def chi2_finish(row: dict[int, int], col: dict[int, int], spread: float, cells: dict, kind: str, alpha: float) -> dict:
    """Finish from margins as {size: how many levels} and ``spread`` = sum n²/(row·col) of the non-empty cells.

    Distinct margin sizes number at most sqrt(2n), whatever the level count.
    """
    r, c = sum(row.values()), sum(col.values())
    n = float(sum(v * m for v, m in row.items()))
    min_exp = min(row) * min(col) / n
    ok = _cells_at_least(row, col, 5 * n) / (r * c) >= 0.8 and min_exp >= 1
    chi2, dof = max(0.0, n * (spread - 1)), (r - 1) * (c - 1)
    name, p = f"Chi-square test of {kind}", float("nan")
    if (r, c) == (2, 2):
        xs, ys = sorted({k[0] for k in cells}), sorted({k[1] for k in cells})
        o = np.array([[cells.get((a, b), 0) for b in ys] for a in xs], dtype=float)
        e = np.outer(o.sum(axis=1), o.sum(axis=0)) / n
        shift = np.minimum(0.5, np.abs(o - e))
        chi2 = float((((np.abs(o - e) - shift) ** 2) / e).sum())
    if dof > 0:
        p = dist.chi2_sf(chi2, dof)
    shown, shown_dof = chi2, dof
    if not ok and (r, c) == (2, 2):
        name, p, shown, shown_dof = "Fisher's exact test", dist.fisher_2x2(*o.astype(int).ravel()), None, None
    small = min(r, c) - 1
    v = math.sqrt(chi2 / (n * small)) if small > 0 else None
    return {"test": name, "chi2": None if shown is None else round(shown, 4), "dof": shown_dof,
            "p_value": None if p != p else round(p, 6), "significant": bool(p < alpha),
            "effect_v": None if v is None else round(v, 4), "strength": _grade_below(v, CHI2_BOUNDS, "Strong"),
            "min_expected": round(float(min_exp), 2), "assumption": bool(ok)}


def chi2_many(counts: DataFrame, alpha: float, kind: str = "independence") -> dict[str, dict]:
    """Tests for every ``variable`` of a count table ``variable, x, y, n``, as result rows."""
    table = core.checkpoint(counts)
    rows = table.groupBy("variable", "x").agg(F.sum("n").alias("row_n"))
    cols = table.groupBy("variable", "y").agg(F.sum("n").alias("col_n"))
    n = F.col("n").cast("double")
    spread = {r["variable"]: r["s"] for r in table.join(rows, ["variable", "x"]).join(cols, ["variable", "y"]).groupBy("variable").agg(
        F.sum(n * n / (F.col("row_n").cast("double") * F.col("col_n"))).alias("s")).collect()}
    margins: dict[str, tuple[dict, dict]] = {v: ({}, {}) for v in spread}
    for i, (m, size) in enumerate(((rows, "row_n"), (cols, "col_n"))):
        for r in m.groupBy("variable", size).count().collect():
            margins[r["variable"]][i][r[size]] = r["count"]
    two = [v for v, (a, b) in margins.items() if sum(a.values()) == 2 and sum(b.values()) == 2]
    cells: dict[str, dict] = {v: {} for v in spread}
    if two:
        for r in table.where(F.col("variable").isin(*two)).collect():
            cells[r["variable"]][r["x"], r["y"]] = r["n"]
    return {v: chi2_finish(*margins[v], spread[v], cells[v], kind, alpha) for v in spread}


CHI2_SCHEMA = ("row string, col string, test string, chi2 double, dof int, p_value double, significant boolean, "
               "effect_v double, strength string, min_expected double, assumption boolean")


def chi2_table(df: DataFrame, x: str, y: str, alpha: float = 0.05, kind: str = "independence") -> DataFrame:
    """Contingency test; Yates for 2x2, Fisher when a 2x2 table breaks the assumption."""
    core.require(df, [x, y])
    found = chi2_many(contingency(df, x, y).withColumn("variable", F.lit(x)), alpha, kind)
    if not found:
        raise ValueError("no complete rows")
    return core.rows_frame(df.sparkSession, [{"row": x, "col": y, **found[x]}], CHI2_SCHEMA)


def chi2_homogeneity(df: DataFrame, group: str, category: str, alpha: float = 0.05) -> DataFrame:
    return chi2_table(df, group, category, alpha, "homogeneity")
