"""Exploratory analysis: single-variable verdicts, tests against a target, variable selection.

A whole chapter is a handful of Spark jobs over all variables at once; the
verdict tables that come out have one row per variable or pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statframe.functions import dist
from statframe.operators import core, correlation, frames, hypothesis, quality
from statframe.operators.core import col_of, div, num
from statframe.sources import io

# Bounds of the verdict rules.
OUTLIER_BOUNDS = ((0.01, "few"), (0.03, "some"), (0.05, "rather many"))
BALANCE_BOUNDS = ((2, "balanced"), (5, "fairly balanced"), (15, "somewhat imbalanced"))
POSTHOC_BOUNDS = ((0.3, "low"), (0.6, "medium"))
INTEGER_SHARE, SPARSE_SHARE, RARE_LEVEL, WEAK_MONOTONE = 0.9, 0.01, 0.01, 0.1
ETA_ENOUGH, CRAMER_ENOUGH, MAX_PARTNERS = 0.06, 0.1, 3


def below(x: Column, bounds, over: str) -> Column:
    """Label of the first bound the value stays under."""
    out = F.when(x.isNull(), None)
    for limit, label in bounds:
        out = out.when(x < limit, label)
    return out.otherwise(over)


def is_classification(df: DataFrame, target: str, task: str | None = None) -> bool:
    if task is not None:
        return task.strip().lower().startswith("clas")
    return target not in core.numeric_columns(df)


def split(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    """Continuous and nominal feature names."""
    core.require(df, [target])
    numeric = [c for c in core.numeric_columns(df) if c != target]
    marked = set(core.nominal_columns(df))
    nominal = [c for c in df.columns if c != target and c not in numeric
               and (c in marked or df.schema[c].dataType.typeName() in ("string", "boolean"))]
    return numeric, nominal


# -------------------------------------------------------------- one variable
def continuous_insight(df: DataFrame, cols: Sequence[str] | None = None, description: DataFrame | None = None) -> DataFrame:
    """Shape, peaks, outliers, discreteness and suggested action per numeric column."""
    cols = list(cols or core.numeric_columns(df))
    desc = description if description is not None else quality.numerical_summary(df, cols)
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), num(c).alias("value")) for c in cols]))).where(
        F.col("value").isNotNull())
    per = values.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    top = F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))
    spread = per.groupBy("variable").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique"), F.min(top).alias("_top"),
        F.coalesce(F.sum(F.when(F.col("value") == F.round("value"), F.col("n"))), F.lit(0)).alias("integers"),
        F.coalesce(F.sum(F.when(F.col("value") == 0, F.col("n"))), F.lit(0)).alias("zeros"))
    both = desc.where(F.col("variable").isin(*cols)).join(spread, "variable").join(frames.peaks(df, cols), "variable")
    s = F.abs("skew")
    strength = F.when(s < 0.5, "nearly symmetric").when(s < 1, "moderate").when(s < 2, "strong").otherwise("very strong")
    side = F.when(s < 0.5, "").when(F.col("skew") > 0, " right").otherwise(" left")
    unique_share, integer_share = div(F.col("unique"), F.col("total")), div(F.col("integers"), F.col("total"))
    many = F.col("outliers_ratio") >= OUTLIER_BOUNDS[-1][0]
    actions = F.array_compact(F.array(
        F.when(F.col("zeros") > 0, "check zeros"), F.when(F.col("log_need") != "none", F.concat(F.lit("try "), F.col("log_need"))),
        F.when(many, "treat outliers")))
    return both.select(
        "variable", "skew", "kurt", F.concat(strength, side).alias("shape"),
        F.when(F.col("kurt") > 0, "peaked").when(F.col("kurt") < 0, "flat").otherwise("near normal").alias("tails"),
        "peaks", F.when(F.col("peaks").isNull(), "-").when(F.col("peaks") <= 1, "single").otherwise("several").alias("peak_verdict"),
        "upper_outliers", "lower_outliers", "outliers_ratio", below(F.col("outliers_ratio"), OUTLIER_BOUNDS, "many").alias("outlier_verdict"),
        "unique", unique_share.alias("unique_share"), F.col("_top.v").alias("mode"), div(-F.col("_top.k"), F.col("total")).alias("mode_share"),
        integer_share.alias("integer_share"), "zeros",
        F.when(F.col("zeros") > 0, "zeros").when(integer_share >= INTEGER_SHARE, "integer grid")
        .when(unique_share <= SPARSE_SHARE, "sparse values").otherwise("continuous").alias("discreteness"),
        "log_need", F.when(F.size(actions) == 0, "use as is").otherwise(F.array_join(actions, "; ")).alias("action"))


def nominal_insight(df: DataFrame, cols: Sequence[str], target: str | None = None, classification: bool = False) -> DataFrame:
    """Levels, largest and smallest level, balance and suggested action per nominal column."""
    counts = quality.value_counts(df, cols)
    big = F.struct((-F.col("count")).alias("k"), F.col("value").alias("v"))
    small = F.struct(F.col("count").alias("k"), F.col("value").alias("v"))
    g = counts.groupBy("variable").agg(F.count(F.lit(1)).alias("levels"), F.sum("count").alias("total"),
                                       F.min(big).alias("_b"), F.min(small).alias("_s"))
    fold, rare = div(-F.col("_b.k"), F.col("_s.k")), div(F.col("_s.k"), F.col("total"))
    levels, is_target = F.col("levels"), F.col("variable") == F.lit(target or "")
    use = F.when(is_target, "target").when(F.lit(classification), "chi-square").when(levels == 2, "t test").when(
        levels >= 3, "ANOVA").otherwise("no test")
    actions = F.array_compact(F.array(use, F.when(is_target & (fold >= BALANCE_BOUNDS[-1][0]), "rebalance classes"),
                                      F.when(rare < RARE_LEVEL, F.concat(F.lit("merge rare level "), F.col("_s.v")))))
    return g.select(
        "variable", "levels", F.when(levels == 2, "two groups").when(levels >= 3, "three or more").otherwise("single level").alias("kind"),
        F.col("_b.v").alias("top"), (-F.col("_b.k")).alias("top_n"), div(-F.col("_b.k"), F.col("total")).alias("top_share"),
        F.col("_s.v").alias("bottom"), F.col("_s.k").alias("bottom_n"), rare.alias("bottom_share"),
        (rare < RARE_LEVEL).alias("has_rare_level"), fold.alias("fold"), below(fold, BALANCE_BOUNDS, "imbalanced").alias("balance"),
        F.array_join(actions, "; ").alias("action"))


def scope(df: DataFrame, target: str, task: str | None = None) -> DataFrame:
    """Which analysis applies for each target kind × feature kind, with the features concerned."""
    clf = is_classification(df, target, task)
    numeric, nominal = split(df, target)
    levels = _level_counts(df, nominal)
    groups = {"continuous": numeric, "nominal, 2 levels": [c for c in nominal if levels[c] == 2],
              "nominal, 3+ levels": [c for c in nominal if levels[c] >= 3]}
    target_levels = _level_counts(df, [target])[target] if clf else 0
    mine = ("nominal, 2 levels" if target_levels == 2 else "nominal, 3+ levels") if clf else "continuous"
    method = {("continuous", "continuous"): "correlation", ("continuous", "nominal, 2 levels"): "two-sample test",
              ("continuous", "nominal, 3+ levels"): "ANOVA", ("nominal, 2 levels", "continuous"): "two-sample test",
              ("nominal, 3+ levels", "continuous"): "ANOVA"}
    rows = [{"target_kind": t, "feature_kind": f, "analysis": method.get((t, f), "chi-square"), "applies": t == mine and bool(v),
             "features": ", ".join(v) if t == mine else ""} for t in groups for f, v in groups.items()]
    return core.rows_frame(df.sparkSession, rows, "target_kind string, feature_kind string, analysis string, applies boolean, features string")


def _level_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    if not cols:
        return {}
    return {r["variable"]: r["unique"] for r in quality.categorical_summary(df, cols).collect()}


# ------------------------------------------------------------ target and tests
TEST_SCHEMA = ("variable string, family string, test string, statistic double, p_value double, effect double, "
               "effect_size string, significant boolean, verdict string, reason string")


def decide(family: str, significant: bool, effect: float | None, threshold: float, alpha: float = 0.05) -> tuple[str, str]:
    """accept / candidate / reject from significance and effect size."""
    if not significant:
        return "reject", f"not significant (p >= {alpha})"
    if family == "t":
        return "accept", "groups differ"
    limit, name = {"corr": (threshold, "|coef|"), "anova": (ETA_ENOUGH, "eta squared"), "chi2": (CRAMER_ENOUGH, "V")}[family]
    if effect is not None and abs(effect) >= limit:
        return "accept", f"significant, {name} >= {limit}"
    return "candidate", f"significant, but {name} < {limit}"


def _row(variable, family, test, statistic, p, effect, label, alpha, threshold) -> dict:
    significant = p is not None and p == p and p < alpha
    verdict, reason = decide(family, significant, effect, threshold, alpha)
    return {"variable": variable, "family": family, "test": test, "statistic": statistic, "p_value": p, "effect": effect,
            "effect_size": label, "significant": significant, "verdict": verdict, "reason": reason}


def correlation_tests(df: DataFrame, target: str, features: Sequence[str], alpha: float = 0.05, threshold: float = 0.3,
                      pairs: list | None = None) -> list[dict]:
    """Numeric features against a numeric target."""
    if not features:
        return []
    pairs = pairs or correlation.correlation_pairs(df, [*features, target], alpha, [(f, target) for f in features]).collect()
    return [_row(r["x"], "corr", r["method"], r["coef"], r["p_value"], r["coef"], r["strength"], alpha, threshold) for r in pairs]


def _groups_long(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``feature, value, level`` rows for (name, numeric column, nominal column) triples."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("feature"), num(y).alias("value"), col_of(g).cast("string").alias("level")) for v, y, g in pairs])))
    return long.where(F.col("value").isNotNull() & F.col("level").isNotNull())


def two_group_tests(df: DataFrame, pairs: Sequence[tuple[str, str, str]], alpha: float = 0.05, threshold: float = 0.3) -> list[dict]:
    """Two-level splits, all variables in one grouped plan per statistic; two-sided."""
    if not pairs:
        return []
    long = _groups_long(df, pairs)
    first = F.broadcast(long.groupBy("feature").agg(F.min("level").alias("_first")))      # one row per variable
    data = core.checkpoint(long.join(first, "feature").select(
        "feature", "value", F.when(F.col("level") == F.col("_first"), "1").otherwise("2").alias("g")))
    check = {r["feature"]: r for r in hypothesis.equal_variance(data, "value", "g", ["feature"], alpha).collect()}
    t = {r["feature"]: r for r in hypothesis.t_statistics(data, "value", "g", ["1", "2"], ["feature"]).collect()}
    ranks = [v for v, r in check.items() if not r["all_normal"]]
    u = {}
    if ranks:
        u = {r["feature"]: r for r in hypothesis.u_statistics(
            data.where(F.col("feature").isin(*ranks)), "value", "g", ["1", "2"], ["feature"]).collect()}
    rows = []
    for v, _, _ in pairs:
        if v not in check:
            continue
        if v in u:
            name, stat, p = "Mann-Whitney U test", u[v]["u"], hypothesis._u_p(u[v]["u"], u[v], "two-sided")
        else:
            kind = "student" if check[v]["equal_var"] else "welch"
            name, stat = f"{kind.title()} t-test", t[v][f"t_{kind}"]
            p = dist.t_p(stat, t[v][f"df_{kind}"])
        p = round(p, 4) if p == p else None
        rows.append(_row(v, "t", name, round(stat, 4), p, None, None, alpha, threshold))
    return rows


def many_group_tests(df: DataFrame, pairs: Sequence[tuple[str, str, str]], alpha: float = 0.05, threshold: float = 0.3) -> list[dict]:
    """Splits of three or more levels: one ANOVA plan keyed by the variable."""
    if not pairs:
        return []
    out = hypothesis.anova(_groups_long(df, pairs), "value", "level", ["feature"], alpha).collect()
    return [_row(r["feature"], "anova", r["test"], r["f"], r["p_value"], r["np2"], r["effect_size"], alpha, threshold) for r in out]


def table_tests(df: DataFrame, target: str, features: Sequence[str], alpha: float = 0.05, threshold: float = 0.3) -> list[dict]:
    """Nominal features against a nominal target: one count job for all of them."""
    if not features:
        return []
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), col_of(c).cast("string").alias("x"),
                                                 col_of(target).cast("string").alias("y")) for c in features])))
    counts = long.dropna().groupBy("variable", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    found = hypothesis.chi2_many(counts, alpha)
    return [_row(v, "chi2", r["test"], r["chi2"], r["p_value"], r["effect_v"], r["strength"], alpha, threshold)
            for v, r in sorted(found.items())]


def shared_pairs(df: DataFrame, target: str, task: str | None = None, alpha: float = 0.05, stats: dict | None = None, quartiles: dict | None = None) -> tuple[list, list]:
    """Pair correlations among numeric features, and with a numeric target, from one shared computation."""
    numeric, _ = split(df, target)
    if is_classification(df, target, task):
        rows = correlation.correlation_pairs(df, numeric, alpha).collect() if len(numeric) > 1 else []
        return rows, []
    if not numeric:
        return [], []
    rows = correlation.correlation_pairs(df, [*numeric, target], alpha, None, stats, quartiles).collect()
    return [r for r in rows if r["y"] != target], [r for r in rows if r["y"] == target]


def target_rows(df: DataFrame, target: str, task: str | None = None, alpha: float = 0.05, corr_threshold: float = 0.3,
                pairs: list | None = None) -> list[dict]:
    """Every feature against the target with the test that fits the kinds."""
    clf = is_classification(df, target, task)
    numeric, nominal = split(df, target)
    levels = _level_counts(df, nominal)
    if not clf:
        two = [(c, target, c) for c in nominal if levels[c] == 2]
        more = [(c, target, c) for c in nominal if levels[c] >= 3]
        rows = correlation_tests(df, target, numeric, alpha, corr_threshold, pairs)
        return rows + two_group_tests(df, two, alpha, corr_threshold) + many_group_tests(df, more, alpha, corr_threshold)
    pairs = [(c, c, target) for c in numeric]
    binary = _level_counts(df, [target])[target] == 2
    rows = (two_group_tests if binary else many_group_tests)(df, pairs, alpha, corr_threshold)
    return rows + table_tests(df, target, [c for c in nominal if levels[c] >= 2], alpha, corr_threshold)


def target_tests(df: DataFrame, target: str, task: str | None = None, alpha: float = 0.05, corr_threshold: float = 0.3) -> DataFrame:
    return core.rows_frame(df.sparkSession, target_rows(df, target, task, alpha, corr_threshold), TEST_SCHEMA)


# ------------------------------------------------------------------- selection
def collinear_groups(pairs: Sequence, features: Sequence[str], threshold: float = 0.7) -> tuple[dict, dict]:
    """Partners with |coef| >= threshold per variable, the strongest first, and the number of the connected group (from 1).

    The features are few (columns): groups are the rows of the closure of the matrix of strong pairs.
    """
    at = {v: i for i, v in enumerate(features)}
    coef = np.full((len(at), len(at)), np.nan)
    for r in pairs:
        if r["coef"] is not None and r["x"] in at and r["y"] in at:
            coef[at[r["x"]], at[r["y"]]] = coef[at[r["y"]], at[r["x"]]] = r["coef"]
    strong = np.abs(coef) >= threshold
    reach = strong | np.eye(len(at), dtype=bool)
    while (wider := reach @ reach).sum() > reach.sum():
        reach = wider
    names = list(features)
    partners = {v: [(names[j], float(coef[i, j])) for j in sorted(np.flatnonzero(strong[i]), key=lambda j: (-abs(coef[i, j]), j))] for v, i in at.items()}
    heads = [i for i in range(len(names)) if strong[i].any() and reach[i].argmax() == i]
    return partners, {names[j]: number for number, i in enumerate(heads, 1) for j in np.flatnonzero(reach[i])}


def choose_representatives(table: DataFrame) -> DataFrame:
    """In each collinear group the largest effect (then p, then name) keeps its verdict, the others become candidates.

    ``table`` has ``variable, verdict, effect, p_value, collinear_group``; rejected rows do not compete.
    """
    size = F.abs(F.coalesce("effect", F.lit(0.0)))
    running = (F.col("verdict") != "reject") & F.col("collinear_group").isNotNull()
    w = Window.partitionBy("collinear_group", running).orderBy(size.desc(), "p_value", "variable")
    out = table.withColumn("_place", F.when(running, F.row_number().over(w))).withColumn(
        "_head", F.when(running, F.first("variable").over(w))).withColumn(
        "_gap", F.when(running, F.first(size).over(w) - size)).withColumn(
        "_members", F.when(running, F.count(F.lit(1)).over(Window.partitionBy("collinear_group", running))))
    yields = F.col("_place") > 1
    note = F.when(yields, F.concat(F.col("reason"), F.lit("; yields to "), F.col("_head"), F.format_string(" (gap %.4f)", F.col("_gap")))).when(
        F.col("_members") > 1, F.concat(F.col("reason"), F.lit("; leads its collinear group"))).otherwise(F.col("reason"))
    return out.withColumn("reason", note).withColumn("verdict", F.when(yields, "candidate").otherwise(F.col("verdict"))).drop(
        "_place", "_head", "_gap", "_members")


def selection_table(df: DataFrame, target: str, task: str | None = None, alpha: float = 0.05, corr_threshold: float = 0.3,
                    collinearity_threshold: float = 0.7, description: DataFrame | None = None,
                    pairs: list | None = None, rows: list[dict] | None = None) -> DataFrame:
    """Final table: verdict, test, p, effect, skew and collinearity signals, reason."""
    spark = df.sparkSession
    numeric, _ = split(df, target)
    stats = quartiles = None
    if pairs is None or rows is None:
        if description is None and numeric and target in core.numeric_columns(df) and not is_classification(df, target, task):
            # correlations and the summary need the same moments and quartiles
            stats = core.moments_dict(df, [*numeric, target])
            quartiles = core.quantiles(df, [*numeric, target], [.25, .5, .75], {c: s["n"] for c, s in stats.items()})
        pairs, with_target = shared_pairs(df, target, task, alpha, stats, quartiles)
        rows = target_rows(df, target, task, alpha, corr_threshold, with_target)
    partners, groups = collinear_groups(pairs, numeric, collinearity_threshold)
    desc = description if description is not None else (quality.numerical_summary(df, numeric, stats=stats, quartiles=quartiles) if numeric else None)
    skew = {r["variable"]: f"{r['skew_interpret']} / {r['log_need']}" for r in desc.collect()} if desc is not None else {}
    for r in rows:
        v = r["variable"]
        r["skew_signal"] = skew.get(v, "not applicable")
        r["collinear_group"] = groups.get(v)
        r["collinear_with"] = ", ".join(f"{o} {c:.3f}" for o, c in partners.get(v, [])[:MAX_PARTNERS]) or None
    table = core.rows_frame(spark, rows, TEST_SCHEMA + ", skew_signal string, collinear_group int, collinear_with string")
    order = F.when(F.col("verdict") == "accept", 0).when(F.col("verdict") == "candidate", 1).otherwise(2)
    return choose_representatives(table).orderBy(order, F.abs(F.coalesce("effect", F.lit(0.0))).desc(), "p_value", "variable")


def feature_correlation(df: DataFrame, target: str, alpha: float = 0.05, collinearity_threshold: float = 0.7,
                        rows: list | None = None) -> dict[str, DataFrame]:
    """Correlation matrix, strongest partners, collinear groups and VIF of the numeric features."""
    numeric, _ = split(df, target)
    if len(numeric) < 2:
        return {}
    rows = rows or correlation.correlation_pairs(df, numeric, alpha).collect()
    pairs = core.rows_frame(df.sparkSession, [r.asDict() for r in rows], correlation.PAIR_SCHEMA)
    _, groups = collinear_groups(rows, numeric, collinearity_threshold)
    rows = [{"variable": v, "collinear_group": g} for v, g in groups.items()]
    return {"pairs": pairs, "matrix": correlation.correlation_matrix(pairs), "summary": correlation.correlation_summary(pairs),
            "groups": core.rows_frame(df.sparkSession, rows, "variable string, collinear_group int"), "vif": correlation.vif(df, numeric)}


# ------------------------------------------------------- verdicts on the tests
def hetero_signal(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> dict:
    """Breusch-Pagan LM of y on x."""
    from statframe.operators import ols

    b = ols.fit(df.select(x, y).dropna(), y, [x]).breusch_pagan(alpha)
    return {"lm": b["lm"], "p_value": b["lm_p"], "verdict": "heteroscedastic" if b["lm_p"] < alpha else "homoscedastic"}


def correlation_insight(df: DataFrame, target: str, features: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Linear or monotone, strength and direction, scatter and influential points per numeric feature."""
    pairs = correlation.correlation_pairs(df, [*features, target], alpha, [(f, target) for f in features]).collect()
    rows = []
    for r in pairs:
        rho, pear = r["spearman"], r["pearson"]
        size = abs(rho or 0.0)
        level = "strong" if size > 0.7 else "medium" if size > 0.3 else "weak" if size > WEAK_MONOTONE else "none"
        bp = hetero_signal(df, r["x"], target, alpha)
        shape = "linear" if r["linearity"] else "monotone, not linear" if size - abs(pear or 0.0) >= 0.02 else "not linear"
        rows.append({"variable": r["x"], "pearson": pear, "spearman": rho, "shape": shape, "monotone": level,
                     "direction": None if level == "none" else "increasing" if rho > 0 else "decreasing",
                     "bp_p_value": bp["p_value"], "scatter": bp["verdict"], "scatter_matters": size >= WEAK_MONOTONE,
                     "influential_outlier": r["influential_outlier"]})
    return core.rows_frame(df.sparkSession, rows, "variable string, pearson double, spearman double, shape string, monotone string, "
                           "direction string, bp_p_value double, scatter string, scatter_matters boolean, influential_outlier boolean")


def anova_insight(df: DataFrame, pairs: Sequence[tuple[str, str, str]], alpha: float = 0.05) -> DataFrame:
    """ANOVA with the share of post-hoc pairs that really differ (significant and not negligible)."""
    long = _groups_long(df, pairs)
    head = hypothesis.anova(long, "value", "level", ["feature"], alpha)
    after = hypothesis.posthoc(long, "value", "level", ["feature"], alpha)
    real = F.col("significant") & (F.col("effect_size") != "Negligible")
    g = after.groupBy("feature").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("significant").alias("significant_pairs"),
                                      F.count_if(real).alias("real_pairs"))
    share = div(F.col("real_pairs"), F.col("pairs"))
    return head.select("feature", "test", "f", "p_value", "np2", "effect_size", "significant").join(g, "feature").withColumn(
        "discrimination", below(share, POSTHOC_BOUNDS, "high")).withColumnRenamed("feature", "variable")


def hue_lines(df: DataFrame, target: str) -> DataFrame:
    """Target against each numeric feature within each level of nominal columns with 2 to 10 levels."""
    numeric, nominal = split(df, target)
    levels = _level_counts(df, nominal)
    out = None
    y = num(target)
    for c in [c for c in nominal if 2 <= levels[c] <= 10]:
        wide = df.where(col_of(c).isNotNull()).groupBy(col_of(c).cast("string").alias("level")).agg(*[
            a for i, x in enumerate(numeric) for a in (F.regr_count(y, num(x)).alias(f"n{i}"), F.regr_slope(y, num(x)).alias(f"s{i}"),
                                                       F.corr(y, num(x)).alias(f"r{i}"))])
        one = wide.select(F.lit(c).alias("hue"), "level", F.inline(F.array(*[
            F.struct(F.lit(x).alias("variable"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("slope"), F.col(f"r{i}").alias("corr"))
            for i, x in enumerate(numeric)])))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ whole flows
def describe(df: DataFrame, target: str, task: str | None = None) -> dict[str, DataFrame]:
    """Chapters 1 and 2: summaries, scope and single-variable verdicts."""
    numeric, nominal = split(df, target)
    clf = is_classification(df, target, task)
    out = {"scope": scope(df, target, task)}
    cont = numeric if clf else [target, *numeric]
    cat = [target, *nominal] if clf else nominal
    if cont:
        out["numeric"] = core.checkpoint(quality.numerical_summary(df, cont))
        out["continuous_insight"] = continuous_insight(df, cont, out["numeric"])
    if cat:
        out["nominal"] = quality.categorical_summary(df, cat)
        out["nominal_insight"] = nominal_insight(df, cat, target if clf else None, clf)
    return out


def run(df: DataFrame, target: str, task: str | None = None, alpha: float = 0.05, corr_threshold: float = 0.3,
        collinearity_threshold: float = 0.7) -> dict[str, DataFrame]:
    """All chapters as frames; summaries, pair correlations and tests are computed once and shared."""
    out = describe(df, target, task)
    numeric, _ = split(df, target)
    pairs, with_target = shared_pairs(df, target, task, alpha)
    out |= {f"feature_{k}": v for k, v in feature_correlation(df, target, alpha, collinearity_threshold, pairs).items()}
    rows = target_rows(df, target, task, alpha, corr_threshold, with_target)
    out["tests"] = core.rows_frame(df.sparkSession, rows, TEST_SCHEMA)
    out["selection"] = selection_table(df, target, task, alpha, corr_threshold, collinearity_threshold,
                                       out.get("numeric"), pairs, rows)
    if not is_classification(df, target, task) and numeric:
        lines = hue_lines(df, target)
        if lines is not None:
            out["hue_lines"] = lines
    return out


def quality_report(df: DataFrame, duplicates: int, removed: bool, missing: DataFrame, numeric: DataFrame | None) -> DataFrame:
    """``item, variable, value, verdict`` rows that sum up a quality check."""
    n_cols = len(df.columns)
    count = len(core.numeric_columns(df))
    rows = [{"item": "numeric columns", "value": float(count)}, {"item": "nominal columns", "value": float(n_cols - count)},
            {"item": "duplicate rows", "value": float(duplicates), "verdict": "removed" if removed else "kept" if duplicates else "none"}]
    gone = missing.agg(F.sum("missing")).first()[0] or 0
    rows.append({"item": "missing values", "value": float(gone), "verdict": "present" if gone else "none"})
    schema = "item string, variable string, value double, verdict string"
    out = core.rows_frame(df.sparkSession, rows, schema)
    if numeric is not None:
        out = out.unionByName(numeric.select(F.inline(F.array(
            F.struct(F.lit("skew").alias("item"), "variable", F.col("skew").alias("value"), F.col("log_need").alias("verdict")),
            F.struct(F.lit("outlier share").alias("item"), "variable", F.col("outliers_ratio").alias("value"),
                     below(F.col("outliers_ratio"), OUTLIER_BOUNDS, "many").alias("verdict"))))))
    return out


def quality_check(df: DataFrame, drop_duplicates: bool = True, save_path: str | None = None) -> dict[str, DataFrame]:
    """Mark non-numeric columns nominal, drop duplicate rows, then missing, numeric and nominal reports."""
    typed = df
    for f in df.schema:
        if not core.is_numeric(f.dataType) and f.dataType.typeName() == "string":
            typed = typed.withMetadata(f.name, {**f.metadata, "nominal": True})
    dup = quality.duplicate_report(typed).first()["duplicates"]
    clean = quality.drop_duplicates(typed) if drop_duplicates and dup else typed
    numeric, nominal = core.numeric_columns(clean), [f.name for f in clean.schema if f.metadata.get("nominal")]
    out = {"data": clean, "missing": quality.missing_report(clean)}
    if numeric:
        out["numeric"] = core.checkpoint(quality.numerical_summary(clean, numeric))
    if nominal:
        out["nominal"] = quality.categorical_summary(clean, nominal)
    out["report"] = quality_report(clean, dup, bool(drop_duplicates and dup), out["missing"], out.get("numeric"))
    if save_path:
        io.save(clean, save_path)
    return out


