"""Data-quality checks and descriptive summaries."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statframe.functions import pvalue
from statframe.operators import core
from statframe.operators.core import div, num

_CASTS = {"int": "bigint", "float": "double", "string": "string", "category": "string", "datetime": "timestamp"}


def set_type(df: DataFrame, as_int=(), as_float=(), as_string=(), as_category=(), as_datetime=(),
             levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Cast columns; a category is a string marked ``nominal`` in its metadata (with levels if given)."""
    wanted = {"int": as_int, "float": as_float, "string": as_string,
              "category": as_category, "datetime": as_datetime}
    flat = {c: kind for kind, cols in wanted.items() for c in core.as_list(cols)}
    core.require(df, list(flat))
    out = df.withColumns({c: F.col(f"`{c}`").cast(_CASTS[k]) for c, k in flat.items()})
    for c, kind in flat.items():
        if kind == "category":
            meta = {"nominal": True, **({"levels": levels[c]} if levels and c in levels else {})}
            out = out.withMetadata(c, meta)
    return out


numeric_columns = core.numeric_columns
nominal_columns = core.nominal_columns


def duplicate_report(df: DataFrame) -> DataFrame:
    """One row: total rows, distinct rows, rows beyond the first copy."""
    cols = [f"`{c}`" for c in df.columns]
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
                      F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def _missing(df: DataFrame, c: str) -> Column:
    x = core.col_of(c)
    if df.schema[c].dataType.typeName() in ("double", "float"):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: missing count and percent of rows."""
    cols = list(cols or df.columns)
    parts = []
    for part in core.chunks(cols, 200):
        wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                      *[F.count_if(_missing(df, c)).alias(f"_{i}") for i, c in enumerate(part)])
        parts.append(wide.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("variable"), F.col("_rows").alias("rows"), F.col(f"_{i}").alias("missing"),
                     (div(F.col(f"_{i}"), F.col("_rows")) * 100).alias("missing_pct"))
            for i, c in enumerate(part)]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ numeric
def log_need(skew: Column, kurt: Column, low: Column) -> Column:
    """Which log transform the tail calls for (fixed rule on skew, kurtosis, minimum)."""
    right = (skew >= 1) | ((skew > 0.5) & (kurt > 0))
    left = (skew <= -1) | ((skew < -0.5) & (kurt > 0))
    return (F.when(right, F.when(low > 0, "log").when(low == 0, "log1p").otherwise("none"))
            .when(left, "reverse_log1p").otherwise("none"))


def _describe(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Finish ``by…, variable, rows, n, …, q25, q50, q75, upper_outliers, lower_outliers``."""
    skew = core.sample_skew(F.col("skew"), F.col("n"))
    kurt = core.sample_kurt(F.col("kurt"), F.col("n"))
    base = stats.select(
        *by, "variable", F.col("n").alias("count"), "rows", "mean", F.sqrt("var").alias("std"), "min",
        "q25", "q50", "q75", "max", skew.alias("skew"), kurt.alias("kurt"), "upper_outliers", "lower_outliers")
    rel = div(F.abs(F.col("mean") - F.col("q50")), F.col("q50"))
    iqr = F.col("q75") - F.col("q25")
    both = F.col("upper_outliers") + F.col("lower_outliers")
    s, k = F.col("skew"), F.col("kurt")
    return base.select(
        *by, "variable", "count", "mean", "std", "min", "q25", "q50", "q75", "max",
        rel.alias("rel_diff"),
        F.when(rel < 0.1, "similar").when(rel < 0.5, "diff").otherwise("large_diff").alias("rdiff_flag"),
        iqr.alias("iqr"),
        (F.col("q75") + 1.5 * iqr).alias("upper_bound"), (F.col("q25") - 1.5 * iqr).alias("lower_bound"),
        "upper_outliers", div(F.col("upper_outliers"), F.col("rows")).alias("upper_outliers_ratio"),
        "lower_outliers", div(F.col("lower_outliers"), F.col("rows")).alias("lower_outliers_ratio"),
        both.alias("outliers"), div(both, F.col("rows")).alias("outliers_ratio"),
        "skew",
        F.when(s < -0.5, "left tail").when(s > 0.5, "right tail").otherwise("symmetric").alias("skew_interpret"),
        "kurt",
        F.when(k < 0, "platykurtic").when(k > 0, "leptokurtic").otherwise("mesokurtic").alias("kurt_interpret"),
        log_need(s, k, F.col("min")).alias("log_need"))


def numerical_summary(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (),
                      approx: bool = False, stats: dict | None = None, quartiles: dict | None = None) -> DataFrame:
    """One row per numeric column: moments, exact quartiles, outlier counts, shape verdicts.

    ``approx=True`` is one scan whatever the table: quartiles and outlier counts come from mergeable sketches (``sketch``), whose ranks are off
    by about 0.1 % of the rows; everything else is exact. Without ``by``, ``stats`` (``core.moments_dict``) and ``quartiles`` of the columns save their passes.
    """
    cols, by = list(cols or core.numeric_columns(df)), list(by)
    core.require_numeric(df, cols)
    if approx:
        return _sketched_summary(df, cols, by)
    if by:
        return _grouped_summary(df, cols, by)
    spark = df.sparkSession
    stats = stats or core.moments_dict(df, cols)
    q = quartiles or core.quantiles(df, cols, [.25, .5, .75], {c: stats[c]["n"] for c in cols})
    counts = {}
    for part in core.chunks(cols, core.LIMITS.agg_columns):
        aggs = []
        for i, c in enumerate(part):
            lo, _, hi = q[c]
            up = F.lit(None).cast("boolean") if lo is None else num(c) > hi + 1.5 * (hi - lo)
            down = F.lit(None).cast("boolean") if lo is None else num(c) < lo - 1.5 * (hi - lo)
            aggs += [F.count_if(up).alias(f"u{i}"), F.count_if(down).alias(f"d{i}")]
        row = df.agg(*aggs).first()
        counts.update({c: (row[f"u{i}"], row[f"d{i}"]) for i, c in enumerate(part)})
    rows = [{**stats[c], "q25": q[c][0], "q50": q[c][1], "q75": q[c][2],
             "upper_outliers": counts[c][0], "lower_outliers": counts[c][1]} for c in cols]
    return _describe(core.rows_frame(
        spark, rows, "variable string, rows long, n long, mean double, var double, skew double, kurt double, "
        "min double, max double, q25 double, q50 double, q75 double, upper_outliers long, lower_outliers long"), [])


#: Size parameter of quantile sketches: ranks are off by about 0.1 %, a sketch has some 50 KB.
SKETCH_K = 3_000


def sketch(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """``by…, variable, n, min, max, sketch``: a mergeable quantile sketch (KLL) of each column, in one scan.

    Sketches are ordinary rows: keep them with a partition or a day, and put them together with ``merge_sketches``. A column without values
    has n = 0 and its sketch is not read.
    """
    parts = []
    for part in core.chunks(list(cols), core.LIMITS.agg_columns):
        wide = df.groupBy(*by).agg(*[a for i, c in enumerate(part) for a in (
            F.count(num(c)).alias(f"_{i}_n"), F.min(num(c)).alias(f"_{i}_min"), F.max(num(c)).alias(f"_{i}_max"), F.kll_sketch_agg_double(num(c), k).alias(f"_{i}_s"))])
        parts.append(wide.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"_{i}_n").alias("n"), F.col(f"_{i}_min").alias("min"),
                                                                  F.col(f"_{i}_max").alias("max"), F.col(f"_{i}_s").alias("sketch")) for i, c in enumerate(part)]))))
    return functools.reduce(DataFrame.unionByName, parts)


def merge_sketches(*tables: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tables of ``sketch`` as one: the sketches of all their rows together, by the given keys."""
    every = functools.reduce(DataFrame.unionByName, tables).where("n > 0")
    return every.groupBy(*by, "variable").agg(F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``sketches`` with ``q``, an array of quantiles instead of the sketch; missing without values."""
    ranks = F.array(*[F.lit(float(p)) for p in probs])
    return sketches.withColumn("q", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", ranks))).drop("sketch")


def _sketched_summary(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    parts = []
    for part in core.chunks(cols, core.LIMITS.agg_columns):
        aggs = [a for i, c in enumerate(part) for a in (*core._moment_aggs(c, i), F.kll_sketch_agg_double(num(c), SKETCH_K).alias(f"_{i}_s"))]
        wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
        parts.append(wide.select(*by, F.inline(F.array(*[
            F.struct(F.lit(c).alias("variable"), F.col("_rows").alias("rows"), *[F.col(f"_{i}_{k}").alias(k) for k in core._MOMENT_FIELDS], F.col(f"_{i}_s").alias("sketch"))
            for i, c in enumerate(part)]))))
    stats = functools.reduce(DataFrame.unionByName, parts)
    # quartiles, and a thousand evenly spaced quantiles of which those beyond a fence are counted
    ranks = [.25, .5, .75, *[(j + 0.5) / 1000 for j in range(1000)]]
    stats = stats.withColumn("_q", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in ranks]))))
    stats = stats.withColumns({f"q{q}": F.get("_q", F.lit(i)) for i, q in enumerate((25, 50, 75))}).withColumn("_q", F.slice("_q", 4, 1000))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    counted = lambda beyond: F.coalesce(F.round(F.col("n") * F.size(F.filter("_q", beyond)) / 1000), F.lit(0)).cast("long")
    return _describe(stats.withColumns({"upper_outliers": counted(lambda v: v > F.col("q75") + reach), "lower_outliers": counted(lambda v: v < F.col("q25") - reach)}), by)


def _grouped_summary(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    stats = core.moments(df, cols, by)
    q = core.group_quantiles(df, cols, [.25, .5, .75], by).select(
        *by, "variable", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))
    fences = q.groupBy(*by).agg(*[
        F.max(F.when(F.col("variable") == c, F.struct(
            (F.col("q25") - 1.5 * (F.col("q75") - F.col("q25"))).alias("lo"),
            (F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))).alias("hi")))).alias(f"_f{i}")
        for i, c in enumerate(cols)])
    data = df.select(*by, *[num(c).alias(f"_x{i}") for i, c in enumerate(cols)])
    counted = join_null_safe(data, fences, by).groupBy(*by).agg(*[
        a for i in range(len(cols)) for a in (
            F.count_if(F.col(f"_x{i}") > F.col(f"_f{i}.hi")).alias(f"u{i}"),
            F.count_if(F.col(f"_x{i}") < F.col(f"_f{i}.lo")).alias(f"d{i}"))])
    long = counted.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"u{i}").alias("upper_outliers"),
                 F.col(f"d{i}").alias("lower_outliers")) for i, c in enumerate(cols)])))
    keys = [*by, "variable"]
    return _describe(join_null_safe(join_null_safe(stats, q, keys), long, keys), by)


def join_null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that lets NULL keys meet; keeps one copy of the keys."""
    right = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return a.join(right, on, how).drop(*[f"_k_{k}" for k in keys])


# ------------------------------------------------------------------ nominal
def _long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), core.col_of(c).cast("string").alias("value")) for c in cols])))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``variable, value, count, share`` (share of the column's non-missing rows)."""
    counts = (_long_values(df, cols).where(F.col("value").isNotNull())
              .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count")))
    totals = counts.groupBy("variable").agg(F.sum("count").alias("_total"))
    return counts.join(totals, "variable").select(
        "variable", "value", "count", div(F.col("count"), F.col("_total")).alias("share"))


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per nominal column: count, unique, top (smallest value on ties), freq."""
    cols = list(cols or core.nominal_columns(df))
    core.require(df, cols)
    counts = _long_values(df, cols).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("_n"))
    seen = F.col("value").isNotNull()
    best = F.struct((-F.col("_n")).alias("n"), F.col("value").alias("v"))
    return counts.groupBy("variable").agg(
        F.coalesce(F.sum(F.when(seen, F.col("_n"))), F.lit(0)).alias("count"),
        F.count_if(seen).alias("unique"), F.min(F.when(seen, best)).alias("_best"),
    ).select("variable", "count", "unique", F.col("_best.v").alias("top"), (-F.col("_best.n")).alias("freq"))


def split_columns(df: DataFrame, target: str | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """``variable, kind, levels``: continuous or nominal, with the number of distinct values of nominal ones."""
    cols = [c for c in (cols or df.columns) if c != target]
    numeric = set(core.numeric_columns(df))
    nominal = [c for c in cols if c not in numeric]
    levels = {}
    if nominal:
        levels = {r["variable"]: r["unique"] for r in categorical_summary(df, nominal).collect()}
    rows = [{"variable": c, "kind": "continuous" if c in numeric else "nominal",
             "levels": levels.get(c)} for c in cols]
    return core.rows_frame(df.sparkSession, rows, "variable string, kind string, levels long")


def mean_interval(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """t interval of the mean; n counts the non-missing values."""
    stats = core.moments(df, list(cols), by)
    se = F.sqrt(div(F.col("var"), F.col("n")))
    out = stats.select(*by, "variable", "n", "mean", se.alias("se"))
    margin = pvalue.t_quantile(F.lit(0.5 + level / 2), (F.col("n") - 1).cast("double")) * F.col("se")
    return out.withColumn("margin", margin).select(
        *by, "variable", "n", "mean", "se", (F.col("mean") - F.col("margin")).alias("low"),
        (F.col("mean") + F.col("margin")).alias("high"))


def normality(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """D'Agostino-Pearson K² per column (and group), from moments alone."""
    stats = core.moments(df, list(cols), by)
    k2 = pvalue.k2_statistic(F.col("n"), F.col("skew"), F.col("kurt"))
    return (stats.select(*by, "variable", "n", k2.alias("statistic"))
            .withColumn("p_value", pvalue.k2_p(F.col("statistic")))
            .withColumn("normal", F.col("p_value") >= alpha))


def shapiro(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), alpha: float = 0.05, below: int = 30) -> DataFrame:
    """Shapiro-Wilk per column (and group) of fewer than ``below`` values: ``by…, variable, n, statistic, p_value, normal``.

    Groups are counted first; only those are brought together, so no task gets more than ``below`` values of one. Larger groups, fewer than
    three values and constant ones have no statistic.
    """
    by = list(by)
    long = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), num(c).alias("_v")) for c in cols]))).where(F.col("_v").isNotNull())
    keys = [*by, "variable"]
    counts = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    few = core.attach(long, counts.where(F.col("n") < below).select(*keys), keys).groupBy(*keys).agg(pvalue.shapiro_wilk(F.collect_list("_v")).alias("_t"))
    out = join_null_safe(counts, few, keys, "left")
    clean = lambda c: F.nanvl(F.col(f"_t.{c}"), F.lit(None).cast("double")).alias(c)
    return out.select(*keys, "n", clean("statistic"), clean("p_value")).withColumn("normal", F.col("p_value") >= alpha)
