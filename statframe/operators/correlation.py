"""Correlation with assumption checks, for all pairs of columns at once, and VIF."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statframe.functions import dist
from statframe.operators import core
from statframe.operators.core import num

PAIR_SCHEMA = ("x string, y string, method string, coef double, p_value double, strength string, significant boolean, "
               "normality_x boolean, normality_y boolean, linearity boolean, influential_outlier boolean, "
               "high_skew boolean, pearson double, spearman double, pearson_trimmed double, n long")


def rank_columns(df: DataFrame, cols: Sequence[str], out: str = "_r_", rows: int | None = None) -> DataFrame:
    """Add the average rank of each column's value as ``<out><col>``.

    All columns are counted and ranked in one pass. Rank tables that are small are broadcast; otherwise the values of all columns meet their ranks
    in one join of long rows, which come back together by row.
    """
    cols = list(cols)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), num(c).alias("value")) for c in cols])))
    table = core.checkpoint(core.value_ranks(long, "value", ["variable"], rows=rows).select("variable", "value", "rank"))
    size = {r["variable"]: r["count"] for r in table.groupBy("variable").count().collect()}
    if max(size.values(), default=0) > core.LIMITS.broadcast_rows:
        keyed = core.checkpoint(df.withColumn("_rid", F.monotonically_increasing_id()))
        long = keyed.select("_rid", F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), num(c).alias("value")) for c in cols])))
        back = long.join(table, ["variable", "value"]).groupBy("_rid").agg(*[F.max(F.when(F.col("variable") == c, F.col("rank"))).alias(f"{out}{c}") for c in cols])
        return keyed.join(back, "_rid", "left").drop("_rid")
    result = df
    for c in cols:
        side = table.where(F.col("variable") == c).select(F.col("value").alias("_v"), F.col("rank").alias(f"{out}{c}"))
        result = result.join(F.broadcast(side), num(c) == F.col("_v"), "left").drop("_v")      # counted above
    return result


def _strength(r: float | None) -> str | None:
    if r is None or r != r:
        return None
    a = abs(r)
    return "Strong" if a > 0.7 else "Moderate" if a > 0.3 else "Weak" if a > 0 else "None"


def _pair_p(r: float, n: int) -> float:
    if n < 3 or r != r:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return dist.t_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def _r(s: np.ndarray) -> float:
    return float(s[0, 1] / math.sqrt(s[0, 0] * s[1, 1])) if s[0, 0] > 0 and s[1, 1] > 0 else float("nan")


def _reset_p(cross: np.ndarray, n: int) -> float:
    """RESET power 2 of y on x: adding the squared fit is adding (x - mean)²; order x, z, y."""
    sxx, sxy, syy = cross[0, 0], cross[0, 2], cross[2, 2]
    if sxx <= 0 or n <= 3:
        return float("nan")
    rss0 = syy - sxy * sxy / sxx
    b, *_ = np.linalg.lstsq(cross[:2, :2], cross[:2, 2], rcond=1e-13)
    rss1 = syy - float(b @ cross[:2, 2])
    if rss1 <= 0:
        return float("nan")
    return dist.f_sf(max(0.0, (rss0 - rss1) / (rss1 / (n - 3))), 1, n - 3)


def _complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    out = df.select(*[num(c).alias(c) for c in cols])
    return out.dropna(subset=list(cols))


def _block(df: DataFrame, cols: list[str], pairs: list[tuple[str, str]], alpha: float, stats: dict | None = None,
           quartiles: dict | None = None) -> list[dict]:
    """All pairs of columns that share the same complete rows."""
    stats = stats or core.moments_dict(df, cols)
    rows_n = stats[cols[0]]["n"]
    quart = {c: (quartiles[c][0], quartiles[c][2]) for c in cols} if quartiles else core.quantiles(df, cols, [.25, .75], {c: stats[c]["n"] for c in cols})
    columns: dict[str, Column] = {c: F.col(f"`{c}`") for c in cols}
    for c in cols:
        centred = F.col(f"`{c}`") - F.lit(stats[c]["mean"])
        columns[f"{c}__sq"] = centred * centred
    g = core.gram(df, {**{c: columns[c] for c in cols}, **{f"{c}__sq": columns[f"{c}__sq"] for c in cols}})
    inside = {c: F.col(f"`{c}`").between(a - 1.5 * (b - a), b + 1.5 * (b - a)) for c, (a, b) in quart.items()}
    trimmed = {}
    for part in core.chunks(pairs, core.LIMITS.agg_columns):
        row = df.agg(*[F.corr(F.when(inside[x] & inside[y], F.col(f"`{x}`")),
                              F.when(inside[x] & inside[y], F.col(f"`{y}`"))).alias(f"r{i}")
                       for i, (x, y) in enumerate(part)]).first()
        trimmed.update({p: float("nan") if row[f"r{i}"] is None else row[f"r{i}"] for i, p in enumerate(part)})
    ranked = rank_columns(df, cols, rows=rows_n)
    rg = core.gram(ranked, {c: F.col(f"`_r_{c}`") for c in cols})
    rows = []
    for x, y in pairs:
        n = g.n
        norm = {c: dist.k2_normality(stats[c]["n"], stats[c]["skew"], stats[c]["kurt"])[1] >= alpha for c in (x, y)}
        p_lin = _reset_p(g.sub([x, f"{x}__sq", y], [x, f"{x}__sq", y]), n)
        r, rho = _r(g.sub([x, y], [x, y])), _r(rg.sub([x, y], [x, y]))
        skews = [(stats[c]["skew"] or 0.0) * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else 0.0 for c in (x, y)]
        flags = {"normality_x": norm[x], "normality_y": norm[y], "linearity": bool(p_lin >= alpha),
                 "influential_outlier": bool(abs(r - trimmed[x, y]) >= 0.1),
                 "high_skew": any(abs(s) > 1 for s in skews)}
        plain = (flags["linearity"] and norm[x] and norm[y]
                 and not flags["influential_outlier"] and not flags["high_skew"])
        coef = r if plain else rho
        p = _pair_p(coef, n)
        rows.append({"x": x, "y": y, "method": "Pearson" if plain else "Spearman",
                     "coef": None if coef != coef else round(coef, 4), "p_value": None if p != p else round(p, 4),
                     "strength": _strength(coef), "significant": bool(p < alpha), **flags,
                     "pearson": None if r != r else r, "spearman": None if rho != rho else rho,
                     "pearson_trimmed": None if trimmed[x, y] != trimmed[x, y] else trimmed[x, y], "n": n})
    return rows


def correlation_pairs(df: DataFrame, cols: Sequence[str] | None = None, alpha: float = 0.05,
                      pairs: Sequence[tuple[str, str]] | None = None, stats: dict | None = None, quartiles: dict | None = None) -> DataFrame:
    """One row per pair: Pearson if all checks pass, else Spearman, with the checks as flags.

    Without missing values all pairs share moments, fences, one cross-product
    matrix and one set of ranks; with missing values each pair uses its own
    complete rows. ``stats`` (``core.moments_dict``) and ``quartiles`` of the columns save their passes if they are known.
    """
    cols = list(cols or core.numeric_columns(df))
    core.require_numeric(df, cols)
    pairs = [tuple(p) for p in pairs] if pairs else list(itertools.combinations(cols, 2))
    used = [c for c in cols if any(c in p for p in pairs)]
    stats = {c: stats[c] for c in used} if stats else core.moments_dict(df, used)
    if all(s["n"] == s["rows"] for s in stats.values()):
        rows = _block(_complete(df, used), used, pairs, alpha, stats, quartiles)
    else:
        rows = [r for p in pairs for r in _block(_complete(df, p), list(dict.fromkeys(p)), [p], alpha)]
    return core.rows_frame(df.sparkSession, rows, PAIR_SCHEMA)


def correlation(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> DataFrame:
    return correlation_pairs(df, [x, y], alpha, [(x, y)])


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """Symmetric matrix with unit diagonal, one row per variable."""
    mirrored = _mirror(pairs)
    names = mirrored.select("x").distinct()
    full = mirrored.select("x", "y", "coef").unionByName(
        names.select("x", F.col("x").alias("y"), F.lit(1.0).alias("coef")))
    order = sorted(r["x"] for r in names.collect())
    return full.groupBy(F.col("x").alias("variable")).pivot("y", order).agg(F.first("coef"))


def _mirror(pairs: DataFrame) -> DataFrame:
    a = pairs.select("x", "y", "coef", "strength")
    return a.unionByName(a.select(F.col("y").alias("x"), F.col("x").alias("y"), "coef", "strength"))


def correlation_summary(pairs: DataFrame, strength: str | Sequence[str] = "Strong") -> DataFrame:
    """Per variable: strongest partner, and the partners of the given strength."""
    both = _mirror(pairs)
    strongest = F.struct((-F.abs(F.col("coef"))).alias("k"), "y")
    match = F.col("strength").isin(*core.as_list(strength))
    listed = F.array_sort(F.collect_list(F.when(match, F.struct((-F.abs(F.col("coef"))).alias("k"), "y", "coef"))))
    out = both.groupBy(F.col("x").alias("variable")).agg(
        F.min_by(F.struct("y", "coef"), strongest).alias("_best"), F.count_if(match).alias("count"),
        listed.alias("_list"))
    return out.select(
        "variable", F.col("_best.y").alias("max_y"), F.col("_best.coef").alias("max_coef"), "count",
        F.when(F.col("count") == 0, "-").otherwise(F.array_join(F.transform("_list", lambda s: s["y"]), ", ")).alias("partners")
    ).orderBy(F.col("count").desc(), F.abs(F.col("max_coef")).desc(), "variable")


def vif(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Variance inflation factor per numeric column, largest first."""
    cols = list(cols or core.numeric_columns(df))
    core.require_numeric(df, cols)
    values = core.vif_from_corr(core.gram(df, cols).corr())
    rows = [{"variable": c, "vif": float(v)} for c, v in zip(cols, values)]
    return core.rows_frame(df.sparkSession, sorted(rows, key=lambda r: (-r["vif"], r["variable"])),
                           "variable string, vif double")
