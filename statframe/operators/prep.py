"""Preprocessing: filling, clipping, transforms, encoding, scaling, components.

Parameters come from a few small aggregates; applying them is a ``select``,
so the same fitted object also works on a streaming DataFrame.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statframe.functions import dist
from statframe.operators import core
from statframe.operators.core import col_of, num


# ------------------------------------------------------------- missing values
def _mode(df: DataFrame, c: str):
    """Most frequent value, the smallest on ties, by a partial count (no per-task value map)."""
    best = (df.where(col_of(c).isNotNull()).groupBy(col_of(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("v"))).alias("b")).first()["b"])
    return None if best is None else best["v"]


def fill_missing(df: DataFrame, cols: Sequence[str] | str | None = None, method: str = "mean", value=None) -> DataFrame:
    """Drop rows with missing values in the columns, or fill them."""
    method = method.lower()
    if method not in ("drop", "value", "mean", "median", "max", "min", "mode"):
        raise ValueError(f"unknown method: {method}")
    numeric = core.numeric_columns(df)
    if cols is None:
        cols = numeric if method in ("mean", "median", "max", "min") else df.columns
    cols = core.as_list(cols)
    core.require(df, cols)
    clean = df.withColumns({c: F.nanvl(col_of(c), F.lit(None).cast(df.schema[c].dataType)) for c in cols
                            if df.schema[c].dataType.typeName() in ("double", "float")})
    if method == "drop":
        return clean.dropna(subset=cols)
    if method == "value":
        fills = {c: value for c in cols}
    elif method == "median":
        fills = {c: q[0] for c, q in core.quantiles(clean, cols, [0.5]).items()}
    elif method == "mode":
        fills = {c: _mode(clean, c) for c in cols}
    else:
        fills = {c: r[method] for c, r in core.moments_dict(clean, cols).items()}
    out = {}
    for c, v in fills.items():
        if v is None:
            continue
        kind = clean.schema[c].dataType
        if method in ("mean", "median", "value") and core.is_numeric(kind) and float(v) != int(float(v)):
            kind = "double"
        out[c] = F.coalesce(col_of(c).cast(kind), F.lit(v).cast(kind))
    return clean.withColumns(out)


# -------------------------------------------------------------- fitted models
class Fitted(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A model whose numbers live in one JSON parameter, so ``save``/``load`` need nothing else."""

    state = Param(Params._dummy(), "state", "fitted numbers as JSON", TypeConverters.toString)

    def __init__(self, state: dict | None = None):
        super().__init__()
        if state is not None:
            self._set(state=json.dumps(state))

    @property
    def numbers(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def _columns(self, df: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        core.require(dataset, self.numbers["columns"])
        return dataset.withColumns(self._columns(dataset))


def clip(x: Column, lo: Column | float, hi: Column | float) -> Column:
    """Bound a value and keep NULL (``least``/``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


class OutlierClipperModel(Fitted):
    def _columns(self, df):
        s = self.numbers
        return {c: clip(num(c), lo, hi) for c, lo, hi in zip(s["columns"], s["lower"], s["upper"]) if lo is not None}


class OutlierClipper(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fences from quartiles (``iqr``) or mean ± 3 population deviations (``zscore``)."""

    method = Param(Params._dummy(), "method", "iqr or zscore", TypeConverters.toString)
    inputCols = Param(Params._dummy(), "inputCols", "columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, method="iqr", inputCols=None):
        super().__init__()
        self._setDefault(method="iqr")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset):
        method = self.getOrDefault(self.method)
        cols = self.getOrDefault(self.inputCols) if self.isSet(self.inputCols) else core.numeric_columns(dataset)
        if method == "iqr":
            q = core.quantiles(dataset, cols, [.25, .75])
            fences = [(None, None) if a is None else (a - 1.5 * (b - a), b + 1.5 * (b - a)) for a, b in q.values()]
        elif method == "zscore":
            fences = []
            for c, r in core.moments_dict(dataset, cols).items():
                sd = (r["var"] * (r["n"] - 1) / r["n"]) ** 0.5 if r["n"] and r["n"] > 1 else 0.0
                fences.append((None, None) if r["mean"] is None else (r["mean"] - 3 * sd, r["mean"] + 3 * sd))
        else:
            raise ValueError(f"unknown method: {method}")
        return OutlierClipperModel({"columns": cols, "lower": [f[0] for f in fences], "upper": [f[1] for f in fences]})


def clip_outliers(df: DataFrame, cols: Sequence[str] | None = None, method: str = "bound", value=None) -> DataFrame:
    """Replace values outside the 1.5 IQR fences by the fence, by an inlier statistic or by a value."""
    cols = core.as_list(cols) or core.numeric_columns(df)
    core.require_numeric(df, cols)
    if method == "bound":
        return OutlierClipper(method="iqr", inputCols=cols).fit(df).transform(df)
    if method not in ("median", "mean", "value"):
        raise ValueError(f"unknown method: {method}")
    fence = OutlierClipper(method="iqr", inputCols=cols).fit(df).numbers
    inside = {c: (num(c) >= lo) & (num(c) <= hi)
              for c, lo, hi in zip(cols, fence["lower"], fence["upper"]) if lo is not None}
    kept = df.select(*[F.when(inside[c], num(c)).alias(c) for c in inside])
    if method == "median":
        fill = {c: q[0] for c, q in core.quantiles(kept, list(inside), [.5]).items()}
    elif method == "mean":
        fill = {c: r["mean"] for c, r in core.moments_dict(kept, list(inside)).items()}
    else:
        fill = {c: value for c in inside}
    return df.withColumns({
        c: F.when(num(c).isNull(), None).when(ok, num(c)).otherwise(F.lit(fill[c]).cast("double"))
        for c, ok in inside.items()})


# ------------------------------------------------------------- log transforms
def log_transform(df: DataFrame, log_columns=(), log1p_columns=(), reflect_columns=()) -> tuple[DataFrame, dict]:
    """Apply ``log`` / ``log1p`` / reflected ``log1p``; the recipe holds what the inverse needs.

    ``recipe["skew"]`` is {column: (before, after)} population skewness.
    """
    log_columns, log1p_columns, reflect_columns = (
        core.as_list(c) for c in (log_columns, log1p_columns, reflect_columns))
    cols = [*log_columns, *log1p_columns, *reflect_columns]
    if not cols:
        return df, {"log": [], "log1p": [], "reflect": {}, "skew": {}}
    core.require_numeric(df, cols)
    before = core.moments_dict(df, cols)
    bad = [c for c in log_columns if before[c]["min"] is not None and before[c]["min"] <= 0]
    if bad:
        raise ValueError(f"log needs positive values: {bad}")
    top = {c: before[c]["max"] for c in reflect_columns}
    new = {**{c: F.ln(num(c)) for c in log_columns},
           **{c: F.log1p(num(c)) for c in log1p_columns},
           **{c: F.log1p(F.lit(top[c]) - num(c)) for c in reflect_columns}}
    out = df.withColumns(new)
    after = core.moments_dict(out, cols)
    return out, {"log": log_columns, "log1p": log1p_columns, "reflect": top,
                 "skew": {c: (before[c]["skew"], after[c]["skew"]) for c in cols}}


def inverse_log(df: DataFrame, log_columns=(), log1p_columns=(), reflect_columns: dict | None = None) -> DataFrame:
    return df.withColumns({
        **{c: F.exp(num(c)) for c in core.as_list(log_columns)},
        **{c: F.expm1(num(c)) for c in core.as_list(log1p_columns)},
        **{c: F.lit(float(m)) - F.expm1(num(c)) for c, m in (reflect_columns or {}).items()}})


# ------------------------------------------------------------------- encoding
def label_table(df: DataFrame, c: str) -> DataFrame:
    """``value, code``: 0..k-1 in sorted value order."""
    levels = df.where(col_of(c).isNotNull()).select(col_of(c).alias("value")).distinct().withColumn("one", F.lit(1))
    return core.cumulate(levels, [], ["value"], ["one"]).select("value", F.col("one_before").cast("int").alias("code"))


def label_encode(df: DataFrame, cols: Sequence[str] | str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Replace values by their code.  Few levels become one expression, many a join."""
    out, names = df, df.columns
    for c in core.as_list(cols):
        core.require(df, [c])
        table = tables[c] if tables else label_table(df, c)
        head = table.orderBy("code").limit(core.LIMITS.groups + 1).collect()
        if len(head) <= core.LIMITS.groups:
            small = F.broadcast(df.sparkSession.createDataFrame(head, table.schema))
            table = small
        table = table.select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        joined = out.join(table, col_of(c) == F.col("_v"), "left")
        out = joined.select(*[F.col("_code").alias(c) if n == c else col_of(n) for n in names])
    return out


def _levels(df: DataFrame, c: str) -> list:
    """The levels of a column that become columns of the result."""
    return sorted(r["v"] for r in df.where(col_of(c).isNotNull()).select(col_of(c).alias("v")).distinct().collect())


def dummies_long(df: DataFrame, row_id: Sequence[str], cols: Sequence[str] | str) -> DataFrame:
    """The ones of ``dummies`` as rows ``row_id…, variable, level``: for columns with too many levels for a wide table."""
    return df.select(*row_id, F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), col_of(c).cast("string").alias("level")) for c in core.as_list(cols)]))
                     ).where(F.col("level").isNotNull())


def dummies(df: DataFrame, cols: Sequence[str] | str, drop_first: bool = True) -> DataFrame:
    """0/1 columns ``col_value``; two-level columns stay as they are."""
    out = df
    for c in core.as_list(cols):
        core.require(df, [c])
        levels = _levels(df, c)
        if len(levels) == 2:
            continue
        flags = {f"{c}_{v}": F.when(col_of(c) == F.lit(v), 1).otherwise(0) for v in levels[1 if drop_first else 0:]}
        out = out.withColumns(flags).drop(c)
    return out


def long_to_wide(df: DataFrame, group: str, value: str, order_by: Sequence[str], dropna: bool = True,
                 levels: Sequence | None = None) -> DataFrame:
    """n-th row of every group side by side (``rn`` plus one column per level, all of them or those asked for)."""
    numbered = core.positions(df, [group], order_by, "rn")
    if dropna:
        numbered = numbered.where(col_of(value).isNotNull())
    return numbered.groupBy("rn").pivot(group, list(levels) if levels is not None else _levels(numbered, group)).agg(F.first(value, ignorenulls=True))


def apply_recipe(df: DataFrame, recipe: dict[str, dict]) -> DataFrame:
    """Replay learned derivations: centred square, or shifted log; the source column goes."""
    new, gone = {}, []
    for c, r in recipe.items():
        core.require(df, [c])
        if r["method"] == "square":
            centred = num(c) - F.lit(float(r.get("center", 0.0)))
            new[f"{c}_c"], new[f"{c}_c2"] = centred, centred * centred
        elif r["method"] == "log":
            new[f"{c}_log"] = F.ln(num(c) + F.lit(float(r.get("shift", 0.0))))
        else:
            raise ValueError(f"unknown method: {r['method']}")
        gone.append(c)
    return df.withColumns(new).drop(*gone)


# -------------------------------------------------------------------- scaling
class ScalerModel(Fitted):
    def _columns(self, df):
        s = self.numbers
        return {c: (num(c) - F.lit(float(m))) / F.lit(float(k))
                for c, m, k in zip(s["columns"], s["center"], s["scale"]) if m is not None}


def _scale_method(name: str) -> str:
    name = name.lower().strip()
    name = name[:-6] if name.endswith("scaler") else name
    if name not in ("standard", "minmax", "robust", "maxabs"):
        raise ValueError(f"unknown scaling method: {name}")
    return name


class Scaler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """standard (population std), minmax, robust (median, IQR) or maxabs; zero scale becomes 1."""

    method = Param(Params._dummy(), "method", "scaling method", TypeConverters.toString)
    inputCols = Param(Params._dummy(), "inputCols", "columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, method="standard", inputCols=None):
        super().__init__()
        self._setDefault(method="standard")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset):
        method = _scale_method(self.getOrDefault(self.method))
        cols = self.getOrDefault(self.inputCols) if self.isSet(self.inputCols) else core.numeric_columns(dataset)
        center, scale = [], []
        stats = core.quantiles(dataset, cols, [.25, .5, .75]) if method == "robust" else core.moments_dict(dataset, cols)
        for c in cols:
            r = stats[c]
            if method == "robust":
                m, k = r[1], None if r[0] is None else r[2] - r[0]
            elif r["mean"] is None:
                m = k = None
            elif method == "standard":
                m, k = r["mean"], ((r["var"] or 0.0) * (r["n"] - 1) / r["n"]) ** 0.5
            elif method == "minmax":
                m, k = r["min"], r["max"] - r["min"]
            else:
                m, k = 0.0, max(abs(r["min"]), abs(r["max"]))
            center.append(m)
            scale.append(k or 1.0)
        return ScalerModel({"columns": cols, "center": center, "scale": scale, "method": method})


def scale(df: DataFrame, cols: Sequence[str] | None = None, method: str = "standard") -> DataFrame:
    cols = core.as_list(cols) or core.numeric_columns(df)
    core.require_numeric(df, cols)
    return Scaler(method=method, inputCols=cols).fit(df).transform(df)


# ----------------------------------------------------------------- components
class PcaModel(Fitted):
    """Scores are linear expressions; ``loadings`` and ``explained`` are small frames."""

    def _columns(self, df):
        s = self.numbers
        out = {}
        for k, vec in enumerate(s["vectors"]):
            terms = [(num(c) - F.lit(m)) / F.lit(d) * F.lit(w)
                     for c, m, d, w in zip(s["columns"], s["center"], s["scale"], vec)]
            total = terms[0]
            for t in terms[1:]:
                total = total + t
            out[f"PC{k + 1}"] = total
        return out

    def loadings(self, spark) -> DataFrame:
        s = self.numbers
        rows = [{"component": f"PC{k + 1}", "variable": c, "loading": w}
                for k, vec in enumerate(s["vectors"]) for c, w in zip(s["columns"], vec)]
        return core.rows_frame(spark, rows, "component string, variable string, loading double")

    def explained(self, spark) -> DataFrame:
        s, total, rows = self.numbers, 0.0, []
        for k, r in enumerate(s["ratios"]):
            total += r
            rows.append({"component": f"PC{k + 1}", "ratio": r, "cumulative": total,
                         "kept": k < len(s["vectors"])})
        return core.rows_frame(spark, rows, "component string, ratio double, cumulative double, kept boolean")


def fit_pca(df: DataFrame, y: str | None = None, n_components: float | int | str = 0.8, scale: bool = True,
            method: str = "standard") -> PcaModel:
    """Principal axes from one cross-product matrix; ``n_components``: explained share, number, or ``'mle'`` (largest evidence)."""
    cols = [c for c in core.numeric_columns(df) if c != y]
    g = core.gram(df, cols)
    center, spread = g.mean, np.ones(len(cols))
    if scale:
        fitted = Scaler(method=method, inputCols=cols).fit(df).numbers
        spread = np.array(fitted["scale"], dtype=float)
    cov = g.cov() / np.outer(spread, spread)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    ratios = values / values.sum() if values.sum() else values
    if n_components == "mle":
        k = dist.most_likely_rank(values, g.n)
    elif isinstance(n_components, str):
        raise ValueError("n_components must be a number or 'mle'")
    elif isinstance(n_components, float) and n_components < 1:
        k = int(np.searchsorted(np.cumsum(ratios), n_components, side="right")) + 1
    else:
        k = int(n_components)
    k = min(max(k, 1), len(cols))
    kept = []
    for v in vectors.T[:k]:
        kept.append((v * np.sign(v[np.argmax(np.abs(v))])).tolist())
    return PcaModel({"columns": cols, "center": center.tolist(), "scale": spread.tolist(),
                     "vectors": kept, "ratios": ratios.tolist()})


def pca(df: DataFrame, y: str | None = None, **kw) -> tuple[DataFrame, PcaModel]:
    """Component scores (and ``y``) of every row with the fitted model."""
    model = fit_pca(df, y, **kw)
    names = [f"PC{k + 1}" for k in range(len(model.numbers["vectors"]))]
    return model.transform(df).select(*names, *([y] if y else [])), model


# ---------------------------------------------------------------- collinearity
def _vif_loop(g: core.Gram, names: list[str], stop) -> tuple[list[str], list[tuple[str, float]]]:
    """Drop the worst column until ``stop``; only the p x p matrix is touched."""
    left, dropped = sorted(names), []
    r = g.corr()
    while left:
        idx = g.index(left)
        vif = np.minimum(np.nan_to_num(core.vif_from_corr(r[np.ix_(idx, idx)]), nan=0.0, posinf=1e6), 1e6)
        worst = int(np.argmax(vif))
        if stop(vif[worst], len(left)):
            break
        dropped.append((left.pop(worst), float(vif[worst])))
    return [c for c in names if c in left], dropped


def reduce_vif(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 10.0) -> tuple[DataFrame, list]:
    """Remove numeric columns until every VIF is below the threshold or one is left."""
    cols = core.as_list(cols) or core.numeric_columns(df)
    core.require_numeric(df, cols)
    keep, dropped = _vif_loop(core.gram(df, cols), cols, lambda v, left: v < threshold or left <= 1)
    return df.drop(*[c for c, _ in dropped]), dropped


class VifSelectorModel(Fitted):
    def _transform(self, dataset):
        s = self.numbers
        core.require(dataset, s["columns"])
        return dataset.drop(*[c for c, _ in s["dropped"]])


class VifSelector(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """As ``reduce_vif`` but stops at VIF <= threshold and may empty the list."""

    threshold = Param(Params._dummy(), "threshold", "largest allowed VIF", TypeConverters.toFloat)
    inputCols = Param(Params._dummy(), "inputCols", "columns", TypeConverters.toListString)

    @keyword_only
    def __init__(self, threshold=10.0, inputCols=None):
        super().__init__()
        self._setDefault(threshold=10.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset):
        cols = self.getOrDefault(self.inputCols) if self.isSet(self.inputCols) else core.numeric_columns(dataset)
        limit = self.getOrDefault(self.threshold)
        keep, dropped = _vif_loop(core.gram(dataset, cols), cols, lambda v, left: v <= limit)
        return VifSelectorModel({"columns": cols, "kept": keep, "dropped": dropped})
