"""Clustering: k-means, choice of k and radius, silhouettes, merge tree, DBSCAN, profiles."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statframe.functions import pvalue
from statframe.operators import core, prep
from statframe.operators.core import col_of, div, num
from statframe.operators.neighbours import SCAN_PART, Tiles, components, distinct_points, neighbours, spanning_tree, stream

SEED = 3217            # fixed value: the default seed of every random step
SILHOUETTE_BLOCK = 16_384      # points a task holds,
SILHOUETTE_SUMS = 8_000_000    # with so many sums of their clusters,
SILHOUETTE_PARTS = 8           # in so many tasks, at least


def _scaled(df: DataFrame, columns: Sequence[str] | None, scaling: str | None) -> tuple[DataFrame, list[str]]:
    cols = list(columns or core.numeric_columns(df))
    core.require_numeric(df, cols)
    return (prep.scale(df, cols, scaling) if scaling else df.withColumns({c: num(c) for c in cols})), cols


@dataclass
class KMeansFit:
    data: DataFrame           # scaled columns plus the label
    columns: list[str]
    centers: np.ndarray       # in order of their coordinates; a label is a place in it
    inertia: float
    label: str
    passes: int = 0           # over the rows, for all runs together

    def center_frame(self) -> DataFrame:
        rows = [{"cluster": i, "variable": c, "center": v} for i, row in enumerate(self.centers) for c, v in zip(self.columns, row)]
        return core.rows_frame(self.data.sparkSession, rows, "cluster int, variable string, center double")


def _vectors(scaled: DataFrame, cols: list[str]) -> DataFrame:
    """The rows with their point ``_f``, cached for the runs of k-means; the caller releases them."""
    return scaled.withColumn("_f", F.array(*[num(c) for c in cols])).persist()


def _matrix(column) -> np.ndarray:
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("rows have missing values")
    return np.asarray(flat, float).reshape(len(column), -1)


def _first_centers(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each further centre is the best of a few points drawn by their squared distance to the centres so far."""
    chosen = [sample[rng.integers(len(sample))]]
    near = ((sample - chosen[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        if near.sum() <= 0:
            chosen.append(chosen[0])
            continue
        drawn = rng.choice(len(sample), 2 + int(math.log(k)), p=near / near.sum())
        left = [np.minimum(near, ((sample - sample[i]) ** 2).sum(axis=1)) for i in drawn]
        best = int(np.argmin([v.sum() for v in left]))
        chosen.append(sample[drawn[best]])
        near = left[best]
    return np.array(chosen)


def _lloyd(points: DataFrame, starts: list[np.ndarray], most: int = 300, tolerance: float = 1e-6) -> tuple[list[np.ndarray], np.ndarray, int]:
    """(centres, inertia of each run, passes): all runs go over the rows together, those that stand still drop out.

    A task multiplies its rows with the centres of all runs at once and returns the sums of each cluster. An empty cluster keeps its centre.
    """
    width, shift = starts[0].shape[1], starts[0].mean(axis=0)
    centers = [c - shift for c in starts]

    def pass_over(active: list[int]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        now = [centers[r] for r in active]
        stacked, ends = np.concatenate(now), np.cumsum([len(c) for c in now])
        square = (stacked * stacked).sum(axis=1)

        def sums(batch) -> np.ndarray:
            total = np.zeros(len(stacked) * (width + 1) + len(now))
            for at in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(at, 4096)) - shift
                d = square - 2 * x @ stacked.T
                own, out = (x * x).sum(axis=1), total[:-len(now)].reshape(-1, width + 1)
                for r, (a, b) in enumerate(zip(ends - [len(c) for c in now], ends)):
                    label = d[:, a:b].argmin(axis=1)
                    member = np.zeros((len(x), b - a))
                    member[np.arange(len(x)), label] = 1.0
                    out[a:b, :width] += member.T @ x
                    out[a:b, width] += member.sum(axis=0)
                    total[len(total) - len(now) + r] += np.maximum(0, own + d[np.arange(len(x)), a + label]).sum()
            return total

        total = core.sum_vectors(points, sums, len(stacked) * (width + 1) + len(now))
        table = total[:-len(now)].reshape(-1, width + 1)
        return [(table[b - len(c):b, :width], table[b - len(c):b, width], float(cost)) for c, b, cost in zip(now, ends, total[-len(now):])]

    active, passes = list(range(len(starts))), 0
    while active and passes < most - 1:
        passes += 1
        still = []
        for r, (total, count, _) in zip(active, pass_over(active)):
            new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers[r])
            if np.sqrt(((new - centers[r]) ** 2).sum(axis=1)).max() > tolerance:
                still.append(r)
            centers[r] = new
        active = still
    inertia = [cost for _, _, cost in pass_over(list(range(len(starts))))]
    return [c + shift for c in centers], np.array(inertia), passes + 1


#: Rows from which the first centres are drawn.
START_ROWS = 20_000


def _runs(data: DataFrame, ks: Sequence[int], seed: int, n_init: int) -> tuple[dict[int, tuple[np.ndarray, float]], int]:
    """(best centres in order, inertia) for each k from ``n_init`` runs of each, all in the same passes; and the number of passes."""
    points = data.select("_f")
    n = points.count()
    if not n:
        raise ValueError("no rows")
    head = points if n <= START_ROWS else points.sample(min(1.0, 1.2 * START_ROWS / n), seed).limit(START_ROWS)
    sample = _matrix(head.toArrow()["_f"].combine_chunks())
    sample = sample[np.lexsort(sample.T[::-1])]
    starts = [_first_centers(sample, k, np.random.default_rng(seed + i)) for k in ks for i in range(n_init)]
    centers, inertia, passes = _lloyd(points, starts)
    out = {}
    for j, k in enumerate(ks):
        own = range(j * n_init, (j + 1) * n_init)
        best = min(own, key=lambda r: (inertia[r], r))
        out[k] = (np.array(sorted(centers[best].tolist())), float(inertia[best]))
    return out, passes


def _labelled(data: DataFrame, centers: np.ndarray, label: str) -> DataFrame:
    """``data`` with the place of the nearest centre instead of ``_f``; of equally near ones the first."""
    square = (centers * centers).sum(axis=1)

    @F.pandas_udf("int")
    def nearest(f: pd.Series) -> pd.Series:
        x = np.stack(f.to_list()) if len(f) else np.zeros((0, centers.shape[1]))
        return pd.Series((square - 2 * x @ centers.T).argmin(axis=1), dtype="int32")

    return data.withColumn(label, nearest("_f")).drop("_f")


def kmeans(df: DataFrame, k: int, columns: Sequence[str] | None = None, scaling: str | None = "standard",
           label: str = "cluster", seed: int = SEED, n_init: int = 10) -> KMeansFit:
    """Best of ``n_init`` seeded runs, which pass over the rows together; clusters are numbered by their centres."""
    scaled, cols = _scaled(df, columns, scaling)
    vec = _vectors(scaled, cols)
    found, passes = _runs(vec, [k], seed, n_init)
    vec.unpersist()
    centers, inertia = found[k]
    return KMeansFit(_labelled(scaled.withColumn("_f", F.array(*[num(c) for c in cols])), centers, label), cols, centers, inertia, label, passes)


# ----------------------------------------------------------------- silhouette
def _label_sizes(df: DataFrame, label: str) -> dict:
    """Rows of each label, one entry per cluster."""
    return {r[0]: r[1] for r in df.where(col_of(label).isNotNull()).groupBy(label).count().collect()}


def silhouette(df: DataFrame, columns: Sequence[str], label: str, method: str = "squared", noise: int | None = -1) -> DataFrame:
    """Add ``silhouette`` per row; noise keeps its rows as a group of their own but is no cluster to count.

    ``squared`` uses squared distances, which have a closed form in per-cluster count, sum and sum of squares: two linear passes.
    ``euclidean`` is the mean-distance form: the distinct points of all clusters stream past blocks of distinct points and only per-cluster
    distance sums come out (quadratic work by products of matrices, no row pairs emitted). Rows with a missing coordinate or label have no coefficient and enter no sum; a cluster of one
    row scores 0, and so does a row whose distances are all 0.
    """
    cols = list(columns)
    core.require_numeric(df, cols)
    if method not in ("squared", "euclidean"):
        raise ValueError(f"unknown method: {method}")
    whole = col_of(label).isNotNull()
    for c in cols:
        whole = whole & num(c).isNotNull()
    sizes = _label_sizes(df.where(whole), label)
    if len([g for g in sizes if g != noise]) < 2:
        return df.withColumn("silhouette", F.lit(None).cast("double"))
    groups = sorted(sizes)
    number = core.rows_frame(df.sparkSession, [{"_label": g, "_own": i} for i, g in enumerate(groups)],
                             f"_label {df.schema[label].dataType.simpleString()}, _own int")
    # one row per cluster: as small as the labels themselves
    tagged = df.withColumn("_label", F.when(whole, col_of(label))).join(F.broadcast(number), "_label", "left").drop("_label")
    form = _squared_means if method == "squared" else _distance_means
    return form(tagged, df.columns, cols, [sizes[g] for g in groups])


def _coefficient(means, own, sizes: list[int]):
    """(b - a) / max(a, b) from an array of mean distances per cluster; missing where the row has no cluster."""
    a = F.get(means, own)
    others = F.array_min(F.transform(means, lambda m, i: F.when(i != own, m)))
    size = F.get(F.array(*[F.lit(n) for n in sizes]), own)
    return F.when(own.isNotNull(), F.when((size <= 1) | (F.greatest(a, others) == 0), F.lit(0.0)).otherwise(div(others - a, F.greatest(a, others))))


def _squared_means(tagged: DataFrame, names: list[str], cols: list[str], sizes: list[int]) -> DataFrame:
    x = F.array(*[num(c) for c in cols])
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda total, e: total + e * e)
    stats = {r["_own"]: r for r in tagged.where("_own is not null").groupBy("_own").agg(
        F.sum(square(x)).alias("q"), *[F.sum(num(c)).alias(f"s{i}") for i, c in enumerate(cols)]).collect()}
    table = F.array(*[F.struct(F.array(*[F.lit(float(stats[g][f"s{i}"] / n)) for i in range(len(cols))]).alias("center"),
                               F.lit(float(stats[g]["q"] / n)).alias("spread"), F.lit(float(n)).alias("n")) for g, n in enumerate(sizes)])
    own = F.col("_own")
    cross = lambda g: F.aggregate(F.zip_with(F.col("_x"), g["center"], lambda a, b: a * b), F.lit(0.0), lambda total, e: total + e)
    means = F.transform(table, lambda g, i: F.greatest(
        (F.col("_sq") + g["spread"] - 2 * cross(g)) * g["n"] / F.when(i == own, F.greatest(g["n"] - 1, F.lit(1.0))).otherwise(g["n"]), F.lit(0.0)))
    out = tagged.withColumn("_x", x).withColumn("_sq", square(F.col("_x")))
    return out.select(*names, _coefficient(means, own, sizes).alias("silhouette"))


class _SumScan:
    """Sums of the distances from the points held to the points that pass, by cluster (``tag``) and weighted by their rows."""

    def __init__(self, pid: np.ndarray, x: np.ndarray, tag: np.ndarray, radius: np.ndarray, k: int):
        self.pid, self.tiles, self.sums = pid, Tiles(x, 2), np.zeros((len(pid), k))

    def see(self, pid: np.ndarray, x: np.ndarray, own: np.ndarray, cnt: np.ndarray) -> None:
        order = np.argsort(own, kind="stable")
        x, own, cnt = x[order], own[order], cnt[order]
        for at, to, d, base, slack in self.tiles.over(x):
            d += base[:, None]
            close = np.flatnonzero(d <= 1e6 * slack[:, None])            # too close for a difference of squares
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            for lo in range(0, len(close), 65_536):
                i, j = np.divmod(close[lo:lo + 65_536], d.shape[1])
                d[i, j] = self.tiles.exact(i + at.start, x[j + to.start])
            d *= cnt[to]
            names = own[to]
            starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            self.sums[at, names[starts]] += np.add.reduceat(d, starts, axis=1)

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.pid), *(pa.array(s) for s in self.sums.T)], ["_pid", *(f"_s{i}" for i in range(self.sums.shape[1]))])


def _distance_means(tagged: DataFrame, names: list[str], cols: list[str], sizes: list[int]) -> DataFrame:
    k = len(sizes)
    base = core.checkpoint(tagged.withColumn("_x", F.when(F.col("_own").isNotNull(), F.array(*[num(c) for c in cols]))))
    copies = core.checkpoint(base.where("_own is not null").groupBy(F.col("_x").alias("x"), F.col("_own").cast("long").alias("tag")).agg(F.count(F.lit(1)).cast("double").alias("radius"))
                             .withColumn("pid", F.monotonically_increasing_id()))
    points = core.checkpoint(copies.groupBy("x").agg(F.min("pid").alias("pid")))
    n = points.count()
    most = max(1, min(SILHOUETTE_BLOCK, -(-n // SILHOUETTE_PARTS), SILHOUETTE_SUMS // k))
    held, parts = -(-n // most), max(SILHOUETTE_PARTS, -(-n // SCAN_PART))
    within = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many).cast("long"))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    asking = points.withColumn("_part", every(parts)).select((within("pid", held) * parts + F.col("_part")).alias("task"), F.lit(0).alias("kind"), "pid", "x", F.lit(0).cast("long").alias("tag"), F.lit(0.0).alias("radius"))
    passing = copies.withColumn("_block", every(held)).select((F.col("_block") * parts + within("pid", parts)).alias("task"), F.lit(1).alias("kind"), "pid", "x", "tag", "radius")
    total = stream(asking.unionByName(passing), 2 * held * parts, functools.partial(_SumScan, k=k), "_pid long, " + ", ".join(f"_s{i} double" for i in range(k))).groupBy("_pid").agg(
        F.array(*[F.sum(f"_s{i}") for i in range(k)]).alias("_sums"))
    own = F.col("_own")
    count = F.array(*[F.lit(float(n)) for n in sizes])
    means = F.transform("_sums", lambda s, i: s / F.when(i == own, F.greatest(F.get(count, i) - 1, F.lit(1.0))).otherwise(F.get(count, i)))
    sums = points.join(total, F.col("pid") == F.col("_pid")).select(F.col("x").alias("_x"), "_sums")
    return base.join(sums, "_x", "left").select(*names, _coefficient(means, own, sizes).alias("silhouette"))


def silhouette_summary(df: DataFrame, label: str, noise: int | None = -1) -> DataFrame:
    """Score, total area, thickness, least relative area and balance of labelled silhouettes."""
    g = df.where(col_of(label) != noise) if noise is not None else df
    per = g.groupBy(label).agg(F.sum("silhouette").alias("area"), F.count(F.lit(1)).alias("size"))
    t = per.agg(F.count(F.lit(1)).alias("k"), F.sum("area").alias("total_area"), F.sum("size").alias("n"),
                div(F.max("size"), F.min("size")).alias("thickness"), F.min("area").alias("least"))
    rel = F.when(F.col("total_area") > 0, div(F.col("least"), F.col("total_area")) * F.col("k")).otherwise(0.0)
    return t.select("k", div(F.col("total_area"), F.col("n")).alias("score"), "total_area", "thickness",
                    rel.alias("min_relative_area")).withColumn(
        "balance", div(F.col("score") * F.col("min_relative_area"), F.col("thickness")))


# ------------------------------------------------------------------ choosing k
def knee(x: Sequence[float], y: Sequence[float], direction: str, sensitivity: float) -> int | None:
    """Index of the bend of a convex curve (Kneedle, Satopää et al. 2011)."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    if len(x) < 3 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return None
    xn, yn = (x - x.min()) / np.ptp(x), (y - y.min()) / np.ptp(y)
    yn = yn.max() - yn
    if direction == "increasing":
        yn = yn[::-1]
    diff = yn - xn
    left, right = np.concatenate([diff[:1], diff[:-1]]), np.concatenate([diff[1:], diff[-1:]])
    peaks, dips = (diff >= left) & (diff >= right), (diff <= left) & (diff <= right)
    step = sensitivity * abs(np.diff(xn).mean())
    threshold, at = None, None
    for i in range(len(diff) - 1):
        if peaks[i]:
            threshold, at = diff[i] - step, i
        if at is None:
            continue
        if dips[i]:
            threshold = 0.0
        if diff[i + 1] < threshold:
            return len(x) - 1 - at if direction == "increasing" else at
    return None


def _shapes(points: DataFrame, centers: list[np.ndarray]) -> list[dict]:
    """``silhouette_summary`` of the squared form for several sets of centres: one pass for the clusters' moments, one for the coefficients."""
    width, ends = centers[0].shape[1], np.cumsum([len(c) for c in centers])
    begins, shift = ends - [len(c) for c in centers], centers[0].mean(axis=0)
    stacked = np.concatenate(centers) - shift
    square = (stacked * stacked).sum(axis=1)

    def labels(x: np.ndarray) -> list[np.ndarray]:
        d = square - 2 * x @ stacked.T
        return [d[:, a:b].argmin(axis=1) for a, b in zip(begins, ends)]

    def moments(batch) -> np.ndarray:
        x = _matrix(batch.column(0)) - shift
        out = np.zeros((len(stacked), width + 2))
        whole = np.column_stack([x, (x * x).sum(axis=1), np.ones(len(x))])
        for a, own in zip(begins, labels(x)):
            np.add.at(out, a + own, whole)
        return out.ravel()

    table = core.sum_vectors(points.select("_f"), moments, len(stacked) * (width + 2)).reshape(len(stacked), width + 2)
    count = table[:, -1]
    mean, spread = table[:, :width] / np.maximum(count, 1)[:, None], table[:, width] / np.maximum(count, 1)

    def areas(batch) -> np.ndarray:
        x = _matrix(batch.column(0)) - shift
        rows, out = np.arange(len(x)), np.zeros(len(stacked))
        away = np.maximum(0, (x * x).sum(axis=1)[:, None] + spread - 2 * x @ mean.T)
        for a, b, own in zip(begins, ends, labels(x)):
            size = count[a:b]
            m = np.where(size > 0, away[:, a:b], np.inf)
            inside = m[rows, own] * size[own] / np.maximum(size[own] - 1, 1)
            m[rows, own] = np.inf
            outside = m.min(axis=1)
            most = np.maximum(inside, outside)
            s = np.where((size[own] <= 1) | (most == 0), 0.0, (outside - inside) / np.where(most == 0, 1, most))
            np.add.at(out, a + own, s)
        return out

    area, rows = core.sum_vectors(points.select("_f"), areas, len(stacked)), []
    for a, b in zip(begins, ends):
        some = count[a:b] > 0
        own, size, k = area[a:b][some], count[a:b][some], int(some.sum())
        if k < 2:
            rows.append(dict.fromkeys(("score", "total_area", "thickness", "min_relative_area", "balance")))
            continue
        total, thickness = own.sum(), size.max() / size.min()
        rel = own.min() / total * k if total > 0 else 0.0
        rows.append({"score": total / size.sum(), "total_area": total, "thickness": thickness, "min_relative_area": rel, "balance": total / size.sum() * rel / thickness})
    return rows


def best_k(df: DataFrame, ks: Sequence[int] | None = None, columns: Sequence[str] | None = None,
           scaling: str | None = "standard", seed: int = SEED, n_init: int = 10, sensitivity: float = 0.01,
           method: str = "squared") -> tuple[dict, DataFrame]:
    """Elbow and silhouette per k on one cached scaled frame; the silhouette balance decides.

    Returns ``{"elbow": k, "silhouette": k, "k": k}`` and the joined table.
    """
    ks = sorted(ks or range(2, 11))
    scaled, cols = _scaled(df, columns, scaling)
    data, rows = _vectors(scaled.select(*cols), cols), []
    found, _ = _runs(data, ks, seed, n_init)
    shapes = _shapes(data, [found[k][0] for k in ks]) if method == "squared" else [
        silhouette_summary(silhouette(_labelled(data, found[k][0], "cluster"), cols, "cluster", method), "cluster").first().asDict() for k in ks]
    for k, s in zip(ks, shapes):
        rows.append({"k": k, "inertia": round(found[k][1], 4), **{
            c: None if s[c] is None else round(s[c], 4) for c in ("score", "total_area", "thickness", "min_relative_area", "balance")}})
    data.unpersist()
    for prev, r in zip(rows, rows[1:]):
        r["drop"] = round(prev["inertia"] - r["inertia"], 4)
    bend = knee(ks, [r["inertia"] for r in rows], "decreasing", sensitivity)
    chosen = max(rows, key=lambda r: -math.inf if r["balance"] is None else r["balance"])["k"]
    table = core.rows_frame(df.sparkSession, rows, "k int, inertia double, drop double, score double, total_area double, "
                            "thickness double, min_relative_area double, balance double")
    return {"elbow": None if bend is None else ks[bend], "silhouette": chosen, "k": chosen}, table


def best_k_elbow(df: DataFrame, ks: Sequence[int] | None = None, columns: Sequence[str] | None = None,
                 scaling: str | None = "standard", seed: int = SEED, n_init: int = 10,
                 sensitivity: float = 0.01) -> tuple[int | None, DataFrame]:
    """Inertia per k and its bend."""
    ks = sorted(ks or range(2, 11))
    scaled, cols = _scaled(df, columns, scaling)
    data = _vectors(scaled.select(*cols), cols)
    found, _ = _runs(data, ks, seed, n_init)
    inertia = [found[k][1] for k in ks]
    data.unpersist()
    rows = [{"k": k, "inertia": round(v, 4), "drop": None if i == 0 else round(inertia[i - 1] - v, 4)}
            for i, (k, v) in enumerate(zip(ks, inertia))]
    bend = knee(ks, inertia, "decreasing", sensitivity)
    return (None if bend is None else ks[bend]), core.rows_frame(df.sparkSession, rows, "k int, inertia double, drop double")


# ------------------------------------------------------------------ merge tree
def _merge_tree(x: np.ndarray, w: np.ndarray, linkage: str, metric: str = "euclidean") -> list[tuple[int, int, float, float]]:
    """Agglomerate weighted points (a few hundred) by Lance-Williams updates: (child1, child2, distance, size)."""
    m = len(x)
    if metric == "cosine":
        norm = np.sqrt((x ** 2).sum(axis=1))
        x = x / np.where(norm == 0, 1.0, norm)[:, None]
    gap = x[:, None, :] - x[None, :, :]
    d = np.abs(gap).sum(axis=2) if metric == "manhattan" else np.sqrt((gap ** 2).sum(axis=2))
    d = d * d / 2 if metric == "cosine" else d
    if linkage == "ward":
        d = d * np.sqrt(2 * np.outer(w, w) / np.add.outer(w, w))
    np.fill_diagonal(d, np.inf)
    name, size, alive, out = list(range(m)), w.astype(float).copy(), np.ones(m, dtype=bool), []
    for step in range(m - 1):
        i, j = np.unravel_index(np.argmin(np.where(np.outer(alive, alive), d, np.inf)), d.shape)
        i, j = min(i, j), max(i, j)
        h, si, sj = d[i, j], size[i], size[j]
        if linkage == "ward":
            new = np.sqrt(np.maximum(0, ((si + size) * d[i] ** 2 + (sj + size) * d[j] ** 2 - size * h * h) / (si + sj + size)))
        elif linkage == "complete":
            new = np.maximum(d[i], d[j])
        elif linkage == "single":
            new = np.minimum(d[i], d[j])
        else:
            new = (si * d[i] + sj * d[j]) / (si + sj)
        out.append((*sorted((name[i], name[j])), float(h), float(si + sj)))
        d[i], d[:, i] = new, new
        d[i, i], alive[j], size[i], name[i] = np.inf, False, si + sj, m + step
    return out


def single_linkage(df: DataFrame, columns: Sequence[str], k: int | None = None, distance_threshold: float | None = None, label: str = "cluster",
                   metric: str = "euclidean") -> tuple[DataFrame, DataFrame, float | None]:
    """Labelled rows, tree rows ``step, child1, child2, distance, size``, height of the cut; exact over the distinct points of all rows.

    The minimum spanning tree, its edges in ascending order, is the dendrogram: row ``step`` joins what points ``child1`` and ``child2`` (numbers
    of distinct points in order of their coordinates) belong to by then; ``size`` is missing. Clusters are what stays connected up to the
    threshold, or without the k - 1 longest edges; they are numbered by their first point. Copies are one point. Rows with a missing
    coordinate have no label.
    """
    space = _space(df, list(columns), metric)
    distinct = space.data.where("_x is not null").select(F.col("_x").alias("x")).distinct().withColumn("one", F.lit(1))
    points = core.checkpoint(core.cumulate(core.checkpoint(distinct), [], ["x"], ["one"]).select(F.col("one_before").cast("long").alias("pid"), "x"))
    n = points.count()
    order = ["d", "a", "b"]
    tree = spanning_tree(points, space.p)
    tree = core.checkpoint(core.cumulate(tree.select("a", "b", space.outward(F.col("d")).alias("d")).withColumn("one", F.lit(1)), [], order, ["one"])
                           .select(F.col("one_before").cast("int").alias("step"), F.col("a").alias("child1"), F.col("b").alias("child2"), F.col("d").alias("distance"),
                                   F.lit(None).cast("double").alias("size"))) if n > 1 else core.rows_frame(
        df.sparkSession, [], "step int, child1 long, child2 long, distance double, size double")
    kept = tree.where(F.col("distance") <= distance_threshold) if k is None else tree.where(F.col("step") < n - k)
    if k is None:
        cut = float(distance_threshold)
    else:
        around = {r["step"]: r["distance"] for r in tree.where(F.col("step").isin(n - k - 1, n - k)).collect()}
        low, high = around.get(n - k - 1), around.get(n - k)
        cut = (low + high) / 2 if None not in (low, high) else None if low is None else low * 1.05
    roots = core.checkpoint(components(kept.select(F.col("child1").alias("a"), F.col("child2").alias("b")), points.select(F.col("pid").alias("node"))))
    first = core.cumulate(roots.select("root").distinct().withColumn("one", F.lit(1)), [], ["root"], ["one"]).select("root", F.col("one_before").cast("int").alias("_c"))
    labels = points.join(roots.join(first, "root").select(F.col("node").alias("pid"), "_c"), "pid").select(F.col("x").alias("_x"), "_c")
    out = space.data.join(labels, "_x", "left").select(*[space.data[c] for c in df.columns], F.col("_c").alias(label))
    return out, tree, cut


def agglomerative(df: DataFrame, k: int | None = None, distance_threshold: float | None = None,
                  columns: Sequence[str] | None = None, scaling: str | None = "standard", linkage: str = "ward",
                  label: str = "cluster", micro: int = 200, seed: int = SEED,
                  metric: str = "euclidean") -> tuple[DataFrame, DataFrame, float | None]:
    """Merge tree: labelled rows, tree rows, height of the cut.

    ``single`` linkage is exact over all rows (``single_linkage``). Other trees are over weighted micro-clusters: the tree is built over ``micro`` centres that condense the rows with the least squared error, weighted by their rows: k-means on Spark,
    or the distinct rows themselves where there are no more of them than centres (their error is 0, which no other choice undercuts).
    """
    if metric not in ("euclidean", "manhattan", "cosine") or (linkage == "ward" and metric != "euclidean"):
        raise ValueError(f"metric {metric} does not go with {linkage}")
    if linkage not in ("ward", "complete", "average", "single"):
        raise ValueError(f"unknown linkage: {linkage}")
    if (k is None) == (distance_threshold is None):
        raise ValueError("give either k or distance_threshold")
    scaled, cols = _scaled(df, columns, scaling)
    if linkage == "single":
        return single_linkage(scaled, cols, k, distance_threshold, label, metric)
    data = scaled.persist()
    head = data.select(*cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).limit(micro + 1).collect()
    if len(head) <= micro:
        centers = np.array([[r[c] for c in cols] for r in head])
        weights = np.array([r["_n"] for r in head], dtype=float)
        table = core.rows_frame(df.sparkSession, [{**{c: r[c] for c in cols}, "_micro": i} for i, r in enumerate(head)],
                                ", ".join(f"{c} double" for c in cols) + ", _micro int")
        labelled = core.attach(data, table, cols)
    else:
        vec = _vectors(data, cols)
        centers = _runs(vec, [micro], seed, 1)[0][micro][0]
        labelled = _labelled(vec, centers, "_micro")
        size = {r["_micro"]: r["count"] for r in labelled.groupBy("_micro").count().collect()}
        weights = np.array([size.get(i, 0) for i in range(len(centers))], dtype=float)
        weights[weights == 0] = 1e-9
    tree = _merge_tree(centers, weights, linkage, metric)
    heights = sorted(t[2] for t in tree)
    m = len(centers)
    merges = m - k if k is not None else sum(h <= distance_threshold for h in heights)
    parent = list(range(2 * m))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, (a, b, _, _) in enumerate(tree[:max(0, merges)]):
        parent[find(a)] = parent[find(b)] = m + i
    roots = [find(i) for i in range(m)]
    number = {r: i for i, r in enumerate(dict.fromkeys(roots[i] for i in sorted(range(m), key=lambda i: tuple(centers[i]))))}
    mapping = F.array(*[F.lit(number[r]) for r in roots])
    if distance_threshold is not None:
        cut = float(distance_threshold)
    elif merges >= len(heights):
        cut = heights[-1] * 1.05 if heights else None
    else:
        cut = None if merges < 1 else (heights[merges - 1] + heights[merges]) / 2
    rows = [{"step": i, "child1": a, "child2": b, "distance": h, "size": s} for i, (a, b, h, s) in enumerate(tree)]
    frame = core.rows_frame(df.sparkSession, rows, "step int, child1 int, child2 int, distance double, size double")
    return labelled.withColumn(label, mapping[F.col("_micro")]).drop("_micro"), frame, cut


# ------------------------------------------------------------- density methods
@dataclass
class _Space:
    """Rows with a point ``_x`` whose L1 or L2 distance orders pairs as the metric does; missing where the metric is undefined."""

    data: DataFrame
    p: int
    cosine: bool

    def outward(self, distance):
        """The metric's own distance."""
        return distance * distance / 2 if self.cosine else distance

    def inward(self, radius: float) -> float:
        return math.sqrt(2 * radius) if self.cosine else radius


def _space(scaled: DataFrame, cols: list[str], metric: str, others: Sequence[str] | None = None) -> _Space:
    """``euclidean``, ``manhattan`` or ``cosine`` (unit vectors, where 1 - cos is half the squared distance; a zero vector has no direction).

    The points are pinned, with the columns ``others`` (default: all): they are packed once, whatever number of steps reads them.
    """
    if metric not in ("euclidean", "manhattan", "cosine"):
        raise ValueError(f"unknown metric: {metric}")
    own = [core.col_of(c) for c in (scaled.columns if others is None else others) if c != "_x"]
    # the packed point is named once, as every mention of it would be computed anew
    whole = F.filter(F.array(F.array(*[num(c) for c in cols])), lambda x: F.forall(x, lambda e: e.isNotNull()))
    data = scaled.select(*own, F.get(whole, F.lit(0)).alias("_x"))
    if metric == "cosine":      # the norm is pinned as well, or each coordinate would sum it anew
        data = core.checkpoint(data.withColumn("_norm", F.sqrt(F.aggregate("_x", F.lit(0.0), lambda total, e: total + e * e))))
        data = data.withColumn("_x", F.when(F.col("_norm") > 0, F.transform("_x", lambda e: e / F.col("_norm")))).drop("_norm")
    data = core.checkpoint(data)
    return _Space(data, 1 if metric == "manhattan" else 2, metric == "cosine")


def knn_distance(df: DataFrame, row_id: str, k: int = 5, columns: Sequence[str] | None = None,
                 scaling: str | None = "standard", metric: str = "euclidean") -> DataFrame:
    """Distance of every row to its k-th nearest row (itself included); missing for rows with a missing coordinate."""
    cols = list(columns or [c for c in core.numeric_columns(df) if c != row_id])
    scaled, cols = _scaled(df, cols, scaling)
    s = _space(scaled, cols, metric, [row_id])
    near = neighbours(distinct_points(s.data, "_x", row_id), k, s.p).select(F.col("x").alias("_x"), "kdist")
    # the hash comes first, so that whole points are compared only where hashes agree
    return s.data.withColumn("_h", F.xxhash64("_x")).join(near.withColumn("_h", F.xxhash64("_x")), ["_h", "_x"], "left").select(row_id, s.outward(F.col("kdist")).alias("distance"))


#: Points of the k-distance curve on which its bend is looked for, whatever the number of rows.
CURVE_POINTS = 1_000


def best_eps(df: DataFrame, row_id: str, min_samples: int = 5, columns: Sequence[str] | None = None, scaling: str | None = "standard",
             sensitivity: float = 1.0, points: int = CURVE_POINTS, metric: str = "euclidean") -> tuple[float | None, DataFrame]:
    """Bend of the sorted k-distance curve, read at ``points`` evenly spaced places (between ranks by interpolation); and the whole curve."""
    dist = core.checkpoint(knn_distance(df, row_id, min_samples, columns, scaling, metric).where("distance is not null"))
    curve = core.value_ranks(dist, "distance")
    n = dist.count()
    if not n:
        return None, curve.select(F.col("cnt_before").alias("rank_from"), "cnt", F.col("value").alias("distance"))
    step = F.lit((n - 1) / (points - 1) or 1.0)
    place = F.col("j") * step
    parts = None
    for ahead in (0, 1):       # a place between two ranks takes its share of either
        low, high = F.col("cnt_before") - ahead, F.col("cnt_before") + F.col("cnt") - ahead
        first = F.greatest(F.ceil(low / step) - 1, F.lit(0))
        last = F.least(F.ceil(high / step) + 1, F.lit(points - 1))
        inside = curve.where(first <= last).select("value", low.alias("lo"), high.alias("hi"), F.explode(F.sequence(first, last)).alias("j")).where(
            (F.floor(place) >= F.col("lo")) & (F.floor(place) < F.col("hi")))
        share = place - F.floor(place) if ahead else 1 - place + F.floor(place)
        one = inside.select("j", (share * F.col("value")).alias("v"))
        parts = one if parts is None else parts.unionByName(one)
    got = parts.groupBy("j").agg(F.sum("v").alias("v")).orderBy("j").collect()      # ``points`` rows
    at = knee([r["j"] for r in got], [r["v"] for r in got], "increasing", sensitivity)
    return (None if at is None else float(got[at]["v"])), curve.select(F.col("cnt_before").alias("rank_from"), "cnt", F.col("value").alias("distance"))


#: Principal axes by which cells are dealt into zones; 3 ** ZONE_AXES neighbours each.
ZONE_AXES = 3


def dbscan(df: DataFrame, row_id: str, eps: float = 0.5, min_samples: int = 5, columns: Sequence[str] | None = None,
           scaling: str | None = "standard", label: str = "cluster", vector: str = "vector", metric: str = "euclidean") -> DataFrame:
    """Density clusters: ``label`` (-1 noise), ``vector`` core / border / noise; both missing for rows with a missing coordinate.

    A point is core when its ``min_samples``-th neighbour lies within eps.  Core points of one cell always belong together, so cells are
    the graph's nodes; the neighbours found so far link most of them. Two cells still apart are linked by testing bounding boxes that shrink
    until they decide, never by pairing their points.  A border point has fewer than ``min_samples`` neighbours, so its core neighbours are in the list the neighbour search returned.
    Clusters are numbered by their first core row.
    """
    cols = list(columns or [c for c in core.numeric_columns(df) if c != row_id])
    scaled, cols = _scaled(df, cols, scaling)
    space, d = _space(scaled, cols, metric), len(cols)
    eps = space.inward(eps)
    near = core.checkpoint(neighbours(distinct_points(space.data, "_x", row_id), min_samples, space.p).withColumn(
        "is_core", F.coalesce(F.col("kdist") <= eps, F.lit(False))))
    side = eps / (math.sqrt(d) if space.p == 2 else d)
    cores = near.where("is_core").select("pid", "x", F.transform("x", lambda e: F.floor(e / side)).alias("cell"))
    cells = cores.groupBy("cell").agg(F.min("pid").alias("node"))
    cores = core.checkpoint(cores.join(cells, "cell").select("pid", "node", "x"))
    node = cores.select("pid", "node")
    known = (near.where("is_core").select("pid", F.explode("near").alias("n")).where(F.col("n.dist") <= eps).select("pid", F.col("n.pid").alias("to"))
             .join(node, "pid").join(node.select(F.col("pid").alias("to"), F.col("node").alias("b")), "to").select(F.col("node").alias("a"), "b").where("a <> b").distinct())
    nodes = cores.select("node").distinct()
    roots = core.checkpoint(components(known, nodes))
    edges = _cell_edges(cores, d, eps, side, space.p, roots)
    if not edges.isEmpty():
        far = edges.join(roots.withColumnRenamed("node", "a"), "a").select("b", F.col("root").alias("a")).join(
            roots.withColumnRenamed("node", "b"), "b").select("a", F.col("root").alias("b"))
        over = components(far, roots.select(F.col("root").alias("node")).distinct())
        roots = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root").select("node", F.col("_top").alias("root"))
    first = core.cumulate(roots.select("root").distinct().withColumn("one", F.lit(1)), [], ["root"], ["one"])
    number = roots.join(first, "root").select("node", F.col("one_before").cast("int").alias("_c"))
    core_label = core.checkpoint(cores.select("pid", "node").join(number, "node").select("pid", "_c"))
    reach = near.where("not is_core").select("pid", F.explode("near").alias("n")).where(F.col("n.dist") <= eps).select(
        F.col("pid").alias("_b"), F.col("n.pid").alias("pid"))
    border = reach.join(core_label, "pid").groupBy(F.col("_b").alias("pid")).agg(F.min("_c").alias("_c"))
    tagged = core_label.withColumn("_v", F.lit("core")).unionByName(border.withColumn("_v", F.lit("border")))
    points = near.select("pid", F.col("x").alias("_x")).join(tagged, "pid", "left").drop("pid")
    whole = F.col("_x").isNotNull()
    return space.data.join(points, "_x", "left").select(
        *[space.data[c] for c in scaled.columns], F.when(whole, F.coalesce("_c", F.lit(-1))).alias(label),
        F.when(whole, F.coalesce("_v", F.lit("noise"))).alias(vector))


def _gaps(p: int):
    """Least and largest distance between box a and box b."""
    sides = F.arrays_zip("a_lo", "a_hi", "b_lo", "b_hi")
    gap = F.transform(sides, lambda z: F.greatest(F.lit(0.0), z["a_lo"] - z["b_hi"], z["b_lo"] - z["a_hi"]))
    far = F.transform(sides, lambda z: F.greatest(F.abs(z["a_hi"] - z["b_lo"]), F.abs(z["b_hi"] - z["a_lo"])))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + (e * e if p == 2 else e))
    return (F.sqrt(total(gap)), F.sqrt(total(far))) if p == 2 else (total(gap), total(far))


def _boxes(cores: DataFrame, d: int, width: float | None, parent: float | None, tag: str) -> DataFrame:
    """Tight boxes per node and sub-cell of ``width`` (whole node without), with the parent sub-cell's key."""
    def key(w):
        return F.lit(0).cast("long") if w is None else F.xxhash64("node", F.transform("x", lambda e: F.floor(e / w)))
    return cores.groupBy(F.col("node").alias(f"{tag}_node"), key(width).alias(f"{tag}_box")).agg(
        F.min(key(parent)).alias(f"{tag}_up"), F.array(*[F.min(F.get("x", F.lit(i))) for i in range(d)]).alias(f"{tag}_lo"),
        F.array(*[F.max(F.get("x", F.lit(i))) for i in range(d)]).alias(f"{tag}_hi"))


def _cell_edges(cores: DataFrame, d: int, eps: float, side: float, p: int, roots: DataFrame) -> DataFrame:
    """Pairs of cells of different components (``node, root``) that hold core points within eps of each other.

    Cells meet in zones along the few directions in which the points vary most: a cell's box is no wider than eps, so the middles of two
    linked cells are 2 eps apart at most, along any direction.
    """
    a, b = (_boxes(cores, d, None, None, t).join(roots.select(F.col("node").alias(f"{t}_node"), F.col("root").alias(f"{t}_root")), f"{t}_node") for t in "ab")
    spread = core.gram(cores, {f"x{i}": F.get("x", F.lit(i)) for i in range(d)}).cross
    axes = np.linalg.eigh(spread)[1][:, ::-1][:, :min(ZONE_AXES, d)].T
    middle = lambda t: F.zip_with(f"{t}_lo", f"{t}_hi", lambda u, v: (u + v) / 2)
    along = lambda t, axis: F.aggregate(F.zip_with(middle(t), F.array(*[F.lit(float(v)) for v in axis]), lambda u, v: u * v), F.lit(0.0), lambda s, e: s + e)
    coarse = lambda t: [F.floor(along(t, axis) / (2 * eps * (1 + 1e-9))) for axis in axes]
    steps = [F.struct(*[F.lit(s).cast("long").alias(f"o{i}") for i, s in enumerate(c)])
             for c in itertools.product((-1, 0, 1), repeat=len(axes))]
    own = core.checkpoint(a.withColumn("_at", F.array(*coarse("a"))))
    spread_out = own.withColumn("_off", F.explode(F.array(*steps))).withColumn("_zone", F.array(*[F.col("_at")[i] + F.col(f"_off.o{i}") for i in range(len(axes))])).drop("_off", "_at")
    pairs = spread_out.join(b.withColumn("_zone", F.array(*coarse("b"))), "_zone").where("a_node < b_node and a_root <> b_root")
    edges, width = None, None
    least, most = _gaps(p)
    while True:
        judged = core.checkpoint(pairs.withColumn("_min", least).where(F.col("_min") <= eps).withColumn("_max", most).select(
            "a_node", "b_node", "a_box", "b_box", (F.col("_max") <= eps).alias("_sure")))
        sure = judged.where("_sure").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
        edges = sure if edges is None else edges.unionByName(sure)
        rest = judged.where("not _sure").join(sure, (F.col("a_node") == F.col("a")) & (F.col("b_node") == F.col("b")), "left_anti")
        if rest.isEmpty():
            return core.checkpoint(edges)
        parent, width = width, (side if width is None else width) / 4
        involved = rest.select(F.explode(F.array("a_node", "b_node")).alias("node")).distinct()
        inside = cores.join(involved, "node", "left_semi")
        aa, bb = _boxes(inside, d, width, parent, "a"), _boxes(inside, d, width, parent, "b")
        pairs = (rest.select("a_node", "b_node", F.col("a_box").alias("a_up"), F.col("b_box").alias("b_up"))
                 .join(aa, ["a_node", "a_up"]).join(bb, ["b_node", "b_up"]))


def dbscan_summary(df: DataFrame, label: str = "cluster", vector: str = "vector") -> DataFrame:
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(vector) == "core").alias("core"),
                              F.count_if(F.col(vector) == "border").alias("border"))
    total = g.agg(F.sum("n")).first()[0]
    return g.select(label, "n", F.round(F.col("n") / total * 100, 1).alias("pct"), "core", "border")


# -------------------------------------------------------------------- profiles
def _id_like(df: DataFrame, cols: Sequence[str]) -> set[str]:
    """Columns whose values are all distinct; only close calls of the estimate are counted exactly."""
    if not cols:
        return set()
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c, 0.02).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    likely = [c for i, c in enumerate(cols) if row[f"_{i}"] > 0.85 * row["n"]]
    if not likely:
        return set()
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), col_of(c).cast("string").alias("v")) for c in likely])))
    distinct = long.groupBy("variable", "v").agg(F.lit(1).alias("one")).groupBy("variable").agg(F.count("one").alias("k")).collect()
    return {r["variable"] for r in distinct if r["k"] == row["n"]}


def persona(df: DataFrame, label: str = "cluster", columns: Sequence[str] | None = None, num_columns: Sequence[str] | None = None,
            cat_columns: Sequence[str] | None = None, exclude: Sequence[str] = (), alpha: float = 0.05,
            noise: int | None = -1) -> dict[str, DataFrame]:
    """Cluster profiles: ``numeric`` (mean or median by normality), ``nominal`` (mode), ``shares`` (percent per level)."""
    core.require(df, [label])
    rest = [c for c in df.columns if c != label and c not in exclude]
    drop = _id_like(df, [c for c in rest if num_columns is None or cat_columns is None])
    num_columns = list(num_columns) if num_columns is not None else [c for c in core.numeric_columns(df) if c in rest and c not in drop]
    cat_columns = list(cat_columns) if cat_columns is not None else [
        c for c in core.nominal_columns(df) if c in rest and c not in drop]
    if columns:
        num_columns = [c for c in columns if c in num_columns] + [c for c in num_columns if c not in columns]
    real = df.where(col_of(label) != F.lit(noise)) if noise is not None else df
    total = df.count()
    out = {}
    if num_columns:
        m = core.moments(real, num_columns, [label])
        med = core.group_quantiles(real, num_columns, [.5], [label]).select(label, "variable", F.col("q")[0].alias("median"))
        both = m.join(med, [label, "variable"])
        p = pvalue.k2_p(pvalue.k2_statistic(F.col("n"), F.col("skew"), F.col("kurt")))
        usable = (F.col("n") >= 8) & (F.col("min") < F.col("max"))
        mean_it = F.coalesce(usable & (p > alpha), F.lit(False))
        out["numeric"] = both.select(
            label, F.col("rows").alias("size"), F.round(F.col("rows") / total * 100, 1).alias("pct"), "variable",
            F.round("mean", 3).alias("mean"), F.round("median", 3).alias("median"),
            F.when(mean_it, "mean").otherwise("median").alias("method"),
            F.round(F.when(mean_it, F.col("mean")).otherwise(F.col("median")), 3).alias("value"))
    if cat_columns:
        long = df.select(label, F.inline(F.array(*[
            F.struct(F.lit(c).alias("variable"), col_of(c).cast("string").alias("level")) for c in cat_columns])))
        counts = long.where(F.col("level").isNotNull()).groupBy(label, "variable", "level").agg(F.count(F.lit(1)).alias("n"))
        kept = counts.where(col_of(label) != F.lit(noise)) if noise is not None else counts
        out["nominal"] = kept.groupBy(label, "variable").agg(
            F.min(F.struct((-F.col("n")).alias("k"), F.col("level").alias("top"))).alias("_m")).select(
            label, "variable", F.col("_m.top").alias("top"), (-F.col("_m.k")).alias("freq"))
        per = kept.withColumn("pct", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(label, "variable")) * 100, 1))
        overall = counts.groupBy("variable", "level").agg(F.sum("n").alias("n"))
        overall = overall.withColumn("pct", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("variable")) * 100, 1))
        out["shares"] = per.select(F.col(label).cast("string").alias(label), "variable", "level", "n", "pct").unionByName(
            overall.select(F.lit("all").alias(label), "variable", "level", "n", "pct"))
    return out
