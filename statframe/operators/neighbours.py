"""Exact nearest neighbours of distinct points without emitting all pairs.

Points are turned to their principal axes (euclidean) and dealt into zones by a k-d partition whose cuts come from a bounded sample. A zone with more
rows than a leaf holds is cut again from a sample of its own, so leaves keep their size however many points there are. Every leaf finds
neighbours among its own points; a point visits another leaf only if that leaf's box and ball are closer than the neighbours it already has.
The driver and the tasks hold the bounds of zones, at most ``ZONES`` of them; bounds of leaves stay with their zone.
Where points reach a large share of the zones (many independent coordinates), blocks of askers are held instead and the points of the zones in
their reach stream past them: products of matrices tell who may be near, their distances are then taken coordinate by coordinate.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statframe.operators import core

LEAF_ROWS = 4_000
SAMPLE_ROWS = 40_000
ZONES = 4_000
QUERY_ROWS = 20_000       # queries of one leaf handled by one task
SCAN_ROWS = 10_000        # points from which blocks are scanned instead of leaves visited,
SCAN_SHARE = 0.08         # if a point reaches this share of the zones
SCAN_BLOCK = 16_384       # askers a scanning task holds
SCAN_BLOCKS = 8           # blocks, at least, into which askers are dealt,
SCAN_PARTS = 4            # tasks, at least, among which the points that pass a block are dealt,
SCAN_PART = 500_000       # and points, at most, that pass in one of them
TILE = 1_024              # points compared at once,
ASKERS = {2: 256, 1: 64}  # with so many askers


def distinct_points(df: DataFrame, vector: str, row_id: str) -> DataFrame:
    """``pid`` (smallest row id), ``x`` (array of coordinates), ``cnt``: copies of a point become one row, missing points none."""
    data = df.select(F.col(row_id).cast("long").alias("_id"), F.col(vector).alias("x")).where(F.col("x").isNotNull())
    return core.checkpoint(data.groupBy("x").agg(F.min("_id").alias("pid"), F.count(F.lit(1)).alias("cnt")))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float)


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _longs(*names: str) -> pa.Schema:
    return pa.schema([(c, pa.int64()) for c in names])


def _cuts(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """k-d tree as a node list (dim, value, left, right); a leaf is (-1, 0, number, 0)."""
    nodes: list = []
    count = 0

    def grow(rows: np.ndarray, want: int) -> int:
        nonlocal count
        me = len(nodes)
        nodes.append(None)
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(sample.shape[1])
        dim = int(np.argmax(spread))
        if want <= 1 or len(rows) < 4 or spread[dim] == 0:
            nodes[me] = (-1, 0.0, count, 0)
            count += 1
            return me
        value = float(np.median(rows[:, dim]))
        low = rows[:, dim] < value
        if not low.any() or low.all():
            value = float(rows[:, dim].mean())
            low = rows[:, dim] < value
        a = grow(rows[low], want // 2)
        b = grow(rows[~low], want - want // 2)
        nodes[me] = (dim, value, a, b)
        return me

    grow(sample, leaves)
    return nodes


def _leaf_of(nodes: list, x: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
    while todo:
        node, idx = todo.pop()
        dim, value, a, b = nodes[node]
        if dim < 0:
            out[idx] = a
            continue
        low = x[idx, dim] < value
        todo += [(a, idx[low]), (b, idx[~low])]
    return out


def _distances(q: np.ndarray, x: np.ndarray, p: int) -> np.ndarray:
    """Every query against every point, one coordinate at a time (no rounding beyond the sum itself)."""
    d = np.zeros((len(q), len(x)))
    for a, b in zip(q.T, x.T):
        gap = a[:, None] - b[None, :]
        d += gap * gap if p == 2 else np.abs(gap)
    return np.sqrt(d) if p == 2 else d


def _norm(gap: np.ndarray, p: int, axis: int = 1) -> np.ndarray:
    return np.sqrt((gap ** 2).sum(axis=axis)) if p == 2 else np.abs(gap).sum(axis=axis)


def _nearest(q: np.ndarray, x: np.ndarray, cnt: np.ndarray, pid: np.ndarray, k: int, p: int = 2):
    """For each query the points that make up its k nearest rows (copies counted): lists of (dist, pid, cnt)."""
    out, m = [], min(k, len(x))
    squares = (x * x).sum(axis=1)
    for lo in range(0, len(q), 512):
        part = q[lo:lo + 512]
        if p == 2 and x.shape[1] > 4:
            # one product of matrices finds who may be among the nearest; their distances are then taken coordinate by coordinate
            own = (part * part).sum(axis=1)
            rough = own[:, None] + squares - 2 * part @ x.T
            slack = 1e-12 * (own + squares.max())
            least = np.partition(rough, m - 1, axis=1)[:, m - 1] + 2 * slack
            rows = [np.flatnonzero(r <= limit) for r, limit in zip(rough, least)]
            found = [(idx, _norm(x[idx] - at, 2)) for at, idx in zip(part, rows)]
        else:
            d = _distances(part, x, p)
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            found = [(idx, row[idx]) for row, idx in zip(d, near)]
        for idx, d in found:
            order = np.lexsort((pid[idx], d))
            idx, d = idx[order], d[order]
            keep = slice(0, int(np.searchsorted(np.cumsum(cnt[idx]), k)) + 1)
            out.append([(float(v), int(pid[i]), int(cnt[i])) for i, v in zip(idx[keep], d[keep])])
    return out


def _kth(items: list, k: int) -> float:
    total = 0
    for d, _, c in items:
        total += c
        if total >= k:
            return d
    return float("inf")


class Tiles:
    """Askers ``x`` held by a task: which points that pass may lie within a limit of each."""

    def __init__(self, x: np.ndarray, p: int, radius: np.ndarray | None = None):
        self.x, self.p, self.centre = x, p, x.mean(axis=0)
        self.reach = math.inf if radius is None else float(np.median(radius))
        near = x - self.centre
        if p == 2:
            self.own = (near * near).sum(axis=1)
            # single precision where its slack is small beside the radius
            self.slack = 2.4e-7 * (x.shape[1] + 4)
            small = self.own.max() < 1e30 and 2 * self.slack * self.own.max() <= 0.02 * self.reach ** 2 < math.inf
            self.kind, self.slack = (np.float32, self.slack) if small else (float, 1e-12)
            self.rows = np.column_stack([near, np.ones(len(near))]).astype(self.kind)
        else:
            self.own, self.rows = np.abs(near).sum(axis=1), near

    def over(self, x: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(askers, points, rough, base, slack) by tiles: the distance (p = 2: its square) is ``rough + base``, give or take ``slack``."""
        near = x - self.centre
        steps = _Steps.of(self.rows, near, self.reach, np.abs(self.centre).max(initial=0)) if self.p == 1 and len(x) else None
        for lo in range(0, len(x), TILE):
            part = near[lo:lo + TILE]
            size = (part * part).sum(axis=1) if self.p == 2 else np.abs(part).sum(axis=1)
            kind = self.kind if self.p == 2 and size.max() < 1e30 else float
            right = np.vstack([-2 * part.T, size]).astype(kind) if self.p == 2 else np.ascontiguousarray(part.T)
            for a in range(0, len(self.x), ASKERS[self.p]):
                at = slice(a, a + ASKERS[self.p])
                own = self.own[at]
                if self.p == 2:
                    yield at, slice(lo, lo + TILE), self.rows[at] @ right, own, self.slack * (own + size.max())
                elif steps:
                    yield at, slice(lo, lo + TILE), steps.sums(at, slice(lo, lo + TILE)), np.zeros(len(own)), np.full(len(own), steps.slack)
                else:
                    yield at, slice(lo, lo + TILE), _sums(self.rows[at], right), np.zeros(len(own)), 1e-4 * (own + size.max())

    def bound(self, limit: np.ndarray, base: np.ndarray, slack: np.ndarray) -> np.ndarray:
        return (limit * limit if self.p == 2 else limit) - base + 2 * slack

    @staticmethod
    def reached(rough: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asker, point) of the tile's places that are not above the asker's ``least``."""
        if rough.dtype == np.float32:       # rounded up
            with np.errstate(over="ignore"):
                least = np.nextafter(least.astype(np.float32), np.float32(np.inf))
        rows = np.flatnonzero(rough.min(axis=1) <= least)
        if not len(rows):
            return rows, rows
        i, j = np.divmod(np.flatnonzero(rough[rows] <= least[rows, None]), rough.shape[1])
        return rows[i], j

    def exact(self, i: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances of askers ``i`` from the points ``at``."""
        return np.concatenate([_norm(at[lo:lo + 65_536] - self.x[i[lo:lo + 65_536]], self.p) for lo in range(0, len(i), 65_536)]) if len(i) else np.zeros(0)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distances of rows of ``a`` from columns of ``b`` in single precision (1e-4 of the sizes covers up to 800 coordinates), else double."""
    kind = np.float32 if a.shape[1] <= 800 and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 1e30 else float
    a, b = a.astype(kind), b.astype(kind)
    total, more = np.zeros((len(a), b.shape[1]), kind), np.empty((len(a), b.shape[1]), kind)
    for u, v in zip(np.ascontiguousarray(a.T), b):            # |u - v| = 2 max(u, v) - u - v
        np.maximum(u[:, None], v[None, :], out=more)
        total += more
    return 2 * total - a.sum(axis=1)[:, None] - b.sum(axis=0)


@dataclass
class _Steps:
    """Points in whole steps, whose Manhattan distances are sums of 16-bit integers: each coordinate is off by less than a step."""

    a: np.ndarray              # a row per coordinate
    b: np.ndarray
    step: float
    slack: float

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, reach: float, far: float) -> _Steps | None:
        """None where steps would be too coarse beside the distance looked for."""
        low, high, d = min(a.min(), b.min()), max(a.max(), b.max()), a.shape[1]
        levels = 65_535 // d
        step = (high - low) / max(levels - 1, 1)
        slack = 1.01 * d * step + 1e-15 * d * (far + max(abs(low), abs(high)))
        if levels < 256 or not 0 < step < 1e30 or not slack <= 0.05 * reach < math.inf:
            return None
        whole = lambda x: np.ascontiguousarray(np.floor((x - low) / step).astype(np.uint16).T)
        return cls(whole(a), whole(b), step, slack)

    def sums(self, at: slice, to: slice) -> np.ndarray:
        a, b = self.a[:, at], self.b[:, to]
        total, more = np.zeros((a.shape[1], b.shape[1]), np.uint16), np.empty((a.shape[1], b.shape[1]), np.uint16)
        for u, v in zip(a, b):            # no sum exceeds 16 bits
            np.maximum(u[:, None], v[None, :], out=more)
            total += more
        out = 2 * total.astype(np.float32) - a.sum(axis=0, dtype=np.float32)[:, None] - b.sum(axis=0, dtype=np.float32)
        return out * np.float32(self.step)


def _radii(x: np.ndarray, k: int, p: int) -> np.ndarray:
    """For each point a distance that the k-th nearest of these points does not exceed; infinite if there are fewer."""
    if len(x) < k:
        return np.full(len(x), np.inf)
    near, out = x - x.mean(axis=0), []
    size = (near * near).sum(axis=1) if p == 2 else np.abs(near).sum(axis=1)
    right = np.ascontiguousarray(near.T)
    for lo in range(0, len(x), ASKERS[p]):
        part, own = near[lo:lo + ASKERS[p]], size[lo:lo + ASKERS[p], None]
        rough = own + size - 2 * part @ right if p == 2 else np.concatenate([_sums(part, right[:, c:c + TILE]) for c in range(0, len(x), TILE)], axis=1).astype(float)
        kth = np.maximum(np.partition(rough, k - 1, axis=1)[:, k - 1], 0) + (1e-11 if p == 2 else 1e-4) * (own[:, 0] + size.max())
        out.append(np.sqrt(kth) * (1 + 1e-12) if p == 2 else kth)
    return np.concatenate(out)


class _NearestScan:
    """The k nearest rows of the askers held, among the points that pass; ``radius``: a distance within which they lie."""

    def __init__(self, pid: np.ndarray, x: np.ndarray, tag: np.ndarray, radius: np.ndarray, k: int, p: int):
        self.pid, self.tag, self.limit, self.k, self.tiles = pid, tag, radius.copy(), k, Tiles(x, p, radius)
        self.found = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def see(self, pid: np.ndarray, x: np.ndarray, cnt: np.ndarray, _) -> None:
        hits, fresh = [self.found], 0
        for at, to, rough, base, slack in self.tiles.over(x):
            limit = self.limit[at]
            least = self.tiles.bound(limit, base, slack)
            loose = np.flatnonzero(~np.isfinite(limit))
            if len(loose) and rough.shape[1] > self.k:
                least[loose] = np.partition(rough[loose], self.k - 1, axis=1)[:, self.k - 1] + 2 * slack[loose]
            i, j = self.tiles.reached(rough, least)
            for lo in range(0, len(i), 65_536):
                ii, jj = i[lo:lo + 65_536] + at.start, j[lo:lo + 65_536] + to.start
                d = self.tiles.exact(ii, x[jj])
                keep = d <= self.limit[ii]
                hits.append((ii[keep], d[keep], pid[jj[keep]], cnt[jj[keep]]))
                fresh += len(ii)
                if fresh > 500_000:
                    hits, fresh = [self._cut(hits)], 0
        self.found = self._cut(hits)

    def _cut(self, hits: list) -> tuple:
        """What makes up the k nearest rows of each asker; limits shrink to the last of them."""
        i, d, pid, cnt = (np.concatenate(c) for c in zip(*hits))
        order = np.lexsort((pid, d, i))
        i, d, pid, cnt = i[order], d[order], pid[order], cnt[order]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])[:len(i)]
        total = np.cumsum(cnt)
        before = total - cnt - np.repeat((total - cnt)[starts], np.diff(np.r_[starts, len(i)]))
        keep = before < self.k
        full = keep & (before + cnt >= self.k)
        self.limit[i[full]] = d[full]
        return i[keep], d[keep], pid[keep], cnt[keep]

    def rows(self) -> pa.RecordBatch:
        i, d, pid, cnt = self.found
        ends = np.searchsorted(i, np.arange(len(self.pid) + 1))
        items = pa.StructArray.from_arrays([pa.array(d), pa.array(pid), pa.array(cnt)], ["dist", "pid", "cnt"])
        return pa.RecordBatch.from_arrays([pa.array(self.pid), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items), pa.array(self.tag)], ["pid", "found", "visits"])


class _ClosestScan:
    """For each component (``tag``) of the askers held the shortest edge to a point of another one, if within ``radius``."""

    def __init__(self, pid: np.ndarray, x: np.ndarray, tag: np.ndarray, radius: np.ndarray, p: int):
        order = np.argsort(tag, kind="stable")
        self.pid, self.tag, self.tiles = pid[order], tag[order], Tiles(x[order], p, radius)
        self.names, first, self.of = np.unique(self.tag, return_index=True, return_inverse=True)
        self.limit = radius[order][first].copy()
        self.best: dict[int, tuple[float, int, int]] = {}

    def see(self, pid: np.ndarray, x: np.ndarray, tag: np.ndarray, _) -> None:
        order = np.argsort(tag, kind="stable")
        pid, x, tag = pid[order], x[order], tag[order]
        for at, to, rough, base, slack in self.tiles.over(x):
            mine, theirs, of = self.tag[at], tag[to], self.of[at]
            if mine[0] == theirs[0] and mine[-1] == theirs[-1] and mine[0] == mine[-1]:
                continue
            if len(np.intersect1d(mine, theirs)):
                rough[mine[:, None] == theirs[None, :]] = np.inf
            least = rough.min(axis=1)
            bound = np.minimum(self.tiles.bound(self.limit[of], base, slack), least + 2 * slack)
            most = np.full(len(self.names), np.inf)
            np.minimum.at(most, of, bound + base + 2 * slack)                # the closest of a component decides for all its askers
            i, j = self.tiles.reached(rough, np.minimum(bound, most[of] - base + 2 * slack))
            for lo in range(0, len(i), 65_536):
                ii, jj = i[lo:lo + 65_536] + at.start, j[lo:lo + 65_536] + to.start
                d = self.tiles.exact(ii, x[jj])
                low, high = np.minimum(self.pid[ii], pid[jj]), np.maximum(self.pid[ii], pid[jj])
                rank = np.lexsort((high, low, d, self.of[ii]))
                for r in rank[np.r_[True, np.diff(self.of[ii][rank]) != 0]]:
                    c, edge = int(self.of[ii[r]]), (float(d[r]), int(low[r]), int(high[r]))
                    if edge[0] <= self.limit[c] and (c not in self.best or edge < self.best[c]):
                        self.best[c], self.limit[c] = edge, edge[0]

    def rows(self) -> pa.RecordBatch:
        rows = [(int(self.names[c]), *e) for c, e in self.best.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["part", "d", "a", "b"])


def _arrays(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
    x = [np.asarray(b.column(3).flatten(), float).reshape(b.num_rows, -1) for b in batches]
    return [np.concatenate([np.asarray(b.column(2)) for b in batches]), np.concatenate(x), *(np.concatenate([np.asarray(b.column(c)) for b in batches]) for c in (4, 5))]


def _pass_by(batches: Iterable[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Rows ``task, kind, pid, x, tag, radius`` in order: ``make`` of a task's rows of kind 0 sees its rows of kind 1, batch by batch."""
    at, held, search = None, [], None
    for batch in batches:
        name, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        starts = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (kind[1:] != kind[:-1])])[:len(name)]
        for a, b in zip(starts, [*starts[1:], len(name)]):
            if name[a] != at:
                if search is not None:
                    yield search.rows()
                at, held, search = name[a], [], None
            if kind[a] == 0:
                held.append(batch.slice(a, b - a))
                continue
            if search is None and not held:
                continue
            if search is None:
                search, held = make(*_arrays(held)), []
            search.see(*_arrays([batch.slice(a, b - a)]))
    if search is not None:
        yield search.rows()


def stream(rows: DataFrame, partitions: int, make, schema: str) -> DataFrame:
    """What ``make(pid, x, tag, radius)`` of the rows ``task, kind, pid, x, tag, radius`` of kind 0 gives after it saw those of kind 1, task by task."""
    rows = rows.select("task", "kind", "pid", "x", "tag", "radius").repartition(partitions, "task").sortWithinPartitions("task", "kind")
    return core.checkpoint(rows.mapInArrow(functools.partial(_pass_by, make=make), schema))


class Axes:
    """Where points lie: their principal axes and the zones cut from a sample. Turned points only bound distances, which are taken unturned."""

    def __init__(self, sample: np.ndarray, p: int, zones: int):
        width = sample.shape[1]
        self.p, self.turn = p, np.eye(width)
        if p == 2 and len(sample) > 1 and width > 1:
            self.turn = np.linalg.eigh(np.cov(sample.T))[1][:, ::-1]
        self.nodes = _cuts(sample @ self.turn, zones)

    def zone(self, x: np.ndarray) -> np.ndarray:
        return _leaf_of(self.nodes, x @ self.turn)


class Bounds:
    """Boxes and balls of groups of turned points: names, corners, centres, radii."""

    def __init__(self, rows: pd.DataFrame, names: list[str], p: int):
        self.names = rows[names].to_numpy() if len(rows) else np.zeros((0, len(names)), np.int64)
        self.low, self.high, self.centre = (_stack(rows[c]) if len(rows) else np.zeros((0, 1)) for c in ("lo", "hi", "centre"))
        self.radius, self.p = rows["radius"].to_numpy(float), p

    def within(self, x: np.ndarray, radius: np.ndarray) -> Iterator[np.ndarray]:
        """For each turned point the groups that may hold a point within its radius."""
        slack = 1e-9 * (1 + (np.abs(self.centre).max() if self.centre.size else 0))
        for at, reach in zip(x, radius):
            box = _norm(np.maximum(0, np.maximum(self.low - at, at - self.high)), self.p)
            ball = _norm(self.centre - at, self.p) - self.radius
            yield np.flatnonzero(np.maximum(box, ball) <= reach + slack)

    def reached(self, x: np.ndarray, radius: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Which of the groups ``among`` may hold a point within the radius of any of the turned points."""
        slack, met = 1e-9 * (1 + (np.abs(self.centre).max() if self.centre.size else 0)), np.zeros(len(among), bool)
        for to, g in enumerate(among):
            for lo in range(0, len(x), 256):
                at, reach = x[lo:lo + 256], radius[lo:lo + 256] + slack
                near = np.flatnonzero(_norm(at - self.centre[g], self.p) - self.radius[g] <= reach)
                box = _norm(np.maximum(0, np.maximum(self.low[g] - at[near], at[near] - self.high[g])), self.p)
                if (box <= reach[near]).any():
                    met[to] = True
                    break
        return among[met]


def _bound(x: np.ndarray, p: int) -> dict:
    centre = x.mean(axis=0)
    return {"lo": [x.min(axis=0)], "hi": [x.max(axis=0)], "centre": [centre], "radius": [float(_norm(x - centre, p).max())]}


_BOUND = "lo array<double>, hi array<double>, centre array<double>, radius double"


def _placed(points: DataFrame, axes: Axes) -> DataFrame:
    """``pid, x, cnt, zone, leaf``: zones of more than ``LEAF_ROWS`` points are cut into leaves from samples of their own."""
    def zone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = axes.zone(_rows(batch.column(1))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], ["pid", "x", "cnt", "zone"])

    zoned = core.checkpoint(points.select("pid", "x", "cnt").mapInArrow(zone, "pid long, x array<double>, cnt long, zone long"))
    sizes = {r["zone"]: r["n"] for r in zoned.groupBy("zone").agg(F.count("*").alias("n")).collect()}      # a row per zone
    large = {z: -(-n // LEAF_ROWS) for z, n in sizes.items() if n > 2 * LEAF_ROWS}
    if not large:
        return zoned.withColumn("leaf", F.lit(0).cast("long"))

    # rows of a zone pass through one task after its sample, which makes the tree; only the sample is held
    share = core.rows_frame(points.sparkSession, [{"zone": z, "leaves": k, "share": min(1.0, 12.0 * k / sizes[z])} for z, k in large.items()], "zone long, leaves long, share double")
    own = zoned.join(F.broadcast(share), "zone")              # a row per zone
    draw = F.pmod(F.xxhash64("pid"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    kinds = own.where(draw).withColumn("kind", F.lit(0)).unionByName(own.withColumn("kind", F.lit(1)))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for batch in batches:
            number, kind, leaves = (np.asarray(batch.column(c)) for c in (3, 5, 4))
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1) @ axes.turn
            leaf, starts = np.zeros(len(x), np.int64), np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(starts, [*starts[1:], len(x)]):
                if number[a] != at:
                    at, held, tree = number[a], [], None
                if kind[a] == 0:
                    held.append(x[a:b])
                else:
                    if tree is None:
                        tree = _cuts(np.concatenate(held) if held else x[:0], int(leaves[a]))
                    leaf[a:b] = _leaf_of(tree, x[a:b])
            keep = pa.array(kind == 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in range(4)), pa.array(leaf).filter(keep)], ["pid", "x", "cnt", "zone", "leaf"])

    fine = (kinds.select("pid", "x", "cnt", "zone", "leaves", "kind").repartition("zone").sortWithinPartitions("zone", "kind")
            .mapInArrow(cut, "pid long, x array<double>, cnt long, zone long, leaf long"))
    rest = zoned.where(~F.col("zone").isin(*large)).withColumn("leaf", F.lit(0).cast("long"))
    return core.checkpoint(fine.unionByName(rest))


@dataclass
class Index:
    """Points dealt into zones and leaves, with the bounds of both."""

    axes: Axes
    placed: DataFrame          # pid, x, cnt, zone, leaf
    p: int
    n: int

    @classmethod
    def of(cls, points: DataFrame, p: int) -> Index:
        n = points.count()
        sample = points.select("x").sample(min(1.0, SAMPLE_ROWS / max(n, 1)), seed=7).limit(2 * SAMPLE_ROWS).toArrow()
        axes = Axes(_rows(sample.column("x").combine_chunks()), p, max(1, min(n // LEAF_ROWS, ZONES)))
        return cls(axes, _placed(points, axes), p, n)

    @property
    def single(self) -> bool:
        return len(self.axes.nodes) == 1 and self.n <= 2 * LEAF_ROWS

    @functools.cached_property
    def leaves(self) -> DataFrame:
        axes, p = self.axes, self.p

        def box(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"zone": pdf["zone"].iloc[:1], "leaf": pdf["leaf"].iloc[:1], **_bound(_stack(pdf["x"]) @ axes.turn, p)})

        return core.checkpoint(self.placed.groupBy("zone", "leaf").applyInPandas(box, f"zone long, leaf long, {_BOUND}"))

    @functools.cached_property
    def zones(self) -> Bounds:
        p = self.p

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            centre = _stack(pdf["centre"])
            middle = centre.mean(axis=0)
            return pd.DataFrame({"zone": pdf["zone"].iloc[:1], "leaf": len(pdf), "lo": [_stack(pdf["lo"]).min(axis=0)], "hi": [_stack(pdf["hi"]).max(axis=0)], "centre": [middle],
                                 "radius": [float((_norm(centre - middle, p) + pdf["radius"].to_numpy()).max())]})

        return Bounds(self.leaves.groupBy("zone").applyInPandas(whole, f"zone long, leaf long, {_BOUND}").toPandas(), ["zone", "leaf"], p)      # a row per zone

    def radii(self, k: int) -> DataFrame:
        """``pid, x, zone, radius``: a distance within which the point's own leaf holds its k nearest rows."""
        p = self.p

        def within(rows: pa.Table) -> pa.Table:
            x = np.asarray(rows.column("x").combine_chunks().flatten(), float).reshape(rows.num_rows, -1)
            return rows.select(["pid", "x", "zone"]).append_column("radius", pa.array(_radii(x, k, p)))

        return core.checkpoint(self.placed.groupBy("zone", "leaf").applyInArrow(within, "pid long, x array<double>, zone long, radius double"))

    def reach(self, asking: DataFrame) -> DataFrame:
        """``pid, zone, leaf, x``: the leaves within ``radius`` of each of ``pid, x, radius, home`` but for the one called ``home`` (``zone:leaf``)."""
        axes, p, zones = self.axes, self.p, self.zones

        # a point asks the zones in its reach, and there the leaves
        def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                    home = [h.split(":")[0] for h in batch.column(3).to_pylist()]
                    to = [[int(z) for z, size in zones.names[idx] if str(z) != h or size > 1] for h, idx in zip(home, zones.within(x @ axes.turn, np.asarray(batch.column(2))))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.list_(pa.int64()))], ["pid", "x", "radius", "home", "to"])

        asks = (asking.select("pid", "x", "radius", "home").mapInArrow(route, "pid long, x array<double>, radius double, home string, to array<long>")
                .select("pid", "home", "x", "radius", F.explode("to").alias("zone")))

        def choose(pdf: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
            inside = Bounds(here, ["leaf"], p)
            own = (pdf["zone"].astype(str) + ":").to_numpy()
            to = [[int(v) for v in inside.names[idx, 0] if f"{z}{v}" != h] for z, h, idx in zip(own, pdf["home"], inside.within(_stack(pdf["x"]) @ axes.turn, pdf["radius"].to_numpy()))]
            return pd.DataFrame({"pid": pdf["pid"], "x": pdf["x"], "zone": pdf["zone"], "leaf": to}).explode("leaf").dropna(subset=["leaf"]).astype({"leaf": "int64"})

        return core.checkpoint(_by_zone(asks, self.leaves, choose))

    def crowded(self, asking: DataFrame) -> bool:
        """Whether points of ``pid, x, radius`` reach so many zones that scanning blocks is less work than visits of each."""
        if self.n < SCAN_ROWS:
            return False
        some = asking.select("x", "radius").orderBy(F.xxhash64("pid")).limit(200).toPandas()
        if not len(some):
            return False
        reached = [len(idx) for idx in self.zones.within(_stack(some["x"]) @ self.axes.turn, some["radius"].to_numpy(float))]
        return float(np.mean(reached)) > SCAN_SHARE * len(self.zones.names)

    def scan(self, asking: DataFrame, points: DataFrame, make, schema: str, count_leaves: bool = False) -> DataFrame:
        """``make(pid, x, tag, radius)`` for each block of ``asking`` (``pid, zone, x, tag, radius``) sees the ``points`` (``pid, zone, x, tag``) of all zones within
        the radius of any of its askers, in ``SCAN_PARTS`` tasks or more; ``count_leaves`` gives the askers the number of leaves seen as their tag.

        A block holds askers of neighbouring zones. A task holds a block and one batch of points.
        """
        spark, axes, zones = asking.sparkSession, self.axes, self.zones
        sizes = {r["zone"]: r["n"] for r in asking.groupBy("zone").agg(F.count("*").alias("n")).collect()}      # a row per zone
        most, parts = min(SCAN_BLOCK, max(TILE, -(-sum(sizes.values()) // SCAN_BLOCKS))), max(SCAN_PARTS, -(-self.n // SCAN_PART))
        dealt, block, held = [], 0, 0
        for z in sorted(sizes):
            if held and held + sizes[z] > most:
                block, held = block + 1, 0
            pieces = -(-sizes[z] // most)
            dealt.append({"zone": z, "block": block, "pieces": pieces})
            block, held = block + pieces - 1, held + sizes[z] if pieces == 1 else most
        table = F.broadcast(spark.createDataFrame(pa.Table.from_pylist(dealt, _longs("zone", "block", "pieces"))))      # a row per zone
        own = core.checkpoint(asking.join(table, "zone").select("pid", "x", "tag", "radius", (F.col("block") + F.pmod(F.xxhash64("pid"), F.col("pieces"))).alias("block")))

        def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, np.ndarray] = {}
            for batch in batches:
                x, radius, of = _rows(batch.column(0)), np.asarray(batch.column(1), float), np.asarray(batch.column(2))
                for b in np.unique(of).tolist():
                    met = known.setdefault(b, np.zeros(len(zones.names), bool))
                    met[zones.reached(x[of == b] @ axes.turn, radius[of == b], np.flatnonzero(~met))] = True
            pairs = [(b, int(z)) for b, met in known.items() for z in zones.names[met, 0]]
            yield pa.RecordBatch.from_arrays([pa.array([k[n] for k in pairs], pa.int64()) for n in (0, 1)], ["block", "zone"])

        routes = core.checkpoint(own.select("x", "radius", "block").mapInArrow(route, "block long, zone long").distinct())
        if count_leaves:
            leaves = spark.createDataFrame(pa.table([zones.names[:, 0], zones.names[:, 1]], _longs("zone", "leaves")))
            own = own.drop("tag").join(routes.join(F.broadcast(leaves), "zone").groupBy("block").agg(F.sum("leaves").alias("tag")), "block")
        task = lambda part: (F.col("block") * parts + part).alias("task")
        askers = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).select(
            task(F.col("part")), F.lit(0).alias("kind"), "pid", "x", "tag", "radius")
        passing = points.join(routes, "zone").select(task(F.pmod(F.xxhash64("pid"), F.lit(parts))), F.lit(1).alias("kind"), "pid", "x", "tag", F.lit(0.0).alias("radius"))

        return stream(askers.unionByName(passing), 2 * parts * (block + 1), make, schema)

    def serve(self, asks: DataFrame, extra: DataFrame, columns: list[str], search, schema: str) -> DataFrame:
        """``search(askers, points)`` for each leaf that was asked; ``extra`` adds ``columns`` to the points by pid. A leaf with many askers is served
        by several tasks, each with its own copy of the leaf's points."""
        load = asks.groupBy("zone", "leaf").agg(F.count(F.lit(1)).alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / QUERY_ROWS))
        queries = core.attach(asks, load, ["zone", "leaf"]).withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("_parts"))).select(*asks.columns, "salt")
        points = core.attach(extra, load, ["zone", "leaf"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        points = points.select(F.col("zone").alias("of_zone"), F.col("leaf").alias("of_leaf"), F.col("salt").alias("of_salt"), F.col("pid").alias("of_pid"), F.col("x").alias("of_x"), *columns)
        empty = [part.split()[0] for part in schema.split(", ")]

        def visit(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({c: [] for c in empty}) if q.empty or s.empty else search(q, s)

        return queries.groupBy("zone", "leaf", "salt").cogroup(points.groupBy("of_zone", "of_leaf", "of_salt")).applyInPandas(visit, schema)


def neighbours(points: DataFrame, k: int, p: int = 2, index: Index | None = None) -> DataFrame:
    """Add ``near`` (the distinct points behind the k nearest rows, self included), ``kdist`` and ``visits`` (leaves searched); ``p``: 2 euclidean, 1 manhattan."""
    index = index or Index.of(points, p)
    item = "array<struct<dist:double,pid:long,cnt:long>>"
    named = lambda found: [[{"dist": d, "pid": i, "cnt": c} for d, i, c in f] for f in found]

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _nearest(*(_stack(pdf["x"]),) * 2, pdf["cnt"].to_numpy(), pdf["pid"].to_numpy(), k, p)
        return pd.DataFrame({"pid": pdf["pid"], "home": pdf["zone"].astype(str) + ":" + pdf["leaf"].astype(str), "x": pdf["x"], "found": named(found), "radius": [_kth(f, k) for f in found]})

    if index.n >= SCAN_ROWS:                                  # radii alone tell whether leaves are worth a visit
        near = index.radii(k)
        if index.crowded(near):
            asking = near.select("pid", "zone", "x", F.lit(0).cast("long").alias("tag"), "radius")
            seen = index.scan(asking, index.placed.select("pid", "zone", "x", F.col("cnt").alias("tag")), functools.partial(_NearestScan, k=k, p=p), f"pid long, found {item}, visits long", True)
            return _merged(points, seen.groupBy("pid").agg(F.flatten(F.collect_list("found")).alias("found"), F.max("visits").alias("visits")), k)
    first = index.placed.groupBy("zone", "leaf").applyInPandas(own, f"pid long, home string, x array<double>, found {item}, radius double")
    if index.single:                                          # one leaf: nothing to visit
        return _merged(points, first.select("pid", "found").withColumn("visits", F.lit(1).cast("long")), k)
    first = core.checkpoint(first)

    def visit(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pid": q["pid"], "found": named(_nearest(_stack(q["x"]), _stack(s["of_x"]), s["cnt"].to_numpy(), s["of_pid"].to_numpy(), k, p))})

    more = index.serve(index.reach(first), index.placed, ["cnt"], visit, f"pid long, found {item}")
    every = first.select("pid", "found").unionByName(more)
    # what a point found in each leaf it visited: k times that number of candidates
    merged = every.groupBy("pid").agg(F.flatten(F.collect_list("found")).alias("found"), F.count("*").alias("visits"))
    return _merged(points, merged, k)


#: Points up to which a spanning tree is grown point by point on arrays.
SMALL_TREE = 5_000


def spanning_tree(points: DataFrame, p: int = 2, k: int = 16) -> DataFrame:
    """``a, b, d``: the edges of the minimum spanning tree of distinct points ``pid, x`` (a < b; of equally long edges those with smaller pids).

    Borůvka's rounds. A component's shortest edge is known from its members' neighbour lists if it is shorter than the distance to which
    all of these lists reach. When it is not for half of the components, the others, all but the largest, search within the best distance
    known so far: a round leaves half of the components at most. Up to
    ``SMALL_TREE`` points the tree grows on arrays.
    """
    points = core.checkpoint(points.select("pid", "x").withColumn("cnt", F.lit(1).cast("long")))
    n = points.count()
    if n <= SMALL_TREE:
        rows = points.orderBy("pid").toPandas()
        edges = _grown_tree(rows["pid"].to_numpy(), _stack(rows["x"]) if n else np.zeros((0, 1)), p)
        return core.rows_frame(points.sparkSession, [{"a": a, "b": b, "d": d} for a, b, d in edges], "a long, b long, d double")
    index = Index.of(points, p)
    near = core.checkpoint(neighbours(points, k, p, index).select("pid", "near", "kdist"))
    lists = near.select(F.col("pid").alias("a"), F.explode("near").alias("n")).select("a", F.col("n.pid").alias("b"), F.col("n.dist").alias("d")).where("a <> b")
    reach = core.checkpoint(near.select("pid", "kdist"))
    part, tree = core.checkpoint(points.select("pid", F.col("pid").alias("part"))), None
    edge = F.struct("d", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    while True:
        of = lambda c: part.select(F.col("pid").alias(c), F.col("part").alias(f"p{c}"))
        # what joins a component with itself never counts again
        lists = core.checkpoint(lists.join(of("a"), "a").join(of("b"), "b").where("pa <> pb").select("a", "b", "d", "pa"))
        seen = lists.groupBy(F.col("pa").alias("part")).agg(F.min(edge).alias("e"))
        lists = lists.drop("pa")
        known = reach.join(part, "pid").groupBy("part").agg(F.min("kdist").alias("reach"), F.count("*").alias("size"))
        state = core.checkpoint(known.join(seen, "part", "left"))
        left = state.count()
        if left <= 1:
            return tree
        sure = state.where("e.d < reach").select("e.*")
        if 2 * sure.count() < left:
            sure = sure.unionByName(_outside(index, points, part, state, edge, p))
        new = core.checkpoint(sure.distinct())
        tree = new if tree is None else core.checkpoint(tree.unionByName(new))
        joined = new.join(of("a"), "a").join(of("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        roots = components(joined, state.select(F.col("part").alias("node")))
        part = core.checkpoint(part.join(roots.withColumnRenamed("node", "part"), "part").select("pid", F.col("root").alias("part")))


def _outside(index: Index, points: DataFrame, part: DataFrame, state: DataFrame, edge, p: int) -> DataFrame:
    """Shortest edges that leave the components whose lists do not tell, all but the largest, from a search within the best distance known.

    A component has the name of its smallest point.
    """
    state = core.checkpoint(state.join(points.select(F.col("pid").alias("part"), "x"), "part"))
    largest = state.orderBy(F.desc("size"), "part").first()["part"]
    heads = state.orderBy(F.desc("size"), "part").select("part", "x").limit(1_000).toPandas()       # a bound for components without any edge so far
    names, at = heads["part"].to_numpy(), _stack(heads["x"])

    @F.pandas_udf("double")
    def away(x: pd.Series, own: pd.Series) -> pd.Series:
        gaps = [np.where(names == o, np.inf, _norm(at - v, p)).min() for v, o in zip(_stack(x), own)] if len(x) else []
        return pd.Series(gaps, dtype="float64")

    radius = state.where((F.col("part") != largest) & ~F.coalesce(F.expr("e.d < reach"), F.lit(False))).select("part", F.least(F.coalesce("e.d", F.lit(math.inf)), away("x", "part")).alias("radius"))
    asking = core.checkpoint(points.select("pid", "x").join(part, "pid").join(radius, "part").select("pid", "x", "radius", F.lit("").alias("home"), "part"))
    if index.crowded(asking):
        zone = index.placed.select("pid", "zone")
        seen = index.scan(asking.join(zone, "pid").select("pid", "zone", "x", F.col("part").alias("tag"), "radius"),
                          index.placed.select("pid", "zone", "x").join(part.withColumnRenamed("part", "tag"), "pid"), functools.partial(_ClosestScan, p=p), "part long, d double, a long, b long")
        return seen.groupBy("part").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.*")
    asks = index.reach(asking).join(asking.select("pid", "part", "radius"), "pid")

    def search(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        x, own, pid = _stack(s["of_x"]), s["of_part"].to_numpy(), s["of_pid"].to_numpy()
        rows = {}
        for at, me, mine, most in zip(_stack(q["x"]), q["pid"], q["part"], q["radius"]):
            d = np.where(own == mine, np.inf, _norm(x - at, p))
            low = d.min()
            if low <= most:
                rows[mine] = min([(float(low), min(me, int(o)), max(me, int(o))) for o in pid[d == low]] + ([rows[mine]] if mine in rows else []))
        return pd.DataFrame([(k, *v) for k, v in rows.items()], columns=["part", "d", "a", "b"])

    placed = index.placed.join(part.withColumnRenamed("part", "of_part"), "pid")
    found = index.serve(asks, placed, ["of_part"], search, "part long, d double, a long, b long")
    return found.groupBy("part").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.*")


def _grown_tree(pid: np.ndarray, x: np.ndarray, p: int) -> list[tuple[int, int, float]]:
    """Prim's tree over points in order of pid."""
    n, out = len(pid), []
    if n < 2:
        return out
    best, of, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        d = _norm(x - x[at], p)
        low, high = np.minimum(np.arange(n), at), np.maximum(np.arange(n), at)
        old_low, old_high = np.minimum(np.arange(n), of), np.maximum(np.arange(n), of)
        closer = left & ((d < best) | (d == best) & ((low < old_low) | (low == old_low) & (high < old_high)))
        best[closer], of[closer] = d[closer], at
        open_ = np.flatnonzero(left)
        ties = open_[best[open_] == best[open_].min()]
        at = int(min(ties, key=lambda i: (min(i, of[i]), max(i, of[i]))))
        a, b = sorted((int(pid[at]), int(pid[of[at]])))
        out.append((a, b, float(best[at])))
    return out


def _by_zone(asks: DataFrame, leaves: DataFrame, choose) -> DataFrame:
    """``choose`` over blocks of askers of a zone with the bounds of the zone's leaves; the bounds travel once per block of askers."""
    load = asks.groupBy("zone").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("_parts"))
    salted = core.attach(asks, load, ["zone"]).withColumn("salt", F.pmod(F.xxhash64("pid"), F.col("_parts"))).select("pid", "home", "x", "radius", "zone", "salt")
    here = (core.attach(leaves, load, ["zone"]).withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
            .select(F.col("zone").alias("of_zone"), "of_salt", "leaf", "lo", "hi", "centre", "radius"))

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or own.empty:
            return pd.DataFrame({"pid": [], "x": [], "zone": [], "leaf": []})
        return choose(pdf, own)

    return salted.groupBy("zone", "salt").cogroup(here.groupBy("of_zone", "of_salt")).applyInPandas(run, "pid long, x array<double>, zone long, leaf long")


def _merged(points: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The k nearest rows among candidates ``pid, found, visits``; copies of a point are rows."""
    item = "array<struct<dist:double,pid:long,cnt:long>>"

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(1), batch.num_rows
            d, pid, cnt = (np.asarray(c) for c in lists.flatten().flatten())
            at = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
            order = np.lexsort((pid, d, at))
            at, d, pid, cnt = at[order], d[order], pid[order], cnt[order]
            total = np.cumsum(cnt)
            first = np.searchsorted(at, at)                       # where the row's candidates begin
            before = total - cnt - (total - cnt)[first]
            keep, last = before < k, (before < k) & (before + cnt >= k)
            kdist, has = np.zeros(n), np.zeros(n, bool)
            kdist[at[last]], has[at[last]] = d[last], True
            items = pa.StructArray.from_arrays([pa.array(d[keep]), pa.array(pid[keep]), pa.array(cnt[keep])], ["dist", "pid", "cnt"])
            ends = pa.array(np.searchsorted(at[keep], np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, items), pa.array(kdist, mask=~has), batch.column(2)], ["pid", "near", "kdist", "visits"])

    merged = found.select("pid", "found", "visits").mapInArrow(nearest, f"pid long, near {item}, kdist double, visits long")
    return points.join(merged, "pid")


def _join_up(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Smallest node of the component of every node in a short edge list."""
    up: dict[int, int] = {}

    def find(v: int) -> int:
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {v: find(v) for v in list(up)}


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, root`` (smallest node of the component) by alternating star contraction.

    Hub nodes are met by partial ``min`` aggregates; every round is pinned by a checkpoint.
    A graph of at most ``Limits.collect_rows / 4`` edges is joined up directly.
    """
    both = core.checkpoint(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if both.count() <= core.LIMITS.collect_rows // 4:
        pairs = _join_up([(r["u"], r["v"]) for r in both.collect()])
        roots = core.rows_frame(edges.sparkSession, [{"node": n, "root": r} for n, r in pairs.items()], "node long, root long")
        return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    while True:
        # large star: every larger neighbour points at the smallest neighbour
        sym = both.select("u", "v").unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = core.checkpoint(large)
        # small star: smaller neighbours point at the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(
            F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = core.checkpoint(small)
        same = small.count() == both.count() and small.exceptAll(both).isEmpty()
        both = small
        if same:
            break
    roots = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
