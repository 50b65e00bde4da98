"""Shared distributed building blocks.

Every operator of the package is assembled from these:

* ``moments``      one pass of count/mean/variance/shape, grouped or not
* ``quantiles``    exact linear-interpolated quantiles: bracket, count, fetch the inside
* ``cumulate``     running totals over a total order, split over range partitions
* ``value_ranks``  average ranks of distinct values with their multiplicities
* ``positions``    1-based row numbers per series without a single-task window
* ``blocks``       bounded window partitions with overlapping rows at the seams
* ``gram``         centred cross products, solved on the driver (p x p numbers)

Nothing here collects raw rows.  What reaches the driver is bounded by the
number of columns, by ``Limits.collect_rows`` or by the partition count.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Limits:
    """Size checks that choose between a direct plan and a split plan."""

    small_rows: int = 500_000       # one window partition may hold this many rows
    map_rows: int = 250_000         # one group of an exact-percentile map may hold this many
    broadcast_rows: int = 1_000_000  # counted rows of a narrow table that may be broadcast
    sample_rows: int = 200_000      # rows that place quantile brackets
    sketch: int = 5_000             # percentile_approx accuracy on that sample
    bracket: float = 0.005          # half width of a bracket in probability
    collect_rows: int = 200_000     # most (value, count) rows a bracket may bring to the driver
    groups: int = 2_000             # groups whose brackets may be broadcast as one table
    block_rows: int = 250_000       # rows per window block of one long series
    agg_columns: int = 40           # columns per aggregate job
    product_sums: int = 300         # sums of products per aggregate job


LIMITS = Limits()


# --------------------------------------------------------------------- columns
def col_of(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def num(c: str | Column) -> Column:
    """Double with NaN read as NULL: the package-wide missing-value rule."""
    return F.nanvl(col_of(c).cast("double"), F.lit(None).cast("double"))


def not_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def div(a: Column, b: Column | float) -> Column:
    """Division that yields NULL instead of an ANSI error on a zero divisor."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.try_divide(a.cast("double"), b.cast("double"))


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType) and not f.metadata.get("nominal")]


def nominal_columns(df: DataFrame) -> list[str]:
    marked = [f.name for f in df.schema if f.metadata.get("nominal")]
    return marked or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def require(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")


def require_numeric(df: DataFrame, cols: Sequence[str]) -> None:
    require(df, cols)
    wrong = [c for c in cols if not is_numeric(df.schema[c].dataType)]
    if wrong:
        raise TypeError(f"columns are not numeric: {wrong}")


def as_list(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def chunks(items: Sequence, size: int) -> list[list]:
    return [list(items[i:i + size]) for i in range(0, len(items), size)]


def _plain(v):
    v = v.item() if isinstance(v, np.generic) else v
    return None if isinstance(v, float) and v != v else v


def rows_frame(spark, rows: list[dict], schema: str) -> DataFrame:
    """Result rows as a frame; NaN becomes NULL."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(_plain(r.get(n)) for n in names) for r in rows], schema)


# ------------------------------------------------------------------ checkpoint
def shared_folder(spark) -> str:
    """The folder all executors reach (``spark.checkpoint.dir``); a temporary one only in local mode, kept for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = f"file://{tempfile.mkdtemp(prefix='statframe-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark, ending: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}{ending}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a lookup table on NULL-safe keys.

    The table is pinned and counted first: up to ``Limits.broadcast_rows`` rows it
    is broadcast, beyond that Spark shuffles (and AQE splits hot keys).
    """
    keys = list(keys)
    pinned = checkpoint(table.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                                     *[c for c in table.columns if c not in keys]))
    side = F.broadcast(pinned) if pinned.count() <= LIMITS.broadcast_rows else pinned
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(side[f"_k_{k}"])
    return df.join(side, on, how).drop(*[f"_k_{k}" for k in keys])


# --------------------------------------------------------------------- moments
_MOMENT_FIELDS = ("n", "mean", "var", "skew", "kurt", "min", "max")


def _moment_aggs(c: str, i: int) -> list[Column]:
    x = num(c)
    return [
        F.count(x).alias(f"_{i}_n"),
        F.avg(x).alias(f"_{i}_mean"),
        not_nan(F.var_samp(x)).alias(f"_{i}_var"),
        not_nan(F.skewness(x)).alias(f"_{i}_skew"),
        not_nan(F.kurtosis(x)).alias(f"_{i}_kurt"),
        F.min(x).alias(f"_{i}_min"),
        F.max(x).alias(f"_{i}_max"),
    ]


def moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long table ``by…, variable, rows, n, mean, var, skew, kurt, min, max``.

    ``var`` is the sample variance, ``skew``/``kurt`` the population forms
    (excess kurtosis); ``rows`` counts all rows, ``n`` the non-missing ones.
    """
    by = list(by)
    if "variable" in by:
        raise ValueError("a key may not be called 'variable'")
    parts = []
    for chunk in chunks(list(cols), LIMITS.agg_columns):
        aggs = [a for i, c in enumerate(chunk) for a in _moment_aggs(c, i)]
        wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
        stacked = F.inline(F.array(*[
            F.struct(F.lit(c).alias("variable"), F.col("_rows").alias("rows"),
                     *[F.col(f"_{i}_{k}").alias(k) for k in _MOMENT_FIELDS])
            for i, c in enumerate(chunk)
        ]))
        parts.append(wide.select(*by, stacked))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def moments_dict(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    return {r["variable"]: r.asDict() for r in moments(df, cols).collect()}


def sample_skew(g1: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurt(g2: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


# ------------------------------------------------------- running totals, ranks
def cumulate(df: DataFrame, keys: Sequence[str], order: Sequence[str], amounts: Sequence[str],
             rows: int | None = None) -> DataFrame:
    """Add ``<amount>_before``: the total of earlier rows of the same key, in ``order``.

    Up to ``Limits.small_rows`` a plain window does it.  Above that the rows are
    range partitioned by (keys, order) and pinned by a checkpoint; each
    partition is summed on its own and shifted by the totals of the partitions
    before it, so no key, however large, meets a single task.
    """
    keys, order = list(keys), list(order)
    rows = df.count() if rows is None else rows
    earlier = (Window.unboundedPreceding, -1)
    zero = F.lit(0)
    if rows <= LIMITS.small_rows:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(*earlier)
        return df.select("*", *[
            F.coalesce(F.sum(a).over(w), zero).alias(f"{a}_before") for a in amounts])
    pinned = checkpoint(
        df.repartitionByRange(*[F.col(k) for k in keys], *[F.col(o) for o in order])
        .withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(*earlier)
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_pid").rowsBetween(*earlier)
    shift = pinned.groupBy("_pid", *keys).agg(*[F.sum(a).alias(f"_t_{a}") for a in amounts]).select(
        "_pid", *keys,
        *[F.coalesce(F.sum(f"_t_{a}").over(across), zero).alias(f"_s_{a}") for a in amounts])
    local = pinned.select("*", *[
        F.coalesce(F.sum(a).over(inside), zero).alias(f"_l_{a}") for a in amounts])
    on = F.lit(True)
    for k in ["_pid", *keys]:
        on = on & local[k].eqNullSafe(shift[k])
    joined = local.join(shift, on)
    return joined.select(
        *[local[c] for c in df.columns],
        *[(F.col(f"_l_{a}") + F.col(f"_s_{a}")).alias(f"{a}_before") for a in amounts])


def value_ranks(df: DataFrame, value: str | Column, keys: Sequence[str] = (),
                weights: dict[str, Column] | None = None, rows: int | None = None) -> DataFrame:
    """One row per (keys, distinct value): ``value, cnt, cnt_before, rank`` (+ summed weights).

    ``rank`` is the average rank of the tied block.  Equal values meet by a
    partial aggregate, so a value that fills a third of the table costs one row.
    """
    keys = list(keys)
    x = num(value)
    counts = (df.select(*keys, x.alias("value"), *[w.alias(f"_w_{n}") for n, w in (weights or {}).items()])
              .where(F.col("value").isNotNull())
              .groupBy(*keys, "value")
              .agg(F.count(F.lit(1)).alias("cnt"),
                   *[F.sum(f"_w_{n}").alias(n) for n in (weights or {})]))
    rows = df.count() if rows is None else rows
    ranked = cumulate(counts, keys, ["value"], ["cnt"], rows)
    return ranked.withColumn("rank", F.col("cnt_before") + (F.col("cnt") + 1) / 2)


def total_order(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> list[str]:
    """``order``, then every other sortable column: rows that still tie are equal, so their order changes nothing."""
    rest = [f.name for f in df.schema if f.name not in {*order, *keys} and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return [*order, *rest]


def previous(df: DataFrame, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add ``prev_<col>``: the value in the row before, over the whole table in ``order`` (ties by all other columns).

    Large tables are range partitioned and pinned; only the last row of every
    partition crosses to the next one.
    """
    order, cols = total_order(df, order), list(cols)
    if df.count() <= LIMITS.small_rows:
        w = Window.partitionBy(F.lit(0)).orderBy(*order)
        return df.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in cols])
    pinned = checkpoint(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    last = pinned.groupBy("_pid").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    border = Window.partitionBy(F.lit(0)).orderBy("_pid")
    edge = last.select(F.col("_pid").alias("_edge"), F.lag("_last").over(border).alias("_from"))
    w = Window.partitionBy("_pid").orderBy(*order)
    out = pinned.withColumn("_rn", F.row_number().over(w)).select(
        "*", *[F.lag(c).over(w).alias(f"_p_{c}") for c in cols])
    out = out.join(F.broadcast(edge), F.col("_pid") == F.col("_edge"), "left")
    return out.select(*df.columns, *[
        F.when(F.col("_rn") == 1, F.col("_from")[c]).otherwise(F.col(f"_p_{c}")).alias(f"prev_{c}") for c in cols])


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "_pos") -> DataFrame:
    """1-based position of each row inside its series, ties by all other columns."""
    by = list(by)
    order = total_order(df, order, by)
    n = df.count()
    if n <= LIMITS.small_rows:
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("long"))
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return (cumulate(one, by, order, ["_one"], n)
            .withColumn(out, F.col("_one_before") + 1).drop("_one", "_one_before"))


@dataclass
class Blocked:
    """A series table cut into window blocks; ``own`` marks the rows a block answers for."""

    df: DataFrame
    window: "Window"
    columns: list[str]

    def close(self, *extra: str) -> DataFrame:
        return self.df.where("_own").select(*self.columns, *extra)


def blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], before: int = 0, after: int = 0) -> Blocked:
    """Cut each series into blocks of ``Limits.block_rows`` rows.

    The last ``before`` rows of a block are repeated at the head of the next
    one and the first ``after`` rows at the tail of the previous one, so a
    row frame that reaches that far sees what it would see in the whole
    series.  ``_pos`` (1-based position) is added.
    """
    by, order = list(by), list(order)
    pos = df if "_pos" in df.columns else positions(df, by, order)
    size = max(LIMITS.block_rows, before + 1, after + 1)
    n = df.count()
    if n <= size:
        cut = pos.withColumn("_blk", F.lit(0).cast("long")).withColumn("_own", F.lit(True))
    else:
        home = F.floor((F.col("_pos") - 1) / size)
        offset = F.col("_pos") - 1 - home * size
        targets = [F.struct(home.alias("_blk"), F.lit(True).alias("_own"))]
        if before:
            targets.append(F.when(offset >= size - before,
                                  F.struct((home + 1).alias("_blk"), F.lit(False).alias("_own"))))
        if after:
            targets.append(F.when((offset < after) & (home > 0),
                                  F.struct((home - 1).alias("_blk"), F.lit(False).alias("_own"))))
        cut = pos.select("*", F.inline(F.array_compact(F.array(*targets))))
    w = Window.partitionBy(*by, "_blk").orderBy("_pos")
    return Blocked(cut, w, [c for c in pos.columns])


# ------------------------------------------------------------------- quantiles
def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              sizes: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns (linear interpolation), as driver numbers.

    Each probability needs one or two order statistics.  A bounded sample places
    a bracket around them; counting the rows below, at and above the bracket's
    ends tells whether an end is the answer, whether the bracket missed, or how
    many rows lie strictly inside.  A small inside is fetched as (value, count)
    rows, a large one is bracketed again.  The sample only places brackets, so
    the answer is exact; the column is never shuffled and no task sees more
    than counts.  ``sizes`` (non-missing rows per column) saves the first pass.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    if len(cols) > LIMITS.agg_columns:
        out = {}
        for part in chunks(cols, LIMITS.agg_columns):
            out.update(quantiles(df, part, probs, sizes))
        return out
    if not cols:
        return {}
    data = df.select(*[num(c).alias(f"_q{i}") for i, c in enumerate(cols)])
    if sizes is None:
        row = data.agg(*[F.count(f"_q{i}").alias(f"n{i}") for i in range(len(cols))]).first()
        sizes = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    most = max(sizes[c] for c in cols)
    delta = LIMITS.bracket
    edges = sorted({min(1.0, max(0.0, p + s * delta)) for p in probs for s in (-1, 1)})
    part = data.sample(LIMITS.sample_rows / most, seed=11) if most > LIMITS.sample_rows else data
    first = part.agg(*[F.percentile_approx(f"_q{i}", edges, LIMITS.sketch).alias(f"e{i}") for i in range(len(cols))]).first()
    targets, bracket = {}, {}
    for i, c in enumerate(cols):
        n = sizes[c]
        if not n:
            continue
        at = dict(zip(edges, first[f"e{i}"] or [None] * len(edges)))
        for j, p in enumerate(probs):
            h = p * (n - 1)
            k = int(np.floor(h))
            targets[i, j] = (k, min(k + 1, n - 1), h - k)
            lo, hi = at[min(1.0, max(0.0, p - delta))], at[min(1.0, max(0.0, p + delta))]
            lo = -np.inf if lo is None or p <= delta else lo
            hi = np.inf if hi is None or p >= 1 - delta else hi
            bracket[i, k] = bracket[i, min(k + 1, n - 1)] = (float(lo), float(hi))
    value = _order_statistics(data, bracket)
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for (i, j), (a, b, frac) in targets.items():
        va, vb = value[i, a], value[i, b]
        out[cols[i]][j] = float(va if frac == 0 else va + (vb - va) * frac)
    return out


def _order_statistics(data: DataFrame, bracket: dict) -> dict:
    """Resolve every (column, 0-based rank) inside its bracket; see ``quantiles``."""
    value: dict = {}
    rounds = 0
    while bracket:
        rounds += 1
        spans = {s: t for t, s in enumerate(dict.fromkeys((i, lo, hi) for (i, _), (lo, hi) in bracket.items()))}
        counted = data.agg(*[
            a for (i, lo, hi), t in spans.items() for a in (
                F.count_if(F.col(f"_q{i}") < lo).alias(f"a{t}"), F.count_if(F.col(f"_q{i}") <= lo).alias(f"b{t}"),
                F.count_if(F.col(f"_q{i}") < hi).alias(f"c{t}"), F.count_if(F.col(f"_q{i}") <= hi).alias(f"d{t}"))
        ]).first()
        fetch, narrow, following = {}, {}, {}
        for (i, r), (lo, hi) in bracket.items():
            t = spans[i, lo, hi]
            lt_lo, le_lo, lt_hi, le_hi = (counted[f"{k}{t}"] for k in "abcd")
            if r < lt_lo:
                following[i, r] = (-np.inf, lo)
            elif r < le_lo:
                value[i, r] = lo
            elif r >= le_hi:
                following[i, r] = (hi, np.inf)
            elif r >= lt_hi:
                value[i, r] = hi
            elif lt_hi - le_lo <= LIMITS.collect_rows:
                fetch[i, r] = (lo, hi, le_lo)
            else:
                narrow[i, r] = (lo, hi, (r - le_lo + 0.5) / (lt_hi - le_lo), lt_hi - le_lo)
        if fetch:
            value.update(_fetch_inside(data, fetch))
        if narrow:
            following.update(_narrow(data, narrow, 17 + len(value) + rounds))
        bracket = following
    return value


def _narrow(data: DataFrame, wide: dict, seed: int) -> dict:
    """Bracket again inside wide brackets, from a sample of bounded size.

    Ends are data values strictly inside the old bracket, so every round shrinks it.
    """
    keys, aggs = list(wide), []
    for t, (i, r) in enumerate(keys):
        lo, hi, p, inside = wide[i, r]
        x = F.col(f"_q{i}")
        taken = (x > lo) & (x < hi) & (F.col("_rand") < LIMITS.sample_rows / inside)
        aggs.append(F.percentile_approx(F.when(taken, x), [max(0.0, p - LIMITS.bracket), min(1.0, p + LIMITS.bracket)],
                                        LIMITS.sketch).alias(f"e{t}"))
    row = data.withColumn("_rand", F.rand(seed)).agg(*aggs).first()
    return {k: tuple(float(v) for v in (row[f"e{t}"] or wide[k][:2])) for t, k in enumerate(keys)}


def _fetch_inside(data: DataFrame, fetch: dict) -> dict:
    """Bring the distinct values strictly inside the brackets (bounded) and pick ranks."""
    spans = {s: t for t, s in enumerate(dict.fromkeys((i, lo, hi) for (i, _), (lo, hi, _b) in fetch.items()))}
    picks = [F.when((F.col(f"_q{i}") > lo) & (F.col(f"_q{i}") < hi),
                    F.struct(F.lit(t).alias("t"), F.col(f"_q{i}").alias("v")))
             for (i, lo, hi), t in spans.items()]
    rows = (data.select(F.inline(F.array_compact(F.array(*picks))))
            .groupBy("t", "v").agg(F.count(F.lit(1)).alias("c")).toPandas().sort_values(["t", "v"]))
    out = {}
    for (i, r), (lo, hi, le_lo) in fetch.items():
        inside = rows[rows["t"] == spans[i, lo, hi]]
        tops = le_lo + np.cumsum(inside["c"].to_numpy())
        out[i, r] = float(inside["v"].iloc[int(np.searchsorted(tops, r, side="right"))])
    return out


def group_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str]) -> DataFrame:
    """Exact quantiles per group: ``by…, variable, q`` (array in the order of ``probs``).

    * largest group small: Spark's ``percentile`` map is bounded and used directly;
    * few groups: each (group, column) is a column of its own for ``quantiles``,
      so nothing is shuffled however large a group is;
    * otherwise values are counted, ranked over range partitions and only the
      rows that hold the wanted positions are kept.
    """
    by, cols, probs = list(by), list(cols), list(probs)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    head = sizes.limit(LIMITS.groups + 1).collect()
    largest = max((r["_n"] for r in head), default=0)
    if len(head) > LIMITS.groups:
        largest = sizes.agg(F.max("_n")).first()[0]
    if largest <= LIMITS.map_rows:
        wide = df.groupBy(*by).agg(*[
            F.percentile(num(c), F.array(*[F.lit(float(p)) for p in probs])).alias(f"_{i}")
            for i, c in enumerate(cols)])
        return wide.select(*by, F.inline(F.array(*[
            F.struct(F.lit(c).alias("variable"), F.col(f"_{i}").alias("q")) for i, c in enumerate(cols)])))
    if len(head) <= LIMITS.groups and len(head) * len(cols) * len(probs) <= LIMITS.agg_columns:
        picks, names = [], {}
        for t, r in enumerate(head):
            here = F.lit(True)
            for k in by:
                here = here & F.col(k).eqNullSafe(F.lit(r[k]))
            for i, c in enumerate(cols):
                names[t, c] = f"_g{t}_{i}"
                picks.append(F.when(here, num(c)).alias(f"_g{t}_{i}"))
        found = quantiles(df.select(*picks), list(names.values()), probs)
        rows = [(*[r[k] for k in by], c, found[names[t, c]]) for t, r in enumerate(head) for c in cols]
        schema = T.StructType([df.schema[k] for k in by] + [
            T.StructField("variable", T.StringType()), T.StructField("q", T.ArrayType(T.DoubleType()))])
        for f in schema.fields:
            f.nullable = True
        return df.sparkSession.createDataFrame(rows, schema)
    long = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), num(c).alias("value")) for c in cols])))
    ranked = value_ranks(long, "value", [*by, "variable"])
    sizes = long.groupBy(*by, "variable").agg(F.count("value").alias("_n"))
    on = F.lit(True)
    for k in [*by, "variable"]:
        on = on & ranked[k].eqNullSafe(sizes[k])
    both = ranked.join(sizes, on).select(*[ranked[c] for c in ranked.columns], "_n")
    picks, first, last = [], F.col("cnt_before"), F.col("cnt_before") + F.col("cnt")
    for j, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_n") - 1)
        lo = F.floor(h)
        frac = h - lo
        hi = F.least(lo + 1, F.col("_n") - 1)
        share = (F.when((lo >= first) & (lo < last), 1 - frac).otherwise(0.0)
                 + F.when((hi >= first) & (hi < last), frac).otherwise(0.0))
        picks.append(F.sum(F.when(share > 0, share * F.col("value"))).alias(f"_{j}"))
    return both.groupBy(*by, "variable").agg(*picks).select(
        *by, "variable", F.array(*[F.col(f"_{j}") for j in range(len(probs))]).alias("q"))


# ------------------------------------------------------------------------ gram
@dataclass
class Gram:
    """Centred cross products of named columns; constant size whatever the row count."""

    names: list[str]
    n: int
    rows: int
    mean: np.ndarray
    cross: np.ndarray

    def index(self, names: Sequence[str]) -> list[int]:
        return [self.names.index(c) for c in names]

    def sub(self, rows: Sequence[str], cols: Sequence[str]) -> np.ndarray:
        return self.cross[np.ix_(self.index(rows), self.index(cols))]

    def cov(self, ddof: int = 1) -> np.ndarray:
        return self.cross / (self.n - ddof)

    def corr(self) -> np.ndarray:
        d = np.sqrt(np.diag(self.cross))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = self.cross / np.outer(d, d)
        return r


#: Partial matrices are merged by so many keys before they reach the driver.
GRAM_KEYS = 64
_GRAM_PART = "part int, rows long, n long, mean binary, cross binary"


class _Cross:
    """Mean and centred cross products of the rows so far; parts are merged pairwise, so no common centre is needed."""

    def __init__(self, p: int):
        self.rows = self.n = 0
        self.mean, self.cross = np.zeros(p), np.zeros((p, p))

    def merge(self, rows: int, n: int, mean: np.ndarray, cross: np.ndarray) -> None:
        self.rows += rows
        if n:
            apart, total = mean - self.mean, self.n + n
            self.cross += cross + np.outer(apart, apart) * (self.n * n / total)
            self.mean = self.mean + apart * (n / total)
            self.n = total

    def merge_row(self, rows: int, n: int, mean: bytes, cross: bytes) -> None:
        p, half = len(self.mean), np.frombuffer(cross)
        full = np.zeros((p, p))
        full[np.triu_indices(p)] = half
        full = full + full.T - np.diag(np.diag(full))
        self.merge(rows, n, np.frombuffer(mean), full)

    def row(self, part: int) -> pa.RecordBatch:
        upper = self.cross[np.triu_indices(len(self.mean))]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([self.rows]), pa.array([self.n]), pa.array([self.mean.tobytes()], pa.binary()),
                                           pa.array([upper.tobytes()], pa.binary())], ["part", "rows", "n", "mean", "cross"])


def gram(df: DataFrame, columns: dict[str, Column] | Sequence[str]) -> Gram:
    """Means and centred products over the rows complete in all columns, in one scan however many columns.

    Each task multiplies its rows batch by batch and gives one half matrix; the halves are merged by ``GRAM_KEYS`` keys, and the driver gets
    one for each key.
    """
    exprs = columns if isinstance(columns, dict) else {c: num(c) for c in columns}
    names, p = list(exprs), len(exprs)
    raw = df.select(*[exprs[c].cast("double").alias(f"_g{i}") for i, c in enumerate(names)])

    def multiply(batches):
        total = _Cross(p)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns])
                holes = [c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns if c.null_count]
                x = x[np.logical_and.reduce(holes)] if holes else x
                # from the first row on, so that a constant column has no spread at all
                mean = x[0] + (x - x[0]).mean(axis=0) if len(x) else np.zeros(p)
                x = x - mean
                total.merge(part.num_rows, len(x), mean, x.T @ x)
        if total.rows:
            yield total.row(TaskContext.get().partitionId())

    def merge(batches):
        key, total = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k].as_py() for c in batch.columns]
                if row[-1] != key:
                    if total is not None:
                        yield total.row(key)
                    key, total = row[-1], _Cross(p)
                total.merge_row(*row[1:5])
        if total is not None:
            yield total.row(key)

    parts = raw.mapInArrow(multiply, _GRAM_PART).withColumn("key", F.pmod("part", F.lit(GRAM_KEYS)))
    merged = parts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(merge, _GRAM_PART).toArrow()      # a row per key
    total = _Cross(p)
    for row in sorted(merged.to_pylist(), key=lambda r: r["part"]):
        total.merge_row(row["rows"], row["n"], row["mean"], row["cross"])
    if not total.n:
        return Gram(names, 0, total.rows, np.full(p, np.nan), np.full((p, p), np.nan))
    return Gram(names, total.n, total.rows, total.mean, total.cross)


def sum_vectors(df: DataFrame, fn, size: int) -> np.ndarray:
    """The sum over Arrow batches of ``fn(batch)``, a vector of ``size`` numbers: one per task, cut into up to ``GRAM_KEYS`` slices that are added up
    on Spark in the order of the tasks; the driver gets one vector, whatever the number of tasks."""
    slices = max(1, min(GRAM_KEYS, size // 4_096))
    ends = [size * i // slices for i in range(slices + 1)]

    def row(key: int, part: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["key", "part", "v"])

    def add(batches):
        total, seen = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total += fn(batch)
                seen = True
        if seen:
            for key, (a, b) in enumerate(zip(ends, ends[1:])):
                yield row(key, TaskContext.get().partitionId(), total[a:b])

    def merge(batches):
        at, total = None, None
        for batch in batches:
            for key, v in zip(batch.column(0).to_pylist(), batch.column(2)):
                if key != at:
                    if at is not None:
                        yield row(at, 0, total)
                    at, total = key, np.zeros(ends[key + 1] - ends[key])
                total += np.frombuffer(v.as_py())
        if at is not None:
            yield row(at, 0, total)

    schema = "key int, part int, v binary"
    merged = df.mapInArrow(add, schema).repartition("key").sortWithinPartitions("key", "part").mapInArrow(merge, schema).toArrow().to_pylist()
    return np.concatenate([np.frombuffer(r["v"]) for r in sorted(merged, key=lambda r: r["key"])]) if merged else np.zeros(size)


def inverse(a: np.ndarray) -> np.ndarray:
    """Symmetric inverse, falling back to the pseudo-inverse for collinear designs."""
    try:
        d = np.sqrt(np.diag(a))
        if np.any(d == 0) or np.linalg.cond(a / np.outer(d, d)) > 1e14:
            raise np.linalg.LinAlgError
        return np.linalg.inv(a / np.outer(d, d)) / np.outer(d, d)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a, hermitian=True)


def vif_from_corr(r: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse correlation matrix; infinite for exact collinearity."""
    p = r.shape[0]
    if p == 1:
        return np.ones(1)
    out = np.empty(p)
    for j in range(p):
        if not np.isfinite(r[j, j]):
            out[j] = np.nan
            continue
        keep = [k for k in range(p) if k != j and np.isfinite(r[k, k])]
        if not keep:
            out[j] = 1.0
            continue
        r2 = float(r[j, keep] @ np.linalg.pinv(r[np.ix_(keep, keep)], rcond=1e-13, hermitian=True) @ r[keep, j])
        out[j] = np.inf if r2 >= 1 - 1e-12 else 1.0 / (1.0 - r2)
    return out
