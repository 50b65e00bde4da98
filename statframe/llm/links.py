"""Confirming candidate pairs of texts on their whole shingle sets, without a text for every pair.

A class of copies (column ``a``) is known by the row ``reps``: the id ``d`` of one of its documents, the number ``n`` of its shingles and further
columns with hashes of its set, as ``names`` gives them. Texts are read again where they are needed; what travels is the text, which packs well,
not its set. Components are a table ``node, root``; a class without links is its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statframe.llm import bits
from statframe.llm.common import free, keep, slices
from statframe.llm.graph import components
from statframe.llm.words import mix, shingle_sets

#: Hashed classes of shingles in a sketch. Two sets differ by at least the sum of the differences of their counts.
CLASSES = 256
#: Hashes of a set of shingles, in the order of the columns of ``reps`` after ``a, d, n``.
Names = Callable[[np.ndarray], tuple]


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether den * intersection >= num * union, for two sorted arrays without repeats."""
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if small * den < num * large:
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared * (num + den) >= num * (len(x) + len(y))


def need(a, b, num: int, den: int):
    """Shared shingles that link sets of a and b: the least c with den * c >= num * (a + b - c)."""
    return -(-num * (a + b) // (num + den))


def sketch_of(s: np.ndarray) -> bytes:
    """Shingles in each hashed class; counts beyond 255 are cut, which only weakens the bound."""
    return np.minimum(np.bincount((mix(s) >> np.uint64(56)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes()


def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether pairs of sketches (rows) leave room for enough shared shingles."""
    out = np.zeros(len(x), bool)
    for a in range(0, len(x), 1 << 14):
        part = slice(a, a + (1 << 14))
        apart = np.abs(x[part].astype(np.int16) - y[part]).sum(axis=1, dtype=np.int64)
        both = n[part].astype(np.int64) + m[part]
        out[part] = (both - apart) // 2 >= need(both, 0, num, den)
    return out


def stored(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def and_end(batches: Iterable) -> Iterator:
    yield from (b for b in batches if b.num_rows)
    yield None


def by_group(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Sorted rows as groups of equal leading columns; binary columns become rows of bytes, strings stay lists."""
    held: list[list] = []
    for batch in and_end(batches):
        if batch is not None:
            columns = [stored(c) if pa.types.is_binary(c.type) else np.asarray(c) for c in batch.columns]
            new = np.zeros(batch.num_rows, bool)
            for c in columns[:keys]:
                new[1:] |= c[1:] != c[:-1]
            new[0] = bool(held) and any(h[0] != c[0] for h, c in zip(held[-1][:keys], columns[:keys]))
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        else:
            columns, cuts = None, [0, 0]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            if held and (batch is None or k > 0):
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            if e > s:
                held.append([c[s:e] for c in columns])


def texts_of(slim: DataFrame, reps: DataFrame, wanted: DataFrame, size: int, names: Names, made: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """``t, n`` and the columns of ``wanted`` (``a`` first): the text of each class's document among ``slim`` (``d, t``), once per task that reads it.

    ``made`` gives ``t`` from the set instead of the text.
    """
    own = keep(reps.join(wanted, "a"))
    keys, more = reps.columns[3:], wanted.columns
    rows = bits.only(slim.where("d is not null"), "d", own.select("d")).join(own, "d").select("t", "n", *more, *keys)

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()                                # one number for each class of the task
        for batch in slices(batches, 1024):
            n, a, *hashes = (batch.column(k).to_pylist() for k in (1, 2, *range(2 + len(more), batch.num_columns)))
            ok, out = np.zeros(batch.num_rows, bool), []
            for row, s in shingle_sets(batch.column(0), size):
                if len(s) == n[row] and a[row] not in seen and names(s) == tuple(h[row] for h in hashes):
                    seen.add(a[row])
                    ok[row] = True
                    if made is not None:
                        out.append(made(s))
            kept = batch.select(range(2 + len(more))).filter(pa.array(ok))
            yield kept if made is None else pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *kept.columns[1:]], kept.schema.names)

    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("n", *more))
    return rows.mapInArrow(check, f"t {'string' if made is None else 'binary'}, {kinds}")


def _edges(a: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among these sets, in order of size: each is compared with others until it is linked with their component."""
    out, parts = [], []
    for i, s in enumerate(sets):
        mine, rest = [i], []
        for part in parts:
            for j in reversed(part):
                if len(sets[j]) * den < num * len(s):
                    j = None                                  # the others are smaller still
                    break
                if linked(s, sets[j], num, den):
                    out.append((int(a[i]), int(a[j])))
                    break
            else:
                j = None
            if j is None:
                rest.append(part)
            else:
                mine = part + mine if len(mine) == 1 else sorted(part + mine)
        parts = [*rest, mine]
    return out


def within(slim: DataFrame, reps: DataFrame, groups: DataFrame, size: int, num: int, den: int, block: int, names: Names) -> DataFrame:
    """Edges ``u, v`` among the members of blocks of each group (``node, root``)."""
    counts = groups.groupBy("root").agg(F.count("*").alias("count"))
    dealt = groups.join(counts, "root").select(F.col("node").alias("a"), "root", F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / block)).alias("block"))
    rows = texts_of(slim, reps, dealt, size, names).select("root", "block", "a", "n", "t").repartition("root", "block").sortWithinPartitions("root", "block", "n", "a")

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, a, _, t in by_group(slices(batches, 512), 2):
            first = np.r_[True, a[1:] != a[:-1]]
            edges = _edges(a[first], [s for _, s in shingle_sets(pa.array(t[first].tolist(), pa.string()), size)], num, den)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*edges)], ["u", "v"])

    return rows.mapInArrow(link, "u long, v long")


def rooted(df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the component of ``column``: a class without links is its own."""
    return df.join(roots.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that span two components ``x < y``."""
    both = rooted(rooted(pairs, roots, "a", "p"), roots, "b", "q").where("p <> q")
    return both.select(*pairs.columns, F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))


def confirmed(slim: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, num: int, den: int, names: Names) -> DataFrame:
    """Edges ``u, v`` of the pairs whose whole sets are linked."""
    either = pairs.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    texts = keep(texts_of(slim, reps, either, size, names).select("a", "t"))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            x, y = ([s for _, s in shingle_sets(batch.column(k), size)] for k in (2, 3))
            ok = pa.array([linked(p, q, num, den) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])

    both = pairs.join(texts.withColumnRenamed("t", "x"), "a").join(texts.select(F.col("a").alias("b"), F.col("t").alias("y")), "b")
    edges = keep(both.select("a", "b", "x", "y").mapInArrow(check, "u long, v long"))
    free(texts)
    return edges


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    return roots if edges.isEmpty() else components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(edges))
