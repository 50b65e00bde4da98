"""Connected components of an edge list, with partial aggregates so that hubs never meet in one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statframe.llm.common import free, keep


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch as stars: every node points at the smallest node it reaches within the batch."""
    for batch in batches:
        u, v = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u):]
        root = np.arange(len(names))
        while True:
            before = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
            if (root == before).all():
                break
        far = root != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[root[far]])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of the component, for every node that has an edge ``u, v`` (longs).

    Alternating star contraction: every larger neighbour moves to the smallest one, then every smaller; each round is written down. It
    ends when every node points at one node that points nowhere. Loops, repeated and reversed edges change nothing; no edges give no rows.
    """
    e = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_forest, "u long, v long").distinct())
    while not _done(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        before, e = e, keep(large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                                                       .alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        free(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _done(e: DataFrame) -> bool:
    """Whether no node has two targets and no target points on: per node one row of marks."""
    marks = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return marks.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out > 0 and in > 0)").isEmpty()
