"""Merkle manifest of a table: leaves per row, a tree per group, one tree over the groups, a proof for every row.

Rows are put in order by a range partitioning and numbered from the partitions' summaries, so no window spans a group. Ranks are cut into
base-``fan`` digits. Within blocks of ``fan ** digits`` ranks the digit columns are grouped away one after the other, the lowest first; each
step nests the children's structs and hashes them. A block's root is a node of the next round; when every group has one node left, the
groups' roots are the nodes of one more tree. From the last round down, a transform over a block's nested structs writes the siblings of every
leaf and an explode emits them; only one row per block takes the path above it from the round before, leaves are never joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statframe.llm.common import keep, schema_with

#: Children of a node.
FAN = 16
#: Digits grouped away within a block: a block nests FAN ** DIGITS leaves at most, about 30 KB.
DIGITS = 2
#: Siblings of a node on one level: the digests left and right of it, in order, as hex text.
STEP = "array<struct<left: string, right: string>>"


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' count, ``:`` and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(parts: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields put together."""
    return F.sha2(F.concat(*[field(c) for c in parts]).cast("binary"), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that ``start`` leads to along ``proof``."""
    return F.aggregate(proof, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof in order, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``g``, the number of the group in ascending order (null first), and ``r``, the number within the group; both from 0.

    The driver holds two values and two counts for each partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    # kept, as the range bounds take a pass of their own; the row's place spreads equal rows over partitions
    rows = keep(rows.withColumn("__at", F.monotonically_increasing_id()))
    laid = (rows.repartitionByRange(group, *order, "__at").sortWithinPartitions(group, *order, "__at").drop("__at")
            .withColumn("__part", F.spark_partition_id()))
    schema = schema_with(laid, g="long", r="long")
    arrow = to_arrow_schema(schema)
    where = laid.columns.index(group)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, count, last = -1, 0, None                   # of the last row so far: number of its group here, rows of it, its value
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(where)
            before = pa.concat_arrays([pa.array([last], values.type), values.slice(0, len(values) - 1)])
            same = pc.or_(pc.fill_null(pc.equal(values, before), False), pc.and_(pc.is_null(values), pc.is_null(before)))
            new = ~same.to_numpy(zero_copy_only=False)
            new[0] |= run < 0
            g = run + np.cumsum(new)
            at = np.arange(len(g))
            first = np.maximum.accumulate(np.where(new, at, -count))     # where the row's group began, before this batch if negative
            r = at - first
            run, count, last = int(g[-1]), int(r[-1]) + 1, values[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g, pa.int64()), pa.array(r, pa.int64())], schema=arrow)

    local = keep(laid.mapInArrow(number, schema))
    ends = local.groupBy("__part").agg(F.min_by(F.struct(group), "g").alias("first"), F.max_by(F.struct(group), "g").alias("last"), F.max("g").alias("runs"),
                                       F.max(F.struct("g", "r")).alias("end")).collect()
    groups, carried, last, starts = -1, 0, None, []
    for e in sorted(ends, key=lambda e: e["__part"]):
        goes_on = groups >= 0 and e["first"][0] == last
        starts.append((e["__part"], groups + (not goes_on), carried if goes_on else 0))
        groups, carried, last = starts[-1][1] + e["runs"], e["end"]["r"] + 1 + (starts[-1][2] if e["runs"] == 0 else 0), e["last"][0]
    table = F.broadcast(local.sparkSession.createDataFrame(starts, "__part int, __g long, __r long"))      # one row per partition
    return local.join(table, "__part").select(*rows.drop("__at").columns, (F.col("g") + F.col("__g")).alias("g"),
                                              F.when(F.col("g") == 0, F.col("r") + F.col("__r")).otherwise(F.col("r")).alias("r"))


def _joined(nodes: Column) -> Column:
    """The digests of a run of nodes, put together."""
    return F.array_join(F.transform(nodes, lambda n: n["h"]), "")


def _around(nodes: Column, i: Column) -> Column:
    """The other nodes of the run: left and right of number ``i``. A lone node's level has no digests."""
    return F.struct(_joined(F.slice(nodes, F.lit(1), i)).alias("left"), _joined(F.slice(nodes, i + 2, F.size(nodes))).alias("right"))


def _nested(nodes: DataFrame, fan: int, digits: int) -> DataFrame:
    """``g, r, h, top``: blocks of nodes ``g, r, h, carried``, their number and root, and the structs nested under it.

    Where a group has one node left its digest goes up as it is: a lone child in the first run of the first block, as ranks have no gaps.
    """
    ranked = nodes.select("g", F.floor(F.col("r") / fan ** digits).cast("long").alias("block"),
                          *[F.floor(F.col("r") / fan ** k % fan).cast("int").alias(f"d{k}") for k in range(digits)], "h", "carried")
    now = ranked.repartition("g", "block")                 # the groupings below keep to this partitioning
    for k in range(digits):
        above = [f"d{j}" for j in range(k + 1, digits)]
        child = F.struct(F.col(f"d{k}").alias("d"), "h", F.col("carried" if k == 0 else "kids"))
        now = now.groupBy("g", "block", *above).agg(F.array_sort(F.collect_list(child)).alias("kids"))
        one = (F.size("kids") == 1) & (F.col("block") == 0)
        for d in above:
            one = one & (F.col(d) == 0)
        now = now.withColumn("h", F.when(one, F.col("kids")[0]["h"]).otherwise(F.sha2(_joined(F.col("kids")).cast("binary"), 256)))
    return now.select("g", F.col("block").alias("r"), "h", F.col("kids").alias("top"))


def _paths(top: Column, first: Column, over: Column, digits: int) -> Column:
    """Array of (carried, proof) for the nodes nested under ``top``; ``over`` is the path above the block, ``first``: it is its group's first."""
    def down(kids: Column, level: int, over: Column, one: Column) -> Column:
        one = one & (F.size(kids) == 1)

        def path(kid: Column, i: Column) -> Column:
            own = F.when(one, over).otherwise(F.concat(F.array(_around(kids, i)), over))
            if level:
                return down(kid["kids"], level - 1, own, one)
            return F.array(F.struct(kid["carried"].alias("carried"), own.alias("proof")))

        return F.flatten(F.transform(kids, path))

    return down(top, digits - 1, over, first)


def _climb(nodes: DataFrame, fan: int, digits: int) -> list[DataFrame]:
    """Rounds of blocks, each kept, until every group has one: nodes of the next round carry the number of their block."""
    rounds = [keep(_nested(nodes, fan, digits))]
    while (rounds[-1].agg(F.max("r")).first()[0] or 0) > 0:
        rounds.append(keep(_nested(rounds[-1].select("g", "r", "h", F.struct("r").alias("carried")), fan, digits)))
    return rounds


def _emit(rounds: list[DataFrame], above: DataFrame, digits: int) -> DataFrame:
    """``g, p, subroot, root``: (carried, proof) of every node of the first round; ``above`` has a path for every group."""
    for blocks in reversed(rounds):
        out = (blocks.select("g", "r", "top").join(above, ["g", "r"])
               .select("g", F.explode(_paths(F.col("top"), F.col("r") == 0, F.col("proof"), digits)).alias("p"), "subroot", "root"))
        above = out.select("g", F.col("p.carried")["r"].alias("r"), F.col("p.proof").alias("proof"), "subroot", "root") if blocks is not rounds[0] else None
    return out


def manifest(docs: DataFrame, id: str = "doc_id", group: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             carry: Sequence[str] = (), fan: int = FAN, digits: int = DIGITS) -> DataFrame:
    """``id, group, *carry, leaf, subroot, root, proof``: one row for each row of ``docs``, proofs in the form of ``STEP``.

    A leaf is the ``digest`` of ``fields``. Within a group leaves ascend by id (null first), rows that share an id by leaf; identical rows are
    leaves of their own. ``fan`` nodes in a row become the digest of their hex digests until one node is left; a lone last node of several gets
    a digest of its own, a group's only leaf is its subroot. Subroots ascend by group (null first, strings by their UTF-8 bytes) and make the
    root in the same way. Nulls in any column, empty and very long texts are fields like others. Other columns are ignored, whatever their
    names; ``carry`` names columns of orderable types that go along. No rows give no rows. One group may hold all rows.
    """
    rows = docs.select(F.col(id).alias("k"), F.col(group).alias("s"), digest([F.col(c) for c in fields]).alias("h"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    extra = [f"c{i}" for i in range(len(carry))]
    leaves = _numbered(rows, "s", ["k", "h", *extra]).select("g", "r", "h", F.struct("k", "s", F.col("h").alias("leaf"), *extra).alias("carried"))
    within = _climb(leaves, fan, digits)
    tops = within[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("r"), "h", F.struct("g", F.col("h").alias("subroot")).alias("carried"))
    over = _climb(tops, fan, digits)
    root = over[-1].select("g", "r", F.array().cast(STEP).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
    group_paths = keep(_emit(over, root, digits).select(F.col("p.carried.g").alias("g"), F.lit(0).cast("long").alias("r"), F.col("p.proof").alias("proof"),
                                                        F.col("p.carried.subroot").alias("subroot"), "root"))
    got = _emit(within, group_paths, digits)
    return got.select(F.col("p.carried.k").alias(id), F.col("p.carried.s").alias(group), *[F.col(f"p.carried.c{i}").alias(c) for i, c in enumerate(carry)],
                      F.col("p.carried.leaf").alias("leaf"), "subroot", "root", F.col("p.proof").alias("proof"))
