"""Exact top-k inner products by pivot-table elimination.

Vectors are packed into blocks with their distances to common pivots (the pivot table). For a query, |d(q, p) - d(x, p)| bounds the
distance from below for every pivot p; the largest of these bounds the inner product from above, as
2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2. Candidates are evaluated in the order of that bound until no bound reaches the k-th best score.
Pivots are chosen from a bounded sample; they never change the answer, only how soon the search stops.

Vectors lie in the order of their nearest and second nearest pivots and are cut into blocks there, so that the distances of a block's
vectors to each pivot form short intervals. A query takes a first k-th score from its own block. Only blocks whose intervals leave room for
that score get the query, all of them if need be; nothing else of a pair of blocks is shuffled. A block travels once for every ``PER_BLOCK``
queries that reach it, and k rows for each query leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statframe.llm.common import free, keep, slices

#: Pivots whose distances bound blocks; the first ``NEAR`` of them also go with every vector.
PIVOTS = 256
NEAR = 32
PIVOT_SAMPLE = 2048
BLOCK = 2048
#: Queries that meet a block in one task.
PER_BLOCK = 4096
#: Blocks whose intervals the tasks hold at once (2 KB each); more blocks mean more passes over the queries.
TABLE = 4_096
#: Rounding errors of a bound in floating point stay below this, relative to the squared lengths.
SLACK = 1e-9
#: Distances travel in single precision; a difference of two may be off by this share of their sum.
SINGLE = 2.0 ** -22
STEP = 256


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal: vectors of the sample that lie far from each other."""
    if not len(sample):
        return sample
    x = sample.astype(float)
    chosen = [int(np.argmax((x * x).sum(axis=1)))]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)) and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every row to every pivot; integers up to 2**53 are exact before the root."""
    xf, pf = x.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum(0, (xf * xf).sum(1)[:, None] + (pf * pf).sum(1)[None, :] - 2 * xf @ pf.T))


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        """``floor``: a score below which no candidate of the query matters."""
        self.k, self.score, self.id = k, [np.zeros(0, np.int64)] * queries, [np.zeros(0, np.int64)] * queries
        self.floor = np.full(queries, -np.inf) if floor is None else floor

    def least(self, q: int) -> float:
        return max(self.floor[q], self.score[q][-1]) if len(self.score[q]) >= self.k else self.floor[q]

    def rows(self, qid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(qid, [len(s) for s in self.score]), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.id, self.score))

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.id[q] = score[order], ids[order]


def search(best: Best, qid: np.ndarray, q: np.ndarray, qd: np.ndarray, xid: np.ndarray, x: np.ndarray, xd: np.ndarray) -> None:
    """Offer a block of candidates to a block of queries. ``qd`` and ``xd`` are the pivot tables."""
    xx, qq = (x.astype(float) ** 2).sum(axis=1), (q.astype(float) ** 2).sum(axis=1)
    for k in range(len(q)):
        bound = np.zeros(len(x)) if not xd.shape[1] else np.maximum(0, np.abs(xd - qd[k]) - SINGLE * (xd + qd[k])).max(axis=1)
        top = (qq[k] + xx - bound * bound) / 2 + SLACK * (qq[k] + xx + 1) + 0.5
        top[xid == qid[k]] = -np.inf
        least = best.least(k)
        alive = np.flatnonzero(top >= least) if np.isfinite(least) else np.flatnonzero(np.isfinite(top))
        alive = alive[np.argsort(-top[alive], kind="stable")]
        for a in range(0, len(alive), STEP):
            own = alive[a:a + STEP]
            if top[own[0]] < best.least(k):
                break
            score = x[own] @ q[k]
            good = score >= best.least(k)
            if good.any():
                best.add(k, score[good], xid[own][good])


def _pack(x: np.ndarray) -> bytes:
    """Integers in the fewest bytes that hold all of them, after one byte that says how many."""
    most = max(int(x.max()), -1 - int(x.min())) if x.size else 0
    size = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return bytes([size]) + x.astype(f"<i{size}").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def reachable(qq: np.ndarray, qd: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray, xx: np.ndarray) -> Iterator[np.ndarray]:
    """For each query the blocks that may hold a score of ``least``: intervals ``low``..``high`` of distances, longest squared length ``xx``."""
    for k in range(len(qq)):
        gap = np.maximum(low - qd[k], qd[k] - high) - SINGLE * (high + qd[k])
        bound = np.maximum(0, gap.max(axis=1)) if low.shape[1] else np.zeros(len(xx))
        yield np.flatnonzero((qq[k] + xx - bound * bound) / 2 + SLACK * (qq[k] + xx + 1) + 0.5 >= least[k])


def integer_vectors(df: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """``id``, ``v``: components floor(scale * x); rows without id, or with null, empty, null or non-finite components left out; copies collapse."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return (df.where(F.col(id).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
            .select(F.col(id).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))
            .distinct())


def top_k(df: DataFrame, queries: Callable[[Column], Column], id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256,
          pivots: int = PIVOTS, block: int = BLOCK, per_block: int = PER_BLOCK, table: int = TABLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id ``queries`` accepts, the ``k`` largest integer inner products.

    Candidates are all rows but those with the query's own id. Ties go to the smaller id; fewer candidates give fewer rows. Vectors that
    are null, empty or hold null or non-finite components take no part; rows that repeat id and vector count once, vectors of one id
    that differ are candidates of their own (an id then stands for its best). Vectors of other lengths than a query's are no candidates
    of it. An empty table gives no rows. Inner products that might pass 62 bits are an error, as are scaled components beyond 2**53.
    """
    spark = df.sparkSession
    ints = keep(integer_vectors(df, id, vector, scale).withColumn("n", F.size("v")).withColumn("q", F.coalesce(queries(F.col("id")), F.lit(False))))
    sizes = ints.groupBy("n").agg(F.count("*").alias("rows"), F.sum(F.col("q").cast("int")).alias("asked")).collect()
    out = None
    for s in sizes:
        if not s["asked"]:
            continue
        own = ints.where(F.col("n") == s["n"])
        some = own.orderBy(F.xxhash64("id", "v"), "id").limit(PIVOT_SAMPLE).select("v").collect()
        chosen = pick_pivots(np.array([r["v"] for r in some], np.int64), pivots)
        part = _search_blocks(own, s["n"], chosen, k, block, per_block, table)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # an id whose vectors differ stands for its best
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_BLOCK_ROW = "b long, ids binary, x binary, d binary, low binary, high binary, xx double, asked binary, least binary, query_id long, vec_id long, score long"


def _search_blocks(own: DataFrame, n: int, pivots: np.ndarray, k: int, block: int, per_block: int, table: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark, arrow = own.sparkSession, to_arrow_schema(_parse_datatype_string(_BLOCK_ROW))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The two nearest pivots and the distance to the first."""
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, n)
            d = distances(x, pivots)
            order = np.argsort(d, axis=1, kind="stable")
            one, two = order[:, 0], order[:, min(1, d.shape[1] - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), pa.array(d[np.arange(len(d)), one])],
                                             ["id", "v", "q", "one", "two", "near"])

    def row(**values) -> pa.RecordBatch:
        size = max(len(v) for v in values.values())
        return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(size, f.type) for f in arrow], schema=arrow)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows in order, each with its pivot table; its own queries are searched in it."""
        number = TaskContext.get().partitionId() << 40

        def made(ids, x, asked):
            nonlocal number
            xx = (x.astype(float) ** 2).sum(axis=1)
            if np.abs(x).max() > 2**53 or xx.max() >= 2.0**62:
                raise OverflowError("inner products of these vectors may not fit 64 bits")
            d = distances(x, pivots).astype(np.float32)
            best = Best(int(asked.sum()), k)
            near = d[:, :NEAR]
            search(best, ids[asked], x[asked], near[asked].astype(float), ids, x, near.astype(float))
            least = np.array([best.least(j) for j in range(len(best.score))], float)
            yield row(b=[number], ids=[_pack(ids)], x=[_pack(x)], d=[np.ascontiguousarray(near).tobytes()], low=[d.min(axis=0).tobytes()], high=[d.max(axis=0).tobytes()], xx=[xx.max()],
                      asked=[asked.tobytes()], least=[least.tobytes()])
            q, v, score = best.rows(ids[asked])
            if len(q):
                yield row(query_id=q, vec_id=v, score=score)
            number += 1

        held, cell = [], None                       # rows of the block so far, and their nearest pivot
        for batch in batches:
            ids, x = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten()).reshape(-1, n)
            asked, one = batch.column(2).to_numpy(zero_copy_only=False), np.asarray(batch.column(3))
            at = 0
            while at < len(ids):
                size = sum(len(h[0]) for h in held)
                if held and (one[at] != cell and size >= block // 4 or size >= block):      # small cells share a block
                    yield from made(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
                cell = one[at]
                run = at + int(np.argmax(np.r_[one[at:] != cell, True]))
                end = min(run, at + block - size)
                held.append((ids[at:end], x[at:end], asked[at:end]))
                at = end
        if held:
            yield from made(*map(np.concatenate, zip(*held)))

    placed = keep(own.select("id", "v", "q").mapInArrow(place, "id long, v array<long>, q boolean, one int, two int, near double"))
    order = ["one", "two", "near", F.xxhash64("id")]
    all_ = keep(placed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "v", "q", "one").mapInArrow(pack, _BLOCK_ROW))
    free(placed)
    blocks = all_.where("b is not null")
    passes = max(1, -(-blocks.count() // table))

    def asks(k_th: int) -> DataFrame:
        """``b, query_id, x, d, least``: the queries for each of some blocks."""
        got = blocks.where(F.pmod(F.xxhash64("b"), F.lit(passes)) == k_th).select("b", "low", "high", "xx").toArrow()      # at most about ``table`` rows
        sides = [np.frombuffer(b"".join(got[c].to_pylist()), np.float32).reshape(len(got), len(pivots)).astype(float) for c in ("low", "high")]
        sent = spark.sparkContext.broadcast((np.asarray(got["b"]), *sides, np.asarray(got["xx"])))

        def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, low, high, xx = sent.value
            for batch in batches:
                for own_b, ids, x, d, asked, least in zip(*(c.to_pylist() for c in batch.columns)):
                    asked = np.frombuffer(asked, bool)
                    ids, x = _unpack(ids)[asked], _unpack(x).reshape(-1, n)[asked]
                    d, least = np.frombuffer(d, np.float32).reshape(len(asked), -1)[asked], np.frombuffer(least)
                    qq = (x.astype(float) ** 2).sum(axis=1)
                    for j, to in enumerate(reachable(qq, distances(x, pivots), least, low, high, xx)):
                        to = names[to]
                        to = to[to != own_b]
                        if len(to):
                            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.full(len(to), ids[j])), pa.array([_pack(x[j])] * len(to), pa.binary()),
                                                              pa.array([d[j].tobytes()] * len(to), pa.binary()), pa.array(np.full(len(to), least[j]))],
                                                             ["b", "query_id", "x", "d", "floor"])

        return (blocks.where(F.length("least") > 0).select("b", "ids", "x", "d", "asked", "least")
                .mapInArrow(route, "b long, query_id long, x binary, d binary, floor double"))

    asked = asks(0)
    for k_th in range(1, passes):
        asked = asked.unionByName(asks(k_th))
    asked = keep(asked)
    load = asked.groupBy("b").agg(F.ceil(F.count("*") / per_block).alias("parts"))
    queries = asked.join(load.where("parts > 1"), "b", "left").select(
        "b", F.coalesce(F.pmod(F.xxhash64("query_id"), F.col("parts")), F.lit(0)).alias("part"), F.lit(0).alias("kind"), "query_id", "x", "d", "floor")
    served = blocks.select("b", "ids", "x", "d").join(load, "b").select(
        "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("query_id"),
        "x", "d", F.lit(None).cast("double").alias("floor"), "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's queries, then the block."""
        key, ask = None, []
        for batch in slices(batches, 256):
            for b, part, kind, qid, x, d, floor, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (b, part) != key:
                    key, ask = (b, part), []
                if kind == 0:
                    ask.append((qid, x, d, floor))
                elif ask:
                    qid, qx, qd, floors = zip(*ask)
                    ids, x = _unpack(ids), _unpack(x).reshape(-1, n)
                    best = Best(len(qid), k, np.array(floors))
                    search(best, np.array(qid), np.array([_unpack(q) for q in qx]), np.array([np.frombuffer(q, np.float32) for q in qd]).astype(float),
                           ids, x, np.frombuffer(d, np.float32).reshape(len(ids), -1).astype(float))
                    q, v, score = best.rows(np.array(qid))
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(score)], ["query_id", "vec_id", "score"])

    far = (queries.withColumn("ids", F.lit(None).cast("binary")).unionByName(served).repartition("b", "part").sortWithinPartitions("b", "part", "kind")
           .mapInArrow(run, "query_id long, vec_id long, score long"))
    return all_.where("b is null").select("query_id", "vec_id", "score").unionByName(far)
