"""Exact Jaccard join of documents on word shingles: a size-aware heavy-light join.

Two sets of a and b shingles are linked when they share at least c(a, b) of them. Sets up to a boundary are light: they enumerate their
subsets of c(a, b) shingles for every partner size b, and sets that meet in a subset are linked without further checks. Larger sets are
heavy: they enter inverted lists under the few shingles that a partner cannot miss (rarest first), the lists are scanned, and candidate
pairs that pass the size and position bounds, and an upper bound from counts of hashed shingles, are verified on the whole sets. The
boundary has the least total cost for the sizes found.

Copies are one set. Groups of near copies are not expanded into all pairs: lists are first scanned for pairs of neighbours; components
are formed; after that only pairs of sets that are still in different components are tried, all of them. A list of any length is dealt
into blocks, and pairs of blocks are separate groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statframe.llm.common import free, keep
from statframe.llm.graph import components
from statframe.llm.links import and_end, apart, confirmed, may_link, merged, need, sketch_of, stored, texts_of, within
from statframe.llm.words import mix, shingle_sets

#: Shingles are counted in so many hashed buckets; the counts only order them (any order gives the same links).
BUCKET_BITS = 18
#: Shuffled rows that a posting costs: itself, its scan and its share of the candidates to verify.
SCAN = 9
#: Sets larger than this are never light.
LIGHT_MOST = 24
#: Classes of copies with at least 1/HOT of all documents (so at most HOT of them) enter lists only once.
HOT = 4096
#: Rows of a list that are compared with others in one task, and texts of a group that are compared in one task.
BLOCK = 512
GROUP = 256
#: A sorted list of at least so many postings is scanned in pieces; its head goes along, so the pieces give what the whole list gives.
PIECE = 1 << 16
_ROW = "kind int, token long, a long, n int, pos int, b long, m int"


def _fits(a, b, num: int, den: int):
    return np.minimum(a, b) * den >= num * np.maximum(a, b)


def _prefix(n: int, num: int, den: int) -> int:
    """Leading shingles of a set of n, one of which every partner shares."""
    return n - -(-num * n // den) + 1


def _partners(n: int, num: int, den: int) -> range:
    return range(-(-num * n // den), den * n // num + 1)


def subsets(n: int, num: int, den: int) -> int:
    """Subsets that a light set of n enumerates."""
    return sum(comb(n, need(n, b, num, den)) for b in _partners(n, num, den) if need(n, b, num, den) <= n)


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """Largest light size: the one with the least total cost over the number of sets of each size."""
    def cost(x: int) -> int:
        total = 0
        for n, count in sizes.items():
            if n <= x:
                total += count * subsets(n, num, den)
            if n > x or n * den >= num * (x + 1):       # light sets near the boundary have heavy partners
                total += count * SCAN * _prefix(n, num, den)
        return total

    return min(range(LIGHT_MOST + 1), key=lambda x: (cost(x), x))


def _signature(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _batch(**columns) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values() if v is not None)
    kinds = {"kind": pa.int32(), "token": pa.int64(), "a": pa.int64(), "n": pa.int32(), "pos": pa.int32(), "b": pa.int64(), "m": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if columns.get(c) is None else pa.array(np.asarray(columns[c]), t) for c, t in kinds.items()], list(kinds))


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4, num: int = 85, den: int = 100,
                       block: int = BLOCK, light_most: int | None = None, piece: int = PIECE, rows: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents are linked when den * intersection >= num * union.

    Sets are distinct shingles of ``size`` words (runs of anything but ASCII white space, A-Z in lower case); fewer words are one shingle;
    null and empty texts have none and are linked with nothing (their component is themselves). Rows with a null id take no part and have
    a null component. Rows that repeat an id are texts of their own; each has the smallest id its text reaches. Ids are integers. Texts
    are told apart by a 64-bit hash of their set and its size, shingles by 64 bits. ``light_most`` fixes the boundary instead of the cost.

    ``rows`` adds ``digest``, a 64-bit hash of the text, and ``first``: whether the row has the smallest (id, digest) of its component (null
    for rows that take no part). Components of rows that repeat an id can share a ``component_id``; ``first`` tells them apart.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id).cast("long").alias("d"), F.col(text).alias("t"))
    digested = slim.withColumn("digest", F.xxhash64("t")) if rows else slim.withColumn("digest", F.lit(0).cast("long"))

    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            n, sig = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for row, s in shingle_sets(batch.column(1), size):
                n[row], sig[row] = len(s), _signature(s)
                counts += np.bincount((s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts)) if len(s) > len(counts) else 0
                if len(s) <= len(counts):
                    np.add.at(counts, (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), pa.array(n), pa.array(sig), batch.column(2)],
                                             ["kind", "d", "n", "sig", "digest"])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), np.int32)), pa.array(used), pa.array(np.zeros(len(used), np.int32)), pa.array(counts[used]),
                                          pa.array(np.zeros(len(used), np.int64))], ["kind", "d", "n", "sig", "digest"])

    profiled = keep(digested.mapInArrow(profile, "kind int, d long, n int, sig long, digest long"))
    members = profiled.where("kind = 0").select("d", "n", "sig", "digest")
    buckets = profiled.where("kind = 1").groupBy("d").agg(F.sum("sig").alias("c")).toPandas()     # at most 2**BUCKET_BITS rows
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[buckets["d"].to_numpy(int)] = buckets["c"].to_numpy(int)
    total = max(1, members.count())
    classes = keep(members.where("n > 0 and d is not null").groupBy("sig", "n").agg(F.min(F.struct("d", "digest")).alias("own"), F.count("*").alias("copies"))
                   .select("sig", "n", "own", F.col("own.d").alias("rep"), "copies"))
    small = {r["n"]: r["k"] for r in classes.where(F.col("n") <= 2 * LIGHT_MOST).groupBy("n").agg(F.count("*").alias("k")).collect()}
    light = boundary(small, num, den) if light_most is None else light_most
    hot = {(r["sig"], r["n"]): r["rep"] for r in classes.where((F.col("copies") >= max(2, -(-total // HOT)))).select("sig", "n", "rep").collect()}
    sent = spark.sparkContext.broadcast((counts, hot))

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, hot = sent.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            tokens, sigs, ns, places = [], [], [], []

            def put(token: np.ndarray, sig: int, n: int, pos: np.ndarray) -> None:
                tokens.append(token), places.append(pos)
                sigs.append(np.full(len(token), sig, np.int64)), ns.append(np.full(len(token), n, np.int32))

            for row, s in shingle_sets(batch.column(1), size):
                n = len(s)
                if not n or ids[row] is None:
                    continue
                sig = _signature(s)
                if hot and hot.get((sig, n), ids[row]) != ids[row]:
                    continue
                if n <= light:
                    for b in _partners(n, num, den):
                        lo, hi, c = min(n, b), max(n, b), need(n, b, num, den)
                        if c <= lo and hi <= light:
                            sums = np.array([sum(x) % 2**64 for x in combinations(mix(s).tolist(), c)], np.uint64)
                            put(mix(sums + np.uint64((lo << 20) + (hi << 8) + 3)).view(np.int64), sig, n, np.full(len(sums), -1 if lo == hi else -2 if n == lo else -3, np.int32))
                if n > light or n * den >= num * (light + 1):
                    k = _prefix(n, num, den)
                    rare = counts[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    # a stable order by (count, hash): s is sorted by hash
                    put(s[np.argsort(rare, kind="stable")[:k]].view(np.int64), sig, n, np.arange(k, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, sigs, ns, places)], ["token", "a", "n", "pos"])

    def good(n, p, m, q):
        """Size bound, and the position bound: what can be shared from the first common shingle on."""
        return _fits(n, m, num, den) & (np.minimum(n - p, m - q) >= need(n, m, num, den))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted lists: edges from subsets (kind 2), neighbours as candidates (kind 0), postings that have any candidate (kind 1)."""
        held = head = None                                        # head: first and last row of a list that was cut
        for batch in _arrays_and_end(batches):
            more = False
            if batch is None:
                now, held = held, None
            else:
                now = batch if held is None else tuple(np.concatenate(x) for x in zip(held, batch))
                at = int(np.searchsorted(now[0], now[0][-1]))     # the last list may go on in the next batch
                more = len(now[0]) - at >= piece
                at = len(now[0]) if more else at
                held, now = tuple(x[at:] for x in now), tuple(x[:at] for x in now)
            if now is None or not len(now[0]):
                continue
            old = 0 if head is None or head[0][0] != now[0][0] else len(head[0])
            if old:
                now = tuple(np.concatenate(x) for x in zip(head, now))
            yield from _scan(now, old, more)
            ends = [int(np.searchsorted(now[0], now[0][-1])), -1]
            head = tuple(x[ends] for x in now) if more else None

    def _scan(now, old: int, more: bool) -> Iterator[pa.RecordBatch]:
        """Whole lists, but the first goes on from its ``old`` leading rows, which an earlier call had, and the last may go on (``more``)."""
        token, a, n, pos = now
        first = np.r_[True, (token[1:] != token[:-1]) | (a[1:] != a[:-1]) | (n[1:] != n[:-1])]
        fresh = (np.arange(len(token)) >= old)[first]
        token, a, n, pos = (x[first] for x in now)
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        length = np.diff(np.r_[start, len(token)])
        cut = np.zeros(len(start), bool)
        cut[0], cut[-1] = cut[0] or old > 0, cut[-1] or more
        shared = np.zeros(len(token), bool)
        shared[np.repeat(cut, length) & (pos >= 0)] = True
        long = length > 1
        start, length, cut = start[long], length[long], cut[long]
        for k in np.flatnonzero(pos[start] < 0):
            own = slice(start[k], start[k] + length[k])
            x, size = a[own], n[own]
            # smaller sets (-2) come first and, sharing what links them to a larger one, are linked among themselves; larger ones (-3) are not
            if pos[start[k]] == -1 or pos[start[k]] == -2 and (cut[k] or size[0] != size[-1]):
                yield _batch(kind=np.full(len(x) - 1, 2), a=x[1:], b=np.full(len(x) - 1, x[0]))
        start, length = start[pos[start] >= 0], length[pos[start] >= 0]
        two = start[length == 2]
        ok = good(n[two], pos[two], n[two + 1], pos[two + 1])
        shared[two[ok]] = shared[two[ok] + 1] = True
        for s, size in zip(start[length > 2], length[length > 2]):
            own = slice(s, s + size)
            if size > BLOCK:
                shared[own] = True
            else:
                fits = good(n[own][:, None], pos[own][:, None], n[own][None, :], pos[own][None, :])
                np.fill_diagonal(fits, False)
                shared[own] = fits.any(axis=1)
        keep_ = np.flatnonzero(shared & fresh)
        if len(keep_):
            yield _batch(kind=np.ones(len(keep_)), token=token[keep_], a=a[keep_], n=n[keep_], pos=pos[keep_])
        keep_ = np.flatnonzero(shared)
        if not len(keep_):
            return
        i, j = keep_[:-1], keep_[1:]
        near = (token[i] == token[j]) & good(n[i], pos[i], n[j], pos[j])
        if near.any():
            yield _pairs(a, n, i[near], j[near])

    found = keep(slim.mapInArrow(post, "token long, a long, n int, pos int").repartition("token").sortWithinPartitions("token", "n", "a").mapInArrow(scan, _ROW))
    postings = found.where("kind = 1").select("token", "a", "n", "pos")
    edges = found.where("kind = 2").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    reps = classes.select(F.col("sig").alias("a"), F.col("rep").alias("d"), "n", "sig")
    sketches = _sketches(slim, reps, postings.select("a").distinct(), size)
    near = keep(_near(found.where("kind = 0").select("a", "b").distinct(), sketches, num, den))
    # groups of pairs that may be linked, each text read once; then one pair for each two components that such a pair spans
    groups = components(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    roots = components(edges.unionByName(within(slim, reps, groups, size, num, den, GROUP, _names)))
    roots = merged(roots, confirmed(slim, reps, keep(_one_each(apart(near, roots))), size, num, den, _names))
    free(near)

    def hopeful(i, j, n, pos, sketch):
        ok = good(n[i], pos[i], n[j], pos[j])
        i, j = i[ok], j[ok]
        ok = may_link(sketch[i], sketch[j], n[i], n[j], num, den) if len(i) else np.zeros(0, bool)
        return i[ok], j[ok]

    # sets that are still apart: a few neighbours of each in a random order of every list, then all pairs
    def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for now in _arrays(batches):
            now = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
            token, a, n, pos, root, sketch = now
            for step in (1, 2, 3, 4):
                i = np.arange(max(0, len(token) - step))
                j = i + step
                near = (token[i] == token[j]) & (root[i] != root[j])
                i, j = hopeful(i[near], j[near], n, pos, sketch)
                if len(i):
                    yield _pairs(a, n, i, j)
            held = tuple(x[-4:] for x in now)

    def every(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for now in _arrays_and_end(batches):
            if now is None:
                now, held = held, None
                if now is None:
                    return
            else:
                now = now if held is None else tuple(np.concatenate(x) for x in zip(held, now))
                last = np.flatnonzero(np.r_[True, _differs(now)])[-1]
                held, now = tuple(x[last:] for x in now), tuple(x[:last] for x in now)
            starts = np.flatnonzero(np.r_[True, _differs(now)]) if len(now[0]) else []
            for s, e in zip(starts, [*starts[1:], len(now[0])]):
                token, x, y, a, n, pos, root, own, sketch = (v[s:e] for v in now)
                i, j = np.triu_indices(e - s, 1)
                ok = (root[i] != root[j]) & ((x[0] == y[0]) | (own[i] != own[j]))
                i, j = hopeful(i[ok], j[ok], n, pos, sketch)
                if len(i):
                    yield _pairs(a, n, i, j)

    for last in (False, True):
        labelled = postings.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
        lists = labelled.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("length")).where("lo <> hi")
        open_ = labelled.join(lists.select("token", "length"), "token").join(sketches.select("a", "sketch").hint("merge"), "a")
        if last:
            dealt = (open_.withColumn("blocks", F.ceil(F.col("length") / block)).withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")))
                     .select("token", "a", "n", "pos", "root", "own", "sketch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
                     .select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "a", "n", "pos", "root", "own", "sketch"))
            tried = dealt.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(every, _ROW)
        else:
            tried = (open_.select("token", "a", "n", "pos", "root", "sketch", F.xxhash64("a", "token").alias("h")).repartition("token")
                     .sortWithinPartitions("token", "h", "a").select("token", "a", "n", "pos", "root", "sketch").mapInArrow(some, _ROW))
        tried = keep(tried.select("a", "b").distinct())
        for all_ in (False, True)[: 1 + last]:                # one pair for each two components, in the end all that still span two
            left = apart(tried, roots)
            left = keep(left.select("a", "b") if all_ else _one_each(left))
            if left.isEmpty():
                break
            roots = merged(roots, confirmed(slim, reps, left, size, num, den, _names))
            free(left)
        free(tried)
    free(found, sketches)

    # components of classes, then the smallest id of each
    placed = keep(classes.join(roots.withColumnRenamed("node", "sig"), "sig").select("sig", "n", "root", "own"))
    least = placed.groupBy("root").agg(F.min("own").alias("least"))
    of_class = placed.join(least, "root").select("sig", "n", "least")
    alone = classes.where("copies > 1").join(of_class, ["sig", "n"], "left_anti").select("sig", "n", F.col("own").alias("least"))
    part, of_row = F.col("d").isNotNull() & (F.col("n") > 0), F.struct("d", "digest")
    out = members.join(of_class.unionByName(alone), ["sig", "n"], "left").select(
        F.col("d").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(part, F.coalesce("least.d", "d")).otherwise(F.col("d")).alias("component_id"),
        "digest", F.when(part, F.coalesce("least", of_row) == of_row).alias("first"))
    return out if rows else out.drop("digest", "first")


def _arrays(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    return (x for x in _arrays_and_end(batches) if x is not None)


def _arrays_and_end(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...] | None]:
    for batch in and_end(batches):
        yield None if batch is None else tuple(stored(c) if pa.types.is_binary(c.type) else np.asarray(c) for c in batch.columns)


def _differs(now: tuple[np.ndarray, ...]) -> np.ndarray:
    return (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1])


def _pairs(a: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Each pair once, the smaller hash first; repeats within the batch go here already."""
    swap = a[i] > a[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    got = np.unique(np.column_stack([a[i], n[i], a[j], n[j]]), axis=0)
    return _batch(kind=np.zeros(len(got)), a=got[:, 0], n=got[:, 1], b=got[:, 2], m=got[:, 3])


def _names(s: np.ndarray) -> tuple[int]:
    return (_signature(s),)


def _sketches(slim: DataFrame, reps: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``a, n, sketch`` of the wanted classes."""
    return keep(texts_of(slim, reps, wanted, size, _names, sketch_of).select("a", "n", F.col("t").alias("sketch")))


def _near(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sketches may belong to linked sets."""
    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = pa.array(may_link(stored(batch.column(4)), stored(batch.column(5)), np.asarray(batch.column(2)), np.asarray(batch.column(3)), num, den))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in range(2)], ["a", "b"])

    side = sketches.hint("merge")      # the same plan at every size
    both = (pairs.join(side.withColumnRenamed("sketch", "x"), "a")
            .join(side.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b"))
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(check, "a long, b long")


def _one_each(pairs: DataFrame) -> DataFrame:
    """``a, b``: one of the pairs for each two components ``x, y``."""
    return pairs.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")
