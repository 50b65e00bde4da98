"""Near-duplicates by an inverted join of MinHash signature coordinates.

Every distinct set of shingles (a class of copies) has a signature of ``COORDINATES`` minima. A (coordinate, value) pair is a token; linked
sets share at least ``MATCHES`` tokens, but for a chance stated there. Tokens are ordered by how many documents hold them, rarest first. Two
sets that share that many tokens share one among the first ``COORDINATES - MATCHES + 1`` of each, so only this prefix is posted: the merge of
lists skips the long ones, and collisions beyond the prefix are counted on the signatures of the pairs that met. Pairs with enough of them are
retained; those that counts of hashed shingles leave room for (a bound that loses no link) are confirmed on the whole sets.

Groups of near copies are not expanded into all pairs. First, neighbours in each list become pairs; the groups that retained pairs form are dealt
into blocks, where each text is read once and linked with those of its block. Then the blocks' components are linked by one pair for each two
of them, and last all pairs of the lists that still hold sets of different components are counted, whatever the lists' lengths.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statframe.llm.common import keep, slices
from statframe.llm.graph import components
from statframe.llm.links import and_end, apart, by_group, confirmed, may_link, merged, rooted, sketch_of, stored, within
from statframe.llm.words import mix, shingle_sets

COORDINATES = 128
#: Tokens that a pair must share. Sets that share 0.8 of their shingles have fewer with a probability below 1e-9 (Chernoff bound), so less if they share more.
MATCHES = 70
#: Bytes kept of a minimum, and of these the one that stands for it on a pair. A false match only lets a pair through to the next test.
BYTES = 5
#: Tokens are counted in so many hashed buckets; the counts only order them and deal out long lists (any order gives the same links).
BUCKET_BITS = 18
#: Rows of a list that are scanned for neighbours in one piece.
PIECE = 1 << 16
#: Members of a group of near copies that are compared in one task, and rows of a list that are compared with others in one task.
BLOCK = 256
LIST_BLOCK = 512
#: A pair is compared in this many of the lists in which it seems to meet (bytes of tokens that agree), not in all of them. It is passed over only
#: if as many bytes agree by chance before the first token that is shared: C(58, 6) / 256^6 at most, for pairs that share hardly any prefix.
MEETINGS = 6

_FACTOR = np.random.default_rng(20240813).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.random.default_rng(20240814).integers(1, 2**63, COORDINATES, dtype=np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """The mixed minimum of each coordinate's hash over the shingles."""
    low = np.full(COORDINATES, np.uint64(2**64 - 1))
    for a in range(0, len(s), 1 << 12):
        np.minimum(low, (_FACTOR[:, None] * s[None, a : a + (1 << 12)]).min(axis=1), out=low)
    return mix(low + _SALT)


def _names(s: np.ndarray) -> tuple[int, int]:
    """128 bits for a set of shingles."""
    one, two = mix(s), mix(s ^ np.uint64(0x9FB21C651E98DF25))
    return tuple(np.array([one.sum(), two.sum()], np.uint64).view(np.int64).tolist())


def _tokens(kept: np.ndarray) -> np.ndarray:
    """Tokens of signatures as stored (rows of COORDINATES x BYTES)."""
    wide = np.zeros((len(kept), COORDINATES, 8), np.uint8)
    wide[:, :, :BYTES] = kept.reshape(len(kept), COORDINATES, BYTES)
    return mix(wide.view(np.uint64)[:, :, 0] + _SALT)


def _prefix(token: np.ndarray, counts: np.ndarray, matches: int) -> np.ndarray:
    """Coordinates of the rarest tokens of each row, in order of count and token: one more than may be missing."""
    count = counts[(token >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    by_token = np.argsort(token, axis=1)
    order = np.take_along_axis(by_token, np.argsort(np.take_along_axis(count, by_token, 1), axis=1, kind="stable"), 1)
    return order[:, : COORDINATES - matches + 1]


def _fits(n, m, num: int, den: int):
    return np.minimum(n, m) * den >= num * np.maximum(n, m)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4, num: int = 80, den: int = 100, matches: int = MATCHES,
                    block: int = BLOCK, list_block: int = LIST_BLOCK, piece: int = PIECE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row: documents are linked when den * intersection >= num * union.

    Sets are distinct shingles of ``size`` words (runs of anything but ASCII white space, A-Z in lower case); fewer words are one shingle; null
    and empty texts have none and are linked with nothing. Rows with a null id take no part: their component and ``kept`` are null. Rows that
    repeat an id are texts of their own; each has the smallest id its text reaches and is ``kept`` if that is its own. Ids are integers. Texts
    are told apart by a 128-bit hash of their set and its size, shingles by 64 bits. No rows give no rows; other columns are ignored.
    ``block``, ``list_block`` and ``piece`` change how the work is dealt out, never a result.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    slim = docs.select(F.col(id).cast("long").alias("d"), F.col(text).alias("t"))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in slices(batches, 1024):
            n, one, two = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            got: list = [None] * batch.num_rows
            sketches: list = [None] * batch.num_rows
            for row, s in shingle_sets(batch.column(1), size):
                if len(s):
                    n[row], (one[row], two[row]) = len(s), _names(s)
                    got[row], sketches[row] = minima(s), sketch_of(s)
            full = np.flatnonzero(n)
            low = np.ascontiguousarray(np.array([got[k] for k in full], np.uint64).reshape(-1, COORDINATES, 1)).view(np.uint8)[:, :, :BYTES]
            if len(full):
                np.add.at(counts, (_tokens(low.reshape(len(full), -1)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64).ravel(), 1)
            for k, x in zip(full, low):
                got[k] = x.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(one), pa.array(two), pa.array(got, pa.binary()), pa.array(sketches, pa.binary())], _SIGNED)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), -1)), pa.array(counts[used]), pa.array(np.zeros(len(used), np.int64)),
                                          *[pa.nulls(len(used), pa.binary())] * 2], _SIGNED)

    signed = keep(slim.mapInArrow(sign, "d long, n long, one long, two long, low binary, sketch binary"))
    members = signed.where("n >= 0").select("d", "n", "one", "two")
    buckets = signed.where("n < 0").groupBy("d").agg(F.sum("one").alias("c")).toArrow()          # at most 2 ** BUCKET_BITS rows
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[np.asarray(buckets["d"])] = np.asarray(buckets["c"])
    sent = sc.broadcast(counts)
    classes = keep(signed.where("n > 0 and d is not null").groupBy("one", "two", "n").agg(F.min("d").alias("d"), F.first("low").alias("low"), F.first("sketch").alias("sketch"))
                   .withColumn("a", F.monotonically_increasing_id()))
    reps = classes.select("a", "d", "n", "one", "two")

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            if batch.num_rows:
                token = _tokens(stored(batch.column(2)))
                prefix = _prefix(token, sent.value, matches)
                own = np.take_along_axis(token, prefix, 1)
                count = sent.value[(own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].ravel()
                k = prefix.shape[1]
                dealt = -(-count // piece)
                a = np.repeat(np.asarray(batch.column(0)), k)
                part = np.where(dealt > 1, mix(a.view(np.uint64)) % np.maximum(dealt, 1).astype(np.uint64) + np.uint64(1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own.ravel().view(np.int64)), pa.array(part), pa.array(a),
                                                  pa.array(np.repeat(np.asarray(batch.column(1)), k)), pa.array(prefix.ravel().astype(np.int32))],
                                                 ["token", "part", "a", "n", "c"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists in order of size: neighbours that may be linked (b not null), and the rows that have such a neighbour or a list in parts."""
        held, was = None, False                               # the last row so far, and whether it may be linked with the one before it
        for batch in and_end(batches):
            if batch is None:
                if held is None:
                    return
                now, keep_ = held, 1
            else:
                now = [np.asarray(c) for c in batch.columns] if held is None else [np.concatenate(x) for x in zip(held, map(np.asarray, batch.columns))]
                keep_ = len(now[0]) - 1
            token, part, a, n, c = now
            near = (token[1:] == token[:-1]) & (part[1:] == part[:-1]) & _fits(n[1:], n[:-1], num, den)
            shared = (np.r_[was, near] | np.r_[near, False] | (part > 0))[:keep_]
            rows = np.flatnonzero(shared)
            if len(rows):
                yield _found(token[rows], a[rows], n[rows], c[rows], None)
            i = np.flatnonzero(near)
            if len(i):
                pairs = np.unique(np.sort(np.column_stack([a[i], a[i + 1]]), axis=1), axis=0)
                yield _found(None, pairs[:, 0], None, None, pairs[:, 1])
            held, was = [x[-1:] for x in now], bool(near[-1]) if len(near) else was

    found = keep(classes.select("a", "n", "low").mapInArrow(post, "token long, part int, a long, n long, c int").repartition("token", "part")
                 .sortWithinPartitions("token", "part", "n", "a").mapInArrow(scan, "token long, a long, n long, c int, b long"))
    postings = found.where("b is null").select("token", "a", "n", "c")
    marks = _marks(classes, sent, matches)
    met = found.where("b is not null").select("a", "b").distinct()
    good = keep(_retained(met, marks, matches, num, den))

    # groups of retained pairs, each text read once
    groups = components(good.select(F.col("a").alias("u"), F.col("b").alias("v")))
    roots = components(keep(within(slim, reps, groups, size, num, den, block, _names)))
    # one pair for each two components that a retained pair spans
    best = apart(good, roots).groupBy("x", "y").agg(F.max_by(F.struct("a", "b"), "score").alias("p")).select("p.*")
    roots = merged(roots, confirmed(slim, reps, keep(best), size, num, den, _names))
    # lists that still hold sets of different components: all their pairs
    open_ = _open(postings, roots, marks, list_block)

    def every(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now in by_group(batches, 3):
            (token, x, y, a, n, root, own, c), marked, posted, sketch = now[:8], now[8], np.unpackbits(now[9], axis=1).astype(bool), now[10]
            seen = posted[:, : c[0]]                          # coordinates before this list's
            i, j = np.triu_indices(len(a), 1)
            ok = (root[i] != root[j]) & ((x[0] == y[0]) | (own[i] != own[j])) & _fits(n[i], n[j], num, den)
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 1 << 14):
                p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                agree = marked[p] == marked[q]
                score = agree.sum(axis=1)
                ok = (score >= matches) & ((agree[:, : c[0]] & seen[p] & seen[q]).sum(axis=1) < MEETINGS)
                p, q, score = p[ok], q[ok], score[ok]
                ok = may_link(sketch[p], sketch[q], n[p], n[q], num, den)
                if ok.any():
                    p, q, score = p[ok], q[ok], score[ok]
                    low = a[p] < a[q]
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(low, a[p], a[q])), pa.array(np.where(low, a[q], a[p])), pa.array(score)], ["a", "b", "score"])

    more = keep(open_.mapInArrow(every, "a long, b long, score long").distinct())
    for share in (1, None):                                   # one for each two components, then all that still span two
        left = apart(more, roots)
        left = left.groupBy("x", "y").agg(F.max_by(F.struct("a", "b"), "score").alias("p")).select("p.*") if share else left.select("a", "b")
        left = keep(left)
        if left.isEmpty():
            break
        roots = merged(roots, confirmed(slim, reps, left, size, num, den, _names))

    placed = keep(classes.select("one", "two", "n", "a", "d").join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a")))
    least = placed.groupBy("root").agg(F.min("d").alias("least"))
    of_class = placed.join(least, "root").select("one", "two", "n", "least")
    part = F.col("d").isNotNull() & (F.col("n") > 0)
    out = members.join(of_class, ["one", "two", "n"], "left").select("d", "n", F.when(part, F.col("least")).otherwise(F.col("d")).alias("c"))
    return out.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), (F.col("d") == F.col("c")).alias("kept"))


_SIGNED = ["d", "n", "one", "two", "low", "sketch"]


def _found(token, a, n, c, b) -> pa.RecordBatch:
    kinds = {"token": pa.int64(), "a": pa.int64(), "n": pa.int64(), "c": pa.int32(), "b": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.nulls(len(a), t) if v is None else pa.array(v, t) for v, t in zip((token, a, n, c, b), kinds.values())], list(kinds))


def _marks(classes: DataFrame, counts, matches: int) -> DataFrame:
    """``a, n, marks, posted, sketch``: one byte of each coordinate, bits of the coordinates that are posted, and the counts of hashed shingles."""
    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            if batch.num_rows:
                low = stored(batch.column(2))
                posted = np.zeros((len(low), COORDINATES), bool)
                np.put_along_axis(posted, _prefix(_tokens(low), counts.value, matches), True, 1)
                marks, posted = ([x.tobytes() for x in v] for v in (low[:, ::BYTES], np.packbits(posted, axis=1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(posted, pa.binary()), batch.column(3)],
                                                 ["a", "n", "marks", "posted", "sketch"])

    return classes.select("a", "n", "low", "sketch").mapInArrow(strip, "a long, n long, marks binary, posted binary, sketch binary")


def _retained(pairs: DataFrame, marks: DataFrame, matches: int, num: int, den: int) -> DataFrame:
    """``a, b, score``: pairs whose signatures collide often enough and whose sketches leave room for a link."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = (stored(batch.column(4)) == stored(batch.column(5))).sum(axis=1)
                ok = (score >= matches) & may_link(stored(batch.column(6)), stored(batch.column(7)), np.asarray(batch.column(2)), np.asarray(batch.column(3)), num, den)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok)), pa.array(score[ok])], ["a", "b", "score"])

    other = marks.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("marks").alias("y"), F.col("sketch").alias("t"))
    both = pairs.join(marks.drop("posted"), "a").join(other, "b").select("a", "b", "n", "m", "marks", "y", "sketch", "t")
    return both.mapInArrow(count, "a long, b long, score long")


def _open(postings: DataFrame, roots: DataFrame, marks: DataFrame, list_block: int) -> DataFrame:
    """Rows of lists with sets of several components, dealt into pairs of blocks ``token, x, y``."""
    labelled = rooted(postings, roots, "a", "root")
    lists = labelled.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("length")).where("lo <> hi")
    rows = (labelled.join(lists.select("token", "length"), "token").join(marks.drop("n"), "a").withColumn("blocks", F.ceil(F.col("length") / list_block))
            .withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks"))))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return (dealt.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "a", "n", "root", "own", "c", "marks", "posted", "sketch")
            .repartition("token", "x", "y").sortWithinPartitions("token", "x", "y"))
