"""Line deduplication by a sharded minimal perfect hash over the keys of frequent lines.

1. Every eligible line becomes a 128-bit hash of its key; partial aggregation counts the documents of each and finds the last one.
2. Frequent keys are dealt into shards. A shard is a minimal perfect hash (levels of bit arrays, as many slots as keys) that
   indexes three compact arrays: fingerprints, document counts and last documents.
3. Documents probe the arrays: what travels is the hash of a line and its document, never the line. A shard's arrays come first
   in its sorted partition, so a task holds one shard at a time and probes stream past it.
4. Keys that hold at least 1/``HEAVY`` of all (line, document) pairs - at most ``HEAVY`` of them, by arithmetic - form one more
   shard that goes to every task and is probed there, so a line that a third of all documents share never meets in one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statframe.llm.common import keep, per_batch, schema_with
from statframe.llm.words import mix

#: Characters stripped at both ends of a line (fixed by the contract).
STRIPPED = b" \t\n\x0b\x0c\r"
HEAVY = 4096
SHARD_KEYS = 1 << 16
SHARD_PROBES = 1 << 18


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a key's slot is the rank of its bit in the first level it is alone in."""

    GAMMA, LEVELS = 1.6, 48

    def __init__(self, bits: list[np.ndarray], sizes: list[int], rest: np.ndarray):
        self.bits, self.sizes, self.rest = bits, sizes, rest
        self.ranks, total = [], 0
        for b in bits:
            counts = np.bitwise_count(b).astype(np.int64)
            self.ranks.append(total + np.cumsum(counts) - counts)
            total += int(counts.sum())
        self.alone = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, sizes = [], []
        while len(keys) and len(sizes) < cls.LEVELS:
            size = max(64, -(-int(len(keys) * cls.GAMMA) // 64) * 64)
            at = cls._at(keys, len(sizes), size)
            hits = np.bincount(at, minlength=size)
            bits.append(np.packbits(hits == 1, bitorder="little").view(np.uint64))
            sizes.append(size)
            keys = keys[hits[at] != 1]
        return cls(bits, sizes, np.sort(keys))

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x632BE59BD9B4E019 * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; of a foreign key any slot or -1 (the fingerprint decides)."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, size) in enumerate(zip(self.bits, self.sizes)):
            at = self._at(keys[todo], level, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[found]] = (self.ranks[level][at >> 6] + below)[found]
            todo = todo[~found]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            same = self.rest[at] == keys[todo]
            out[todo[same]] = self.alone + at[same]
        return out

    def pack(self) -> bytes:
        return struct.pack(f"<ii{len(self.sizes)}q", len(self.sizes), len(self.rest), *self.sizes) + b"".join(
            b.tobytes() for b in self.bits) + self.rest.astype(np.uint64).tobytes()

    @classmethod
    def unpack(cls, blob: bytes) -> PerfectHash:
        levels, rest = struct.unpack_from("<ii", blob)
        sizes = list(struct.unpack_from(f"<{levels}q", blob, 8))
        bits, at = [], 8 + 8 * levels
        for size in sizes:
            bits.append(np.frombuffer(blob, np.uint64, size // 64, at))
            at += size // 8
        return cls(bits, sizes, np.frombuffer(blob, np.uint64, rest, at))


class LineIndex:
    """One shard: a perfect hash over line hashes and the arrays it indexes."""

    def __init__(self, hash_: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.hash, self.prints, self.counts, self.last = hash_, prints, counts, last

    @classmethod
    def build(cls, h: np.ndarray, g: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineIndex:
        keys = mix(h.view(np.uint64) ^ (g.view(np.uint64) >> np.uint64(1)))
        hash_ = PerfectHash.build(keys)
        at = hash_.slots(keys)
        out = [np.zeros(len(keys), d) for d in (np.int64, np.int64, np.int64)]
        for target, source in zip(out, (g, counts, last)):
            target[at] = source
        return cls(hash_, *out)

    def probe(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, last document) of each line hash; count 0 where the line is not in the index."""
        if not len(self.prints):
            return np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        at = self.hash.slots(mix(h.view(np.uint64) ^ (g.view(np.uint64) >> np.uint64(1))))
        known = (at >= 0) & (self.prints[at] == g)
        return np.where(known, self.counts[at], 0), np.where(known, self.last[at], 0)

    def pack(self) -> bytes:
        head = self.hash.pack()
        return struct.pack("<qq", len(self.prints), len(head)) + b"".join(a.tobytes() for a in (self.prints, self.counts, self.last)) + head

    @classmethod
    def unpack(cls, blob: bytes) -> LineIndex:
        n, _ = struct.unpack_from("<qq", blob)
        arrays = [np.frombuffer(blob, np.int64, n, 16 + 8 * n * k) for k in range(3)]
        return cls(PerfectHash.unpack(blob[16 + 24 * n:]), *arrays)


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z in lower case."""
    return line.strip(STRIPPED).lower()


def _eligible(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least)


def _hashes(text: bytes | None, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text and the 128-bit hash of each eligible one's key."""
    lines = (text or b"").split(b"\n")
    keys = [line_key(x) for x in lines]
    return lines, [xxhash.xxh3_128_digest(k) if _eligible(k, least) else None for k in keys]


def _pairs(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray]:
    """((hash, hash), document) of the distinct eligible lines of each row that has an id."""
    digests, counts, ids = [], [], batch.column(0)
    for text in batch.column(1).cast(pa.binary()).to_pylist():
        own = {d for d in _hashes(text, least)[1] if d}
        digests += own
        counts.append(len(own))
    pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    null = np.asarray(ids.is_null())
    docs = np.repeat(np.asarray(ids.fill_null(0)).astype(np.int64), counts)
    mine = ~np.repeat(null, counts)
    return pairs[mine], docs[mine]


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5,
                heavy: int = HEAVY, shard_probes: int = SHARD_PROBES) -> DataFrame:
    """Drop lines that occur in at least ``min_docs`` documents from all but the document with the largest id.

    Returns ``docs`` with ``text`` replaced, and ``n_lines`` (before) and ``n_dropped``; columns of those names in ``docs`` give way.
    Null or empty text is one empty line and comes back empty. Rows with a null id take no part: their lines are neither counted nor
    dropped. Rows that repeat an id are one document: a line counts once for it and goes or stays in all its rows. Ids are integers.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id).cast("long").alias("d"), F.col(text).alias("t"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, own = _pairs(batch, min_chars)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(own)], ["h", "g", "d"])

    pairs = slim.mapInArrow(count, "h long, g long, d long")
    counted = keep(pairs.groupBy("h", "g").agg(F.count_distinct("d").alias("n"), F.max("d").alias("last")).where(F.col("n") >= min_docs)
                   .withColumn("total", F.col("n")))
    frequent, held = (counted.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first())
    held = held or 0
    # at most ``heavy`` keys can each hold 1/heavy of the pairs that frequent lines make
    large = counted.where(F.col("n") >= max(1, -(-held // heavy))).toPandas() if frequent else pd.DataFrame(
        {c: np.zeros(0, np.int64) for c in ("h", "g", "n", "last")})
    everywhere = spark.sparkContext.broadcast(LineIndex.build(*(large[c].to_numpy(np.int64) for c in ("h", "g", "n", "last"))).pack())
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-frequent // SHARD_KEYS), -(-held // shard_probes))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        index = LineIndex.build(*(group[c].to_numpy(np.int64) for c in ("h", "g", "n", "last")))
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "kind": 0, "h": 0, "g": 0, "d": 0, "blob": [index.pack()]})

    columns = "shard int, kind int, h long, g long, d long, blob binary"
    shard = F.pmod(F.shiftrightunsigned("h", 17), F.lit(shards)).cast("int").alias("shard")
    index = keep(counted.where(F.col("n") < max(1, -(-held // heavy))).select(shard, "h", "g", "n", "last").groupBy("shard").applyInPandas(build, columns))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = LineIndex.unpack(everywhere.value)
        for batch in batches:
            pairs, own = _pairs(batch, min_chars)
            away = near.probe(pairs[:, 0].copy(), pairs[:, 1].copy())[0] == 0
            pairs, own = pairs[away], own[away]
            number = ((pairs[:, 0].astype(np.uint64) >> np.uint64(17)) % np.uint64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.ones(len(own), np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
                                              pa.array(own), pa.nulls(len(own), pa.binary())], ["shard", "kind", "h", "g", "d", "blob"])

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, have = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            number, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            h, g, own = (np.asarray(batch.column(k)).copy() for k in (2, 3, 4))
            cuts = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 0)])
            for a, b in zip(cuts, [*cuts[1:], len(number)]):
                if kind[a] == 0:
                    current, have = LineIndex.unpack(batch.column(5)[int(a)].as_py()), number[a]
                elif have == number[a]:
                    n, last = current.probe(h[a:b], g[a:b])
                    gone = (n > 0) & (last != own[a:b])
                    if gone.any():
                        yield pa.RecordBatch.from_arrays([pa.array(own[a:b][gone]), pa.array(h[a:b][gone]), pa.array(g[a:b][gone])], ["d", "h", "g"])

    asked = slim.mapInArrow(ask, columns).unionByName(index)
    dropped = (asked.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, "d long, h long, g long")
               .groupBy("d").agg(F.collect_set(F.struct("h", "g")).alias("__gone")))
    both = docs.withColumn("__d", F.col(id).cast("long")).join(dropped.withColumnRenamed("d", "__d"), "__d", "left")

    def clean(batch: pa.RecordBatch) -> dict:
        near = LineIndex.unpack(everywhere.value)
        out, n, gone = [], [], []
        ids = batch.column(batch.schema.get_field_index("__d")).to_pylist()
        drops = batch.column(batch.schema.get_field_index("__gone"))
        parts = drops.flatten()
        some = np.stack([np.asarray(parts.field(0)), np.asarray(parts.field(1))], axis=1) if len(parts) else np.zeros((0, 2), np.int64)
        sizes = np.asarray(drops.value_lengths().fill_null(0)).astype(np.int64)
        ends = np.cumsum(sizes)
        for k, value in enumerate(batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()):
            lines, hashes = _hashes(value, min_chars)
            n.append(len(lines))
            known = [d for d in hashes if d]
            bad: set[bytes] = set()
            if ids[k] is not None and known:
                bad = {x.tobytes() for x in some[ends[k] - sizes[k]:ends[k]]}
                pairs = np.frombuffer(b"".join(known), np.int64).reshape(-1, 2)
                count, last = near.probe(pairs[:, 0].copy(), pairs[:, 1].copy())
                bad |= {known[i] for i in np.flatnonzero((count > 0) & (last != ids[k]))}
            kept = [x for x, d in zip(lines, hashes) if d is None or d not in bad] if bad else lines
            out.append(b"\n".join(kept))
            gone.append(len(lines) - len(kept))
        return {text: pa.array(out, pa.binary()).cast(pa.string()), "n_lines": n, "n_dropped": gone}

    order = [f.name for f in schema_with(docs, n_lines="long", n_dropped="long").fields]
    return per_batch(both, clean, **{text: "string", "n_lines": "long", "n_dropped": "long"}).select(*order)
