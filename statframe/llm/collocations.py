"""Phrase collocations: Toivonen's mining of frequent word sequences, then the score of each phrase's weakest cut.

A sample is mined level by level with a lowered threshold. What it finds is proposed: a phrase of m words is proposed or on the negative
border if its first and its last m - 1 words are proposed. The full pass counts all of those, by hash. A frequent phrase that was not
proposed is a failure of the border: longer phrases over it were not counted. It is proposed then, and a further pass counts what that
opens; passes go on until no failure is left, so the sample never affects the result. From the first of them on phrases are counted by
their words, those that are known to be frequent by hash included.

Proposed phrases travel as a table of bits of fixed size (``bits``) whatever their number: a false hit only means that a phrase more is counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statframe.llm import bits
from statframe.llm.common import free, keep, slices
from statframe.llm.words import Words, mix, texts

#: Share of the documents in the sample, and the share of the expected count that proposes a phrase.
SAMPLE = 0.125
LOWERED = 0.7
#: Bytes of text handled at once.
CHUNK = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Fixed classes of bytes: what ends a piece, and what ends a word.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~ENDS
WORD[[0x20, 0x09]] = False


def _chunks(column: pa.Array, longest: int, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """First row, row after the last, bytes, row offsets, and the byte before which phrases begin. A long text comes in overlapping chunks."""
    for first, last, data, offsets in texts(column, most):
        if len(data) <= 2 * most:
            yield first, last, data, offsets, len(data)
            continue
        at, size = 0, most                   # one row
        while True:
            part = data[at : at + size]
            if at + size >= len(data):
                yield first, last, part, np.array([0, len(part)]), len(part)
                break
            inside = WORD[part]
            begins = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
            if len(begins) <= 2 * longest:   # words as long as the chunk
                size *= 2
                continue
            end = int(begins[-longest])      # the last word may be cut; phrases that begin here end before it
            yield first, last, part, np.array([0, len(part)]), end
            at, size = at + end, most


class _Chunk:
    """Words of a chunk with the keys of the phrases that begin at each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, end: int, lang: np.ndarray, salt: np.ndarray):
        w = self.words = Words(data, offsets, WORD)
        self.lang = np.repeat(lang, np.diff(w.first))
        self.salt = salt[self.lang]
        ended = np.r_[np.int64(0), np.cumsum(ENDS[data])]
        split = np.ones(len(w.start), bool)
        if len(split):
            split[1:] = ended[w.start[1:]] > ended[w.end[:-1]]
            split[w.first[:-1][np.diff(w.first) > 0]] = True
        self.piece = np.cumsum(split)
        self.begins = int(np.searchsorted(w.start, end))
        self.sum = np.zeros(len(w.hash), np.uint64)

    def keys(self, m: int) -> np.ndarray:
        """Keys of the phrases of m words; to be called with 1, 2, …"""
        n = max(0, len(self.words.hash) - m + 1)
        self.sum = self.sum[:n] + mix(self.words.hash[m - 1 :] + np.uint64(0xD1B54A32D192ED03 * m % 2**64))
        return mix(self.sum + self.salt[:n] + np.uint64(m))

    def whole(self, m: int) -> np.ndarray:
        n = max(0, len(self.piece) - m + 1)
        return (self.piece[:n] == self.piece[m - 1 :]) & (np.arange(n) < self.begins)

    def phrases(self, at: np.ndarray, m: int) -> pa.Array:
        """The phrases of m words that begin at these words, in lower case, with one space between words."""
        w = self.words
        idx = (at[:, None] + np.arange(m)).ravel()
        start, size = w.start[idx], (w.end - w.start)[idx] + 1
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(start, size)
        text = _LOWER[w.data[np.minimum(place, len(w.data) - 1)]]
        text[ends - 1] = 32
        last = np.zeros(len(text), bool)
        last[ends[m - 1 :: m] - 1] = True
        offsets = np.r_[0, ends[m - 1 :: m] - np.arange(1, len(at) + 1)].astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text[~last].tobytes()))


def _walk(docs: DataFrame, lengths: range, new, old=None, known=None, named: bool = False, most: int = CHUNK) -> DataFrame:
    """Counts of the phrases that ``new`` opens and ``old`` did not, and of those whose key is ``known`` (tables of bits, as broadcasts).

    ``key, m, c``; if ``named`` also ``lang, phrase``, and rows of m = 0 with the number of words for each language. Rows of the same phrase
    from one chunk are added up here, by their 64-bit key. ``new`` opens a phrase if both phrases one word shorter in it are proposed.
    """
    longest = lengths[-1]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {name: bits.load(table) for name, table in (("new", new), ("old", old), ("known", known)) if table is not None}
        proposing = [(name, tables[name]) for name in ("new", "old") if name in tables]
        for batch in slices(batches, 4096):
            coded = batch.column(0).dictionary_encode()
            salt = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], np.uint64)
            for first, last, data, offsets, end in _chunks(batch.column(1), longest, most):
                chunk = _Chunk(data, offsets, end, np.asarray(coded.indices)[first:last], salt)
                if not len(chunk.sum):
                    continue
                if named and 1 in lengths:
                    words = np.bincount(chunk.lang[: chunk.begins], minlength=len(salt))
                    seen = np.flatnonzero(words)
                    yield _rows(salt[seen], 0, words[seen], coded.dictionary.take(pa.array(seen)), pa.array([""] * len(seen)))
                was = {}                                                 # whether the phrases one word shorter are proposed, for each table
                for m in range(1, longest + 1):
                    key, whole = chunk.keys(m), chunk.whole(m)
                    opened = {}
                    for name, _ in proposing:
                        opened[name] = whole if m == 1 else whole & was[name][: len(key)] & was[name][1 : len(key) + 1]
                    take = opened["new"] if old is None else opened["new"] & ~opened["old"]
                    if known is not None:
                        take = take.copy()
                        left = np.flatnonzero(whole & ~take)
                        take[left] = bits.has(tables["known"], key[left])
                    if m in lengths:
                        at = np.flatnonzero(take)
                        if len(at):
                            got, where, c = np.unique(key[at], return_index=True, return_counts=True)
                            at = at[where]
                            yield (_rows(got, m, c, coded.dictionary.take(pa.array(chunk.lang[at])), chunk.phrases(at, m)) if named else _rows(got, m, c))
                    if m < longest:
                        # what begins in the overlap is looked up too: it is the second part of a phrase that begins before it
                        look = np.flatnonzero(chunk.piece[: len(key)] == chunk.piece[m - 1 :])
                        for name, table in proposing:
                            was[name] = np.zeros(len(key), bool)
                            was[name][look] = bits.has(table, key[look])

    kind = "key long, m int, c long" + (", lang string, phrase string" if named else "")
    return docs.mapInArrow(count, kind)


def _rows(key: np.ndarray, m: int, c: np.ndarray, *names: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(key.view(np.int64)), pa.array(np.full(len(key), m, np.int32)), pa.array(c.astype(np.int64)), *names]
    return pa.RecordBatch.from_arrays(columns, ["key", "m", "c", "lang", "phrase"][: len(columns)])


def _failed(frequent: DataFrame, proposed, longest: int) -> DataFrame:
    """Frequent phrases that were not proposed and have room for more words."""
    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.load(proposed)
        for batch in batches:
            yield batch.filter(pa.array(~bits.has(table, np.asarray(batch.column(0)))))

    return frequent.where(F.col("m").between(1, longest - 1)).select("key").mapInArrow(test, "key long")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, sample: float = SAMPLE, lowered: float = LOWERED,
         chunk: int = CHUNK, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(``lang, m, phrase, f``: all phrases of 1 to ``longest`` words that occur ``least`` times in a language's texts; ``lang, n``: its words).

    A-Z are lowered, texts fall into pieces at ``ENDS`` and those into words at spaces and tabs; every contiguous occurrence within a piece
    counts, overlaps too. Null texts are empty, a null language is ``und``. ``sample``, ``lowered`` and ``seed`` move work between passes,
    never a result. No rows give no rows; other columns are ignored. A phrase's language and words are grouped as they are; 64-bit keys
    choose what is counted and add up the rows of one chunk.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))

    def frequent(df: DataFrame, at_least: int, *by: str) -> DataFrame:
        return df.groupBy("m", "key", *by).agg(F.sum("c").alias("f")).where((F.col("f") >= at_least) | (F.col("m") == 0))

    drawn = keep(docs.sample(sample, seed))
    low, proposed = max(2, int(least * sample * lowered)), bits.empty()
    for m in range(1, longest):
        shared = bits.share(spark, proposed)
        proposed = proposed | bits.table(frequent(_walk(drawn, range(m, m + 1), shared, most=chunk), low))
        shared.destroy()
    free(drawn)
    old = bits.share(spark, proposed)
    by_key = keep(frequent(_walk(docs, range(1, longest + 1), old, most=chunk), least))
    frequent_keys = bits.table(by_key)
    proposed = proposed | frequent_keys
    known, now = bits.share(spark, frequent_keys), bits.share(spark, proposed)
    # the first pass by words also finds what the border's failures have hidden
    out = [keep(frequent(_walk(docs, range(1, longest + 1), now, old, known, True, chunk), least, "lang", "phrase"))]
    while not (failed := keep(_failed(out[-1], now, longest))).isEmpty():
        old.destroy()
        proposed = proposed | bits.table(failed)
        old, now = now, bits.share(spark, proposed)
        out.append(keep(frequent(_walk(docs, range(2, longest + 1), now, old, None, True, chunk), least, "lang", "phrase")))
    phrases = out[0]
    for more in out[1:]:
        phrases = phrases.unionByName(more)
    # a phrase that an earlier pass had by a key of the known table comes again when its border opens
    return (phrases.where("m > 0").groupBy("lang", "m", "phrase").agg(F.max("f").alias("f")),
            phrases.where("m = 0").groupBy("lang").agg(F.sum("f").alias("n")))


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, top: int = 2000, share: int = 100,
                 scale: int = 1000, **how) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of 2 to ``longest`` words of each language.

    a is the phrase's count (``mine``), n the language's words. Cutting it after k words leaves parts that occur l and r times and scores
    floor(scale * a * n / (l * r)); the lowest cut counts, the first of several. Phrases inside a longer frequent one that occurs at least
    ``share`` percent as often are left out. Order: score, a (both descending), phrase by its bytes. Products are exact up to 38 digits.
    """
    found, words = mine(docs, text, lang, longest, least, **how)
    found = keep(found)
    phrases = found.where("m > 1").select("lang", "m", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    span = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = phrases.select("lang", "m", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("head"), span(F.col("k") + 1, F.col("m") - F.col("k")).alias("tail"))
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(words, "lang")
    cuts = cuts.withColumns({"above": _wide(F.col("a")) * _wide(F.col("n")) * F.lit(scale).cast("decimal(9,0)"),
                             "below": _wide(F.col("l")) * _wide(F.col("r"))}).withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))
    inner = (phrases.where("m > 2").select("lang", "m", "w", "a", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("size"))
             .select("lang", "w", "a", "size", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)).alias("at"))
             .groupBy("lang", span(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer")))
    left = best.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {share} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return (left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score")))
