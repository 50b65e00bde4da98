"""SentencePiece encoding and decoding; giant documents by a max-plus scan over chunks.

A short text is segmented word by word (see ``unigram``). A giant one is cut into chunks of fixed length that different tasks handle:

1. Each chunk yields a transfer matrix: entry (j, k) is the best score from a boundary j characters past the chunk's begin to the first
   boundary at or past its end, which lies k characters past it (a piece may cross the border). Matrices combine by the max-plus product,
   which is associative. A scan of them gives the scores with which paths enter each chunk: the matrices of each ``SPAN`` chunks in a row are
   multiplied, the products again, until each document has one; from there down, the scores with which paths enter a block are carried
   through its members. Blocks of a level are independent of each other, so no task sees more than ``SPAN`` matrices of a document at once.
   With its matrix a chunk's ids between its first and last sure boundary are made, which no entry or exit changes.
2. With these scores what is left of each chunk is traced back alone, for every k it may be left with; it tells where each trace entered.
3. From the last chunk backwards, the entry of one is the exit of the one before; the chosen traces joined are the ids.

The ids are those of the unchunked best path, ties included.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statframe.llm import unigram
from statframe.llm.common import keep, per_batch, schema_with, slices
from statframe.llm.tokens import MODEL, Cache

#: Texts of more characters than this are cut; a chunk has so many characters.
GIANT = 1 << 15
CHUNK = 1 << 13
#: Chunks whose words are segmented together.
CHUNKS = 64
#: Matrices multiplied by one task in a row.
SPAN = 64
NONE = unigram._NONE


def transfer(cache: Chunks, before: str, body: str, after: str, between: np.ndarray | None = None) -> np.ndarray:
    """The chunk's matrix over boundary states 0..longest-1. ``before``: the character before (empty at the start), ``after``: those after.

    ``between``: the ids from the first to the last sure boundary, where they are known.
    """
    v, whole = cache.trie.v, body + after
    states = v.longest
    out = np.full((states, states), NONE)
    starts = _boundaries(cache, before, body)
    if not len(starts):
        for j in range(min(states, len(body) + 1)):
            best, _ = unigram.segment(v, whole[j:], until=max(0, len(body) - j))
            for k in range(min(states, len(after) + 1)):
                out[j, k] = best[len(body) + k - j]
        if len(body) < states:          # a state past the end of a short chunk stays where it is
            for j in range(len(body), states):
                out[j, j - len(body)] = 0
        return out
    first, last = starts[0], starts[-1]
    middle = cache.score(cache.encoded([whole[first:last]])[0] if between is None else between)
    tail, _ = unigram.segment(v, whole[last:len(body) + _reach(cache, body, after)], until=len(body) - last)
    for j in range(min(states, first + 1)):
        head = unigram.segment(v, whole[j:first])[0][-1]
        for k in range(min(states, len(tail) - (len(body) - last))):
            out[j, k] = head + middle + tail[len(body) - last + k]
    return out


def _boundaries(cache: Cache, before: str, body: str) -> list[int]:
    """The first and the last place in the chunk where every path has a boundary (no piece crosses it); none if there is no such place."""
    pairs = cache.trie.v.pairs
    first = 0 if body and not before else next((a for a in range(1, len(body)) if body[a - 1:a + 1] not in pairs), None)
    if first is None:
        return []
    return [first, next((a for a in range(len(body) - 1, first, -1) if body[a - 1:a + 1] not in pairs), first)]


def _reach(cache: Cache, body: str, after: str) -> int:
    """Characters past the end that may belong to a piece which crosses it."""
    text = body[-1:] + after
    return next((a for a in range(len(text) - 1) if text[a:a + 2] not in cache.trie.v.pairs), max(0, len(text) - 1))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of matrices (or of a row and a matrix)."""
    return np.maximum((a[..., :, None] + b).max(axis=-2), NONE)


def traces(v: unigram.Vocabulary, head: str | None, rest: str, until: int, exits: int, start: list[int]) -> tuple[list[int], list[list[int]], list[int]]:
    """(ids up to the first sure boundary, ids from the last one by exit k, entry by exit k) given the scores ``start`` of entering at each state.

    ``head``: the characters before the first sure boundary, ``rest``: those after the last one, of which ``until`` belong to the chunk. Without a sure
    boundary ``head`` is None and ``rest`` all there is.
    """
    if head is None:
        best, back = unigram.segment(v, rest, start, until)
        got = [unigram.trace(v, rest, back, until + k) if best[until + k] > NONE else ([], 0) for k in range(exits)]
        return [], [g[0] for g in got], [g[1] for g in got]
    _, back = unigram.segment(v, head, start)
    shared, entry = unigram.trace(v, head, back, len(head))
    best, back = unigram.segment(v, rest, until=until)
    return shared, [unigram.trace(v, rest, back, until + k)[0] if until + k <= len(rest) else [] for k in range(exits)], [entry] * exits


def ids_of(cache: Cache, texts: pa.Array, front: str = " ") -> pa.ListArray:
    """Ids of each text with ``front`` in front; none of a null or empty one."""
    flat, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for made, at, upto, _ in cache.slices(texts, front):
        own = made.cast(pa.large_binary()).take(pa.array(at))
        _, places, data = own.buffers()
        places = np.frombuffer(places, np.int64)[:len(own) + 1] // 4 if len(own) else np.zeros(1, np.int64)
        flat.append(np.frombuffer(data, np.int32, places[-1]) if places[-1] else flat[0])
        ends.append(ends[-1][-1] + places[upto])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(flat)))


class Chunks(Cache):
    """A worker's cache with scores of ids."""

    def __init__(self, v: unigram.Vocabulary, kind: str):
        super().__init__(v, kind)
        self.scores = np.full(len(v.text), v.byte_score, np.int64)
        for score, k in v.pieces.values():
            self.scores[k] = score

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of normal texts that begin and end at sure boundaries."""
        made = ids_of(self, pa.array(map(unigram.raw, texts), pa.string()), "")
        return np.split(np.asarray(made.flatten()), np.asarray(made.offsets)[1:-1])

    def score(self, ids: np.ndarray) -> int:
        return int(self.scores[ids].sum())


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """``docs`` with ``ids``, an array of piece ids; a column of that name in ``docs`` gives way. Null and empty texts have no ids.

    Texts of more than ``giant`` characters are cut into chunks of ``chunk``, whose matrices are scanned ``span`` at a time; the ids are the same for
    any of these. Time grows in proportion to a text's length, whatever its script; its ids end up in one row, as they must.
    """
    sent = docs.sparkSession.sparkContext.broadcast(unigram.load(model))

    def run(batch: pa.RecordBatch) -> dict:
        return {"ids": ids_of(Cache.of(sent, "encode"), batch.column(batch.schema.get_field_index(text)))}

    long = F.coalesce(F.length(text) > giant, F.lit(False))
    short = per_batch(docs.where(~long), run, ids="array<int>")
    return short.unionByName(_encode_giants(docs.where(long), text, sent, chunk, span))


def _encode_giants(docs: DataFrame, text: str, sent, chunk: int, span: int) -> DataFrame:
    keyed = keep(docs.withColumn("__row", F.monotonically_increasing_id()))
    longest = sent.value.longest

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunk c holds the characters from c * chunk on; the space in front of the whole text belongs to the first."""
        for batch in slices(batches, 1):
            row, whole = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            at = range(0, len(whole), chunk)
            for k in range(0, len(at), CHUNKS):
                own = at[k:k + CHUNKS]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row] * len(own), pa.int64()), pa.array(range(k, k + len(own)), pa.int32()), pa.array([whole[a - 1:a] if a else "" for a in own]),
                    pa.array([whole[a:a + chunk] for a in own]), pa.array([whole[a + chunk:a + chunk + longest - 1] for a in own])], ["__row", "c", "before", "body", "after"])

    pieces = keyed.select("__row", F.col(text).alias("t")).mapInArrow(cut, "__row long, c int, before string, body string, after string").repartition("__row", "c")

    def matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's matrix, the ids between its sure boundaries, and the text that is left for ``traces``."""
        cache = Chunks.of(sent, "encode")
        for batch in slices(batches, CHUNKS):
            rows, places, *texts = (batch.column(batch.schema.get_field_index(c)) for c in ("__row", "c", "before", "body", "after"))
            own = [tuple(map(unigram.normal, t)) for t in zip(*(t.to_pylist() for t in texts))]
            own = [(before, body if c else unigram.SPACE + body, after) for c, (before, body, after) in zip(places.to_pylist(), own)]
            sure = [_boundaries(cache, before, body) for before, body, _ in own]
            between = cache.encoded([body[s[0]:s[1]] if s else "" for s, (_, body, _) in zip(sure, own)])
            left = [(body[:s[0]], body[s[1]:] + after[:_reach(cache, body, after)], len(body) - s[1]) if s else (None, body + after, len(body))
                    for s, (_, body, after) in zip(sure, own)]
            yield pa.RecordBatch.from_arrays([
                rows, places, pa.array([transfer(cache, *t, ids).tobytes() for t, ids in zip(own, between)], pa.binary()),
                pa.array([ids.tobytes() for ids in between], pa.binary()), pa.array([None if h is None else unigram.raw(h) for h, _, _ in left], pa.string()),
                pa.array([unigram.raw(t) for _, t, _ in left], pa.string()), pa.array([n for _, _, n in left], pa.int32()),
                pa.array([min(longest, len(after) + 1) for _, _, after in own], pa.int32())], ["__row", "c", "m", "between", "head", "rest", "until", "exits"])

    made = keep(pieces.mapInArrow(matrices, "__row long, c int, m binary, between binary, head string, rest string, until int, exits int"))
    entered = _scan(made.select("__row", "c", "m"), longest, span)

    def trace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in slices(batches, CHUNKS):
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            got = [traces(v, None if head is None else unigram.normal(head), unigram.normal(rest), until, exits, np.frombuffer(enter, np.int64).tolist())
                   for head, rest, until, exits, enter in zip(*(column(c).to_pylist() for c in ("head", "rest", "until", "exits", "enter")))]
            shared = [np.array(g[0], np.int32).tobytes() + between for g, between in zip(got, column("between").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                column("__row"), column("c"), pa.array(shared, pa.binary()), pa.array([[np.array(x, np.int32).tobytes() for x in g[1]] for g in got], pa.list_(pa.binary())),
                pa.array([g[2] for g in got], pa.list_(pa.int32()))], ["__row", "c", "shared", "tails", "entry"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        """From the last chunk back: the entry of one is the exit of the one before."""
        leave, out = 0, []
        for shared, tails, entry in group.sort_values("c", ascending=False)[["shared", "tails", "entry"]].itertuples(index=False):
            out.append(bytes(shared) + bytes(tails[leave]))
            leave = int(entry[leave])
        return pd.DataFrame({"__row": group["__row"].iloc[:1], "ids": [np.frombuffer(b"".join(reversed(out)), np.int32)]})

    traced = made.drop("m").join(entered, ["__row", "c"]).mapInArrow(trace, "__row long, c int, shared binary, tails array<binary>, entry array<int>")
    ids = traced.groupBy("__row").applyInPandas(join, "__row long, ids array<int>")
    order = [f.name for f in schema_with(docs, ids="array<int>").fields]
    clash = [c for c in docs.columns if c.lower() == "ids"]
    return keyed.drop(*clash).join(ids, "__row").select(*order)


def _scan(matrices: DataFrame, states: int, span: int) -> DataFrame:
    """``__row, c, enter``: scores with which paths enter each chunk, from ``__row, c, m``."""
    own = lambda group: [np.frombuffer(m, np.int64).reshape(states, states) for m in group["m"]]

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("c")
        whole, *rest = own(group)
        for m in rest:
            whole = combine(whole, m)
        return pd.DataFrame({"__row": group["__row"].iloc[:1], "c": group["c"].iloc[:1] // span, "m": [whole.tobytes()]})

    def carry(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("c")
        enter, out = np.frombuffer(group["over"].iloc[0], np.int64), []
        for m in own(group):
            out.append(enter.tobytes())
            enter = combine(enter, m)
        return pd.DataFrame({"__row": group["__row"], "c": group["c"], "enter": out})

    block = F.expr(f"c div {span}")
    levels = [matrices]
    while (levels[-1].agg(F.max("c")).first()[0] or 0) > 0:
        levels.append(keep(levels[-1].withColumn("b", block).groupBy("__row", "b").applyInPandas(multiply, "__row long, c int, m binary")))
    start = np.full(states, NONE)
    start[0] = 0
    enter = levels[-1].select("__row", "c", F.lit(bytearray(start.tobytes())).alias("enter"))
    for level in reversed(levels[:-1]):
        over = enter.select("__row", F.col("c").alias("b"), F.col("enter").alias("over"))
        joined = level.withColumn("b", block.cast("int")).join(over, ["__row", "b"])
        enter = joined.groupBy("__row", "b").applyInPandas(carry, "__row long, c int, enter binary")
    return enter


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` with the text of its ids, exactly what was encoded; null ids give null, no ids give an empty text."""
    sent = docs.sparkSession.sparkContext.broadcast(pa.array(unigram.load(model).text, pa.large_binary()))

    def run(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.schema.get_field_index(ids))
        last = np.cumsum(np.append(0, column.value_lengths().fill_null(0)), dtype=np.int64)
        _, places, data = sent.value.take(column.flatten()).buffers()
        ends = np.frombuffer(places, np.int64)[last] if last[-1] else last
        own = np.frombuffer(data, np.uint8) if ends[-1] else np.zeros(0, np.uint8)
        some = np.diff(ends) > 0
        own = np.delete(own[:ends[-1]], ends[:-1][some])          # the space in front of each text
        ends -= np.append(0, np.cumsum(some))
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(own)])
        return {out: (pc.if_else(column.is_null(), None, made) if column.null_count else made).cast(pa.binary()).cast(pa.string())}

    return per_batch(docs, run, **{out: T.StringType()})
