"""Token counts: distinct words share a trie, whose prefixes are scored once; a text's count is the sum over its words.

Every worker keeps the counts of words it has met (a bounded cache in Arrow arrays) and builds a trie of the new ones of each slice; words are cut
where no piece crosses two ASCII characters, so that one with a comma behind it is not new. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from statframe.llm import unigram
from statframe.llm.common import per_batch

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_BYTES = 1 << 20
#: Words that a worker remembers.
CACHE = 1 << 18

_made: dict = {}


class Cache:
    """Words' results in this worker. When half of ``CACHE`` was met, the words that were not are forgotten; when there are too many, all but those at hand."""

    def __init__(self, v: unigram.Vocabulary, kind: str):
        self.trie, self.split = unigram.Trie(v), unigram.Splitter(v)
        self.make = getattr(self.trie, kind)
        self.known = pa.array([], pa.string())
        self.became = pa.array([], pa.int64() if kind == "counts" else pa.binary())
        self.met = np.zeros(0, bool)

    @classmethod
    def of(cls, sent, kind: str) -> Cache:
        key = (cls, kind, sent.value.longest, len(sent.value.pieces), hash(tuple(sent.value.pieces.items())))
        if key not in _made:
            _made.clear()
            _made[key] = cls(sent.value, kind)
        return _made[key]

    def meet(self, distinct: pa.Array) -> pa.Array:
        """What these words, or parts of words, became."""
        at = pc.index_in(distinct, self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        at[new] = len(self.known) + np.arange(len(new))
        if len(new):
            words = distinct.take(pa.array(new))
            normal = list(map(unigram.normal, words.to_numpy(zero_copy_only=False).tolist()))
            made = pa.array(list(map(self.make(normal).__getitem__, normal)), self.became.type)
            self.known, self.became = pa.concat_arrays([self.known, words]), pa.concat_arrays([self.became, made])
        hand = np.zeros(len(self.known), bool)
        hand[at] = True
        self.met = np.append(self.met, np.zeros(len(new), bool)) | hand
        out = self.became.take(pa.array(at))
        met = int(self.met.sum())
        if met > CACHE // 2 or len(hand) > CACHE:
            keep = self.met if CACHE // 2 < met <= CACHE else hand
            self.known, self.became, self.met = self.known.filter(pa.array(keep)), self.became.filter(pa.array(keep)), hand[keep]
        return out

    def slices(self, texts: pa.Array, front: str = " ") -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """Slice by slice of the texts: what distinct parts of words became, which of them the texts hold, how many up to each text's end, words of each text."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE_BYTES, "right")))
            parts, upto, n_words = self.split(texts.slice(first, last - first), front)
            yield self.meet(parts.dictionary), parts.indices.to_numpy(), upto, n_words
            first = last

    def results(self, texts: list[str | None]) -> list[list]:
        """What each text's words became, one by one."""
        out = []
        for made, at, upto, _ in self.slices(pa.array(texts, pa.string())):
            out += [made.take(pa.array(own)).to_pylist() for own in np.split(at, upto[:-1])]
        return out


def token_counts(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens`` of the best unigram path; columns of those names in ``docs`` give way.

    Null and empty texts have no words and no tokens; repeated rows agree. Time grows in proportion to a text's length, whatever its script: a long
    word is cut wherever no piece crosses, what is left of it beyond 64 characters shares tries with others of its length or is segmented alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(unigram.load(model))

    def run(batch: pa.RecordBatch) -> dict:
        n_words, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for made, at, upto, words in Cache.of(sent, "counts").slices(batch.column(batch.schema.get_field_index(text))):
            total = np.cumsum(np.append(0, made.to_numpy()[at]))
            n_words.append(words), n_tokens.append(np.diff(total[upto], prepend=0))
        return {"n_words": np.concatenate(n_words), "n_tokens": np.concatenate(n_tokens)}

    return per_batch(docs, run, n_words="long", n_tokens="long")
