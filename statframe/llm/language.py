"""Language identification as a mixture: each document's language proportions by expectation-maximisation.

A language is a smoothed distribution over hashed three-letter groups (lower case, everything but letters is one space), counted over
all documents that may be learned from. A document's groups are explained by a mixture of languages; sets of one, two, ... languages
are compared by likelihood less a penalty for every further language, and the best set gives the proportions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statframe.llm.common import per_batch

BUCKETS = 1 << 15
#: Characters joined and handled at once.
SLICE_CHARS = 1 << 19
SMOOTH = 0.5
#: A further language must add this many times log(groups) to the log-likelihood.
PENALTY = 12.0
ROUNDS = 8
_ALPHA = np.array([chr(c).isalpha() for c in range(0x10000)])


class Model(NamedTuple):
    names: list[str]
    table: np.ndarray       # BUCKETS x languages: probability of a group


def _groups(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray | None]]:
    """(row, buckets of its letter groups) of each text; None for a text that is null or has no letter."""
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and (chars == 0 or chars + len(texts[last] or "") <= SLICE_CHARS):
            chars += len(texts[last] or "") + 1
            last += 1
        lower = [(t or "").lower() for t in texts[first:last]]
        codes = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        alpha = _ALPHA[np.minimum(codes, 0xFFFF)]
        if (far := np.flatnonzero(codes > 0xFFFF)).size:
            alpha = alpha.copy()
            alpha[far] = [chr(c).isalpha() for c in codes[far]]
        stay = alpha.copy()
        stay[1:] |= alpha[:-1]                 # one space after each run of letters
        stay[0] = True
        place = np.cumsum(stay) - 1            # in the shortened sequence
        c = np.where(alpha, codes, 32)[stay].astype(np.uint64)
        if len(c) >= 3:
            h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
            h = ((h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) >> np.uint64(49)).astype(np.int64)
        begin = 0
        for k, t in enumerate(lower):
            a, b = place[begin], place[begin + len(t) + 1]      # the spaces before and after the text
            own = h[a:b - 1] if b - a >= 2 else None
            yield first + k, own if own is not None and len(own) else None
            begin += len(t) + 1
        first = last


def _fit(p: np.ndarray, w: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` that make groups of weight ``w`` likely, and that log-likelihood."""
    total = w.sum()
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds if p.shape[1] > 1 else 0):
        share = share * ((w / (p @ share)) @ p) / total
    return share, float(w @ np.log(p @ share))


def mixture(groups: np.ndarray, model: Model) -> tuple[np.ndarray, list[int]]:
    """Smoothed proportions of all languages, and the selected set, the largest share first."""
    counts = np.bincount(groups, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    p, w = model.table[used], counts[used].astype(float)
    share, _ = _fit(p, w, ROUNDS)
    order = np.argsort(-share, kind="stable")
    few = [int(k) for k in order if share[k] >= 0.02] or [int(order[0])]
    fee = PENALTY * np.log(len(groups) + 1)
    singles = np.log(p[:, few]).T @ w
    best = few[int(np.argmax(singles))]
    chosen, own, value = [best], np.ones(1), float(singles.max())
    for size in range(2, len(few) + 1):
        s, likely = _fit(p[:, few[:size]], w, 2 * ROUNDS)
        if likely - fee * (size - 1) <= value - fee * (len(chosen) - 1):
            break
        rank = np.argsort(-s, kind="stable")
        chosen, own, value = [few[k] for k in rank], s[rank], likely
    out = np.zeros(len(model.names))
    out[chosen] = own
    return (out * len(groups) + 1 / len(out)) / (len(groups) + 1), chosen


def train(docs: DataFrame, text: str = "text", lang: str = "lang", learn: Column | None = None) -> Model:
    """Count the letter groups of every document with a known language (those that ``learn`` picks), with partial sums per task.

    What reaches the driver is one count per bucket and language (32,768 buckets), however large the corpus.
    """
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, own in _groups(batch.column(1).to_pylist()):
                if own is not None:
                    sums.setdefault(names[row], np.zeros(BUCKETS, np.int64))
                    sums[names[row]] += np.bincount(own, minlength=BUCKETS)
        for name, n in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used.astype(np.int32)), pa.array(n[used])], ["lang", "bucket", "n"])

    known = docs.where(F.col(lang).isNotNull() & (F.lit(True) if learn is None else learn)).select(F.col(lang).cast("string"), F.col(text))
    got = (known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
           .toPandas())
    names = sorted(got["lang"].unique())
    table = np.full((BUCKETS, len(names)), SMOOTH)
    table[got["bucket"].to_numpy(int), np.searchsorted(np.array(names, object), got["lang"].to_numpy(object)) if names else []] += got["n"].to_numpy(float)
    return Model(names, table / table.sum(axis=0, keepdims=True))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``lang_shares``; columns of those names in ``docs`` give way.

    ``lang_shares`` maps the selected languages to their proportions, ``lang_pred`` is the largest (ties: first by name), ``score`` its
    smoothed proportion. Text that is null or has no letter is ``und`` with score 0 and no shares, and so is all text if no language is known.
    A very long text is counted whole, with some 30 bytes of memory a character; rows are independent, so repeated ones agree. The model's
    table has 32,768 numbers for each language.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        m = sent.value
        names, scores, shares = [], [], []
        for _, own in _groups(batch.column(batch.schema.get_field_index(text)).to_pylist()):
            if own is None or not m.names:
                names.append("und"), scores.append(0.0), shares.append([])
                continue
            share, chosen = mixture(own, m)
            names.append(m.names[chosen[0]]), scores.append(float(min(1.0, share[chosen[0]])))
            shares.append([(m.names[k], float(share[k])) for k in chosen])
        return {"lang_pred": names, "score": scores, "lang_shares": shares}

    return per_batch(docs, run, lang_pred="string", score="double", lang_shares="map<string,double>")
