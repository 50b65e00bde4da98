"""Quality classifier by compression: a zstandard dictionary of good text against one of bad text.

The dictionaries and the calibration come from a bounded sample of labelled documents (``rows`` of each class for either, chosen by
the hash of their ids; at most ``pieces`` pieces of a document enter a dictionary). Scoring reads whole texts: every piece of 2 KB is
compressed with both dictionaries, and the difference of the summed sizes per byte is turned into a probability by a logistic curve.
Scoring is a narrow job: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statframe.llm.common import keep, per_batch

PIECE = 2048
DICTIONARY = 112_640
LEVEL = 3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    offset: float


def held_out(id: str) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _pieces(text: bytes) -> list[bytes]:
    return [text[a:a + PIECE] for a in range(0, len(text), PIECE)]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of samples too few or too small to train on, their own end."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d)


def size_difference(texts: Iterable[bytes | None], good: bytes, bad: bytes) -> np.ndarray:
    """(size with the bad dictionary - size with the good one) / bytes of text; 0 for null and empty texts."""
    a, b = _compressor(good), _compressor(bad)
    out = []
    for text in texts:
        text = text or b""
        out.append(sum(len(b.compress(p)) - len(a.compress(p)) for p in _pieces(text)) / max(1, len(text)))
    return np.array(out, float)


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve with a small ridge on the slope (in units of the spread of x), classes weighted to ``prior``."""
    if len(x) == 0 or y.min() == y.max():
        return 0.0, float(np.log(prior / (1 - prior)))
    spread = x.std() or 1.0
    z = x / spread
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    a, b = 0.0, float(np.log(prior / (1 - prior)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        q = weight * p * (1 - p)
        grad = np.array([(weight * (y - p) * z).sum() - 0.1 * a, (weight * (y - p)).sum()])
        step = np.linalg.solve(np.array([[(q * z * z).sum() + 0.1, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-9]]), grad)
        step = np.clip(step, -3, 3)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a / spread), float(b)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = 1500, pieces: int = 4, learn: Column | None = None) -> Model:
    """Fit the two dictionaries and the curve on at most ``2 * rows`` documents of each class.

    ``labels`` has one 0/1 ``label`` per id; several rows of an id are averaged, ties and nulls left out. ``learn`` picks the ids that
    may be learned from. Without labelled documents of both classes every score is the share of class 1 (0.5 without any).
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1) & (F.lit(True) if learn is None else learn))
    known = (known.groupBy(F.col(id).alias("__id")).agg(F.avg(label).alias("m")).where("m <> 0.5")
             .select("__id", (F.col("m") > 0.5).cast("int").alias("__y"), F.xxhash64(F.lit("quality"), "__id").alias("__h")))
    counts = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    prior = (n1 + 1) / (n0 + n1 + 2)
    chosen = [known.where(F.col("__y") == y).orderBy("__h", "__id").limit(2 * rows) for y in (0, 1)]
    # at most 4 * rows ids: small enough to send to every task
    sample = keep(docs.select(F.col(id).alias("__id"), F.col(text).cast("binary").alias("__t"))
                  .join(F.broadcast(chosen[0].unionByName(chosen[1])), "__id")
                  .select("__id", "__y", F.coalesce("__t", F.lit(b"")).alias("__t"), F.pmod("__h", F.lit(2)).alias("half")))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _pieces(value)
                at = np.unique(np.linspace(0, len(own) - 1, min(pieces, len(own))).astype(int)) if own else []
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(at), pa.int32()), pa.array([own[k] for k in at], pa.binary())], ["y", "p"])

    got = sample.where("half = 0").select("__y", "__t").mapInArrow(cut, "y int, p binary").orderBy("y", F.xxhash64("p"), "p").toPandas()
    good, bad = (_dictionary([bytes(p) for p in got.loc[got["y"] == y, "p"]]) for y in (1, 0))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size_difference(batch.column(1).to_pylist(), good, bad))], ["y", "x"])

    curve = sample.where("half = 1").select("__y", "__t").mapInArrow(measure, "y int, x double").orderBy("y", "x").toPandas()
    return Model(good, bad, *_logistic(curve["x"].to_numpy(float), curve["y"].to_numpy(float), prior))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is better); a column of that name in ``docs`` gives way. Null and empty texts get the curve's
    value at 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        m = sent.value
        x = size_difference(batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist(), m.good, m.bad)
        return {"score": 1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30)))}

    return per_batch(docs, run, score="double")
