"""Corpus pipeline: stages over ``documents``, each reading what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statframe.llm import codec, quality
from statframe.llm.common import keep, read, ship
from statframe.llm.decontaminate import decontaminate
from statframe.llm.jaccard import jaccard_components
from statframe.llm.line_dedup import dedup_lines

#: Documents with a lower score are rejected.
ACCEPT = 0.7
#: Near copies share at least 0.8 of their five-word shingles (op9 has a contract of its own: four words, 0.85).
NEAR = {"size": 5, "num": 80, "den": 100}


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(spark)
    model = quality.train(docs, read(spark, sf_dir, "labels"), learn=~quality.held_out("doc_id"))
    return quality.score(docs, model).where(F.col("score") >= ACCEPT).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    ship(spark)
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by their shingles (``NEAR``) the one with the smallest id and text hash stays, once.

    Rows are told apart by id and text. Rows without an id or without words stay.
    """
    ship(spark)
    part = keep(jaccard_components(docs, **NEAR, rows=True).where("first is not null")
                .groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.min("first").alias("__first"), F.count("*").alias("__rows")))
    own, on = docs.withColumn("__d", F.xxhash64("text")), [F.col("doc_id").cast("long") == F.col("__id"), F.col("__d") == F.col("__digest")]
    once = own.join(part.where("not __first or __rows > 1"), on, "left_anti").select(*docs.columns)
    again = keep(part.where("__first and __rows > 1"))
    if again.isEmpty():
        return once
    again = own.join(again, on).groupBy("__id", "__digest").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(again.select("row.*"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    ship(spark)
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as piece ids."""
    ship(spark)
    out = codec.encode(docs)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", classify), ("line dedup", lines), ("n-gram Jaccard join", copies),
          ("benchmark decontamination", benchmark), ("SentencePiece encoding", encode)]

#: The classifier is trained and the encoder searches for a best path; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs)
    return docs
