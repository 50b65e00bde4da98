"""License scan: MinHash bands over overlapping windows of text retrieve templates, exact shingle containment verifies them.

Only DataFrame functions run here, and the rows of windows never leave generated code: a text's words are split once, every position
gives two neighbouring five-word shingles (a window of six words; each shingle is in two windows), and each of ``BANDS`` bands takes the
smaller of the two under its own order. The windows of the templates, at every offset, give the keys to look for: a table that is counted,
broadcast when it is small and shuffled otherwise, so templates may be of any number and length.

A template of two shingles or more shares a whole window with any text that contains it, so all bands collide. A template of one shingle
is missed by a band only if both neighbours in the text come before it, with probability 1/3: 3**-12 for twelve bands (2**-12 at a
text's edge).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statframe.llm.common import keep

# Notices by which public licenses are stated.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
           "conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                  "as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
#: Band keys, and shingles of templates, up to which their tables are broadcast.
BROADCAST_KEYS = 200_000
SIZE = 5
BANDS = 12
CONTAINMENT = 0.8
# ASCII that is neither a digit nor a small letter
_NOT_WORD = "[\\x00-/:-`{-\\x7f]+"
_ORDERS = [int(x) for x in np.random.default_rng(7).integers(-2**63, 2**63, BANDS, dtype=np.int64)]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _NOT_WORD), "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _gram(hashes: Column, at: Column) -> Column:
    """Hash of the five words from a position on."""
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(SIZE)])


def _grams(hashes: Column) -> Column:
    """All of them; none of a shorter text."""
    return F.when(F.size(hashes) >= SIZE, F.transform(F.sequence(F.lit(0), F.size(hashes) - SIZE), lambda i: _gram(hashes, i)))


def _windows(df: DataFrame, hashes: str, keep_: list[str]) -> DataFrame:
    """A row for each window: its two shingles (twice the same in a text of one).

    The second generator computes each shingle once: what follows reads its columns.
    """
    h, at = F.col(hashes), F.col("at")
    places = F.when(F.size(h) >= SIZE, F.sequence(F.lit(0), F.greatest(F.size(h) - SIZE - 1, F.lit(0))))
    pair = F.struct(_gram(h, at).alias("x"), _gram(h, F.least(at + 1, F.size(h) - SIZE)).alias("y"))
    return df.select(*keep_, h, F.explode(places).alias("at")).select(*keep_, F.inline(F.array(pair)))


def _bands(x: Column, y: Column) -> list[Column]:
    """The smaller of two shingles under the order of each band."""
    return [F.least(x.bitwiseXOR(F.lit(c)), y.bitwiseXOR(F.lit(c))) for c in _ORDERS]


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``template, grams, reach``: distinct shingles, and how many positions a match may span (a quarter more than the template has)."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string").withColumn("w", _hashes(_words(F.col("text"))))
    return rows.withColumn("all", _grams(F.col("w"))).withColumn("grams", F.array_distinct("all")).withColumn("reach", (F.size("w") - SIZE + 1) + F.floor((F.size("w") - SIZE + 1) / 4).cast("int"))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT,
         broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with ``licenses``: (template, share) of every template found, by name; a column of that name in ``docs`` gives way.

    A template is found when some stretch of the text, a quarter longer than the template at most, holds at least ``containment`` of its
    distinct five-word shingles; ``share`` is the largest such share. Words are runs of letters, digits and non-ASCII in lower case.
    Null, empty and short texts hold none. Rows are independent of each other: they are told apart by a 64-bit hash of ``id`` and text, so repeated
    rows are scanned once and agree. A very long text is one array of words in one task. Templates need at least five words.
    """
    spark = docs.sparkSession
    sizes = {k: len([w for w in "".join(c if c.isalnum() else " " for c in t).split()]) for k, t in templates.items()}
    if min(sizes.values(), default=SIZE) < SIZE:
        raise ValueError(f"templates need {SIZE} words each")
    own = keep(_templates(spark, templates))

    def small(table: DataFrame, size: int) -> DataFrame:
        return F.broadcast(table) if size <= broadcast_keys else table.hint("merge")

    x, y = F.col("x"), F.col("y")
    # each band has its own order, so that a key tells its band
    keys = keep(_windows(own, "w", ["template"]).select("template", F.explode(F.array(*_bands(x, y))).alias("key")).distinct())
    row = F.xxhash64(F.col(id).cast("string"), F.col(text)).alias("__row")
    hashed = docs.select(row, _words(F.col(text)).alias("w")).select("__row", _hashes(F.col("w")).alias("h"))
    met = (_windows(hashed, "h", ["__row"]).select("__row", F.explode(F.array(*_bands(x, y))).alias("key"))
           .join(small(keys, keys.count()), "key").select("__row", "template").distinct())
    candidates = keep(met)

    # the candidates' texts again: containment in the stretch that begins at each shingle of the template
    texts = docs.select(row, F.col(text).alias("t")).join(candidates.select("__row").distinct(), "__row").dropDuplicates(["__row"])
    placed = (texts.select("__row", _hashes(_words(F.col("t"))).alias("h")).select("__row", _grams(F.col("h")).alias("all"))
              .join(candidates, "__row").join(small(own.select("template", "grams", "reach"), sum(sizes.values())), "template")
              .where(F.size(F.array_intersect("all", "grams")) / F.size("grams") >= containment))      # no stretch holds more than the text
    starts = F.filter(F.sequence(F.lit(1), F.size("all")), lambda i: F.array_contains(F.col("grams"), F.get(F.col("all"), i - 1)))
    shared = F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(F.col("all"), i, F.col("reach")), F.col("grams"))))
    found = (placed.select("__row", "template", (F.array_max(shared) / F.size("grams")).alias("share")).where(F.col("share") >= containment)
             .groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("template", "share"))).alias("__found")))
    rest = [c for c in docs.columns if c.lower() != "licenses"]
    return (docs.withColumn("__row", row).join(found, "__row", "left")
            .select(*rest, F.coalesce("__found", F.array().cast("array<struct<template:string,share:double>>")).alias("licenses")))
