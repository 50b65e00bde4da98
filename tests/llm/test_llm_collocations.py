"""Phrase mining against counts of every phrase by plain loops."""

import random
import re
from collections import Counter, defaultdict

import pytest

from statframe.llm import collocations
from statframe.llm.collocations import mine

SCHEMA = "doc_id long, lang string, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counted(rows, longest, least):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    return {k: c for k, c in f.items() if c >= least}, n


def ranked(f, n, top, share, scale=1000):
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or any(q != p and l2 == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                             for (l2, q), b in f.items()):
            continue
        score, k = min((scale * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, own in out.items()
                  for rank, (score, a, p, l, r) in enumerate(sorted(own)[:top], 1))


def text(r, vocabulary, words):
    out = []
    for _ in range(words):
        out.append(r.choice(vocabulary))
        out.append(r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r\n", "! "]))
    return "".join(out)


@pytest.fixture(scope="module")
def table():
    r = random.Random(5)
    vocabulary = ["a", "b", "The", "the", "é", "É", "x\x00y", "日本", "long" * 12, "c-d", "'q'", "\xa0"]
    rows = [(k, r.choice(["en", "en", "de", None, ""]), text(r, vocabulary[: r.choice([2, 5, 12])], r.randrange(0, 60))) for k in range(150)]
    return rows + [(200, "en", None), (201, None, ""), (202, "de", " . , \t"), (203, "en", "a b the a b the a b the " * 40), (203, "en", "a b the a b the " * 9)] * 2


@pytest.mark.parametrize("sample, chunk, longest, least", [(0.5, 1 << 21, 5, 6), (0.001, 64, 5, 4), (1.0, 50, 3, 9), (0.05, 300, 2, 3)])
def test_all_frequent_phrases_are_counted_whatever_the_sample(spark, table, sample, chunk, longest, least):
    found, words = mine(spark.createDataFrame(table, SCHEMA).repartition(3), longest=longest, least=least, sample=sample, chunk=chunk)
    f, n = counted(table, longest, least)
    assert {(x["lang"], tuple(x["phrase"].split(" "))): x["f"] for x in found.collect()} == f
    assert {x["lang"]: x["n"] for x in words.collect()} == {k: c for k, c in n.items() if c}


@pytest.mark.parametrize("top, share", [(2000, 100), (5, 60)])
def test_scores_cuts_and_inner_phrases(spark, table, top, share):
    got = collocations.collocations(spark.createDataFrame(table, SCHEMA), longest=5, least=5, top=top, share=share, sample=0.2, chunk=500)
    want = ranked(*counted(table, 5, 5), top, share)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_border_failures_open_longer_phrases_pass_by_pass(spark, monkeypatch):
    # an empty sample proposes nothing: two-word phrases come by the first pass over failures, each longer length by one more
    passes, walk = [], collocations._walk
    monkeypatch.setattr(collocations, "_walk", lambda *a, **k: passes.append(a[1]) or walk(*a, **k))
    rows = [(k, "en", "one two three four five six") for k in range(12)]
    found, _ = mine(spark.createDataFrame(rows, SCHEMA), least=10, sample=1e-9)
    assert {x["phrase"] for x in found.collect()} == {" ".join("one two three four five six".split()[i:i + m]) for m in range(1, 6) for i in range(7 - m)}
    assert passes[-4:] == [range(1, 6), range(2, 6), range(2, 6), range(2, 6)]


def test_products_beyond_64_bits_are_exact(spark, monkeypatch):
    a, l, r, n = 4_000_000_000_000_003, 5_000_000_000_000_007, 6_000_000_000_000_011, 900_000_000_000_000_017
    found = spark.createDataFrame([("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)], "lang string, m int, phrase string, f long")
    monkeypatch.setattr(collocations, "mine", lambda *_, **__: (found, spark.createDataFrame([("en", n)], "lang string, n long")))
    assert [tuple(x) for x in collocations.collocations(None).collect()] == [("en", 1, "x y", a, l, r, n, 1000 * a * n // (l * r))]


def test_empty_tables_and_clashing_columns(spark):
    rows = [(k, "en", "some words go here, some words go there") for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert collocations.collocations(df.limit(0)).count() == 0 and collocations.collocations(spark.createDataFrame([(1, None, None)], SCHEMA)).count() == 0
    more = df.selectExpr("*", "1 as key", "2 as m", "3 as phrase", "4 as a", "5 as n", "6 as f", "7 as rank", "8 as score")
    got = sorted(map(tuple, collocations.collocations(more, least=20).collect()))
    assert got == ranked(*counted(rows, 5, 20), 2000, 100)
