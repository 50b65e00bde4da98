"""The signature join against all pairs by plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from statframe.llm import signatures
from statframe.llm.signatures import near_duplicates


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size=4, num=80, den=100):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return Counter((d, len(s), *((None, None) if d is None else (least[find(k)], least[find(k)] == d))) for k, ((d, _), s) in enumerate(zip(rows, sets)))


def got(spark, rows, **how):
    return Counter(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()))


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        at = r.randrange(len(words))
        words[at:at + 1] = r.choice([[], [f"new{r.randrange(10**6)}"], [words[at], f"ins{r.randrange(10**6)}"]])
    return words


@pytest.mark.parametrize("block, list_block, piece", [(256, 512, 1 << 16), (3, 2, 5)])
def test_components_are_those_of_all_pairs(spark, block, list_block, piece):
    r = random.Random(block)
    passage = [f"p{k}" for k in range(60)]                   # many texts share it, and most of each is something else
    rows = []
    for g in range(12):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(r.choice([5, 8, 30, 150]))] + (passage if g % 3 == 0 else [])
        rows += [(r.randrange(10**6), r.choice([" ", "\n", "\t "]).join(edited(r, base, r.randrange(0, max(2, len(base) // 10))))) for _ in range(r.choice([1, 2, 9, 40]))]
    rows += [(2000 + k, " ".join(passage + [f"own{k}x{j}" for j in range(r.randrange(5, 30))])) for k in range(40)]
    rows += [(k, x) for k, x in enumerate(["", None, " \n", "one", "ONE", "one two", "two one", "a b c", "a b c d", "A b c d ", "a b c d e"])]
    rows += rows[:5] + [(None, rows[0][1]), (None, rows[0][1]), (None, None)]
    r.shuffle(rows)
    assert got(spark, rows, block=block, list_block=list_block, piece=piece) == brute(rows)


def test_pairs_at_the_threshold(spark):
    rows = []
    for k in range(40):                                      # 8 of 10 shingles are shared: linked; 7 of 9: not
        w = [f"d{k}w{j}" for j in range(12)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(w[:11] + [f"other{k}"])), (10 * k + 2, " ".join(w[:10] + ["q", f"r{k}"]))]
    assert got(spark, rows) == brute(rows)


def test_one_group_of_near_copies_and_one_of_copies_hold_most_rows(spark):
    r = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(edited(r, base, 2))) for k in range(250)] + [(1000 + k, "the very same text in each of these rows") for k in range(300)]
    assert got(spark, rows, block=16, list_block=8, piece=20) == brute(rows)


def test_repeated_ids_are_texts_of_their_own_and_other_settings(spark):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(7, one), (7, two), (3, two + " more"), (9, one + " more"), (7, one), (8, "short one"), (8, "short one")]
    assert got(spark, rows) == brute(rows)
    # three-word shingles at one half need another number of collisions
    assert got(spark, rows + [(5, one[:60])], size=3, num=50, matches=30) == brute(rows + [(5, one[:60])], 3, 50)


def test_long_texts_empty_tables_and_clashing_columns(spark):
    long = " ".join(f"w{k % 70_000}" for k in range(90_000))
    rows = [(1, long), (2, long + " end"), (3, "spam " * 50_000), (4, "spam " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"1 as {c}" for c in ("a", "b", "d", "n", "t", "one", "low", "root", "token")])
    assert sorted(map(tuple, near_duplicates(df).collect())) == [(1, 70_000, 1, True), (2, 70_001, 1, False), (3, 1, 3, True), (4, 1, 3, False)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_a_coordinate_collides_as_often_as_the_sets_are_alike():
    r = np.random.default_rng(1)
    hits = []
    for n in (5, 50, 700):
        for _ in range(60):
            x = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
            shared = 8 * n // 10
            a, b = x[:n], np.r_[x[:shared], x[n:2 * n - shared]]
            hits.append(((signatures.minima(a) == signatures.minima(b)).mean(), shared / (2 * n - shared)))
    seen, true = np.array(hits).T
    assert abs((seen - true).mean()) < 0.01
