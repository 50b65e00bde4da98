"""Merkle manifest against the same rules written as plain loops."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from statframe.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(nodes, fan):
    """Digest of the top, and for each node the (left, right) texts of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf_no, k in enumerate(at):
            a = k // fan * fan
            paths[leaf_no].append(("".join(nodes[a:k]), "".join(nodes[k + 1:a + fan])))
        at = [k // fan for k in at]
        nodes = [h("".join(nodes[a:a + fan])) for a in range(0, len(nodes), fan)]
    return nodes[0], paths


def brute(rows, fan=16):
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = [], []
    for s in groups:
        own = sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, leaf(x)))
        top, paths = climb([leaf(x) for x in own], fan)
        tops.append(top)
        inner.append((own, paths))
    root, over = climb(tops, fan)
    return sorted(((x[0], x[1], leaf(x), top, root, p + up) for top, up, (own, paths) in zip(tops, over, inner) for x, p in zip(own, paths)), key=str)


def got(df, **kw):
    out = merkle.manifest(df, **kw)
    return sorted(((r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], [(s["left"], s["right"]) for s in r["proof"]]) for r in out.collect()), key=str)


def table(sizes):
    return [(k, s, None if k % 5 == 0 else "en", k if k % 3 else None, None if k % 7 == 0 else "Ü" * (k % 4)) for s, n in sizes.items() for k in range(n)]


@pytest.mark.parametrize("fan, digits, sizes", [
    (16, 2, {"a": 1, None: 16, "b": 17, "ä": 257, "": 2}), (2, 1, {"x": 9, "y": 1, "z": 2}), (2, 3, {str(k): k for k in range(1, 19)}),
    (3, 2, {"one": 82, "two": 81, "three": 80, "four": 28, "five": 27}), (16, 2, {"only": 1}), (2, 2, {"only": 7}), (16, 2, {f"s{k}": 1 for k in range(40)})])
def test_manifest_is_the_tree_of_its_definition(spark, fan, digits, sizes):
    rows = table(sizes)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), fan=fan, digits=digits) == brute(rows, fan)


def test_one_group_holds_nearly_all_rows_in_any_partitions(spark):
    rows = table({"hot": 900, "cold": 3})
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df.repartition(13)) == got(df.coalesce(1)) == brute(rows)


def test_repeated_ids_identical_rows_nulls_and_clashing_columns(spark):
    rows = [(1, "a", "en", 1, "x")] * 20 + [(1, "a", "en", 1, "y"), (None, "a", None, None, None), (None, "a", None, None, None), (None, None, None, None, ""),
                                            (2, "a", "en", 9, "long " * 40_000), (-3, "a", "", 0, "\x00 null byte")]
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.select("*", *[F.lit(7).alias(c) for c in ("g", "r", "h", "top", "proof", "leaf", "root", "__at", "__part", "carried")])
    assert got(more) == brute(rows)
    assert merkle.manifest(df.limit(0)).count() == 0


def test_tampered_leaves_fail_and_others_lead_to_the_root(spark):
    rows = table({"a": 40, "b": 5})
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA), carry=["n_chars"])
    folded = out.select("n_chars", (merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"),
                        (merkle.fold(F.sha2(F.lit("other").cast("binary"), 256), F.col("proof")) == F.col("root")).alias("bad")).collect()
    assert len(folded) == 45 and all(x["ok"] and not x["bad"] for x in folded)
    assert sorted(str(x["n_chars"]) for x in folded) == sorted(str(x[3]) for x in rows)
