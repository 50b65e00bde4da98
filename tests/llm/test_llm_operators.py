"""Corpus operators on small tables: brute force, round trips, held-out accuracy, and awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from statframe.llm import chat, codec, language, licences, quality, tokens, topk, unigram
from statframe.llm.decontaminate import decontaminate, find_matches
from statframe.llm.graph import components
from statframe.llm.jaccard import jaccard_components
from statframe.llm.line_dedup import dedup_lines

LINE = "This line has more than forty characters, for sure."


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


# ------------------------------------------------------------------ 1 lines
@pytest.mark.parametrize("heavy", [1, 4096])
def test_lines_follow_their_definition(spark, heavy):
    r = random.Random(heavy)
    pool = [f"  line number {k} with a tail that makes it long enough {'x' * (k % 9)}" for k in range(30)] + ["short", "", LINE]
    data = [(k, "\n".join(r.choice([x, x.upper(), x + "\t"]) for x in r.choices(pool, k=r.randrange(0, 9)))) for k in range(120)] + [(500, None), (None, LINE)]
    got = dedup_lines(frame(spark, data), heavy=heavy, shard_probes=64)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for d, t in data:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 40:
                    held[key(x)].add(d)
    want = []
    for d, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held.get(key(x), ())) < 5 or max(held[key(x)]) == d]
        want.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert rows(got, "doc_id", "text", "n_lines", "n_dropped") == sorted(want, key=str)


def test_lines_of_repeated_ids_and_clashing_columns(spark):
    data = [(k % 3, LINE, "a", 7) for k in range(9)] + [(9, LINE, "b", 7), (10, "x", "c", 7)]
    df = frame(spark, data, "doc_id long, text string, h string, n_lines int")
    got = dedup_lines(df, min_docs=4)
    assert got.columns == ["doc_id", "text", "h", "n_lines", "n_dropped"]
    assert [(d, t, n) for d, t, n in rows(got, "doc_id", "text", "n_dropped") if d < 9] == [(k % 3, "", 1) for k in sorted(range(9), key=lambda k: k % 3)]
    assert rows(got.where("doc_id >= 9"), "text", "n_dropped") == [(LINE, 0), ("x", 0)]
    assert dedup_lines(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 2 chat
def test_chat_reads_back_in_any_windows(spark, monkeypatch):
    r = random.Random(3)
    data = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([None, "", "### a </turn> \\", "word " * r.randrange(1, 60)]))
            for c in range(40) for t in range(r.randrange(1, 12))] + [(None, 0, "user", "x")] + [(77, k, "assistant", f"turn {k}") for k in range(600)]
    data += [(78, 1, "user", "same")] * 3
    monkeypatch.setattr(chat, "HELD", 50)
    windows = chat.format_windows(frame(spark, data, "conv_id long, turn long, role string, text string"), budget=120)
    got = {x["conv_id"]: x for x in chat.read_back(windows).collect()}
    by = defaultdict(list)
    for c, t, role, text in data:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert got[c]["n_turns"] == len(turns)
        if len({t for t, *_ in turns}) == len(turns):
            said = "".join(f"{role}\n{x}\n" for _, role, x in sorted(turns))
            loss = "".join(x for _, role, x in sorted(turns) if role == "assistant")
            assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
            assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["loss_chars"] == len(loss)
    assert got[77]["formatted_chars"] > sum(len(chat.render("assistant", f"turn {k}")[0]) for k in range(600))
    long = [w for w in windows.where("conv_id = 77").collect()]
    assert len(long) > 10 and all(w["n_tokens"] <= 120 for w in long) and sum(w["repeated"] for w in long) > 0
    # windows chosen in one go are the same
    monkeypatch.setattr(chat, "HELD", 1 << 16)
    again = chat.format_windows(frame(spark, data, "conv_id long, turn long, role string, text string"), budget=120)
    assert rows(again.where("conv_id < 78"), "conv_id", "window", "text") == rows(windows.where("conv_id < 78"), "conv_id", "window", "text")


def test_chat_keeps_the_system_turn_and_masks_repeats(spark):
    data = [(1, 0, "system", "be kind"), *[(1, k, "assistant" if k % 2 == 0 else "user", f"said {k} " * 8) for k in range(1, 9)]]
    got = chat.format_windows(frame(spark, data, "conv_id long, turn long, role string, text string"), budget=90).orderBy("window").collect()
    assert len(got) > 1 and all(chat.parse(w["text"])[0] == ("system", "be kind") for w in got)
    targets = [w["text"][m["start"]:m["end"]] for w in got for m in w["loss"]]
    assert targets == [f"said {k} " * 8 for k in (2, 4, 6, 8)]
    assert chat.format_windows(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


# ------------------------------------------------------------------ 3 language, 5 quality
def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality.held_out("doc_id")
    model = language.train(docs, learn=~out)
    got = language.predict(docs.withColumn("out", out), model).where("out")
    assert got.where("lang_pred = lang").count() / got.count() > 0.98


def test_language_of_awkward_rows(spark):
    docs = frame(spark, [(1, "the cat and the dog", "en", "k"), (2, "der Hund und die Katze", "de", "k"), (3, None, "en", "k"), (4, "", None, "k"), (5, "12 !", "de", "k"),
                         (6, "the dog and the cat", None, "k"), (6, "the dog and the cat", None, "k")], "doc_id long, text string, lang string, score string")
    got = {x["doc_id"]: x for x in language.predict(docs, language.train(docs)).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 4, 5, 6)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[3]["score"] == 0
    none = language.predict(docs, language.train(docs.where("doc_id > 9"))).collect()
    assert {x["lang_pred"] for x in none} == {"und"} and len(none) == 7
    assert language.predict(docs.limit(0), language.train(docs)).count() == 0


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.held_out("doc_id")
    got = quality.score(docs.withColumn("out", out), quality.train(docs, labels, learn=~out)).join(labels, "doc_id").where("out").toPandas()
    good, bad = got.loc[got["quality"] == 1, "score"].to_numpy(), got.loc[got["quality"] == 0, "score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9


def test_quality_of_awkward_rows(spark):
    docs = frame(spark, [(k, f"plain words number {k} in a row " * 9) for k in range(40)] + [(k, f"X{k}!! $$$ ### " * 30) for k in range(40, 80)]
                 + [(90, None), (91, ""), (92, "same"), (92, "same"), (None, "none")])
    labels = frame(spark, [(k, int(k < 40)) for k in range(80)] + [(0, 0), (1, 1), (500, 1), (None, 1), (90, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {x["doc_id"]: x["score"] for x in quality.score(docs, model).collect()}
    assert np.mean([got[k] > 0.5 for k in range(2, 40)]) > 0.9 and np.mean([got[k] < 0.5 for k in range(40, 80)]) > 0.9
    assert got[90] == got[91] and all(0 <= x <= 1 for x in got.values())
    one = quality.train(docs, labels.where("quality = 1"))
    assert len({round(x["score"], 9) for x in quality.score(docs, one).collect()}) == 1
    assert quality.score(docs.limit(0), model).count() == 0
    assert {x["score"] for x in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}


# ------------------------------------------------------------------ 4 decontamination
def test_decontamination_of_awkward_rows(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    docs = frame(spark, [(1, f"Before {passage.upper()}, after", 5), (2, "w1 w2 w3", 5), (3, None, 5), (4, "", 5), (5, f"x {passage[:60]}", 5), (5, "tiny ITEM!", 5), (5, "tiny ITEM!", 5)],
                 "doc_id long, text string, matches int")
    items = frame(spark, [(10, passage), (11, "tiny item"), (12, None), (13, "?!"), (None, "w1 w2"), (14, "never met"), (11, "w2 w3")], "item_id long, text string")
    for words in (10**6, 8):
        got = find_matches(docs, items, block_words=words)
        assert got.columns == ["doc_id", "text", "n_words", "n_hit", "matches"]
        seen = {(x["doc_id"], x["text"]): x for x in got.collect()}
        assert [(m["item"], m["item_word"], m["word"], m["words"]) for m in seen[1, f"Before {passage.upper()}, after"]["matches"]
                if m["item"] == "10"] == [("10", 0, 1, 30)]
        assert seen[1, f"Before {passage.upper()}, after"]["n_hit"] == 30 and seen[2, "w1 w2 w3"]["n_hit"] == 2 and seen[5, "tiny ITEM!"]["n_hit"] == 2
        assert seen[3, None]["n_words"] == 0 and not seen[4, ""]["matches"]
    assert rows(decontaminate(docs, items), "doc_id") == [(3,), (4,)]
    assert decontaminate(docs, items.limit(0)).count() == 7 and find_matches(docs.limit(0), items).count() == 0


def test_decontamination_of_text_that_repeats_itself(spark):
    long = "a " * 20_000
    got = {x["doc_id"]: x for x in find_matches(frame(spark, [(1, long), (2, "b " + long + "b"), (3, "a " * 9)]), frame(spark, [(7, long), (8, "a " * 12)], "item_id long, text string")).collect()}
    assert [(got[k]["n_words"], got[k]["n_hit"]) for k in (1, 2, 3)] == [(20_000, 20_000), (20_002, 20_000), (9, 0)]
    assert max(m["words"] for m in got[2]["matches"]) == 20_000 and {m["item"] for m in got[1]["matches"]} == {"7", "8"} and not got[3]["matches"]


# ------------------------------------------------------------------ 6 top-k
def test_top_k_of_awkward_rows(spark):
    r = np.random.default_rng(6)
    data = [(k, [float(x) for x in r.normal(size=6)]) for k in range(150)]
    data += [(200 + k, data[0][1]) for k in range(40)] + [data[3], (300, None), (301, []), (302, [None] * 6), (303, [float("nan")] * 6), (304, [1.0, 2.0]), (None, data[1][1])]
    df = frame(spark, data, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for x in topk.top_k(df, lambda i: i % 50 == 0, block=32, per_block=2, table=3).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    ints = {k: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for k, v in data if k is not None and k not in (300, 301, 302, 303, 304)}
    assert set(got) == {k for k in ints if k % 50 == 0}
    for q, own in got.items():
        assert own == sorted(((k, int(v @ ints[q])) for k, v in ints.items() if k != q), key=lambda x: (-x[1], x[0]))[:5]
    assert topk.top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert topk.top_k(frame(spark, [(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"), lambda i: i == 0).collect()[0]["vec_id"] == 1


def test_top_k_guards_and_large_components(spark):
    big = frame(spark, [(k, [float(2**24 + k), -float(2**20), 3.5]) for k in range(60)], "vec_id long, embedding array<double>")
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.top_k(big, lambda i: i % 50 == 0, scale=1, block=8, pivots=3).collect()}
    assert got[0, 1] == (59, 2**24 * (2**24 + 59) + 2**40 + 9) and got[50, 5] == (55, (2**24 + 50) * (2**24 + 55) + 2**40 + 9)
    with pytest.raises(Exception, match="may not fit"):
        topk.top_k(frame(spark, [(0, [2.0**40]), (1, [1.0])], "vec_id long, embedding array<double>"), lambda i: i == 0).count()


# ------------------------------------------------------------------ 7, 8 tokens
TEXTS = ["", None, "the intention", " a  b ▁c\n\n x\t", "héllo 😀 中文 ▁▁", "ha" * 90, "▁" * 70, " " * 50, "word " * 40, "the" * 60,
         "中文没有空格的一行文字" * 20, "ภาษาไทยไม่มีช่องว่าง" * 12, "aGVsbG8gd29ybGQ0ZXN0" * 15, "中a" * 100]


def test_token_counts_are_those_of_the_codec(spark):
    df = frame(spark, [(k, t, k) for k, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_tokens long")
    v = unigram.load(tokens.MODEL)
    for x in codec.encode(tokens.token_counts(df)).collect():
        whole = unigram.SPACE + unigram.normal(x["text"] or "")
        want = unigram.trace(v, whole, unigram.segment(v, whole)[1], len(whole))[0] if x["text"] else []
        assert x["ids"] == want and x["n_tokens"] == len(want)
    assert tokens.token_counts(df.limit(0)).count() == 0


@pytest.mark.parametrize("giant, chunk, span", [(40, 64, 64), (20, 19, 3), (5, 7, 2)])
def test_chunked_encoding_equals_the_whole(spark, giant, chunk, span):
    df = frame(spark, [(k % 4, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = codec.decode(codec.encode(df, giant=giant, chunk=chunk, span=span)).collect()
    v = unigram.load(codec.MODEL)
    assert len(got) == len(TEXTS)
    for x in got:
        whole = unigram.SPACE + unigram.normal(x["text"] or "")
        assert x["ids"] == (unigram.trace(v, whole, unigram.segment(v, whole)[1], len(whole))[0] if x["text"] else [])
        assert x["decoded"] == (x["text"] or "")
    assert codec.encode(df.limit(0)).count() == 0


def test_decoding_of_null_empty_and_control_ids(spark):
    v = unigram.load(codec.MODEL)
    control = next(k for k, t in enumerate(v.text) if not t)
    ids = lambda t: unigram.trace(v, w := unigram.SPACE + unigram.normal(t), unigram.segment(v, w)[1], len(w))[0]
    rows = [(0, None), (1, []), (2, ids("héllo ▁中 😀")), (3, [control]), (4, [control, *ids(" a")]), (5, ids("b")), (6, None)]
    got = codec.decode(frame(spark, rows, "doc_id long, ids array<int>").coalesce(1)).collect()
    assert {x["doc_id"]: x["decoded"] for x in got} == {0: None, 1: "", 2: "héllo ▁中 😀", 3: "", 4: " a", 5: "b", 6: None}


# ------------------------------------------------------------------ 9 jaccard
def _brute(data):
    sets = []
    for _, t in data:
        w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and data[i][0] is not None and data[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(data, sets))]


@pytest.mark.parametrize("light", [None, 0, 24])
def test_jaccard_components_equal_all_pairs(spark, light):
    r = random.Random(9)
    data, k = [], 1000
    for size in (3, 4, 9, 12, 14, 17, 20, 24, 40, 80):
        for _ in range(4):
            base = [f"v{r.randrange(10**6)}" for _ in range(size)]
            for _ in range(r.randrange(1, 12)):
                own = list(base)
                for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                    own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
                own = own[r.randrange(2):]
                k -= 1
                data.append((k, " ".join(x.upper() if r.random() < 0.3 else x for x in own)))
    data += [(2000, None), (2001, ""), (2002, " \n"), (None, data[0][1]), (None, None), (5, data[3][1]), (5, "one two three four five")]
    got = jaccard_components(frame(spark, data), block=16, light_most=light)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(_brute(data), key=str)


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "4")
    yield
    spark.conf.set(name, old)


@pytest.mark.parametrize("light", [None, 0, 7, 24])
def test_jaccard_lists_cut_into_pieces_are_still_one_list(spark, small_batches, light):
    base = [f"w{k}" for k in range(10)]
    star = [(k, " ".join([*base, f"u{k}"])) for k in range(60, 100)] + [(200, " ".join(base))]          # linked through 200 only
    apart = [(k, " ".join(["p0 p1 p2 p3 p4 p5 p6 p7 p8 p9", f"u{k}"])) for k in range(300, 340)]        # linked with nothing
    long = [f"x{k}" for k in range(60)]
    heavy = [(k, " ".join([*long[:59], f"z{k}"])) for k in range(400, 440)]
    data = star + apart + heavy + [(7, None), (None, star[0][1]), (60, star[1][1])]
    got = jaccard_components(frame(spark, data), block=8, light_most=light, piece=8)
    want = sorted(_brute(data), key=str)
    assert rows(got, "doc_id", "n_shingles", "component_id") == want
    assert len({c for d, _, c in want if d is not None and d < 300 and d != 7}) == 1 and len({c for d, _, c in want if d and 300 <= d < 400}) == 40


def test_jaccard_of_an_empty_table(spark):
    assert jaccard_components(frame(spark, [])).count() == 0
    assert rows(jaccard_components(frame(spark, [(1, None)])), "doc_id", "n_shingles", "component_id") == [(1, 0, 1)]


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 300), (3, 2)]
    got = dict(components(frame(spark, edges, "u long, v long").repartition(5)).collect())
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 160)}
    assert components(frame(spark, [], "u long, v long")).count() == 0


# ------------------------------------------------------------------ 10 licenses
def test_licenses_of_awkward_rows(spark):
    header = licences.TEMPLATES["Apache-2.0-header"]
    edited = header.replace("except", "unless")
    docs = frame(spark, [(1, "x\nReleased under THE MIT license.\ny", 1), (2, f"{header} {licences.TEMPLATES['GPL-3.0']}", 1), (3, f"a b {edited} c", 1), (4, None, 1), (5, "", 1),
                         (6, "released under the MIT", 1), (None, "Released under the MIT License", 1), (7, "Released under the MIT License", 1), (7, "Released under the MIT License", 1)],
                 "doc_id long, text string, at int")
    got = licences.scan(docs)
    assert got.columns == ["doc_id", "text", "at", "licenses"] and got.count() == 9
    names = defaultdict(list)
    for x in got.collect():
        names[x["doc_id"]].append([(m["template"], round(m["share"], 3)) for m in x["licenses"]])
    words = len(re.findall("[a-z0-9]+", header.lower()))
    lost = round((words - 4 - 5) / (words - 4), 3)
    assert names[1] == [[("MIT", 1.0)]] and names[2] == [[("Apache-2.0-header", 1.0), ("GPL-3.0", 1.0)]]
    assert names[3] == ([[("Apache-2.0-header", lost)]] if lost >= 0.8 else [[]]) and names[4] == names[5] == names[6] == [[]]
    assert names[None] == [[("MIT", 1.0)]] and names[7] == [[("MIT", 1.0)]] * 2
    assert licences.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licences.scan(docs, templates={"short": "three words only"})


@pytest.mark.parametrize("broadcast_keys", [licences.BROADCAST_KEYS, 10])
def test_licenses_of_whole_texts(spark, broadcast_keys):
    r = random.Random(10)
    words = [f"t{r.randrange(10**9)}" for _ in range(6000)]
    cut = words[:2000] + ["edit"] + words[2001:5900]
    templates = {"long": " ".join(words), "MIT": licences.TEMPLATES["MIT"]}
    docs = frame(spark, [(1, " ".join(["lead", *words, "tail"])), (2, " ".join(cut)), (3, " ".join(words[:3000])), (4, f"x {templates['MIT']} y"), (5, None)])
    got = {x["doc_id"]: [(m["template"], round(m["share"], 4)) for m in x["licenses"]] for x in licences.scan(docs, templates=templates, broadcast_keys=broadcast_keys).collect()}
    assert got == {1: [("long", 1.0)], 2: [("long", round(5891 / 5996, 4))], 3: [], 4: [("MIT", 1.0)], 5: []}


def test_licenses_retrieve_by_bands_only(spark):
    plan = licences.scan(frame(spark, [(1, "a b c d e f")]))._jdf.queryExecution().toString()
    assert " IN (" not in plan and "INSET" not in plan


def test_licenses_run_without_python(spark):
    plan = licences.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_shared_folder_is_the_cluster_s(spark):
    from statframe.llm.common import keep, shared_folder

    path = keep(spark.range(3).withColumn("x", F.lit(1))).inputFiles()[0]
    assert path.startswith("file:") and shared_folder(spark).removeprefix("file://") in path
