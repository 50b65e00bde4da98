"""Local parts of the corpus operators against brute force."""

import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from statframe.llm import chat, codec, jaccard, links, tokens, topk, unigram
from statframe.llm.decontaminate import SuffixArray, Suffixes, _pieces
from statframe.llm.language import Model, _groups, mixture
from statframe.llm.line_dedup import LineIndex, PerfectHash, line_key
from statframe.llm.tokens import MODEL
from statframe.llm.words import ALNUM, NOT_SPACE, Words, shingle_sets, texts


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal_and_survives_packing(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    h = PerfectHash.unpack(PerfectHash.build(keys).pack())
    assert sorted(h.slots(keys).tolist()) == list(range(n))


def test_line_index_knows_its_keys_and_no_others():
    r = np.random.default_rng(1)
    h, g, n, last = (r.integers(-2**62, 2**62, 3000) for _ in range(4))
    index = LineIndex.unpack(LineIndex.build(h[:2000], g[:2000], np.abs(n[:2000]) + 1, last[:2000]).pack())
    count, doc = index.probe(h, g)
    assert (count[:2000] == np.abs(n[:2000]) + 1).all() and (doc[:2000] == last[:2000]).all() and not count[2000:].any()


def test_line_key_strips_only_the_six_characters():
    assert line_key("\x0b A Ä \r".encode()) == "a Ä".encode()


def test_words_agree_with_the_pattern():
    rows = ["One two-3", None, "", "  ÄÖ x \x1c tab\there", "a" * 3000 + " b"]
    for kind, pattern in ((ALNUM, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (NOT_SPACE, "[^\x20\x09-\x0D]+")):
        for first, _, data, offsets in texts(pa.array(rows), 10):
            w = Words(data, offsets, kind)
            for k in range(len(offsets) - 1):
                lower = re.sub("[A-Z]", lambda m: m[0].lower(), rows[first + k] or "")
                got = [bytes(data[a:b]).decode().lower() for a, b in zip(w.start[w.first[k]:w.first[k + 1]], w.end[w.first[k]:w.first[k + 1]])]
                assert got == [x.lower() for x in re.findall(pattern, lower)]


def test_shingles_fold_case_and_repeats():
    sets = dict(shingle_sets(pa.array(["A b c d e", "a B C d E", "a b c d e a b c d", "x y", "", None, "a b c d"]), 4))
    assert sets[0].tolist() == sets[1].tolist() and len(sets[0]) == 2 and len(sets[2]) == 5
    assert [len(sets[k]) for k in (3, 4, 5, 6)] == [1, 0, 0, 1] and sets[6][0] in sets[0]


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_finds_every_window(seed):
    r = random.Random(seed)
    docs = [[r.choice("abcd") for _ in range(r.randrange(0, 60))] for _ in range(30)]
    docs += docs[:5]
    items = [[r.choice("abcd") for _ in range(r.randrange(0, 12))] for _ in range(40)]
    code = {c: np.uint64(x) for c, x in zip("abcd", np.random.default_rng(3).integers(0, 2**63, 4))}
    words = np.array([code[c] for d in docs for c in d], np.uint64)
    cuts = np.cumsum([len(d) for d in docs])
    ends = np.repeat(cuts, [len(d) for d in docs])
    array = SuffixArray(words, ends)
    suffixes = [tuple(int(x) >> 20 for x in words[i:ends[i]]) for i in array.order]
    assert suffixes == sorted(suffixes)
    suffixes = Suffixes([str(k) for k in range(len(items))], [np.array([code[c] for c in i], np.uint64) for i in items], 4)
    found = suffixes.hits(words, ends)
    names = {tuple(g.tolist()): first + k for _, grams, first in suffixes.sets for k, g in enumerate(grams)}
    want, runs = set(), defaultdict(set)
    for k, item in enumerate(items):
        size = min(4, len(item))
        for p in range(len(item) - size + 1 if size else 0):
            window = names[tuple(int(code[c]) for c in item[p:p + size])]
            for j, (start, d) in enumerate(zip(cuts - [len(d) for d in docs], docs)):
                for q in range(len(d) - size + 1):
                    if d[q:q + size] == item[p:p + size]:
                        want.add((int(start + q), window))
                        if size < 4 or not (q and p and d[q - 1:q + 3] == item[p - 1:p + 3]):
                            e = 0
                            while size == 4 and d[q + e + 1:q + e + 5] == item[p + e + 1:p + e + 5] and p + e + 5 <= len(item) and q + e + 5 <= len(d):
                                e += 1
                            runs[j].add((q, k, p, size + e))
    assert {tuple(x) for x in found.tolist()} == want
    for j, (start, d) in enumerate(zip(cuts - [len(d) for d in docs], docs)):
        own = found[(found[:, 0] >= start) & (found[:, 0] < start + len(d))] - [start, 0]
        assert {tuple(x) for x in suffixes.longest(own[np.random.default_rng(j).permutation(len(own))]).tolist()} == runs[j]


def test_text_that_repeats_itself_has_few_matches():
    words = np.full(20_000, 7, np.uint64)
    suffixes = Suffixes(["x"], [words], 10)
    tracemalloc.start()
    hits = suffixes.hits(words, np.full(len(words), len(words)))
    got = suffixes.longest(hits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hits) == 19_991 and len(got) == 2 * 19_991 - 1 and peak < 200e6
    assert sorted(got[:, 3].tolist())[-1] == 20_000 and (got[:, 0] * got[:, 2] == 0).all() and (got[:, 3] == 20_000 - got[:, 0] - got[:, 2]).all()


def test_long_documents_are_cut_with_overlap(monkeypatch):
    import statframe.llm.decontaminate as d

    monkeypatch.setattr(d, "SHARD_WORDS", 10)
    got = list(_pieces(np.array([3, 4, 25, 2]), 3))
    assert got == [(0, 2, 0, 4), (2, 3, 0, 10), (2, 3, 7, 17), (2, 3, 14, 24), (2, 3, 21, 25), (3, 4, 0, 2)]


def test_subsets_meet_exactly_when_linked():
    for a in range(1, 25):
        for b in range(a, 30):
            c = links.need(a, b, 85, 100)
            assert 100 * c >= 85 * (a + b - c) and 100 * (c - 1) < 85 * (a + b - c + 1)
            assert (b in jaccard._partners(a, 85, 100)) == (100 * a >= 85 * b)
    assert jaccard.boundary({5: 10, 8: 10, 40: 5}, 85, 100) >= 8 and jaccard.boundary({}, 85, 100) == 0


def test_escaping_is_reversible():
    r = random.Random(1)
    parts = ["\\", "#", "###", "</turn>", "<", "/", "a", ":", "\n", " ", "### x: "]
    for _ in range(2000):
        text, role = ("".join(r.choice(parts) for _ in range(r.randrange(10))) for _ in range(2))
        assert chat.parse(chat.render(role, text)[0] + chat.render("user", text)[0]) == [(role, text), ("user", text)]


@pytest.mark.parametrize("seed", range(20))
def test_spans_cover_every_turn_once_within_the_budget(seed):
    r = random.Random(seed)
    tokens = np.array([r.randrange(1, 60) for _ in range(r.randrange(1, 40))])
    system, history = r.randrange(0, 2), r.randrange(0, 4)
    got = chat.spans(tokens, system, 100, history)
    assert [i for _, new, after in got for i in range(new, after)] == list(range(system, len(tokens)))
    for shown, new, after in got:
        assert new - shown <= history and shown >= system
        assert tokens[:system].sum() + tokens[shown:after].sum() <= 100 or after - shown <= 1


def test_pivot_bounds_never_lose_a_candidate():
    r = np.random.default_rng(5)
    x, q = r.integers(-300, 300, (500, 16)), r.integers(-300, 300, (7, 16))
    x[100:140] = x[0]
    pivots = topk.pick_pivots(x[:50], 8)
    best = topk.Best(7, 5)
    for a in range(0, 500, 90):
        topk.search(best, np.arange(7) + 1000, q, topk.distances(q, pivots), np.arange(500)[a:a + 90], x[a:a + 90], topk.distances(x[a:a + 90], pivots))
    for k in range(7):
        s = x @ q[k]
        order = np.lexsort((np.arange(500), -s))[:5]
        assert best.id[k].tolist() == order.tolist() and best.score[k].tolist() == s[order].tolist()


def test_blocks_out_of_reach_are_not_asked():
    r = np.random.default_rng(8)
    centres = r.integers(-2000, 2000, (20, 16))
    x = np.concatenate([c + r.integers(-30, 30, (200, 16)) for c in centres])      # a block for each cluster
    pivots = topk.pick_pivots(x[::7], 24)
    d = topk.distances(x, pivots).astype(np.float32).astype(float).reshape(20, 200, -1)
    xx = (x.astype(float) ** 2).sum(axis=1).reshape(20, 200)
    q = x[::400]
    score = x @ q.T
    least = np.sort(score, axis=0)[-5]
    asked = list(topk.reachable((q.astype(float) ** 2).sum(axis=1), topk.distances(q, pivots), least.astype(float), d.min(axis=1), d.max(axis=1), xx.max(axis=1)))
    for k, blocks in enumerate(asked):
        assert set(np.flatnonzero(score[:, k] >= least[k]) // 200) <= set(blocks.tolist())
    assert sum(map(len, asked)) < 0.3 * 20 * len(q)


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load(MODEL)


def _word_list():
    r = random.Random(2)
    words = {"".join(r.choice("▁abehsté中😀\ud800") for _ in range(r.randrange(1, 90))) for _ in range(400)} | {"ha" * 20, "▁" * 40}
    # long words that no sure boundary cuts: many of like length share tries, few go alone
    words |= {"".join(r.choice("hate") for _ in range(r.randrange(65, 120))) for _ in range(150)} | {"the" * 100, "中文" * 400, "ภาษาไทย" * 90}
    return sorted(words)


def test_trie_equals_path_by_path(vocabulary):
    trie, words = unigram.Trie(vocabulary), _word_list()
    made, counts = trie.encode(words), trie.counts(words)
    for w in words:
        ids = unigram.trace(vocabulary, w, unigram.segment(vocabulary, w)[1], len(w))[0]
        assert np.frombuffer(made[w], np.int32).tolist() == ids and counts[w] == len(ids)


def test_no_piece_crosses_where_long_words_are_cut(vocabulary):
    word = "中文没有空格" * 30 + "hahaha" + "ภาษาไทย" * 30
    own = unigram.parts(vocabulary, word)
    assert "".join(own) == word and max(map(len, own)) <= unigram.LONG and len(own) > 100
    places = np.cumsum([len(x) for x in own])[:-1]
    for p in places[:50]:
        for a in range(max(0, p - vocabulary.longest), p):
            assert not any(word[a:b] in vocabulary.pieces for b in range(p + 1, a + vocabulary.longest + 1))


def test_best_path_beats_random_paths(vocabulary):
    r = random.Random(4)
    for w in ("▁there", "hahaha", "▁intention"):
        best = unigram.segment(vocabulary, w)[0][-1]
        for _ in range(50):
            cuts = [0, *sorted(r.sample(range(1, len(w)), r.randrange(0, len(w) - 1))), len(w)]
            parts = [w[a:b] for a, b in zip(cuts, cuts[1:])]
            if all(p in vocabulary.pieces for p in parts):
                assert sum(vocabulary.pieces[p][0] for p in parts) <= best


@pytest.mark.parametrize("chunk", [5, 17, 33])
def test_transfer_matrices_give_the_score_of_the_whole(vocabulary, chunk):
    cache = codec.Chunks(vocabulary, "encode")
    text = unigram.SPACE + unigram.normal("the hahahahahahahahahahahahahaha  of\nintention" + "x" * 40 + " end")
    enter = np.full(vocabulary.longest, codec.NONE)
    enter[0] = 0
    matrices = [codec.transfer(cache, text[a - 1:a] if a else "", text[a:a + chunk], text[a + chunk:a + chunk + vocabulary.longest - 1]) for a in range(0, len(text), chunk)]
    for m in matrices:
        enter = codec.combine(enter, m)
    assert enter[0] == unigram.segment(vocabulary, text)[0][-1]
    middle = codec.combine(codec.combine(matrices[0], matrices[1]), matrices[2])
    assert (np.maximum(middle, -10**15) == np.maximum(codec.combine(matrices[0], codec.combine(matrices[1], matrices[2])), -10**15)).all()


def test_mixture_selects_both_languages():
    a, b = "abc def abd cab fed " * 30, "xyz zyx wxy zzx yyw " * 30
    counts = []
    for t in (a, b):
        own = next(_groups([t]))[1]
        counts.append(np.bincount(own, minlength=1 << 15) + 0.5)
    model = Model(["one", "two"], np.array([c / c.sum() for c in counts]).T)
    share, chosen = mixture(next(_groups([a + b[:300]]))[1], model)
    assert chosen == [0, 1] and 0.6 < share[0] < 0.9
    assert mixture(next(_groups([a]))[1], model)[1] == [0]
    assert [g is None for _, g in _groups([None, "", "12 3!", "a"])] == [True, True, True, False]


def test_ends_of_pieces_are_known(vocabulary):
    table = unigram.Trie(vocabulary).table

    def hashes(texts):
        out = []
        for t in texts:
            h = 0
            for c in t:
                h = (h * int(unigram._BASE) + ord(c) + 1) % 2**64
            out.append(h)
        return np.array(out, np.uint64)

    pieces = list(vocabulary.pieces)
    ends = {p[k:] for p in pieces for k in range(len(p))}
    assert table.may_end(hashes(sorted(ends))).all()
    others = [f"{p}\x07{k}" for k, p in enumerate(pieces[:2000])]      # no piece ends like these
    assert not set(others) & ends and table.may_end(hashes(others)).mean() < 0.5


def test_full_cache_keeps_the_words_at_hand(vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    cache, made = tokens.Cache(vocabulary, "encode"), []
    make = cache.make
    cache.make = lambda words: made.extend(words) or make(words)
    first = cache.results(["one two"])
    assert cache.results(["two three four"])[0][0] == first[0][1]
    assert sorted(w.strip(unigram.SPACE) for w in made) == ["four", "one", "three", "two"] and len(cache.known) == 3


def test_words_are_not_new_with_other_punctuation(vocabulary):
    cache, made = tokens.Cache(vocabulary, "encode"), []
    make = cache.make
    cache.make = lambda words: made.extend(words) or make(words)
    got = cache.results(["there, there. there", "there; there! there,there"])
    assert made.count("▁there") == 1 and not any(len(w) > 5 and w != "▁there" for w in made)
    for t, own in zip(["there, there. there", "there; there! there,there"], got):
        whole = unigram.SPACE + unigram.normal(t)
        assert np.frombuffer(b"".join(own), np.int32).tolist() == unigram.trace(vocabulary, whole, unigram.segment(vocabulary, whole)[1], len(whole))[0]


def test_texts_are_cut_into_words_where_no_piece_crosses(vocabulary):
    r = random.Random(7)
    texts = [None, "", " ", "\n", "a", " a"] + ["".join(r.choice("  abé.,\n\t\r▁中7😀") for _ in range(r.randrange(60))) for _ in range(200)]
    separators = re.escape(vocabulary.separators)
    word = re.compile(f" *[^ {separators}]+|[{separators}]| +")
    for own in (pa.array(texts), pa.array(["x y", *texts, "z"])[1:-1]):
        for front in (" ", ""):
            parts, upto, n_words = unigram.Splitter(vocabulary)(own, front)
            parts, whole = parts.to_pylist(), [front + t if t else "" for t in texts]
            assert ["".join(parts[a:b]) for a, b in zip([0, *upto], upto)] == whole and all(parts)
            assert n_words.tolist() == [len(word.findall(t)) for t in whole]
            for t, a, b in zip(whole, [0, *upto], upto):
                cuts = {0, *np.cumsum([len(p) for p in parts[a:b]]).tolist()}
                assert {m.start() for m in word.finditer(t)} <= cuts
                assert not any(unigram.normal(t[k - 1:k + 1]) in vocabulary.pairs for k in cuts if 0 < k < len(t))
    assert [len(x) for x in unigram.Splitter(vocabulary)(pa.array([], pa.string()))] == [0, 0, 0]


def test_cache_forgets_words_that_were_not_met(vocabulary, monkeypatch):
    r = random.Random(8)
    texts = [" ".join(["always", *("".join(r.choice("abehst") for _ in range(6)) for _ in range(8))]) for _ in range(60)]
    want = [tokens.Cache(vocabulary, "encode").results([t])[0] for t in texts]
    monkeypatch.setattr(tokens, "CACHE", 40)
    cache, made = tokens.Cache(vocabulary, "encode"), []
    make = cache.make
    cache.make = lambda words: made.extend(words) or make(words)
    for t, own in zip(texts, want):
        assert cache.results([t])[0] == own and len(cache.known) == len(cache.became) == len(cache.met) <= 40
    assert made.count("▁always") == 1 and len(made) > 400


def test_ids_between_sure_boundaries_give_the_same_matrix(vocabulary):
    cache = codec.Chunks(vocabulary, "encode")
    body, after = unigram.normal("nd the intention, of 中文 and ▁ so on. thou"), "gh"
    first, last = codec._boundaries(cache, "a", body)
    between, = cache.encoded([body[first:last]])
    assert (codec.transfer(cache, "a", body, after) == codec.transfer(cache, "a", body, after, between)).all()
    assert cache.score(between) == unigram.segment(vocabulary, body[first:last])[0][-1]
