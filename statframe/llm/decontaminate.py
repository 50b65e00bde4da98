"""Benchmark decontamination by suffix arrays over the training text.

Each task cuts its documents into shards of at most 2**20 - 1 words, sorts the suffixes of a shard by prefix doubling (word numbers
of 20 bits are packed with the position, so a round is one sort of 64-bit numbers) and binary-searches every suffix of the test
items in it. Hits give the longest verbatim matches and their places. Nothing is shuffled: shards live and die inside a task.
The items travel to the tasks in blocks of bounded size; more blocks mean more passes, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statframe.llm.common import keep, per_batch
from statframe.llm.words import ALNUM, Words, texts

#: Bytes of text and words in a shard; 20 bits hold a position or a rank.
SHARD_BYTES = 1_500_000
SHARD_WORDS = (1 << 20) - 1
#: Words of test items sent to the tasks at once (8 bytes each).
BLOCK_WORDS = 1 << 21
_LOW = np.uint64((1 << 20) - 1)
_TOP = np.uint64(44)

MATCHES = "array<struct<item:string,item_word:int,word:int,words:int>>"


class SuffixArray:
    """All word suffixes of a shard in order; a suffix ends with its document."""

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        """``words``: 64-bit hash of each word; ``ends``: end of each word's document."""
        n = len(words)
        at = np.arange(n, dtype=np.uint64)
        packed = np.sort((words >> np.uint64(20) << np.uint64(20)) | at)
        order = (packed & _LOW).astype(np.int64)
        first = packed >> np.uint64(20)
        new = np.r_[True, first[1:] != first[:-1]] if n else np.zeros(0, bool)
        self.known = first[new]                       # distinct words, in order
        self.word = np.zeros(n + 3, np.uint64)        # number of each word, from 1; 0 past the end
        self.word[order] = np.cumsum(new).astype(np.uint64)
        self.ends = ends
        heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.zeros(n, np.int64)
        rank[order] = heads
        step = 1
        while True:
            size_one = np.r_[new[1:], True] & new
            open_ = ~size_one & (ends[order] - order > step)
            if not open_.any():
                break
            # the open suffixes keep their group's place; sort them by what follows ``step`` words on
            where = np.flatnonzero(open_ | (~size_one))
            who = order[where]
            after = who + step
            follow = np.where(after < ends[who], rank[np.minimum(after, n - 1)] + 1, 0).astype(np.uint64)
            packed = np.sort((rank[who].astype(np.uint64) << np.uint64(41)) | (follow << np.uint64(20)) | who.astype(np.uint64))
            who = (packed & _LOW).astype(np.int64)
            order[where] = who
            key = packed >> np.uint64(20)
            fresh = np.r_[True, key[1:] != key[:-1]]
            new[where] |= fresh
            heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            rank[order[where]] = heads[where]
            step *= 2
        self.order = order
        inside = lambda k: np.arange(n) + k < ends
        #: Three words from each position on, packed; in suffix order this is sorted.
        self.three = (self.word[:n] << np.uint64(40)) | (np.where(inside(1), self.word[1:n + 1], 0) << np.uint64(20)) | np.where(inside(2), self.word[2:n + 2], 0)
        self.sorted_three = self.three[order]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Number of each word in this shard, 0 if absent."""
        cut = words >> np.uint64(20)
        at = np.minimum(np.searchsorted(self.known, cut), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == cut, at + 1, 0).astype(np.uint64) if len(self.known) else np.zeros(len(words), np.uint64)

    def search(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each row of ``wanted`` (word numbers)."""
        lo, hi = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        active = np.flatnonzero((wanted != 0).all(axis=1))
        for depth in range(0, wanted.shape[1], 3):
            part = wanted[active, depth:depth + 3]
            low = np.zeros(len(part), np.uint64)
            for k in range(part.shape[1]):
                low |= part[:, k] << np.uint64(40 - 20 * k)
            high = low + np.uint64(1 << (40 - 20 * (part.shape[1] - 1)))
            if depth == 0:
                a, b = np.searchsorted(self.sorted_three, low), np.searchsorted(self.sorted_three, high)
            else:
                a, b = (self._bisect(lo[active], hi[active], depth, x) for x in (low, high))
            lo[active], hi[active] = a, b
            active = active[b > a]
            lo_hi_empty = np.ones(len(wanted), bool)
            lo_hi_empty[active] = False
            hi[lo_hi_empty] = lo[lo_hi_empty]
        return lo, hi

    def _bisect(self, lo: np.ndarray, hi: np.ndarray, depth: int, wanted: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) whose packed words from ``depth`` on are not below ``wanted``."""
        lo, hi = lo.copy(), hi.copy()
        n = len(self.order)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = self.order[np.minimum(mid, n - 1)]
            past = at + depth
            value = np.where(past < self.ends[at], self.three[np.minimum(past, n - 1)], 0)
            less = (value < wanted) & open_
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo


class Suffixes:
    """Test items as distinct windows: the words of each window, and the (item, place) pairs that have it.

    Windows of all lengths are numbered through. Two copies of the pairs are sorted by window and then by the number of the window before
    (and after) theirs in the item, -1 if there is none: an occurrence in a text lies on the same diagonal run as the pairs that agree with it there.
    """

    def __init__(self, names: list[str], words: list[np.ndarray], window: int):
        self.window, self.names = window, names
        rows: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for k, own in enumerate(words):
            size = min(window, len(own))
            for p in range(len(own) - size + 1 if size else 0):
                rows.setdefault(size, {}).setdefault(own[p:p + size].tobytes(), []).append((k, p))
        self.sets, pairs, count = [], [], 0                # (words in a window, the windows, number of the first)
        for size, found in sorted(rows.items()):
            grams = np.frombuffer(b"".join(found), np.uint64).reshape(-1, size)
            self.sets.append((size, grams, count))
            pairs += [(count + w, k, p) for w, places in enumerate(found.values()) for k, p in places]
            count += len(found)
        self.size = np.repeat([s[0] for s in self.sets], [len(s[1]) for s in self.sets]).astype(np.int64)
        window_of, item, place = (np.array(pairs, np.int64).reshape(-1, 3)[:, k] for k in range(3))
        order = np.lexsort((place, item))
        window_of, item, place = window_of[order], item[order], place[order]
        goes_on = (item[1:] == item[:-1]) & (place[1:] == place[:-1] + 1)
        before, after = (np.full(len(item), -1) for _ in range(2))
        before[1:][goes_on], after[:-1][goes_on] = window_of[:-1][goes_on], window_of[1:][goes_on]
        self.sides = []
        for beside in (before, after):
            order = np.lexsort((beside, window_of))
            self.sides.append((window_of[order] * (count + 1) + beside[order] + 1, item[order], place[order]))
        self.count = count
        self.first = np.searchsorted(self.sides[0][0], np.arange(count + 1) * (count + 1))
        every = [s[1].ravel() for s in self.sets]
        self.vocabulary = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.index = [np.searchsorted(self.vocabulary, s[1]) for s in self.sets]

    def hits(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(place in the shard, window) of every occurrence of every window."""
        if not len(words) or not self.sets:
            return np.zeros((0, 2), np.int64)
        array = SuffixArray(words, ends)
        numbers = array.numbers(self.vocabulary)
        out = []
        for (size, grams, number), index in zip(self.sets, self.index):
            lo, hi = array.search(numbers[index])
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            count = hi[some] - lo[some]
            which = np.repeat(some, count)
            at = array.order[np.repeat(lo[some], count) + _runs(count)]
            same = np.ones(len(at), bool)
            for k in range(size):      # the array compares 44 bits of a word's hash; here all 64
                same &= words[at + k] == grams[which, k]
            out.append(np.column_stack([at[same], which[same] + number]))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def longest(self, hits: np.ndarray) -> np.ndarray:
        """(place, item, place in the item, words) of the maximal matches behind one text's occurrences (distinct, any order).

        Neighbouring windows on one diagonal are one match. Only the pairs where a match begins, and those where one ends, are listed, so the work
        grows with the occurrences and the matches, not with occurrences times places: text that repeats itself has few of either.
        """
        order = np.lexsort((hits[:, 0], self.size[hits[:, 1]]))
        at, window = hits[order].T
        size = self.size[window]
        goes_on = (size[1:] == size[:-1]) & (at[1:] == at[:-1] + 1)
        beside = [np.full(len(at), -1) for _ in range(2)]
        beside[0][1:][goes_on], beside[1][:-1][goes_on] = window[:-1][goes_on], window[1:][goes_on]
        found = []
        for own, (key, item, place) in zip(beside, self.sides):
            whole = window * (self.count + 1)
            lo, hi = np.searchsorted(key, whole + own + 1), np.searchsorted(key, whole + own + 1, "right")
            hi = np.where(own < 0, lo, hi)                  # with nothing beside it, an occurrence agrees with no pair
            counts = np.concatenate([lo - self.first[window], self.first[window + 1] - hi])
            pair = np.repeat(np.concatenate([self.first[window], hi]), counts) + _runs(counts)
            which = np.repeat(np.tile(np.arange(len(at)), 2), counts)
            rows = np.column_stack([item[pair], size[which], at[which] - place[pair], at[which], place[pair]])
            found.append(rows[np.lexsort(rows.T[3::-1])])
        begin, end = found                                   # on each diagonal they take turns
        return np.column_stack([begin[:, 3], begin[:, 0], begin[:, 4], end[:, 3] - begin[:, 3] + begin[:, 1]])


def _runs(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _pieces(lengths: np.ndarray, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """Cut documents of these many words into shards: (first row, row after the last, words skipped in the first row, words taken of the
    last). A document longer than a shard is cut into overlapping pieces, so every window lies whole in one of them."""
    row = 0
    while row < len(lengths):
        if lengths[row] > SHARD_WORDS:
            step = SHARD_WORDS - overlap
            for a in range(0, max(1, int(lengths[row]) - overlap), step):
                yield row, row + 1, a, min(int(lengths[row]), a + SHARD_WORDS)
            row += 1
            continue
        total = np.cumsum(lengths[row:])
        last = row + max(1, int(np.searchsorted(total, SHARD_WORDS, "right")))
        yield row, last, 0, int(lengths[last - 1])
        row = last


def search_block(batch: pa.RecordBatch, column: str, suffixes: Suffixes) -> tuple[np.ndarray, list[list[tuple]]]:
    """(words of each row, matches of each row)."""
    source = batch.column(batch.schema.get_field_index(column))
    counts = np.zeros(len(source), np.int64)
    found: list[list[tuple]] = [[] for _ in range(len(source))]
    for first, _, data, offsets in texts(source, SHARD_BYTES):
        words = Words(data, offsets, ALNUM)
        lengths = np.diff(words.first)
        counts[first:first + len(lengths)] = lengths
        for a, b, skip, take in _pieces(lengths, suffixes.window - 1):
            begin, end = words.first[a] + skip, words.first[b - 1] + take
            own = words.hash[begin:end]
            ends = np.repeat(np.minimum(words.first[a + 1:b + 1], end) - begin, np.minimum(words.first[a + 1:b + 1], end) - np.maximum(words.first[a:b], begin))
            hits = suffixes.hits(own, ends)
            if len(hits):
                row = np.searchsorted(words.first, hits[:, 0] + begin, "right") - 1
                hits[:, 0] += begin - words.first[row]
                order = np.argsort(row, kind="stable")
                row, hits = row[order], hits[order]
                cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                for x, y in zip(cuts, [*cuts[1:], len(row)]):
                    found[first + row[x]].append(hits[x:y])
    return counts, [_named(suffixes, np.unique(np.concatenate(h), axis=0)) if h else [] for h in found]


def _named(suffixes: Suffixes, hits: np.ndarray) -> list[tuple]:
    return [(suffixes.names[i], p, w, n) for w, i, p, n in suffixes.longest(hits).tolist()]


def _blocks(items: DataFrame, id: str, text: str, window: int, block_words: int) -> Iterator[Suffixes]:
    """Items as word hashes, in blocks of about ``block_words`` words."""
    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in texts(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                own = [words.hash[words.first[k]:words.first[k + 1]] for k in range(last - first)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([len(x) for x in own], pa.int64()),
                                                  pa.array([x.tobytes() for x in own], pa.binary())], ["item", "n", "words"])

    table = keep(items.where(F.col(id).isNotNull()).select(F.col(id).cast("string").alias("item"), F.col(text).alias("t"))
                 .mapInArrow(hashed, "item string, n long, words binary").where("n > 0"))
    total = table.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        rows = table.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).select("item", "words").orderBy("item", "words").collect()
        yield Suffixes([r["item"] for r in rows], [np.frombuffer(r["words"], np.uint64) for r in rows], window)


def find_matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` and ``matches``; columns of those names in ``docs`` give way.

    ``matches`` has the longest verbatim matches of at least ``window`` words (of a whole item with fewer): item, first word in the item,
    first word in the document, words. A word inside any of them is hit. Words are runs of letters, digits and non-ASCII, A-Z in lower
    case. Null and empty texts have no words; items with a null id or without words are never found; rows that repeat an item id are
    further texts of that item; an empty items table finds nothing. Rows of ``docs`` are independent of each other.
    """
    from functools import partial

    spark = docs.sparkSession
    out = docs
    for k, block in enumerate(_blocks(items, item_id, item_text, window, block_words)):
        sent = spark.sparkContext.broadcast(block)

        def search(batch: pa.RecordBatch, sent, first: bool) -> dict:
            counts, found = search_block(batch, text, sent.value)
            if not first:
                before = batch.column(batch.schema.get_field_index("matches")).to_pylist()
                found = [[tuple(x.values()) for x in a] + b for a, b in zip(before, found)]
            hit = np.zeros(len(found), np.int64)
            for row, own in enumerate(found):
                if own:
                    cover = np.zeros(counts[row] + 1, np.int64)
                    for _, _, word, n in own:
                        cover[word] += 1
                        cover[word + n] -= 1
                    hit[row] = (np.cumsum(cover) > 0).sum()
            rows = [[dict(zip(("item", "item_word", "word", "words"), m)) for m in own] for own in found]
            return {"n_words": counts, "n_hit": hit, "matches": rows}

        out = per_batch(out, partial(search, sent=sent, first=k == 0), n_words="long", n_hit="long", matches=MATCHES)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a window of any item."""
    return find_matches(docs, items, **options).where("n_hit = 0").select(*docs.columns)
