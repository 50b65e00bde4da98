"""Unigram segmentation of text into the pieces of a SentencePiece vocabulary.

A piece's log-probability follows Zipf's law over its rank in the vocabulary, as an integer, so sums are exact in any order. Text is
taken as it is (no normalisation): a space becomes U+2581, one is put in front, and a character outside the vocabulary becomes its
UTF-8 bytes. The best path has the largest sum; of equal ones the path whose last piece is longest, then the one before it, and so on.

No piece holds U+2581 after another character, so a word (spaces, then other characters) can be segmented alone. ``Trie`` does that for
many distinct words at once, level by level of their trie: a shared prefix is scored once. Where two neighbouring characters stand next to
each other in no piece, every path has a boundary: a long word (a line of a script without spaces) is cut there, and its parts join the trie.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = "▁"
#: Stands for a U+2581 that the text itself holds; UTF-8 text has no lone surrogates.
LITERAL = "\ud800"
SCALE = 1 << 16
#: Longer words are cut where no piece crosses. Parts that stay longer are segmented with others of like length if there are ``TOGETHER``, else alone.
LONG = 64
TOGETHER = 64
#: Distinct words scored together.
BATCH = 1 << 13
#: Bits of the places in the table of the ends of pieces.
ENDS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.int64).min // 4


class Vocabulary(NamedTuple):
    pieces: dict[str, tuple[int, int]]      # piece -> (score, id)
    bytes: list[int]                        # id of each byte
    byte_score: int
    longest: int
    separators: str                         # characters that are in no piece of several characters
    text: list[bytes]                       # what each id stands for
    pairs: frozenset[str]                   # neighbouring characters within a piece


def load(path: str) -> Vocabulary:
    """Read a SentencePiece model file (with byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    norm = float(np.log(np.sum(1 / np.arange(1, size + 1))))
    pieces, own, text = {}, [0] * 256, [b""] * size
    for k in range(size):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            own[int(piece[3:5], 16)] = k
            text[k] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            pieces[piece] = (-round((np.log(k + 1) + norm) * SCALE), k)
            text[k] = piece.replace(SPACE, " ").encode()
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece holds a space after another character: words cannot be segmented alone")
    several = "".join(p for p in pieces if len(p) > 1)
    return Vocabulary(pieces, own, -round((np.log(size) + norm) * SCALE) * 2, max(map(len, pieces)),
                      "".join(c for c in "\n\r\t" if c not in several), text, frozenset(p[k:k + 2] for p in pieces for k in range(len(p) - 1)))


def normal(text: str) -> str:
    return text.replace(SPACE, LITERAL).replace(" ", SPACE)


def raw(text: str) -> str:
    """The text that ``normal`` was given."""
    return text.replace(SPACE, " ").replace(LITERAL, SPACE)


def char_bytes(c: str) -> bytes:
    return SPACE.encode() if c == LITERAL else c.encode()


class Splitter:
    """Cuts texts into words, and words where two ASCII characters stand next to each other in no piece: best paths have a boundary at any cut.

    A word is spaces and the characters after them up to a space or a separator; a separator is one by itself. Texts are as they were given, not
    ``normal``.
    """

    def __init__(self, v: Vocabulary):
        self.separators = [ord(c) for c in v.separators]
        self.together = np.zeros(1 << 14, bool)            # pairs of ASCII characters that stand in a piece
        for a, b in (pair.replace(SPACE, " ") for pair in v.pairs):
            if a < "\x80" > b:
                self.together[ord(a) << 7 | ord(b)] = True

    def __call__(self, texts: pa.Array, front: str = " ") -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """What all texts are cut into, and for each text how many parts it and those before it have, and how many words.

        ``front`` is put in front of each text; a null or empty one has no words.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(front, texts, ""))
        _, places, data = texts.buffers()
        places = np.frombuffer(places, np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        own = np.frombuffer(data, np.uint8)[places[0]:places[-1]] if data else np.zeros(0, np.uint8)
        ends, size = places[1:] - places[0], len(own)
        space, apart = own == 0x20, np.isin(own, self.separators)
        word = np.ones(size, bool)
        word[1:] = apart[1:] | apart[:-1] | (space[1:] & ~space[:-1])
        word[(ends - np.diff(places))[np.diff(places) > 0]] = True
        ascii_ = own < 0x80
        begin = word.copy()
        begin[1:] |= ascii_[1:] & ascii_[:-1] & ~self.together[(own[:-1] & 0x7F).astype(np.uint16) << 7 | (own[1:] & 0x7F)]
        begins = np.append(np.flatnonzero(begin), size).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(own))
        words = np.searchsorted(np.flatnonzero(word), ends)
        return parts.dictionary_encode(), np.searchsorted(begins[:-1], ends), np.diff(words, prepend=0)


def parts(v: Vocabulary, word: str) -> list[str]:
    """The word, cut wherever no piece crosses."""
    cuts = [0, *(k for k in range(1, len(word)) if word[k - 1:k + 1] not in v.pairs), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def segment(v: Vocabulary, text: str, start: list[int] | None = None, until: int | None = None) -> tuple[list[int], list[tuple[int, int]]]:
    """Best score of a path to each place, and the last piece on it (first place, id; -1: a character as bytes).

    ``start`` holds scores with which paths may enter at the first places (default: at 0); an entry wins a tie, and has (-1, 0) as its
    piece. Pieces begin before ``until``.
    """
    n = len(text)
    best, back = [_NONE] * (n + 1), [(-1, 0)] * (n + 1)
    for k, s in enumerate([0] if start is None else start[: n + 1]):
        best[k] = s
    get, until = v.pieces.get, n if until is None else until
    for end in range(1, n + 1):
        for first in range(max(0, end - v.longest), min(end, until)):
            if best[first] > _NONE:
                found = get(text[first:end])
                if found is None:
                    if end - first > 1:
                        continue
                    found = (v.byte_score * len(char_bytes(text[first])), -1)
                if best[first] + found[0] > best[end]:
                    best[end], back[end] = best[first] + found[0], (first, found[1])
    return best, back


def trace(v: Vocabulary, text: str, back: list[tuple[int, int]], end: int) -> tuple[list[int], int]:
    """Ids of the path that ends at ``end``, and the place where it entered."""
    out: list[int] = []
    while end > 0 and back[end][0] >= 0:
        first, piece = back[end]
        out += [piece] if piece >= 0 else [v.bytes[b] for b in reversed(char_bytes(text[first]))]
        end = first
    return out[::-1], end


class Table:
    """Pieces by the hash of their characters, in tables of one slot per hash; what collides goes to the next table.

    A bit table knows the ends of pieces: where text does not end like any piece of a size, no larger one ends there either.
    """

    def __init__(self, v: Vocabulary):
        hashes, scores, ids, ends = [], [], [], set()
        powers = [pow(int(_BASE), k, 1 << 64) for k in range(v.longest)]
        for piece, (score, k) in v.pieces.items():
            h = 0
            for size, c in enumerate(reversed(piece)):
                h = (h + (ord(c) + 1) * powers[size]) % 2**64
                ends.add(h)
            hashes.append(h), scores.append(score), ids.append(k)
        self.ends = np.zeros(1 << ENDS, bool)
        self.ends[self._at(np.fromiter(ends, np.uint64, len(ends)), ENDS, 0)] = True
        h, s, i = np.array(hashes, np.uint64), np.array(scores, np.int64), np.array(ids, np.int32)
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces have one hash")
        self.levels, bits = [], 18
        while len(h):
            at = self._at(h, bits, len(self.levels))
            keep = np.zeros(len(h), bool)
            keep[np.unique(at, return_index=True)[1]] = True
            keys, score, piece = np.zeros(1 << bits, np.uint64), np.full(1 << bits, _NONE), np.full(1 << bits, -1, np.int32)
            keys[at[keep]], score[at[keep]], piece[at[keep]] = h[keep], s[keep], i[keep]
            self.levels.append((bits, keys, score, piece))
            h, s, i, bits = h[~keep], s[~keep], i[~keep], 14

    @staticmethod
    def _at(h: np.ndarray, bits: int, level: int) -> np.ndarray:
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * level) >> np.uint64(64 - bits)).astype(np.int64)

    def may_end(self, h: np.ndarray) -> np.ndarray:
        """False for hashes of text that no piece ends with."""
        return self.ends[self._at(h, ENDS, 0)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of each hash; a score of _NONE where no piece has it."""
        bits, keys, score, piece = self.levels[0]
        at = self._at(h, bits, 0)
        hit = keys[at] == h
        out, ids = np.where(hit, score[at], _NONE), piece[at]
        for level, (bits, keys, score, piece) in enumerate(self.levels[1:], 1):
            rest = np.flatnonzero(~hit)
            at = self._at(h[rest], bits, level)
            same = keys[at] == h[rest]
            out[rest[same]], ids[rest[same]], hit[rest[same]] = score[at[same]], piece[at[same]], True
        return out, ids


class Trie:
    """Segments distinct words together. ``counts`` and ``encode`` take any list of distinct words."""

    def __init__(self, v: Vocabulary):
        self.v, self.table = v, Table(v)
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(v.longest + 1)], np.uint64)

    def counts(self, distinct: list[str]) -> dict[str, int]:
        """Number of ids of each word."""
        def together(part: list[str]) -> list[int]:
            *_, total = self._forward(part, False)
            return total.tolist()

        return self._each(distinct, together, len, sum)

    def encode(self, distinct: list[str]) -> dict[str, bytes]:
        """Ids of each word, as the bytes of 32-bit integers."""
        return self._each(distinct, self._encoded, lambda ids: np.array(ids, np.int32).tobytes(), b"".join)

    def _each(self, distinct: list[str], together, alone, join) -> dict:
        """Results word by word: short words and parts of long ones in tries, ``alone`` of the ids of what is left."""
        cut = {w: parts(self.v, w) for w in distinct if len(w) > LONG}
        out: dict = {}
        sizes: dict[int, list[str]] = {LONG: [w for w in distinct if len(w) <= LONG]}
        for w in set().union(*cut.values()).difference(sizes[LONG]):
            sizes.setdefault(max(LONG, 1 << (len(w) - 1).bit_length()), []).append(w)
        for size, group in sizes.items():
            if size > LONG and len(group) < TOGETHER:
                out.update((w, alone(self._alone(w))) for w in group)
                continue
            group.sort()
            rows = max(1, BATCH * LONG // size)
            for a in range(0, len(group), rows):
                out.update(zip(group[a:a + rows], together(group[a:a + rows])))
        out.update((w, join(out[x] for x in own_parts)) for w, own_parts in cut.items())
        return out

    def _encoded(self, part: list[str]) -> list[bytes]:
        length, step, piece, total = self._forward(part, True)
        row, place = np.arange(len(part)), length.copy()
        flat = np.zeros(int(total.sum()), np.int32)
        at = np.cumsum(total)                          # filled from each word's end
        odd = []
        while len(row):
            own = piece[row, place]
            if (unknown := own < 0).any():
                odd += row[unknown].tolist()
            at[row] -= 1
            flat[np.maximum(at[row], 0)] = own
            place = place - step[row, place]
            stay = place > 0
            row, place = row[stay], place[stay]
        ends = np.cumsum(total)
        raw = flat.tobytes()
        out = [raw[4 * a:4 * b] for a, b in zip((ends - total).tolist(), ends.tolist())]
        for k in set(odd):
            out[k] = np.array(self._alone(part[k]), np.int32).tobytes()
        return out

    def _alone(self, word: str) -> list[int]:
        return trace(self.v, word, segment(self.v, word)[1], len(word))[0]

    def _forward(self, part: list[str], paths: bool):
        """Sorted words: lengths, and per word and place the last step and piece (if ``paths``), and the number of ids of each word."""
        length = np.fromiter(map(len, part), np.int64, len(part))
        deepest = int(length.max())
        inside = np.arange(deepest) < length[:, None]
        chars = np.zeros((len(part), deepest), np.uint32)
        chars[inside] = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        differ = np.ones((len(part), deepest + 1), bool)
        differ[1:, :-1] = (chars[1:] != chars[:-1]) | ~inside[1:] | ~inside[:-1]
        shared = differ.argmax(axis=1)                     # characters shared with the word before
        shared[0] = 0
        prefix = np.zeros((deepest + 1, len(part)), np.uint64)
        node = np.zeros((deepest + 1, len(part)), np.int32)
        best, count = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        step = np.zeros((len(part), deepest + 1), np.int8) if paths else None
        piece = np.zeros((len(part), deepest + 1), np.int32) if paths else None
        total = np.zeros(len(part), np.int64)
        for depth in range(1, deepest + 1):
            alive = np.flatnonzero(length >= depth)
            prefix[depth, alive] = prefix[depth - 1, alive] * _BASE + chars[alive, depth - 1] + np.uint64(1)
            new = shared[alive] < depth
            own = (np.cumsum(new) - 1).astype(np.int32)
            node[depth, alive] = own
            first = alive[new]                             # a word of each node at this depth
            top = np.full(len(first), _NONE)
            last, ids, many = np.zeros(len(first), np.int8), np.full(len(first), -1, np.int32), np.zeros(len(first), np.int64)
            whole, open_ = prefix[depth, first], np.arange(len(first))        # nodes where a piece of the size may end
            for size in range(1, min(depth, self.v.longest) + 1):
                hashes = whole[open_] - prefix[depth - size, first[open_]] * self.powers[size]
                if size > 1:
                    may = np.flatnonzero(self.table.may_end(hashes))
                    open_, hashes = open_[may], hashes[may]
                    if not len(open_):
                        break
                score, which = self.table.find(hashes)
                units = 1
                if size == 1 and (missing := score == _NONE).any():
                    c = chars[first, depth - 1]
                    units = np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))
                    score = np.where(missing, self.v.byte_score * units, score)
                    which = np.where(missing, -1, which)
                    units = np.where(missing, units, 1)
                    hit = open_
                else:
                    here = np.flatnonzero(score != _NONE)
                    if not len(here):
                        continue
                    hit, score, which = open_[here], score[here], which[here]
                before = node[depth - size, first[hit]]
                value = best[depth - size][before] + score
                win = np.flatnonzero(value >= top[hit])
                hit, before = hit[win], before[win]
                top[hit], last[hit], ids[hit] = value[win], size, which[win]
                many[hit] = count[depth - size][before] + (units[win] if isinstance(units, np.ndarray) else units)
            best.append(top), count.append(many)
            ends = alive[length[alive] == depth]
            total[ends] = many[node[depth, ends]]
            if paths:
                step[alive, depth], piece[alive, depth] = last[own], ids[own]
        return length, step, piece, total
