"""SentencePiece encoding and decoding over a piece table.

A text is written with a mark for each blank and one in front; marks begin words, and no piece
crosses a word's beginning, so words are encoded independently.  A word's lattice has an edge
for each of its substrings that is a piece, weighted by the piece's score, and an edge for
each character that is no piece.  The fold over the lattice follows the model file's type:

* ``unigram``: the path of highest total score (Viterbi), ties to the edge that starts first,
* ``bpe``: from single characters, again and again the two neighbours whose union is the edge of
  highest score, the leftmost of equals, until no union is an edge.  (The best path is not what
  such a model means: on its scores Viterbi gives other pieces for most words.)

Characters without a piece become the pieces of their UTF-8 bytes.

Two forms of the same lattice:

* ``relational_lattice``: explode the bounded-length substrings of distinct words, equi-join them
  to the piece table, group the edges by word and fold them with Spark's ``aggregate``.
  It encodes the corpus' frequent words (``LEXICON_WORDS`` at most, chosen by counts over all
  documents) into a lexicon.
* ``Lattice.encode``: the same fold over all remaining distinct words of a task's texts at once,
  in numpy.  Sending every word of every text through an exchange to meet a relational
  lexicon of all words, and back, would move many times the input (figures in the README).

Decoding concatenates the pieces; blank marks become blanks, byte pieces bytes.  It is the exact
inverse for every text: a literal mark character in a text is encoded by its bytes.

Defined results: a null text is empty and has no pieces; rows with equal or null ids are
encoded each; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.tables import written
from riskframe.llm.textnp import byte_buffer, chunks, give_back, mix

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Added to the lowest score for a character without a piece.
UNKNOWN_PENALTY = 10.0
#: Most words of the relational lexicon.
LEXICON_WORDS = 60_000
#: Longest word (in characters) that goes through the relational lattice.
LEXICON_CHARS = 32
#: Bytes of text, and of distinct words, that a task handles at a time (a lattice has some hundred bytes a byte).
TEXT_BYTES, FOLD_BYTES = 1 << 19, 1 << 16
#: Words of more bytes are merged one at a time with a heap, the others all at once.
LONG_WORD = 64
_K = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20
_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


class PieceTable:
    """Type, pieces, scores and the ids of the byte pieces of a model file (read on the driver only)."""

    def __init__(self, kind: str, pieces: list[str], scores: list[float], ids: list[int], byte_ids: list[int]):
        self.kind, self.pieces, self.scores, self.ids, self.byte_ids = kind, pieces, scores, ids, byte_ids

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> PieceTable:
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        return cls.of(model)

    @classmethod
    def of(cls, model) -> PieceTable:
        kinds = {model.trainer_spec.UNIGRAM: "unigram", model.trainer_spec.BPE: "bpe"}
        if model.trainer_spec.model_type not in kinds:
            raise ValueError("only unigram and bpe models have a lattice")
        normal, byte_ids = [], [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == p.BYTE:
                byte_ids[int(p.piece[3:5], 16)] = i
            elif p.type == p.NORMAL:
                normal.append((p.piece, float(p.score), i))
        if any(MARK in p.lstrip(MARK) for p, _, _ in normal):
            raise ValueError("a piece crosses the beginning of a word")
        return cls(kinds[model.trainer_spec.model_type], *(list(c) for c in zip(*normal)), byte_ids)

    @property
    def unknown_score(self) -> float:
        return min(self.scores) - UNKNOWN_PENALTY

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.pieces, self.ids, self.scores)), "piece string, id int, score double")


def _inner(word: str) -> bytes:
    """A word's bytes inside tasks: 0xFF, which no UTF-8 text contains, for each blank mark."""
    return word.encode().replace(MARK.encode(), b"\xff")


def _hash_steps(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return h * _K + byte.astype(np.uint64) + np.uint64(1)


class Lattice:
    """The piece table as arrays, and a lexicon of words that are already encoded."""

    def __init__(self, table: PieceTable, lexicon: list[tuple[str, list[int]]] = ()):
        self.kind = table.kind
        data = [_inner(p) for p in table.pieces]
        self.ids = np.asarray(table.ids, np.int64)
        self.scores = np.asarray(table.scores)
        self.unknown = table.unknown_score
        self.byte_ids = np.asarray(table.byte_ids, np.int64)
        self.longest = max(map(len, data))
        keys = self._whole(data, piece_hashes)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], self.ids[order], self.scores[order]
        self.some = np.zeros(1 << _FILTER_BITS, bool)
        self.some[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        used = np.unique(np.frombuffer(b"".join(data), np.uint8))
        self.single = np.ones(128, bool)  # ASCII bytes that no piece contains are words of their own
        self.single[used[used < 128]] = False
        words = [_inner(w) for w, _ in lexicon]
        known = self._whole(words, word_hashes) if words else np.zeros(0, np.uint64)
        order = np.argsort(known)
        self.known = known[order]
        self.known_size = np.array([len(w) for w in words], np.int64)[order]
        self.known_at = np.cumsum(self.known_size) - self.known_size
        self.known_bytes = np.frombuffer(b"".join(words[k] for k in order) or b" ", np.uint8)
        counts = np.array([len(i) for _, i in lexicon], np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1] if len(counts) else np.zeros(0, np.int64)
        self.known_ids = np.array([i for _, ids in lexicon for i in ids], np.int64)
        self.known_first, self.known_count = first[order], counts[order]
        # for decoding: bytes of every id
        size = max(int(self.ids.max()), int(self.byte_ids.max())) + 1
        spelled = [b""] * size
        for p, i in zip(table.pieces, table.ids):
            spelled[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(table.byte_ids):
            spelled[i] = bytes([b])
        self.spelled_first = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    @staticmethod
    def _whole(words: list[bytes], hashes) -> np.ndarray:
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = np.array([len(w) for w in words], np.int64)
        return hashes(raw, np.cumsum(n) - n, n)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text plus the end) for some texts."""
        marked, text_at, text_end = with_marks(raw, offsets)
        start, end, text = words_at(marked, text_at, text_end, self.single)
        distinct, at, of = distinct_words(marked, start, end)
        ids, first, count = self._encode_distinct(marked, distinct, start[at], end[at])
        n = count[of]
        total = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(first[of] - total[:-1], n) + np.arange(total[-1])
        per_text = np.bincount(text, n, len(offsets) - 1).astype(np.int64)
        return ids[where], np.concatenate([[0], np.cumsum(per_text)])

    def _encode_distinct(self, marked, distinct, start, end):
        """(ids, first, count) of distinct words: from the lexicon where it has them, else by the lattice."""
        first, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        found = np.zeros(len(distinct), bool)
        if len(self.known):
            k = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
            found = (self.known[k] == distinct) & (self.known_size[k] == end - start)
            found[found] = same_bytes(marked, start[found], self.known_bytes, self.known_at[k[found]], self.known_size[k[found]])
            first[found], count[found] = self.known_first[k[found]], self.known_count[k[found]]
        rest = np.flatnonzero(~found)
        if not len(rest):
            return self.known_ids, first, count
        ids, n = self.fold(marked, start[rest], end[rest])
        first[rest] = len(self.known_ids) + np.cumsum(n) - n
        count[rest] = n
        return np.concatenate([self.known_ids, ids]), first, count

    def fold(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, number of ids of each); lattices of about ``FOLD_BYTES`` of words at a time."""
        block = np.cumsum(end - start) // FOLD_BYTES
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        parts = [self._fold(raw, start[a:z], end[a:z]) for a, z in zip(cuts[:-1], cuts[1:])]
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([n for _, n in parts])

    def _fold(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = end - start
        node = np.cumsum(n + 1) - (n + 1)  # a word's first node; node + i lies before its byte i
        word = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        b = raw[start[word] + place]
        boundary = np.ones(int((n + 1).sum()), bool)
        boundary[node[word] + place] = (b & 0xC0) != 0x80
        src, dst, val, piece = self._edges(b, word, place, node, n, boundary)
        if self.kind == "bpe":
            w, src, dst, piece = self._merge(src, dst, val, piece, node, n)
        else:
            w, src, dst, piece = self._best_paths(src, dst, val, piece, node, n)
        return self._spell(raw, start, node, n, w, src, dst, piece)

    @staticmethod
    def _best_paths(src, dst, val, piece, node, n):
        """Viterbi: (word, from, to, piece) of the edges on each word's best path, in order."""
        order = np.lexsort((src, dst, dst - node_of(dst, node)))
        src, dst, val, piece = src[order], dst[order], val[order], piece[order]
        nodes = int((n + 1).sum())
        best = np.full(nodes, -np.inf)
        best[node] = 0.0
        back, took = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        level = dst - node_of(dst, node)
        cuts = np.flatnonzero(np.r_[True, level[1:] != level[:-1], True]) if len(level) else np.zeros(1, int)
        for a, z in zip(cuts[:-1], cuts[1:]):  # all edges that end at the same distance into their word
            total = best[src[a:z]] + val[a:z]
            to = dst[a:z]
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            top = np.maximum.reduceat(total, first)
            size = np.diff(np.r_[first, len(to)])
            wins = np.flatnonzero(total == np.repeat(top, size))
            won = wins[np.r_[True, to[wins][1:] != to[wins][:-1]]]  # the edge that starts first
            best[to[won]], back[to[won]], took[to[won]] = top, src[a:z][won], piece[a:z][won]
        at, words, steps = node + n, np.arange(len(n)), []
        while True:
            live = at > node[words]
            words, at = words[live], at[live]
            if not len(words):
                break
            steps.append((words, back[at], at, took[at]))
            at = back[at]
        if not steps:
            return (np.zeros(0, np.int64),) * 4
        w, src, dst, piece = (np.concatenate(c) for c in zip(*steps))
        order = np.lexsort((src, w))
        return w[order], src[order], dst[order], piece[order]

    @staticmethod
    def _merge(src, dst, val, piece, node, n):
        """Merging: (word, from, to, piece) of each word's final pieces, in order."""
        reach = int((dst - src).max()) + 1 if len(src) else 1
        key = src * reach + (dst - src)
        order = np.argsort(key)
        key, val, piece = key[order], val[order], piece[order]

        def find(a, z):
            """Place of the edges a..z, -1 where there is none."""
            want = np.where((z > a) & (z - a < reach), a * reach + (z - a), -1)
            k = np.minimum(np.searchsorted(key, want), len(key) - 1)
            return np.where(key[k] == want, k, -1)

        # the first cut is into characters: the shortest edge from each node that begins one
        src, dst = src[order], dst[order]
        shortest = np.r_[True, src[1:] != src[:-1]]
        a, z = src[shortest], dst[shortest]
        word = np.searchsorted(node, a, "right") - 1
        # a character may also lie inside a longer piece that starts earlier; all characters are kept here
        done = [np.zeros((4, 0), np.int64)]
        far = n[word] > LONG_WORD
        for i in np.unique(word[far]):
            done.append(_merge_one(i, a[word == i], z[word == i], find, val, piece))
        a, z, word = a[~far], z[~far], word[~far]

        def union(i):
            """Score of merging segment i with the next one."""
            j = np.minimum(i + 1, len(a) - 1)
            k = np.where((i + 1 < len(a)) & (word[j] == word[i]), find(a[i], z[j]), -1)
            return np.where(k >= 0, val[k], -np.inf)

        score = union(np.arange(len(a))) if len(a) else np.zeros(0)
        while len(a):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            top = np.maximum.reduceat(score, first)
            size = np.diff(np.r_[first, len(a)])
            ended = np.repeat(top == -np.inf, size)
            if ended.any():
                done.append(np.stack([word[ended], a[ended], z[ended], piece[find(a[ended], z[ended])]]))
                a, z, word, score = a[~ended], z[~ended], word[~ended], score[~ended]
                top, size = top[top > -np.inf], size[top > -np.inf]
                if not len(a):
                    break
            wins = np.flatnonzero(score == np.repeat(top, size))
            wins = wins[np.r_[True, word[wins][1:] != word[wins][:-1]]]  # the leftmost of equals
            z[wins] = z[wins + 1]
            keep = np.ones(len(a), bool)
            keep[wins + 1] = False
            wins = wins - np.arange(len(wins))  # one segment before it is gone for each earlier word
            a, z, word, score = a[keep], z[keep], word[keep], score[keep]
            changed = np.zeros(len(a), bool)
            changed[wins] = changed[np.maximum(wins - 1, 0)] = True
            changed = np.flatnonzero(changed)
            score[changed] = union(changed)
        w, src, dst, piece = np.concatenate(done, axis=1)
        order = np.lexsort((src, w))
        return w[order], src[order], dst[order], piece[order]

    def _edges(self, b, word, place, node, n, boundary):
        """Edges (from node, to node, score, piece place or -1) of all words, by growing substrings."""
        at = np.flatnonzero(boundary[node[word] + place])  # characters' first bytes
        left = n[word[at]] - place[at]
        h = np.zeros(len(at), np.uint64)
        parts = []
        width = np.select([b[at] < 0x80, b[at] < 0xE0, b[at] < 0xF0, b[at] < 0xF8], [1, 2, 3, 4], 1)
        lone = np.zeros(len(at), bool)
        live = np.arange(len(at))
        for size in range(1, self.longest + 1):
            live = live[left[live] >= size]
            if not len(live):
                break
            h[live] = _hash_steps(h[live], b[at[live] + size - 1])
            ends = node[word[at[live]]] + place[at[live]] + size
            cand = live[boundary[ends]]
            key = mix(h[cand] + np.uint64(size * int(_K) & (1 << 64) - 1))
            maybe = self.some[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
            cand, key = cand[maybe], key[maybe]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            cand, k = cand[hit], k[hit]
            lone[cand[width[cand] == size]] = True
            from_node = node[word[at[cand]]] + place[at[cand]]
            parts.append((from_node, from_node + size, self.scores[k], k))
        alone = np.flatnonzero(~lone)
        from_node = node[word[at[alone]]] + place[at[alone]]
        parts.append((from_node, from_node + np.minimum(width[alone], left[alone]), np.full(len(alone), self.unknown),
                      np.full(len(alone), -1)))
        return tuple(np.concatenate(c) for c in zip(*parts))

    def _spell(self, raw, start, node, n, w, src, dst, piece):
        """(ids, number of ids per word); a character without a piece gives its bytes' ids."""
        size = np.where(piece < 0, dst - src, 1)
        total = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), np.int64)
        known = piece >= 0
        ids[total[known]] = self.ids[piece[known]]
        if not known.all():
            for i in np.flatnonzero(~known):
                byte = start[w[i]] + src[i] - node[w[i]]
                ids[total[i]:total[i] + size[i]] = self.byte_ids[raw[byte:byte + size[i]]]
        return ids, np.bincount(w, size, len(n)).astype(np.int64)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The texts of some id lists (UTF-8), without the blank in front."""
        n = self.spelled_first[ids + 1] - self.spelled_first[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(self.spelled_first[ids] - total[:-1], n) + np.arange(total[-1])
        data = self.spelled[where].tobytes()
        ends = total[first]
        return [data[a + 1:z] if z > a else b"" for a, z in zip(ends[:-1], ends[1:])]


def _merge_one(word: int, a: np.ndarray, z: np.ndarray, find, val: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The merges of one long word, by a heap of (score, place): time n log n in its characters."""
    a, z = a.tolist(), z.tolist()
    after = [*range(1, len(a)), -1]
    before = [-1, *range(len(a) - 1)]
    heap: list[tuple] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            k = int(find(np.array([a[i]]), np.array([z[after[i]]]))[0])
            if k >= 0:
                heapq.heappush(heap, (-val[k], a[i], i, z[i], z[after[i]]))

    for i in range(len(a)):
        offer(i)
    gone = [False] * len(a)
    while heap:
        _, _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j < 0 or z[i] != left or z[j] != right:
            continue  # one of the two has been merged meanwhile
        z[i], after[i], gone[j] = z[j], after[j], True
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    live = [i for i in range(len(a)) if not gone[i]]
    a, z = np.array(a)[live], np.array(z)[live]
    return np.stack([np.full(len(a), word), a, z, piece[find(a, z)]])


def node_of(dst: np.ndarray, node: np.ndarray) -> np.ndarray:
    return node[np.searchsorted(node, dst, "right") - 1]


def piece_hashes(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of at most a piece's length, grown byte by byte as in ``Lattice._edges``."""
    h, live, step = np.zeros(len(start), np.uint64), np.arange(len(start)), 0
    while True:
        live = live[length[live] > step]
        if not len(live):
            break
        h[live] = _hash_steps(h[live], raw[start[live] + step])
        step += 1
    return mix(h + length.astype(np.uint64) * _K)


def word_hashes(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of any length, the same for equal bytes wherever they lie.

    Powers of one factor cannot tell some regular words of a thousand letters apart, so a long word's hash is a sum over
    mixtures of its bytes with their places."""
    out = np.empty(len(start), np.uint64)
    long = length > LONG_WORD
    out[~long] = piece_hashes(raw, start[~long], length[~long])
    if long.any():
        start, length = start[long], length[long]
        before = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(before, length)
        places = mix(np.arange(1, int(length.max()) + 1, dtype=np.uint64) * _K)
        values = (_BYTES[raw[np.repeat(start, length) + place]] ^ places[place]) * _K
        values ^= values >> np.uint64(32)
        out[long] = mix(np.add.reduceat(values, before) + length.astype(np.uint64) * _K)
    return out


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which pairs of byte ranges (of equal, positive lengths) hold the same bytes."""
    if not len(length):
        return np.zeros(0, bool)
    before = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(before, length)
    return np.logical_and.reduceat(a[np.repeat(a_at, length) + place] == b[np.repeat(b_at, length) + place], before)


def distinct_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, place of one of each, number of each word's) of distinct byte ranges; equal hashes are checked by bytes."""
    size = end - start
    h = word_hashes(raw, start, size)
    distinct, at, of = np.unique(h, return_index=True, return_inverse=True)
    like = at[of]
    right = size == size[like]
    if right.all() and len(start) and (start[1:] == end[:-1]).all():  # side by side, as words of texts are: one look-up a byte
        same = raw[start[0]:end[-1]] == raw[np.arange(start[0], end[-1]) + np.repeat(start[like] - start, size)]
        if same.all():
            return distinct, at, of
    right[right] = same_bytes(raw, start[right], raw, start[like[right]], size[right])
    if right.all():
        return distinct, at, of
    # two words of one hash: all words of such hashes are told apart by their bytes
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(~right):
        seen.setdefault(raw[start[i]:end[i]].tobytes(), len(seen))
    other = {b: len(distinct) + k for b, k in seen.items()}
    for i in np.flatnonzero(~right):
        of[i] = other[raw[start[i]:end[i]].tobytes()]
    first = {int(of[i]): int(i) for i in np.flatnonzero(~right)[::-1]}
    more = [first[k] for k in range(len(distinct), len(distinct) + len(seen))]
    return np.concatenate([distinct, h[more]]), np.concatenate([at, np.array(more, at.dtype)]), of


def with_marks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): each non-empty text with a mark in front and a mark for each blank.

    A blank mark is the byte 0xFF inside tasks (no UTF-8 text contains it), so a literal mark
    character of a text stays what it is."""
    n = np.diff(offsets)
    some = n > 0
    size = n + some
    end = np.cumsum(size)
    out = np.empty(int(size.sum()), np.uint8)
    body = np.ones(len(out), bool)
    body[(end - size)[some]] = False
    out[~body] = 0xFF
    out[body] = np.where(raw == 32, 0xFF, raw)
    return out, end - size, end


def words_at(b: np.ndarray, text_at: np.ndarray, text_end: np.ndarray, single: np.ndarray):
    """(start, end, text) of the words: cut before each run of marks and around bytes that no piece has."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = b == 0xFF
    own = np.zeros(256, bool)
    own[:128] = single
    lone = own[b]
    cut = np.zeros(len(b), bool)
    cut[text_at[text_end > text_at]] = True
    cut[1:] |= mark[1:] & ~mark[:-1]
    cut |= lone
    cut[1:] |= lone[:-1]
    start = np.flatnonzero(cut)
    return start, np.r_[start[1:], len(b)], np.searchsorted(text_at, start, "right") - 1


# --- the relational form -------------------------------------------------------------------------


def words_column(text: Column, table: PieceTable) -> Column:
    """Array of the words of a text, each with its blank marks, by the same cuts as in ``words_at``."""
    used = {c for p in table.pieces for c in p}
    lone = "".join(f"\\x{i:02X}" for i in range(128) if chr(i) not in used and i != 32)
    some = F.when(F.length(text) > 0, F.concat(F.lit(MARK), F.translate(text, " ", MARK)))
    return F.coalesce(F.regexp_extract_all(some, F.lit(f"{MARK}+[^{MARK}{lone}]*|[{lone}]|[^{MARK}{lone}]+"), F.lit(0)),
                      F.array().cast("array<string>"))


def frequent_words(docs: DataFrame, table: PieceTable, text_col: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """At most ``most`` words, all those above a count: a histogram of counts (by powers of two in
    eighths) finds the least count for which they fit, so no task orders all words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = ~text.contains(MARK)  # a literal mark is not a blank: such texts are left to the tasks
    counts = written(docs.filter(plain).select(F.explode(words_column(text, table)).alias("word"))
                     .groupBy("word").agg(F.count("*").alias("n")).filter(F.length("word") <= LEXICON_CHARS)
                     .filter("n > 1"), "piece-words")
    step = F.floor(F.log2("n") * 8).cast("int")
    histogram = sorted(((r["b"], r["c"]) for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("c")).collect()),
                       reverse=True)
    least, total = None, 0
    for b, c in histogram:
        total += c
        if total > most:
            break
        least = b
    return counts.filter(step >= least if least is not None else F.lit(False)).select("word")


def relational_lattice(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, ids) of distinct words: substrings exploded, joined to the pieces, grouped and folded."""
    spark = words.sparkSession
    longest = max(map(len, table.pieces))
    pieces = F.broadcast(table.frame(spark))  # as many rows as the model has pieces
    spans = (words.select("word", F.length("word").alias("n"))
             .select("word", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
             .select("word", "n", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("start"))))
                     .alias("size"))
             .withColumn("piece", F.substring(F.col("word"), F.col("start") + 1, F.col("size"))))
    edges = (spans.join(pieces, "piece", "left").filter(F.col("id").isNotNull() | (F.col("size") == 1))
             .select("word", "n", (F.col("start") + F.col("size")).alias("end"), "start",
                     F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(table.unknown_score)).alias("score"),
                     F.when(F.col("id").isNull(), F.col("piece")).alias("char")))
    lattice = edges.groupBy("word", "n").agg(F.sort_array(F.collect_list(F.struct("end", "start", "id", "score", "char"))).alias("e"))
    byte_ids = F.array(*[F.lit(i) for i in table.byte_ids])

    def spelled(x: Column) -> Column:
        digits = F.hex(F.encode(x["char"], "UTF-8"))
        return F.when(x["char"].isNull(), F.array(x["id"])).otherwise(F.transform(
            F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1),
            lambda i: F.get(byte_ids, F.conv(F.substring(digits, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))))

    path = _merged(F.col("e"), F.col("n")) if table.kind == "bpe" else _best_path(F.col("e"), F.col("n"))
    return lattice.select("word", path.alias("path")).select("word", F.flatten(F.transform("path", spelled)).alias("ids"))


def _best_path(edges: Column, n: Column) -> Column:
    """Viterbi as two folds: the best edge into each place of the word, then back from its end."""
    def node(score, start, id_, char):
        return F.struct(score.alias("score"), start.alias("start"), id_.alias("id"), char.alias("char"))

    nothing = F.lit(None).cast("string")
    none = node(F.lit(float("-inf")), F.lit(-1), F.lit(-1), nothing)
    root = node(F.lit(0.0), F.lit(-1), F.lit(-1), nothing)

    def into(nodes: Column, end: Column) -> Column:
        def better(old: Column, x: Column) -> Column:
            total = F.get(nodes, x["start"])["score"] + x["score"]
            return F.when(total > old["score"], node(total, x["start"], x["id"], x["char"])).otherwise(old)
        return F.concat(nodes, F.array(F.aggregate(F.filter(edges, lambda x: x["end"] == end), none, better)))

    def path(nodes: Column) -> Column:
        def back(acc: Column, _: Column) -> Column:
            x = F.get(nodes, acc["at"])
            return F.when(acc["at"] > 0, F.struct(x["start"].alias("at"), F.concat(F.array(x), acc["path"]).alias("path"))) \
                .otherwise(acc)
        start = F.struct(n.alias("at"), F.filter(F.array(root), lambda x: F.lit(False)).alias("path"))
        return F.aggregate(F.sequence(F.lit(1), n), start, back)["path"]

    nodes = F.aggregate(F.sequence(F.lit(1), n), F.array(root), into)
    return F.flatten(F.transform(F.array(nodes), path))  # binds the nodes once


def _merged(edges: Column, n: Column) -> Column:
    """Merging as a fold over the cuts of a word: each step removes the cut inside the best union."""
    def step(cuts: Column, _: Column) -> Column:
        def fits(x: Column) -> Column:
            return F.array_contains(cuts, x["start"]) & F.array_contains(cuts, x["end"]) & \
                (F.size(F.filter(cuts, lambda c: (c > x["start"]) & (c < x["end"]))) == 1)

        best = F.array_min(F.transform(F.filter(edges, fits), lambda x: F.struct(
            (-x["score"]).alias("s"), x["start"].alias("start"), x["end"].alias("end"))))
        return F.flatten(F.transform(F.array(best), lambda b: F.when(b.isNull(), cuts).otherwise(
            F.filter(cuts, lambda c: (c <= b["start"]) | (c >= b["end"])))))

    cuts = F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step)
    chosen = F.transform(F.array(cuts), lambda c: F.filter(edges, lambda x: F.array_contains(c, x["start"]) & F.array_contains(
        c, x["end"]) & (F.size(F.filter(c, lambda k: (k > x["start"]) & (k < x["end"]))) == 0)))
    return F.array_sort(F.flatten(chosen))


def build_lexicon(docs: DataFrame, table: PieceTable, text_col: str = "text", most: int = LEXICON_WORDS) -> list[tuple[str, list[int]]]:
    """The frequent words with their ids; at most ``most`` rows reach the driver."""
    lexicon = written(relational_lattice(frequent_words(docs, table, text_col, most), table), "piece-lexicon")
    return [(r["word"], list(r["ids"])) for r in lexicon.collect()]


def encode(docs: DataFrame, table: PieceTable, lexicon: list[tuple[str, list[int]]], id_col: str = "doc_id",
           text_col: str = "text", round_trip: bool = False) -> DataFrame:
    """(doc_id, text, ids): every text with the ids of its pieces.

    With ``round_trip`` the ids are decoded again in the same task, and whether that gives the text
    stands in the text's place."""
    shared = docs.sparkSession.sparkContext.broadcast(Lattice(table, lexicon))  # arrays of a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value
        for batch in batches:
            raw, offsets = byte_buffer(batch.column("text"))
            for a, z in chunks(offsets, TEXT_BYTES):
                part, ends = raw[offsets[a]:offsets[z]], offsets[a:z + 1] - offsets[a]
                ids, first = lattice.encode(part, ends)
                if round_trip:
                    back = lattice.decode(ids, first)
                    second = pa.array([part[s:e].tobytes() == t for s, e, t in zip(ends[:-1], ends[1:], back)], pa.bool_())
                else:
                    second = batch.column("text").slice(a, z - a)
                column = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([batch.column("doc_id").slice(a, z - a), second, column],
                                      names=["doc_id", "round_trip" if round_trip else "text", "ids"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {'round_trip boolean' if round_trip else 'text string'}, ids array<int>")


def decode(encoded: DataFrame, table: PieceTable) -> DataFrame:
    """The columns of ``encoded`` (doc_id, text, ids) and ``decoded``, from the ids alone."""
    shared = encoded.sparkSession.sparkContext.broadcast(Lattice(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value
        for batch in batches:
            lists = batch.column("ids")
            if lists.null_count:
                raise ValueError("a row has no ids")
            first = np.asarray(lists.offsets).astype(np.int64)
            ids = np.asarray(lists.values).astype(np.int64)[first[0]:first[-1]]
            texts = [t.decode("utf-8", "surrogatepass") for t in lattice.decode(ids, first - first[0])] if len(first) > 1 else []
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
        give_back()

    return encoded.mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def encode_and_decode(docs: DataFrame, model: str = DEFAULT_MODEL, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_sha256 (of the comma-joined ids), round_trip (decoded = text),
    and the ids themselves if asked for."""
    table = PieceTable.load(model)
    both = encode(docs, table, build_lexicon(docs, table), round_trip=True)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"),
                       F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), "round_trip",
                       *(["ids"] if with_ids else []))
