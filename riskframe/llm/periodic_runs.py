"""Periodic runs of words, found by longest common extensions from a difference cover.

A run is a stretch of consecutive words with smallest period q and at least ``exponent`` * q (and
``least``) words that no neighbouring word extends keeping period q.  Texts are split at ASCII
blanks; a text is handled whole, in the task that reads it, together with the texts beside it
(about 1 MB at a time), and nothing is shuffled.

1. Words become numbers (exactly, by dictionary); a number of its own stands before and behind each
   text, so no extension leaves a text.
2. ``Extensions``: only suffixes at positions whose residue modulo ``MOD`` lies in ``COVER`` are sorted: by
   their first ``MOD`` words, then by doubling over sampled suffixes.  Any two positions reach sampled ones
   after the same number of steps, fewer than ``MOD`` (every difference occurs in the cover), so
   a common extension is a few compared words and one range minimum in a sparse table
   over the lengths common to neighbours in sorted order.  A second structure over the reversed words extends backward.
3. Harmonic grid: words equal to those q further on form a stretch of (exponent - 1) * q places or more
   in a run of period q, so one of the places 0, g, 2g, ... with g = (exponent - 1) * q lies in it.
   Extending each of them forward and backward finds all runs; of all places there are n log n.
   A stretch found under a multiple of its period is kept under the smallest.

Defined results: a null text is empty and has no words and no runs; rows with equal or null ids are
separate rows; equal runs are reported once; empty tables give no rows; other columns are ignored,
whatever their names.  Memory in a task is about 100 bytes a word of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.textnp import byte_buffer, chunks, give_back

LEAST, EXPONENT = 6, 4
#: A perfect difference set: every residue modulo MOD but 0 is the difference of exactly one ordered pair.
MOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Grid places handled at a time.
PLACES = 1 << 20

_IN_COVER = np.isin(np.arange(MOD), COVER)
_ORDINAL = np.cumsum(_IN_COVER) - 1
#: Steps after which two residues are both in the cover.
_STEPS = np.array([[next(d for d in range(MOD) if _IN_COVER[(a + d) % MOD] and _IN_COVER[(b + d) % MOD])
                    for b in range(MOD)] for a in range(MOD)], dtype=np.int64)


def _sampled(at: np.ndarray) -> np.ndarray:
    """Number of a sampled position among the sampled ones."""
    return at // MOD * len(COVER) + _ORDINAL[at % MOD]


def _split_ties(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order suffixes of equal rank by ``key``, in place; returns those that are still equal to another."""
    order = np.lexsort((key, rank[tied]))
    tied, key = tied[order], key[order]
    old = rank[tied]
    group = np.r_[True, old[1:] != old[:-1]]
    first = group | np.r_[True, key[1:] != key[:-1]]
    at = np.arange(len(tied))
    rank[tied] = old + np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
    return tied[~(first & np.r_[first[1:], True])]


class Extensions:
    """Common extensions of suffixes of ``s``, whose last number occurs once."""

    def __init__(self, s: np.ndarray):
        self.s = s
        at = np.flatnonzero(np.tile(_IN_COVER, -(-len(s) // MOD))[:len(s)])
        padded = np.r_[s, np.full(MOD + 64, -1)] + 1
        bits = max(1, int(padded.max()).bit_length())
        width = min(MOD, 63 // bits)
        rank, tied = np.zeros(len(at), np.int64), np.arange(len(at))
        for b in range(0, MOD, width):
            if not len(tied):
                break
            key = np.zeros(len(tied), np.int64)
            for t in range(b, min(b + width, MOD)):
                key = key << bits | padded[at[tied] + t]
            tied = _split_ties(rank, tied, key)
        ranks, step = [rank.copy()], len(COVER)
        while len(tied):
            ahead = tied + step
            tied = _split_ties(rank, tied, np.where(ahead < len(at), ranks[-1][np.minimum(ahead, len(at) - 1)], -1))
            ranks.append(rank.copy())
            step *= 2
        self.rank = rank
        order = np.argsort(rank)
        self._common(at, order[:-1], order[1:], ranks[:-1], step // 2)

    def _common(self, at: np.ndarray, a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray], step: int) -> None:
        """Sparse table over the words that suffixes have in common with their successors in sorted order."""
        a, b, common = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for rank in reversed(ranks):
            end = len(rank) - 1
            same = (rank[np.minimum(a, end)] == rank[np.minimum(b, end)]) & (np.maximum(a, b) <= end)
            a, b, common = a + step * same, b + step * same, common + step // len(COVER) * MOD * same
            step //= 2
        more, left, right = np.arange(len(a)), at[a], at[b]
        for t in range(MOD):
            more = more[self.s[left[more] + t] == self.s[right[more] + t]]
            if not len(more):
                break
            common[more] += 1
        self.minima = [common.astype(np.int32)]
        while len(self.minima[-1]) > 1 << len(self.minima) - 1:
            low, h = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(low[:-h], low[h:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from ``i`` and ``j`` on (never equal positions) agree."""
        steps = _STEPS[i % MOD, j % MOD]
        out, live = np.zeros(len(i), np.int64), np.arange(len(i))
        ready = []
        for t in range(MOD):
            there = steps[live] == t
            ready.append(live[there])
            live = live[~there]
            live = live[self.s[i[live] + t] == self.s[j[live] + t]]
            out[live] += 1
            if not len(live):
                break
        ready = np.concatenate(ready)
        x, y = self.rank[_sampled(i[ready] + steps[ready])], self.rank[_sampled(j[ready] + steps[ready])]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            some = level == k
            m = self.minima[k]
            out[ready[some]] += np.minimum(m[low[some]], m[high[some] - (1 << k)])
        return out


def grid(first: np.ndarray, counts: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods): the harmonic grids of texts that start at ``first`` and have ``counts`` numbers."""
    periods = counts // exponent
    text = np.repeat(np.arange(len(counts)), periods)
    q = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(periods) - periods, periods)
    gap = (exponent - 1) * q
    number = -(-(counts[text] - q) // gap)
    ends = np.r_[0, np.cumsum(number)]
    for a, z in chunks(ends, PLACES):
        which = np.repeat(np.arange(a, z), number[a:z])
        yield first[text[which]] + (np.arange(ends[a], ends[z]) - ends[which]) * gap[which], q[which]


def runs_of(s: np.ndarray, first: np.ndarray, counts: np.ndarray, least: int = LEAST,
            exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of all runs, by start, then period.

    ``s`` holds the numbers of all texts, each with a number of its own before and behind it."""
    found = [np.zeros((3, 0), np.int64)]
    ahead = behind = None
    for x, q in grid(first, counts, exponent):
        same = s[x] == s[x + q]
        x, q = x[same], q[same]
        if not len(x):
            continue
        if ahead is None:
            ahead, behind = Extensions(s), Extensions(s[::-1])
        start = x - behind.common(len(s) - x, len(s) - x - q)
        length = x + ahead.common(x, x + q) + q - start
        run = length >= np.maximum(least, exponent * q)
        found.append(np.stack([start[run], length[run], q[run]]))
    start, length, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    keep = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][:len(start)]
    start, length, q = start[keep], length[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(least: int, exponent: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, z in chunks(byte_buffer(texts)[1]):
                words = [(t or b"").split() for t in texts.slice(a, z - a).cast(pa.binary()).to_pylist()]
                counts = np.array([len(w) for w in words])
                first = np.cumsum(counts + 1) - counts  # a place is free before each text, and one behind the last
                flat = pa.array([w for text in words for w in text], pa.binary()).dictionary_encode()
                s = np.empty(len(flat) + len(words) + 1, np.int64)
                between = np.r_[first - 1, len(s) - 1]
                s[between] = len(flat.dictionary) + np.arange(len(between))
                inside = np.ones(len(s), bool)
                inside[between] = False
                s[inside] = flat.indices.to_numpy()
                start, length, q = runs_of(s, first, counts, least, exponent)
                cover = np.bincount(start + q, minlength=len(s) + 1) - np.bincount(start + length, minlength=len(s) + 1)
                gone = np.cumsum(cover) > 0
                text = np.searchsorted(first, start, "right") - 1
                ends = np.searchsorted(text, np.arange(z - a + 1)).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(start - first[text]), pa.array(length), pa.array(q)], fields=list(RUN))
                kept = [b" ".join(w if ends[d] == ends[d + 1] else [x for x, out in zip(w, gone[first[d]:first[d] + len(w)].tolist()) if not out])
                        for d, w in enumerate(words)]
                yield pa.record_batch([ids.slice(a, z - a), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), runs),
                                       pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
        give_back()
    return find


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  exponent: int = EXPONENT) -> DataFrame:
    """One row per row: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    ``collapsed`` is the text's words without those that any run holds after its first period."""
    if exponent < 2 or least < 1:
        raise ValueError("a run repeats its period at least twice and is not empty")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(_find(least, exponent), "doc_id long, n_words long, "
                           "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of runs and collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"), F.floor(-F.col("best.n") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def repeated(doc_id: Column, words: Column) -> Column:
    """The text that op12 reads: in every tenth document the words from some place on repeat the first few there."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p)))
    return F.array_join(F.when((h % 10 == 0) & (n > 0), again).otherwise(words), " ")


def with_repeats(docs: DataFrame) -> DataFrame:
    split = F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")
    return docs.select("doc_id", F.filter(split, lambda w: w != "").alias("w")).select("doc_id", repeated(F.col("doc_id"), F.col("w")).alias("text"))
