"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A text's words are read in overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, from the
first word to the last.  A word enters as the sum of two inputs: a vector of its own (hashed)
and the vectors of its character 4-grams (hashed, with a mark at its beginning), so that words
never seen in training are read by their letters.  The network runs over the window in both
directions; attention weighs its positions; a logistic unit scores the window.  The
document's score is that of its worst window.

Training is on a bounded sample: up to ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled documents
outside the held-out fold, chosen by a hash of their id, one row of each; a text of more than ``SAMPLE_CHARS``
characters enters with ``SAMPLE_CUTS`` stretches, spread over all of it (scoring has no such bound).  Labels belong to documents, so training begins with random
windows of each document and then takes the windows that score highest, and random ones beside
them.  A fifth of the sample is not trained on: the document scores found there fit the logistic
scale that turns the worst window's logit into a probability for a whole document.
It is one task, in numpy by backpropagation through time; its weights go to all tasks of the
scoring pass.

Defined results: a null or wordless text scores 0; without training documents of both classes
every score is 0; a document whose labels disagree counts as toxic; rows with equal or null ids are
scored each; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm import gru
from riskframe.llm.langid import held_out, stretches
from riskframe.llm.tables import fingerprint, without, written
from riskframe.llm.textnp import Words, byte_buffer, chunks, give_back, mix

WINDOW, STRIDE = 32, 16
HIDDEN, VECTOR, ATTEND = 8, 16, 8
#: Rows of the hashed tables of words and of character 4-grams.
WORD_ROWS = GRAM_ROWS = 1 << 15
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS, SAMPLE_CUTS = 1000, 2000, 6_000, 8
THRESHOLD = 0.7
BLOCK = 4096


class Inputs:
    """The distinct words of some texts, as hashed rows, and the texts' windows over them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        words = Words(raw, offsets)
        self.texts = words.texts
        distinct, at, self.word = np.unique(words.hash, return_index=True, return_inverse=True)
        self.rows = (distinct % np.uint64(WORD_ROWS)).astype(np.int64)
        self.grams, gram_of = self._grams(words, at)
        self.gram_first = np.searchsorted(gram_of, np.arange(len(self.rows) + 1))
        self._windows(words)

    @staticmethod
    def _grams(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of every 4-gram of bytes of the distinct words, the first with a leading mark."""
        start, end = words.start[at], words.end[at]
        low = np.concatenate([words.low, np.zeros(4, np.uint8)]).astype(np.uint64)
        n = np.maximum(0, end - start - 3)
        of = np.repeat(np.arange(len(at)), n)
        p = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        whole = low[p] | low[p + 1] << np.uint64(8) | low[p + 2] << np.uint64(16) | low[p + 3] << np.uint64(24)
        lead = np.full(len(at), 1 << 32, np.uint64)
        for j in range(3):
            lead |= np.where(start + j < end, low[np.minimum(start + j, len(low) - 1)], 0).astype(np.uint64) << np.uint64(8 * j)
        rows = (mix(np.concatenate([whole, lead])) % np.uint64(GRAM_ROWS)).astype(np.int64)
        of = np.concatenate([of, np.arange(len(at))])
        order = np.argsort(of, kind="stable")
        return rows[order], of[order]

    def _windows(self, words: Words) -> None:
        n = words.counts
        k = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
        self.text = np.repeat(np.arange(self.texts), k)
        j = np.arange(len(self.text)) - np.repeat(np.cumsum(k) - k, k)
        self.at = words.first[self.text] + STRIDE * j
        self.length = np.minimum(WINDOW, words.first[self.text + 1] - self.at)

    def index(self, pick) -> np.ndarray:
        """(steps, windows) numbers of distinct words, one past the last where a window has ended."""
        at, length = self.at[pick], self.length[pick]
        step = np.arange(WINDOW)[:, None]
        inside = step < length[None, :]
        return np.where(inside, self.word[np.where(inside, at[None, :] + step, 0)], len(self.rows))

    def gram_rows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in ``some``) of the grams of some distinct words."""
        n = self.gram_first[some + 1] - self.gram_first[some]
        of = np.repeat(np.arange(len(some)), n)
        return self.grams[self.gram_first[some][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)], of

    def vectors(self, w: dict[str, np.ndarray], some: np.ndarray) -> np.ndarray:
        """(words + 1, VECTOR) of some distinct words; the last row, for ended windows, is zero."""
        out = np.zeros((len(some) + 1, VECTOR), gru.F4)
        if len(some):
            rows, of = self.gram_rows(some)
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out[:-1] = w["word"][self.rows[some]] + np.add.reduceat(w["gram"][rows], first, axis=0)
        return out


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    # nearly zero tables: what was not seen in training says nothing
    w = {"word": 0.01 * rng.standard_normal((WORD_ROWS, VECTOR)), "gram": 0.01 * rng.standard_normal((GRAM_ROWS, VECTOR)),
         "in": 0.4 * rng.standard_normal((6 * HIDDEN, VECTOR)), "in_bias": np.zeros((6 * HIDDEN, 1)),
         "re_f": gru.start(rng, HIDDEN), "re_b": gru.start(rng, HIDDEN),
         "look": 0.4 * rng.standard_normal((ATTEND, 2 * HIDDEN)), "look_bias": np.zeros((ATTEND, 1)),
         "weigh": 0.4 * rng.standard_normal((1, ATTEND)), "out": 0.4 * rng.standard_normal((1, 2 * HIDDEN)),
         "out_bias": np.full((1, 1), -1.0), "scale": np.array([[1.0, 0.0]])}
    return {k: v.astype(gru.F4) for k, v in w.items()}


def forward(w: dict[str, np.ndarray], table: np.ndarray, index: np.ndarray, ended: int, keep: dict | None = None) -> np.ndarray:
    """Logit of each window.  ``table``: (6 H, distinct words + 1) pre-activations."""
    trace_f, trace_b = ([], []) if keep is not None else (None, None)
    hf = gru.states(table[:3 * HIDDEN], w["re_f"], index, False, trace_f)
    hb = gru.states(table[3 * HIDDEN:], w["re_b"], index, True, trace_b)
    h = np.concatenate([hf, hb], axis=1)
    seen = gru.squash(w["look"] @ h + w["look_bias"])
    e = (w["weigh"] @ seen)[:, 0, :]
    e = np.where(index == ended, gru.F4(-1e9), e)
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    context = np.einsum("tb,thb->hb", a, h)
    logit = (w["out"] @ context + w["out_bias"])[0]
    if keep is not None:
        keep.update(h=h, seen=seen, a=a, context=context, trace_f=trace_f, trace_b=trace_b)
    return logit


def chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def gradients(w: dict[str, np.ndarray], x: Inputs, pick: np.ndarray, goal: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean loss over some windows."""
    index = x.index(pick)
    some, index = np.unique(index, return_inverse=True)
    index = index.reshape(WINDOW, len(pick))
    some = some[some < len(x.rows)]  # an ended window's number, if any, is the last
    vectors = x.vectors(w, some)
    keep: dict = {}
    logit = forward(w, w["in"] @ vectors.T + w["in_bias"], index, len(some), keep)
    h, seen, a = keep["h"], keep["seen"], keep["a"]
    d_logit = ((chance(logit) - goal) / len(goal)).astype(gru.F4)[None, :]
    g = {"out": d_logit @ keep["context"].T, "out_bias": d_logit.sum(axis=1, keepdims=True)}
    d_context = w["out"].T @ d_logit
    d_h = a[:, None, :] * d_context[None]
    d_a = np.einsum("thb,hb->tb", h, d_context)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    g["weigh"] = np.einsum("tb,tkb->k", d_e, seen)[None, :]
    d_seen = w["weigh"].T[None] * d_e[:, None, :] * (1 - np.abs(seen)) ** 2
    g["look"] = np.einsum("tkb,thb->kh", d_seen, h, optimize=True)
    g["look_bias"] = d_seen.sum(axis=(0, 2))[:, None]
    d_h += w["look"].T @ d_seen
    g["re_f"], d_f = gru.backward(w["re_f"], keep["trace_f"], d_h[:, :HIDDEN])
    g["re_b"], d_b = gru.backward(w["re_b"], keep["trace_b"], d_h[:, HIDDEN:])
    d_table = gru.table_gradient(index, np.concatenate([d_f, d_b], axis=1), len(some) + 1)
    g["in"] = d_table @ vectors
    g["in_bias"] = d_table.sum(axis=1, keepdims=True)
    d_vectors = (d_table.T @ w["in"])[:-1]
    g["word"] = gru.sum_rows(x.rows[some], d_vectors, WORD_ROWS)
    rows, of = x.gram_rows(some)
    g["gram"] = gru.sum_rows(rows, d_vectors[of], GRAM_ROWS)
    return g


def window_logits(w: dict[str, np.ndarray], x: Inputs) -> np.ndarray:
    table = w["in"] @ x.vectors(w, np.arange(len(x.rows))).T + w["in_bias"]
    out = np.empty(len(x.text), gru.F4)
    for a in range(0, len(x.text), BLOCK):
        some = slice(a, a + BLOCK)
        out[some] = forward(w, table, x.index(some), len(x.rows))
    return out


def worst_windows(x: Inputs, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts with a word, logit of each one's worst window)."""
    if not len(x.text):
        return x.text, logits
    first = np.flatnonzero(np.r_[True, x.text[1:] != x.text[:-1]])
    return x.text[first], np.maximum.reduceat(logits, first)


def score_texts(w: dict[str, np.ndarray], raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Score of each text: its worst window, on the documents' scale; 0 without a word."""
    out = np.zeros(len(offsets) - 1)
    slope, shift = w["scale"][0]
    for a, b in chunks(offsets):
        x = Inputs(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        text, worst = worst_windows(x, window_logits(w, x))
        out[a + text] = chance(slope * worst + shift)
    return out


def document_scale(logit: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic fit of labels on logits (Newton steps, targets drawn in by one case a class)."""
    up, down = float((label == 1).sum()), float((label == 0).sum())
    goal = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([logit, np.ones_like(logit)]).astype(float)
    b = np.array([1.0, 0.0])
    for _ in range(steps):
        p = chance(b @ x)
        move = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - goal) + 1e-3 * (b - [1, 0]))
        b = b - np.clip(move, -1, 1)
    return float(max(b[0], 1e-3)), float(b[1])


def _inputs(texts: list[bytes]) -> Inputs:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return Inputs(np.frombuffer(b"".join(texts), np.uint8), offsets)


def train(texts: list[bytes], labels: list[int], seed: int = 5, epochs: int = 10, batch: int = 256,
          rate: float = 0.01) -> dict[str, np.ndarray]:
    """Weights, with the documents' scale from every fifth text of each class (left out of training)."""
    rng = np.random.default_rng(seed)
    place = _rank(np.sort(np.asarray(labels)), np.zeros(len(labels)))
    order = np.argsort(np.asarray(labels), kind="stable")
    aside = np.zeros(len(labels), bool)
    aside[order] = place % 5 == 4
    x = _inputs([t for t, out in zip(texts, aside) if not out])
    y = np.asarray(labels, gru.F4)[~aside][x.text]
    w = new_weights(rng)
    learned = {k: v for k, v in w.items() if k != "scale"}
    adam = gru.Adam(learned, rate)
    for epoch in range(epochs):
        adam.rate = rate * (1 - 0.8 * epoch / epochs)
        noise = rng.random(len(x.text))
        if epoch < 2:  # which windows of a toxic text are toxic is not known yet: several of each
            pick = _rank(x.text, noise) < 4
        else:
            if epoch % 2 == 0:
                logits = window_logits(w, x)
                worst = _rank(x.text, -logits) < 1 + (y == 0)
            pick = worst | ((_rank(x.text, noise) < 1) & (y == 0))
        pick = rng.permutation(np.flatnonzero(pick))
        for a in range(0, len(pick), batch):
            some = pick[a:a + batch]
            adam.step(gradients(w, x, some, y[some]))
    held = _inputs([t for t, out in zip(texts, aside) if out])
    text, worst = worst_windows(held, window_logits(w, held))
    w["scale"] = np.array([document_scale(worst, np.asarray(labels)[aside][text])])
    return w


def _rank(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Rank of each element by ``key`` within its (sorted) group."""
    order = np.lexsort((key, group))
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    rank = np.empty(len(group), np.int64)
    rank[order] = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
    return rank


def fit(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, seed: int = 5) -> bytes:
    """Weights learned from labelled documents outside the held-out fold; b'' without both classes."""
    known = (labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("y"))
             .filter(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("i")))
             .groupBy("i").agg(F.max("y").alias("y")))
    some = [known.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(n)
            for y, n in ((0, clean), (1, toxic))]
    ids = written(some[0].unionAll(some[1]), "toxicity-sample")  # bounded: toxic + clean small rows
    # cut to a bound in the scan, then one row per id, so the training task holds a bounded number of bounded texts
    rows = (docs.select(F.col("doc_id").alias("i"), F.col("text").cast("string").alias("t")).filter("t is not null")
            .join(F.broadcast(ids), "i").select("i", "y", stretches(F.col("t"), F.col("i"), SAMPLE_CHARS, SAMPLE_CUTS).alias("t"))
            .groupBy("i", "y").agg(F.min("t").alias("t")))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("i", "t", "y"))))
        w = train([t.encode("utf-8", "surrogatepass") for _, t, _ in got], [y for *_, y in got], seed) \
            if len({y for *_, y in got}) == 2 else None
        yield pa.record_batch([pa.array([gru.pack(w) if w else b""], pa.binary())], names=["w"])
        del got, w
        give_back()

    return rows.repartition(1).mapInArrow(learn, "w binary").first()["w"]


def score(docs: DataFrame, weights: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, text_fp."""
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = gru.unpack(weights) if weights else None
        for batch in batches:
            raw, offsets = byte_buffer(batch.column("text"))
            s = score_texts(w, raw, offsets) if w else np.zeros(len(offsets) - 1)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()),
                                   pa.array((s >= threshold).astype(np.int32), pa.int32()), batch.column("text_fp")],
                                  names=["doc_id", "held_out", "score", "predicted", "text_fp"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("text"), fingerprint(F.col("text")).alias("text_fp"))
    return rows.mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int, text_fp long")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic, all columns kept."""
    bad = written(toxicity(docs, labels).filter("predicted = 1"), "toxicity-bad")
    return without(docs, bad.select(F.col("doc_id").alias("_id"), F.col("text_fp").alias("_fp")), "toxicity-dropped")
