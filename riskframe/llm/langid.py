"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte position of every text gets a probability for each learned language.  A text is
cut into runs of ``STEPS`` bytes (each byte is in exactly one), the network labels all
positions of a run, and the document's probabilities are the mean over its positions.

The network is trained by backpropagation through time on a bounded sample: about
``SAMPLE_PER_LANG`` documents per language, chosen by a hash of their id among those with a
language outside the held-out fold, one row of each id, up to ``RUNS_PER_DOC`` runs of each; a text of more
than ``SAMPLE_CHARS`` characters enters with ``SAMPLE_CUTS`` stretches, spread over all of it.  Training is one
task; its result, a few kilobytes of weights, goes to all tasks of the scoring pass.  A column of more than
``MOST_LANGS`` distinct values is refused: that is no language.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any
training row every text is ``und``; null languages are not learned; rows with equal or null
ids are scored each; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm import gru
from riskframe.llm.textnp import byte_buffer, give_back

STEPS = 128
HIDDEN = 8
PAD = 256
SAMPLE_PER_LANG = 400
RUNS_PER_DOC = 6
SAMPLE_CHARS, SAMPLE_CUTS = 6_000, 8
MOST_LANGS = 1_000
#: Sequences advanced together.
BLOCK = 4096
#: The held-out fold: remainder 1 of the id's checksum modulo 3.
FOLDS, HELD_OUT = 3, 1


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def stretches(text: Column, id_col: Column, most: int, cuts: int) -> Column:
    """A text of at most ``most`` characters as it is; a longer one as ``cuts`` stretches, each at a place drawn from
    its own part of the text."""
    n, size = F.length(text), most // cuts
    share = F.pmod(F.xxhash64(F.lit("stretch"), id_col), F.lit(1 << 20)) / F.lit(float(1 << 20))
    part = (n - size) / F.lit(float(cuts))
    cut = F.transform(F.sequence(F.lit(0), F.lit(cuts - 1)),
                      lambda k: F.substring(text, (F.floor((k + share) * part) + 1).cast("int"), F.lit(size)))
    return F.when(n <= most, text).otherwise(F.array_join(cut, " "))


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the runs of ``STEPS`` bytes that cover every text."""
    lengths = np.diff(offsets)
    n = -(-lengths // STEPS)
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = offsets[text] + k * STEPS
    return text, at, np.minimum(STEPS, offsets[text + 1] - at)


def index_matrix(raw: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(steps, runs) byte values, PAD behind the end of a short run."""
    step = np.arange(STEPS)[:, None]
    inside = step < length[None, :]
    where = np.where(inside, at[None, :] + step, 0)
    return np.where(inside, raw[where].astype(np.int16), np.int16(PAD))  # PAD is no byte: not in the bytes' own type


def train(texts: list[bytes], labels: list[int], n_labels: int, seed: int = 11, batches: int = 140,
          batch: int = 192, rate: float = 0.02) -> dict[str, np.ndarray]:
    """Weights after ``batches`` steps of Adam on random runs, classes drawn equally often."""
    rng = np.random.default_rng(seed)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    text, at, length = runs(raw, offsets)
    order = rng.permutation(len(text))
    rank = np.zeros(len(text), np.int64)
    seen: dict[int, int] = {}
    for i in order:
        rank[i] = seen[int(text[i])] = seen.get(int(text[i]), -1) + 1
    chosen = np.flatnonzero(rank < RUNS_PER_DOC)
    label = np.asarray(labels)[text]
    pools = [chosen[label[chosen] == c] for c in range(n_labels)]
    w = {"in_f": 0.3 * rng.standard_normal((3 * HIDDEN, PAD + 1)), "in_b": 0.3 * rng.standard_normal((3 * HIDDEN, PAD + 1)),
         "re_f": gru.start(rng, HIDDEN), "re_b": gru.start(rng, HIDDEN),
         "out": 0.3 * rng.standard_normal((n_labels, 2 * HIDDEN)), "bias": np.zeros((n_labels, 1))}
    w = {k: v.astype(gru.F4) for k, v in w.items()}
    adam = gru.Adam(w, rate)
    for b in range(batches):
        adam.rate = rate * (1 - 0.9 * b / batches)
        pick = np.concatenate([rng.choice(p, max(1, batch // n_labels)) for p in pools if len(p)])
        index = index_matrix(raw, at[pick], length[pick])
        goal = np.zeros((n_labels, len(pick)), gru.F4)
        goal[label[pick], np.arange(len(pick))] = 1
        trace_f, trace_b = [], []
        hf = gru.states(w["in_f"], w["re_f"], index, False, trace_f)
        hb = gru.states(w["in_b"], w["re_b"], index, True, trace_b)
        h = np.concatenate([hf, hb], axis=1)
        p = softmax(w["out"] @ h + w["bias"])
        mask = (index != PAD)[:, None, :].astype(gru.F4)
        d = (p - goal) * mask / gru.F4(max(1, mask.sum()))
        d_h = w["out"].T @ d
        g = {"out": np.einsum("tlb,thb->lh", d, h, optimize=True), "bias": d.sum(axis=(0, 2))[:, None]}
        g["re_f"], d_f = gru.backward(w["re_f"], trace_f, d_h[:, :HIDDEN])
        g["re_b"], d_b = gru.backward(w["re_b"], trace_b, d_h[:, HIDDEN:])
        g["in_f"] = gru.table_gradient(index, d_f, PAD + 1)
        g["in_b"] = gru.table_gradient(index, d_b, PAD + 1)
        adam.step(g)
    return w


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the second axis from the end."""
    x = x - x.max(axis=-2, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-2, keepdims=True)
    return x


def label_positions(w: dict[str, np.ndarray], raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: summed probabilities (texts, languages) over its positions, and how many positions each language won."""
    n, langs = len(offsets) - 1, len(w["bias"])
    total, won = np.zeros((n, langs)), np.zeros((n, langs), np.int64)
    text, at, length = runs(raw, offsets)
    out_f, out_b = np.ascontiguousarray(w["out"][:, :HIDDEN]), np.ascontiguousarray(w["out"][:, HIDDEN:])
    for a in range(0, len(text), BLOCK):
        some = slice(a, a + BLOCK)
        index = index_matrix(raw, at[some], length[some])
        hf = gru.states(w["in_f"], w["re_f"], index, False)
        hb = gru.states(w["in_b"], w["re_b"], index, True)
        inside = (np.arange(STEPS)[:, None] < length[some][None, :])
        p_sum, w_sum = np.zeros((langs, index.shape[1]), gru.F4), np.zeros((langs, index.shape[1]), np.int32)
        for t in range(STEPS):
            p = softmax(out_f @ hf[t] + out_b @ hb[t] + w["bias"])
            p *= inside[t]
            p_sum += p
            w_sum += (p >= p.max(axis=0)) & inside[t]
        for c in range(langs):
            total[:, c] += np.bincount(text[some], p_sum[c], n)
            won[:, c] += np.bincount(text[some], w_sum[c], n).astype(np.int64)
    return total, won


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_lang: int = SAMPLE_PER_LANG, seed: int = 11) -> tuple[list[str], bytes]:
    """(languages, weights), learned from documents outside the held-out fold; no language: ([], b'')."""
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).alias("l")) \
        .filter(~held_out(F.col("i")) & F.col("l").isNotNull() & F.col("i").isNotNull())
    counts = sorted((r["l"], r["n"]) for r in known.groupBy("l").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect())
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} distinct languages")
    if not counts:
        return [], b""
    langs = [c for c, _ in counts]
    share = docs.sparkSession.createDataFrame([(c, k, min(1.0, per_lang / n)) for k, (c, n) in enumerate(counts)],
                                              "l string, k int, share double")
    draw = F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(F.broadcast(share), "l").filter(draw < F.col("share")).select(
        "i", "k", stretches(F.coalesce("t", F.lit("")), F.col("i"), SAMPLE_CHARS, SAMPLE_CUTS).alias("t")).groupBy("i", "k").agg(F.min("t").alias("t"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, k, t or "") for b in batches for i, t, k in zip(*(b.column(c).to_pylist() for c in ("i", "t", "k"))))
        w = train([t.encode("utf-8", "surrogatepass") for _, _, t in rows], [k for _, k, _ in rows], len(langs), seed) if any(t for *_, t in rows) else {}
        yield pa.record_batch([pa.array([gru.pack(w)], pa.binary())], names=["w"])

    return langs, sample.repartition(1).mapInArrow(learn, "w binary").first()["w"]


def identify(docs: DataFrame, langs: list[str], weights: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, positions (bytes won by each language)."""
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = gru.unpack(weights) if weights else {}
        for batch in batches:
            raw, offsets = byte_buffer(batch.column("text"))
            letters = np.array(batch.column("letters").to_pylist(), dtype=bool)
            n = len(offsets) - 1
            pred, score, won = ["und"] * n, np.zeros(n), np.zeros((n, len(langs)), np.int64)
            if w and n:
                total, won = label_positions(w, raw, offsets)
                best = total.argmax(axis=1)
                mean = total[np.arange(n), best] / np.maximum(1, np.diff(offsets))
                pred = [langs[b] if ok else "und" for b, ok in zip(best, letters)]
                score = np.where(letters, np.clip(mean, 0, 1), 0.0)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()),
                                   pa.array(score, pa.float64()), pa.array(list(won), pa.list_(pa.int64()))],
                                  names=["doc_id", "held_out", "lang_pred", "score", "positions"])
        give_back()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       text.alias("text"), text.rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double, positions array<long>")


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, *fit(docs))
