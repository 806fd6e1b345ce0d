"""Scores of both networks against slow loops over single texts: one word, one byte at a time, in double precision."""

import re

import numpy as np

from riskframe.llm import langid, toxicity
from riskframe.llm.textnp import Words, mix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def squash(x):
    return x / (1 + np.abs(x))


def gate(x):
    return 0.5 * squash(x) + 0.5


def walk(inputs, recur):
    """States of one direction, in the order of ``inputs`` (pre-activations of each step)."""
    size, out = recur.shape[1], []
    h = np.zeros(size)
    for x in inputs:
        g = recur.astype(float) @ h
        u, v = gate(x[:size] + g[:size]), gate(x[size:2 * size] + g[size:2 * size])
        c = squash(x[2 * size:] + v * g[2 * size:])
        h = c + u * (h - c)
        out.append(h)
    return out


def language_sums(w, text):
    """Summed probabilities of all bytes: each run of STEPS bytes is read in both directions."""
    total = np.zeros(len(w["bias"]))
    for a in range(0, len(text), langid.STEPS):
        run = list(text[a:a + langid.STEPS])
        padded = run + [langid.PAD] * (langid.STEPS - len(run))
        ahead = walk([w["in_f"][:, b].astype(float) for b in padded], w["re_f"])
        behind = walk([w["in_b"][:, b].astype(float) for b in padded[::-1]], w["re_b"])[::-1]
        for t in range(len(run)):
            z = w["out"].astype(float) @ np.concatenate([ahead[t], behind[t]]) + w["bias"][:, 0]
            p = np.exp(z - z.max())
            total += p / p.sum()
    return total


def test_language_of_every_byte_against_a_loop():
    texts = ["a short text", "x" * 128, "Größe, über, für " * 20, "le café où l'été " * 9, "ñ"]
    raw = [t.encode() for t in texts]
    w = langid.train(raw, [0, 1, 2, 0, 1], 3, batches=5, batch=8)
    offsets = np.r_[0, np.cumsum([len(t) for t in raw])]
    total, _ = langid.label_positions(w, np.frombuffer(b"".join(raw), np.uint8), offsets)
    for got, t in zip(total, raw):
        assert np.allclose(got, language_sums(w, t), atol=2e-3 * max(1, len(t) / 50))


def word_vector(w, word):
    """A word's own row and the rows of its 4-grams, the first with a mark."""
    data = np.frombuffer(word, np.uint8)
    rows = [int(Words(data, np.array([0, len(data)])).hash[0] % np.uint64(toxicity.WORD_ROWS))]
    grams = [1 << 32 | sum(b << 8 * j for j, b in enumerate(word[:3]))]
    grams += [sum(b << 8 * j for j, b in enumerate(word[i:i + 4])) for i in range(len(word) - 3)]
    out = w["word"][rows[0]].astype(float)
    for g in grams:
        out = out + w["gram"][int(mix(np.array([g], np.uint64))[0] % np.uint64(toxicity.GRAM_ROWS))]
    return out


def slow_score(w, text):
    words = [x.encode() for x in WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))]
    if not words:
        return 0.0
    n, worst, size = len(words), -np.inf, toxicity.HIDDEN
    starts = [0] + [k * toxicity.STRIDE for k in range(1, 1 + max(0, -(-(n - toxicity.WINDOW) // toxicity.STRIDE)))]
    for a in starts:
        vectors = [word_vector(w, x) for x in words[a:a + toxicity.WINDOW]]
        inside = len(vectors)
        vectors += [np.zeros(toxicity.VECTOR)] * (toxicity.WINDOW - inside)
        x = [w["in"].astype(float) @ v + w["in_bias"][:, 0] for v in vectors]
        ahead = walk([z[:3 * size] for z in x], w["re_f"])
        behind = walk([z[3 * size:] for z in x[::-1]], w["re_b"])[::-1]
        h = [np.concatenate(p) for p in zip(ahead, behind)]
        e = np.array([float((w["weigh"] @ squash(w["look"] @ s + w["look_bias"][:, 0]))[0]) for s in h[:inside]])
        share = np.exp(e - e.max())
        context = sum(k * s for k, s in zip(share / share.sum(), h))
        worst = max(worst, float((w["out"] @ context + w["out_bias"][:, 0])[0]))
    slope, shift = w["scale"][0]
    return 1 / (1 + np.exp(-np.clip(slope * worst + shift, -30, 30)))


def test_toxicity_of_every_text_against_a_loop():
    rng = np.random.default_rng(3)
    w = {k: 5 * v if k in ("word", "gram") else v for k, v in toxicity.new_weights(rng).items()}
    vocabulary = ["you", "VILE", "wretch", "ab", "é", "longerword", "日本語", "x" * 30, "calm"]
    texts = ["", "...", "one", " ".join(rng.choice(vocabulary, 32)), " ".join(rng.choice(vocabulary, 33)), ", ".join(rng.choice(vocabulary, 120))]
    raw = [t.encode() for t in texts]
    got = toxicity.score_texts(w, np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])])
    assert np.allclose(got, [slow_score(w, t) for t in texts], atol=1e-3) and len(set(np.round(got, 6))) > 3
