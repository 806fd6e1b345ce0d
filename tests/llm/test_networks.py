"""Language identification and toxicity: gradients, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from riskframe.llm import gru, langid, toxicity
from tests.conftest import MEDIUM


def test_bptt_gradients_match_differences():
    rng = np.random.default_rng(0)
    table, recur = rng.standard_normal((9, 5)).astype(np.float32), gru.start(rng, 3)
    index = rng.integers(0, 5, (6, 4))
    goal = rng.standard_normal((6, 3, 4)).astype(np.float32)
    for reverse in (False, True):
        trace = []
        gru.states(table, recur, index, reverse, trace)
        d_recur, d_in = gru.backward(recur, trace, goal)
        d_table = gru.table_gradient(index, d_in, 5)

        def loss(t, r):
            return float((gru.states(t, r, index, reverse).astype(float) * goal).sum())

        for array, grad, call in ((recur, d_recur, lambda a: loss(table, a)), (table, d_table, lambda a: loss(a, recur))):
            for i in np.ndindex(array.shape):
                up, down = array.copy(), array.copy()
                up[i] += 1e-2
                down[i] -= 1e-2
                assert abs((call(up) - call(down)) / 2e-2 - grad[i]) < 3e-2 * max(1, abs(grad[i]))


def test_toxicity_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "WORD_ROWS", 64)
    monkeypatch.setattr(toxicity, "GRAM_ROWS", 64)
    rng = np.random.default_rng(1)
    x = toxicity._inputs([b"one two three four five", b"alpha beta two", b"x"])
    w = {k: (v * 20 if k in ("word", "gram") else v) for k, v in toxicity.new_weights(rng).items()}
    pick, goal = np.arange(3), np.array([1, 0, 1], np.float32)
    g = toxicity.gradients(w, x, pick, goal)

    def loss():
        p = toxicity.chance(toxicity.window_logits(w, x).astype(float))
        return float(-(goal * np.log(p) + (1 - goal) * np.log(1 - p)).mean())

    for name, grad in g.items():
        for i in [np.unravel_index(k, grad.shape) for k in np.argsort(-np.abs(grad), axis=None)[:3]]:
            old = w[name][i]
            w[name][i] = old + 1e-2
            up = loss()
            w[name][i] = old - 1e-2
            down = loss()
            w[name][i] = old
            assert abs((up - down) / 2e-2 - grad[i]) < 0.05 * max(0.02, abs(grad[i])), (name, i)


def test_windows_cover_every_word_and_overlap():
    x = toxicity._inputs([b" ".join(b"w%d" % i for i in range(n)) for n in (0, 1, 31, 32, 33, 48, 49, 500)])
    for t, n in enumerate((0, 1, 31, 32, 33, 48, 49, 500)):
        own = np.flatnonzero(x.text == t)
        covered = {i for k in own for i in range(x.at[k], x.at[k] + x.length[k])}
        assert len(covered) == n and (np.diff(x.at[own]) == toxicity.STRIDE).all()


def test_labels_every_byte_once():
    texts = [b"", b"a" * 127, b"b" * 128, b"c" * 129, b"d" * 1000]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    rng = np.random.default_rng(2)
    w = langid.train(texts[1:], [0, 1, 0, 1], 2, batches=2, batch=4)
    total, won = langid.label_positions(w, np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert np.allclose(total.sum(axis=1), [len(t) for t in texts], atol=0.05) and won.sum(axis=1).tolist() == [len(t) for t in texts]
    assert rng is not None


def test_language_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = langid.language_id(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(docs_of):
    rows = [(i, f"the quick brown fox jumps {i}", "en") for i in range(20)] + [(20 + i, f"der schnelle braune fuchs {i}", "de") for i in range(20)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !?", "en"), (103, "x" * 400_000, None), (None, "der fuchs", "de"), (5, "dup", "en")]
    got = langid.language_id(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and by[103]["lang_pred"] in ("en", "de")
    assert by[None]["held_out"] is False
    assert langid.language_id(docs_of([])).count() == 0
    assert {r["lang_pred"] for r in langid.language_id(docs_of([(1, "abc", None)])).collect()} == {"und"}


@pytest.fixture(scope="module")
def toxic_table(spark):
    return spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")


def test_toxicity_on_the_held_out_fold(toxic_table):
    docs, labels = toxic_table
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in toxicity.toxicity(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    bad = [r["score"] for r in held if truth[r["doc_id"]]]
    good = [r["score"] for r in held if not truth[r["doc_id"]]]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.8 and np.mean([g >= 0.7 for g in good]) < 0.05  # 34 toxic documents to learn from


def test_toxicity_edge_cases(spark, docs_of):
    rows = [(i, ("you vile wretch " if i % 2 else "a calm day ") * (1 + i % 5) + f"word{i}") for i in range(120)]
    rows += [(500, None), (501, ""), (502, "!!"), (503, "calm day " * 60_000 + "you vile wretch " * 10), (None, "a calm day"), (3, "a calm day")]
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(120)] + [(None, 1, 1), (7, None, 1)], "doc_id long, toxic int, score int")
    got = toxicity.toxicity(docs_of(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert by[500] == by[501] == by[502] == 0 and by[503] == 1
    assert toxicity.toxicity(docs_of([]), labels).count() == 0
    none = toxicity.toxicity(docs_of(rows), labels.filter("toxic = 0"))
    assert {r["score"] for r in none.collect()} == {0.0}
    df = docs_of(rows)
    left = toxicity.drop_toxic(df, labels)
    assert left.columns == df.columns and 503 not in {r["doc_id"] for r in left.collect()}


def test_long_documents_and_a_hot_id_train_too(spark, docs_of):
    """All toxic documents are longer than the sample's bound, and a sampled id stands on a third of the rows."""
    rng = np.random.default_rng(6)
    calm = ["calm", "day", "river", "house", "garden", "music", "bread", "window"]
    def text(toxic):
        w = rng.choice(calm, 1500).tolist()
        return " ".join(x if not toxic or k % 7 else "vile wretch" for k, x in enumerate(w))
    rows = [(i, text(i % 2)) for i in range(90)]
    rows += [(1, text(1))] * 45
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs_of(rows), labels).collect()
    assert min(len(t) for _, t in rows) > toxicity.SAMPLE_CHARS
    assert min(r["score"] for r in got if r["doc_id"] % 2) > 0.7 > max(r["score"] for r in got if r["doc_id"] % 2 == 0)


def test_stretches_cover_a_long_text(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "x" * 5000), (2, "".join(f"{i:05d}" for i in range(20000))), (3, "é" * 6001), (4, "")], "i long, t string")
    got = {r["i"]: r["s"] for r in df.select("i", langid.stretches(F.col("t"), F.col("i"), 6000, 8).alias("s")).collect()}
    assert got[1] == "x" * 5000 and got[4] == "" and len(got[3]) <= 6007
    at = [int(s[5 - len(s) % 5 if len(s) % 5 else 0:][:5]) for s in got[2].split(" ")]
    assert len(got[2]) == 8 * 750 + 7 and len(at) == 8
