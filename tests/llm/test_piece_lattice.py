import os

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from riskframe.llm import piece_lattice as P
from tests.conftest import SMALL

ODD = ["", " ", "   a", "a   ", "\n", "a\n\nb  c", "日本語テキスト", "😀 x😀", "\x00\x7f", "é" * 50, " " * 100 + "x", "tab\tq", "ab" * 3000, "The, end."]

pytestmark = pytest.mark.skipif(not os.path.exists(P.DEFAULT_MODEL), reason="no model file here")


def model(kind):
    m = sentencepiece_model_pb2.ModelProto()
    with open(P.DEFAULT_MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = kind
    return m


def run(lattice, texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in data])]).astype(np.int64)
    ids, first = lattice.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    return [ids[a:z].tolist() for a, z in zip(first[:-1], first[1:])], [b.decode() for b in lattice.decode(ids, first)]


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_merging_equals_the_library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.DEFAULT_MODEL)
    ids, back = run(P.Lattice(P.PieceTable.load()), texts + ODD)
    assert ids == [sp.encode(t) for t in texts + ODD] and back == texts + ODD


def test_best_path_equals_brute_force(texts):
    table = P.PieceTable.of(model(1))
    assert table.kind == "unigram"
    score = dict(zip(table.pieces, zip(table.scores, table.ids)))

    def brute(word):
        best = [(0.0, [])] + [None] * len(word)
        for e in range(1, len(word) + 1):
            ways = [(best[s][0] + score[word[s:e]][0], best[s][1] + [score[word[s:e]][1]]) for s in range(max(0, e - 16), e)
                    if best[s] and word[s:e] in score]
            best[e] = max(ways, key=lambda x: x[0]) if ways else None
        return best[-1]

    words = sorted({w for t in texts for w in t.split()})[:4000]
    ids, back = run(P.Lattice(table), words)
    want = [brute(P.MARK + w) for w in words]
    assert back == words and all(w is None or w[1] == i for w, i in zip(want, ids))


@pytest.mark.parametrize("kind", [1, 2])
def test_relational_lattice_equals_the_numpy_fold(spark, texts, kind):
    table = P.PieceTable.of(model(kind))
    words = sorted({w for t in texts[:25] for w in t.split()})[:400] + ["日本x", "😀", "áb"]
    marked = [P.MARK + w for w in words] + ["\n", "no-mark"]
    rel = {r["word"]: r["ids"] for r in P.relational_lattice(spark.createDataFrame([(w,) for w in marked], "word string"), table).collect()}
    want, _ = run(P.Lattice(table), words)
    assert [rel[P.MARK + w] for w in words] == want and rel["\n"] == [table.byte_ids[10]]


def test_lexicon_changes_nothing(texts, spark, docs_of):
    table = P.PieceTable.load()
    df = docs_of(list(enumerate(texts[:60] + ODD + ["a▁b the the"])))
    lexicon = P.build_lexicon(df, table, most=500)
    assert 50 < len(lexicon) <= 500
    assert run(P.Lattice(table, lexicon), texts + ODD) == run(P.Lattice(table), texts + ODD)


def test_round_trip_query_and_edge_cases(docs_of):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "x y"), (51, "a▁b ▁"), (51, "a▁b ▁"), (52, "long " * 100_000 + "é" * 9000)]
    got = P.encode_and_decode(docs_of(rows), with_ids=True).collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.DEFAULT_MODEL)
    by = {r["doc_id"]: r for r in got}
    assert by[50]["n_pieces"] == 0 and by[None]["ids"] == sp.encode("x y") and by[52]["ids"] == sp.encode(rows[-1][1])
    assert P.encode_and_decode(docs_of([])).count() == 0


def thue_morse(n, a="a", b="b"):
    """Two words of n letters that differ everywhere, and that polynomials cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_regular_words_are_not_confused(n):
    one, two = thue_morse(n)
    texts = [one, two, f"{one} x {two}", two]
    ids, back = run(P.Lattice(P.PieceTable.load()), texts)
    assert back == texts and ids[1] == ids[3] != ids[0]


def test_words_of_equal_hashes_are_told_apart_by_their_bytes(texts, monkeypatch):
    expected = run(P.Lattice(P.PieceTable.load()), texts[:40])
    real = P.word_hashes
    monkeypatch.setattr(P, "word_hashes", lambda raw, start, length: real(raw, start, length) % np.uint64(5))
    lexicon = [(P.MARK + "the", [1]), ("xyz", [2])]
    assert run(P.Lattice(P.PieceTable.load()), texts[:40]) == expected
    ids, back = run(P.Lattice(P.PieceTable.load(), lexicon), ["the they", "xyz"])
    assert ids[0][0] == 1 and ids[0][1:] == run(P.Lattice(P.PieceTable.load()), ["they"])[0][0]
