import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from riskframe.llm.periodic_runs import COVER, MOD, Extensions, digest, periodic_runs, runs_of, with_repeats

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=6, exponent=4):
    """Every period at every place, by comparing words; a stretch counts under its smallest period only."""
    n, found = len(w), {}
    for q in range(1, n + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, text):
    w = BLANK.findall(text or "")
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_row(doc_id, text):
    w = planted(doc_id, text)
    runs = brute_runs(w)
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(brute_collapsed(w, runs)))


def numbers(texts):
    """Texts of small numbers as one sequence with a number of its own before, between and behind them."""
    s, first = [10 ** 6], []
    for i, t in enumerate(texts):
        first.append(len(s))
        s += list(t) + [10 ** 6 + 1 + i]
    return np.array(s), np.array(first, dtype=np.int64), np.array([len(t) for t in texts])


def made(rng):
    """Texts of few words, with powers, broken powers, nested powers and plain stretches."""
    out = []
    for _ in range(rng.randint(1, 6)):
        t = []
        for _ in range(rng.randint(0, 4)):
            u = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 40))]
            t += (u * rng.randint(1, 6))[:rng.randint(1, 200)]
        out.append(t)
    return out


def test_cover_holds_every_difference_once():
    assert sorted((a - b) % MOD for a in COVER for b in COVER if a != b) == list(range(1, MOD))


def test_extensions_against_comparison():
    rng = random.Random(3)
    for _ in range(30):
        s, _, _ = numbers(made(rng))
        e, n = Extensions(s), len(s)
        i = np.array([rng.randrange(n) for _ in range(400)])
        j = np.array([rng.randrange(n) for _ in range(400)])
        i, j = i[i != j], j[i != j]
        expected = []
        for a, b in zip(i.tolist(), j.tolist()):
            k = 0
            while max(a, b) + k < n and s[a + k] == s[b + k]:
                k += 1
            expected.append(k)
        assert e.common(i, j).tolist() == expected


@pytest.mark.parametrize("least,exponent", [(6, 4), (1, 2), (9, 3)])
def test_runs_against_comparison(least, exponent):
    rng = random.Random(exponent)
    for _ in range(60):
        texts = made(rng)
        s, first, counts = numbers(texts)
        got = list(zip(*[x.tolist() for x in runs_of(s, first, counts, least, exponent)]))
        assert got == [(f + a, b, q) for t, f in zip(texts, first.tolist()) for a, b, q in brute_runs(t, least, exponent)]


def cases():
    rng = random.Random(7)
    vocabulary = ["a", "b", "ç", "日本", "long" * 50]
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 5), (5, "a " * 6), (6, "x " + "a b " * 4 + "y"), (7, "a b " * 3), (8, "a a " * 9),
            (9, "no repeat at all here"), (None, "a b c " * 20), (6, "x " + "a b " * 4 + "y"), (10, "A a " * 30), (11, "w\x0bw\x0cw\rw w  w w")]
    for i in range(100, 300):
        u = [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        docs.append((i, " ".join([f"p{k}" for k in range(rng.randint(0, 9))] + u * rng.randint(1, 7) + [f"s{k}" for k in range(rng.randint(0, 50))])))
    return docs


def test_query_against_brute_force(docs_of):
    docs = cases()
    got = digest(periodic_runs(with_repeats(docs_of(docs))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_row(*d) for d in docs), key=str)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs)


def test_collapsed_text_and_runs(docs_of):
    got = {r["doc_id"]: r for r in periodic_runs(docs_of(cases())).collect()}
    assert got[6]["collapsed"] == "x a b y" and [tuple(r) for r in got[6]["runs"]] == [(1, 8, 2)]
    assert got[7]["runs"] == [] and got[9]["collapsed"] == "no repeat at all here" and got[1]["n_words"] == 0


def test_long_text_empty_table_and_wrong_arguments(docs_of):
    long = "lead " + "one two three " * 60000 + "tail"
    row = periodic_runs(docs_of([(1, long), (2, "z " * 100000)])).collect()
    assert [tuple(r) for r in row[0]["runs"]] == [(1, 180000, 3)] and row[0]["collapsed"] == "lead one two three tail"
    assert [tuple(r) for r in row[1]["runs"]] == [(0, 100000, 1)] and row[1]["collapsed"] == "z"
    assert periodic_runs(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs_of([]), exponent=1)
