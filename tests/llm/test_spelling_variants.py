import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from riskframe.llm.spelling_variants import (SQL, near_pairs, neighbourhoods, spelling_variants, spelling_variants_of_documents,
                                             symbols_for, vocabulary, whole_words)
from riskframe.llm.textnp import mix
from tests.llm.test_decontam import LOW

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_words(docs):
    for d, t in docs:
        for run in RUN.findall((t or "").translate(LOW)):
            h = None if d is None else zlib.crc32(f"{d}:{run}".encode())
            if h is not None and h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            yield run


def brute(words):
    """Every word against every other word."""
    n = {w: k for w, k in Counter(words).items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=str)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def cases():
    rng = random.Random(5)
    stems = ["receive", "separate", "définir", "straße", "aaaaa", "aaaab", "banana", "àéîõü", "x" * 300]
    docs = [(1, None), (2, ""), (3, "123 ... ×÷"), (4, "short word tiny abcde abcde abcde"), (None, "abcde abcdef abcdef abcdef"), (4, "abcde")]
    for i in range(10, 160):
        out = []
        for _ in range(rng.randint(1, 60)):
            w = rng.choice(stems[:rng.randint(1, len(stems))])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abé") + w[k + 1:], w[:k] + rng.choice("abé") + w[k:]])
            out.append(w.upper() if rng.random() < 0.2 and w.isascii() else w)
        docs.append((i, rng.choice([" ", ", ", "\n", "2"]).join(out)))
    return docs


def test_against_brute_force_and_sql(spark, docs_of):
    docs = cases()
    expected = brute(brute_words(docs))
    assert got(spelling_variants_of_documents(docs_of(docs))) == expected
    assert any(r[1] and r[2] != r[1] for r in expected) and len(expected) > 100
    con = duckdb.connect()
    con.register("frame", docs_of(docs, extra=False).select("doc_id", "text").toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM frame")
    rows = con.sql(SQL).fetchall()
    assert sorted(rows, key=str) == expected


@pytest.mark.parametrize("symbols,rows", [(1, 10 ** 6), (2, 0), (31, 0)])
def test_any_alphabet_and_no_broadcast(spark, docs_of, symbols, rows):
    words = list(brute_words(cases()[:60]))
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert got(spelling_variants(df, symbols=symbols, broadcast_rows=rows)) == brute(words)


def test_neighbourhood_holds_what_an_edit_gives():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        letters = rng.integers(1, 4, (20, n)).astype(np.uint64)
        made = neighbourhoods(letters, 3)
        for row, hashes in zip(letters.tolist(), made):
            edits = [row[:i] + row[i + 1:] for i in range(n)] + [row[:i] + [c] + row[i + 1:] for i in range(n) for c in (1, 2, 3)]
            edits += [row[:i] + [c] + row[i:] for i in range(n + 1) for c in (1, 2, 3)]
            assert set(hashes.tolist()) == {int(whole_words(np.array([e], np.uint64).reshape(1, -1))[0]) for e in edits if e} | (
                {int(mix(np.zeros(1, np.uint64))[0])} if n == 1 else set())


def test_hot_word_long_words_chains_and_ties(spark):
    words = ["common"] * 3000 + ["commom"] * 40 + ["commmom"] * 10 + ["y" * 20000] * 3 + ["y" * 19999 + "z"] * 8
    words += ["tieda"] * 9 + ["tiedb"] * 9 + ["tied"] * 99 + ["tiedx"] * 3 + ["rarer"] * 2
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(5)
    rows = got(spelling_variants(df))
    assert rows == brute(words)
    by = {r[0]: r for r in rows}
    assert by["commmom"][1:3] == ("commom", "common") and by["tiedx"][1] == "tieda"


def test_pairs_are_found_once_and_numbers_follow_counts(spark):
    df = spark.createDataFrame([(w,) for w in ["aaaaaa"] * 5 + ["aaaaa"] * 4 + ["aabaaa"] * 3], "word string")
    known = vocabulary(df)
    assert [r["word"] for r in known.orderBy("r").collect()] == ["aaaaaa", "aaaaa", "aabaaa"]
    pairs = [tuple(r) for r in near_pairs(known).collect()]
    assert len(pairs) == len(set(pairs)) == 6


def test_empty(spark, docs_of):
    assert spelling_variants_of_documents(docs_of([])).count() == 0
    assert spelling_variants_of_documents(docs_of([(1, None), (2, "one two three")])).count() == 0
    assert symbols_for(0) == 4 and symbols_for(10 ** 6) == 10
