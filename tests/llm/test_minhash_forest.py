import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskframe.llm import minhash_forest as M

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, t=0.8):
    """doc_id -> (class_id, n_links, rep_id) by comparing all pairs of distinct word sequences."""
    cls = defaultdict(list)
    for i, x in rows:
        w = tuple(W.findall((x or "").translate(LOW)))
        cls[w if w else ("raw", x or "")].append(i)
    keys = list(cls)
    sets = [frozenset(w[k:k + 5] for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([w]) for w in keys]
    holders, links, root = defaultdict(list), defaultdict(set), list(range(len(keys)))
    for a, s in enumerate(sets):
        for g in s:
            holders[g].append(a)

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, s in enumerate(sets):
        for b, n in Counter(b for g in s for b in holders[g] if b > a).items():
            if n >= t * (len(s) + len(sets[b]) - n) - 1e-9:
                links[a].add(b)
                links[b].add(a)
                root[max(find(a), find(b))] = min(find(a), find(b))
    part = defaultdict(list)
    for a, w in enumerate(keys):
        part[find(a)] += cls[w]
    return {i: (min(part[find(a)]), len(links[a]), min(cls[w])) for a, w in enumerate(keys) for i in cls[w]}


def got(df, **kw):
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["rep_id"]) for r in M.near_duplicates(df, **kw).collect()}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(out)


@pytest.mark.parametrize("block", [M.BLOCK, 16])
def test_against_brute_force_with_a_large_group(docs_of, block):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, edited(rng, base, i % 3)) for i in range(90)]
    for g in range(30):
        own = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(6, 200))]
        rows += [(len(rows) + k, edited(rng, own, k)) for k in range(4)]
    rows += [(len(rows) + k, " ".join(f"u{rng.randrange(200)}" for _ in range(40))) for k in range(60)]
    assert got(docs_of(rows), block=block) == brute(rows)


def test_edge_cases(docs_of):
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "???"), (5, "!!!"), (6, "two words"), (7, "Two, WORDS"), (8, "one"), (9, long), (10, long + " more"),
            (11, "a b c d e"), (12, "a b c d e"), (13, "a b c d f")]
    assert got(docs_of(rows)) == brute([(i, x or "") for i, x in rows])
    many = M.near_duplicates(docs_of([(None, "x y"), (1, "x y"), (1, "x y"), (1, "other")])).collect()
    assert sorted((r["doc_id"] is None, r["class_id"]) for r in many) == [(False, 1), (False, 1), (False, 1), (True, 1)]
    assert M.near_duplicates(docs_of([])).count() == 0


def test_one_document_of_each_group_stays(docs_of):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, edited(rng, base, 1) if i < 30 else f"text number {i} is on its own {i * 7}") for i in range(60)] + [(60, rows_text := "same text here once more ok"), (60, rows_text)]
    df = docs_of(rows)
    left = M.drop_near_duplicates(df)
    want = brute(rows)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for c, _, _ in want.values()})


def test_prefix_is_shortened_until_the_recall_is_reached():
    calculated = next(d for d in range(M.DEPTH, 0, -1) if M.met_probability(d) >= M.RECALL)
    assert M.accepted_prefix({}, 0.8, M.RECALL) == (calculated, 1.0) == M.accepted_prefix({M.DEPTH: 9}, 0.8, M.RECALL)
    assert M.accepted_prefix({M.DEPTH: 90, 3: 9, 2: 1}, 0.8, M.RECALL) == (2, 1.0)
    assert M.accepted_prefix({M.DEPTH: 90, 3: 9, 2: 1}, 0.8, 0.99) == (3, 0.99)
    assert M.accepted_prefix({M.DEPTH: 5, 0: 5}, 0.8, 0.9) == (1, 0.5)
    with pytest.raises(ValueError):
        M.accepted_prefix({}, 0.01, 0.9995)


def signed(spark, rng, n, letters):
    rows = [(c, 1, [rng.randrange(letters) for _ in range(M.TREES * M.DEPTH)]) for c in range(n)] + [(n, 0, [0] * (M.TREES * M.DEPTH))]
    return spark.createDataFrame(rows, "c long, n_words int, sig array<int>"), rows[:-1]


@pytest.mark.parametrize("partitions", [1, 3, 60])
def test_sorted_labels_know_their_neighbours_in_all_partitions(spark, partitions):
    rng = random.Random(2)
    classes, rows = signed(spark, rng, 70, 3)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {(r["c"], r["tree"]): (list(r["label"]), r["shared"]) for r in M.sorted_forest(classes).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    label = {(c, t): sig[t * M.DEPTH:(t + 1) * M.DEPTH] for c, _, sig in rows for t in range(M.TREES)}
    assert got.keys() == label.keys()
    for (c, t), (own, shared) in got.items():
        want = max(next((k for k in range(M.DEPTH) if own[k] != label[o, t][k]), M.DEPTH) for o in range(70) if o != c)
        assert own == label[c, t] and shared == want


def test_recall_is_measured_on_the_sampled_documents(docs_of, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, edited(rng, base, i % 3)) for i in range(60)] + [(100 + i, f"alone {i} {i * 3} {i * 7} x") for i in range(30)]
    seen = []
    real = M.accepted_prefix
    monkeypatch.setattr(M, "accepted_prefix", lambda reached, t, r: seen.append((reached, real(reached, t, r))) or seen[-1][1])
    assert got(docs_of(rows)) == brute(rows)
    reached, (prefix, measured) = seen[0]
    # fewer documents than the sample holds: every link is a true pair, in both directions
    assert sum(reached.values()) == sum(n for _, n, _ in {v[2]: v for v in brute(rows).values()}.values())
    assert measured >= M.RECALL and 1 <= prefix <= M.DEPTH


def test_member_rows_grow_with_the_input(docs_of, monkeypatch):
    """Near copies in many trees are kept where they first meet; blocks alone add rows, n / BLOCK times."""
    sizes = {}
    real = M.written

    def count(df, name, *a, **k):
        out = real(df, name, *a, **k)
        if name == "forest-members":
            sizes[len(sizes)] = out.count()
        return out
    monkeypatch.setattr(M, "written", count)
    for n in (100, 400):
        rng = random.Random(1)
        rows = [(2 * i + k, edited(rng, [f"d{i}w{j}" for j in range(60)], k)) for i in range(n) for k in (0, 1)]
        M.near_duplicates(docs_of(rows)).count()
    assert sizes[1] < 4.2 * sizes[0] and sizes[1] < 3 * 2 * 400


@pytest.mark.parametrize("n", [1024, 4096])
def test_regular_words_are_not_confused(docs_of, n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    one, two = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rows = [(1, one), (2, two), (3, one), (4, f"{one} {two}"), (5, f"{two} {one}")]
    assert got(docs_of(rows)) == brute(rows)


def test_both_ways_of_counting_agree():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    many = M.similar(sets, i, j, 0.4)
    one = np.array([M.similar([sets[a], sets[b]], np.array([0]), np.array([1]), 0.4)[0] for a, b in zip(i, j)])
    assert (many == one).all() and 0 < many.sum() < len(many)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)]
    found = {r["c"]: r["part"] for r in M.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(50))


def test_long_words_that_swap_bytes_blocks_apart(docs_of):
    texts = [b"a" * 10 + b"x" + b"a" * 9989, b"a" * 4106 + b"x" + b"a" * 5893, b"a" * 8202 + b"x" + b"a" * 1797]
    hashes = [int(M.Words(np.frombuffer(t, np.uint8), np.array([0, len(t)])).hash[0]) for t in texts]
    assert len(set(hashes)) == 3
    both = b" ".join(texts)  # a word's hash does not depend on the words beside it
    assert M.Words(np.frombuffer(both + b" ab", np.uint8), np.array([0, len(both) + 3])).hash[:3].tolist() == hashes
    got = M.near_duplicates(docs_of([(i, t.decode()) for i, t in enumerate(texts)])).collect()
    assert {(r["doc_id"], r["rep_id"]) for r in got} == {(0, 0), (1, 1), (2, 2)}
