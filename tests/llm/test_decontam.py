import hashlib
import re

from riskframe.llm.decontam import contamination, drop_contaminated

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    windows = []
    for i, t in items:
        w = W.findall((t or "").translate(LOW))
        windows += [("" if i is None else str(i), w[s:s + 10]) for s in range(max(1, len(w) - 9)) if w]
    out = []
    for d, t in docs:
        w = W.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if w[s:s + len(win)] == win:
                    hit.update(range(s, s + len(win)))
                    found.add(item)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


ITEMS = [(1, words(0, 12)), (2, words(5, 15)), (10, "Short ITEM"), (3, "École fermée"), (4, None), (5, "..."), (6, words(50, 57)),
         (None, "alpha beta gamma"), (7, words(0, 12)), (8, "rep rep rep rep rep rep rep rep rep rep rep"), (9, "x")]
DOCS = [(1, words(0, 30)), (2, words(1, 11)), (3, words(0, 9)), (4, "a short, item! and SHORT-item"), (5, "école fermée"), (6, "École, fermée"),
        (7, None), (8, ""), (9, "?!"), (10, words(49, 58)), (11, "rep " * 25), (12, "alpha beta gamma"), (13, "X"), (14, "K xx"),
        (15, "pre " + words(0, 12) + " mid " + words(0, 12)), (16, "lead " * 5000 + words(3, 15)), (None, words(0, 12)), (2, words(1, 11))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_against_brute_force(spark, docs_of):
    got = contamination(docs_of(DOCS), frame(spark, ITEMS)).drop("text_fp")
    assert sorted(map(tuple, got.collect()), key=str) == brute(DOCS, ITEMS)


def test_hot_passage_common_words_and_empty(spark, docs_of):
    docs = [(i, f"the of and {words(0, 12)} the of" if i % 3 == 0 else "the of and a the of and a the of and b") for i in range(300)]
    items = [(1, words(0, 12)), (2, "the of and a the of and a the of and a")]
    got = contamination(docs_of(docs), frame(spark, items)).drop("text_fp")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    assert contamination(docs_of([]), frame(spark, items)).count() == 0
    assert not contamination(docs_of(docs), frame(spark, [])).filter("contaminated").count()


def test_clean_documents_stay_as_they_were(spark, docs_of):
    df = docs_of(DOCS)
    left = drop_contaminated(df, frame(spark, ITEMS))
    assert left.columns == df.columns
    bad = {r[0] for r in brute(DOCS, ITEMS) if r[-1]}
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in DOCS} - bad


def test_position_filter_marks_the_slots_of_all_shingles(spark):
    from riskframe.llm import decontam as D
    h = [5, -7, 1 << 60, 123456789, -(1 << 62)]
    table = D.position_filter(spark.createDataFrame([(x,) for x in h], "h long"))
    size = len(table)
    assert size == D.LEAST_SLOTS
    want = {((x & (1 << 64) - 1) >> 13 * p if p else x) % size for x in h for p in range(D.PROBES)}
    assert {i for i, b in enumerate(table) if b == ord("1")} == want
    assert set(D.position_filter(spark.createDataFrame([], "h long"))) == {ord("0")}
