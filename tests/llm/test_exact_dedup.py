import duckdb
from pyspark.sql import functions as F

from riskframe.llm.exact_dedup import drop_exact_copies, exact_groups
from riskframe.llm.queries import ORACLES, QUERIES


def test_groups_keep_and_sizes(docs_of):
    df = docs_of([(1, "a"), (5, "a"), (3, "a"), (2, "b"), (4, None), (6, ""), (7, "A"), (8, "a ")])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(df, keep="largest").collect()}
    assert got == {1: (5, 3, False), 5: (5, 3, True), 3: (5, 3, False), 2: (2, 1, True), 4: (6, 2, False), 6: (6, 2, True),
                   7: (7, 1, True), 8: (8, 1, True)}
    small = {r["doc_id"]: r["keep_id"] for r in exact_groups(df).collect()}
    assert small[5] == 1 and small[6] == 4


def test_colliding_hash_is_told_apart_by_bytes(docs_of):
    df = docs_of([(i, f"text {i % 4}") for i in range(20)])
    one = exact_groups(df, hash128=lambda t: F.unhex(F.lit("00")) if True else t)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in one.collect()} == {(i, i % 4, 5) for i in range(20)}


def test_nulls_ties_repeats_long_and_empty(docs_of):
    long = "word " * 300_000
    df = docs_of([(None, "n"), (None, "n"), (9, "n"), (1, long), (2, long + "x"), (3, long), (4, "r"), (4, "r"), (4, "other")])
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(df).collect()), key=str)
    assert got == sorted([(None, 9, 3, False), (9, 9, 3, True), (1, 1, 2, True), (3, 1, 2, False), (2, 2, 1, True),
                          (4, 4, 2, True), (4, 4, 1, True)], key=str)
    left = drop_exact_copies(df)
    assert left.columns == df.columns
    assert sorted(((r["doc_id"], len(r["text"])) for r in left.collect()), key=str) == sorted(
        [(9, 1), (1, len(long)), (2, len(long) + 1), (4, 1), (4, 5)], key=str)
    assert exact_groups(docs_of([])).count() == 0
    assert drop_exact_copies(docs_of([])).count() == 0


def test_query_returns_every_repeated_row(spark, docs_of, rows_of, tmp_path):
    docs_of([(4, "r"), (4, "r"), (4, "other"), (2, "r"), (5, "s"), (5, "s"), (6, None), (6, "")]).write.parquet(
        str(tmp_path / "documents.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duckdb.sql(ORACLES["op5_exact_dedup"]).fetchall()
    assert len(want) == 8
    assert rows_of(QUERIES["op5_exact_dedup"](spark, str(tmp_path))) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_each_row_with_null_ids(docs_of):
    df = docs_of([(None, "n"), (None, "n"), (9, "n"), (None, "alone")])
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(df, each_row=True).collect()), key=str)
    assert got == sorted([(None, 9, 3, False), (None, 9, 3, False), (9, 9, 3, True), (None, None, 1, True)], key=str)
