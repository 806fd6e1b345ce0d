import zlib
from collections import Counter

import numpy as np

from riskframe.llm.hyper_shuffle import communication_matrix, shard_table, shuffle_into_shards, write_shards


def test_matrix_margins_and_law():
    counts = [5, 0, 17, 1000, 3]
    m = communication_matrix(counts, 8, 1)
    assert m.sum(axis=1).tolist() == counts
    total = sum(counts)
    assert m.sum(axis=0).tolist() == [total // 8 + (s < total % 8) for s in range(8)]
    # mean of an entry over seeds: n_p * room_s / N
    seen = np.mean([communication_matrix([40, 60], 4, s)[0] for s in range(400)], axis=0)
    assert np.allclose(seen, 10, atol=0.6)
    big = communication_matrix([3_000_000_000, 2_000_000_001], 8, 3)
    assert big.sum(axis=1).tolist() == [3_000_000_000, 2_000_000_001] and big.sum(axis=0).max() - big.sum(axis=0).min() <= 1


def test_shards_sizes_slots_and_values(spark, docs_of):
    rows = [(i, f"text {i} é") for i in range(203)] + [(None, None), (7, "same"), (7, "same")]
    got = shuffle_into_shards(docs_of(rows).repartition(5), 8, block_rows=7).collect()
    assert len(got) == len(rows)
    per = Counter(r["shard"] for r in got)
    assert max(per.values()) - min(per.values()) <= 1 and len(per) == 8
    for s in per:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(per[s]))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] is not None]
    assert order != sorted(order) and order != sorted(order, reverse=True)


def test_uniform_over_seeds(docs_of):
    df = docs_of([(i, "t") for i in range(16)]).repartition(3).cache()
    where = Counter()
    for seed in range(30):
        where.update((r["shard"]) for r in shuffle_into_shards(df, 4, seed=seed).collect() if r["doc_id"] == 5)
    assert len(where) == 4


def test_empty_and_contract_columns(docs_of):
    assert shuffle_into_shards(docs_of([]), 8).count() == 0
    assert shard_table(docs_of([(1, "a")])).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_write_shards(spark, docs_of, tmp_path):
    write_shards(docs_of([(i, f"t{i}") for i in range(40)]), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 40 and {r["_shard"] for r in back.select("_shard").distinct().collect()} == {0, 1, 2, 3}


def test_write_shards_null_and_repeated_ids(spark, docs_of, tmp_path, rows_of):
    rows = [(i, f"t{i}") for i in range(20)] + [(None, f"null {i}") for i in range(9)] + [(7, f"hot {i % 5}") for i in range(15)]
    df = docs_of(rows).selectExpr("*", "'x' AS part", "'y' AS pos").repartition(5)
    write_shards(df, str(tmp_path / "s"), 8)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert rows_of(back.select(df.columns)) == rows_of(df)
    for k, n in ((k, 44 // 8 + (k < 44 % 8)) for k in range(8)):
        assert sorted(r["_slot"] for r in back.filter(f"_shard = {k}").collect()) == list(range(n))


def test_query_moves_the_documents(spark, docs_of):
    rows = [(i, f"text {i} é") for i in range(30)] + [(None, None), (None, ""), (7, "same"), (7, "same")]
    got = shard_table(docs_of(rows).repartition(3), 8).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert Counter(r["shard"] for r in got) == {k: 34 // 8 + (k < 34 % 8) for k in range(8)}
    assert len({(r["shard"], r["slot"]) for r in got}) == 34
    assert shard_table(docs_of([])).count() == 0
