"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows lie in partitions of n_1..n_P rows; the S shards shall hold N // S rows,
the first N % S of them one more.  In a uniform random permutation the number of
rows that partition p sends to shard s follows a multivariate hypergeometric law, so:

1. the rows are written once with their partition and position (frozen: any later
   recomputation sees the same partitions); steps 2 to 4 move narrow keys only,
2. the P x S matrix of exact counts is drawn, one partition after the other, from
   what the shards still have room for,
3. each partition is permuted locally; its first M[p,0] rows go to shard 0, the next
   M[p,1] to shard 1, and so on (the exchange),
4. each shard is permuted again, in blocks: a row's block is a uniform hash, blocks
   are ordered by the hash and numbered from the running total of the earlier blocks,
   so no task sorts a whole shard,
5. ``write_shards`` permutes whole rows in their partitions by a local sort and moves them once.

Only partition counts (one number per partition) reach the driver.

Defined results: a null text has size 1 (0 bytes plus 1) and the checksum of the empty
text; rows with equal or null ids are separate rows; an empty table gives no rows;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.tables import written
from riskframe.session import scratch_path

#: Input splits beyond this number share a partition of the matrix (bounds the matrix, not the rows).
MAX_PARTS = 4096
#: Rows aimed at in one block of a shard's second permutation.
BLOCK_ROWS = 100_000
#: The same where whole rows are numbered in a block, and the most blocks of a shard (the first slots of all are broadcast).
MOVED_ROWS, MOST_BLOCKS = 4_000, 1 << 16


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts of rows from each partition (row) to each shard (column), exact margins."""
    total = int(sum(counts))
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts):
        left = int(n)
        for s in range(shards):  # one hypergeometric draw per shard, conditioned on the earlier ones
            rest = int(room[s + 1:].sum())
            got = left if rest == 0 else _draw(rng, int(room[s]), rest, left)
            out[p, s] = got
            left -= got
        room -= out[p]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric number.  numpy's sampler ends at urns of 10^9; beyond that the normal limit of
    the law is rounded and held inside its exact range, so the margins stay exact."""
    if n == 0 or good == 0:
        return 0
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    f = good / total
    spread = (n * f * (1 - f) * (total - n) / (total - 1)) ** 0.5
    return min(max(round(n * f + rng.standard_normal() * spread), 0, n - bad), n, good)


def _key_columns(id_col: str, text_col: str) -> list:
    """The narrow columns of a row that the contract reports."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32")]


def _place() -> list:
    """Partition and position of a row; frozen once they are written."""
    return [(F.spark_partition_id() % MAX_PARTS).alias("part"), F.monotonically_increasing_id().alias("pos")]


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 20, id_col: str = "doc_id",
                        text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard (0..shards-1), slot (gapless from 0 in a shard)."""
    keys = written(docs.select(*_key_columns(id_col, text_col), *_place()), "shard-keys")
    return keys.join(slots_of(keys.select("part", "pos"), shards, seed, block_rows), "pos").select(
        "doc_id", "size", "text_crc32", "shard", "slot")


def matrix_ends(spark: SparkSession, counts: dict[int, int], shards: int, seed: int) -> DataFrame:
    """(part, ends): up to which rank the rows of a partition go to shard 0, 1, ..."""
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    return spark.createDataFrame([(int(p), [int(x) for x in np.cumsum(m)]) for p, m in zip(parts, matrix, strict=True)],
                                 "part int, ends array<bigint>")


def slots_of(keys: DataFrame, shards: int, seed: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """pos, shard and slot of every row of ``keys`` (part, pos), which must be frozen."""
    spark = keys.sparkSession
    counts = {r["part"]: r["n"] for r in keys.groupBy("part").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    ends = matrix_ends(spark, counts, shards, seed)
    # the local permutation: a partition's rows in the order of a seeded hash of their frozen position
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.col("pos")), "pos")
    sent = (keys.withColumn("rank", F.row_number().over(local).cast("bigint") - 1)
            .join(F.broadcast(ends), "part")
            .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank")))))
    blocks = max(1, -(-total // (shards * block_rows)))
    mix = F.xxhash64(F.lit(seed + 1), F.col("pos"))
    sent = written(sent.withColumn("mix", mix).withColumn("block", F.pmod(F.shiftrightunsigned("mix", 20), F.lit(blocks)))
                   .select("pos", "shard", "block", "mix"), "shard-sent")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sent.groupBy("shard", "block").agg(F.count("*").alias("n"))
               .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "block", "base"))
    inside = Window.partitionBy("shard", "block").orderBy("mix", "pos")
    return (sent.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["shard", "block"])
            .select("pos", "shard", (F.col("base") + F.col("r")).alias("slot")))


def shard_table(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """The contract's columns, read from the shards that the documents were moved into: the law is
    ``rows``, so a further shard keeps nothing in place and grown_shard is null."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    rows = docs.select("doc_id", "text")
    write_shards(rows, path, shards, seed)
    schema = T.StructType([*rows.schema, T.StructField("_slot", T.LongType()), T.StructField("_shard", T.IntegerType())])
    back = spark.read.schema(schema).parquet(path)
    return back.select(
        *_key_columns("doc_id", "text"), F.lit("rows").alias("law"), F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 20, block_rows: int = MOVED_ROWS) -> None:
    """Write the rows themselves, all columns, as ``path/_shard=k`` in slot order (column ``_slot``).

    Ids are not read, so null and repeated ones are rows like others.  Each input partition is permuted where it
    is (a local sort by a seeded hash) and written with its rows' ranks; a rank and the matrix give the shard, a
    second hash the block inside it, and counts of the narrow columns the blocks' first slots.  The rows then
    move once, range-partitioned by (shard, block), and are numbered inside their block."""
    spark = docs.sparkSession
    # the row as one struct, so that no column of the input meets the names used here
    local = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("_m")).sortWithinPartitions("_m")
    low = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's number in its partition
    rows = written(local.select("_row", F.spark_partition_id().alias("part"), low.alias("rank")), "shard-rows", "zstd")
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a number per partition
    ends = matrix_ends(spark, counts, shards, seed)
    blocks = min(MOST_BLOCKS, max(1, -(-sum(counts.values()) // (shards * block_rows))))
    mix = F.xxhash64(F.lit(seed + 1), "part", "rank")
    sent = (rows.join(F.broadcast(ends), "part").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
            .withColumn("mix", mix).withColumn("block", F.pmod(F.shiftrightunsigned("mix", 20), F.lit(blocks))))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = written(sent.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
        "shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "shard-bases")
    inside = Window.partitionBy("shard", "block").orderBy("mix", "part", "rank")
    # at most shards * MOST_BLOCKS bases
    (sent.join(F.broadcast(base), ["shard", "block"]).drop("ends").repartitionByRange("shard", "block")
     .withColumn("_slot", F.col("base") + F.row_number().over(inside) - 1)
     .select("_row.*", "_slot", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path))
