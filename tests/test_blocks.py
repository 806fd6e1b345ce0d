"""Blocks of training rows: what a task holds of them, and that the order of the input does not lead the network astray."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskframe.models import blocks as B
from riskframe.models import gelu_net as G


def test_a_row_group_holds_few_blocks(spark):
    """Writer and reader hold a row group at once, which had a hundred blocks and more."""
    rows = spark.range(0, 400_000, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: k + F.rand(1)).alias("x"), F.lit(1.0).alias("y"))
    table, path = B.written(B.in_blocks(rows, lambda x: x, lambda n, t: np.zeros(n), 8192), "blocks")
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    sizes = [m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)]
    assert sum(sizes) == 49 and max(sizes) <= 1 + B.GROUP_BYTES // (8192 * 16 * 8)
    assert table.agg(F.sum("n")).first()[0] == 400_000 and table.agg(F.max("n")).first()[0] == 8192


def test_gathered_rows_stay_whole_and_in_order():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b))], ["v"]) for a, b in ((0, 3), (3, 3), (3, 14), (14, 15))]
    got = [t["v"].to_pylist() for t in B.gathered(iter(batches), 4)]
    assert got == [list(range(k, min(k + 4, 15))) for k in range(0, 15, 4)] and list(B.gathered(iter([]), 4)) == []


def test_rows_that_lie_by_class_train_the_network(spark):
    """(F1-F21, F22, F23) A task of several blocks that each held one class only ended every epoch on the last class."""
    rows = spark.range(0, 150_000, 1, 1).select(F.col("id"), (F.col("id") < 75_000).cast("int").alias("label"), F.rand(3).alias("u"), F.randn(4).alias("v")) \
        .select("id", "label", array_to_vector(F.array(F.col("label") + F.col("u") * 2 - 1.5, F.col("v"))).alias("scaled"))
    m = G.GeluNetwork(epochs=3, partitions=1).fit(rows, "id")
    assert m.val_loss_curve[-1] < 0.5 < m.val_loss_curve[0]


def test_probabilities_in_parts_equal_those_at_once():
    sizes = [5, 6, 4, 1]
    flat = G.GeluNetwork(hidden=(6, 4)).start(sizes)
    x = np.random.default_rng(0).standard_normal((2 * G.ROWS_AT_ONCE + 7, 5))
    for kind in ("gelu", "relu"):
        assert np.allclose(G.probabilities(flat, sizes, kind, x), G.layer_outputs(flat, sizes, kind, x)[-1][:, 0], atol=1e-14)
    assert len(G.probabilities(flat, sizes, "gelu", x[:0])) == 0
    value, slope = G.gelu_curve(x)
    k = G.GELU_RATE * (x + G.GELU_CUBIC * x ** 3)
    s = 1 / (1 + np.exp(-k))
    assert np.allclose(value, x * s, atol=1e-12) and np.allclose(slope, s + x * s * (1 - s) * G.GELU_RATE * (1 + 3 * G.GELU_CUBIC * x * x), atol=1e-12)
