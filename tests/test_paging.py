"""Deep pages read the files that hold them, and nothing else."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators import paging as P
from riskframe.session import scratch_path


@pytest.fixture(scope="module")
def listing(spark):
    df = spark.range(120_000).select((F.col("id") * 7919 % 120_000).alias("app_id"), F.concat(F.lit("user "), F.col("id") % 9).alias("name"))
    path = scratch_path(spark, "pages")
    P.write_pages(df, "app_id", path, rows_per_file=10_000)
    return df, path


@pytest.mark.parametrize("offset,limit", [(0, 100), (20, 100), (9_990, 30), (100_000, 500), (119_990, 100), (120_000, 5), (500_000, 5), (3, 0)])
def test_pages_equal_the_sorted_table(spark, listing, offset, limit):
    df, path = listing
    page = P.read_page(spark, df.schema, "app_id", path, offset, limit)
    want = [tuple(r) for r in df.orderBy(F.desc("app_id")).offset(offset).limit(limit).collect()]
    assert [tuple(r) for r in page.collect()] == want
    assert len(page.inputFiles()) <= 2 + limit // 5_000


def test_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(i // 50 if i % 11 else None, f"n{i}") for i in range(500)], "k long, name string")
    path = scratch_path(spark, "pages")
    P.write_pages(df, "k", path, rows_per_file=60)
    got = [tuple(r) for o in range(0, 520, 40) for r in P.read_page(spark, df.schema, "k", path, o, 40).collect()]
    assert got == [tuple(r) for r in df.orderBy(F.desc_nulls_last("k"), "name").collect()]
    empty = scratch_path(spark, "pages")
    P.write_pages(df.limit(0), "k", empty)
    assert P.read_page(spark, df.schema, "k", empty, 0, 10).count() == 0
