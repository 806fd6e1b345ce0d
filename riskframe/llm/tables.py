"""Small table helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import drop_scratch, scratch_path, scratch_tables, table_path

#: A side is broadcast only when it was written, counted, and holds at most this many rows
#: (every use ships one or two numbers per row, so this is a few tens of MB at most).
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table cuts the lineage, freezes row ids, and survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Write ``df`` and mark it for broadcast only if its counted rows are within ``limit``;
    a larger side is joined by a shuffle (which AQE splits where it is skewed)."""
    table = written(df, name)
    return F.broadcast(table) if table.count() <= limit else table


def fingerprint(text: Column) -> Column:
    """64-bit hash of a text; with the id it names a row where ids repeat."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, dropped: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose (id, text fingerprint) is in ``dropped`` (columns _id, _fp).

    Only ids and fingerprints move: the text stays where it was read unless
    ``dropped`` is too large to broadcast."""
    gone = sized(dropped.select("_id", "_fp").distinct(), name)
    on = docs[id_col].eqNullSafe(gone["_id"]) & (fingerprint(docs[text_col]) == gone["_fp"])
    return docs.join(gone, on, "left_anti")


def once(docs: DataFrame, repeats: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each (id, text) named in ``repeats`` (columns _id, _fp); only those rows are shuffled."""
    again = sized(repeats.select("_id", "_fp").distinct(), name)
    on = docs[id_col].eqNullSafe(again["_id"]) & (fingerprint(docs[text_col]) == again["_fp"])
    return docs.join(again, on, "left_anti").unionByName(docs.join(again, on, "left_semi").dropDuplicates([id_col, text_col]))


def release(docs: DataFrame, before: list[str]) -> None:
    """Remove the scratch tables ``before``, except those that ``docs`` still reads."""
    read_by = [f.split(":", 1)[-1].lstrip("/") for f in docs.inputFiles()]
    free = [p for p in before if not any(f.startswith(p.split(":", 1)[-1].strip("/") + "/") for f in read_by)]
    drop_scratch(docs.sparkSession, free)


def scratch_now() -> list[str]:
    """The scratch tables that exist by now."""
    return scratch_tables()
