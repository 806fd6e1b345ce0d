"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups.

1. One narrow pass: (id, 128-bit hash, SHA-256) per row, counted per hash with
   map-side combining.  Texts do not move.
2. Only rows whose hash occurs more than once carry their text into
   ``groupBy(hash, text)``.  That comparison of whole texts is what excludes hash
   collisions, and the map-side combine turns any number of copies into one row
   per task.
3. Every row takes the class of its (hash, SHA-256); a class of one is itself.

Defined results: a null text counts as empty; an empty table gives no rows; a
null id is returned as a row of its own (ids compare null-safe, a class with
other members keeps a non-null id); rows repeating both id and text are one
document, returned once (with ``each_row``, as in the query, once per row), and
``group_size`` counts each of the rows.  Other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.tables import fingerprint, once, sized, without, written


def content_hash(text: Column) -> Column:
    """128 bits (MD5) of the UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                 hash128: Callable[[Column], Column] = content_hash, each_row: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, text_fp, row_copies.

    ``each_row``: one row per row of ``docs`` instead, each with a ``row_copies`` of 1.

    ``keep``: the ``smallest`` or ``largest`` id of a group stays.  ``hash128``
    can be replaced (tests use a hash that collides).
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).select(
        "_id", "_t", hash128(F.col("_t")).alias("_h"), F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("_s"),
        fingerprint(F.col("_t")).alias("_fp"))
    rows = base.select("_id", "_h", "_s", "_fp", F.lit(1).cast("bigint").alias("_copies")) if each_row else \
        base.groupBy("_id", "_h", "_s", "_fp").agg(F.count("*").alias("_copies"))
    rows = written(rows, "exact-rows")
    dup = sized(rows.groupBy("_h").agg(F.sum("_copies").alias("n")).filter("n > 1").select("_h"), "exact-dup")
    classes = (base.join(dup, "_h", "left_semi")
               .groupBy("_h", "_t", "_s").agg(pick("_id").alias("_keep"), F.count("*").alias("_size"))
               # different texts under equal MD5 and SHA-256 would be told apart only by their bytes: stop then
               .groupBy("_h", "_s").agg(F.first("_keep").alias("_keep"), F.first("_size").alias("_size"),
                                        F.count("*").alias("_texts"))
               .withColumn("_size", F.when(F.col("_texts") == 1, F.col("_size"))
                           .otherwise(F.raise_error(F.lit("two texts share both hashes")).cast("bigint")))
               .select("_h", "_s", "_keep", "_size"))
    classes = written(classes, "exact-classes")
    out = rows.join(classes, ["_h", "_s"], "left")
    single = F.col("_size").isNull()
    return out.select(
        F.col("_id").alias("doc_id"),
        F.when(single, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", "_copies").cast("bigint").alias("group_size"),
        (single | F.col("_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        F.lower(F.hex("_s")).alias("text_sha256"),
        F.col("_fp").alias("text_fp"), F.col("_copies").alias("row_copies"))


def drop_exact_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    groups = written(exact_groups(docs, keep=keep).select("doc_id", "kept", "text_fp", "row_copies"), "exact-groups")
    left = without(docs, groups.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_fp").alias("_fp")),
                   "exact-dropped")
    repeats = groups.filter("kept and row_copies > 1")
    return left if repeats.isEmpty() else once(
        left, repeats.select(F.col("doc_id").alias("_id"), F.col("text_fp").alias("_fp")), "exact-repeats")
