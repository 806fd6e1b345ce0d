"""Corpus pipeline: ``documents`` to encoded training data in five stages.

Each stage reads the table its predecessor kept (written as Parquet and read again), drops
rows by its own decisions and returns the remaining ones with all columns of ``documents``;
the last stage returns the encoded documents.

1. toxicity: documents predicted toxic go (learned from ``labels``),
2. exact dedup: of equal texts, the row with the smallest id stays,
3. near duplicates: of documents connected by word-shingle similarity, the smallest id stays,
4. decontamination: documents that contain a window of a ``benchmark`` item go,
5. encoding: pieces of every remaining text, decoded again as a check.

Defined results of every stage: a null text counts as empty; an empty text is not toxic, equals other empty texts (one
stays), is near no other text, holds no window and has no pieces; texts of any length are read whole; rows that
repeat id and text are copies of each other; rows with equal ids and different texts, or null ids, are rows of their
own; ties go to the smallest id; an empty table stays empty; other columns are carried along, whatever their names
(the last stage returns its own).

``run`` applies them to ``documents``.  Toxicity is a trained model, which SQL cannot
express, so there is no ``ORACLE_SQL``; tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import tables
from riskframe.llm.decontam import drop_contaminated
from riskframe.llm.exact_dedup import drop_exact_copies
from riskframe.llm.minhash_forest import drop_near_duplicates
from riskframe.llm.piece_lattice import encode_and_decode
from riskframe.llm.toxicity import drop_toxic
from riskframe.session import ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, tables.read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs, keep="smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, tables.read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_and_decode(docs, with_ids=True)


_MADE: list[str] = []


def _stage(f):
    """A stage that first removes the scratch tables of earlier stages, whose results are written by then."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        tables.release(docs, _MADE)
        before = set(tables.scratch_now())
        out = f(spark, docs, sf_dir)
        _MADE[:] = [p for p in tables.scratch_now() if p not in before]
        return out
    run_stage.__name__, run_stage.__doc__ = f.__name__, f.__doc__
    return run_stage


STAGES = [(f.__name__, _stage(f)) for f in (toxicity, exact_dedup, near_dedup, decontamination, encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the table is written to the shared scratch folder."""
    docs = tables.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
