"""From documents to packed sequences: toxicity, quality, near duplicates, benchmark leaks, packing.

Every stage gets the documents that the one before kept, from a written table, and all but the last
return the columns of documents. Tables that a stage writes for itself are deleted when the next one
begins or the run ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import decontamination, packing, partenum, quality, toxicity
from linkloom.session import BATCH_BYTES, BATCH_ROWS, delete_folder, new_scope, ship_package, smaller_batches, staging_below

WORDS, PERCENT = 5, 80  # near duplicates: shingles of five words, similarity 0.8 or more
TEXTS = 2000  # whole texts that a Python function gets at once
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _own_scope(stage: Stage) -> Stage:
    """The stage with a folder of its own for what it writes; that of the stage before is deleted.

    Its result is worked out after it has returned, so the size of batches stays set in the session.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        smaller_batches(spark, TEXTS)
        while _left:
            delete_folder(spark, _left.pop())
        _left.append(new_scope(spark))
        with staging_below(_left[-1]):
            return stage(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_own_scope
def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


@_own_scope
def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of poor quality go."""
    return quality.without_poor(docs, _table(spark, sf_dir, "labels"))


@_own_scope
def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest doc_id stays."""
    return partenum.one_of_each(docs, WORDS, PERCENT)


@_own_scope
def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontamination.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


@_own_scope
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, with their places in sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_out),
    ("quality", poor_out),
    ("near_duplicates", copies_out),
    ("decontamination", leaks_out),
    ("packing", packed),
]
# The stages learn from labels, follow links and encode tokens: not for SQL. The tests compare each
# with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    scope = new_scope(spark)
    batches = {name: spark.conf.get(name) for name in (BATCH_ROWS, BATCH_BYTES)}
    before = None
    for name, stage in STAGES:
        path = f"{scope}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    while _left:
        delete_folder(spark, _left.pop())
    for name, value in batches.items():
        spark.conf.set(name, value)
    return docs
