"""A training-data pipeline: STAGES run in order over the documents table.

A stage's input is a table that was written: what the stages before it kept in the shared
folder has been read by then, and is removed.  So one pipeline runs at a time in a process.
A stage leaves the session with batches of ``BATCH_BYTES`` between the JVM and Python: its
result is computed only when it is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from citeledger.llm.cotraining import without_rejected
from citeledger.llm.decontaminate import removal_spans
from citeledger.llm.harmonic_packing import sequences
from citeledger.llm.simhash_dedup import without_near_copies
from citeledger.llm.substring_dedup import repeats, without_spans
from citeledger.scratch import keep, load, noted, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Each running task holds several copies of a batch, in the JVM and in its worker; of whole texts 10,000 rows are too many.
BATCH_BYTES = 4 << 20
_kept: list[str] = []


def _clearing(stage: Stage) -> Stage:
    """The stage, in batches of few bytes, after the tables that earlier ones kept are removed."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _kept)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        with noted(_kept):
            return stage(spark, docs, sf_dir)

    return run_stage


@_clearing
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return without_rejected(docs, load(spark, sf_dir, "labels"))


@_clearing
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return without_near_copies(docs)


@_clearing
def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, except where they come first; documents left without words go."""
    return without_spans(docs, repeats(docs))


@_clearing
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go; documents left without words go."""
    return without_spans(docs, removal_spans(docs, load(spark, sf_dir, "benchmark")))


@_clearing
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as sequences: the bins with the ids and texts of their documents."""
    return sequences(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_dedup", near_copies),
    ("substring_dedup", substring),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: The classifier and the near-copy groups have no SQL form; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
