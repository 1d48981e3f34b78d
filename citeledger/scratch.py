"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_notes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(shared_folder, "own", None):
        shared_folder.own = "file://" + tempfile.mkdtemp(prefix="citeledger-")
    return shared_folder.own


def session_folder(spark: SparkSession) -> str:
    """The part of the shared folder that holds this application's tables, and nothing else."""
    return f"{shared_folder(spark)}/citeledger-{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for note in _notes:
        note.append(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    return kept


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Remove what ``keep`` wrote; only when nothing will read it again."""
    _remove(df.sparkSession, df.kept_path)


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """The paths of what ``keep`` writes meanwhile are added to paths."""
    _notes.append(paths)
    try:
        yield
    finally:
        _notes.pop()


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove noted tables; only when the results that read them have been written."""
    while paths:
        _remove(spark, paths.pop())


def release_all(spark: SparkSession) -> None:
    """Remove all tables that this application kept; only when no result will be read again."""
    _remove(spark, session_folder(spark))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows in enough partitions to keep every core at work.

    For small rows that take long to work through: a file of a few MB is one task however many
    rows it holds, and adaptive execution would join partitions of so few bytes again.
    """
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
