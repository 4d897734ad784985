"""Helpers that the corpus operators share: the shared folder, staged tables and Arrow batch bounds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans.shared import shared_dir

#: Rows and bytes of one Arrow batch to a Python worker. Texts may be long, so both are bounded.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


#: Folders that stage_table wrote, for each ``temporary_tables`` that is open in this thread or task.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


def new_table(spark: SparkSession, label: str) -> str:
    """Path of a table to be written in the shared folder."""
    path = f"{shared_dir(spark)}/seqloom/{label}-{uuid.uuid4().hex}"
    for paths in _written.get():
        paths.append(path)
    return path


def stage_table(df: DataFrame, label: str, *by: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in a folder for each value of ``by``, and read it back: lineage is
    cut, nothing is kept in executors."""
    path = new_table(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``stage_table`` (without ``by``) that no later plan reads."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at its end, the tables that are staged within it, but for those taken out of the list."""
    paths: list[str] = []
    token = _written.set((*_written.get(), paths))
    try:
        yield paths
    finally:
        _written.reset(token)
        for path in paths:
            _delete(spark, path)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch bounds, where they are higher, so that long texts cannot exhaust a Python worker.
    They have to hold when a result is computed, and so stay lowered; lower ones of the session's own are left alone."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        own = spark.conf.get(name).removesuffix("b").removesuffix("B")
        if not (own.isdigit() and 0 < int(own) <= most):
            spark.conf.set(name, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(key: str, parts: int):
    """crc32 of the key as text, modulo ``parts``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, size: int, *key: str, distinct: bool = False) -> DataFrame:
    """About 1.3 times ``size`` rows of ``df`` at most (all, if fewer), chosen by a hash of ``key``, in a column ``nth`` to
    order by: ``orderBy("nth").limit(size)`` after what shortens the rows. ``distinct`` drops repeated rows first, within
    the tasks that read them, so that one row repeated cannot fill the sample."""
    n = df.count()
    share = min(1.0, 1.3 * size / max(n, 1))
    h = F.xxhash64(*key)
    chosen = df.where(F.pmod(h, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return (chosen.distinct() if distinct else chosen).withColumn("nth", h)
