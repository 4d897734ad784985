"""The folder that driver and executors share, for checkpoints and tables between jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What the session names as spark.checkpoint.dir, or else the context's checkpoint folder. Where neither is set, a local session gets a
    folder of its own; on a cluster that is an error, as executors would each write to their own disks."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="seqloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/seqloom/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, partition by partition as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows and bytes of an Arrow batch to a Python worker; reads may be long.
BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch bounds where they are higher. They have to hold when a result is computed, and so stay
    lowered; lower ones of the session's own are left alone."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        own = spark.conf.get(name).removesuffix("b").removesuffix("B")
        if not (own.isdigit() and 0 < int(own) <= most):
            spark.conf.set(name, str(most))
