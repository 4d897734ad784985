"""Reads as a stream: every FASTQ file that is put into a folder is parsed once, in pieces, whatever its size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seqloom.plans.deploy import ship
from seqloom.schema import READ_SCHEMA
from seqloom.sources.fastq import FastqSplit, read_split
from seqloom.sources.files import open_file


#: Of Spark's source of whole files; their content is never asked for.
_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            with open_file(path) as f:
                yield from read_split(f, FastqSplit(path, 0, -1, 0))


def stream_fastq(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """A streaming DataFrame of reads. grep, alignment and quality shifts run on it in append mode, histograms (k-mers
    to k = 12) and counts in complete mode. The stream itself carries the files' paths; a task reads a file in chunks."""
    ship(spark)
    files = spark.readStream.schema(_FILES).format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select("path").mapInArrow(_parse, READ_SCHEMA)
