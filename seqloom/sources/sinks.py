"""Text sinks. What is written appears at once, when all of it is there, in place of what was there before."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from seqloom.sources.blocked import BlockedWriter
from seqloom.sources.files import delete_folder, exists, file_system, is_local, list_files, local_path


def _until_nul(column: str):
    """Printed fields end at a NUL byte."""
    return F.substring_index(F.col(column), "\0", 1)


def fastq_text(reads: DataFrame) -> DataFrame:
    """One string a record, without its final newline."""
    parts = (F.lit("@"), _until_nul("id1"), F.lit("\n"), _until_nul("seq"), F.lit("\n+"), _until_nul("id2"), F.lit("\n"), _until_nul("qual"))
    return reads.select(F.concat(*parts).alias("value"))


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class LineWriter(DataSourceArrowWriter):
    """A file for each task, one byte for each character. Files of attempts that did not end are deleted at the end."""

    def __init__(self, path: str, blocked: bool):
        self.path, self.blocked = path, blocked

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = file_system(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}" + ".gz" * self.blocked
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}", compression=None) as f:
            out = BlockedWriter(f) if self.blocked else f
            for b in iterator:
                if b.num_rows:
                    out.write(("\n".join(b.column(0).to_pylist()) + "\n").encode("latin-1"))
            if self.blocked:
                out.close()
        return _Written(name)

    def commit(self, messages) -> None:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        whole = {m.name for m in messages if m is not None}
        for path in list_files(self.path):
            if path.rpartition("/")[2] not in whole:
                system.delete_file(file_system(path)[1])

    def abort(self, messages) -> None:
        delete_folder(self.path)


class LineSink(DataSource):
    """Sink for one string column of Latin-1 text, which Spark's own text sink cannot write."""

    @classmethod
    def name(cls) -> str:
        return "latin1_lines"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return LineWriter(self.options["path"], self.options.get("blocked", "false") == "true")


@contextmanager
def _claimed(path: str) -> Iterator[None]:
    """Lets one writer at a time write to ``path``: the one that creates the claim beside it. Where files cannot be created
    exclusively, a writer that sees another's claim gives way, so that two may both fail but never both go on."""
    claim = path.rstrip("/") + ".claim"
    if is_local(path):
        claim = os.path.abspath(local_path(claim))
        os.makedirs(os.path.dirname(claim), exist_ok=True)
        try:
            os.close(os.open(claim, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            raise FileExistsError(f"{path} is being written; if not, delete {claim}") from None
        drop = lambda: os.unlink(claim)
    else:
        from pyarrow import fs

        system, inner = file_system(claim)
        own = f"{inner}-{uuid.uuid4().hex}"
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(own):
            pass
        drop = lambda: system.delete_file(own)
        others = [f.path for f in system.get_file_info(fs.FileSelector(inner.rpartition("/")[0])) if f.path.startswith(f"{inner}-") and f.path != own]
        if others:
            drop()
            raise FileExistsError(f"{path} is being written; if not, delete {others[0]}")
    try:
        yield
    finally:
        drop()


@contextmanager
def staged(path: str, overwrite: bool) -> Iterator[str]:
    """A folder to write, beside ``path``. It takes the place of ``path`` by one rename when the block ends well, and goes otherwise;
    what was there before stays until then, so that it can be read by what is written. In between both are whole on the disk, the old one
    as ``path``.old-..."""
    path = path.rstrip("/")
    if exists(path) and not overwrite:
        raise FileExistsError(f"{path} exists")
    mark = uuid.uuid4().hex
    new, old = f"{path}.staged-{mark}", f"{path}.old-{mark}"
    with _claimed(path):
        try:
            if exists(path) and not overwrite:  # since then
                raise FileExistsError(f"{path} exists")
            yield new
            system, inner = file_system(path)
            replaced = exists(path)
            if replaced:
                system.move(inner, file_system(old)[1])
            try:
                system.move(file_system(new)[1], inner)
            except Exception:
                if replaced:
                    system.move(file_system(old)[1], inner)
                raise
        except BaseException:
            delete_folder(new)
            raise
        if replaced:
            system, inner = file_system(old)
            if system.get_file_info(inner).is_file:
                system.delete_file(inner)
            else:
                system.delete_dir(inner)


def _write_lines(lines: DataFrame, path: str, overwrite: bool, blocked: bool) -> None:
    spark = lines.sparkSession
    spark.createDataFrame([], "x int")  # makes the session this thread's own, in which Spark looks for sinks
    spark.dataSource.register(LineSink)
    with staged(path, overwrite) as folder:
        lines.write.format("latin1_lines").option("blocked", str(blocked).lower()).mode("append").save(folder)


def write_fastq(reads: DataFrame, path: str, overwrite: bool = False, blocked: bool = False) -> None:
    """A folder of text files in the order of the rows, as blocked gzip where ``blocked``; an existing one is an error unless
    ``overwrite``, and then stays as it is if writing fails. ``reads`` may come from that very folder."""
    _write_lines(fastq_text(reads), path, overwrite, blocked)


def write_lines(df: DataFrame, path: str, overwrite: bool = False, blocked: bool = False) -> None:
    """The string column ``value`` as lines; it may hold several, as FASTA records do."""
    _write_lines(df.select("value"), path, overwrite, blocked)


def write_tsv(df: DataFrame, path: str, header: bool = True, overwrite: bool = False) -> None:
    with staged(path, overwrite) as folder:
        df.write.option("sep", "\t").option("header", header).csv(folder)
