"""Growing FASTQ files as micro-batches.

The stream itself carries only how far files have grown: a row (path, from, to) for each file of a folder that is new or
longer than before. A batch turns these ranges into reads with Spark jobs, as for any large file: lines are
counted by range, so that a file of any size is read by many tasks, and what follows the last whole record is left to the next
batch. Where each file's next record begins is written down by batch, beside the stream's own checkpoint: a batch that
is run again reads the same bytes, gives the same numbers to its records, and takes the place of what it wrote before.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from seqloom.plans.deploy import ship
from seqloom.sources.fastq import SPLIT_BYTES, FastqSplit, counted, reads_of
from seqloom.sources.files import file_system
from seqloom.sources.sinks import write_fastq

#: Batches whose notes are kept, besides the last one's.
KEPT = 10


class Growth(D.InputPartition):
    def __init__(self, rows: list[tuple[str, int, int]]):
        super().__init__(None)
        self.rows = rows


class GrowthReader(D.DataSourceStreamReader):
    """Offsets are the files' lengths; nothing of a file is read here."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, inner = file_system(self.folder)
        head = self.folder[: len(self.folder) - len(inner)] if "://" in self.folder and not self.folder.startswith("file:") else ""
        found = system.get_file_info(fs.FileSelector(inner))
        return {head + f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[:1] not in "._"}

    def partitions(self, start: dict, end: dict) -> Sequence[D.InputPartition]:
        rows = [(p, start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)]
        return [Growth(rows)] if rows else []

    def read(self, partition: Growth) -> Iterator[pa.RecordBatch]:
        path, before, now = zip(*partition.rows)
        yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(before, pa.int64()), pa.array(now, pa.int64())], ["path", "before", "now"])


class GrowthSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_growth"

    def schema(self):
        return "path string, before bigint, now bigint"

    def streamReader(self, schema) -> D.DataSourceStreamReader:
        return GrowthReader(self.options["path"])


# ---------------------------------------------------------------- what a batch reads


class Notes:
    """Byte and number of each file's next record, after each batch."""

    def __init__(self, folder: str):
        self.system, self.folder = file_system(folder)

    def _path(self, batch: int) -> str:
        return f"{self.folder}/{batch:012d}.json"

    def before(self, batch: int) -> dict[str, list[int]]:
        if batch == 0:
            return {}
        with self.system.open_input_stream(self._path(batch - 1)) as f:
            return json.loads(f.read())

    def write(self, batch: int, state: dict[str, list[int]]) -> None:
        self.system.create_dir(self.folder, recursive=True)
        with self.system.open_output_stream(self._path(batch) + ".new") as f:
            f.write(json.dumps(state).encode())
        self.system.move(self._path(batch) + ".new", self._path(batch))
        if batch > KEPT:
            from pyarrow import fs

            if self.system.get_file_info(self._path(batch - KEPT - 1)).type != fs.FileType.NotFound:
                self.system.delete_file(self._path(batch - KEPT - 1))


def new_splits(spark: SparkSession, grown: list[tuple[str, int]], state: dict[str, list[int]], split_bytes: int = SPLIT_BYTES) -> tuple[list[FastqSplit], dict[str, list[int]]]:
    """Splits of what ``grown`` (path, length) hold beyond ``state``, up to their last whole records, and the state behind them.
    Packed files are read whole when they are first seen."""
    splits, after, ranges = [], dict(state), []
    for k, (path, length) in enumerate(grown):
        at = state.get(path, [0, 0])[0]
        if path.endswith(".gz"):
            if path not in state:
                splits.append(FastqSplit(path, 0, -1, 0, k, "gzip"))
                after[path] = [length, -1]
        else:
            ranges += [(k, path, b, min(b + split_bytes, length), "plain") for b in range(at, length, split_bytes)]
    by_file: dict[int, list] = {}
    for r in counted(spark, ranges) if ranges else ():
        by_file.setdefault(r["k"], []).append(r)
    for k, rows in by_file.items():
        path = rows[0]["path"]
        records = state.get(path, [0, 0])[1]
        lines, total = 4 * records, sum(r["n"] for r in rows)
        if not total // 4:
            continue
        # The place behind the last whole record: so many newlines before the last one.
        ends = [e for r in rows for e in r["last"]]
        stop = ends[-1 - total % 4] + 1
        broken = False
        for r in rows:
            if r["start"] < stop:
                splits.append(FastqSplit(path, r["start"], min(r["stop"], stop), lines, k, "plain", broken, lines + r["n"]))
            lines, broken = lines + r["n"], broken if r["ends"] is None else not r["ends"]
        after[path] = [stop, records + total // 4]
    return sorted(splits, key=lambda s: s.file_no), after


def stream_growing(spark: SparkSession, folder: str, checkpoint: str, use: Callable[[DataFrame, int], None], split_bytes: int = SPLIT_BYTES, **trigger):
    """Start a query that calls ``use(reads, batch)`` with the reads that were added to the files of ``folder``; ``checkpoint`` is its
    folder, ``trigger`` as for Structured Streaming. A batch may be run again after a failure, then with the same reads."""
    ship(spark)
    spark.dataSource.register(GrowthSource)
    notes = Notes(f"{checkpoint.rstrip('/')}/reads")

    def run(rows: DataFrame, batch: int) -> None:
        grown = sorted((r["path"], r["now"]) for r in rows.collect())  # a row a file that has grown
        splits, after = new_splits(rows.sparkSession, grown, state := notes.before(batch), split_bytes)
        if splits:
            use(reads_of(rows.sparkSession, [[s] for s in splits]), batch)
        notes.write(batch, after if splits else state)

    growth = spark.readStream.format("fastq_growth").load(folder)
    return growth.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def batch_writer(folder: str, transform: Callable[[DataFrame], DataFrame] | None = None, blocked: bool = False) -> Callable[[DataFrame, int], None]:
    """For ``stream_growing``: every batch as a folder of its own, which appears whole; a batch that is run again takes the place of
    its first run."""

    def write(reads: DataFrame, batch: int) -> None:
        write_fastq(transform(reads) if transform else reads, f"{folder.rstrip('/')}/batch-{batch:012d}", overwrite=True, blocked=blocked)

    return write
