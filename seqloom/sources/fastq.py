"""FASTQ as a Spark data source.

A record is four lines, each ended by a newline; nothing else marks where one begins, so a split is
aligned by counting lines: one Spark job counts the newlines of every byte range, their running sums
give each range the number of its first line, and each range then reads the records that begin in
it. Ranges of blocked gzip are counted and read alike, by the members that begin in them; other gzip files are
one split each. A last record without its final newline is dropped unless ``strict_tail`` is off.

A range of record numbers can be asked for: splits that cannot hold such a record are not planned, and nothing behind the
last one is read. The source takes no filters from Spark: 4.1 keeps what a filter has pruned with the relation, so that
another query on the same DataFrame would miss rows.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from seqloom.schema import NUMBERED_SCHEMA
from seqloom.sources import blocked
from seqloom.sources.files import file_size, open_file, open_raw

SPLIT_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
#: Ranges that one plan holds, at most: beyond, they are longer. Files that are looked at at once.
MOST_RANGES, LOOKING = 20_000, 32
#: Bytes that a byte of a packed file counts for when small files are put together.
PACKED = 4
#: Reads that are read one after the other rather than counted first.
SEQUENTIAL = 1 << 20
_KINDS = {"rec_no": pa.int64(), "file_no": pa.int32()}
COLUMNS = tuple(f.name for f in NUMBERED_SCHEMA.fields if f.name != "file_no")


class FastqSplit:
    """Bytes [start, end) of a file; ``lines`` newlines precede ``start``. ``end`` -1: to the end. ``file_no``: the file's place
    among those that are read. ``kind``: "plain", "gzip" or "blocked", whose bytes are packed ones. ``broken``: whether ``start`` is within a line; None:
    look. ``after``: newlines before ``end``, -1 if they are not known."""

    def __init__(self, path: str, start: int, end: int, lines: int, file_no: int = 0, kind: str = "plain", broken: bool | None = None, after: int = -1):
        self.path, self.start, self.end, self.lines, self.file_no, self.kind, self.broken, self.after = path, start, end, lines, file_no, kind, broken, after

    def holds(self, start: int, stop: int | None) -> bool:
        """Whether a record numbered from ``start`` to below ``stop`` may begin here."""
        return (stop is None or (self.lines + bool(self.broken) + 3) // 4 < stop) and (self.after < 0 or self.after // 4 >= start)


class FastqPartition(D.InputPartition):
    def __init__(self, splits: list[FastqSplit]):
        super().__init__(None)
        self.splits = splits


# ---------------------------------------------------------------- records


def _lines_of_records(own: Iterable[bytes], after: Iterable[bytes], lines: int, broken: bool, strict_tail: bool) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first record, lines) of the records whose first line begins in ``own``; ``after`` is what follows it."""
    skip = (-(lines + broken)) % 4
    # Lines to drop before the first record: the rest of a broken one, then whole ones.
    drop = skip + broken
    record = (lines + broken + skip) // 4
    held: list[bytes] = []
    carry = b""

    def take(found: list[bytes]) -> list[bytes]:
        nonlocal drop, held
        if drop:
            gone = min(drop, len(found))
            drop -= gone
            found = found[gone:]
        held = held + found
        whole = len(held) // 4 * 4
        out, held = held[:whole], held[whole:]
        return out

    for data in own:
        found = (carry + data).split(b"\n")
        carry = found.pop()
        if out := take(found):
            yield record, out
            record += len(out) // 4
    # The record that began before the end goes on behind it. A range that began within dropped lines owns none.
    if not held and (drop or not carry):
        return
    for data in after:
        found = (carry + data).split(b"\n")
        carry = found.pop()
        need = 4 - len(held)
        if len(found) >= need:
            yield record, take(found[:need])
            return
        take(found)
    if not strict_tail and carry and len(held) == 3:
        yield record, [*held, carry]


def _pieces(f, size: int, left: int = -1) -> Iterator[bytes]:
    while left and (data := f.read(size if left < 0 else min(size, left))):
        left -= len(data) if left > 0 else 0
        yield data


def _texts(f, split: FastqSplit, chunk: int) -> tuple[Iterator[bytes], Iterator[bytes], bool]:
    """What lies in the split, what follows it, and whether it begins within a line."""
    if split.kind == "blocked":
        at = blocked.find_member(f, split.start, split.end)
        found = iter(()) if at is None else blocked.members(f, at)
        ahead: list[bytes] = []

        def own() -> Iterator[bytes]:
            for place, text in found:
                if place >= split.end:
                    ahead.append(text)
                    return
                yield text

        def after() -> Iterator[bytes]:
            yield from ahead
            yield from (text for _, text in found)

        return own(), after(), bool(split.broken)
    broken = bool(split.broken)
    if split.start:
        f.seek(split.start - (split.broken is None))
        if split.broken is None:
            broken = f.read(1) != b"\n"
    return _pieces(f, chunk, split.end - split.start if split.end >= 0 else -1), _pieces(f, 1 << 16), broken


def _text(values: list[bytes]) -> list[str]:
    return [v.decode("latin-1") for v in values]


def _unmark(values: list[bytes], mark: bytes) -> list[bytes]:
    return [v[1:] if v[:1] == mark else v for v in values]


def _batch(split: FastqSplit, first: int, lines: list[bytes], columns: Sequence[str]) -> pa.RecordBatch:
    n = len(lines) // 4
    make = {
        "source_file": lambda: [split.path] * n,
        "rec_no": lambda: range(first, first + n),
        "id1": lambda: _text(_unmark(lines[0::4], b"@")),
        "seq": lambda: _text(lines[1::4]),
        "id2": lambda: _text(_unmark(lines[2::4], b"+")),
        "qual": lambda: _text(lines[3::4]),
        "file_no": lambda: [split.file_no] * n,
    }
    schema = pa.schema([pa.field(c, _KINDS.get(c, pa.string()), nullable=False) for c in columns])
    return pa.RecordBatch.from_arrays([pa.array(make[c](), _KINDS.get(c, pa.string())) for c in columns], schema=schema)


def read_split(f, split: FastqSplit, strict_tail: bool = True, chunk: int = CHUNK_BYTES, columns: Sequence[str] = COLUMNS, start: int = 0, stop: int | None = None) -> Iterator[pa.RecordBatch]:
    """The records whose first line begins in the split, numbered from ``start`` to below ``stop``."""
    own, after, broken = _texts(f, split, chunk)
    for record, lines in _lines_of_records(own, after, split.lines, broken, strict_tail):
        n = len(lines) // 4
        lo, hi = max(0, start - record), n if stop is None else min(n, stop - record)
        if lo < hi:
            yield _batch(split, record + lo, lines[4 * lo : 4 * hi], columns)
        if stop is not None and record + n >= stop:
            return


# ---------------------------------------------------------------- the source


class FastqReader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.strict_tail = options.get("strict_tail", "true").lower() != "false"
        self.start, self.stop = int(options.get("start", 0)), int(options["stop"]) if "stop" in options else None
        groups = options.get("splits")
        self.groups = [[FastqSplit(*s) for s in g] for g in json.loads(groups)] if groups else [[FastqSplit(options["path"], 0, -1, 0, 0, "gzip" if options["path"].endswith(".gz") else "plain")]]

    def partitions(self) -> Sequence[D.InputPartition]:
        return [FastqPartition(g) for g in self.groups]

    def read(self, partition: FastqPartition) -> Iterator[pa.RecordBatch]:
        for split in partition.splits:
            with open_raw(split.path) if split.kind != "gzip" else open_file(split.path) as f:
                yield from read_split(f, split, self.strict_tail, columns=self.columns, start=self.start, stop=self.stop)


class FastqDataSource(D.DataSource):
    """``spark.read.format("fastq").load(path)``; ``read_fastq`` adds the splits of large files."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self):
        wanted = self.options["columns"].split(",") if "columns" in self.options else COLUMNS
        return StructType([f for f in NUMBERED_SCHEMA.fields if f.name in wanted])

    def reader(self, schema) -> D.DataSourceReader:
        return FastqReader(schema, dict(self.options))


# ---------------------------------------------------------------- planning


def _looked_at(path: str) -> tuple[int, str] | None:
    """(bytes, kind), or None if the file cannot be opened."""
    try:
        with open_raw(path) as f:
            if not path.endswith(".gz"):
                return file_size(path), "plain"
            return file_size(path), "blocked" if blocked.is_blocked(f.read(blocked.LARGEST)) else "gzip"
    except OSError:
        return None


_COUNTED = "k int, path string, start bigint, stop bigint, kind string"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Newlines of each range, whether its last byte is one (null if it has none), whether it could be unpacked, and where in the
    file its last newlines are, four at most."""
    for b in batches:
        found = []
        for r in b.to_pylist():
            split, n, ends, whole, last, at = FastqSplit(r["path"], r["start"], r["stop"], 0, kind=r["kind"], broken=False), 0, None, True, [], r["start"]
            with open_raw(split.path) as f:
                try:
                    for data in _texts(f, split, CHUNK_BYTES)[0]:
                        n, ends = n + data.count(b"\n"), data.endswith(b"\n") if data else ends
                        place, late = len(data), []
                        while len(late) < 4 and (place := data.rfind(b"\n", 0, place)) >= 0:
                            late.insert(0, at + place)
                        last, at = [*last, *late][-4:], at + len(data)
                except blocked.NotBlocked:
                    whole = False
            found.append((n, ends, whole, last))
        n, ends, whole, last = zip(*found)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(ends, pa.bool_()), pa.array(whole), pa.array(last, pa.list_(pa.int64()))], [*b.schema.names, "n", "ends", "whole", "last"])


def counted(spark: SparkSession, ranges: list[tuple[int, str, int, int, str]]) -> list:
    """The ranges (file, path, start, stop, kind) with what ``_count`` finds, in order; a row a range comes to the driver."""
    table = spark.createDataFrame(ranges, _COUNTED).repartition(len(ranges))
    rows = table.mapInArrow(_count, f"{_COUNTED}, n bigint, ends boolean, whole boolean, last array<bigint>").collect()
    return sorted(rows, key=lambda r: (r["k"], r["start"]))


def plan_splits(spark: SparkSession, files: list[tuple[str, int, str]], split_bytes: int = SPLIT_BYTES, whole: bool = False) -> list[FastqSplit]:
    """Splits of ``files`` (path, bytes, kind) in order, numbered by place; files of one range or plain gzip need no count.
    ``whole``: every file is one range."""
    split_bytes = max(split_bytes, -(-sum(size for _, size, _ in files) // MOST_RANGES))
    ranges = [(k, path, at, min(at + split_bytes, size), kind) for k, (path, size, kind) in enumerate(files) if kind != "gzip" and not whole and size > split_bytes for at in range(0, size, split_bytes)]
    by_file: dict[int, list] = {}
    for r in counted(spark, ranges) if ranges else ():  # MOST_RANGES, and one more a file
        by_file.setdefault(r["k"], []).append(r)
    out = []
    for k, (path, _, kind) in enumerate(files):
        rows = by_file.get(k, ())
        if not rows or not all(r["whole"] for r in rows):
            out.append(FastqSplit(path, 0, -1, 0, k, "plain" if kind == "plain" else "gzip"))
            continue
        lines, broken = 0, False
        for r in rows:
            out.append(FastqSplit(path, r["start"], r["stop"], lines, k, kind, broken, lines + r["n"]))
            lines, broken = lines + r["n"], broken if r["ends"] is None else not r["ends"]
    return out


def _together(splits: list[FastqSplit], sizes: list[int], most: int) -> list[list[FastqSplit]]:
    """Neighbouring whole files in one partition, as many as ``most`` bytes allow."""
    groups: list[list[FastqSplit]] = []
    room = 0
    for s in splits:
        size = (sizes[s.file_no] if s.end < 0 else s.end - s.start) * (1 if s.kind == "plain" else PACKED)
        if groups and size <= room and s.end < 0:
            groups[-1].append(s)
            room -= size
        else:
            groups.append([s])
            room = most - size if s.end < 0 else 0
    return groups


def read_fastq(spark: SparkSession, paths: str | list[str], missing: str = "error", strict_tail: bool = True, split_bytes: int = SPLIT_BYTES, records: tuple[int, int | None] = (0, None), file_no: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Reads of one or several files, concatenated; the partitions are in the order of files and records. ``missing``: "error",
    or "skip" files that cannot be opened. ``records``: only those numbered from the one to below the other, in each file; of
    its first SEQUENTIAL reads a file is read without being counted. ``file_no`` adds the file's place among ``paths``: with rec_no it tells reads apart even where a file is given twice. ``columns``:
    only these are made."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if missing not in ("error", "skip"):
        raise ValueError("missing must be 'error' or 'skip'")
    wanted = [c for c in (*COLUMNS, *(["file_no"] if file_no else [])) if columns is None or c in columns or c == "file_no"]
    with ThreadPoolExecutor(LOOKING) as pool:
        looked = list(pool.map(_looked_at, paths))
    for path, x in zip(paths, looked):
        if x is None:
            if missing == "error":
                raise FileNotFoundError(f"{path} cannot be opened")
            print(f"skipped: {path} cannot be opened", file=sys.stderr)
    places = [k for k, x in enumerate(looked) if x is not None]
    none = spark.createDataFrame([], StructType([f for f in NUMBERED_SCHEMA.fields if f.name in wanted]))
    if not places:
        return none
    start, stop = records
    splits = plan_splits(spark, [(paths[k], *looked[k]) for k in places], split_bytes, whole=stop is not None and stop <= SEQUENTIAL)
    splits = [s for s in splits if s.holds(start, stop)]
    if not splits:
        return none
    groups = _together(splits, [looked[k][0] for k in places], split_bytes)
    for s in splits:
        s.file_no = places[s.file_no]
    return reads_of(spark, groups, strict_tail, wanted, records)


def reads_of(spark: SparkSession, groups: list[list[FastqSplit]], strict_tail: bool = True, columns: Sequence[str] = COLUMNS, records: tuple[int, int | None] = (0, None)) -> DataFrame:
    """The reads of planned splits, a partition for each group of them."""
    spark.createDataFrame([], "x int")  # makes the session this thread's own, in which Spark looks for sources
    spark.dataSource.register(FastqDataSource)
    plan = [[(s.path, s.start, s.end, s.lines, s.file_no, s.kind, s.broken, s.after) for s in g] for g in groups]
    reader = spark.read.format("fastq").option("strict_tail", str(strict_tail).lower()).option("columns", ",".join(columns))
    reader = reader.option("start", records[0]) if records[0] else reader
    reader = reader if records[1] is None else reader.option("stop", records[1])
    return reader.option("splits", json.dumps(plan)).load()
