"""Quality tables, shifts and scale detection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.letters import latin1_bytes
from seqloom.functions.sequences import shift_quality
from seqloom.plans.shared import bound_batches, checkpointed
from seqloom.schema import SCALE_READS, SCALES

LAST_BYTE = 254
#: Positions of a block, blocks that a task counts at once, letters that it looks at together.
POSITIONS, BLOCKS, PIECE = 512, 32, 1 << 20


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by blocks of positions, each a table (position, byte); they are passed on when there are too many."""
    tables: dict[int, np.ndarray] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for block, table in sorted(tables.items()):
            pos, qual = np.nonzero(table)
            columns = [pa.array((pos + block * POSITIONS).astype(np.int32)), pa.array(qual.astype(np.int32)), pa.array(table[pos, qual])]
            yield pa.RecordBatch.from_arrays(columns, ["pos", "qual", "n"])
        tables.clear()

    for b in batches:
        data, starts = latin1_bytes(b.column(0))
        lengths = np.diff(np.append(starts, len(data)))
        filled = np.flatnonzero(lengths)
        for at in range(0, len(data), PIECE):
            part = data[at : at + PIECE]
            lo, hi = int(np.searchsorted(starts[filled], at, side="right")) - 1, int(np.searchsorted(starts[filled], at + len(part)))
            begins = starts[filled][lo:hi]
            pos = np.arange(at, at + len(part)) - np.repeat(begins, np.diff(np.append(np.maximum(begins, at), at + len(part))))
            block = pos // POSITIONS
            for k in np.unique(block):
                here = block == k
                cells = (pos[here] - k * POSITIONS) * 256 + part[here]
                table = tables.setdefault(int(k), np.zeros((POSITIONS, 256), np.int64))
                table += np.bincount(cells, minlength=POSITIONS * 256).reshape(POSITIONS, 256)
            if len(tables) > BLOCKS:
                yield from passed_on()
    yield from passed_on()


def _counts(reads: DataFrame) -> DataFrame:
    bound_batches(reads.sparkSession)
    found = reads.where(F.length("qual") > 0).select("qual").mapInArrow(_tally, "pos int, qual int, n bigint")
    return found.where(F.col("qual") <= LAST_BYTE).groupBy("pos", "qual").agg(F.sum("n").alias("n"))


def _grid(reads: DataFrame) -> DataFrame:
    """All pairs of a position, to the longest read's, and a byte."""
    longest = reads.agg(F.max(F.length("qual")).alias("m")).first()["m"] or 0
    pair = reads.sparkSession.range(longest * (LAST_BYTE + 1))
    return pair.select(F.expr(f"CAST(id DIV {LAST_BYTE + 1} AS INT)").alias("pos"), (F.col("id") % (LAST_BYTE + 1)).cast("int").alias("qual"))


def qual_table(reads: DataFrame, dense: bool = False) -> DataFrame:
    """(pos, qual, n): reads with quality byte ``qual`` at 0-based position ``pos``. ``dense`` adds the pairs that do not
    occur, for all bytes to 254 and all positions to the longest read's."""
    counts = _counts(reads)
    if not dense:
        return counts
    return _grid(reads).join(counts, ["pos", "qual"], "left").select("pos", "qual", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def qual_lines(reads: DataFrame) -> DataFrame:
    """(qual, value): for each byte its counts by position, tab-separated: the command line's table. Lines are put together from
    blocks of positions."""
    joined = lambda cells: F.array_join(F.transform(F.sort_array(F.collect_list(cells)), lambda c: c["text"]), "\t")
    blocks = qual_table(reads, dense=True).withColumn("block", F.expr(f"pos DIV {POSITIONS}"))
    pieces = blocks.groupBy("qual", "block").agg(joined(F.struct("pos", F.col("n").cast("string").alias("text"))).alias("text"))
    return pieces.groupBy("qual").agg(joined(F.struct("block", "text")).alias("value"))


def qual_adjust(reads: DataFrame, offset: int) -> DataFrame:
    return reads.withColumn("qual", shift_quality("qual", offset)).select(*reads.columns)


def _compatible(lo, hi):
    """Bit set of the scales that hold all bytes from lo to hi, the first scale lowest."""
    bits = [F.when((F.lit(a) <= lo) & (F.lit(b) >= hi), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, a, b) in enumerate(SCALES)]
    return reduce(lambda x, y: x + y, bits)


def first_reads(reads: DataFrame, limit: int, bins: int = 1024, rounds: int = 2) -> DataFrame:
    """Reads among which are each file's ``limit`` first ones by rec_no, and few more: histograms of rec_no, each of the bin
    of the one before that holds the last wanted read, find a rec_no behind which none is. Only the files with more reads
    are looked at twice, and only their numbers are read."""
    slim = reads.select("source_file", "rec_no")
    wide = slim.groupBy("source_file").agg(F.count("*").alias("n"), F.min("rec_no").alias("lo"), F.max("rec_no").alias("hi")).where(F.col("n") > limit)
    wide = checkpointed(wide.select("source_file", "lo", "hi", F.lit(limit).cast("bigint").alias("left")))
    if wide.isEmpty():
        return reads
    for _ in range(rounds):
        size = F.floor((F.col("hi") - F.col("lo")) / bins) + 1
        binned = slim.join(wide, "source_file").where("rec_no BETWEEN lo AND hi").withColumn("bin", F.floor((F.col("rec_no") - F.col("lo")) / size))
        counted = binned.groupBy("source_file", "lo", "hi", "left", "bin").agg(F.count("*").alias("n"))  # `bins` rows a file
        so_far = F.sum("n").over(Window.partitionBy("source_file").orderBy("bin"))
        last = counted.withColumn("so_far", so_far).where("so_far >= left AND so_far - n < left")
        lo = F.col("lo") + F.col("bin") * size
        wide = checkpointed(last.select("source_file", lo.alias("lo"), F.least("hi", lo + size - 1).alias("hi"), (F.col("left") - F.col("so_far") + F.col("n")).alias("left")))
    return reads.join(wide.select("source_file", F.col("hi").alias("__last")), "source_file", "left").where("__last IS NULL OR rec_no <= __last").drop("__last")


def _ranges(reads: DataFrame) -> DataFrame:
    """(source_file, lo, hi, first, n): the ranges of bytes that single reads have, the first read of each, and how many
    have it. At most some thousand rows a file, whatever its size, and added up in any order."""
    letters = F.split("qual", "")
    full = F.length("qual") > 0
    lo, hi = F.when(full, F.ascii(F.array_min(letters))).otherwise(126), F.when(full, F.ascii(F.array_max(letters))).otherwise(33)
    return reads.select("source_file", "rec_no", lo.alias("lo"), hi.alias("hi")).groupBy("source_file", "lo", "hi").agg(F.min("rec_no").alias("first"), F.count("*").alias("n"))


def _detected(ranges: DataFrame) -> DataFrame:
    """A scale goes with the first read that it does not hold; the file's range stops growing at the read with which all but one
    have gone."""
    files = ranges.groupBy("source_file").agg(F.collect_list(F.struct("lo", "hi", "first")).alias("x"))
    outside = lambda a, b: lambda r: (r["lo"] < a) | (r["hi"] > b)
    gone = [F.array_min(F.transform(F.filter("x", outside(a, b)), lambda r: r["first"])) for _, a, b in SCALES]
    files = files.withColumn("stop", F.get(F.array_sort(F.array_compact(F.array(*gone))), F.lit(len(SCALES) - 2)))
    files = files.withColumn("x", F.filter("x", lambda r: F.col("stop").isNull() | (r["first"] <= F.col("stop"))))
    # An empty file's range starts from the widest compatible one.
    lo, hi = F.least(F.lit(126), F.array_min(F.transform("x", lambda r: r["lo"]))), F.greatest(F.lit(33), F.array_max(F.transform("x", lambda r: r["hi"])))
    return files.select("source_file", lo.alias("lo"), hi.alias("hi"))


def detect_scale(reads: DataFrame, limit: int = SCALE_READS, numbered: bool = True) -> DataFrame:
    """(source_file, lo, hi, scale): the range of bytes grows read by read and stops at the first read after which at most
    one scale remains, or after ``limit`` reads; the scale is the first that remains, or null. Files without reads have no
    row. One pass, in which each file becomes a small table of ranges and their first reads. ``numbered``: rec_no counts from 0 within each
    file, as from the source, so that a filter takes the first reads; else files with more
    reads than ``limit`` are looked at again, and histograms of their rec_no find the first ones."""
    if numbered:
        found = _detected(_ranges(reads.where(F.col("rec_no") < limit)))
    else:
        ranges = checkpointed(_ranges(reads))
        size = Window.partitionBy("source_file")
        ranges = ranges.withColumn("all", F.sum("n").over(size))  # of some thousand rows
        wide = ranges.where(F.col("all") > limit)
        found = _detected(ranges.where(F.col("all") <= limit))
        if not wide.isEmpty():
            again = reads.join(wide.select("source_file").distinct(), "source_file", "left_semi")
            nth = F.row_number().over(Window.partitionBy("source_file").orderBy("rec_no"))
            some = first_reads(again, limit).withColumn("nth", nth).where(F.col("nth") <= limit)
            found = found.unionByName(_detected(_ranges(some)))
    set_ = found.withColumn("bits", _compatible(F.col("lo"), F.col("hi")))
    names = F.coalesce(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) != 0, F.lit(name)) for k, (name, _, _) in enumerate(SCALES)])
    return set_.select("source_file", "lo", "hi", names.alias("scale"))


def scale_lines(detected: DataFrame) -> DataFrame:
    """The line printed for each file."""
    unknown = F.concat(F.lit("Unknown scale ['"), F.chr(F.col("lo")), F.lit("', '"), F.chr(F.col("hi")), F.lit("']"))
    return detected.select("source_file", F.concat_ws(": ", "source_file", F.coalesce("scale", unknown)).alias("value"))
