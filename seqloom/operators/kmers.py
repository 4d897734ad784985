"""k-mer histograms.

Up to k = 12 a task counts into a table of all k-mers and passes on what it has found. Beyond that reads
are cut into super-k-mers, runs of neighbouring windows that share a minimizer and so a bucket; these are dealt by
bucket, some two bytes a window, repeated ones once with their number, and a task counts the windows of its
buckets by sorting. No window is a row before it is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.kmer_codes import added, numbers_of, pieces, super_kmers
from seqloom.functions.sequences import packed_kmer
from seqloom.plans.shared import bound_batches

#: Above this the full table has too many empty rows to be worth writing, and a task's own table is too large.
DENSE_K = 12
#: Buckets of minimizers; super-k-mers that a task holds before it passes them on, and windows that it sorts together.
BUCKETS, HELD, SORTED = 4096, 1 << 22, 1 << 22


def _tabled(k: int):
    """Counts in a table of all k-mers, the one thing that a task holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(4**k, np.int64)
        for b in batches:
            for w in pieces(b.column(0), k):
                np.add.at(table, w.numbers(), 1)
        found = np.flatnonzero(table)
        for at in range(0, len(found), 1 << 18):
            some = found[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some])], ["rank", "frequency"])

    return count


def _dealt(k: int):
    """Rows (bucket, words, words that repeat, how often): one for each bucket whenever enough is held."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def passed_on() -> pa.RecordBatch:
            bucket, word = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((word, bucket))
            bucket, word = bucket[order], word[order]
            first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (bucket[1:] != bucket[:-1])]))
            times = np.diff(np.append(first, len(word)))
            bucket, word = bucket[first], word[first]
            cells = []
            for b, e in zip(starts := np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), np.append(starts[1:], len(bucket))):
                once = times[b:e] == 1
                cells.append((int(bucket[b]), word[b:e][once].tobytes(), word[b:e][~once].tobytes(), times[b:e][~once].astype("<i8").tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), kinds)], ["bucket", "once", "more", "times"])

        for b in batches:
            for w in pieces(b.column(0), k):
                held.append(super_kmers(w, BUCKETS))
                n += len(held[-1][0])
                if n >= HELD:
                    yield passed_on()
                    held, n = [], 0
        if n:
            yield passed_on()

    return deal


def _sorted(k: int):
    """Counts of a partition that is sorted by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, sums, held, n = None, None, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            parts = ([sums] if sums is not None else []) + held
            return added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

        def rows() -> Iterator[pa.RecordBatch]:
            number, times = merged()
            for at in range(0, len(number), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(number[at : at + (1 << 18)].astype(np.int64)), pa.array(times[at : at + (1 << 18)])], ["rank", "frequency"])

        for b in batches:
            for this, once, more, times in zip(*(b.column(c).to_pylist() for c in range(4))):
                if this != bucket:
                    if held or sums is not None:
                        yield from rows()
                    bucket, sums, held, n = this, None, [], 0
                words = np.frombuffer(once + more, "<u8")
                weight = np.concatenate([np.ones(len(once) // 8, np.int64), np.frombuffer(times, "<i8")])
                held.append(numbers_of(words, weight, k))
                n += len(held[-1][0])
                if n >= SORTED:
                    sums, held, n = merged(), [], 0
        if held or sums is not None:
            yield from rows()

    return count


def kmers(reads: DataFrame, k: int = 1, dense: bool | None = None) -> DataFrame:
    """(kmer, frequency, rank): windows of k bases A, C, G or T in either case, over all reads. ``rank`` is the packed
    number, the order of the command line's table (the first base varies fastest). ``dense`` adds k-mers that do not
    occur; by default up to k = 12. Null sequences have no window."""
    if not 1 <= k <= 16:
        raise ValueError("k has to be within 1 to 16")
    dense = k <= DENSE_K if dense is None else dense
    bound_batches(reads.sparkSession)
    some = reads.where(F.length("seq") >= k).select("seq")
    counts = "rank bigint, frequency bigint"
    if k <= DENSE_K:
        found = some.mapInArrow(_tabled(k), counts).groupBy("rank").agg(F.sum("frequency").alias("frequency"))
    else:
        runs = some.mapInArrow(_dealt(k), "bucket int, once binary, more binary, times binary")
        found = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sorted(k), counts)
    if not dense:
        return found.select(packed_kmer(F.col("rank"), k).alias("kmer"), "frequency", "rank")
    every = reads.sparkSession.range(4**k).select(packed_kmer(F.col("id"), k).alias("kmer"), F.col("id").alias("rank"))
    return every.join(found, "rank", "left").select("kmer", F.coalesce("frequency", F.lit(0)).cast("bigint").alias("frequency"), "rank")


def kmer_order(order: str = "packed") -> str:
    """The column to sort by: "packed" (the command line's order) or "lex"."""
    return {"packed": "rank", "lex": "kmer"}[order]
