"""Sorting of reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.hashing import RECORD_SEED, record_hash
from seqloom.functions.sequences import gc_fraction, mean_quality, natural_key
from seqloom.operators.ranking import global_rank

KEYS = ("id", "natural", "seq", "random", "gc", "mean_qual")


def sort_keys(by: str, seed: int | None = None, exact: bool = False) -> list[Column]:
    """Key columns. "random" orders by a digest of seed and whole record, alike in any engine, so that equal records end up
    together; ``exact`` takes the command line's own hash."""
    if by not in KEYS:
        raise ValueError(f"by must be one of {', '.join(KEYS)}")
    if by == "random":
        if exact:
            return [record_hash(RECORD_SEED if seed is None else seed)]
        return [F.md5(F.concat_ws("\n", F.lit(str(RECORD_SEED if seed is None else seed)), "id1", "seq", "id2", "qual"))]
    return {
        "id": lambda: [F.col("id1")],
        "natural": lambda: [natural_key("id1"), F.length("id1")],
        "seq": lambda: [F.col("seq")],
        "gc": lambda: [gc_fraction("seq")],
        "mean_qual": lambda: [mean_quality("qual")],
    }[by]()


def _ties(reads: DataFrame | None = None) -> list[Column]:
    numbered = reads is not None and "file_no" in reads.columns
    return [F.asc("file_no" if numbered else "source_file"), F.asc("rec_no")]


def sort_order(by: str, reverse: bool = False, seed: int | None = None, exact: bool = False) -> list[Column]:
    """Keys with direction; file and record number settle ties."""
    keys = sort_keys(by, seed, exact)
    return [k.desc() if reverse else k.asc() for k in keys] + _ties()


def sort_reads(reads: DataFrame, by: str = "id", reverse: bool = False, seed: int | None = None, exact: bool = False) -> DataFrame:
    """Globally sorted reads: keys are computed once, rows are dealt by ranges of keys, file and record number, and sorted
    with spill. Files count in their given order where ``reads`` has a ``file_no``, else by name."""
    names = [f"__key{k}" for k in range(len(sort_keys(by, seed, exact)))]
    keyed = reads.withColumns(dict(zip(names, sort_keys(by, seed, exact))))
    order = [F.desc(n) if reverse else F.asc(n) for n in names] + _ties(reads)
    return keyed.orderBy(*order).drop(*names)


def sort_positions(reads: DataFrame, by: str = "id", reverse: bool = False, seed: int | None = None, name: str = "position", columns: Sequence[str] | None = None) -> DataFrame:
    """The reads with their 0-based position in that order; of ``columns`` only, so that no others are sorted and written."""
    names = [f"__key{k}" for k in range(len(sort_keys(by, seed)))]
    wanted = list(columns or reads.columns)
    ties = [c for c in ("file_no" if "file_no" in reads.columns else "source_file", "rec_no") if c not in wanted]
    keyed = reads.select(*wanted, *ties, *[k.alias(n) for n, k in zip(names, sort_keys(by, seed))])
    ranked = global_rank(keyed, [F.desc(n) if reverse else F.asc(n) for n in names] + _ties(reads), name)
    return ranked.select(*wanted, name)
