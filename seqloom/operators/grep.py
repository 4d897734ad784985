"""Regular-expression selection, splitting, counting and trimming of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.patterns import Translation, translated

_SUBJECT = {"seq": "seq", "id": "id1"}


def _matches(pattern: str | None, on: str, case_sensitive: bool) -> tuple[Column, Translation]:
    if pattern is None:
        raise ValueError("a pattern is needed")
    if on not in _SUBJECT:
        raise ValueError("on must be 'seq' or 'id'")
    found = translated(pattern, case_sensitive)
    return F.col(_SUBJECT[on]).rlike(found.java), found


def grep(reads: DataFrame, pattern: str, on: str = "seq", invert: bool = False, trim_before: bool = False, trim_after: bool = False, trim_match: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Reads that match. ``trim_before`` keeps from the first match on, ``trim_after`` up to its end; ``trim_match`` drops
    the match as well. Sequence and quality are cut alike; identifiers stay."""
    if trim_before and trim_after:
        raise ValueError("trim_before and trim_after exclude each other")
    if (trim_before or trim_after) and on == "id":
        raise ValueError("only matches in the sequence can be trimmed")
    if (trim_before or trim_after) and invert:
        raise ValueError("reads without a match cannot be trimmed")
    hit, found = _matches(pattern, on, case_sensitive)
    out = reads.where(~hit if invert else hit)
    if not (trim_before or trim_after):
        return out
    at = F.regexp_instr("seq", F.lit(found.java)) - 1  # an empty match counts as well
    end = at + F.length(F.regexp_extract("seq", found.java, 0))
    for group in found.keeps:  # what \\K leaves out of the match
        at = at + F.length(F.regexp_extract("seq", found.java, group))
    if trim_before:
        start = end if trim_match else at
        cut = lambda c: F.substr(F.col(c), start + 1)
    else:
        stop = at if trim_match else end
        cut = lambda c: F.left(F.col(c), stop)
    return out.withColumns({"seq": cut("seq"), "qual": cut("qual")}).select(*reads.columns)


def grep_split(reads: DataFrame, pattern: str, on: str = "seq", invert: bool = False, case_sensitive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(selected, the rest)."""
    hit, _ = _matches(pattern, on, case_sensitive)
    return (reads.where(~hit), reads.where(hit)) if invert else (reads.where(hit), reads.where(~hit))


def grep_count(reads: DataFrame, pattern: str, on: str = "seq", invert: bool = False, case_sensitive: bool = False, files: DataFrame | None = None) -> DataFrame:
    """Selected reads by source_file. ``files`` (source_file) adds files without any read."""
    hit, _ = _matches(pattern, on, case_sensitive)
    counts = reads.groupBy("source_file").agg(F.count_if(~hit if invert else hit).alias("n"))
    if files is None:
        return counts
    return files.join(counts, "source_file", "left").select("source_file", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
