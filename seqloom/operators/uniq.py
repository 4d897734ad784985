"""Duplicate collapsing with copy counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ranking import global_rank


def uniq(reads: DataFrame) -> DataFrame:
    """(seq, copies) of the distinct sequences of all files; case counts, identifiers and qualities do not."""
    return reads.groupBy("seq").agg(F.count("*").alias("copies"))


def uniq_ranked(reads: DataFrame) -> DataFrame:
    """(seq, copies, n): ``n`` from 0, most copies first, equal ones by sequence."""
    return global_rank(uniq(reads), [F.desc("copies"), F.asc("seq")], "n")


def uniq_fasta(reads: DataFrame) -> DataFrame:
    """(n, value): FASTA records, without their final newline."""
    number = F.when(F.length(F.col("n").cast("string")) < 7, F.lpad(F.col("n").cast("string"), 7, "0")).otherwise(F.col("n").cast("string"))
    header = F.concat(F.lit(">unique-read-"), number, F.lit(" ("), F.col("copies").cast("string"), F.lit(" copies)\n"), F.col("seq"))
    return uniq_ranked(reads).select("n", header.alias("value"))
