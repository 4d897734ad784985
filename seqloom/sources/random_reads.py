"""Random reads for tests: the same for a seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cumulative shares of the bases in thousandths.
_BASES = (("A", 280), ("C", 490), ("G", 700), ("T", 900), ("N", 1000))


def _draw(seed: int, salt: str, at: Column, below: int) -> Column:
    """Below ``below``: the first 28 bits of a digest, alike in any engine."""
    digest = F.md5(F.concat_ws(".", F.lit(str(seed)), F.lit(salt), F.col("rec_no").cast("string"), at.cast("string")))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % below


def random_reads(spark: SparkSession, n: int, seed: int = 0, min_length: int = 100, max_length: int = 100, id_length: int = 50, source_file: str = "random.fastq") -> DataFrame:
    """``n`` reads: printable identifiers, bases by the shares above, qualities uniform over 64 bytes from '!'."""
    return random_reads_for(spark.range(n).withColumnRenamed("id", "rec_no"), seed, min_length, max_length, id_length, source_file)


def random_reads_for(numbers: DataFrame, seed: int = 0, min_length: int = 100, max_length: int = 100, id_length: int = 50, source_file: str = "random.fastq") -> DataFrame:
    """A random read for each ``rec_no`` of a table."""
    if not 0 <= min_length <= max_length:
        raise ValueError("lengths have to satisfy 0 <= min_length <= max_length")
    rows = numbers.select(F.lit(source_file).alias("source_file"), "rec_no")
    rows = rows.withColumn("n", (F.lit(min_length) + _draw(seed, "length", F.lit(0), max_length - min_length + 1)).cast("int"))

    def text(length: Column, letter) -> Column:
        places = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, letter), "")

    def base(i: Column) -> Column:
        x = _draw(seed, "seq", i, 1000)
        chosen = F.when(x < _BASES[0][1], _BASES[0][0])
        for letter, below in _BASES[1:]:
            chosen = chosen.when(x < below, letter)
        return chosen

    return rows.select(
        "source_file",
        "rec_no",
        text(F.lit(id_length), lambda i: F.chr(33 + _draw(seed, "id", i, 94))).alias("id1"),
        text(F.col("n"), base).alias("seq"),
        F.lit("").alias("id2"),
        text(F.col("n"), lambda i: F.chr(33 + _draw(seed, "qual", i, 64))).alias("qual"),
    )
