"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.plans.shared import checkpointed

#: Bits of a row's place within its partition in monotonically_increasing_id().
_PLACE = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 0-based position in ``order``. The rows are sorted by ranges of all order columns, as many as adaptive
    execution finds fit, and written down; a row's place in its partition is moved by the rows of the partitions before.
    Rows that agree in some of the columns are dealt by the others."""
    placed = checkpointed(df.orderBy(*order)).withColumn("__id", F.monotonically_increasing_id())
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit(_PLACE))
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    ahead, total = [], 0
    for k, n in sizes:
        ahead.append((k, total))
        total += n
    before = df.sparkSession.createDataFrame(ahead, "__part bigint, __ahead bigint")
    return placed.join(F.broadcast(before), part == F.col("__part")).withColumn(name, place + F.col("__ahead")).drop("__id", "__part", "__ahead")
