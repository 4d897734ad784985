"""The reads that queries run on, derived from ``events`` by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READS_SQL = """
SELECT event_id AS rec_no,
       event_type || '.fastq' AS source_file,
       'read.' || event_id || ' ' || event_type AS id1,
       substr(translate(md5('s' || (user_id % 97) || '.' || (event_id % 7)) || md5('t' || (user_id % 97)),
                        '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, CAST(24 + (user_id % 5) * 8 AS INT)) AS seq,
       '' AS id2,
       substr(translate(md5('q' || event_id) || md5('r' || event_id), '0123456789abcdef',
                        CASE event_type WHEN 'click' THEN 'BEHJMPSUWY[]`ceh'
                                        WHEN 'error' THEN '@CFILORUX[^adfgh'
                                        WHEN 'view' THEN ';=@CGKOSW[^`cegh'
                                        ELSE '#&),/258;>ADFGHI' END),
              1, CAST(24 + (user_id % 5) * 8 AS INT)) AS qual
FROM events
"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id")
    cores = spark.sparkContext.defaultParallelism
    if events.rdd.getNumPartitions() < cores:  # a small file is one task; large inputs are left as they are read
        events = events.repartition(cores)
    return spark.sql(READS_SQL.replace("FROM events", "FROM {events}"), events=events).select("source_file", "rec_no", "id1", "seq", "id2", "qual")
