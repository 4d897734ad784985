"""Schema and constants of the read model."""

from __future__ import annotations

from pyspark.sql import types as T

READ_SCHEMA = T.StructType(
    [
        T.StructField("source_file", T.StringType(), False),
        T.StructField("rec_no", T.LongType(), False),
        T.StructField("id1", T.StringType(), False),
        T.StructField("seq", T.StringType(), False),
        T.StructField("id2", T.StringType(), False),
        T.StructField("qual", T.StringType(), False),
    ]
)

#: With the file's place among those that are read.
NUMBERED_SCHEMA = T.StructType([*READ_SCHEMA.fields, T.StructField("file_no", T.IntegerType(), False)])

#: Fixed values. Quality scales by priority: description, lowest and highest byte.
SCALES = (
    ("Sanger/Phred+33", 33, 73),
    ("Illumina 1.8/Phred+33", 33, 74),
    ("Illumina 1.5/Phred+64", 66, 104),
    ("Illumina 1.3/Phred+64", 64, 104),
    ("Solexa/Solexa+64", 59, 104),
)
#: Fixed values. Reads that scale detection looks at in a file, at most; default sample size and seed.
SCALE_READS, SAMPLE_READS, SAMPLE_SEED = 100_000, 10_000, 4357
#: Fixed values. Alignment scores: match, mismatch, anything with N; first base of a gap, each further one.
MATCH, MISMATCH, WITH_N, GAP_OPEN, GAP_EXTEND = 1, -2, 0, -4, -3
