"""The corpus pipeline: language ID, quality rules, near-duplicate removal, redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of their input, whatever other columns it has and however these are named, and an empty input gives an
empty result. Texts of any length are read whole by every stage. Models are fitted within a stage: language ID on what it is given, the quality rules on the
labels of the input folder that belong to documents they are given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import langid, pii, quality, simhash
from seqloom.llm.common import stage_table, temporary_tables
from seqloom.llm.packing import Packer
from seqloom.plans.deploy import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letters, or a probability below the calibrated threshold. A null, empty or
    unlettered text goes; without any ``lang`` to learn from every document with a letter stays; null keys and repeated rows
    stay or go by their text alone."""
    ship(spark)
    return langid.drop_unidentified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that the trees reject go. A null or empty text fails the base rule; without labels
    of both kinds the base rule decides alone; of a document's labels that disagree each counts; labels without a key or a
    quality are not learned from; repeated rows are judged alike."""
    ship(spark)
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; one without a key only if no other has one. All null,
    empty and blank texts are one group; of repeated rows one stays. The groups are those of op5's contract: words in shingles
    of three, fingerprints within two bits."""
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind. Every row stays; null and empty texts stay as they are."""
    return pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces. A null or empty text is one piece, the end id; rows without a key and repeated rows are packed like
    any other."""
    ship(spark)
    return Packer(spark, public_tokenizers.path("byte_bpe_50k.json")).pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Fitted classifiers and tokens have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again. The tables a stage makes
    for itself, and the stage's input, are deleted once its result is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with temporary_tables(spark) as paths:
            docs = stage_table(stage(spark, docs, sf_dir), name)
            result = paths.pop()
            paths += last
        last = [result]
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
