"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bitslice, blockmax, brown, langid, licenses, minmax, ordinal, pii, quality, yinyang
from seqloom.llm.bpe import BpeCodec
from seqloom.llm.common import documents
from seqloom.llm.license_sql import license_scan_sql
from seqloom.llm.packing import Packer
from seqloom.llm.simhash import hexadecimal, near_duplicates


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_brown_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(documents(spark, sf_dir))
    return groups.select("doc_id", hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = {k})) AS BIGINT)").alias(f"n_{name}") for k, name in enumerate(pii.BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Packer(spark, public_tokenizers.path("byte_bpe_50k.json")).pack(documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.rate(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = bitslice.build_index(vectors, "vec_id", "embedding")
    return bitslice.search(index, vectors.where(F.col("vec_id") % bitslice.EVERY == 0), "vec_id", "embedding")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = BpeCodec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return documents(spark, sf_dir).select("doc_id", codec.digest(codec.encode(F.col("text"))).alias("r")).select("doc_id", "r.*")


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.search(blockmax.build_index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = yinyang.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if coded is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    rows = yinyang.with_label_error(coded.rows)
    return rows.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(yinyang.digest(coded.codebooks)).alias("codebooks_sha256"))


def op13_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(documents(spark, sf_dir))


OP9 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id,
           list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
"""


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_brown_ngrams,
        op2_quality_rules,
        op3_license_scan,
        op4_language_id,
        op5_simhash_near_dedup,
        op6_personal_data,
        op7_best_fit_packing,
        op8_quality_classifier,
        op9_exact_top_k,
        op10_byte_bpe,
        op11_block_max_search,
        op12_vector_codes,
        op13_minmax_near_dedup,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": license_scan_sql(), "op9_exact_top_k": OP9, "op11_block_max_search": blockmax.search_sql(), "op12_vector_codes": yinyang.codes_sql()}
