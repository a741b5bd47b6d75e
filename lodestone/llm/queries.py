"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import licences, mixing, multi_index, ordinal, pieces, quotations, simhash, suffix_array, token_counts, transport_stream
from lodestone.llm.common import read_table, tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licences", " ").alias("licences"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = transport_stream.store(read_table(spark, sf_dir, "documents"))
    return transport_stream.read(media)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.train(docs, ordinal.graded(read_table(spark, sf_dir, "labels")))
    return ordinal.classify(docs, model).drop("text")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.removed_bytes(read_table(spark, sf_dir, "documents"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.conversations(read_table(spark, sf_dir, "conversations"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = (
        op1_license_scans, op2_token_counts, op3_media_columns, op4_quality_classifier, op5_nearest_neighbours, op6_sentencepiece,
        op7_simhash, op8_suffix_array, op9_quotation_linking, op10_mixing, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scans": licences.oracle(), "op10_mixing": mixing.oracle()}
