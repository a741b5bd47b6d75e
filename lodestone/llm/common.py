"""Helpers that all training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.storage import clear, delete_path, fresh_path, made, materialise, shared_dir

__all__ = ["BATCH_ROWS", "WORD", "bound_batches", "clear", "delete_path", "fresh_path", "made", "materialise", "read_table", "shared_dir", "text_or_empty", "tokenizer_path"]

#: Texts may be long, so Arrow batches are shorter than Spark's 10,000 rows.
BATCH_ROWS = 1000
#: A word, as all contracts of this subpackage define it.
WORD = r"[^\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession) -> None:
    """Hand Python workers at most BATCH_ROWS whole texts at once; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
