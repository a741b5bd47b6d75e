"""Token counts through a digest cache.

The cache is a Parquet table (text_digest, tokenizer_digest, n_tokens) that is only ever appended to. Texts are
normalised (null becomes empty; nothing else may change, as it would change the counts), digested with SHA-256 in the
JVM and joined with the cache's rows of this tokenizer; only distinct misses are shuffled with their text, encoded
and appended. Two runs that race may append a digest twice; reading takes one row for each.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows and repeated texts each return a row. Texts are
encoded one at a time, so a batch's memory is bounded by its texts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bound_batches, fresh_path, text_or_empty

CACHE = T.StructType([T.StructField("text_digest", T.BinaryType()), T.StructField("tokenizer_digest", T.StringType()), T.StructField("n_tokens", T.LongType())])


@functools.cache
def load(path: str):
    """A function from texts to their numbers of tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(path)
    one.no_truncation()
    one.no_padding()
    return lambda texts: [len(one.encode(x, add_special_tokens=False).ids) for x in texts]


def tokenizer_digest(path: str) -> str:
    """Of the tokenizer's file and the library's version: either may change counts."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(Path(path).read_bytes() + f"\0{library.__name__} {library.__version__}".encode()).hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows, none where it doesn't exist yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)


def fill_cache(docs: DataFrame, tokenizer: str, cache: str, text: str = "text") -> DataFrame:
    """Encode the distinct texts that the cache lacks, append them, and return the cache's rows of this tokenizer."""
    spark, digest = docs.sparkSession, tokenizer_digest(tokenizer)
    bound_batches(spark)
    known = read_cache(spark, cache).filter(F.col("tokenizer_digest") == digest).select("text_digest")
    keyed = docs.select(F.unhex(F.sha2(text_or_empty(text), 256)).alias("text_digest"), text_or_empty(text).alias("text"))
    misses = keyed.join(known, "text_digest", "left_anti").dropDuplicates(["text_digest"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(tokenizer)
        for b in batches:
            n = count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("text_digest"), pa.array([digest] * len(n), pa.string()), pa.array(n, pa.int64())], ["text_digest", "tokenizer_digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    return spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer_digest") == digest).groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int, cache: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; without ``cache``, through a new one."""
    counts = fill_cache(docs, tokenizer, cache or fresh_path(docs.sparkSession, "token_cache"), text)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), F.unhex(F.sha2(text_or_empty(text), 256)).alias("text_digest"))
    return keyed.join(counts, "text_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
