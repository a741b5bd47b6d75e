"""From raw documents to encoded training rows: filter, deduplicate, mix and encode.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns documents' columns; the
last returns the encoded rows. All stages take columns in any order and leave others out; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, ordinal, pieces, similar_texts, suffix_array
from lodestone.llm.common import clear, made, materialise, read_table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the ordinal classifier selects: documents that are likely of the top grade.

    Null and empty texts are graded like texts of no words. A document at the cut stays; repeated rows fare alike; a null
    doc_id has no label but is graded. Texts are graded as wholes, however long.
    """
    model = ordinal.train(docs, ordinal.graded(read_table(spark, sf_dir, "labels")))
    return ordinal.classify(docs, model).filter("selected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group at a similarity of 0.8 or more on five-word shingles.

    Null and empty texts are one group. Of a group the smallest doc_id stays, null only if there is no other; of rows that
    share doc_id and text one stays, so ties and repeated rows are settled.
    """
    return similar_texts.keep_one(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every repeated passage of 200 bytes or more out of the texts; characters that a cut splits go with it.

    A null text stays null, and what has fewer bytes stays as it is. Texts that are repeated as wholes become empty, each
    of them, as every occurrence goes. All rows stay, whatever their doc_ids.
    """
    cut = suffix_array.deduplicate(docs.select(*COLUMNS))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(suffix_array.whole_characters("kept"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take words of each source up to its target; a document stands once for each time that it is read.

    Null texts and texts without words aren't taken. A null source is a source; null and repeated doc_ids are documents
    of their own, and rows of one doc_id, source and size are interchangeable.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text; null and empty texts have none. Every row, whatever its doc_id, is encoded."""
    return pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("encode", encode)]

#: No stage but the mix can be said in SQL; tests hold each against brute force or the model's own sums.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage and the one before it have
    put there besides goes as soon as its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    since = made()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        clear(spark, since, -1)
    return STAGES[-1][1](spark, docs, sf_dir)
