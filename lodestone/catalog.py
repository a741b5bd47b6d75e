"""The catalog: a DataFrame of file records, with the columns that queries need derived once.

``name_lc``, ``path_lc`` and ``match_path_lc`` are stored, not computed at query time, so that substring conditions on
them reach the Parquet reader; ``ext`` and ``depth`` likewise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text

RECORD = T.StructType(
    [
        T.StructField("file_id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("type", T.IntegerType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("mod_time", T.LongType(), False),
        T.StructField("inode", T.LongType(), False),
        T.StructField("dev_id", T.IntegerType(), False),
    ]
)


def records(df: DataFrame) -> DataFrame:
    """df's record columns with their types; without inode and dev_id, 0."""
    own = set(df.columns)
    return df.select([(F.col(f.name) if f.name in own else F.lit(0)).cast(f.dataType).alias(f.name) for f in RECORD])


def derive(df: DataFrame, initials: bool = False) -> DataFrame:
    """Live records with derived columns. ``initials``: with the key of Mandarin initials, which changes results."""
    base = records(df).filter("type <> 0")
    base = base.withColumns({"name_lc": F.lower("name"), "path_lc": F.lower("path")})
    base = base.withColumns({"match_path_lc": F.concat("path_lc", F.lit("/"), "name_lc"), "ext": text.extension(F.col("name")), "depth": text.depth(F.col("path"))})
    return base.withColumn("initials", text.initials(F.col("name"))) if initials else base


def by_id() -> list[Column]:
    """The order of file_ids, which are unsigned numbers of 64 bits: negative ones are the largest."""
    return [F.col("file_id") < 0, F.col("file_id")]


def latest(df: DataFrame) -> DataFrame:
    """Bulk load: of records with the same full path, whatever its case, the one of the largest file_id."""
    key = F.lower(text.full_path(F.col("path"), F.col("name")))
    newest = df.withColumn("_key", key).groupBy("_key").agg(F.max_by(F.struct(*df.columns), F.struct(*by_id())).alias("r"))
    return newest.select("r.*")


def renumbered(df: DataFrame) -> DataFrame:
    """Compaction: (old_id, file_id) with ids from 0 in the old order, numbered by ranges so that no task sorts all rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(F.col("file_id").alias("old_id")).repartitionByRange(parts, "old_id").withColumn("part", F.spark_partition_id())
    counts = ranged.groupBy("part").count()  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("part").orderBy("old_id")
    return ranged.withColumn("n", F.row_number().over(own) - 1).join(offsets, "part").select("old_id", (F.col("offset") + F.col("n")).cast("long").alias("file_id"))


def save(df: DataFrame, target: str) -> None:
    """Write a catalog in ranges of paths, so that Parquet's statistics prune by path. It is written beside the target and
    takes its place when it is whole, so the target may be what df reads, and a failure leaves it as it was."""
    write_swapped(df.repartitionByRange("path_lc", "name_lc").sortWithinPartitions("path_lc", "name_lc"), target)


def write_swapped(df: DataFrame, target: str) -> None:
    """Parquet at target by way of a staging folder and a rename."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = lambda suffix: jvm.org.apache.hadoop.fs.Path(target.rstrip("/") + suffix)
    fs, tag = at("").getFileSystem(conf), uuid.uuid4().hex
    df.write.parquet(at(f".new-{tag}").toString())
    if fs.exists(at("")):
        fs.rename(at(""), at(f".old-{tag}"))
    if not fs.rename(at(f".new-{tag}"), at("")):
        raise OSError(f"can't move the new table to {target}")
    fs.delete(at(f".old-{tag}"), True)
