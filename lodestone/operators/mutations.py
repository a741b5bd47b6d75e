"""Catalogs changed by ordered logs.

A change is (seq, op, target, name, path, type, size, mod_time): ADD puts a record, UPDATE replaces the one at
``target`` by the record, whose own path may be another, and REMOVE takes the one at ``target`` away. A record's key is
its full path in lower case. The last change of a key wins; of one seq, what it puts wins over what it removes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.catalog import records, renumbered
from lodestone.functions import text

RECORD = ["name", "path", "type", "size", "mod_time"]


def key_of(path: str = "path", name: str = "name"):
    return F.lower(text.full_path(F.col(path), F.col(name)))


def effects(changes: DataFrame) -> DataFrame:
    """(key, seq, put, record) of each change: what it removes and what it puts."""
    record = F.struct(*RECORD)
    puts = F.col("op").isin("ADD", "UPDATE")
    removal = F.struct(F.lower("target").alias("key"), F.lit(0).alias("put"))
    addition = F.struct(key_of().alias("key"), F.lit(1).alias("put"))
    both = F.filter(F.array(F.when(F.col("op").isin("REMOVE", "UPDATE"), removal), F.when(puts, addition)), lambda e: e.isNotNull())
    return changes.select("seq", record.alias("record"), F.explode(both).alias("e")).select("e.key", "seq", "e.put", "record")


def winners(changes: DataFrame) -> DataFrame:
    """The last effect of each key: one shuffle, and its partial maximum keeps a hot key to a row a task."""
    last = F.max_by(F.struct("put", "seq", "record"), F.struct("seq", "put"))
    return effects(changes).groupBy("key").agg(last.alias("w")).select("key", "w.*")


def apply(files: DataFrame, changes: DataFrame, first_id: int = 0) -> DataFrame:
    """Records after the changes; those put have id first_id + seq."""
    won = winners(changes)
    untouched = records(files).withColumn("key", key_of()).join(won.select("key"), "key", "left_anti").drop("key")
    put = won.filter("put = 1").select((F.col("seq") + first_id).alias("file_id"), "record.*")
    return untouched.unionByName(records(put))


def remove_prefix(files: DataFrame, prefix: str) -> DataFrame:
    return files.filter(~text.within(text.full_path(F.col("path"), F.col("name")), prefix))


def rescan_prefix(files: DataFrame, prefix: str, fresh: DataFrame) -> DataFrame:
    """The subtree replaced by what a scan of it found."""
    return records(remove_prefix(files, prefix)).unionByName(records(fresh))


def compact(files: DataFrame, contents: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Live records, the last of each path, with ids renumbered in order; contents (file_id, ...) follow."""
    from lodestone.catalog import latest

    live = latest(records(files).filter("type <> 0"))
    ids = renumbered(live)
    moved = live.withColumnRenamed("file_id", "old_id").join(ids, "old_id")
    followed = contents.withColumnRenamed("file_id", "old_id").join(ids, "old_id").drop("old_id") if contents is not None else None
    return records(moved), followed


def renamed_from(events: DataFrame, files: DataFrame) -> DataFrame:
    """Earlier full paths of files that an event saw elsewhere: same inode and device, another path."""
    old = files.select("inode", "dev_id", text.full_path(F.col("path"), F.col("name")).alias("old_path")).filter("inode <> 0")
    return events.select("inode", "dev_id", "full_path").join(old, ["inode", "dev_id"]).filter(F.lower("full_path") != F.lower("old_path"))


def difference(old: DataFrame, new: DataFrame, first_seq: int = 0) -> DataFrame:
    """Changes that turn the one set of records into the other: UPDATE of what is new or differs, REMOVE of what is gone.
    They touch different keys, so they may all have one seq."""
    side = lambda df, s: df.select(key_of().alias("key"), *(F.col(c).alias(f"{c}_{s}") for c in RECORD))
    both = side(old, "old").join(side(new, "new"), "key", "full")
    same = F.lit(True)
    for c in RECORD:
        same &= F.col(f"{c}_old").eqNullSafe(F.col(f"{c}_new"))
    gone = F.col("path_new").isNull()
    of = lambda c: F.when(gone, F.col(f"{c}_old")).otherwise(F.col(f"{c}_new")).alias(c)
    target = text.full_path(F.coalesce("path_old", "path_new"), F.coalesce("name_old", "name_new")).alias("target")
    return both.filter(~same).select(F.lit(first_seq).cast("long").alias("seq"), F.when(gone, "REMOVE").otherwise("UPDATE").alias("op"), target, *(of(c) for c in RECORD))


def minimal_paths(paths: DataFrame) -> DataFrame:
    """Paths that no other path of the set covers; a path's ancestors are few, so they are joined by equality."""
    own = paths.filter("path <> ''").select(F.when(F.col("path") == "/", "/").otherwise(F.rtrim("path", F.lit("/"))).alias("path")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.when(i == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    ancestors = own.filter("path <> '/'").select(F.col("path").alias("below"), F.explode(above).alias("path"))
    covered = ancestors.join(own, "path", "left_semi").select(F.col("below").alias("path")).distinct()
    return own.join(covered, "path", "left_anti")
