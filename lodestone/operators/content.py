"""Searches in texts."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as functions
from lodestone.operators.search import ranked

AROUND, SHORTEST_KEY, LARGEST_LIMIT = 80, 3, 200


@dataclass(frozen=True)
class ContentConfig:
    """Which files have their content indexed."""

    extensions: frozenset[str] = frozenset()
    largest: int = 1 << 20

    def __post_init__(self):
        if len(self.extensions) > 256 or any(not e or len(e) > 64 or e.startswith(".") for e in self.extensions):
            raise ValueError("at most 256 extensions of at most 64 characters, without the dot")
        if not 1 <= self.largest <= 100 << 20:
            raise ValueError("the largest size is between 1 byte and 100 MiB")

    def allows(self, name: Column) -> Column:
        """By extension, or by the whole name if it has none."""
        low = F.lower(name)
        dotted = low.contains(".") & ~low.endswith(".")
        return F.when(dotted, functions.extension(name)).otherwise(low).isin(list(self.extensions)) if self.extensions else F.lit(False)


def key_of(keyword: str) -> str:
    return unicodedata.normalize("NFC", keyword.lower())


def is_text(content: Column) -> Column:
    """No NUL among the first 8 KiB of a binary column."""
    return ~F.contains(F.substring(content, 1, 8192), F.unhex(F.lit("00")))


def snippet(text: Column, place: Column, size: int) -> Column:
    """What stands around ``size`` characters at ``place`` (from 1), on one line."""
    begin = F.greatest(place - 1 - AROUND, F.lit(0))
    head = F.substring(text, begin + 1, place - begin)
    # from the start of the line, if the window holds it
    begin = F.when(begin > 0, begin + F.length(head) - F.length(F.substring_index(head, "\n", -1))).otherwise(begin)
    end = F.least(place - 1 + size + AROUND, F.length(text))
    inner = F.btrim(F.translate(F.substring(text, begin + 1, end - begin), "\n\r", "  "), F.lit(" \t"))
    return F.concat(F.when(begin > 0, F.lit("...")).otherwise(F.lit("")), inner, F.when(end < F.length(text), F.lit("...")).otherwise(F.lit("")))


def content_hits(texts: DataFrame, keyword: str, canonical: bool = False) -> DataFrame:
    """(file_id, match_offset, snippet) of all texts (file_id, text) that hold the keyword; offsets in bytes.

    Keywords under three bytes find nothing. The texts are taken to be in composed form, unless ``canonical`` asks for
    texts of any form: then they are composed first, and offsets are those of the composed text.
    """
    key = key_of(keyword)
    if canonical and not key.isascii():  # an ASCII key may stand before a mark, where a composed text hasn't got it
        texts = texts.withColumn("text", functions.composed(F.col("text")))
    place = F.instr(F.lower("text"), key)
    found = texts.filter(F.lower("text").contains(key) if len(key.encode()) >= SHORTEST_KEY else F.lit(False))
    offset = F.octet_length(F.substring("text", F.lit(1), place - 1)).cast("long")
    return found.select("file_id", offset.alias("match_offset"), snippet(F.col("text"), place, len(key)).alias("snippet"))


def content_search(texts: DataFrame, keyword: str, limit: int = LARGEST_LIMIT) -> DataFrame:
    """The first hits by id, at most LARGEST_LIMIT, with ``rank``."""
    return ranked(content_hits(texts, keyword), min(limit, LARGEST_LIMIT), [F.col("file_id")])


def with_records(matches: DataFrame, catalog: DataFrame) -> DataFrame:
    """Matches with their files' names and full paths."""
    named = catalog.select("file_id", "name", functions.full_path(F.col("path"), F.col("name")).alias("full_path"))
    return matches.join(named, "file_id")


def refresh(index: DataFrame, texts: DataFrame) -> DataFrame:
    """(file_id, content_hash, mod_time, change) of texts (file_id, text, mod_time) against an index of the first three:
    unchanged where the time or the hash is the same, else upserted; removed where the text is gone."""
    new = texts.select("file_id", F.xxhash64("text").alias("content_hash"), "mod_time")
    old = index.select("file_id", F.col("content_hash").alias("old_hash"), F.col("mod_time").alias("old_time"))
    same = F.coalesce((F.col("old_time") == F.col("mod_time")) | (F.col("old_hash") == F.col("content_hash")), F.lit(False))
    change = F.when(F.col("mod_time").isNull(), "removed").when(same, "unchanged").otherwise("upserted")
    return new.join(old, "file_id", "full").select("file_id", F.coalesce("content_hash", "old_hash").alias("content_hash"), F.coalesce("mod_time", "old_time").alias("mod_time"), change.alias("change"))


def stale(index: DataFrame, live: DataFrame) -> DataFrame:
    """Index entries whose file isn't there any more."""
    return index.join(live.select("file_id"), "file_id", "left_anti")
