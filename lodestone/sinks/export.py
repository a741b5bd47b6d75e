"""Results as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text

COLUMNS = ["name", "path", "ext", "size", "modified", "snippet"]


def export_columns(results: DataFrame) -> DataFrame:
    """COLUMNS as strings; times are ISO 8601 in UTC, missing snippets empty. Of content matches, which have a snippet,
    extension, size and time are empty."""
    # seconds go through an interval, so that the session's time zone doesn't matter
    utc = F.expr("date_format(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, mod_time), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    if "snippet" in results.columns:
        empty = [F.lit("").alias(c) for c in ("ext", "size", "modified")]
        return results.select("file_id", "name", "path", *empty, F.coalesce("snippet", F.lit("")).alias("snippet"))
    return results.select("file_id", "name", "path", text.extension(F.col("name")).alias("ext"), F.col("size").cast("string").alias("size"), utc.alias("modified"), F.lit("").alias("snippet"))


def _field(c: Column) -> Column:
    """Quoted; what a spreadsheet would take for a formula gets an apostrophe."""
    safe = F.when(c.rlike("^[=+@\t\r-]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(results: DataFrame) -> DataFrame:
    """(file_id, line)."""
    return export_columns(results).select("file_id", F.concat_ws(",", *[_field(F.col(c)) for c in COLUMNS]).alias("line"))


def txt_lines(results: DataFrame) -> DataFrame:
    return export_columns(results).select("file_id", F.concat_ws("\t", *[F.translate(c, "\t\r\n", "   ") for c in COLUMNS]).alias("line"))


def json_lines(results: DataFrame) -> DataFrame:
    """Objects with name, path (in full), type, size and modTime, or of content matches."""
    full = text.full_path(F.col("path"), F.col("name"))
    if "snippet" in results.columns:
        fields = F.struct(F.col("name").alias("fileName"), full.alias("filePath"), "snippet", F.col("match_offset").alias("matchOffset"))
    else:
        fields = F.struct("name", full.alias("path"), "type", "size", F.col("mod_time").alias("modTime"))
    return results.select("file_id", F.to_json(fields).alias("line"))


def path_lines(results: DataFrame) -> DataFrame:
    return results.select("file_id", text.full_path(F.col("path"), F.col("name")).alias("line"))


def write_separated(lines: DataFrame, target: str, separator: str = "\0") -> None:
    """Lines as text files that end each line with the separator, by default NUL, as paths may hold line ends."""
    lines.select("line").write.mode("overwrite").option("lineSep", separator).text(target)


def write_lines(lines: DataFrame, target: str, header: str | None = None) -> None:
    """Lines as text files. A header, with a byte order mark, makes it one file, as is meant for a window of results."""
    own = lines.select("line")
    if header is not None:
        spark = lines.sparkSession
        own = spark.createDataFrame([("﻿" + header,)], "line string").unionAll(own).coalesce(1)
    own.write.mode("overwrite").text(target)
