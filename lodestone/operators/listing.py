"""Lists, sorts and counts of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.catalog import by_id
from lodestone.functions import text
from lodestone.operators.search import ranked
from lodestone.query.filters import DIRECTORY

MOST_RECENT = 200
SORTS = {"name": "name_lc", "ext": "ext", "path": "_full", "size": "size", "modified": "mod_time"}


def recent(catalog: DataFrame, limit: int) -> DataFrame:
    """The last modified, at most MOST_RECENT; of equal times the larger id first."""
    order = [F.desc("mod_time"), *(c.desc() for c in by_id())]
    return ranked(catalog.filter("type <> 0"), min(limit, MOST_RECENT), order).select("file_id", "name", "path", "type", "size", "mod_time", "rank")


def sort_results(results: DataFrame, by: str, descending: bool = False, limit: int | None = None) -> DataFrame:
    """Results by a column: directories first but for paths, then the full path. They are a search's window; without a
    limit all of them stay."""
    full = F.lower(text.full_path(F.col("path"), F.col("name")))
    own = results.drop("rank").withColumns({"_full": full, "name_lc": F.lower("name"), "ext": text.extension(F.col("name"))})
    key = F.col(SORTS[by])
    order = [*([] if by == "path" else [F.when(F.col("type") == DIRECTORY, 0).otherwise(1)]), key.desc() if descending else key.asc(), F.col("_full"), *by_id()]
    top = own if limit is None else own.orderBy(*order).limit(max(0, limit))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("file_id", "name", "path", "type", "size", "mod_time", "rank")


def counts_by_type(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("type").agg(F.count("*").alias("files"))


def status(catalog: DataFrame) -> DataFrame:
    """(records, live, dead_share): all rows, those that aren't tombstones, and the share that is."""
    live = F.count_if(F.col("type") != 0)
    return catalog.agg(F.count("*").alias("records"), live.alias("live"), (1 - live / F.count("*")).alias("dead_share"))


def breakdown(catalog: DataFrame) -> DataFrame:
    """(part, entries, bytes): what each part of the catalog holds."""
    one = lambda name, entries, size: F.struct(F.lit(name).alias("part"), entries.cast("long").alias("entries"), size.cast("long").alias("bytes"))
    total = catalog.agg(F.count("*").alias("n"), F.sum(F.octet_length("name")).alias("names"), F.sum(F.octet_length("name_lc")).alias("lower"))
    paths = catalog.groupBy("path").agg(F.lit(1)).agg(F.count("*").alias("p"), F.sum(F.octet_length("path")).alias("paths"))
    ext = catalog.filter("ext <> ''").groupBy("ext").agg(F.count("*").alias("k")).agg(F.count("*").alias("e"), F.sum(F.octet_length("ext") + 8 * F.col("k")).alias("exts"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = [total.select(one("names", F.col("n"), zero("names")).alias("r")), total.select(one("lower_names", F.col("n"), zero("lower")).alias("r")), paths.select(one("paths", F.col("p"), zero("paths")).alias("r")), ext.select(one("extensions", F.col("e"), zero("exts")).alias("r")), total.select(one("records", F.col("n"), F.col("n") * 36).alias("r"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out.select("r.*")
