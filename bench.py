"""Headline queries over the star-schema tables; prints one JSON line.

Catalogs are built once and kept in memory, as the searches that they are compared with are warm and in memory; the
value is the sum of these. Beside them stand ``floor``, the time of a query of one row, which any query costs, and the
same kinds of search over the saved catalog (``parquet_...``), by scanning and with the name index (``..._indexed``).
Each query runs once to warm up and then three times; its time is the median.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from lodestone import catalog as catalogs
from lodestone.operators import content, listing, mutations
from lodestone.operators.postings import NameIndex
from lodestone.operators.search import search, subtree
from lodestone.query.dates import Clock
from lodestone.sources import adapters
from lodestone.suite import A, B

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
CLOCK = Clock()

SEARCHES = {
    "term_long": "supplier_000000042",
    "term_medium": "europe",
    "term_two": "asia l12",
    "term_or_not": "l12|l13 !nf",
    "glob": "*.rf",
    "glob_path": "*/france/*",
    "ext": "ext:nf",
    "size": "size:1mb..2mb",
    "date": "dm:1995-06",
    "regex": r"regex:_3\.(rf|no)$",
    "segments": "europe/france/l1",
    "none": "zzzznotfound",
}

#: Kinds of search that aren't in the sum.
MORE = {"ideograph": "中文", "short_term": "l1", "term_common": "supplier"}

#: Searches of the saved catalog.
SAVED = {"term_rare": "l12345_", "term_long": "supplier_000000042", "term_two": "france l12", "regex": r"regex:l1234\d_3\.", "none": "zzzznotfound"}


def timed(make) -> float:
    """Median seconds of three runs after a warm-up."""
    out = []
    for _ in range(4):
        t = time.perf_counter()
        df: DataFrame = make()
        df.collect()
        out.append(time.perf_counter() - t)
    return round(statistics.median(out[1:]), 4)


def saved(spark: SparkSession, lines: DataFrame, rows: int) -> dict[str, float]:
    """Searches of the catalog on disk, with and without the name index."""
    folder, out = tempfile.mkdtemp(prefix="bench-"), {}
    try:
        t = time.perf_counter()
        catalogs.save(lines, f"{folder}/catalog")
        out["save_catalog"] = round(time.perf_counter() - t, 4)
        files = spark.read.parquet(f"{folder}/catalog")
        t = time.perf_counter()
        NameIndex.of(files).save(f"{folder}/index")
        out["save_index"] = round(time.perf_counter() - t, 4)
        index = NameIndex.load(spark, f"{folder}/index", rows)
        for name, query in SAVED.items():
            out[f"parquet_{name}"] = timed(lambda query=query: search(files, query, 100, CLOCK))
            out[f"parquet_{name}_indexed"] = timed(lambda query=query: search(files, query, 100, CLOCK, index=index))
        out["parquet_subtree"] = timed(lambda: subtree(files, "/europe/france/supplier_000000042").groupBy().count())
    finally:
        shutil.rmtree(folder)
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {}
    t = time.perf_counter()
    lines = adapters.catalog(spark, SF_DIR, B).repartition(int(CPUS)).persist()
    rows = lines.count()
    queries["build_catalog"] = round(time.perf_counter() - t, 4)
    for name, query in SEARCHES.items():
        queries[name] = timed(lambda query=query: search(lines, query, 100, CLOCK))
    parts = adapters.catalog(spark, SF_DIR, A).persist()
    parts.count()
    queries["dir_list"] = timed(lambda: search(parts, "brand_2/economy/*", 100, CLOCK))
    queries["recent"] = timed(lambda: listing.recent(lines, 200))
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("doc_id file_id", "text")
    queries["content"] = timed(lambda: content.content_search(texts, "license", 100))
    changes = adapters.project(spark, SF_DIR, "changes")
    empty = spark.sql("select cast(null as bigint) file_id, '' name, '' path, 1 type, cast(0 as bigint) size, cast(0 as bigint) mod_time limit 0")
    queries["replay"] = timed(lambda: mutations.apply(empty, changes).groupBy().count())
    total = round(sum(v for k, v in queries.items() if k != "build_catalog"), 4)
    queries["floor"] = timed(lambda: spark.range(1))
    queries |= {name: timed(lambda query=query: search(lines, query, 100, CLOCK)) for name, query in MORE.items()}
    queries |= saved(spark, lines, rows)
    print(json.dumps({"metric": "seconds of all searches, warm", "value": total, "unit": "sec", "queries": queries, "rows": rows, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
