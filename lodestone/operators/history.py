"""Query history, suggestions, quick filters and latency statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.query.filters import BUNDLE, DIRECTORY, FILE

SHORTEST = 2

#: Tokens that quick filters add to a query.
QUICK_FILTERS = {
    "all": "",
    "files": "type:file",
    "folders": "type:folder",
    "documents": "doc:",
    "images": "pic:",
    "code": "ext:swift;h;m;mm;cpp;c;hpp;rs;go;py;js;ts;tsx;jsx;java;kt;rb;php;sh;zsh;json;xml;yml;yaml;toml;sql;css;scss;html",
    "archives": "zip:",
}

#: Extensions that quick filters take among recent files.
RECENT_EXTENSIONS = {
    "documents": "pdf doc docx xls xlsx ppt pptx txt md rtf pages numbers key".split(),
    "images": "jpg jpeg png gif bmp tiff webp svg heic heif".split(),
    "code": "swift h m mm cpp c hpp rs go py js ts tsx jsx java kt rb php sh zsh json xml yml yaml toml sql css scss html".split(),
    "archives": "zip rar 7z tar gz bz2 xz tgz zst lz4".split(),
}


def compose(query: str, quick: str = "all", size: str | tuple[float, float] | None = None, modified: str | tuple[str, str] | None = None) -> str:
    """A query with a quick filter and presets of size (a name, or two numbers of MB) and date (a name, or two days)."""
    sizes = {"under_1mb": "size:<1mb", "1_to_100mb": "size:1mb..100mb", "over_100mb": "size:>100mb"}
    dates = {"today": "dm:today", "last_7_days": "dm:last7days", "last_30_days": "dm:last30days"}
    parts = [query.strip(), QUICK_FILTERS[quick]]
    if isinstance(size, tuple):
        low, high = sorted(max(0, x) for x in size)
        parts.append(f"size:{low:g}mb..{high:g}mb")
    elif size:
        parts.append(sizes[size])
    if isinstance(modified, tuple):
        parts.append("dm:" + "..".join(sorted(modified)))
    elif modified:
        parts.append(dates[modified])
    return " ".join(p for p in parts if p)


def quick_recent(recent: DataFrame, quick: str) -> DataFrame:
    """Recent files of a quick filter; bundles count as files here."""
    if quick == "all":
        return recent
    if quick in ("files", "folders"):
        return recent.filter(F.col("type").isin([FILE, BUNDLE] if quick == "files" else [DIRECTORY]))
    name = F.lower("name")
    return recent.filter(name.contains(".") & F.substring_index(name, ".", -1).isin(RECENT_EXTENSIONS[quick]))


def frequencies(log: DataFrame) -> DataFrame:
    """(query, uses, last_used) of a log (query, at); short queries and content searches don't count."""
    own = log.withColumn("query", F.lower(F.btrim("query"))).filter((F.length("query") >= SHORTEST) & ~F.col("query").rlike("^(content|infile):"))
    return own.groupBy("query").agg(F.count("*").alias("uses"), F.max("at").alias("last_used"))


def best_match(counted: DataFrame, prefix: str) -> DataFrame:
    """The most used, then most recent, longer query that starts so; one row at most."""
    low = prefix.lower()
    return counted.filter(F.col("query").startswith(low) & (F.col("query") != low)).orderBy(F.desc("uses"), F.desc("last_used"), "query").limit(1)


def shortest_keyword(keywords: DataFrame, prefix: str) -> DataFrame:
    """The shortest, then first, keyword (column keyword) that starts so; one row at most."""
    low = prefix.lower()
    return keywords.filter(F.lower("keyword").startswith(low) & (F.lower("keyword") != low)).orderBy(F.length("keyword"), "keyword").limit(1)


def latencies(timings: DataFrame) -> DataFrame:
    """Statistics of (query, ms) for each query."""
    at = lambda p: F.percentile("ms", F.lit(p))
    return timings.groupBy("query").agg(F.avg("ms").alias("mean"), at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.stddev("ms").alias("stddev"))
