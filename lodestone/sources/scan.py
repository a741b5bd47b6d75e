"""Catalogs from file systems and tables."""

from __future__ import annotations

import fnmatch
import itertools
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import records
from lodestone.functions import text
from lodestone.operators.content import is_text
from lodestone.query.filters import BUNDLE, DIRECTORY, FILE, OTHER, SYMLINK

#: Paths and components that system filtering leaves out.
SYSTEM_PATHS = ("/System", "/private/var")
SYSTEM_COMPONENTS = ("Library/Caches", ".Spotlight-V100", ".fseventsd", ".Trashes")


@dataclass(frozen=True)
class ScanConfig:
    roots: tuple[str, ...]
    hidden: bool = False
    system: bool = False
    excluded: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    bundles: bool = False
    other_devices: bool = False

    @property
    def exclusions(self) -> list[str]:
        """Excluded paths, but for those that hold a root: naming a root takes it in."""
        return [x for x in self.excluded if x and not any(_holds(x, r) for r in self.roots)]

    @property
    def system_roots(self) -> list[str]:
        """Roots that system filtering would leave out; it doesn't hold below them."""
        return [r for r in self.roots if r != "/" and is_system(r)]

    def skips(self, path: str, name: str) -> bool:
        """Is this entry, and all below it, left out?"""
        if not self.hidden and name.startswith("."):
            return True
        if any(_holds(x, path) for x in self.exclusions):
            return True
        if not self.system and is_system(path) and not any(_holds(r, path) for r in self.system_roots):
            return True
        return any(fnmatch.fnmatchcase(name.lower(), p.lower()) for p in self.patterns)


def _holds(outer: str, path: str) -> bool:
    """Is the path the outer one or below it? Ignores case."""
    return (path.lower().rstrip("/") + "/").startswith(outer.lower().rstrip("/") + "/")


def is_system(path: str) -> bool:
    """Does system filtering leave the path out?"""
    return any(f"{path}/".startswith(x + "/") for x in SYSTEM_PATHS) or any(f"/{c}/" in f"{path}/" for c in SYSTEM_COMPONENTS)


def _kind(mode: int, name: str) -> int:
    if stat.S_ISDIR(mode):
        return BUNDLE if name.lower().endswith(".app") else DIRECTORY
    return FILE if stat.S_ISREG(mode) else SYMLINK if stat.S_ISLNK(mode) else OTHER


def entries(root: str, config: ScanConfig, deep: bool) -> Iterator[dict]:
    """Records below a directory; with ``deep`` of its whole subtree, else of its direct children."""
    try:
        pending, device, seen = [root], os.stat(root).st_dev, set()
    except OSError as e:
        yield {"error": f"{root}: {e.strerror}"}
        return
    while pending:
        directory = pending.pop()
        try:
            found = sorted(os.scandir(directory), key=lambda e: e.name)
        except OSError as e:
            yield {"error": f"{directory}: {e.strerror}"}
            continue
        for entry in found:
            if config.skips(entry.path, entry.name):
                continue
            try:
                s = entry.stat(follow_symlinks=False)
            except OSError as e:
                yield {"error": f"{entry.path}: {e.strerror}"}
                continue
            kind, identity = _kind(s.st_mode, entry.name), (s.st_dev, s.st_ino)
            if kind in (DIRECTORY, BUNDLE):
                if identity in seen or (s.st_dev != device and not config.other_devices):
                    continue
                seen.add(identity)
                if deep and (kind == DIRECTORY or config.bundles):
                    pending.append(entry.path)
            parent = directory.rstrip("/") if directory != "/" else ""
            yield {"name": entry.name, "path": parent, "type": kind, "size": 0 if kind in (DIRECTORY, BUNDLE) else s.st_size, "mod_time": int(s.st_mtime), "inode": s.st_ino & (1 << 63) - 1, "dev_id": s.st_dev & 0x7FFFFFFF}


_ENTRY = "name string, path string, type int, size long, mod_time long, inode long, dev_id int, error string"
_ARROW = pa.schema([("name", pa.string()), ("path", pa.string()), ("type", pa.int32()), ("size", pa.int64()), ("mod_time", pa.int64()), ("inode", pa.int64()), ("dev_id", pa.int32()), ("error", pa.string())])


#: Directories from which on subtrees are listed as a whole, and levels after which they are in any case.
ENOUGH, LEVELS = 1024, 32


def scan(spark: SparkSession, config: ScanConfig, enough: int = ENOUGH) -> DataFrame:
    """All entries below the roots, with ``error`` where one, or a root, couldn't be read.

    Directories are listed level by level until a level has ``enough`` of them, so that one large top-level directory
    isn't one task; then each one's subtree is listed as a whole, in as many tasks. A directory that two ways lead to is
    taken once, by its least path. Ids are a hash of the lower-case path.
    """

    def listing(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for directory in b.column("directory").to_pylist():
                    found = entries(directory, config, deep)
                    while rows := list(itertools.islice(found, 10_000)):
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)

        return run

    level, n, levels = spark.createDataFrame([(r,) for r in config.roots], "directory string"), len(config.roots), []
    while 0 < n < enough and len(levels) < LEVELS:
        levels.append(level.repartition(n, "directory").mapInArrow(listing(False), _ENTRY).persist())
        inner = levels[-1].filter(F.col("type").isin([DIRECTORY, BUNDLE] if config.bundles else [DIRECTORY]))
        level = inner.select(text.full_path(F.col("path"), F.col("name")).alias("directory"))
        n = level.count()
    if n:
        levels.append(level.repartition(min(n, 16 * enough), "directory").mapInArrow(listing(True), _ENTRY))
    found = reduce(DataFrame.unionAll, levels)
    directory = F.col("type").isin(DIRECTORY, BUNDLE)
    once = found.filter(directory).groupBy("dev_id", "inode").agg(F.min_by(F.struct(*found.columns), "path").alias("r")).select("r.*")
    whole = found.filter(~directory | F.col("error").isNotNull()).unionByName(once)
    key = F.lower(text.full_path(F.col("path"), F.col("name")))
    return whole.withColumn("file_id", F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1)))


def complete(scanned: DataFrame) -> DataFrame:
    """The records of a scan; refuses one with errors, so that it can't replace a whole catalog."""
    wrong = scanned.filter("error is not null").select("error").take(3)
    if wrong:
        raise ValueError("the scan isn't complete: " + "; ".join(r.error for r in wrong))
    return records(scanned)


def allowed(config: ScanConfig, full_path: Column, name: Column) -> Column:
    """The same policy as a column, for records that come from elsewhere: inside a root and not left out.

    Excluding a directory excludes what is below it, so hidden and pattern rules look at all components below the root.
    """
    out = [text.within(full_path, x) for x in config.exclusions]
    if not config.system:
        system = [(full_path == x) | full_path.startswith(x + "/") for x in SYSTEM_PATHS]
        system += [F.concat(full_path, F.lit("/")).contains(f"/{c}/") for c in SYSTEM_COMPONENTS]
        out.append(text.any_of(system) & ~text.any_of([text.within(full_path, r) for r in config.system_roots]))
    # each pattern matches one whole component
    patterns = ([r"\."] if not config.hidden else []) + [f"{_component_pattern(p)}(/|$)" for p in config.patterns]

    def inside(root: str) -> Column:
        below = F.lower(F.substring(full_path, F.lit(len(root.rstrip("/")) + 1), F.length(full_path)))
        return text.within(full_path, root) & ~text.any_of([below.rlike(f"/{p}") for p in patterns])

    return text.any_of([inside(r) for r in config.roots]) & ~text.any_of(out)


def _component_pattern(glob: str) -> str:
    """A regular expression for a file-name pattern that stays inside one component."""
    out, i, low = [], 0, glob.lower()
    while i < len(low):
        c, end = low[i], low.find("]", i + 2)
        if c == "[" and end > 0:
            body = low[i + 1 : end].replace("\\", r"\\").replace("[", r"\[")
            out.append(f"[^/{body[1:]}]" if body[0] in "!^" else f"[{body}]")
            i = end
        else:
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
        i += 1
    return "".join(out)


def texts_of(scanned: DataFrame, largest: int = 1 << 20) -> DataFrame:
    """(file_id, text, size, mod_time) of a scan's regular files that hold text: of 1 to ``largest`` bytes, without NUL near
    the start. Files are read where they are, and links are never followed; what can't be read any more is left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_id, path, mod_time in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
                except OSError:
                    continue
                with os.fdopen(handle, "rb") as f:
                    s = os.fstat(handle)
                    if not stat.S_ISREG(s.st_mode) or not 1 <= s.st_size <= largest:
                        continue
                    data = f.read(largest)
                if b"\0" not in data[:8192]:
                    yield pa.RecordBatch.from_pylist([{"file_id": file_id, "text": data.decode("utf-8", "replace"), "size": len(data), "mod_time": mod_time}], schema)

    schema = pa.schema([("file_id", pa.int64()), ("text", pa.string()), ("size", pa.int64()), ("mod_time", pa.int64())])
    own = scanned.filter((F.col("type") == FILE) & F.col("size").between(1, largest))
    return own.select("file_id", text.full_path(F.col("path"), F.col("name")).alias("full_path"), "mod_time").mapInArrow(read, "file_id long, text string, size long, mod_time long")


def read_texts(spark: SparkSession, paths: str | list[str], largest: int = 1 << 20) -> DataFrame:
    """(full_path, text, size, mod_time) of text files in any store: of 1 to ``largest`` bytes, without NUL near the start.
    Where a store has links, the store decides whether they are followed; see texts_of()."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    own = files.filter(F.col("length").between(1, largest)).filter(is_text(F.col("content")))
    return own.select(F.regexp_replace("path", "^file:/*", "/").alias("full_path"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mod_time"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_log(spark: SparkSession, *paths: str) -> DataFrame:
    """A change log's valid prefix: rows with a checksum, up to the first whose checksum is wrong."""
    log = spark.read.parquet(*paths)
    payload = [c for c in log.columns if c != "crc"]
    checked = log.withColumn("_ok", F.crc32(F.to_json(F.struct(*payload))) == F.col("crc"))
    bad = checked.filter("not _ok or crc is null").agg(F.min("seq")).first()[0]  # one number
    kept = checked if bad is None else checked.filter(F.col("seq") < bad)
    return kept.drop("_ok", "crc")


def with_checksum(changes: DataFrame) -> DataFrame:
    return changes.withColumn("crc", F.crc32(F.to_json(F.struct(*changes.columns))))


def with_ids(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the file_ids of another table."""
    return catalog.join(ids.select("file_id"), "file_id", "left_semi")


def between(catalog: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of a range of ids."""
    return catalog.filter(F.col("file_id").between(first, last))
