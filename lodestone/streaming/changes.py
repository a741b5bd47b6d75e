"""Streams of changes into a catalog.

A catalog on disk is a base and a log of changes by micro-batch. A batch appends its own folder, and writing it again
after a failure replaces just that, so replays change nothing; readers merge the base and the log by key, and
``compact`` folds the log into a new base. Appending costs what the batch holds, not what the catalog holds. Records
that the log puts have ids beyond those of the base, by a number that is written with the base.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.catalog import RECORD, records
from lodestone.operators import mutations
from lodestone.query.filters import FILE
from lodestone.sources import scan

CHANGE = "seq long, op string, target string, name string, path string, type int, size long, mod_time long"
NAMES = [c.split()[0] for c in CHANGE.split(", ")]
#: Parts of paths whose events say nothing, and pairs of such parts.
NOISY, NOISY_PAIRS = ("/.Spotlight-V100/", "/.fseventsd/", "/.Trashes/"), (("/private/var/folders/", "/com.apple."),)


@dataclass
class ChangeTable:
    """``path`` holds base folders and log folders; the newest whole base counts."""

    spark: SparkSession
    path: str

    def _fs(self, *parts: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind that were written to the end."""
        where, fs = self._fs(kind)
        if not fs.exists(where):
            return []
        whole = [s.getPath() for s in fs.listStatus(where) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in whole)

    def _base(self) -> int:
        """The newest base; -2 if there is none, which is an empty one."""
        return max(self._numbers("base"), default=-2)

    def _write(self, files: DataFrame, upto: int) -> None:
        """A base and, before it counts, the first id that is free beyond it."""
        staged = f"{self.path}/staged/upto={upto}"
        records(files).write.mode("overwrite").parquet(staged)
        first = self.spark.read.parquet(staged).agg(F.coalesce(F.max("file_id") + 1, F.lit(0)).alias("first_id"))  # one row
        first.write.mode("overwrite").parquet(f"{self.path}/first/upto={upto}")
        (source, fs), (target, _) = self._fs("staged", f"upto={upto}"), self._fs("base", f"upto={upto}")
        fs.mkdirs(target.getParent())
        fs.delete(target, True)
        if not fs.rename(source, target):
            raise OSError(f"can't move the new base to {target}")

    def create(self, files: DataFrame) -> None:
        self._write(files, max([*self._numbers("log"), *self._numbers("base"), -1]))

    def append(self, changes: DataFrame, batch: int) -> None:
        """With checksums; idempotent by batch. A batch that a base already holds is dropped."""
        if batch > self._base():
            scan.with_checksum(changes.select(NAMES)).write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def log(self) -> DataFrame | None:
        """The changes since the base, up to the first whose checksum is wrong."""
        newer = [f"{self.path}/log/batch={b}" for b in self._numbers("log") if b > self._base()]
        return scan.read_log(self.spark, *newer) if newer else None

    def read(self) -> DataFrame:
        upto, log = self._base(), self.log()
        files = self.spark.read.parquet(f"{self.path}/base/upto={upto}") if upto >= -1 else self.spark.createDataFrame([], RECORD)
        if log is None:
            return files
        first = self.spark.read.parquet(f"{self.path}/first/upto={upto}").first()[0] if upto >= -1 else 0  # one number
        return mutations.apply(files, log, first)

    def compact(self) -> None:
        """A new base from all batches so far; readers keep the old one until it is whole."""
        batches = self._numbers("log")
        if batches and batches[-1] > self._base():
            self._write(self.read(), batches[-1])

    def resume(self, log: DataFrame, watermark: int, rescan: Callable[[], DataFrame], batch: int) -> bool:
        """Go on after the change of that seq. Where the log doesn't reach back to it, what it would have said is lost: the
        table is made anew from a complete scan. Whether the log sufficed."""
        oldest = log.agg(F.min("seq")).first()[0]  # one number
        if oldest is not None and oldest > watermark + 1:
            self.create(scan.complete(rescan()))
            return False
        self.append(log.filter(F.col("seq") > watermark), batch)
        return True

    def poll(self, rescan: Callable[[], DataFrame], checkpoint: str, seconds: int = 60) -> StreamingQuery:
        """Every so many seconds, append what a scan of roots that send no events has found to differ. A scan with errors
        changes nothing."""

        def tick(_: DataFrame, batch: int) -> None:
            found = rescan()
            if found.filter("error is not null").isEmpty():
                self.append(mutations.difference(self.read(), records(found), batch), batch)

        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()

    def follow(self, changes: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Append a stream of CHANGE rows; the checkpoint is where it goes on."""
        write = changes.writeStream.foreachBatch(lambda batch, i: self.append(batch, i)).option("checkpointLocation", checkpoint)
        return write.trigger(**(trigger or {"availableNow": True})).start()


def relevant(events: DataFrame, config: scan.ScanConfig | None = None) -> DataFrame:
    """Events (full_path, ...) but for those of noisy paths and, with a scan's config, of paths that it leaves out."""
    padded = F.concat("full_path", F.lit("/"))
    quiet: Column = F.lit(True)
    for parts in [*((p,) for p in NOISY), *NOISY_PAIRS]:
        noisy = F.lit(True)
        for p in parts:
            noisy &= padded.contains(p)
        quiet &= ~noisy
    own = events.filter(quiet)
    return own if config is None else own.filter(scan.allowed(config, F.col("full_path"), F.substring_index("full_path", "/", -1)))


def routed(events: DataFrame) -> DataFrame:
    """Events (seq, full_path, exists, must_rescan, is_dir, name, path, type, size, mod_time) as changes, with ``rescan``
    the subtree to scan anew (a flagged path itself, or a vanished directory's parent) and ``content`` what becomes of the
    file's indexed text (upsert or remove). Where ``exists`` is null the path couldn't be looked at, which is no evidence
    that it's gone: the event is dropped."""
    events = events.filter("exists is not null")
    gone = ~F.col("exists")
    parent = F.regexp_replace("full_path", "/[^/]*$", "")
    rescan = F.when(F.col("must_rescan"), F.col("full_path")).when(gone & F.col("is_dir"), F.when(parent == "", "/").otherwise(parent))
    return events.select("seq", F.when(gone, "REMOVE").otherwise("UPDATE").alias("op"), F.col("full_path").alias("target"), "name", "path", "type", "size", "mod_time", rescan.alias("rescan"), F.when(~gone & (F.col("type") == FILE), "upsert").otherwise("remove").alias("content"))


def moved(events: DataFrame, files: DataFrame) -> DataFrame:
    """REMOVE changes of the paths that files were at before: an event (seq, full_path, exists, inode, dev_id, ...) saw the
    same inode and device elsewhere, and no event of this batch saw a file at the old path."""
    seen = events.filter("exists")
    there = seen.select(F.lower("full_path").alias("there")).distinct()
    old = mutations.renamed_from(seen.select("inode", "dev_id", "full_path"), files).select("inode", "dev_id", "old_path").distinct()
    lost = old.join(there, F.lower("old_path") == F.col("there"), "left_anti")
    by = seen.groupBy("inode", "dev_id").agg(F.max("seq").alias("seq"))
    name, path = F.substring_index("old_path", "/", -1), F.regexp_replace("old_path", "/[^/]*$", "")
    gone = lost.join(by, ["inode", "dev_id"]).withColumns({"op": F.lit("REMOVE"), "target": F.col("old_path"), "name": name, "path": path, "type": F.lit(FILE)})
    return gone.select("seq", "op", "target", "name", "path", "type", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mod_time"))


def sessions(requests: DataFrame, quiet: str = "5 seconds") -> DataFrame:
    """(root, first_at, last_at, requests): requests (root, at) that follow each other within ``quiet``, for batches and,
    with a watermark on ``at``, for streams."""
    return requests.groupBy("root", F.session_window("at", quiet).alias("s")).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("requests")).drop("s")


def throttled(rescans: DataFrame, seconds: int = 300) -> DataFrame:
    """(root, run_at, first_at, last_at, requests): when sessions (root, first_at, last_at, requests) are run.

    A session runs when it ends, unless its root was run less than so many seconds before: then it waits until these are
    over, and sessions that end meanwhile are run with it. Roots' sessions are sorted and passed through one at a time.
    """
    parts = int(rescans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rescans.schema["root"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, last_run, waiting = None, None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if waiting and (r["root"] != root or r["last"] > waiting["run_at"]):
                    out.append(waiting)
                    waiting, last_run = None, waiting["run_at"]
                if r["root"] != root:
                    root, last_run = r["root"], None
                if waiting:
                    waiting |= {"first": min(waiting["first"], r["first"]), "last": r["last"], "requests": waiting["requests"] + r["requests"]}
                else:
                    run_at = r["last"] if last_run is None else max(r["last"], last_run + seconds * 1_000_000)
                    waiting = {"root": root, "run_at": run_at, "first": r["first"], "last": r["last"], "requests": r["requests"]}
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("root", b.schema.field("root").type), *((c, pa.int64()) for c in ("run_at", "first", "last", "requests"))]))
        if waiting:
            yield pa.RecordBatch.from_pylist([waiting], pa.schema([("root", b.schema.field("root").type), *((c, pa.int64()) for c in ("run_at", "first", "last", "requests"))]))

    micros = rescans.select("root", F.unix_micros("first_at").alias("first"), F.unix_micros("last_at").alias("last"), F.col("requests").cast("long").alias("requests"))
    passed = micros.repartition(parts, "root").sortWithinPartitions("root", "last", "first").mapInArrow(run, f"root {kind}, run_at long, first long, last long, requests long")
    at = lambda c, name: F.timestamp_micros(c).alias(name)
    return passed.select("root", at("run_at", "run_at"), at("first", "first_at"), at("last", "last_at"), "requests")


def gaps(requests: DataFrame, seconds: int = 5) -> DataFrame:
    """The batch form of sessions(): a session starts where the gap before is longer. Sessions are first made within
    stretches of time, so that a root with many requests has many tasks, and then joined across these."""
    stretch = F.expr(f"unix_seconds(at) div {max(1, seconds) * 256}")
    near = requests.groupBy("root", stretch.alias("stretch"), F.session_window("at", f"{seconds * 1_000_000 + 1} microseconds").alias("s"))
    some = near.agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("requests")).drop("s", "stretch")
    w = Window.partitionBy("root").orderBy("first_at")
    new = F.coalesce(F.unix_micros("first_at") - F.unix_micros(F.lag("last_at").over(w)) > seconds * 1_000_000, F.lit(True))
    numbered = some.withColumn("new", new.cast("int")).withColumn("s", F.sum("new").over(w))
    return numbered.groupBy("root", "s").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("requests").alias("requests")).drop("s")
